import random
import re
import time

import pytest
from pyspark.sql import functions as F

from helpbooks.functions import entities, paths, text


def values(spark, rows, f):
    """f applied to a one-column table, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string" + ", b string" * (isinstance(rows[0], tuple)))
    return [r[0] for r in df.orderBy("i").select(f).collect()]


def test_windows_1252(spark):
    df = spark.createDataFrame([(bytearray([0x80, 0x93, 0x8D, 0x41, 0xE9]),)], "content binary")
    assert df.select(text.decode_bytes(F.col("content"))).first()[0] == "€“\x8dAé"


def test_strip_html_and_title(spark):
    page = "<!doctype html><title>\n Rain gauges </title><style>b{}</style><p class=x>Empty <b>daily</b>&mdash;at&nbsp;dawn.<SCRIPT>let a = '<p>'</SCRIPT><br/>Note it&#33;"
    assert values(spark, [page], text.html_title(F.col("a"))) == ["Rain gauges"]
    assert values(spark, [page], text.strip_html(F.col("a"))) == ["Rain gauges Empty daily at dawn. Note it"]


@pytest.mark.parametrize("raw,plain", [("a b c﻿", "a b c"), ("&nbsp;x&#160;<!-- y -->", "x"), ("<STYLE>p{}</style>z", "z"), ("", ""), ("1 < 2", "1 < 2")])
def test_strip_edges(spark, raw, plain):
    assert values(spark, [raw], text.strip_html(F.col("a"))) == [plain]


def test_title_edges(spark):
    got = values(spark, ["<TITLE lang=x> a<b>c</b> </TITLE>", "none", "<title>&amp;</title>"], text.html_title(F.col("a")))
    assert got == ["ac", "", "&amp;"]


def test_paths(spark):
    rows = ["/srv/shelf/Garden Year.chm", "C:\\docs\\weeds.htm", "/one/two/three/", "alone", ""]
    assert values(spark, rows, paths.basename(F.col("a"))) == ["Garden Year.chm", "weeds.htm", "three", "alone", ""]
    assert values(spark, ["soil/ph.htm#test", "soil/ph.htm", "x##y", "#"], paths.strip_fragment(F.col("a"))) == ["soil/ph.htm", "soil/ph.htm", "x", ""]
    assert values(spark, ["soil.htm", "/soil.htm", "beds/raised.htm#wood", "", None], paths.page_url(F.lit("g7"), F.col("a"))) == ["chm://g7/soil.htm", "chm://g7/soil.htm", "chm://g7/beds/raised.htm#wood", None, None]
    assert values(spark, ["/Garden.CHM", "x.chm\n"], paths.book_title(F.col("a"))) == ["Garden", "x.chm\n"]


def test_mime_types(spark):
    kinds = [*paths.MIME_TYPES.items(), ("exe", "application/octet-stream"), ("", "application/octet-stream")]
    for make in ("/beds/plan.{}", "/beds/v2.PLAN.{}", "{}"):
        assert values(spark, [make.format(end) for end, _ in kinds], paths.mime_type(F.col("a"))) == [k for _, k in kinds]
    assert values(spark, [f"/x.{end.upper()}" for end, _ in kinds], paths.mime_type(F.col("a"))) == [k for _, k in kinds]


def test_safe_paths(spark):
    good = ["/", "/beds/..plan/x", "/beds/plan..", "/.../x", "/ ../x", "/a.b../c"]
    bad = ["..", "/..", "/beds/../../x", "//../x", "beds/plan.htm", " /beds"]
    assert values(spark, good + bad, paths.is_safe_path(F.col("a"))) == [True] * 6 + [False] * 6


def test_request_parts(spark):
    rows = ["chm://Book/a%20b+c.htm?q#f", "chm://b/%zz", "chm://b/x%E9x", "chm://b/%EF%BF%BD", "not a url"]
    assert values(spark, rows, paths.request_path(F.col("a"))) == ["/a b+c.htm", None, None, "/�", None]


def test_excerpt(spark):
    long = "x" * 100 + " Needle " + "y" * 100
    got = values(spark, [(long, "needle z"), (long, "absent"), ("short", "absent")], text.excerpt(F.col("a"), F.col("b")))
    assert got == ["…" + "x" * 79 + " Needle " + "y" * 79 + "…", (long[:160]).strip() + "…", "short"]


@pytest.mark.parametrize("raw,plain", [("Salt &AMP; lime &#8364;5 &#x1F331;", "Salt & lime €5 🌱"), ("&mdash;&;&#;&#x;", "&mdash;&;&#;&#x;"), ("&quot;&apos;&gt;", "\"'>"), ("x&nbsp;y", "x\u00a0y"), ("&#1114112;&#x110000;&#xD800;", "&#1114112;&#x110000;&#xD800;"), ("&amp;lt;", "&lt;"), ("&toString;", "&toString;")])
def test_entities(raw, plain):
    assert entities.decode_entities(raw) == plain


def stripped_in_order(html):
    """The six replacements one after another."""
    space = re.sub(r"\\x\{(\w{4})\}", lambda m: chr(int(m[1], 16)), text.SPACE)
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<[^>]+>", r"(?i)&nbsp;", r"(?i)&[a-z#0-9]+;", f"{space}+"):
        html = re.sub(pattern, " ", html, flags=re.A)
    return html.strip(" ")


def test_strip_is_the_replacements_in_order(spark):
    rng = random.Random(11)
    parts = ["<script", "<SCRIPT src=x>", "</script>", "</Script>", "<style>", "<style", "</STYLE>", "</style >", "<", ">", "<>", "<p>", "</p", "&nbsp;", "&NBSP;", "&amp", "&#39;", ";", "&", " ", "\n", "a", "é", "b c", "\u00a0", "\ufeff", "x>y"]
    pages = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(6000)]
    got = values(spark, pages, text.strip_html(F.col("a")))
    assert [(p, g) for p, g in zip(pages, got, strict=True) if g != stripped_in_order(p)] == []


@pytest.mark.parametrize("piece", ["<script ", "<script>", "<style>x", "<", "<b", "&a", "</script>", "<script></script>", "x > y < z "])
def test_strip_is_linear(spark, piece):
    values(spark, [piece], text.strip_html(F.col("a")))
    began = time.time()
    (got,) = values(spark, [piece * 100_000], text.strip_html(F.col("a")))
    assert time.time() - began < 8 and got[:50].strip() == stripped_in_order(piece * 50)[:50].strip()
