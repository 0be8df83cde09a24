import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpbooks import schemas
from helpbooks.jobs import scalars  # noqa: F401  registers queries
from helpbooks.jobs.registry import QUERIES
from helpbooks.functions import paths
from helpbooks.operators import clickstream, links, navigation, reconcile, requests, search, sitemap
from helpbooks.sources import books

CONTENTS = """<object type="text/site properties"><param name="Window" value="main"></object>
<ul>
 <li><object type="text/sitemap"><param name="Name" value="Sowing"><param name="Local" value="spring/sowing.html"></object>
  <ul>
   <li><object type="text/sitemap"><param name="Local" value="spring/peas.html#depth"><param name="Name" value="Peas &lt;early&gt;"></object>
    <ul><li><object type="text/sitemap"><param name="Name" value="Frost"></object></ul>
  </ul>
 <li><object type="text/sitemap"><param name="Name" value="Harvest"><param name="Local" value="autumn.html"></object>
</ul>"""


def obj(name=None, *local):
    params = "".join(f'<param name="Local" value="{x}">' for x in local)
    return '<object type="text/sitemap">' + (f'<param name="Name" value="{name}">' if name is not None else "") + params + "</object>"


def test_contents_markup():
    want = [(0, None, 0, "Sowing", ["spring/sowing.html"]), (1, 0, 1, "Peas <early>", ["spring/peas.html#depth"]), (2, 1, 2, "Frost", []), (3, None, 0, "Harvest", ["autumn.html"])]
    assert sitemap.parse(CONTENTS) == want
    assert sitemap.parse(CONTENTS.replace('"', "'").replace("object", "OBJECT").replace("ul>", "UL >")) == want


def test_several_targets_and_names():
    tool = '<object type="text/sitemap"><param name="Name" value=""><param name="Name" value="rake"><param name="Name" value="hoe">' + "".join(f'<param name="Local" value="tools/{k}.html">' for k in range(3)) + "</object>"
    got = sitemap.parse("<ul>" + tool + "<ul>" + obj("handle") + "</ul>" + obj(None, "x.html") + "</ul>")
    assert got == [(0, None, 0, "rake", ["tools/0.html", "tools/1.html", "tools/2.html"]), (1, 0, 1, "handle", []), (2, None, 0, "", ["x.html"])]


@pytest.mark.parametrize("tag,value", [(' NAME="a" value=\'b"c\'', 'b"c'), (" value=bare", None), (' data-value="x"', "x"), (' data-value="x" value="y"', "x"), (" title='value=\"in\"' value='out'", "in"), (' Value = "one" value="two"', "one"), (' value=""', "")])
def test_attributes(tag, value):
    assert sitemap.attribute("value", tag) == value


def test_attribute_columns(spark):
    tags = [' NAME="a" value=\'b"c\'', " value=bare", ' data-VALUE = "x" value="y"', ' value=""', None, "", " value='a' value=\"b\""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tag string").orderBy("i").select(sitemap.tag_attribute(F.col("tag"), "value")).collect()
    assert [r[0] for r in got] == [sitemap.attribute("value", t) if t is not None else None for t in tags]


def test_loose_markup():
    assert sitemap.parse("</ul></ul><ul>" + obj("a")) == [(0, None, 0, "a", [])]
    assert [x[2] for x in sitemap.parse("<ul><ul>" + obj("a") + "</ul>" + obj("b"))] == [0, 0]
    assert sitemap.parse('<object type="text/sitemap"><param name="Name" value="lost">') == []
    assert sitemap.parse('<object type="text/sitemap"><param name="Name" value=""><param name="Name" value="real"></object>')[0][3] == "real"
    assert sitemap.parse('<object type="text/sitemap"><param name="Name" value=bare><param name="Name" value="A > B"></object>')[0][3] == ""
    assert sitemap.parse('<object type="other"><param name="Name" value="x"></object>') == []


trees = st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.text("abc&<\"", max_size=4), kids), max_size=4), max_leaves=20)


def markup_of(tree):
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    return "<ul>" + "".join(obj(esc(n)) + (markup_of(kids) if kids else "") for n, kids in tree) + "</ul>"


def rows_of(tree, parent=None, depth=0, out=None):
    out = [] if out is None else out
    for name, kids in tree:
        at = len(out)
        out.append((at, parent, depth, name, []))
        rows_of(kids, at, depth + 1, out)
    return out


@settings(max_examples=80, deadline=None)
@given(trees)
def test_markup_round_trip(tree):
    assert sitemap.parse(markup_of(tree)) == rows_of(tree)


def test_navigation_tables(spark):
    texts = [("g", "hhc", CONTENTS), ("g", "hhk", "<ul>" + obj() + "<ul>" + obj("k", "x.htm", "y.htm") + "</ul></ul>"), ("e", "hhc", None)]
    nodes = sitemap.nodes(spark.createDataFrame(texts, schemas.SITEMAPS)).cache()
    toc = navigation.toc(nodes)
    assert [r.node_id for r in toc.orderBy("ordinal").collect()] == ["toc-0", "toc-1", "toc-2", "toc-3"]
    assert [r.has_children for r in navigation.with_children_flag(toc).orderBy("ordinal").collect()] == [True, True, False, False]
    entry = navigation.keyword_index(nodes).collect()
    assert [(r.entry_id, r.depth, r.local_paths) for r in entry] == [("idx-0", 1, ["x.htm", "y.htm"])]
    assert navigation.target_badge(navigation.keyword_index(nodes)).first()["badge"] == 2
    assert navigation.landing_pages(toc).first()["url"] == "chm://g/spring/sowing.html"
    listing = spark.createDataFrame([("g", 0, "/SPRING/sowing.html", 1), ("g", 1, "/autumn.html", 1), ("g", 2, "/spring/SOWING.html", 9)], "book_id string, ordinal long, path string, size long")
    assert [r.node_id for r in links.dangling_toc(toc, listing).collect()] == ["toc-1"]
    assert {r.link for r in links.dangling_index(navigation.keyword_index(nodes), listing).collect()} == {"x.htm", "y.htm"}
    found = links.lookup(spark.createDataFrame([("g", "/Spring/Sowing.html")], "book_id string, path string"), listing).first()
    assert (found.entry_path, found.size) == ("/SPRING/sowing.html", 1)
    shown = navigation.book_documents(spark.createDataFrame([("g", "/shelf/The Garden.chm"), ("none", "n.CHM")], "book_id string, file_path string"), toc, navigation.keyword_index(nodes)).orderBy("book_id").collect()
    assert [(r.title, len(r.toc), len(r["index"])) for r in shown] == [("The Garden", 4, 1), ("n", 0, 0)]


def test_landing_page_without_link(spark):
    nodes = sitemap.nodes(spark.createDataFrame([("b", "hhc", "<ul>" + obj("no link") + obj("x", "x.htm"))], schemas.SITEMAPS))
    assert navigation.landing_pages(navigation.toc(nodes)).first()["url"] is None


def pages(spark, rows):
    return spark.createDataFrame(rows, schemas.PAGES_TEXT)


def test_search(spark):
    p = pages(spark, [("b", f"/{i}.htm", "Collections" if i == 3 else f"p{i}", "the class of collections " * (i + 1)) for i in range(40)] + [("b", "/e.htm", "the", "")])
    rows = search.postings(p).cache()
    q = spark.createDataFrame([(1, None, "class"), (2, None, "collect"), (3, None, "a"), (4, None, "   "), (5, None, "zzqx"), (6, None, "the coll"), (7, "other", "the"), (8, "b", "p1 class")], schemas.QUERIES)
    hits = {k: [r for r in search.search(p, rows, q, limit=5).collect() if r.query_id == k] for k in range(1, 9)}
    assert len(hits[1]) == 5 and all(r.excerpt and r.title for r in hits[1])
    scores = [r.score for r in sorted(hits[1], key=lambda r: r.rank)]
    assert scores == sorted(scores, reverse=True) and scores[0] == 1.0 and scores[-1] > 0
    assert min(hits[2], key=lambda r: r.rank).path == "/3.htm"  # a title comes before texts
    assert not hits[3] and not hits[4] and not hits[5] and not hits[7] and not hits[8]
    assert len(hits[6]) == 5
    terms, tokens = search.dictionary(rows), search.query_tokens(q)
    assert set(search.prefix_matches(terms, tokens).collect()) == set(search.edge_matches(terms, tokens).collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    tokens = [w for w in words[::17]]
    got = {(r.token, r.term) for r in search.fuzzy_matches(terms, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {(t, w) for t in tokens for w in words if distance(t, w) <= int(len(t) * 0.2 + 0.5)}


def test_fuzzy_search_ranks_exact_first(spark):
    p = pages(spark, [("b", "/1", "t", "account"), ("b", "/2", "t", "acount"), ("b", "/3", "t", "accounting"), ("b", "/4", "t", "teller")])
    q = spark.createDataFrame([(1, None, "account")], schemas.QUERIES)
    got = search.fuzzy_search(search.postings(p), q).orderBy("rank").collect()
    assert got[0].path == "/1" and {r.path for r in got} == {"/1", "/2", "/3"}


def test_incremental_index_is_idempotent(spark):
    old = pages(spark, [("b", "/1", "t", "one two"), ("b", "/2", "t", "three")])
    new = pages(spark, [("b", "/2", "t", "four"), ("b", "/3", "t", "five"), ("b", "/1", "t", "one two")])
    seen = old.select("book_id", "path", F.sha2("text", 256).alias("sha256"))
    got = search.add_pages(search.postings(old), new, seen)
    want = search.postings(pages(spark, [("b", "/1", "t", "one two"), ("b", "/2", "t", "four"), ("b", "/3", "t", "five")]))
    assert sorted(got.collect()) == sorted(want.collect())
    every = want.select("book_id", "path").distinct().join(new.unionByName(old), ["book_id", "path"]).select("book_id", "path", F.sha2("text", 256).alias("sha256"))
    assert sorted(search.add_pages(want, new, every).collect()) == sorted(want.collect())


def test_reconciliation(spark):
    man = "book string, path string, size long, sha256 string"
    a = spark.createDataFrame([("x", "/1", 1, "s"), ("x", "/2", 2, "s"), ("x", "/3", 3, "s"), ("y", "/1", 4, "s")], man)
    b = spark.createDataFrame([("x", "/1", 1, "s"), ("x", "/2", 2, "other"), ("x", "/4", 9, "b")], man)
    assert [(r.path, r.sha_b) for r in reconcile.disagreements(a, b).collect()] == [("/2", "other")]
    m = reconcile.merged(a, b, "p", "q")
    assert {(r.book, r.path): r.tools for r in m.collect()} == {("x", "/1"): ["p", "q"], ("x", "/2"): ["p", "q"], ("x", "/3"): ["p"], ("x", "/4"): ["q"], ("y", "/1"): ["p"]}
    c = spark.createDataFrame([("x", "/1", 1, "s"), ("x", "/2", 7, "s"), ("x", "/3", 3, "t")], man)
    assert {(r.book, r.path): r.status for r in reconcile.verified(a, c).collect()} == {("x", "/1"): "ok", ("x", "/2"): "size", ("x", "/3"): "hash", ("y", "/1"): "unreadable"}
    assert {(r.book, r.is_total): (r.files, r.confirmed) for r in reconcile.confirmed_counts(m).collect()} == {("x", 0): (4, 2), ("y", 0): (1, 0), (None, 1): (5, 2)}
    assert {r.book: r.trusted for r in reconcile.trusted(a, b).collect()} == {"x": False, "y": True}
    back = books.manifest_rows(books.manifest_json(m))
    assert sorted(map(str, back.collect())) == sorted(map(str, m.collect()))


def test_requests(spark):
    t = dt.datetime(2024, 1, 1)
    urls = ["chm://b/a.htm", "chm://B/A.HTM?q#f", "chm://x/a.htm", "chm://b/none.htm", "chm://b/..%2Fa.htm", "chm://b/%zz", "chm://b/c+d.css", "junk", None]
    r = spark.createDataFrame([(i, t, u) for i, u in enumerate(urls)], schemas.REQUESTS)
    e = spark.createDataFrame([("b", 0, "/a.htm", 1), ("b", 1, "/c+d.css", 1)], "book_id string, ordinal long, path string, size long")
    got = {x.request_id: (x.status, x.content_type) for x in requests.resolved(r, e.select("book_id"), e).collect()}
    html = "text/html; charset=windows-1252"
    assert got == {0: (200, html), 1: (200, html), 2: (404, None), 3: (404, None), 4: (403, None), 5: (400, None), 6: (200, "text/css"), 7: (400, None), 8: (400, None)}


CASES = [
    ("na", ("a", False, False)), ("na nb", ("b", True, False)), ("na nb back", ("a", False, True)), ("na nb back forward", ("b", True, False)),
    ("na nb nb back", ("a", False, True)), ("na nb nc back nd", ("d", True, False)), ("na nb nc back nd back", ("b", True, True)), ("na back forward", ("a", False, False)),
]


def test_history(spark):
    t, rows = dt.datetime(2024, 1, 1), []
    for k, (events, _) in enumerate(CASES):
        for i, e in enumerate(events.split()):
            rows.append((str(k), t, i, "navigate" if e[0] == "n" else e, e[1:] if e[0] == "n" else None))
    got = {}
    for r in clickstream.replayed(spark.createDataFrame(rows, schemas.NAV_EVENTS)).orderBy("session_id", "seq").collect():
        got[r.session_id] = (r.current_url, r.can_back, r.can_forward)
    assert got == {str(k): want for k, (_, want) in enumerate(CASES)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "back", "forward", "open"]), max_size=30))
def test_history_against_a_list(actions):
    history, log, at = clickstream.History(), [], -1
    for x in actions:
        if x == "open":
            log, at = ["home"], 0
        elif x == "back":
            at = max(0, at - 1) if log else at
        elif x == "forward":
            at = min(len(log) - 1, at + 1)
        elif not log or log[at] != x:
            log, at = [*log[: at + 1], x], at + 1
        got = history.apply(x if x in ("back", "forward", "open") else "navigate", "home" if x == "open" else x)
        assert got == (log[at] if log else None, at > 0, at < len(log) - 1)


def test_debounce_and_recent(spark):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    keys = spark.createDataFrame([("s", ms(0), "te"), ("s", ms(100), "tel"), ("s", ms(351), "tell"), ("s", ms(601), " x "), ("s", ms(2000), " ok")], schemas.KEYSTROKES)
    assert [r.query for r in clickstream.fired_queries(keys).orderBy("ts").collect()] == ["tel", " ok"]
    rows = [("u", t, i, f"/f{i % 12}") for i in range(24)] + [("u", t, 99, "/f1")]
    got = [r.file_path for r in clickstream.recent_files(spark.createDataFrame(rows, schemas.OPENS)).orderBy("rank").collect()]
    assert got == ["/f1", *[f"/f{i}" for i in range(11, 2, -1)]]


def test_trees(spark, tmp_path):
    for name, data in (("b1/x.htm", b"1"), ("b1/sub/y.htm", b"22"), ("b2/z.css", b"333")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = books.hashed(books.read_trees(spark, str(tmp_path))).collect()
    assert {(r.book, r.path, r.size) for r in got} == {("b1", "/x.htm", 1), ("b1", "/sub/y.htm", 2), ("b2", "/z.css", 3)}


def test_needles_by_their_rarest_piece(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["the rarest theorem", None]
    needles = sorted({t[i : i + n] for t in texts[::9] if t for i in (0, 2) for n in (1, 2, 3, 5, 9) if t[i : i + n]} | {"the", "the r", "zzzz", "theor"})
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, name string, gram string").drop("gram")
    got = navigation.substring_matches(rows, "name", spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted((r.i, r.needle) for r in got.collect()) == sorted((i, n) for i, t in enumerate(texts) for n in needles if t and n in t)


@pytest.mark.parametrize("path,want", [("/a/b/../c", "/a/c"), ("/../x", "/x"), ("/a/%2e%2E/b", "/b"), ("/a/.", "/a/"), ("/a/..", "/"), ("/", "/"), ("/a//../b", "/a/b"), ("/..%2Fx", "/..%2Fx"), ("/a/.../b", "/a/.../b"), ("", ""), (None, None)])
def test_dot_segments(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.folded(F.col("p"))).first()[0] == want


def test_trees_of_files(spark, tmp_path):
    rows = [("b1", 0, "/a/x.htm", 5, bytearray(b"h\ni\r\n")), ("b1", 1, "/a=b%20/ü?.htm", 2, bytearray("é".encode())), ("b2", 0, "/a/x.htm", 1, bytearray(b"\n")), ("b2", 1, "/empty.htm", 0, bytearray(b""))]
    books.write_tree(spark.createDataFrame(rows, schemas.ENTRIES), str(tmp_path / "t"))
    got = {(r.book_id, r.path, r.size, bytes(r.content)) for r in books.read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {(b, p, n, bytes(c)) for b, _, p, n, c in rows if n}


def test_packs_hold_all_files_in_few(spark, tmp_path):
    rows = [("b", i, f"/d/{i}.htm", 1, bytes([i % 256, 10, 13, 0, 255])) for i in range(300)]
    rows += [("b", 300, "/a\n\tb \"%=é.htm", 0, b""), ("c=1/2", 301, "/x.htm", 1, b"\n"), ("", 302, "/y.htm", 1, b"z"), ("b", 303, "/long.htm", 1, b"x" * 21_000_000)]
    books.write_packs(spark.createDataFrame(rows, schemas.ENTRIES).coalesce(2), str(tmp_path / "p"))
    got = sorted((r.book_id, r.path, r.size, bytes(r.content)) for r in books.read_packs(spark, str(tmp_path / "p")).collect())
    assert got == sorted((b, p, len(c), c) for b, _, p, _, c in rows)
    assert len(list((tmp_path / "p").rglob("part-*"))) <= 6


@pytest.mark.parametrize("name", ["s1_read_entries", "s2_hashed_tree"])
def test_trees_of_queries_are_few_files(spark, tmp_path, name):
    url = F.concat(F.lit("http://h"), (F.col("page_id") % 2).cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    spark.range(200).toDF("page_id").select("page_id", url.alias("url"), F.when(F.col("page_id") % 9 > 0, url).alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    files = [f for f in df.inputFiles() if "/tree-" in f]
    assert 0 < len(files) <= 8 and df.count() == 200 and df.filter("size = 0").count() == 23
