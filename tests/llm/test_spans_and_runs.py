"""Licence scan, fill-in-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpbooks.llm import entry, fill_in_middle, licences, periodic_runs, refinement
from helpbooks.llm.licence_texts import NOTICES, PHRASES, TEXTS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def given_docs(spark, make, sample):
    """The sample, long texts, a text of a few MB, planted licence texts, ties of ids, and clashing names."""
    mit, apache = TEXTS[0][1], dict(TEXTS)["apache-2.0"]
    cut = mit.split()
    more = [
        (9200, f"prose before. {mit} prose after", "a"),
        (9201, " ".join(cut[:60] + ["and", "some", "words", "put", "in"] + cut[60:]), "a"),
        (9202, " ".join(cut[: len(cut) // 3]), "a"),
        (9203, apache.upper() + "\n\n" + mit, None),
        (9204, "apache license\nGNU  general-public_license mit MIT license cc BY cc by by", "b"),
        (9205, "the gnu general public licenses and a commit license", "b"),
        (9206, "Ünï mit license é漢 apache license", "c"),
        (9207, ("Licensed under CC BY-NC 4.0.\n" + "filler text here " * 5) * 20, "c"),
        (9300, "line one\nline two\r\n\n\n漢字 é\nlast", "d"),
        (9301, "\n" * 500, "d"),
        (9302, "has <S> inside\nyes", "d"),
        (9303, "<P", "d"),
        (9304, "é\n" * 3000 + "tail", "d"),
        (9305, "ab ab ab ab ab ab ab ab ab", "e"),
        (9306, ("one two three four five six seven. " * 400 + "\n") * 30, "e"),
        (9307, "lorem ipsum dolor \n" * 160_000, "e"),
    ]
    return make([*sample, *more, (9305, "other text of the same id", "e")])


# --- licences


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_query(given_docs):
    rows = licences.digest(licences.find(given_docs)).collect()
    texts = given_docs.select("doc_id", "text").collect()
    key = lambda r: str(r)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(got, key=key) == sorted([(d.doc_id, *brute_phrases(d.text)) for d in texts], key=key)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9200].labels == "mit" and by_id[9200].score == 1 and by_id[9200].n_base == 0
    assert by_id[9201].labels == "mit" and 0.95 < by_id[9201].score <= 1  # one chain over the gap
    assert by_id[9202].labels == "" and by_id[9202].score == 0
    assert set(by_id[9203].labels.split(",")) >= {"apache", "apache-2.0", "mit"}
    assert by_id[9204].base_labels == "apache,cc-by,gpl,mit" and by_id[9205].n_base == 0  # whole words alone
    assert by_id[9207].n_base == 20 and by_id[9207].labels == "cc-by,cc-by-nc-4.0" and by_id[9207].n_spans >= 20
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_spans_say_where(spark):
    text = "x y z " + TEXTS[1][1] + " end"
    row = licences.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    span = next(s for s in row.spans if s.label == "isc")
    words = re.findall(r"[0-9a-z]+", text.lower())
    assert (span.start, span.end, span.covered) == (3, len(words) - 1, 1.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=5), st.text("abcd", max_size=60))
def test_matching_statistics(templates, text):
    a = licences.Automaton([[bytes([c]) for c in t.encode()] for t in templates])
    state = length = 0
    for i, c in enumerate(text):
        w = a.words.get(c.encode())
        state, length = (0, 0) if w is None else a.step(state, length, w)
        want = max(k for k in range(i + 2) if any(text[i + 1 - k : i + 1] in t for t in templates))
        assert length == want
        if length:
            s = text[i + 1 - length : i + 1]
            assert a.places(state) == sorted((n, j + length) for n, t in enumerate(templates) for j in range(len(t)) if t.startswith(s, j))


def test_phrases_within_phrases():
    s = licences.Scanner([], [("x", "a b"), ("y", "b"), ("z", "c a b")])
    n, places, spans = s.scan(b"c a b. a b b ca b")
    assert n == 8 and places == [(0, 2), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1), (7, 1)] and spans == []


def test_slices_cut_no_word():
    text = ("licensed under the apache license, " * 50 + "wörter " * 9).encode()
    for size in (1, 7, 100):
        assert b"".join(licences.slices(text, size)) == text
        assert [w for part in licences.slices(text, size) for w in licences.words_of(part)] == licences.words_of(text)


def test_templates_are_told_apart():
    s = licences.Scanner([*NOTICES, *TEXTS], [])
    for label, text in [*NOTICES, *TEXTS]:
        assert label in {s.templates[t][0] for t, *_ in s.scan(text.encode())[2]}


# --- fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle_query(given_docs):
    got = fill_in_middle.digest(fill_in_middle.transform(given_docs)).collect()
    want = [brute_fim(d.doc_id, d.text) for d in given_docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


UNIT = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"(?s)\A[ \t-\r]+|[^ \t-\r]+[ \t-\r]*"}


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\té漢😀", max_size=80), st.sampled_from(sorted(UNIT)), st.integers(1, 9), st.integers(1, 30))
def test_checkpoints(text, unit, every, block):
    units = re.findall(UNIT[unit], text)
    index = fill_in_middle.Checkpoints(text.encode(), unit, every, block)
    assert (index.n, index.chars) == (len(units), len(text)) and len(index.units) == -(-len(units) // every)
    for u in range(len(units) + 1):
        before = "".join(units[:u])
        assert index.cut(u) == (len(before.encode()), len(before))


def test_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(300)], "doc_id long, text string")
    n = {r.form: r["count"] for r in fill_in_middle.transform(docs, rate=50, spm=20).groupBy("form").count().collect()}
    assert 110 < n["plain"] < 190 and n["psm"] > 2 * n["spm"] > 10
    assert fill_in_middle.transform(docs, rate=0).filter("form != 'plain'").count() == 0
    again = fill_in_middle.transform(docs, unit="char", every=3)
    assert {r[0] for r in again.select(fill_in_middle.restored(again.output, again.form)).collect()} == {f"a{i}\nb\nc\n" for i in range(300)}


# --- periodic runs


def brute_runs(x, least):
    n, found = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and not any(s <= i and j + q <= s + m and q % p == 0 for s, m, p in found):
                found.append((i, j - i + q, q))
            i = j
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute_runs(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def test_periodic_run_query(spark, make, sample):
    short = [r for r in sample if len((r[1] or "").split()) < 900]
    ids = [i for i in range(20_000, 21_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = ["", " one ", "a b c d e f g h i j k l m n o p", "x " * 50, "ab ba " * 30 + "c", " ".join(random.Random(4).choices("abcdefghij", k=300)), "Ab ab Ab ab " * 5]
    docs = make([*short, *((i, texts[k % len(texts)], "s") for k, i in enumerate(ids)), *((i + 1, texts[k % len(texts)], "s") for k, i in enumerate(ids[:14]))])
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.planted(docs))).collect()
    want = [brute_row(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    assert len(got) > 150 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_texts_have_their_runs(given_docs):
    rows = {r.doc_id: r for r in periodic_runs.find(given_docs.filter("doc_id in (9301, 9306, 9307, 9005, 9006)")).collect()}
    assert [tuple(x) for x in rows[9307].runs] == [(0, 480_000, 3)] and rows[9307].collapsed == "lorem ipsum dolor"
    assert [tuple(x) for x in rows[9306].runs] == [(0, 84_000, 7)]
    assert rows[9005].runs[0].length == 40_000 and rows[9301].n_words == 0 and rows[9006].runs == []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("ab", max_size=24) | st.text("abc", max_size=40) | st.integers(1, 9).map(lambda p: ("abcdefghi"[:p] * 9)[:37]), max_size=4))
def test_refinement(texts):
    sequences = [np.array([ord(c) - 97 for c in t], dtype=np.int64) for t in texts]
    want = [brute_runs(t, 2) for t in texts]
    for few in (0, 5, 1000):  # whole arrays, both, single places
        assert refinement.runs(sequences, 2, few) == want


def test_names_and_empty_tables(spark, make):
    none = make([])
    for op in (licences.find, fill_in_middle.transform, periodic_runs.find):
        assert op(none).count() == 0
    other = spark.createDataFrame([(None, None, 1, 2, 3), (5, "a b", 1, 2, 3)], "id long, body string, text int, n int, form int")
    assert [r.n_words for r in licences.find(other, doc_id="id", text="body").collect()] == [0, 2]
    assert sorted(r.form for r in fill_in_middle.transform(other, doc_id="id", text="body").collect())[0] == "plain"
    assert sorted(r.n_words for r in periodic_runs.find(periodic_runs.planted(other, "id", "body")).collect()) == [0, 2]


def test_registered():
    assert {"op11_licence_scans", "op12_fill_in_middle", "op13_periodic_runs"} <= set(entry.QUERIES)
