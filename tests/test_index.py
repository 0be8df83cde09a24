"""The stored index: what it finds, what it reads, and how it changes."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpbooks import schemas
from helpbooks.operators import index, search, segments


def pages(spark, rows):
    return spark.createDataFrame(rows, schemas.PAGES_TEXT)


def asked(spark, rows):
    return spark.createDataFrame(rows, schemas.QUERIES)


def scans(df):
    """(files, rows) that the file scans of a query have read, after it has run."""
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name == "FileSourceScanExec":
            m = plan.metrics()
            found.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé9") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(f"b{i % 5}", f"/{i}.htm", " ".join(rng.choices(words, k=3)) if i % 3 else "", " ".join(["the", *rng.choices(words, k=60), "there" if i % 2 else "then"])) for i in range(1500)]
    rows += [("b1", "/rare.htm", "Zyzzyva", "zyzzyva beetles the"), ("b1", "/no.htm", "no text", ""), ("b1", "/marks.htm", "!", "?!"), ("b2", "/long.htm", "x", "q" * 20_000 + " the")]
    folder = str(tmp_path_factory.mktemp("stored"))
    index.write(pages(spark, rows), folder)
    return index.open_index(spark, folder), pages(spark, rows), words


def hits(df):
    return sorted(map(tuple, df.collect()))


def test_it_is_the_same_as_without_files(spark, stored):
    held, p, words = stored
    q = asked(spark, [(1, None, "the"), (2, None, "the th"), (3, "b1", "the"), (4, "b1", f"{words[5][:3]} the"), (5, None, words[9]), (6, None, "nothingatall"), (7, None, "a"), (8, None, "t"), (9, None, "é"), (10, None, words[3][:2])])
    rows = search.postings(p).cache()
    columns = [x.split()[0] for x in schemas.POSTINGS.split(", ")]
    assert hits(held.postings.select(columns)) == hits(rows.select(columns))
    assert hits(index.field_hits(held, q)) == hits(search.field_hits(rows, q))
    for limit in (3, 30):  # limits before the shuffle change nothing
        assert hits(index.ranked(held, q, limit)) == hits(search.ranked(search.field_hits(rows, q), limit))
    assert hits(index.find(held, q, 5).select("query_id", "book_id", "path", "rank", "excerpt")) == hits(search.search(p, rows, q, 5).select("query_id", "book_id", "path", "rank", "excerpt"))
    assert hits(index.fuzzy_find(held, q)) == hits(search.fuzzy_search(rows, q))
    want = rows.groupBy("term").agg(F.count_distinct("book_id", "path").alias("df"), F.sum("tf").alias("tf"))
    assert hits(held.terms.select("term", "df", "tf")) == hits(want)
    n = rows.select("book_id", "path").distinct().count()
    assert [tuple(r) for r in held.about.select("pages", "words").collect()] == [(n, rows.agg(F.sum("tf")).first()[0])]


def test_many_queries_narrow_less_and_find_the_same(spark, stored, monkeypatch):
    held, p, words = stored
    q = asked(spark, [(i, None if i % 3 else "b2", w[: 2 + i % 3]) for i, w in enumerate(words[:260])])
    want = hits(search.ranked(search.field_hits(search.postings(p), q), 10))
    assert hits(index.ranked(held, q, 10)) == want
    for pushed, wanted in ((40, 100_000), (5, 10), (0, 0)):
        monkeypatch.setattr(index, "MOST_PUSHED", pushed)
        monkeypatch.setattr(index, "MOST_WANTED", wanted)
        assert hits(index.ranked(held, q, 10)) == want


def test_a_rare_term_reads_little(spark, stored):
    held, _, _ = stored
    every = held.postings.select("term", "first_pos")
    every.write.format("noop").mode("overwrite").save()
    all_rows = every.count()
    found = index.of_terms(held.postings, [{"lead": "z", "term": "zyzzyva"}]).select("term", "first_pos")
    assert found.count() == 2
    df = index.of_terms(held.postings, [{"lead": "z", "term": "zyzzyva"}]).select("term", "first_pos")
    df.collect()
    (files, rows), = scans(df)
    everything = held.postings.select("term", "first_pos")
    everything.collect()
    (all_files, _), = scans(everything)
    assert files < all_files / 5 and rows < all_rows / 10
    tokens = spark.createDataFrame([("zyzz",)], "token string")
    near = index.starting_with(held.terms, tokens).select("term")
    assert [r.term for r in near.collect()] == ["zyzzyva"]
    (files, rows), = scans(near)
    assert files < all_files / 5 and rows < held.terms.count() / 10


def test_a_common_word_does_not_shuffle_its_postings(spark, stored):
    held, _, _ = stored
    df = index.ranked(held, asked(spark, [(1, None, "the")]), 5)
    df.collect()
    written = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name == "ShuffleExchangeExec":
            written.append(plan.metrics().apply("shuffleRecordsWritten").value())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    matched = held.postings.filter("term like 'the%'").count()
    terms = held.postings.filter("term like 'the%'").select("field", "term").distinct().count()
    tasks = spark.sparkContext.defaultParallelism
    assert matched > 1500 and written and max(written) <= 5 * terms * tasks * 2 < matched


def test_terms_of_any_length_cost_nothing(spark):
    long = [("q" * n,) for n in (1500, 20_000)] + [("account",), ("acount",), ("accounts",), ("amount",), ("bookkeeping",), ("bookeepin",), ("incomprehensible",), ("incomprehensive",)]
    terms = spark.createDataFrame(long * 40, "term string").distinct()
    tokens = spark.createDataFrame([("account",), ("bookkeepin",), ("incomprehensibly",)], "token string")
    began = time.time()
    got = {tuple(r) for r in search.fuzzy_matches(terms, tokens).collect()}
    assert got == {("account", "account", 0), ("account", "acount", 1), ("account", "accounts", 1), ("bookkeepin", "bookkeeping", 1), ("bookkeepin", "bookeepin", 1), ("incomprehensibly", "incomprehensible", 1), ("incomprehensibly", "incomprehensive", 3)}
    assert time.time() - began < 30


def test_changes_give_what_a_new_index_gives(spark, tmp_path):
    folder, rng, truth = str(tmp_path), random.Random(5), {}
    segments.start(spark, folder)
    for batch in range(5):
        put = [(f"b{rng.randrange(3)}", f"/{rng.randrange(12)}", f"title {batch}", " ".join(rng.choices("ant bee cat dog eel".split(), k=4)), False) for _ in range(7)]
        gone = [(b, p, None, None, True) for b, p in rng.sample(sorted(truth), min(3, len(truth)))]
        gone += [("b2", None, None, None, True)] if batch == 3 else []
        odd = [("none", "/x", None, None, True), ("b0", "/empty", None, None, None), (None, "/y", "t", "u", False)]
        changes = spark.createDataFrame(put + gone + odd, segments.CHANGES)
        segments.change(changes, folder, batch)
        if batch % 2:
            segments.change(changes, folder, batch)  # a batch that is tried again
        kept = {}
        for r in changes.filter("not coalesce(gone, false) and book_id is not null").withColumn("h", F.coalesce(F.sha2("text", 256), F.lit(""))).collect():
            if (r.book_id, r.path) not in kept or kept[r.book_id, r.path][0] < r.h:
                kept[r.book_id, r.path] = (r.h, r.title, r.text)
        for b, p, *_ in gone:
            for key in [k for k in truth if k[0] == b and p in (None, k[1]) and k not in kept]:
                del truth[key]
        for key, (_, title, text) in kept.items():
            if key not in truth or truth[key][1] != text:
                truth[key] = (title, text)
        now = pages(spark, [(b, p, t, x) for (b, p), (t, x) in truth.items()])
        assert hits(segments.postings(spark, folder)) == hits(search.postings(now))
    held = segments.open_index(spark, folder)
    fresh = str(tmp_path / "fresh")
    index.write(now, fresh)
    want = index.open_index(spark, fresh)
    q = asked(spark, [(1, None, "ant"), (2, "b1", "be"), (3, None, "cat dog"), (4, None, "doq")])
    assert hits(held.terms.select("term", "df", "tf")) == hits(want.terms.select("term", "df", "tf"))
    assert hits(held.about.select("pages", "words")) == hits(want.about.select("pages", "words"))
    assert hits(index.find(held, q)) == hits(index.find(want, q))
    assert hits(index.fuzzy_find(held, q)) == hits(index.fuzzy_find(want, q))
    names = [s for s, _ in segments.live(spark, folder)]
    assert len(names) <= 2 and any(s.startswith("m") for s in names)  # five batches, merged by four
    assert set(segments.vacuum(spark, folder)).isdisjoint(names)
    assert hits(segments.postings(spark, folder)) == hits(search.postings(now))


def test_sketches_merge(spark, stored, tmp_path):
    held, p, _ = stored
    folder = str(tmp_path)
    segments.start(spark, folder)
    for k in range(2):
        segments.change(p.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == k), folder, k)
    (got,) = segments.statistics(spark, folder).collect()
    (want,) = index.statistics(held).collect()
    assert (got.text_chars, got.postings) == (want.text_chars, want.postings) and abs(got.terms - want.terms) < 0.04 * want.terms


def most_memory(spark, df):
    """MB of the greatest peak memory of a hash table or sort of a query, after it has run, and the records it shuffled."""
    found, shuffled = [0], [0]

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if plan.metrics().contains("peakMemory"):
            found.append(plan.metrics().apply("peakMemory").value() / 1e6)
        if name == "ShuffleExchangeExec":
            shuffled.append(plan.metrics().apply("shuffleRecordsWritten").value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found), sum(shuffled)


@pytest.mark.parametrize("make", [search.postings, search.stored_postings])
def test_words_are_counted_a_page_at_a_time(spark, make):
    rng = random.Random(5)
    rows = [("b", f"/{i}.htm", f"t{i} w1 T{i}" if i % 3 else "", " ".join(f"w{rng.randrange(400)}" for _ in range(i % 200))) for i in range(300)]
    rows += [("b", "/none.htm", "no text", ""), ("b", "/null.htm", None, "x y x"), ("b", "/nothing.htm", "x", None), ("b", "/marks.htm", "!", "?!")]
    df = make(pages(spark, rows))
    got = df.collect()
    assert most_memory(spark, df) == (0, 0)
    want = {}
    for book, path, title, text in rows:
        words = {"title": re.findall(r"[^\W_]+", (title or "").lower()), "text": re.findall(r"[^\W_]+", (text or "").lower())} if text else {}
        for field, w in words.items():
            for pos, term in enumerate(w):
                tf, first = want.get((book, path, field, term), (0, pos))
                want[book, path, field, term] = tf + 1, first
    assert {(r.book_id, r.path, r.field, r.term): (r.tf, r.first_pos) for r in got} == want and len(got) == len(want)
    if make is search.stored_postings:
        assert all(r.first_field == (r.field == "text" or (r.book_id, r.path, "text", r.term) not in want) for r in got)
        lengths = Counter()
        for (_, path, _, _), (tf, _) in want.items():
            lengths[path] += tf
        assert all(r.page_words == lengths[r.path] for r in got if r.path != "/null.htm")


def test_a_batch_without_news_moves_no_texts(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path / "i"), [("b", f"/{i}.htm", "t", f"word{i} and more") for i in range(50)]
    spark.createDataFrame(rows, schemas.PAGES_TEXT).write.parquet(str(tmp_path / "p"))
    now = spark.read.schema(schemas.PAGES_TEXT).parquet(str(tmp_path / "p"))
    segments.start(spark, folder)
    segments.change(now, folder, 0)
    written = []
    monkeypatch.setattr(index, "write", lambda fresh, *where, write=index.write: (written.append(fresh), write(fresh, *where)))
    segments.change(now, folder, 1)
    hashed = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert written[0].count() == 0 and "max_by" in hashed and hashed.index("max_by") < hashed.index("LeftSemi")  # the texts are compared where they are new
    assert segments.open_index(spark, folder).terms.count() == 53


def test_tasks_that_sort_postings_follow_the_texts(spark, tmp_path, monkeypatch):
    """More text is more tasks, not larger ones, however few shuffle partitions the session has."""
    rng = random.Random(11)
    rows = [(f"b{i % 7}", f"/{i}.htm", f"page {i}", " ".join(["the", *("".join(rng.choices("abcdefgh", k=4)) for _ in range(40))])) for i in range(400)]
    monkeypatch.setattr(index, "CHARS_A_PART", 4_000, raising=False)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        largest = {}
        for n in (100, 400):
            p, folder = pages(spark, rows[:n]), str(tmp_path / str(n))
            index.write(p, folder)
            held = spark.read.schema(schemas.INDEX_POSTINGS).parquet(f"{folder}/postings")
            task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)
            largest[n] = max(r["count"] for r in held.groupBy(task.alias("task")).count().collect())
            got = held.select("book_id", "path", "field", "term", "tf", "first_pos")
            assert hits(got) == hits(search.postings(p))
        assert largest[400] < 1.7 * largest[100], largest
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
