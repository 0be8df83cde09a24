import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from helpbooks.llm import toxicity
from helpbooks.llm.entry import QUERIES

from .conftest import shingles_of, words_of
from .test_corpus_operators import brute_classes, brute_targets, near

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf)
        assert kept.columns == names and kept.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0


def planted(spark, folder):
    """Tables with toxic documents, exact and near copies and benchmark passages; the ids of the toxic ones, and the rows."""
    rng = random.Random(5)
    vocabulary, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(400)], ["vileone", "viletwo", "grimthing", "foulword"]
    items = [(k, " ".join(rng.choices(vocabulary, k=5 + 3 * k))) for k in range(12)]
    rows, labels, toxic = [], [], set()
    for i in range(600):
        w = rng.choices(vocabulary, k=rng.randint(8, 120))
        if i % 5 == 0:
            toxic.add(i)
            for x in rng.choices(bad, k=5):
                w.insert(rng.randint(0, len(w)), x)
        elif i % 17 == 1:
            w[4:4] = items[i % 12][1].split()
        rows.append((i, " ".join(w), None if i % 50 == 7 else f"src{i % 6}"))
        if i % 2 == 0:
            labels.append((i, 1, int(i in toxic)))
    clean = [r for r in rows if r[0] not in toxic]
    long = [r for r in clean if len(r[1].split()) > 70]
    rows += [(1000 + k, clean[k % 9][1], f"src{k % 4}") for k in range(90)]
    rows += [(2000 + k, near(long[k % 7][1], k), "src1") for k in range(60)]
    rows += [(3000, None, "src2"), (3001, "", "src2"), (3002, " \n", None), (3003, "word " * 3000, "src3"), (None, "some text without an id here", "src4")]
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, items


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    _, toxic, items = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    grader = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    before, kept = None, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, docs.collect()

    def ids(rows):
        return Counter(r.doc_id for r in rows)

    def rejected(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        held = {f for w in words for f in (w, f"{w[:4]}*" if len(w) > 4 else w, f"{w[:5]}*" if len(w) > 5 else w)} & grader.index.keys()
        z = sum(grader.model.weights[grader.index[f]] for f in held)
        return 1 / (1 + math.exp(grader.model.thresholds[0] - z)) >= grader.reject_from

    rows, out = kept["toxicity"]
    assert ids(out) == Counter(i for i, t, _ in rows if not rejected(t))
    gone = {i for i, _, _ in rows} - ids(out).keys()
    assert len(gone - toxic) <= 3 and len(toxic - gone) <= 3

    rows, out = kept["ngram_jaccard_join"]
    assert ids(out) == Counter({v[0] for v in brute_classes(rows).values()})
    assert len(out) <= len(rows) - 130

    rows, out = kept["benchmark_decontamination"]
    own = [(shingles_of(x), x) for _, x in items]
    leaks = lambda t: any(len(s & shingles_of(t)) >= 0.8 * len(s) for s, _ in own)
    assert ids(out) == Counter(i for i, t, _ in rows if not leaks(t)) and 20 < len(rows) - len(out) < 60

    rows, out = kept["mixing"]
    sizes, taken, copies = Counter(), Counter(), ids(out)
    for i, t, s in rows:
        sizes[s] += len(words_of(t))
        taken[s] += copies[i] * len(words_of(t))
    assert set(copies) <= {i for i, _, _ in rows} and max(copies.values()) <= 3
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    longest = {s: max(len(words_of(t)) for _, t, q in rows if q == s) for s in sizes}
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= 0.02 * want + 8 + (longest[s] if longest[s] > 0.2 * sizes[s] else 0)

    rows, out = kept["sharding"]
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in rows)
    slots, load = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(load) <= set(range(16))
    mean = sum(load.values()) / 16
    assert max(load.values()) <= mean + max(r.size for r in out)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in whole) == Counter((r.doc_id, r.size, r.text_crc32) for r in out)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
