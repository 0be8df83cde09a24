"""N-gram Jaccard self-join: MinHash candidates, Bayesian pruning, exact verification.

Texts that are equal are one class; joins run between different texts. Each text
has the set of its shingles of five words (the whole text if it has fewer).

1. A text has ``VALUES`` MinHash values, laid out as a table of 32 rows and 8
   columns. Its 64 bands are eight values each: the rows, and the columns cut in
   four. Texts that share a band are in one bucket; a pair of similarity 0.8
   misses all bands with probability 4e-5, one of 0.3 is in a bucket with 4e-3.
   A bucket links each member to its least one; those stars make candidate
   components, so no pairs are listed.
2. Each component is cut into blocks of about ``BLOCK`` texts or ``BLOCK_BYTES``
   bytes; each pair of blocks is a group of its own, so no group is unbounded.
   Inside, MinHash values are compared 16 at a time; a pair is dropped as soon as
   the posterior probability (uniform prior) of a similarity of at least the
   threshold falls below ``TOLERANCE``. All other pairs are verified on their
   exact shingles. The number of links of a text asks for every pair of a
   component, so this step is quadratic in a component of texts that are truly
   alike; exact copies are one text and cost nothing.
3. A group reports, for each text, its number of links and the least text it is
   connected to there; sums and components of these are exact for the table.

Texts are told apart by 64-bit hashes; should two different texts have the same
one, a second hash takes its place for those, so 128 bits must agree before a
document counts as a copy.

A text without words has no shingles and no links but to its own copies. Null
texts are empty. Very long texts are taken whole, one at a time. Null and
repeated ids are rows like any other; the class id is the least id of the class,
null if it has none. Of a class the document of the least id stays; of several
such rows the one of the least hash over all columns, of equal rows any one.
Other columns may have any name; only ``one_of_each`` reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textarrays as ta
from .components import components

THRESHOLD = 0.8
VALUES, BANDS = 256, 64
#: Values that are compared before exact verification.
PERMS = 128
STEP = 16
TOLERANCE = 1e-9
BLOCK, BLOCK_BYTES = 512, 16_000_000
#: Candidate texts up to this number are announced to the readers of all texts; beyond it texts are dealt by key.
ANNOUNCED = 500_000
_SEEDS = ta.seeds(VALUES, 4)
_BAND_SALT = ta.seeds(BANDS, 44)


def _hash(text: Column, salt: int | None = None) -> Column:
    return F.xxhash64(text) if salt is None else F.xxhash64(F.lit(salt), text)


def text_key(docs: DataFrame, text: str = "text") -> Column:
    """A long that different texts of ``docs`` do not share. About n**2 / 2**65 hashes of n texts clash (24 in 3e10); those alone reach the driver."""
    whole = F.coalesce(F.col(text), F.lit(""))
    first, second = _hash(whole), _hash(whole, 4)
    both = docs.select(first.alias("key"), second.alias("other")).groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    clashing = [r["key"] for r in both.filter("a != b").select("key").collect()]
    return F.when(first.isin(clashing), second).otherwise(first) if clashing else first


def signatures(h: np.ndarray, off: np.ndarray, seeds: np.ndarray = _SEEDS[:PERMS]) -> np.ndarray:
    """(texts with shingles, seeds) MinHash values; ``off`` must not hold empty texts."""
    out = np.empty((len(off) - 1, len(seeds)), np.uint32)
    for p, seed in enumerate(seeds):
        out[:, p] = np.minimum.reduceat(ta.permuted(h, seed), off[:-1])
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the least number of equal ones at which a pair is kept.

    With a uniform prior the posterior of the similarity is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    t, out = Fraction(str(threshold)), {}
    for n in range(STEP, PERMS + 1, STEP):
        total = Fraction(0)
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(texts, ``BANDS``) hashes of the bands' numbers and values."""
    table = sig.astype(np.uint64).reshape(len(sig), 32, 8)
    eights = np.concatenate([table, table.reshape(len(sig), 4, 8, 8).swapaxes(2, 3).reshape(len(sig), 32, 8)], axis=1)
    mixed = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(8):
        mixed = ta.mix(mixed * np.uint64(31) + eights[:, :, r] + _BAND_SALT[None, :])
    return mixed


def band_rows(docs: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """(key, band): the bands of each text, in each batch every different text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, first = np.unique(b.column(0).to_numpy(), return_index=True)
            b = b.take(pa.array(np.sort(first)))
            keys = b.column(0).to_numpy()
            for lo, hi, data, offsets in ta.slices(b.column(1)):
                h, off = ta.text_shingles(data, offsets)
                some = np.flatnonzero(np.diff(off))
                if not len(some):
                    continue
                mixed = bands_of(signatures(h, np.append(off[some], off[-1]), _SEEDS))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[lo:hi][some], BANDS)), pa.array(mixed.reshape(-1).view(np.int64))], names=["key", "band"])

    common.small_batches(docs.sparkSession)
    return docs.select(key.alias("key"), common.text_bytes(text).alias("text")).mapInArrow(run, "key long, band long")


def candidate_components(bands: DataFrame) -> DataFrame:
    """(v, component) of texts that share a bucket with another text."""
    rows, path = common.written(bands, "bands")
    leaders = rows.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).filter("least != most").drop("most")
    stars = common.looked_up(rows, leaders, "band", rows.count()).filter("key != least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    out = components(stars)
    common.remove(bands.sparkSession, path)
    return out


def picked_texts(docs: DataFrame, key: Column, found: DataFrame, text: str = "text") -> DataFrame:
    """(key, component, text): each text of ``found`` (v, component) once, in bytes."""
    texts = docs.select(key.alias("key"), common.text_bytes(text).alias("text"))
    own = found.select(F.col("v").alias("key"), "component")
    if found.count() <= ANNOUNCED:
        texts = texts.join(F.broadcast(own.select("key")), "key", "left_semi")
    once = texts.groupBy("key").agg(F.first("text").alias("text"))  # copies are merged before the shuffle
    return once.join(own, "key").select("key", "component", "text")


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets, by products of 0/1 matrices or one by one, whichever is less work."""
    used = np.unique(pairs)
    sizes = np.array([len(sets[i]) for i in used])
    rows = np.repeat(np.arange(len(used)), sizes)
    _, col, n = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = n[col] > 1  # what one text alone holds is in no intersection
    rows, col = rows[shared], np.unique(col[shared], return_inverse=True)[1]
    width = int(col.max(initial=-1)) + 1
    if len(pairs) * 4e-5 < len(used) ** 2 * width * 2e-10:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], dtype=np.int64)
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((len(used), 4096), np.float32)
        x[rows[a:b], col[a:b] - lo] = 1
        total += x @ x.T
    at = np.searchsorted(used, pairs)
    return total[at[:, 0], at[:, 1]].astype(np.int64)


def linked_pairs(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs (rows of ``sig``) of similarity >= threshold between two blocks, or within one if ``right`` is None."""
    other = left if right is None else right
    keep = np.ones((len(left), len(other)), bool) if right is not None else np.triu(np.ones((len(left), len(left)), bool), 1)
    need = least_matches(threshold)
    equal = np.zeros(keep.shape, np.int16)
    for p in range(STEP):
        equal += sig[left, p][:, None] == sig[other, p][None, :]
    a, b = np.nonzero(keep & (equal >= need[STEP]))
    m = equal[a, b].astype(np.int64)
    a, b = left[a], other[b]
    for n in range(STEP, PERMS, STEP):
        if not len(a):
            break
        m += (sig[a, n : n + STEP] == sig[b, n : n + STEP]).sum(1)
        go_on = m >= need[n + STEP]
        a, b, m = a[go_on], b[go_on], m[go_on]
    pairs = np.stack([a, b], axis=1)
    if not len(pairs):
        return pairs
    t, size = Fraction(str(threshold)), np.array([len(s) for s in sets], dtype=np.int64)
    same = _overlaps(sets, pairs)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - same
    return pairs[same * t.denominator >= union * t.numerator]


def _least_connected(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each row the least row it is connected to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, pairs[:, 0], low[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], low[pairs[:, 0]])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def block_links(keys: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], same_block: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, links, least key connected) of the texts of a group that have links."""
    order = np.argsort(keys, kind="stable")
    order = order[np.append(True, np.diff(keys[order]) != 0)] if len(order) else order  # repeated rows
    keys, sides, sets = keys[order], sides[order], [sets[i] for i in order]
    if len(keys) < 2:
        return keys[:0], keys[:0], keys[:0]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = signatures(np.concatenate(sets), off)
    left = np.flatnonzero(sides == 0)
    pairs = linked_pairs(sig, sets, left, None if same_block else np.flatnonzero(sides == 1), threshold)
    links = np.bincount(pairs.reshape(-1), minlength=len(keys))
    low = _least_connected(len(keys), pairs)
    some = links > 0
    return keys[some], links[some], keys[low[some]]


def links(docs: DataFrame, key: Column, threshold: float = THRESHOLD, text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((key, n_links), (v, component)) of all texts that have links to different texts."""
    found = common.cut(candidate_components(band_rows(docs, key, text)))
    sets, path = common.written(_shingle_sets(picked_texts(docs, key, found, text)), "shingles")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") * 8 / block_bytes), F.lit(1)).cast("int")
    blocks = sets.groupBy("component").agg(parts.alias("blocks"), F.count("*").alias("n"))
    placed = common.looked_up(sets, blocks, "component", found.count()).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "shingles")
    dealt = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = common.cut(_grouped(dealt, threshold))
    common.remove(docs.sparkSession, path)
    n_links = counted.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    return n_links, components(counted.select(F.col("key").alias("u"), F.col("least").alias("v")))


def _shingle_sets(picked: DataFrame) -> DataFrame:
    """text becomes ``shingles``: sorted 64-bit hashes, as bytes, ``size`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in ta.slices(b.column(2)):
                h, off = ta.text_shingles(data, offsets)
                sets = [np.unique(h[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "component", "size", "shingles"])

    return picked.mapInArrow(run, "key long, component long, size long, shingles binary")


def _grouped(dealt: DataFrame, threshold: float) -> DataFrame:
    """Work through groups of rows that stand together; a group has at most two blocks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column(5).to_pylist()]
                keys, n, low = block_links(rows.column(4).to_numpy(), rows.column(3).to_numpy(), sets, group[1] == group[2], threshold)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), pa.array(low)], names=["key", "n_links", "least"])
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            names = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                now = tuple(names[x].tolist())
                if now != group:
                    yield from done()
                    group = now
                held.append(b.slice(x, y - x))
        yield from done()

    return dealt.mapInArrow(run, "key long, n_links long, least long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, class_id, text_class, n_links, n_copies.

    ``class_id`` is the least id of all documents connected by links or by equal
    texts, ``text_class`` the least id of those with an equal text, ``n_links``
    the number of different texts of similarity at least ``threshold``, and
    ``n_copies`` the number of documents with that text.
    """
    key = text_key(docs, text)
    n_links, comps = links(docs, key, threshold, text)
    ids = common.cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key")))
    texts = ids.groupBy("key").agg(F.min("doc_id").alias("text_class"), F.count("*").alias("n_copies"))
    joined = texts.join(comps.withColumnRenamed("v", "key"), "key", "left").join(n_links, "key", "left")
    joined = common.cut(joined.select("key", "text_class", "n_copies", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = joined.groupBy("component").agg(F.min("text_class").alias("class_id"), F.count("*").alias("n"))
    size = joined.agg(F.count("*"), F.sum("n_copies")).first()
    about = common.looked_up(joined, least, "component", size[0]).select("key", "class_id", "text_class", "n_links", "n_copies")
    return common.looked_up(ids, about, "key", size[1] or 0, "n_copies").select("doc_id", "class_id", "text_class", "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one of the least id (a null id comes last)."""
    key = text_key(docs)
    _, comps = links(docs, key, threshold)
    has_id, id_ = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(key.alias("key"), has_id.alias("has_id"), id_.alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(*(docs[c] for c in plain)).alias("tie"))
    first = F.min(F.struct((~F.col("has_id")).alias("last"), "id")).alias("first")
    texts = rows.groupBy("key").agg(first).join(comps.withColumnRenamed("v", "key"), "key", "left")
    kept = texts.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min(F.struct("first", "key")).alias("w"))
    kept = kept.select("w.key", (~F.col("w.first.last")).alias("has_id"), F.col("w.first.id").alias("id"))
    once = rows.groupBy("key", "has_id", "id").agg(F.min_by("row", "tie").alias("row"))  # repeated rows are merged before the shuffle
    return once.join(kept, ["key", "has_id", "id"], "left_semi").select("row.*")
