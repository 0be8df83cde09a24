"""Benchmark decontamination: containment search by size-partitioned MinHash.

Items are partitioned by size: class u, 16 at least, holds items of u/2 < n <= u
shingles of five words. For each class a document is cut into windows of 2u shingles, u
apart, so that any u shingles in a row lie in one window and the Jaccard
similarity of an item and its window stays above a fifth, however long the
document is. A window whose MinHash agrees with an item's in any of ``PERMS``
orders makes (document, item) a candidate: at containment 0.8 one in a million
is missed. Candidates are verified on the exact shingles of the whole document.

Smaller items are not hashed to windows: any shingle that an item of at most
``EXACT`` shingles shares with a document makes a candidate. An item of fewer
than five words is one run of all its words and is sought among the document's
runs of that many words, wherever they lie.

Everything happens where a document is read. Items go out in blocks of about
``ITEM_BLOCK`` items or ``ITEM_BYTES`` bytes (one pass over the documents each),
so what is broadcast has a bound, but for a single longer item. Null and empty texts have no shingles and match nothing. Equal items each match; repeated rows each report. Items with a
null id report a null id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textarrays as ta

THRESHOLD = 0.8
PERMS = 64
LEAST_CLASS = 16
#: Items of so many shingles, or fewer, are looked up exactly: half of the least class.
EXACT = LEAST_CLASS // 2
#: Words of a shingle.
WIDTH = 5
ITEM_BLOCK, ITEM_BYTES = 20_000, 32_000_000
_SEEDS = ta.seeds(PERMS, 6)
_EMPTY = np.uint32(0xFFFFFFFF)


class Items:
    """A block of items: exact shingles; MinHash values by size class; the shingles of small items by their width in words."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.shingles, width = [], [], []
        column = pa.array(texts, pa.binary())
        for a, b, data, offsets in ta.slices(column):
            start, end, text = ta.words(data, offsets)
            hashes, count = ta.word_hashes(data, start, end), np.bincount(text, minlength=b - a)
            by_width = {w: ta.shingles(hashes, text, b - a, w) for w in {min(WIDTH, n) for n in count.tolist() if n}}
            for k in np.flatnonzero(count):
                h, off = by_width[min(WIDTH, count[k])]
                self.ids.append(ids[a + k])
                self.shingles.append(np.unique(h[off[k] : off[k + 1]]))
                width.append(min(WIDTH, int(count[k])))
        sizes = np.array([len(s) for s in self.shingles], dtype=np.int64)
        self.exact = {}
        for w in sorted(set(width)):
            own = [i for i in np.flatnonzero(sizes <= EXACT).tolist() if width[i] == w]
            if own:
                values, item = np.concatenate([self.shingles[i] for i in own]), np.repeat(own, sizes[own])
                order = np.argsort(values, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[values >> ta.U64(48)] = True
                self.exact[w] = (values[order], item[order], seen)
        level = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / LEAST_CLASS)).astype(int))
        level[sizes <= EXACT] = -1
        self.classes = {}
        for k in sorted(set(level.tolist()) - {-1}):
            own = np.flatnonzero(level == k)
            mins = np.array([[ta.permuted(self.shingles[i], s).min() for i in own] for s in _SEEDS])
            order = np.argsort(mins, axis=1, kind="stable")
            seen = np.zeros((PERMS, 1 << 16), dtype=bool)
            for p in range(PERMS):
                seen[p, mins[p] >> np.uint32(16)] = True
            self.classes[k] = (np.take_along_axis(mins, order, 1), own[order], seen)

    def candidates(self, h: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
        """(document number, item number) pairs that some MinHash value suggests."""
        size = np.diff(off)
        blocks = -(-size // LEAST_CLASS)
        block_off = np.concatenate([[0], np.cumsum(blocks)])
        if not block_off[-1] or not self.classes:
            return set()
        doc = np.repeat(np.arange(len(size)), size)
        place = block_off[:-1][doc] * LEAST_CLASS + np.arange(len(h)) - off[:-1][doc]
        levels = {}
        for k in self.classes:
            step = 1 << k
            many = -(-blocks // step)
            d = np.repeat(np.arange(len(size)), many)
            start = block_off[:-1][d] + step * (np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many))
            levels[k] = (start, d, np.append(d[1:] == d[:-1], False))
        found: set[tuple[int, int]] = set()
        padded = np.empty(block_off[-1] * LEAST_CLASS, np.uint32)
        for p, seed in enumerate(_SEEDS):
            padded.fill(_EMPTY)
            padded[place] = ta.permuted(h, seed)
            least = padded.reshape(-1, LEAST_CLASS).min(axis=1)
            for k, (start, d, same) in levels.items():
                m = np.minimum.reduceat(least, start)
                m[:-1] = np.where(same[:-1], np.minimum(m[:-1], m[1:]), m[:-1])
                values, item, seen = self.classes[k]
                hit = np.flatnonzero(seen[p][m >> np.uint32(16)])
                if len(hit):
                    a, b = np.searchsorted(values[p], m[hit], "left"), np.searchsorted(values[p], m[hit], "right")
                    for x, lo, hi in zip(hit[b > a], a[b > a], b[b > a], strict=True):
                        found.update((int(d[x]), int(i)) for i in item[p, lo:hi])
        return found

    def sharing(self, h: np.ndarray, off: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(document number, item number) pairs of small items of that width that share a shingle."""
        values, item, seen = self.exact[width]
        hit = np.flatnonzero(seen[h >> ta.U64(48)])
        a, b = np.searchsorted(values, h[hit], "left"), np.searchsorted(values, h[hit], "right")
        shared, doc = b > a, np.searchsorted(off, hit, side="right") - 1
        _, once = np.unique(doc[shared] * len(values) + a[shared], return_index=True)  # a document may hold a shingle often
        doc, a, n = doc[shared][once], a[shared][once], (b - a)[shared][once]
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return set(zip(np.repeat(doc, n).tolist(), item[at].tolist(), strict=True))

    def verified(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, object, float]]:
        """(document number, item id, containment) of the documents of a slice."""
        start, end, text = ta.words(data, offsets)
        hashes, n = ta.word_hashes(data, start, end), len(offsets) - 1
        h, off = ta.shingles(hashes, text, n, WIDTH)
        out, whole, of = [], None, -1
        for w in self.exact.keys() - {WIDTH}:  # one shingle: shared or not
            out += [(d, self.ids[i], 1.0) for d, i in self.sharing(*ta.shingles(hashes, text, n, w), w) if threshold <= 1]
        for d, i in sorted(self.candidates(h, off) | (self.sharing(h, off, WIDTH) if WIDTH in self.exact else set())):
            if d != of:
                whole, of = np.unique(h[off[d] : off[d + 1]]), d
            own = self.shingles[i]
            at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            share = float((whole[at] == own).sum()) / len(own)
            if share >= threshold:
                out.append((d, self.ids[i], share))
        return out


def blocks_of(items: DataFrame, item_id: str = "item_id", item_text: str = "text", item_block: int = ITEM_BLOCK, item_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """The items, about ``item_block`` of them or ``item_bytes`` at a time. Repeated rows go together; each is an item."""
    named = items.select(F.col(item_id).cast("long").alias("item_id"), common.text_bytes(item_text).alias("text"))
    n, size = named.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // item_block), -(-(size or 0) // item_bytes))
    for k in range(parts):
        rows = (named if parts == 1 else named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).toArrow()
        yield Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, containment): items of whose shingles a document holds at least ``threshold``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text"))
    out = None
    for block in blocks_of(items, item_block=item_block):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                for first, _, data, offsets in ta.slices(b.column(1)):
                    hits = shipped.value.verified(data, offsets, threshold)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + d for d, _, _ in hits], pa.int64())), pa.array([i for _, i, _ in hits], pa.int64()), pa.array([s for _, _, s in hits], pa.float64())], names=["doc_id", "item_id", "containment"])

        part = base.mapInArrow(run, "doc_id long, item_id long, containment double")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """docs without those that contain an item; judged where they are read, without a shuffle."""
    for block in blocks_of(items, item_block=item_block):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def judge(texts: pa.Array, shipped=shipped) -> list[pa.Array]:
            hit = [False] * len(texts)
            for first, _, data, offsets in ta.slices(texts):
                for d, _, _ in shipped.value.verified(data, offsets, threshold):
                    hit[first + d] = True
            return [pa.array(hit, pa.bool_())]

        docs = common.judged(docs, judge, "hit boolean", text).filter("not hit").select("row.*")
    return docs
