"""Exact top-k inner-product search by norm buckets.

The table is dealt out by length, longest vectors first, and written so once;
each run of ``BUCKET`` vectors of it is a bucket of nearly equal lengths. A query
skips a bucket whose longest vector cannot reach the query's current k-th score.
The ratio of that score to (query length x longest length) is the bucket's local
cosine threshold: where it is low, vectors are pruned by length alone; where it
is high, by the query's largest coordinate, which a vector of that cosine must
nearly share. Only what is left is multiplied, by exact integer products.

A first bucket, the ``first_bucket`` longest vectors of the whole table, gives
every query a lower bound before the search starts. Queries go out in blocks of
bounded size; each block reads the files down to the length that its bounds still
ask for. So work is queries x vectors, less what is pruned, and a block's queries
are all that the driver ever holds.

Vectors that are null or hold null or non-finite components take no part; a
shorter vector counts as filled up with zeros. Every row is a candidate for all
others, also for rows of the same id, and every row whose id is asked for is a
query of its own: an id that m rows have comes with m lists of ranks. Null ids take no part.
Scores beyond 64 bits are cut there. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries sent out at a time; with their vectors they are what is broadcast.
QUERY_BLOCK = 8192
FIRST_BUCKET = 1024
BUCKET = 512
#: From this local cosine threshold on, a bucket is pruned by coordinate.
COORDINATE_FROM = 0.6
_LOW = -(2**63) + 1  # its negative is a long, too
_SLACK = 1e-9


def matrix(column: pa.Array, scale: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) as a dense float matrix, which rows take part)."""
    sizes = np.array([len(v) if v is not None else 0 for v in column], dtype=np.int64) if column.null_count else np.diff(np.asarray(column.offsets))
    flat = column.flatten()
    bad_value = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    values = np.floor(np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), posinf=0, neginf=0) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = ~np.asarray(column.is_null())
    ok[row[bad_value]] = False
    out = np.zeros((len(sizes), max(width or 0, int(sizes.max(initial=1)))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, ok


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of q and v; floats hold them while they stay below 2**53."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < 2.0**52:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in v], dtype=object).T
    return np.clip(exact, -(2**63) + 2, 2**63 - 1).astype(np.int64)


def pair_products(q: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The products of rows r of q with rows c of v, pair by pair."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] >= 2.0**52:
        return products(q, v)[r, c]
    parts = [np.einsum("ij,ij->i", q[r[at : at + 65536]], v[c[at : at + 65536]]) for at in range(0, len(r), 65536)]
    return np.concatenate(parts).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Block:
    """A block of queries and the best that one task has found for each."""

    def __init__(self, rows: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
        self.rows, self.q, self.k, self.bound = rows, q, k, bound.astype(np.float64)
        self.norm = np.sqrt((q * q).sum(1))
        self.unit = q / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(self.unit).argmax(1)
        self.scores = np.full((len(rows), k), _LOW, np.int64)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max, np.int64)

    def take(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Candidates: their rows, ids and vectors."""
        norm = np.sqrt((v * v).sum(1))
        order = np.lexsort((ids, -norm))
        for at in range(0, len(order), BUCKET):
            part = order[at : at + BUCKET]
            self._bucket(own[part], ids[part], v[part], norm[part])

    def _bucket(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        """Vectors of a bucket, the longest first."""
        reach = self.norm * norm[0]
        live = np.flatnonzero(reach * (1 + _SLACK) + _SLACK >= self.bound)
        if not len(live):
            return
        cosine = np.where(reach[live] > 0, self.bound[live] / np.maximum(reach[live], 1e-300), -1)
        by_length, by_coordinate = live[cosine < COORDINATE_FROM], live[cosine >= COORDINATE_FROM]
        if len(by_length):  # a prefix of the bucket; queries of like prefixes go together
            need = self.bound[by_length] / np.maximum(self.norm[by_length], 1e-300)
            first = np.searchsorted(-(norm * (1 + _SLACK) + _SLACK), -need, side="right")
            for step in range(4):
                lo, hi = len(norm) * step // 4, len(norm) * (step + 1) // 4
                rows, n = by_length[(first > lo) & (first <= hi)], hi
                self._verify(rows, own[:n], ids[:n], v[:n], np.arange(n)[None, :] < first[(first > lo) & (first <= hi)][:, None])
        if len(by_coordinate):
            t = np.minimum(cosine[cosine >= COORDINATE_FROM], 1.0)
            c = self.unit[by_coordinate, self.focus[by_coordinate]]
            lean = np.sqrt(np.maximum(0, (1 - t * t) * (1 - c * c)))
            x = (v / np.maximum(norm, 1e-300)[:, None])[:, self.focus[by_coordinate]].T
            keep = (x >= (c * t - lean)[:, None] - 1e-7) & (x <= (np.where(c > t, 1.0, c * t + lean))[:, None] + 1e-7)
            keep |= (c < -t)[:, None]
            keep |= (norm <= 0)[None, :]
            self._verify(by_coordinate, own, ids, v, keep)

    def _verify(self, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, v: np.ndarray, keep: np.ndarray) -> None:
        """Multiply the pairs in ``keep`` (rows x vectors) and take the best: pair by pair if they are few, else what rows and vectors they span."""
        keep = keep & (self.rows[rows][:, None] != own[None, :])
        some, held = keep.any(1), keep.any(0)
        rows, ids, v, keep = rows[some], ids[held], v[held], keep[some][:, held]
        if not len(rows):
            return
        if keep.mean() < 0.05:
            r, c = np.nonzero(keep)
            scores = np.full(keep.shape, _LOW, np.int64)
            scores[r, c] = pair_products(self.q[rows], v, r, c)
        else:
            scores = np.where(keep, products(self.q[rows], v), _LOW)
        scores, found = best_of(scores, np.where(keep, ids[None, :], np.iinfo(np.int64).max), self.k)
        scores, found = best_of(np.hstack([self.scores[rows], scores]), np.hstack([self.found[rows], found]), self.k)
        self.scores[rows], self.found[rows] = scores, found
        full = scores[:, -1] > _LOW
        self.bound[rows[full]] = np.maximum(self.bound[rows[full]], scores[full, -1].astype(np.float64))


def by_norm(vectors: DataFrame, is_query: Column, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v, q, r, n) of the vectors that take part, written in order of n, the longest first. n is not less than a vector's length; r tells rows apart."""
    sane = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * scale + 1, F.lit(2.0))))
    base = base.filter(F.col("id").isNotNull() & sane).withColumn("n", n)
    return common.written(base.repartitionByRange(F.desc("n")).sortWithinPartitions(F.desc("n")).withColumn("r", F.monotonically_increasing_id()), "vectors")[0]


def topk(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, query_block: int = QUERY_BLOCK, first_bucket: int = FIRST_BUCKET) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    base = by_norm(vectors, is_query, vec_id, vector, scale)
    order = [F.desc("n"), F.col("r")]
    # The last of the longest is found without vectors, so that only those of the first bucket meet in one task.
    last = base.select("n", "r").orderBy(*order).limit(first_bucket).orderBy("n", F.desc("r")).first()
    ahead = (F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("r") <= last["r"])) if last else F.lit(False)
    longest = base.filter(ahead).orderBy(*order).limit(first_bucket).select("r", "v").toArrow()
    first_rows = longest.column("r").to_numpy()
    first = matrix(longest.column("v").combine_chunks(), scale)[0] if len(first_rows) else np.zeros((0, 1))
    queries = base.filter("q").select("id", "r", "v")
    blocks = max(1, -(-queries.count() // query_block))
    path = common.new_folder(spark, "found")
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("r"), F.lit(blocks)) == b).toArrow()
        _search(base, own, first_rows, first, k, scale).write.mode("append").parquet(path)
    out = spark.read.schema(FOUND).parquet(path)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, query_row long, vec_id long, score long"


def _search(base: DataFrame, own: pa.Table, first_rows: np.ndarray, first: np.ndarray, k: int, scale: float) -> DataFrame:
    query_ids, query_rows = own.column("id").to_numpy(), own.column("r").to_numpy()
    q = matrix(own.column("v").combine_chunks(), scale)[0] if len(query_ids) else np.zeros((0, 1))
    bound = np.full(len(query_ids), -np.inf)
    if len(query_ids) and len(first_rows) > k:
        a, b = _same_width(q, first)
        for at in range(0, len(a), 512):
            s = np.where(query_rows[at : at + 512, None] != first_rows[None, :], products(a[at : at + 512], b), _LOW)
            kth = np.partition(s, -k, axis=1)[:, -k]
            bound[at : at + 512] = np.where(kth > _LOW, kth.astype(np.float64), -np.inf)
        need = (bound / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)).min()  # no shorter vector reaches any of these queries' scores
        base = base.filter(F.col("n") * (1 + 2 * _SLACK) >= F.lit(float(need))) if np.isfinite(need) and need > 0 else base
    shipped = base.sparkSession.sparkContext.broadcast((query_ids, query_rows, q, bound))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, q, bound = shipped.value
        block = None
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            v, _ = matrix(batch.column(2), scale, q.shape[1])
            if block is None or v.shape[1] > block.q.shape[1]:
                before, block = block, Block(own, np.pad(q, ((0, 0), (0, v.shape[1] - q.shape[1]))), bound, k)
                if before is not None:
                    block.scores, block.found, block.bound = before.scores, before.found, before.bound
            if v.shape[1] < block.q.shape[1]:
                v = np.pad(v, ((0, 0), (0, block.q.shape[1] - v.shape[1])))
            block.take(batch.column(0).to_numpy(), batch.column(1).to_numpy(), v)
        if block is not None:
            r, c = np.nonzero(block.scores > _LOW)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(own[r]), pa.array(block.found[r, c]), pa.array(block.scores[r, c])], names=["query_id", "query_row", "vec_id", "score"])

    return base.select("r", "id", "v").mapInArrow(search, FOUND)
