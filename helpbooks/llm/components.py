"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple[int, int | None]:
    """(number of edges, their hash in any order)."""
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(v long, component long) of edges (u long, v long): the least vertex of each component, for every vertex with an edge to another.

    A large star links all greater neighbours of a vertex to its least
    neighbour, a small star all lesser ones; rounds stop when nothing changes.
    Each round is written to the shared folder. A vertex with very many
    neighbours, a group of copies say, is looked up where its edges are. Edges without ends and loops
    are passed over, repeated ones count once.
    """
    e = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = _checksum(e)
    for _ in range(most_rounds):
        n = before[0]
        if not n:
            break
        e = common.few_parts(e, n)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = common.looked_up(both.filter("v > u"), least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.looked_up(large, low, "u", n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = common.cut(small.filter("u != v").distinct())
        after = _checksum(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    common.sweep(edges.sparkSession)
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(e.select("v", F.col("v").alias("component")).distinct())
