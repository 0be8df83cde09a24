"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

A document's rate is the number of times the mix takes it. Of all rates that
give each source its target of words, entropy balancing takes those nearest, in
relative entropy of words, to taking every document once. A constraint that all
sources share keeps the mix from drifting to long or short documents: a word's
mean log length of its document is to stay that of the corpus (with a ridge, as
sources and lengths can contradict each other). So a document's rate is
exp(lambda of its source + mu x its log length): the lengths are tilted within
every source, and the dual couples the sources.

The dual is convex. Each Newton step is one distributed aggregation over cells
(source x size class) to gradient and curvature in mu, the sources' lambdas being
eliminated exactly; only mu, one number, comes back. With mu found, each source's
lambda is solved with no rate above ``MAX_COPIES``. Rates become copies class by
class, from long documents to short ones: each class is given the whole number
of copies that brings its source's words nearest to what is wanted so far, so
what is left over is about one of the shortest documents. Within a class copies
are spread evenly along the documents.

Null texts have size 0 and take no words, as do texts without words. Very long
texts are documents like any other, taken 0 to 3 times whole. A null source is a
source, the last. Null or repeated ids are rows like any other. Columns of any
name are kept in ``mixed_rows``. An empty table gives an empty mix. Sources, not
documents, are numbered in one task (a row each).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEWTON_STEPS = 40
#: A (source, size class) is dealt over so many parts, so that no hot source or group of copies meets in one task.
SALTS = 256
MAX_COPIES = 3
#: Sizes of a class differ by 2 % at most.
CLASS_RATIO = 1.02
#: Weight of mu**2 against the spread of log lengths.
RIDGE = 0.05


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source: shares of the grand total by weight, none above cap x its size.

    Sources in code point order, null last, weigh ``weights`` in turn. Filling
    up under caps has one solution: sources with the least cap for their weight
    are full, the rest share by weight what those leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("double")).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    all_rows, before = Window.partitionBy(), by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(all_rows).cast("double"), "full_before": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "weight_from": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("full", F.col("most") * F.col("weight_from") <= F.col("weight") * (F.col("total") - F.col("full_before")))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(all_rows)
    share = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    return s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * left / share)).select("source", "source_size", "target")


def length_tilt(cells: DataFrame, cap: float = MAX_COPIES, steps: int = NEWTON_STEPS) -> tuple[float, float]:
    """(mu, mean log length) of cells (key, n, s, target, source_size): Newton's method on the dual, with every source's lambda eliminated.

    A source that takes all it may is fixed at the cap and takes part in the shared constraint alone.
    """
    long = F.log(F.col("s") / F.col("n"))
    about = cells.filter("s > 0").agg(F.sum(F.col("s") * long) / F.sum("s")).first()[0]
    if about is None:
        return 0.0, 0.0
    full = F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12)
    c = common.cut(cells.filter("s > 0").select("key", "target", F.col("s").cast("double").alias("s"), (long - F.lit(about)).alias("x"), full.alias("full")))
    c = common.few_parts(c, c.count())
    total = c.agg(F.sum(F.col("s") * F.col("x") ** 2), F.sum(F.when(F.col("full"), F.lit(cap) * F.col("s") * F.col("x")).otherwise(0.0))).first()
    ridge, goal, mu = RIDGE * total[0], -total[1], 0.0
    for _ in range(steps):
        w = F.col("s") * F.exp(F.lit(mu) * F.col("x"))
        each = c.filter("not full").groupBy("key").agg(F.first("target").alias("t"), F.sum(w).alias("a"), F.sum(w * F.col("x")).alias("b"), F.sum(w * F.col("x") ** 2).alias("c"))
        scale = F.col("t") / F.col("a")  # exp(lambda)
        g, h = each.agg(F.sum(scale * F.col("b")), F.sum(scale * (F.col("c") - F.col("b") ** 2 / F.col("a")))).first()
        slope, curve = (g or 0.0) - goal + ridge * mu, (h or 0.0) + ridge
        step = max(-1.0, min(1.0, -slope / curve)) if curve > 0 else 0.0
        mu += step
        if abs(step) < 1e-10:
            break
    common.sweep(cells.sparkSession)
    return round(mu, 7), about  # rounded, so that the order of sums does not matter


def _rate(lam: Column, tilt: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(lam + tilt))


def rounded(cells: DataFrame, mu: float, about: float, cap: int = MAX_COPIES) -> DataFrame:
    """(key, class, rate, class_docs, class_copies, source_size, target) of cells (key, class, n, s, target, source_size).

    A source's cells are one array, of as many entries as there are size classes. Its lambda is bisected.
    """
    cell = F.struct((-F.col("class")).alias("order"), "class", "n", F.col("s").cast("double").alias("s"), F.when(F.col("s") > 0, F.lit(mu) * (F.log(F.col("s") / F.col("n")) - F.lit(about))).otherwise(0.0).alias("tilt"))
    each = cells.groupBy("key").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list(cell)).alias("cells"))

    def words(lam: Column) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["s"] * _rate(lam, c["tilt"], cap))

    def halved(range_: Column, _: Column) -> Column:
        mid = (range_["lo"] + range_["hi"]) / 2
        low = words(mid) < F.col("target")
        return F.struct(F.when(low, mid).otherwise(range_["lo"]).alias("lo"), F.when(low, range_["hi"]).otherwise(mid).alias("hi"))

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi")), halved)["hi"]
    each = each.withColumn("lam", F.when((F.col("target") > 0) & (F.col("source_size") > 0), lam).otherwise(-200.0))

    def dealt(state: Column, c: Column) -> Column:
        mean = F.when(c["s"] > 0, c["s"] / c["n"]).otherwise(1.0)
        wanted = state["wanted"] + c["s"] * _rate(F.col("lam"), c["tilt"], cap)
        copies = F.when(c["s"] > 0, F.greatest(F.lit(0.0), F.least(F.round((wanted - state["taken"]) / mean), c["n"] * float(cap)))).otherwise(0.0)
        row = F.struct(c["class"].alias("class"), c["n"].alias("class_docs"), copies.cast("long").alias("class_copies"), _rate(F.col("lam"), c["tilt"], cap).alias("rate"))
        return F.struct(wanted.alias("wanted"), (state["taken"] + copies * mean).alias("taken"), F.concat(state["out"], F.array(row)).alias("out"))

    none = F.array().cast("array<struct<class: int, class_docs: bigint, class_copies: bigint, rate: double>>")
    start = F.struct(F.lit(0.0).alias("wanted"), F.lit(0.0).alias("taken"), none.alias("out"))
    return each.select("key", "source_size", "target", F.explode(F.aggregate("cells", start, dealt)["out"]).alias("o")).select("key", "source_size", "target", "o.*")


def _share(upto: Column, copies: Column, docs: Column) -> Column:
    """How many of ``copies`` the first ``upto`` of ``docs`` get, in whole numbers of any size."""
    wide = "decimal(19,0)"
    return F.call_function("div", upto.cast(wide) * copies.cast(wide), docs.cast(wide))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), text: str = "text", source: str = "source", doc_id: str = "doc_id", rows: bool = False) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, rate, copies, taken; with ``rows`` also ``row``, all its columns."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), word_count(text).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("mixed"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []))
    if not rows:
        d = common.written(d, "sizes")[0]  # words are counted once
    size_class = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(CLASS_RATIO)))).otherwise(-1)
    d = d.withColumn("class", size_class.cast("int")).withColumn("salt", F.pmod("mixed", F.lit(SALTS)).cast("int"))
    # at most SALTS x 1,100 counts a source, whatever its number of documents
    counts = common.cut(d.groupBy("source", "key", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("s")))
    goals = targets(counts.groupBy("source").agg(F.sum("s").alias("source_size")), weights)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "source_size", "target")
    cells = common.cut(counts.groupBy("key", "class").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(goals, "key"))
    plan = rounded(cells, *length_tilt(cells))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("key", "class", "salt", "n", before.alias("before")).join(plan, ["key", "class"])
    own_copies = _share(F.col("before") + F.col("n"), F.col("class_copies"), F.col("class_docs")) - _share(F.col("before"), F.col("class_copies"), F.col("class_docs"))
    parts = parts.withColumn("part_copies", own_copies).drop("before", "class_docs", "class_copies")
    own = Window.partitionBy("key", "class", "salt").orderBy(F.desc("size"), "mixed", "doc_id")
    j = d.join(parts, ["key", "class", "salt"]).withColumn("rank", F.row_number().over(own))
    copies = _share(F.col("rank"), F.col("part_copies"), F.col("n")) - _share(F.col("rank") - 1, F.col("part_copies"), F.col("n"))
    out = j.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", "taken", *(["row"] if rows else []))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    m = mix(docs, weights, rows=True).filter("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
