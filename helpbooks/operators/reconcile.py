"""Several extractions of the same books compared, merged and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ON = ["book", "path"]


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book, path, sha_a, sha_b) of files that both hold with different content."""
    left, right = a.select(*ON, F.col("sha256").alias("sha_a")), b.select(*ON, F.col("sha256").alias("sha_b"))
    return left.join(right, ON).filter("sha_a != sha_b")


def merged(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """``schemas.MANIFEST``: all files of either, a's values first, ``tools`` says who has it."""
    left = a.select(*ON, F.col("size").alias("size_a"), F.col("sha256").alias("sha_a"))
    right = b.select(*ON, F.col("size").alias("size_b"), F.col("sha256").alias("sha_b"))
    j = left.join(right, ON, "full_outer")
    tools = F.array_compact(F.array(F.when(F.col("sha_a").isNotNull(), F.lit(name_a)), F.when(F.col("sha_b").isNotNull(), F.lit(name_b))))
    return j.select(*ON, F.coalesce("size_a", "size_b").alias("size"), F.coalesce("sha_a", "sha_b").alias("sha256"), tools.alias("tools"))


def trusted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book, mismatches, trusted): a book with any disagreement is not trusted."""
    books = a.select("book").union(b.select("book")).distinct()
    bad = disagreements(a, b).groupBy("book").agg(F.count("*").alias("mismatches"))
    n = F.coalesce("mismatches", F.lit(0))
    return books.join(bad, "book", "left").select("book", n.alias("mismatches"), (n == 0).alias("trusted"))


def verified(baseline: DataFrame, third: DataFrame) -> DataFrame:
    """(book, path, status): what a third extraction has of each file: unreadable, size, hash or ok."""
    got = third.select(*ON, F.col("size").alias("size_c"), F.col("sha256").alias("sha_c"))
    status = F.when(F.col("size_c").isNull(), "unreadable").when(F.col("size_c") != F.col("size"), "size").when(F.col("sha_c") != F.col("sha256"), "hash").otherwise("ok")
    return baseline.join(got, ON, "left").select(*ON, status.alias("status"))


def unlisted(baseline: DataFrame, entries: DataFrame) -> DataFrame:
    """Baseline files that a listing lacks; case matters."""
    return baseline.join(entries.select(*ON), ON, "left_anti").select(*ON)


def confirmed_counts(manifest: DataFrame) -> DataFrame:
    """(book, is_total, files, confirmed) by book, and in all."""
    rolled = manifest.rollup("book").agg(F.grouping("book").cast("long").alias("is_total"), F.count("*").alias("files"), F.count_if(F.size("tools") == 2).alias("confirmed"))
    return rolled.select("book", "is_total", "files", "confirmed")


def first_problems(verdicts: DataFrame, n: int = 15) -> DataFrame:
    """(book, path, status, rn, total): the first n files of each book that are not ok, with the book's count."""
    bad = verdicts.filter("status != 'ok'")
    w = Window.partitionBy("book").orderBy("path")
    total = bad.groupBy("book").agg(F.count("*").alias("total"))
    return bad.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= n).join(total, "book")


def all_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ON).union(b.select(*ON)).distinct()


def common_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ON).intersect(b.select(*ON))
