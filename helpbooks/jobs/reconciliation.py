"""Queries that compare, merge and verify extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links, reconcile
from ..sources import tables
from .registry import query


def merged_manifest(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return reconcile.merged(a, b, "first", "second")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    a, _, c = tables.manifests(spark, sf)
    return reconcile.verified(a, c)


@query("j5_disagreements", "SELECT a.book, a.path, a.sha256 AS sha_a, b.sha256 AS sha_b FROM man_a a JOIN man_b b ON a.book = b.book AND a.path = b.path WHERE a.sha256 <> b.sha256", ("man_a", "man_b"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return reconcile.disagreements(a, b)


@query("j5_trusted_books", "SELECT book, coalesce(sum(CASE WHEN a.sha256 <> b.sha256 THEN 1 ELSE 0 END), 0)::BIGINT AS mismatches, coalesce(sum(CASE WHEN a.sha256 <> b.sha256 THEN 1 ELSE 0 END), 0) = 0 AS trusted FROM man_a a FULL JOIN man_b b USING (book, path) GROUP BY book", ("man_a", "man_b"))
def j5b(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return reconcile.trusted(a, b)


@query("j6_merged_manifest", "SELECT * FROM merged", "merged")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return merged_manifest(spark, sf).withColumn("tools", F.array_join("tools", ","))


@query("j7_verified", "SELECT * FROM verdicts", "verdicts")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf)


@query("j8_missing_from_listing", "SELECT a.book, a.path FROM man_a a LEFT JOIN man_c c ON a.book = c.book AND a.path = c.path WHERE c.path IS NULL", ("man_a", "man_c"))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    a, _, c = tables.manifests(spark, sf)
    return reconcile.unlisted(a, c)


@query("a1_confirmed_rollup", "SELECT book, grouping(book)::BIGINT AS is_total, count(*) AS files, count_if(tools = 'first,second')::BIGINT AS confirmed FROM merged GROUP BY ROLLUP (book)", "merged")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.confirmed_counts(merged_manifest(spark, sf))


@query("a2_first_problems", "SELECT book, path, status, rn, total FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY path) AS rn, count(*) OVER (PARTITION BY book) AS total FROM verdicts WHERE status <> 'ok') WHERE rn <= 15", "verdicts")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.first_problems(verdicts(spark, sf))


@query("u1_all_paths", "SELECT book, path FROM man_a UNION SELECT book, path FROM man_b", ("man_a", "man_b"))
def u1(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return reconcile.all_paths(a, b)


@query("u3_difference", "SELECT book, path FROM man_a EXCEPT SELECT book, path FROM man_b", ("man_a", "man_b"))
def u3(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return a.select("book", "path").exceptAll(b.select("book", "path"))


@query("u4_common_paths", "SELECT book, path FROM man_a INTERSECT SELECT book, path FROM man_b", ("man_a", "man_b"))
def u4(spark: SparkSession, sf: str) -> DataFrame:
    a, b, _ = tables.manifests(spark, sf)
    return reconcile.common_paths(a, b)


@query("j1_entry_lookup", "SELECT h.doc_id, e.ordinal FROM (SELECT page_id AS doc_id, book_id, CASE WHEN page_id % 3 = 0 THEN path || 'x' ELSE upper(path) END AS path FROM page_paths) h LEFT JOIN entries e ON h.book_id = e.book_id AND lower(h.path) = lower(e.path)", ("page_paths", "entries"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    asked = tables.page_paths(spark, sf).select(F.col("page_id").alias("doc_id"), "book_id", F.when(F.col("page_id") % 3 == 0, F.concat("path", F.lit("x"))).otherwise(F.upper("path")).alias("path"))
    entries = tables.entries(spark, sf).select("book_id", "ordinal", "path", F.col("ordinal").alias("size"))
    return links.lookup(asked, entries).select("doc_id", F.col("size").alias("ordinal"))
