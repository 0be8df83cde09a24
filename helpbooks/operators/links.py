"""Link integrity: which targets are listed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def listed(entries: DataFrame) -> DataFrame:
    """(book_id, path_key, path, size): of paths that differ in case alone, the first listed."""
    keyed = entries.withColumn("path_key", paths.path_key(F.col("path")))
    return keyed.groupBy("book_id", "path_key").agg(F.min_by("path", "ordinal").alias("path"), F.min_by("size", "ordinal").alias("size"))


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (book_id, path) with the entry they name, whatever their case; null if there is none."""
    have = listed(entries).select("book_id", "path_key", F.col("path").alias("entry_path"), "size")
    return requests.withColumn("path_key", paths.path_key(F.col("path"))).join(have, ["book_id", "path_key"], "left").drop("path_key")


def _missing(links: DataFrame, entries: DataFrame) -> DataFrame:
    wanted = links.withColumn("path_key", paths.path_key(paths.internal_path(F.col("link"))))
    return wanted.join(listed(entries).select("book_id", "path_key"), ["book_id", "path_key"], "left_anti")


def dangling_toc(toc_nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Contents nodes whose link names no entry; nodes without a link don't count."""
    links = toc_nodes.filter(F.coalesce("local_path", F.lit("")) != "").withColumn("link", F.col("local_path"))
    return _missing(links, entries).select("book_id", "node_id", "local_path")


def dangling_index(index_entries: DataFrame, entries: DataFrame, first: int | None = None) -> DataFrame:
    """(book_id, entry_id, link): index targets that name no entry; ``first`` keeps to that many entries a book."""
    own = index_entries if first is None else index_entries.filter(F.col("ordinal") < first)
    links = own.select("book_id", "entry_id", F.explode("local_paths").alias("link")).filter("link != ''")
    return _missing(links, entries).select("book_id", "entry_id", "link")


def unlisted_hits(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Search hits that are not listed, to the letter."""
    return hits.join(entries.select("book_id", "path"), ["book_id", "path"], "left_anti")


def listed_hits(hits: DataFrame, entries: DataFrame) -> DataFrame:
    return hits.join(entries.select("book_id", "path"), ["book_id", "path"], "left_semi")


def samples(rows: DataFrame, by: str, order: str, n: int = 15) -> DataFrame:
    """The first n rows of each group, with the group's full count beside them."""
    w = Window.partitionBy(by).orderBy(order)
    counted = rows.groupBy(by).agg(F.count("*").alias("total"))
    return rows.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= n).join(counted, by)
