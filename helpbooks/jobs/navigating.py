"""Queries of the navigation structures (T) and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import clickstream, links, navigation, sitemap
from ..sources import tables
from .registry import query


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap.nodes(tables.contents_markup(spark, sf))


def toc(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.toc(nodes(spark, sf))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.keyword_index(sitemap.nodes(tables.index_markup(spark, sf)))


@query("t1_parse_sitemap", "SELECT book_id, ordinal, parent_ordinal, CAST(depth AS INTEGER) AS depth, name, coalesce(local_path, '') AS locals FROM toc_nodes", "toc_nodes")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("book_id", "ordinal", "parent_ordinal", "depth", "name", F.array_join("locals", ",").alias("locals"))


@query("t2_contents", "SELECT book_id, 'toc-' || ordinal AS node_id, 'toc-' || parent_ordinal AS parent_id, ordinal, CAST(depth AS INTEGER) AS depth, name, local_path FROM toc_nodes", "toc_nodes")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return toc(spark, sf)


_INDEX = "SELECT book_id, 'idx-' || ordinal AS entry_id, ordinal, name, CAST(depth AS INTEGER) AS depth, coalesce(array_to_string(locals, ','), '') AS local_paths FROM index_entries"


@query("t3_keyword_index", _INDEX, "index_entries")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).withColumn("local_paths", F.array_join("local_paths", ","))


@query("a6_ordered_targets", "SELECT book_id, ordinal, place - 1 AS place, locals[place] AS target FROM (SELECT *, unnest(range(1, len(locals) + 1)) AS place FROM index_entries)", "index_entries")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).select("book_id", "ordinal", F.posexplode("local_paths").alias("place", "target"))


@query("w2_preorder_numbers", "SELECT book_id, ordinal, parent_ordinal, row_number() OVER (PARTITION BY book_id, parent_ordinal ORDER BY ordinal) AS place FROM toc_nodes", "toc_nodes")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    """Reading-order numbers, and each node's place among its siblings."""
    own = Window.partitionBy("book_id", "parent_ordinal").orderBy("ordinal")
    return nodes(spark, sf).select("book_id", "ordinal", "parent_ordinal", F.row_number().over(own).alias("place"))


_FIRST = "SELECT book_id, path, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ordinal) AS rn FROM entries WHERE lower(path) LIKE '%{}') WHERE rn = 1"


@query("t4_first_with_suffix", _FIRST.format(".html"), "entries")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.first_with_suffix(tables.entries(spark, sf), ".html")


@query("w3_first_listed", _FIRST.format(""), "entries")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    """The first of all entries of a book."""
    return navigation.first_with_suffix(tables.entries(spark, sf), "")


@query("t5_book_documents", """SELECT book_id, 'Help ' || book_id AS title, count(*) AS toc_nodes, 0 AS index_entries FROM toc_nodes GROUP BY book_id
 UNION ALL SELECT book_id, 'Help ' || book_id, 0, count(*) FROM index_entries GROUP BY book_id""", ("toc_nodes", "index_entries"))
def t5(spark: SparkSession, sf: str) -> DataFrame:
    t, i = toc(spark, sf), index(spark, sf)
    ids = t.select("book_id").union(i.select("book_id")).distinct()
    docs = navigation.book_documents(ids.withColumn("file_path", F.concat(F.lit("/shelf\\Help "), "book_id", F.lit(".CHM"))), t, i)
    return docs.select("book_id", "title", F.size("toc").cast("long").alias("toc_nodes"), F.size("index").cast("long").alias("index_entries"))


@query("t6_tree_shape", "SELECT book_id, count(*) AS nodes, count_if(depth = 0)::BIGINT AS top_nodes, count(*) > count_if(depth = 0) AS nested FROM toc_nodes GROUP BY book_id", "toc_nodes")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.tree_shape(toc(spark, sf))


@query("t7_has_children", "SELECT t.book_id, t.ordinal, EXISTS (SELECT 1 FROM toc_nodes c WHERE c.book_id = t.book_id AND c.parent_ordinal = t.ordinal) AS has_children FROM toc_nodes t", "toc_nodes")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.with_children_flag(toc(spark, sf)).select("book_id", "ordinal", "has_children")


@query("t7_target_badge", "SELECT book_id, ordinal, CASE WHEN len(locals) > 1 THEN len(locals) END AS badge FROM index_entries", "index_entries")
def t7b(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.target_badge(index(spark, sf)).select("book_id", "ordinal", "badge")


@query("t8_landing_page", "SELECT book_id, local_path, CASE WHEN local_path IS NOT NULL THEN 'chm://' || book_id || '/' || local_path END AS url FROM toc_nodes WHERE ordinal = 0", "toc_nodes")
def t8(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.landing_pages(toc(spark, sf))


@query("t9_active_nodes", "SELECT book_id, 'chm://' || book_id || '/' || string_split(local_path, '#')[1] || '#now' AS url, 'toc-' || ordinal AS node_id FROM toc_nodes WHERE local_path IS NOT NULL", "toc_nodes")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    t = toc(spark, sf)
    url = paths.page_url(F.col("book_id"), F.concat(paths.strip_fragment(F.col("local_path")), F.lit("#now")))
    current = t.filter("local_path is not null").select("book_id", url.alias("url"))
    return navigation.active_nodes(t, current)


@query("t10_recent_files", "SELECT user_id, file_path, rank FROM (SELECT user_id, file_path, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, max(seq) DESC, file_path) AS rank FROM opened GROUP BY user_id, file_path) WHERE rank <= 10", "opened")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return clickstream.recent_files(tables.opens(tables.read(spark, sf, "events")))


@query("t11_book_ids", "SELECT DISTINCT file_path, sha256(file_path) AS book_id FROM opened", "opened")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.book_ids(tables.opens(tables.read(spark, sf, "events")))


_MISSING_TOC = "SELECT t.book_id, 'toc-' || t.ordinal AS node_id, local_path FROM toc_nodes t WHERE local_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.book_id = t.book_id AND lower(l.path) = '/' || lower(string_split(local_path, '#')[1]))"


@query("j2_dangling_contents", _MISSING_TOC, ("toc_nodes", "listing"))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return links.dangling_toc(toc(spark, sf), tables.listing(spark, sf))


@query("j3_dangling_index", "SELECT t.book_id, 'idx-' || t.ordinal AS entry_id, link FROM (SELECT book_id, ordinal, unnest(locals) AS link FROM index_entries) t WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.book_id = t.book_id AND lower(l.path) = '/' || lower(link))", ("index_entries", "listing"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return links.dangling_index(index(spark, sf), tables.listing(spark, sf))
