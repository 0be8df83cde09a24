"""Queries of the search operators (X), and the windows, sets and counts that search uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index, links, navigation, search, segments
from ..schemas import PAGES_TEXT
from ..sources import tables
from .registry import query
from .scalars import _EXCERPT, scratch


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return search.page_texts(tables.entries(spark, sf), "UTF-8")


def opened(spark: SparkSession, sf: str) -> index.Index:
    """An index in the shared folder, built once and read from there as often as a query needs it."""
    folder = scratch(spark, "index")
    index.write(pages(spark, sf), folder)
    return index.open_index(spark, folder)


def top(spark: SparkSession, sf: str) -> DataFrame:
    return index.ranked(opened(spark, sf), tables.searches(spark))


@query("x1_tokenise", "SELECT book_id, path, field, count(*) AS words, count(DISTINCT term) AS terms FROM occurrences GROUP BY ALL", "occurrences")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.occurrences(pages(spark, sf))
    return rows.groupBy("book_id", "path", "field").agg(F.count("*").alias("words"), F.count_distinct("term").alias("terms"))


@query("x2_postings", "SELECT * FROM postings", "postings")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(pages(spark, sf))


@query("x3_prefix_match", "SELECT DISTINCT token, term FROM postings JOIN tokens ON starts_with(term, token)", ("postings", "tokens"))
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return index.prefix_matches(opened(spark, sf), tables.searches(spark)).select("token", "term")


@query("x3_edge_match", "SELECT DISTINCT token, term FROM postings JOIN tokens ON starts_with(term, token)", ("postings", "tokens"))
def x3b(spark: SparkSession, sf: str) -> DataFrame:
    return search.edge_matches(opened(spark, sf).terms, search.query_tokens(tables.searches(spark)))


@query("x4_all_tokens", "SELECT * FROM field_hits", "field_hits")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return index.field_hits(opened(spark, sf), tables.searches(spark))


@query("x5_limits", "SELECT query_id, book_id, path, rank FROM ranked", "ranked")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf).select("query_id", "book_id", "path", "rank")


@query("x6_hits_with_pages", "SELECT query_id, r.book_id, r.path, rank, title FROM ranked r JOIN stripped s ON r.book_id = s.book_id AND r.path = s.path", ("ranked", "stripped"))
def x6(spark: SparkSession, sf: str) -> DataFrame:
    """Hits from the index, then the bytes of their pages alone."""
    hits, entries = top(spark, sf), tables.entries(spark, sf)
    return search.with_meta(hits, search.hit_texts(hits, entries, "UTF-8"), tables.searches(spark)).select("query_id", "book_id", "path", "rank", "title")


_SEARCH = f"""SELECT query_id, book_id, path, title, rank, score, {_EXCERPT} AS excerpt FROM (SELECT *, strpos(lower(text), term) AS hit FROM (
 SELECT r.*, title, text, lower(string_split(trim(q), ' ')[1]) AS term FROM ranked r JOIN stripped s ON r.book_id = s.book_id AND r.path = s.path JOIN searches USING (query_id)))"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    return index.find(opened(spark, sf), tables.searches(spark))


@query("x7_excerpts", f"SELECT book_id, path, query_id, {_EXCERPT} AS excerpt FROM (SELECT *, strpos(lower(text), term) AS hit FROM (SELECT book_id, path, text, query_id, string_split(lower(q), ' ')[1] AS term FROM stripped, (SELECT query_id, trim(q) AS q FROM searches) WHERE length(q) >= 2))", ("stripped", "searches"))
def x7(spark: SparkSession, sf: str) -> DataFrame:
    """An excerpt of every page for every query, found there or not."""
    asked = search.gated(tables.searches(spark)).select("query_id", "q")
    each = pages(spark, sf).select("book_id", "path", "text").crossJoin(F.broadcast(asked))  # a stated list of queries
    return each.select("book_id", "path", "query_id", text.excerpt(F.col("text"), F.col("q")).alias("excerpt"))


_IN_BOOK = """SELECT query_id, book_id, count(*) AS hits, sum(first)::BIGINT AS first FROM (
 SELECT query_id, book_id, field, path, n_tokens, sum(first) AS first FROM (
  SELECT query_id, b.book_id, token, n_tokens, path, field, min(first_pos) AS first FROM tokens, postings p
  JOIN (SELECT min(book_id) AS book_id FROM entries UNION SELECT max(book_id) FROM entries) b ON p.book_id = b.book_id WHERE starts_with(term, token) GROUP BY ALL)
 GROUP BY query_id, book_id, field, path, n_tokens HAVING count(*) = n_tokens) GROUP BY query_id, book_id"""


@query("x_search_in_book", _IN_BOOK, ("tokens", "postings", "entries"))
def x_in_book(spark: SparkSession, sf: str) -> DataFrame:
    """Each query in the first and in the last book alone; the book is part of the join."""
    held = opened(spark, sf)
    ends = held.pages.agg(F.min("book_id").alias("a"), F.max("book_id").alias("b"))
    books = ends.select(F.posexplode(F.array_distinct(F.array("a", "b"))).alias("at", "book_id"))
    asked = tables.searches(spark).drop("book_id").crossJoin(F.broadcast(books))  # two books
    hits = index.field_hits(held, asked.withColumn("query_id", F.col("query_id") * 2 + F.col("at")))
    return hits.groupBy(F.floor(F.col("query_id") / 2).alias("query_id"), "book_id").agg(F.count("*").alias("hits"), F.sum("first").alias("first"))


query("x_search", _SEARCH, ("ranked", "stripped", "searches"))(_search)


# DuckDB counts edits in bytes, so letters beyond ASCII, which no token has, become one byte each.
_NEAR = r"""(SELECT DISTINCT token, term, levenshtein(token, regexp_replace(term, '[^\x00-\x7F]', '?', 'g')) AS off FROM (SELECT DISTINCT term FROM postings), (SELECT DISTINCT token FROM tokens)
 WHERE levenshtein(token, regexp_replace(term, '[^\x00-\x7F]', '?', 'g')) <= floor(length(token) * 0.2 + 0.5))"""


@query("x8_fuzzy_match", f"SELECT token, term FROM {_NEAR}", ("postings", "tokens"))
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy_matches(opened(spark, sf).terms, search.query_tokens(tables.searches(spark))).select("token", "term")


_BM25 = f"""SELECT query_id, book_id, path, rank, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, book_id, path) AS rank FROM (
 SELECT query_id, f.book_id, f.path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) / (1 + off)), 6) AS weight FROM (
  SELECT query_id, term, min(off) AS off FROM tokens JOIN (SELECT token, term, off FROM {_NEAR} UNION ALL
   SELECT DISTINCT token, term, length(term) - length(token) FROM postings JOIN tokens ON starts_with(term, token)) USING (token) GROUP BY query_id, term) w
 JOIN (SELECT term, book_id, path, sum(tf)::BIGINT AS tf FROM postings GROUP BY ALL) f USING (term)
 JOIN (SELECT term, count(DISTINCT (book_id, path)) AS df FROM postings GROUP BY term) USING (term)
 JOIN (SELECT book_id, path, sum(tf)::BIGINT AS len FROM postings GROUP BY ALL) l ON l.book_id = f.book_id AND l.path = f.path,
 (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT sum(tf) AS len FROM postings GROUP BY book_id, path)) GROUP BY ALL)) WHERE rank <= 50"""


@query("x8_fuzzy_search", _BM25, ("postings", "tokens"))
def x8b(spark: SparkSession, sf: str) -> DataFrame:
    return index.fuzzy_find(opened(spark, sf), tables.searches(spark))


@query("x9_statistics", "SELECT (SELECT count(*) FROM stripped WHERE text <> '') AS pages, (SELECT CAST(sum(length(text)) AS BIGINT) FROM stripped) AS text_chars, count(DISTINCT term) AS terms, count(*) AS postings FROM postings", ("stripped", "postings"))
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return index.statistics(opened(spark, sf))


_EXACT = "SELECT (SELECT count(*) FROM (SELECT DISTINCT book_id, path FROM postings)) AS pages, (SELECT CAST(sum(length(text)) AS BIGINT) FROM stripped) AS text_chars, count(*) AS postings, true AS terms_within FROM postings"


@query("x9_merged_statistics", _EXACT, ("stripped", "postings"))
def x9b(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of an index of three batches from the counts and sketches of its segments; the number of terms is within five standard errors."""
    folder = scratch(spark, "segments")
    pages(spark, sf).drop("error").write.parquet(f"{folder}/all")
    p = spark.read.schema(PAGES_TEXT).parquet(f"{folder}/all")
    segments.start(spark, folder)
    for k in range(3):
        segments.change(p.filter(F.pmod(F.xxhash64("path"), F.lit(3)) == k), folder, k)
    exact = segments.open_index(spark, folder).terms.agg(F.count("*").alias("n"))
    near = F.abs(F.col("terms") - F.col("n")) <= F.greatest(F.lit(1.0), 5 * 1.04 / 2 ** (index.SKETCH_BITS / 2) * F.col("n"))
    return segments.statistics(spark, folder).crossJoin(exact).select("pages", "text_chars", "postings", near.alias("terms_within"))  # one row each


@query("x10_incremental_index", "SELECT * FROM postings", "postings")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the pages first, then all of them: what is there already is not added again."""
    folder = scratch(spark, "segments")
    pages(spark, sf).drop("error").write.parquet(f"{folder}/all")  # decoded and stripped once
    p = spark.read.schema(PAGES_TEXT).parquet(f"{folder}/all")
    segments.start(spark, folder)
    segments.change(p.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == 0), folder, 0)
    segments.change(p, folder, 1)
    return segments.postings(spark, folder)


@query("j4_unlisted_hits", "SELECT DISTINCT h.book_id, h.path FROM ranked h LEFT JOIN (SELECT * FROM entries WHERE ordinal % 5 <> 0) e ON h.book_id = e.book_id AND h.path = e.path WHERE e.path IS NULL", ("ranked", "entries"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    some = tables.entries(spark, sf).filter("ordinal % 5 != 0")
    return links.unlisted_hits(top(spark, sf), some).select("book_id", "path").distinct()


@query("j4_listed_hits", "SELECT query_id, h.book_id, h.path FROM ranked h JOIN (SELECT * FROM entries WHERE ordinal % 5 <> 0) e ON h.book_id = e.book_id AND h.path = e.path", ("ranked", "entries"))
def j4b(spark: SparkSession, sf: str) -> DataFrame:
    some = tables.entries(spark, sf).filter("ordinal % 5 != 0")
    return links.listed_hits(top(spark, sf), some).select("query_id", "book_id", "path")


@query("j10_substring_join", "SELECT p_partkey, token FROM part JOIN (SELECT DISTINCT token FROM tokens) ON contains(lower(p_name), token)", "tokens")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    names = tables.read(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"))
    tokens = search.query_tokens(tables.searches(spark)).select(F.col("token").alias("needle")).distinct()
    return navigation.substring_matches(names, "name", tokens).select("p_partkey", F.col("needle").alias("token"))


@query("a3_pages_by_book", "SELECT book_id, count(*) AS pages FROM stripped WHERE text <> '' GROUP BY book_id", "stripped")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return search.indexable(pages(spark, sf)).groupBy("book_id").agg(F.count("*").alias("pages"))


@query("a4_sizes", "SELECT CAST(sum(length(text)) AS BIGINT) AS text_chars, round(avg(length(text)), 6) AS mean_chars FROM stripped WHERE text <> ''", "stripped")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return search.indexable(pages(spark, sf)).agg(F.sum(n).cast("long").alias("text_chars"), F.round(F.avg(n), 6).alias("mean_chars"))


@query("a5_distinct_hits", "SELECT query_id, count(DISTINCT (book_id, path)) AS pages, count(*) AS field_hits FROM field_hits GROUP BY query_id", "field_hits")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    hits = index.field_hits(opened(spark, sf), tables.searches(spark))
    return hits.groupBy("query_id").agg(F.count_distinct("book_id", "path").alias("pages"), F.count("*").alias("field_hits"))


query("w1_rank_and_score", "SELECT query_id, book_id, path, rank, score FROM ranked", "ranked")(top)


@query("w6_top_k", "SELECT query_id, book_id, path, rank FROM ranked WHERE rank <= 5", "ranked")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf).filter("rank <= 5").select("query_id", "book_id", "path", "rank")


@query("u2_first_field_wins", "SELECT query_id, book_id, path, min(CASE field WHEN 'title' THEN 0 ELSE 1 END) AS field_ord FROM field_hits GROUP BY ALL", "field_hits")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    hits = index.field_hits(opened(spark, sf), tables.searches(spark))
    return hits.groupBy("query_id", "book_id", "path").agg(F.min(search.field_order()).alias("field_ord"))
