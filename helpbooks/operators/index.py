"""The stored index: page texts, postings clustered by term, and their dictionary.

Postings and dictionary lie in folders by the lead of their terms and are sorted
by term in ranges, so a search that knows what its terms start with opens a few
folders and, by the files' own statistics, a few stretches of them. The dictionary says in how many pages a term is, so no search counts the
postings. Page texts are sorted by book and path within each file.

``starting_with`` and ``of_terms`` turn a small set of tokens or terms into filters
that reach the files; a larger one narrows less, and the results stay the same.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INDEX_ABOUT, INDEX_PAGES, INDEX_POSTINGS, INDEX_TERMS
from . import search, sides

#: Values that are sent to the scans as filters, and rows of matched terms that are looked at before the postings are read.
MOST_PUSHED, MOST_WANTED = 200, 50_000
#: Letters of pages whose postings one task sorts, some half a million rows; tasks of a few pages get an eighth of that at least. A task that makes postings has twice as many letters.
CHARS_A_PART = 4_000_000
#: Bits of the number of a term sketch's buckets: its estimate is off by 1.04 / sqrt(2**bits) of the true number as a standard error, 0.8 %.
SKETCH_BITS = 14


class Index(NamedTuple):
    """An opened index. ``postings`` are ``schemas.POSTINGS`` and more, ``terms`` has (term, lead, df, tf), ``about`` one row (``schemas.INDEX_ABOUT``)."""

    pages: DataFrame
    postings: DataFrame
    terms: DataFrame
    about: DataFrame


def lead(term: Column) -> Column:
    """The folder of a term: its first letter or digit, or one of sixteen for the first letters of other scripts."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike(r"\A[a-z0-9]\z"), first).otherwise(F.concat(F.lit("_"), (F.ascii(first) % 16).cast("string")))


def dictionary(postings: DataFrame) -> DataFrame:
    """(lead, term, df, tf) of stored postings; those of a term lie together, so next to nothing is shuffled."""
    return postings.groupBy("lead", "term").agg(F.count_if("first_field").alias("df"), F.sum("tf").alias("tf"))


def write(pages: DataFrame, folder: str, part: str = "") -> None:
    """Pages (``schemas.PAGES_TEXT``), decoded and stripped once, and their postings and dictionary below ``folder``."""
    spark = pages.sparkSession
    written = any_words(F.col("title")) | any_words(F.col("text"))
    stored = pages.select("book_id", "path", "title", "text", F.sha2("text", 256).alias("sha256"), ((F.length("text") > 0) & written).alias("has_words"))
    _write_pages(stored, f"{folder}/pages{part}")
    again = spark.read.schema(INDEX_PAGES).parquet(f"{folder}/pages{part}")
    parts = _parts(again)
    dealt = again.repartition(parts if parts <= spark.sparkContext.defaultParallelism else math.ceil(parts / 2), "book_id", "path")  # a task may hold what it shuffles, some 20 times its file
    write_parts(None, search.stored_postings(dealt), folder, part, parts)


def any_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _write_pages(pages: DataFrame, path: str) -> None:
    pages.sortWithinPartitions("book_id", "path").write.mode("overwrite").parquet(path)


def _parts(pages: DataFrame) -> int:
    """Tasks that sort the postings of ``pages``: as many as the texts are long, whatever the session's number of shuffle partitions; as many as there are cores where that is few."""
    chars = pages.agg(F.sum(F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    return max(1, math.ceil(chars / CHARS_A_PART), min(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * chars / CHARS_A_PART)))


def write_parts(pages: DataFrame | None, rows: DataFrame, folder: str, part: str = "", parts: int | None = None) -> None:
    """Stored postings ``rows``, their dictionary and, unless they are there already, their pages. A common term is cut by book and path. ``parts`` are the tasks that sort them, if it is known."""
    spark = rows.sparkSession
    if pages is not None:
        _write_pages(pages, f"{folder}/pages{part}")
    held = spark.read.schema(INDEX_PAGES).parquet(f"{folder}/pages{part}")
    key = ["lead", "term", "book_id", "path"]
    _write_by_lead(rows.withColumn("lead", lead(F.col("term"))).repartitionByRange(parts or _parts(held), *key).sortWithinPartitions(*key), f"{folder}/postings{part}")
    found = dictionary(spark.read.schema(INDEX_POSTINGS).parquet(f"{folder}/postings{part}"))
    _write_by_lead(found.repartitionByRange("lead", "term").sortWithinPartitions("lead", "term"), f"{folder}/terms{part}")
    n = held.agg(F.count_if("has_words").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_chars"))
    words = spark.read.schema(INDEX_TERMS).parquet(f"{folder}/terms{part}").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"), F.hll_sketch_agg("term", F.lit(SKETCH_BITS)).alias("term_sketch"))
    count = spark.read.schema(INDEX_POSTINGS).parquet(f"{folder}/postings{part}").agg(F.count("*").alias("postings"))
    n.crossJoin(words).crossJoin(count).select(*(x.split()[0] for x in INDEX_ABOUT.split(", "))).write.mode("overwrite").parquet(f"{folder}/about{part}")  # one row each


def _write_by_lead(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("lead").mode("overwrite").parquet(path)


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in (("pages", INDEX_PAGES), ("postings", INDEX_POSTINGS), ("terms", INDEX_TERMS), ("about", INDEX_ABOUT))))


def settled(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, list[dict] | None]:
    """A table of at most ``most`` (``MOST_WANTED``) rows as it is now, and these rows; a larger one stays what it is."""
    return sides.settled(rows, MOST_WANTED if most is None else most)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def starting_with(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (lead, term, ...) whose term may start with a token; of many tokens the first letters alone count."""
    for letters in (64, 3, 1):
        head = F.substring("token", 1, letters)
        heads = tokens.select(head.alias("token"), lead(head).alias("lead")).distinct().limit(MOST_PUSHED + 1).collect()
        if len(heads) <= MOST_PUSHED:
            return _with_heads(rows, heads)
    return rows


def _with_heads(rows: DataFrame, heads: list) -> DataFrame:
    return rows.filter(F.col("lead").isin(sorted({h["lead"] for h in heads})) & _any([F.startswith("term", F.lit(t)) for t in sorted({h["token"] for h in heads})]))


def of_terms(rows: DataFrame, wanted: list) -> DataFrame:
    """``rows`` (lead, term, ...) of the terms of ``wanted`` rows (lead, term, ...), or, of very many, those from the least to the greatest of each lead."""
    by_lead: dict[str, set[str]] = {}
    for w in wanted:
        by_lead.setdefault(w["lead"], set()).add(w["term"])
    if sum(map(len, by_lead.values())) <= MOST_PUSHED:
        kept = _any([F.col("term") == t for terms in by_lead.values() for t in sorted(terms)])
    else:
        kept = _any([(F.col("lead") == x) & F.col("term").between(min(terms), max(terms)) for x, terms in by_lead.items()])
    return rows.filter(F.col("lead").isin(sorted(by_lead)) & kept)


class _Asked(NamedTuple):
    """The tokens of a batch of queries, which kinds of queries there are, and the part of the dictionary that can start with a token."""

    tokens: DataFrame
    kinds: set[tuple[bool, bool]]
    terms: DataFrame


def _asked(index: Index, queries: DataFrame) -> _Asked:
    tokens, found = settled(search.query_tokens(queries).withColumn("lead", lead(F.col("token"))))
    kinds = search.KINDS if found is None else {(t["n_tokens"] == 1, t["book_id"] is not None) for t in found}
    few = found is not None and len({t["token"] for t in found}) <= MOST_PUSHED
    tokens = tokens.drop("lead")
    return _Asked(tokens, kinds, _with_heads(index.terms, found) if few else starting_with(index.terms, tokens))


def _prefixes(asked: _Asked, *columns: str) -> DataFrame:
    return search.prefix_matches(asked.terms, asked.tokens, "lead", *columns)


def _narrowed(index: Index, asked: _Asked, matches: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(what a search reads of the postings, the terms that it wants there); matches are (token, term, lead, ...)."""
    wanted, found = settled(search.wanted(asked.tokens, matches, "lead", *columns))
    return index.postings if found is None else of_terms(index.postings, found), wanted.drop("lead")


def prefix_matches(index: Index, queries: DataFrame) -> DataFrame:
    """(token, term, lead, df) from the dictionary, which is read where its terms can start with a token."""
    return _prefixes(_asked(index, queries), "df")


def field_hits(index: Index, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """``search.field_hits`` of a stored index."""
    asked = _asked(index, queries)
    return search.hits_of(*_narrowed(index, asked, _prefixes(asked)), asked.kinds, limit)


def ranked(index: Index, queries: DataFrame, limit: int = 30) -> DataFrame:
    return search.ranked(field_hits(index, queries, limit), limit)


def pages_of(index: Index, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page texts that can matter, hits): a few hits are looked up by path, more by book."""
    hits, found = settled(top)
    if found is None:
        return index.pages, top
    books, paths = sorted({h["book_id"] for h in found}), sorted({h["path"] for h in found})
    kept = F.col("book_id").isin(books) if len(paths) > MOST_PUSHED else _any([F.col("path") == p for p in paths]) & F.col("book_id").isin(books)
    return index.pages.filter(kept), hits


def find(index: Index, queries: DataFrame, limit: int = 30, radius: int = 80) -> DataFrame:
    """A batch of queries (``schemas.QUERIES``) against a stored index: ranked hits with excerpts."""
    pages, top = pages_of(index, ranked(index, queries, limit))
    return search.with_meta(top, pages, queries, radius)


def fuzzy_find(index: Index, queries: DataFrame, limit: int = 50, fuzzy: float = 0.2, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``search.fuzzy_search`` of a stored index: terms and their pages are counted in the dictionary, page lengths stand in the postings."""
    asked = _asked(index, queries)
    prefixes = _prefixes(asked, "df").withColumn("off", (F.length("term") - F.length("token")).cast("int"))
    errors = search.fuzzy_matches(index.terms, asked.tokens, fuzzy, "lead", "df").withColumnRenamed("distance", "off")
    near = prefixes.unionByName(errors).groupBy("token", "term", "lead", "df").agg(F.min("off").alias("off"))
    return search.weighted(*_narrowed(index, asked, near, "df", "off"), index.about, limit, k1, b, asked.kinds)


def statistics(index: Index) -> DataFrame:
    """One row: pages, text_chars, terms, postings; terms from the dictionary."""
    p = search.indexable(index.pages).agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("long").alias("text_chars"))
    return p.crossJoin(index.terms.agg(F.count("*").alias("terms"))).crossJoin(index.postings.agg(F.count("*").alias("postings")))  # one row each


def merged_statistics(about: DataFrame) -> DataFrame:
    """One row (pages, text_chars, terms, postings) from the ``about`` rows of any number of indexes of different pages, no postings being read: ``terms`` is an estimate from the union of their sketches."""
    union = F.hll_sketch_estimate(F.hll_union_agg("term_sketch"))
    return about.agg(F.sum("pages").alias("pages"), F.sum("text_chars").alias("text_chars"), union.alias("terms"), F.sum("postings").alias("postings"))
