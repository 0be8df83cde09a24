"""Tables of contents and keyword indexes as flat tables, and what readers derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import sides


def toc(nodes: DataFrame) -> DataFrame:
    """``schemas.TOC_NODES``: every node of a contents file, its first link or null."""
    own = nodes.filter("kind = 'hhc'")
    return own.select("book_id", F.concat(F.lit("toc-"), "ordinal").alias("node_id"), F.concat(F.lit("toc-"), "parent_ordinal").alias("parent_id"), "ordinal", "depth", "name", F.get("locals", F.lit(0)).alias("local_path"))


def is_entry(name: Column, locals_: Column) -> Column:
    """Whether an index node is an entry and not mere structure."""
    return (name != "") | (F.size(locals_) > 0)


def keyword_index(nodes: DataFrame) -> DataFrame:
    """``schemas.INDEX_ENTRIES``: structural nodes dropped, the rest renumbered, depths kept."""
    own = nodes.filter((F.col("kind") == "hhk") & is_entry(F.col("name"), F.col("locals")))
    at = F.row_number().over(Window.partitionBy("book_id").orderBy("ordinal")) - 1
    return own.withColumn("at", at.cast("long")).select("book_id", F.concat(F.lit("idx-"), "at").alias("entry_id"), F.col("at").alias("ordinal"), "name", F.col("locals").alias("local_paths"), "depth")


def first_with_suffix(entries: DataFrame, suffix: str) -> DataFrame:
    """(book_id, path, ordinal): the first listed entry with a suffix, whatever its case."""
    own = entries.filter(F.endswith(F.lower("path"), F.lit(suffix)))
    return own.groupBy("book_id").agg(F.min_by("path", "ordinal").alias("path"), F.min("ordinal").alias("ordinal"))


def tree_shape(toc_nodes: DataFrame) -> DataFrame:
    """(book_id, nodes, top_nodes, nested)."""
    out = toc_nodes.groupBy("book_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 0).alias("top_nodes"))
    return out.withColumn("nested", F.col("nodes") > F.col("top_nodes"))


def with_children_flag(toc_nodes: DataFrame) -> DataFrame:
    """Adds ``has_children``: in reading order, a node's first child comes next and one deeper."""
    following = F.lead("depth").over(Window.partitionBy("book_id").orderBy("ordinal"))
    return toc_nodes.withColumn("has_children", F.coalesce(following > F.col("depth"), F.lit(False)))


def target_badge(entries: DataFrame) -> DataFrame:
    """Adds ``badge``: the number of targets where there is more than one."""
    n = F.size("local_paths")
    return entries.withColumn("badge", F.when(n > 1, n.cast("long")))


def landing_pages(toc_nodes: DataFrame) -> DataFrame:
    """(book_id, local_path, url) of the first node, null if that one has no link."""
    first = toc_nodes.filter("depth = 0").groupBy("book_id").agg(F.min_by(F.struct("local_path"), "ordinal")["local_path"].alias("local_path"))
    return first.withColumn("url", paths.page_url(F.col("book_id"), F.col("local_path")))


def active_nodes(toc_nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(book_id, url, node_id): nodes whose page is the current one; fragments don't count, case does."""
    page = paths.strip_fragment(paths.page_url(F.col("book_id"), F.col("local_path")))
    now = current.select("book_id", "url", paths.strip_fragment(F.col("url")).alias("page"))
    return toc_nodes.withColumn("page", page).join(now, ["book_id", "page"]).select("book_id", "url", "node_id")


def filtered_index(entries: DataFrame, needle: str) -> DataFrame:
    """Entries whose name holds the needle, whatever the case; a blank needle keeps all."""
    return entries if not needle.strip() else entries.filter(F.contains(F.lower("name"), F.lit(needle.lower())))


GRAM = 3


def _grams(text: Column, least: int) -> Column:
    """The different pieces of ``GRAM`` letters of a text, and from ``least`` letters on the shorter ones as well."""

    def of(n: int) -> Column:
        size = F.length(text)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(least, GRAM + 1)))))


def substring_matches(rows: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """``rows`` with the ``needle`` s (one row each, none empty) that their text holds.

    A needle meets the texts that hold its rarest piece of ``GRAM`` letters, of which
    the number of texts is counted first; a shorter needle is its own piece. So a
    needle costs as many comparisons as its rarest piece has texts, not as its commonest.
    The pieces of the texts are never sent out: up to ``sides.MOST_SENT`` needles are, more are shuffled.
    """
    needles, found = sides.settled(needles, sides.MOST_SENT)
    sent = found is not None
    short = F.length("needle") < GRAM
    asked = needles.select("needle", F.explode(F.when(short, F.array("needle")).otherwise(_grams(F.col("needle"), GRAM))).alias("gram"))
    pieces = rows.select(F.explode(_grams(F.col(text), 1)).alias("gram"))
    counts = sides.meet(pieces, asked.select("gram").distinct(), "gram", sent).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g"))).alias("gram"))
    names = [F.col(c) for c in rows.columns]
    each = rows.select(*names, F.explode(_grams(F.col(text), 1)).alias("gram"))
    return sides.meet(each, rarest, "gram", sent).filter(F.contains(F.col(text), F.col("needle"))).select(*rows.columns, "needle")


def filtered_by_queries(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, book_id, entry_id, name) for a table of needles (query_id, q); a blank needle keeps all entries.

    Each needle is sought once, by its rarest piece, for all queries that ask for it.
    """
    kept = entries.select("book_id", "entry_id", "name", F.lower("name").alias("low"))
    asked, found = sides.settled(queries.select("query_id", F.lower("q").alias("needle")), sides.MOST_SENT)
    some = asked.filter(F.trim("needle") != "")
    hits = sides.meet(substring_matches(kept, "low", some.select("needle").distinct()), some, "needle", found is not None)
    blank = asked.filter(F.trim("needle") == "").agg(F.collect_list("query_id").alias("ids"))  # one row
    everything = kept.crossJoin(F.broadcast(blank)).withColumn("query_id", F.explode("ids"))
    columns = ["query_id", "book_id", "entry_id", "name"]
    return hits.select(columns).unionByName(everything.select(columns))


def book_documents(books: DataFrame, toc_nodes: DataFrame, index_entries: DataFrame) -> DataFrame:
    """One row a book: id, title, contents and index as sorted arrays (empty if a book has none)."""
    t = toc_nodes.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "node_id", "parent_id", "depth", "name", "local_path"))).alias("toc"))
    i = index_entries.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "entry_id", "name", "local_paths", "depth"))).alias("index"))
    out = books.withColumn("title", paths.book_title(F.col("file_path"))).join(t, "book_id", "left").join(i, "book_id", "left")
    return out.withColumns({"toc": F.coalesce("toc", F.array().cast(t.schema["toc"].dataType)), "index": F.coalesce("index", F.array().cast(i.schema["index"].dataType))})


def book_ids(opens: DataFrame) -> DataFrame:
    """(file_path, book_id): opening a path twice gives the same id, which is a hash, so that retries agree."""
    return opens.select("file_path").distinct().withColumn("book_id", F.sha2("file_path", 256))
