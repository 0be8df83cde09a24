"""Help-book tables derived from the star schema, pages and event log that jobs are run on.

Each function takes (spark, folder of parquet tables). ``CTES`` spells the same
tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

HOST = r"^https?://([^/?#]+)"
PATH = r"^https?://[^/?#]+([^?#]*)"
#: The batch of queries that search jobs run: a common word, a prefix, two words, too short, blank, unknown.
SEARCHES = [(1, "the"), (2, "tion"), (3, "le que"), (4, "a"), (5, "   "), (6, "zzqxnonexistentterm"), (7, " Der "), (8, "th an")]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (one small file, say) dealt over all of them; larger ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def page_paths(spark: SparkSession, folder: str, spread_out: bool = True) -> DataFrame:
    """(page_id, book_id, path, html): pages as files of the book that their host names."""
    raw = F.regexp_extract("url", PATH, 1)
    path = F.when((raw == "") | F.endswith(raw, F.lit("/")), F.concat(F.when(raw == "", "/").otherwise(raw), F.lit("index.html"))).when(raw.rlike(r"(?i)\.html?\z"), raw).otherwise(F.concat(raw, F.lit(".html")))
    rows = read(spark, folder, "pages").select("page_id", "url", "html")
    return (spread(rows) if spread_out else rows).select("page_id", F.regexp_extract("url", HOST, 1).alias("book_id"), path.alias("path"), F.coalesce("html", F.lit("")).alias("html"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``schemas.ENTRIES``; of pages with the same path in a book the first. Only the ids of the others meet the bytes, not those of all."""
    key, names = ["book_id", F.lower("path").alias("k")], page_paths(spark, folder, spread_out=False)
    first = names.groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = names.select("page_id", *key).join(first, ["book_id", "k"]).filter("page_id != first").select("page_id")
    kept = page_paths(spark, folder).join(later, "page_id", "left_anti")
    return kept.select("book_id", F.col("page_id").alias("ordinal"), "path", F.octet_length("html").cast("long").alias("size"), F.col("html").cast("binary").alias("content"))


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, None, q) for i, q in SEARCHES], "query_id long, book_id string, q string")


def _object(name, local=None):
    """Markup of one node; ``local`` may be a column of whole parameters."""
    param = F.concat(F.lit('<param name="Name" value="'), F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit('">'))
    return F.concat(F.lit('<li><object type="text/sitemap">'), param, F.lit("") if local is None else local, F.lit("</object>"))


def _local(path):
    return F.concat(F.lit('<param name="Local" value="'), path, F.lit('">'))


#: Keys of customers or parts that go into one contents file or index, so that files don't grow with the tables.
KEYS_A_BOOK = 1000


def _block(key: str):
    return F.floor(F.col(key) / KEYS_A_BOOK).cast("string")


def _joined(rows: list[str], marks: str = "m"):
    """The markup ``m`` of grouped rows, in the order of the other columns."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*rows, marks))), lambda x: x[marks]), "")


def _shelved_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their nation and the book they are in: one for each region and block of keys."""
    c, n, r = (read(spark, folder, t) for t in ("customer", "nation", "region"))
    named = c.join(n, c["c_nationkey"].cast("long") == n["n_nationkey"].cast("long")).join(r, n["n_regionkey"].cast("long") == r["r_regionkey"].cast("long"))
    return named.select(F.concat("r_name", F.lit("-"), _block("c_custkey")).alias("book_id"), "n_nationkey", "n_name", "c_custkey", "c_name")


def _shelved_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with the book they are in: one for each size and block of keys."""
    book = F.concat(F.lit("size"), F.col("p_size").cast("string"), F.lit("-"), _block("p_partkey"))
    return read(spark, folder, "part").select(book.alias("book_id"), "p_brand", "p_type", "p_partkey")


def contents_markup(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, kind, text): contents files: nations, below them their customers."""
    leaf = _object(F.col("c_name"), _local(F.concat(F.lit("c/"), "c_custkey", F.lit(".htm#top"))))
    kids = _shelved_customers(spark, folder).withColumn("m", leaf).groupBy("book_id", "n_nationkey", "n_name").agg(_joined(["c_custkey"]).alias("kids"))
    node = F.concat(_object(F.concat("n_name", F.lit(" & Co"))), F.lit("<UL>"), "kids", F.lit("</UL>"))
    tops = kids.withColumn("m", node).groupBy("book_id").agg(_joined(["n_nationkey"]).alias("tops"))
    head = '<object type="text/site properties"><param name="ImageType" value="Folder"></object><ul>'
    return tops.select("book_id", F.lit("hhc").alias("kind"), F.concat(F.lit(head), "tops", F.lit("</ul></ul>")).alias("text"))


def index_markup(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, kind, text): index files: an empty node, below it brands, below them types with their parts as targets."""
    link = _local(F.concat(F.lit("parts/"), "p_partkey", F.lit(".htm")))
    by_type = _shelved_parts(spark, folder).withColumn("m", link).groupBy("book_id", "p_brand", "p_type").agg(_joined(["p_partkey"]).alias("links"))
    types = by_type.withColumn("m", _object(F.col("p_type"), F.col("links"))).groupBy("book_id", "p_brand").agg(_joined(["p_type"]).alias("types"))
    brands = types.withColumn("m", F.concat(_object(F.col("p_brand")), F.lit("<ul>"), "types", F.lit("</ul>"))).groupBy("book_id").agg(_joined(["p_brand"]).alias("brands"))
    return brands.select("book_id", F.lit("hhk").alias("kind"), F.concat(F.lit('<ul><li><object type="text/sitemap"></object><ul>'), "brands", F.lit("</ul></ul>")).alias("text"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, ordinal, path, size): what contents and indexes link to; every tenth customer and part is missing, every third path is in upper case."""
    a = _shelved_customers(spark, folder).select("book_id", F.col("c_custkey").alias("ordinal"), F.concat(F.lit("/c/"), "c_custkey", F.lit(".htm")).alias("path"))
    b = _shelved_parts(spark, folder).select("book_id", F.col("p_partkey").alias("ordinal"), F.concat(F.lit("/parts/"), "p_partkey", F.lit(".htm")).alias("path"))
    both = a.unionByName(b).filter("ordinal % 10 != 0")
    return both.withColumns({"path": F.when(F.col("ordinal") % 3 == 0, F.upper("path")).otherwise(F.col("path")), "size": F.col("ordinal") + 1})


def manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three extractions (book, path, size, sha256) of the documents: the second lacks some and alters some, the third cuts, drops and garbles some."""
    d = read(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("book"), F.concat(F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), "doc_id", F.lit(".htm")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    size, sha = F.octet_length("text").cast("long"), F.sha2("text", 256)
    altered = F.sha2(F.concat("text", F.lit("!")), 256)
    a = d.filter("doc_id % 5 != 0").select("book", "path", size.alias("size"), sha.alias("sha256"))
    b = d.filter("doc_id % 7 != 0").select("book", "path", size.alias("size"), F.when(F.col("doc_id") % 11 == 0, altered).otherwise(sha).alias("sha256"))
    c = d.filter("doc_id % 17 != 0").select("book", "path", F.when(F.col("doc_id") % 13 == 0, F.greatest(size - 1, F.lit(0))).otherwise(size).alias("size"), F.when(F.col("doc_id") % 19 == 0, altered).otherwise(sha).alias("sha256"))
    return a, b, c


def _requests(events: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    kind = F.col("event_id") % 10
    path = F.when(kind == 1, "/..%2Fetc/passwd").when(kind == 2, "/%zz").when(kind == 3, "/missing/page.htm").when(kind == 4, F.upper("path")).when(kind == 5, F.concat("path", F.lit("?q=1#top"))).otherwise(F.col("path"))
    j = events.withColumn("page_id", F.col("event_id") % n_pages).join(pages.select("page_id", "book_id", "path"), "page_id")
    return j.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("chm://"), F.when(kind == 0, "no.such.book").otherwise(F.col("book_id")), path).alias("url"))


def requests(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """``schemas.REQUESTS``: each event asks for a page; one in two is wrong in some way. ``events`` may be a stream."""
    pages = page_paths(spark, folder)
    return _requests(read(spark, folder, "events") if events is None else events, pages, pages.count())


def asked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, book_id, path): the page that each event asks for."""
    pages = page_paths(spark, folder)
    rows = read(spark, folder, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % pages.count()).alias("page_id"))
    return rows.join(pages.select("page_id", "book_id", "path"), "page_id").drop("page_id")


def nav_events(events: DataFrame) -> DataFrame:
    """``schemas.NAV_EVENTS``: views, clicks and purchases navigate, signups go back, errors forward."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "back").when(kind == "error", "forward").otherwise("navigate")
    url = F.when(action == "navigate", F.concat(F.lit("chm://book/"), F.get_json_object("props", "$.k"), F.lit(".htm")))
    return events.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), url.alias("url"), (F.col("event_id") % 4 != 0).alias("is_main_frame"))


def keystrokes(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.concat("event_type", F.lit(" "))).alias("query"))


def opens(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("/books/"), F.get_json_object("props", "$.k"), F.lit(".chm")).alias("file_path"))


_SPACE = text.SPACE


def _replaced(value: str, patterns: tuple[str, ...], by: str) -> str:
    for p in patterns:
        value = f"regexp_replace({value}, '{p}', '{by}', 'g')"
    return value


_TITLE = _replaced(f"regexp_extract(html, '{text.TITLE}', 1)", ("<[^>]+>", f"^{_SPACE}+", f"{_SPACE}+\\z"), "")

#: The same tables in SQL, by name; ``with_tables`` puts those a query needs before it.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "page_paths": ((), rf"""SELECT page_id, regexp_extract(url, '{HOST}', 1) AS book_id, coalesce(html, '') AS html,
        CASE WHEN raw = '' THEN '/index.html' WHEN raw LIKE '%/' THEN raw || 'index.html' WHEN regexp_matches(raw, '(?i)\.html?\z') THEN raw ELSE raw || '.html' END AS path
        FROM (SELECT *, regexp_extract(url, '{PATH}', 1) AS raw FROM pages)"""),
    "entries": (("page_paths",), "SELECT book_id, page_id AS ordinal, path, strlen(html) AS size, html FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(path) ORDER BY page_id) AS rn FROM page_paths) WHERE rn = 1"),
    "stripped": (("entries",), rf"""SELECT book_id, ordinal, path, CASE WHEN title = '' THEN regexp_replace(list_last(string_split(path, '/')), '(?i)\.html?\z', '') ELSE title END AS title, text FROM (
        SELECT *, {_TITLE} AS title, trim({_replaced("html", text.MARKUP, " ")}) AS text
        FROM entries WHERE size > 0 AND regexp_matches(path, '(?i)\.html?\z'))"""),
    "occurrences": (("stripped",), r"""SELECT book_id, path, field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (
        SELECT book_id, path, 'title' AS field, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS w FROM stripped WHERE text <> ''
        UNION ALL SELECT book_id, path, 'text', regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM stripped WHERE text <> '')"""),
    "postings": (("occurrences",), "SELECT book_id, path, field, term, count(*) AS tf, min(pos) AS first_pos FROM occurrences GROUP BY ALL"),
    "searches": ((), "SELECT query_id::BIGINT AS query_id, q FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in SEARCHES) + ") AS t(query_id, q)"),
    "tokens": (("searches",), rf"""SELECT query_id, q, unnest(t) AS token, len(t) AS n_tokens FROM (SELECT query_id, q, list_distinct(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')) AS t FROM (
        SELECT query_id, regexp_replace(regexp_replace(q, '^{_SPACE}+', ''), '{_SPACE}+\z', '') AS q FROM searches) WHERE length(q) >= 2)"""),
    "field_hits": (("tokens", "postings"), """SELECT query_id, field, book_id, path, sum(first)::BIGINT AS first FROM (
        SELECT query_id, n_tokens, field, book_id, path, token, min(first_pos) AS first FROM postings JOIN tokens ON starts_with(term, token) GROUP BY ALL) GROUP BY query_id, n_tokens, field, book_id, path HAVING count(*) = n_tokens"""),
    "ranked": (("field_hits",), """SELECT query_id, book_id, path, rank, (count(*) OVER (PARTITION BY query_id) - rank + 1) / count(*) OVER (PARTITION BY query_id) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, first, book_id, path) AS rank FROM (
            SELECT query_id, book_id, path, min(f) AS f, arg_min(first, f) AS first FROM (
                SELECT *, CASE field WHEN 'title' THEN 0 ELSE 1 END AS f, row_number() OVER (PARTITION BY query_id, field ORDER BY first, book_id, path) AS rn FROM field_hits) WHERE rn <= 30 GROUP BY query_id, book_id, path)) WHERE rank <= 30"""),
    "toc_nodes": ((), f"""SELECT book_id, ordinal, CASE WHEN c = -1 THEN NULL ELSE max(CASE WHEN c = -1 THEN ordinal END) OVER (PARTITION BY book_id, nk) END AS parent_ordinal, CASE WHEN c = -1 THEN 0 ELSE 1 END AS depth, name, local_path FROM (
        SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY nk, c) - 1 AS ordinal FROM (
            SELECT DISTINCT r_name || '-' || c_custkey // {KEYS_A_BOOK} AS book_id, n_nationkey AS nk, -1 AS c, n_name || ' & Co' AS name, NULL AS local_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            UNION ALL SELECT r_name || '-' || c_custkey // {KEYS_A_BOOK}, n_nationkey, c_custkey, c_name, 'c/' || c_custkey || '.htm#top' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""),
    "index_entries": ((), f"""SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY b, t) - 1 AS ordinal, name, depth, locals FROM (
        SELECT 'size' || p_size || '-' || p_partkey // {KEYS_A_BOOK} AS book_id, p_brand AS b, '' AS t, p_brand AS name, 1 AS depth, NULL AS locals FROM part GROUP BY ALL
        UNION ALL SELECT 'size' || p_size || '-' || p_partkey // {KEYS_A_BOOK}, p_brand, p_type, p_type, 2, list('parts/' || p_partkey || '.htm' ORDER BY p_partkey) FROM part GROUP BY ALL)"""),
    "listing": ((), f"""SELECT book_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN upper(path) ELSE path END AS path, ordinal + 1 AS size FROM (
        SELECT r_name || '-' || c_custkey // {KEYS_A_BOOK} AS book_id, c_custkey AS ordinal, '/c/' || c_custkey || '.htm' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'size' || p_size || '-' || p_partkey // {KEYS_A_BOOK}, p_partkey, '/parts/' || p_partkey || '.htm' FROM part) WHERE ordinal % 10 <> 0"""),
    "files": ((), "SELECT doc_id, coalesce(source, 'none') AS book, '/' || coalesce(lang, 'xx') || '/' || doc_id || '.htm' AS path, coalesce(text, '') AS text FROM documents"),
    "man_a": (("files",), "SELECT book, path, strlen(text) AS size, sha256(text) AS sha256 FROM files WHERE doc_id % 5 <> 0"),
    "man_b": (("files",), "SELECT book, path, strlen(text) AS size, CASE WHEN doc_id % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM files WHERE doc_id % 7 <> 0"),
    "man_c": (("files",), "SELECT book, path, CASE WHEN doc_id % 13 = 0 THEN greatest(strlen(text) - 1, 0) ELSE strlen(text) END AS size, CASE WHEN doc_id % 19 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM files WHERE doc_id % 17 <> 0"),
    "merged": (("man_a", "man_b"), "SELECT coalesce(a.book, b.book) AS book, coalesce(a.path, b.path) AS path, coalesce(a.size, b.size) AS size, coalesce(a.sha256, b.sha256) AS sha256, CASE WHEN b.sha256 IS NULL THEN 'first' WHEN a.sha256 IS NULL THEN 'second' ELSE 'first,second' END AS tools FROM man_a a FULL JOIN man_b b ON a.book = b.book AND a.path = b.path"),
    "verdicts": (("man_a", "man_c"), "SELECT a.book, a.path, CASE WHEN c.size IS NULL THEN 'unreadable' WHEN c.size <> a.size THEN 'size' WHEN c.sha256 <> a.sha256 THEN 'hash' ELSE 'ok' END AS status FROM man_a a LEFT JOIN man_c c ON a.book = c.book AND a.path = c.path"),
    "asked": (("page_paths",), """SELECT event_id AS request_id, ts, event_id % 10 AS kind, book_id, path FROM events JOIN page_paths ON page_id = event_id % (SELECT count(*) FROM pages)"""),
    "resolved": (("asked", "entries"), """SELECT request_id, ts, status, CASE WHEN status = 200 THEN 'text/html; charset=windows-1252' END AS content_type FROM (
        SELECT *, CASE kind WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 400 WHEN 3 THEN 404 ELSE 200 END AS status FROM asked)"""),
    "nav": ((), """SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'back' WHEN 'error' THEN 'forward' ELSE 'navigate' END AS action,
        CASE WHEN event_type NOT IN ('signup', 'error') THEN 'chm://book/' || json_extract_string(props, '$.k') || '.htm' END AS url, event_id % 4 <> 0 AS is_main_frame FROM events"""),
    "keys": ((), "SELECT CAST(user_id AS VARCHAR) AS session_id, ts, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_type || ' ' END AS query FROM events"),
    "opened": ((), "SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id AS seq, '/books/' || json_extract_string(props, '$.k') || '.chm' AS file_path FROM events"),
}


def with_tables(names: tuple[str, ...] | str, query: str) -> str:
    """``query`` after the definitions of the derived tables it names and those they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, sql = CTES[name]
            for x in needs:
                add(x)
            done[name] = sql

    for x in (names,) if isinstance(names, str) else names:
        add(x)
    return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" if done else "") + query
