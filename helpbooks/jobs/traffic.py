"""Queries of requests and reader behaviour, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clickstream, requests, search, segments
from ..schemas import PAGES_TEXT
from ..sources import tables
from ..streaming import streams
from .registry import query
from .scalars import scratch

#: Keystrokes of the event log are minutes apart; its debounce waits that long.
QUIET_MS = 1_200_000


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    entries = tables.entries(spark, sf).drop("content")
    return requests.resolved(tables.requests(spark, sf), entries.select("book_id"), entries)


@query("j9_resolved_requests", "SELECT request_id, status, content_type FROM resolved", "resolved")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("request_id", "status", "content_type")


@query("a7_status_counts", "SELECT status, content_type, count(*) AS requests FROM resolved GROUP BY ALL", "resolved")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return requests.status_counts(resolved(spark, sf))


@query("w4_without_echoes", "SELECT session_id, seq, url FROM (SELECT *, lag(url) OVER (PARTITION BY session_id ORDER BY ts, seq) AS before FROM nav WHERE action = 'navigate') WHERE url IS DISTINCT FROM before", "nav")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    n = tables.nav_events(tables.read(spark, sf, "events")).filter("action = 'navigate'")
    return clickstream.without_echoes(n).select("session_id", "seq", "url")


_FIRED = "(SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, query) AS nxt FROM keys)"
_GAP = f"epoch_us(nxt) - epoch_us(ts) > {QUIET_MS * 1000}"


@query("w5_debounced_queries", f"SELECT session_id, epoch_us(ts) AS at_us, query FROM {_FIRED} WHERE (nxt IS NULL OR {_GAP}) AND length(trim(query)) >= 2", "keys")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    fired = clickstream.fired_queries(tables.keystrokes(tables.read(spark, sf, "events")), QUIET_MS)
    return fired.select("session_id", F.unix_micros("ts").alias("at_us"), "query")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a file stream, be it one file or a folder of files."""
    path = f"{sf}/events.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if all(f.rstrip("/").endswith("/events.parquet") for f in now.inputFiles()):
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return reader.parquet(path)


def run_stream(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What an append stream writes until its input is used up."""
    folder = scratch(spark, name)
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


# One event of every session a step, with the lists as they are after it.
_HISTORY = """SELECT session_id, epoch_us(ts) AS at_us, seq, action, cur AS current_url, len(past) > 0 AS can_back, len(future) > 0 AS can_forward FROM (
 WITH RECURSIVE e AS (SELECT session_id, ts, seq, action, url, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM nav),
 h AS (SELECT session_id, ts, seq, action, n, []::VARCHAR[] AS past, CASE WHEN action = 'navigate' THEN url END AS cur, []::VARCHAR[] AS future FROM e WHERE n = 1
  UNION ALL SELECT e.session_id, e.ts, e.seq, e.action, e.n,
   CASE WHEN moved AND cur IS NOT NULL OR ahead THEN list_append(past, cur) WHEN back THEN past[:len(past) - 1] ELSE past END,
   CASE WHEN moved THEN url WHEN back THEN past[len(past)] WHEN ahead THEN future[len(future)] ELSE cur END,
   CASE WHEN moved THEN [] WHEN back THEN list_append(future, cur) WHEN ahead THEN future[:len(future) - 1] ELSE future END
  FROM h JOIN e ON e.session_id = h.session_id AND e.n = h.n + 1,
  LATERAL (SELECT e.action = 'navigate' AND url IS NOT NULL AND url IS DISTINCT FROM cur AS moved, e.action = 'back' AND len(past) > 0 AS back, e.action = 'forward' AND len(future) > 0 AS ahead))
 SELECT * FROM h)"""


def _with_micros(states: DataFrame) -> DataFrame:
    return states.select("session_id", F.unix_micros("ts").alias("at_us"), "seq", "action", "current_url", "can_back", "can_forward")


@query("k1_history_replay", _HISTORY, "nav")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return _with_micros(clickstream.replayed(tables.nav_events(tables.read(spark, sf, "events"))))


@query("k1_history_stream", f"{_HISTORY} WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM nav) - 60000", "nav")
def k1b(spark: SparkSession, sf: str) -> DataFrame:
    """Events that the watermark has passed at the end of the log."""
    return _with_micros(run_stream(streams.replay(tables.nav_events(_event_stream(spark, sf))), spark, "history"))


@query("k2_debounce_stream", f"SELECT session_id, epoch_us(ts) AS at_us, query FROM {_FIRED} WHERE (nxt IS NULL OR {_GAP}) AND length(trim(query)) >= 2 AND epoch_us(ts) + {QUIET_MS * 1000} <= (SELECT max(epoch_us(ts)) FROM keys) - 60000000", "keys")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts that are over; those still open at the end of the log are not emitted."""
    out = run_stream(streams.debounced(tables.keystrokes(_event_stream(spark, sf)), quiet_ms=QUIET_MS), spark, "debounce")
    return out.select("session_id", F.unix_micros("ts").alias("at_us"), "query")


@query("k3_request_stream", "SELECT epoch_us(date_trunc('minute', ts)) AS window_us, status, count(*) AS requests FROM resolved WHERE epoch_us(date_trunc('minute', ts)) + 60000000 <= (SELECT max(epoch_us(ts)) FROM asked) - 60000000 GROUP BY ALL", "resolved")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    entries = tables.entries(spark, sf).drop("content")
    asked = tables.requests(spark, sf, _event_stream(spark, sf))
    counted = streams.status_counts(streams.resolved(asked, entries.select("book_id"), entries))
    return run_stream(counted, spark, "requests").select(F.unix_micros("window_start").alias("window_us"), "status", "requests")


@query("k4_index_stream", "SELECT * FROM postings", "postings")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    """Pages arriving as files, indexed batch by batch."""
    folder = scratch(spark, "indexed")
    pages = search.page_texts(tables.entries(spark, sf), "UTF-8").drop("error")
    pages.write.parquet(f"{folder}/pages")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/pages")
    streams.index_pages(arriving, folder, f"{folder}/state").start().awaitTermination()
    return streams.current_postings(spark, folder)


_LEFT = "book_id <> (SELECT min(book_id) FROM entries) AND (book_id, path) NOT IN (SELECT (book_id, path) FROM entries WHERE ordinal % 7 = 0)"


def _changed(spark: SparkSession, sf: str) -> str:
    """A folder with an index of several batches: pages of which some are early drafts, the same pages as they are now, twice, then some removed and a book closed."""
    folder = scratch(spark, "segments")
    e = tables.entries(spark, sf)
    search.page_texts(e, "UTF-8").drop("error").join(e.select("book_id", "path", "ordinal"), ["book_id", "path"]).write.parquet(f"{folder}/all")
    p = spark.read.schema(f"{PAGES_TEXT}, ordinal long").parquet(f"{folder}/all")
    draft = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("early words of "), "text")).otherwise(F.col("text"))
    gone = p.filter("ordinal % 7 = 0").select("book_id", "path").unionByName(p.agg(F.min("book_id").alias("book_id")).withColumn("path", F.lit(None).cast("string")))
    removals = gone.select("book_id", "path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("gone"))
    segments.start(spark, folder)
    for batch, changes in enumerate([p.withColumn("text", draft), p, p.filter("ordinal % 2 = 0"), removals]):
        segments.change(changes, folder, batch)
    return folder


@query("k4_changed_index", f"SELECT * FROM postings WHERE {_LEFT}", ("postings", "entries"))
def k4_changed(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after changes, removals and merging is what an index of these pages alone holds."""
    return segments.postings(spark, _changed(spark, sf))


@query("k4_changed_dictionary", f"SELECT term, count(DISTINCT (book_id, path)) AS df, sum(tf)::BIGINT AS tf FROM postings WHERE {_LEFT} GROUP BY term", ("postings", "entries"))
def k4_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of the same index, kept by adding and taking away."""
    return segments.open_index(spark, _changed(spark, sf)).terms.select("term", "df", "tf")
