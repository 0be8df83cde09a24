"""The event-driven jobs as Structured Streaming queries.

Events later than the watermark are dropped by Spark and counted in the query's
progress. Each function takes a streaming DataFrame and returns one, or a writer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.text import trim_space
from ..operators import requests, segments
from ..operators.clickstream import LEAST_QUERY, QUIET_MS
from ..schemas import NAV_STATES

IDLE_MS = 24 * 3600 * 1000
_STORE, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Readers(StatefulProcessor):
    """One reader's history a key: pages by their place, the place of the shown one and of the last that forward leads to.

    An event costs at most one page read and one written, however long the history.
    Events wait in a list until the watermark has passed them; a timer at the first
    of them applies what has been passed. The last timer of an idle reader clears all.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "place long, last long, applied long, timer long")
        self.pages = handle.getMapState("pages", "place long", "url string")
        self.waiting = handle.getListState("waiting", "us long, seq long, action string, url string")

    def _timed(self, at: tuple, to: int) -> tuple:
        """The state ``at`` with a timer for ``to``, unless an earlier one is set."""
        if at[3] is not None and at[3] <= to:
            return at
        self.handle.registerTimer(to)
        return (*at[:3], to)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            events = list(zip(f["us"].tolist(), f["seq"].tolist(), f["action"], f["url"], strict=True))
            if events:
                self.waiting.appendList(events)
                first = min([x[0] for x in events] + ([] if first is None else [first]))
        if first is not None:
            self.at.update(self._timed(tuple(self.at.get()) if self.at.exists() else (-1, -1, None, None), first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        place, last, applied, _ = tuple(self.at.get()) if self.at.exists() else (-1, -1, None, None)
        events = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[:2]) if self.waiting.exists() else []
        n = sum(us // 1000 < passed for us, *_ in events)
        place, last, states = self._applied(events[:n], place, last)
        if n:
            self.waiting.put(events[n:]) if events[n:] else self.waiting.clear()
            applied = events[n - 1][0] // 1000
        idle = applied is None or applied + self.idle_ms < passed
        if idle:  # what still waits comes later than that
            place = last = -1
            self.pages.clear()
        if events[n:] or not idle:
            self.at.update(self._timed((place, last, applied, None), events[n][0] // 1000 if events[n:] else applied + self.idle_ms))
        else:
            self.at.clear()
        if states:
            us, seq, action, _ = zip(*events[:n], strict=True)
            shown, back, forward = zip(*states, strict=True)
            yield pd.DataFrame({"session_id": key[0], "ts": pd.to_datetime(list(us), unit="us", utc=True), "seq": seq, "action": action, "current_url": shown, "can_back": back, "can_forward": forward})

    def _applied(self, events: list[tuple], place: int, last: int) -> tuple[int, int, list[tuple]]:
        """(place, last place, what is shown after each event), as ``clickstream.History`` has it."""
        held: dict[int, str | None] = {}
        written: set[int] = set()
        states = []

        def page(k: int) -> str | None:
            if k not in held:
                held[k] = self.pages.getValue((k,))[0]
            return held[k]

        def put(k: int, url: str) -> int:
            held[k] = url
            written.add(k)
            return k

        for _, _, action, url in events:
            if action == "open":
                place = last = put(0, url) if url else -1
            elif action == "navigate" and url is not None and (place < 0 or url != page(place)):
                place = last = put(place + 1, url)
            elif action == "back" and place > 0:
                place -= 1
            elif action == "forward" and place < last:
                place += 1
            states.append((page(place) if place >= 0 else None, place > 0, place < last))
        for k in sorted(written):
            self.pages.updateValue((k,), (held[k],))
        return place, last, states

    def close(self) -> None:
        pass


def replay(events: DataFrame, idle_ms: int = IDLE_MS, delay: str = "1 minute") -> DataFrame:
    """History after each event, kept per session; state idle for ``idle_ms`` of event time is dropped.

    Events wait until the watermark has passed them and then apply by time and
    number, in whatever micro-batches they came; those still above the watermark
    when the stream ends are not reported. Equal ones apply as often as they come.
    State lies in RocksDB, which this sets for the session's streams from here on.
    """
    if events.sparkSession.conf.get(_STORE) != _ROCKSDB:
        events.sparkSession.conf.set(_STORE, _ROCKSDB)
    picked = events.withWatermark("ts", delay).select("session_id", "ts", F.unix_micros("ts").alias("us"), "seq", "action", "url")
    return picked.groupBy("session_id").transformWithStateInPandas(Readers(idle_ms), NAV_STATES, "append", "EventTime")


def debounced(keystrokes: DataFrame, delay: str = "1 minute", quiet_ms: int = QUIET_MS) -> DataFrame:
    """(session_id, ts, query): the last query of each burst of keystrokes, once it is quiet.

    A session window joins events exactly the gap apart, which agrees with the
    batch job's strict comparison.
    """
    timed = keystrokes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    burst = timed.groupBy("session_id", F.session_window("ts", f"{quiet_ms} milliseconds").alias("w"))
    last = burst.agg(F.max(F.struct("ts", "query")).alias("last")).select("session_id", "last.ts", "last.query")
    return last.filter(F.length(trim_space(F.col("query"))) >= LEAST_QUERY)


def resolved(stream: DataFrame, books: DataFrame, entries: DataFrame) -> DataFrame:
    """Each request with its status; books and entries are static tables."""
    return requests.resolved(stream, books, entries)


def status_counts(resolved_stream: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """(window_start, status, requests) by event time."""
    timed = resolved_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), "status", "requests")


def index_pages(pages: DataFrame, folder: str, checkpoint: str):
    """A streaming query that applies changes of pages (``schemas.PAGES_TEXT``, and ``gone`` for removals) to the index of ``segments`` below ``folder``, a micro-batch at a time."""
    segments.start(pages.sparkSession, folder)
    return pages.writeStream.foreachBatch(lambda batch, batch_id: segments.change(batch, folder, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current_postings(spark: SparkSession, folder: str) -> DataFrame:
    """``schemas.POSTINGS`` of an index that ``index_pages`` keeps."""
    return segments.postings(spark, folder)
