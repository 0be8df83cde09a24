"""Reader behaviour from event logs: history, debounced queries, recent files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import SCHEME
from ..functions.text import trim_space
from ..schemas import NAV_STATES

QUIET_MS = 250
LEAST_QUERY = 2
RECENT = 10


def is_book_navigation(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit(SCHEME)), F.lit(False))


def recorded(navigations: DataFrame) -> DataFrame:
    """Navigations that go into a history: book pages, in the main frame."""
    return navigations.filter(is_book_navigation(F.col("url")) & F.coalesce("is_main_frame", F.lit(False)))


def without_echoes(navigations: DataFrame) -> DataFrame:
    """Plain navigations (session_id, ts, seq, url) without those to the page that is already shown."""
    before = F.lag("url").over(Window.partitionBy("session_id").orderBy("ts", "seq"))
    return navigations.withColumn("before", before).filter(~F.col("url").eqNullSafe(F.col("before"))).drop("before")


def fired_queries(keystrokes: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Keystrokes (session_id, ts, query, ...) that stand for more than ``quiet_ms`` and are long enough.

    A query that is too short still cancels the one before it, so the gate comes last.
    """
    following = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "query"))
    gap_us = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    quiet = keystrokes.withColumn("gap_us", gap_us).filter(F.col("gap_us").isNull() | (F.col("gap_us") > quiet_ms * 1000)).drop("gap_us")
    return quiet.filter(F.length(trim_space(F.col("query"))) >= LEAST_QUERY)


def recent_files(opens: DataFrame, n: int = RECENT) -> DataFrame:
    """(user_id, file_path, rank): each user's latest files; opening one again moves it to the front.

    Opens are reduced to one row a user and file first, so busy users cost little.
    """
    last = opens.groupBy("user_id", "file_path").agg(F.max(F.struct("ts", "seq")).alias("last"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last"), "file_path")
    return last.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).select("user_id", "file_path", "rank")


class History:
    """One reader's back and forward lists."""

    def __init__(self, past: Iterable[str] = (), current: str | None = None, future: Iterable[str] = ()):
        self.past, self.current, self.future = list(past), current, list(future)

    def apply(self, action: str, url: str | None) -> tuple[str | None, bool, bool]:
        """The page shown after an event, and whether back and forward lead anywhere.

        ``open`` starts a history anew, at the landing page if it has one.
        """
        if action == "open":
            self.past, self.current, self.future = [], url or None, []
        elif action == "navigate" and url is not None and url != self.current:
            if self.current is not None:
                self.past.append(self.current)
            self.current, self.future = url, []
        elif action == "back" and self.past:
            self.future.append(self.current)
            self.current = self.past.pop()
        elif action == "forward" and self.future:
            self.past.append(self.current)
            self.current = self.future.pop()
        return self.current, bool(self.past), bool(self.future)


def replayed(events: DataFrame) -> DataFrame:
    """``schemas.NAV_STATES``: the state after each event of (session_id, ts, seq, action, url).

    Rows are dealt by session and sorted there; a task then runs through them
    one after another, holding one reader's history at a time and never a whole
    session's events.
    """
    dealt = events.select("session_id", "ts", "seq", "action", "url").repartition("session_id").sortWithinPartitions("session_id", "ts", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, history = None, History()
        for f in frames:
            states = []
            for s, action, url in zip(f["session_id"], f["action"], f["url"], strict=True):
                if s != session:
                    session, history = s, History()
                states.append(history.apply(action, url))
            out = f.drop(columns=["url"])
            out["current_url"], out["can_back"], out["can_forward"] = zip(*states, strict=True) if states else ((), (), ())
            yield out

    return dealt.mapInPandas(run, NAV_STATES)
