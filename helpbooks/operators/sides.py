"""Joins of many rows with a table that is mostly small.

Spark takes a table whose arrays are exploded for hardly larger than its file, so left
alone it may send all of its rows to the driver and to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the small side that are sent out.
MOST_SENT = 10_000


def settled(rows: DataFrame, most: int) -> tuple[DataFrame, list[dict] | None]:
    """A table of at most ``most`` rows as it is now, and these rows; a larger one stays what it is."""
    found = rows.limit(most + 1).toArrow()
    if found.num_rows > most:
        return rows, None
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)), found.to_pylist()


def meet(many: DataFrame, few: DataFrame, on: str | list[str], sent: bool) -> DataFrame:
    """``many`` joined with ``few``, which is sent out if ``sent``, else both are shuffled; ``many`` is never sent out."""
    return many.join(F.broadcast(few), on) if sent else many.hint("merge").join(few, on)
