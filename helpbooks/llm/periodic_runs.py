"""Periodic runs of words in whole texts, and texts without the repeats.

A run is a stretch of words with least period q, at least 2q and ``least`` words
long, that no neighbouring word extends. Runs come from partition refinement
(``refinement``) over the words of some texts at a time; a text is never cut.
Words are the runs of other bytes than space, tab, LF, VT, FF and CR, compared as
they are. Time is n log n in the words of a text, memory some ten numbers a word.

A null text is empty; a text without words has no runs and collapses to an empty
one. Equal rows give equal results, an empty table gives no rows, and only
the two columns named are read, whatever others are called. A null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .refinement import runs

LEAST = 12
#: Words of texts that are refined together (a single text may have more).
WORDS_AT_ONCE = 400_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not found:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _together(texts: list[bytes], most: int) -> Iterator[list[list[bytes]]]:
    """The words of texts, in lists of texts of some ``most`` words."""
    group, n = [], 0
    for text in texts:
        words = text.split()
        if group and n + len(words) > most:
            yield group
            group, n = [], 0
        group.append(words)
        n += len(words)
    if group:
        yield group


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """A row per document; columns as in ``SCHEMA``, runs by start, then period. No shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ", 2)[:2]] + ["runs", "collapsed"]
        for batch in batches:
            at = 0
            for group in _together(batch.column(1).to_pylist(), words_at_once):
                found = runs([numbered(w) for w in group], least)
                out = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([len(w) for w in group], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found], _RUNS),
                    pa.array([without_repeats(w, x).decode("utf-8", "replace") for w, x in zip(group, found, strict=True)], pa.string()),
                ]
                at += len(group)
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a repeat planted in a tenth of the documents: the test rows of the registered query.

    With h the CRC-32 of the decimal id (null: of nothing) and g its tenth, rounded
    down, a text of n > 0 words and h % 10 = 0 repeats the p words from word a on up
    to its end, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    chosen = h % 10 == 0
    words = F.when(chosen, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\t-\\r ]+"), ""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"), words.alias("w"))
    sized = rows.withColumn("n", F.size("w"))
    cut = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return period.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """A row per document of ``find``: the longest run (of equal ones the first, then that of the shortest period) and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

