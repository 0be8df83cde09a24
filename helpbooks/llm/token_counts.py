"""Exact length histogram of documents in tokens, and what follows from it.

``length_histogram`` counts documents by encoded length with a fixed public
byte-pair vocabulary; each task sends one row per distinct length. ``suffix_sums``
adds, for every length L of the histogram, what a context limit of L would keep.
A null text is empty and has 0 tokens; an empty table gives an empty result;
repeated rows count each; other columns are never read. Very long texts are
encoded whole, one at a time; long runs of white space, which the splitting
pattern alone can't walk through, are cut out first where it would cut them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits text before merging (published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it, in runs that are cut out before splitting.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")


def n_tokens(coder, text: str) -> int:
    """Tokens of a text. Of a run of white space before other letters the pattern leaves the last one to what follows."""
    n, at = 0, 0
    for m in LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(coder.encode_ordinary(text[at:]))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens long, n_docs long), a row per length that occurs. The vocabulary file is read once, on the driver."""
    spark = docs.sparkSession
    common.small_batches(spark)
    with open(vocabulary, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        coder = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        total: dict[int, int] = {}
        for batch in batches:
            for text in common.strings(batch.column(0)):
                n = n_tokens(coder, text)
                total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["n_tokens", "n_docs"])

    parts = docs.select(common.text_bytes(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L: documents and tokens of at least L, tokens if texts are cut at L, and the share of documents of at most L.

    Sums run over blocks of lengths first (one row per ``block`` lengths, so the
    table that is broadcast has at most the longest length / ``block`` rows) and
    then inside each block, so no task holds the whole histogram.
    """
    h = common.cut(histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(F.broadcast(blocks), "block").withColumns({"docs_at_least": F.col("docs_above") + F.sum("n_docs").over(own), "tokens_at_least": F.col("tokens_above") + F.sum("tokens").over(own)})
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) for any limits, from the suffix sums alone."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = sums.crossJoin(F.broadcast(asked))  # a stated list of limits against the histogram
    kept = F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("tokens")).otherwise(F.col("context_limit") * F.col("n_docs"))
    cut = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    return over.groupBy("context_limit").agg(F.sum(kept).alias("truncated_total"), F.sum(cut).alias("docs_cut"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.crossJoin(F.broadcast(asked)).filter(F.col("docs_share") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def brute(lengths: list[int]) -> dict[int, tuple]:
    """The same figures by plain Python, for tests."""
    a = np.array(lengths, dtype=np.int64)
    return {int(x): (int((a == x).sum()), int((a >= x).sum()), int(a[a >= x].sum()), int(np.minimum(a, x).sum())) for x in set(lengths)}
