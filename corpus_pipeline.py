"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and keeps the columns of its documents,
but for the last, which says where each row goes. The toxicity labels and the
benchmark items come from ``sf_dir``. SQL can't express the fitted, hashed or
planned stages, so ``ORACLE_SQL`` is None; tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helpbooks.llm import common, decontamination, mixing, ngram_join, resharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labelled ones, rejects."""
    return toxicity.accepted(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar texts."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 3 times)."""
    return mixing.mixed_rows(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per kept copy: its shard and its slot there, read from the shards that are written to the shared folder."""
    return resharding.reshard_documents(docs, os.path.join(common.shared_dir(spark), f"shards-{uuid.uuid4().hex}"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is a table in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    folder = os.path.join(common.shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        common.sweep(spark)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None
