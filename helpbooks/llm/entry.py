"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.find(common.read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = common.read(spark, sf_dir, "documents")
    grader = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.grade(docs.select("doc_id", "text"), grader).select("row.doc_id", "grade", "expected_severity", "p_toxic", "toxic")


def op3_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(common.read(spark, sf_dir, "pages"), os.path.join(common.shared_dir(spark), f"warc-{uuid.uuid4().hex}"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.classes(common.read(spark, sf_dir, "documents"))


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import context_tree

    return context_tree.scored(common.read(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.contained(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resharding

    return resharding.reshard_documents(common.read(spark, sf_dir, "documents"), os.path.join(common.shared_dir(spark), f"shards-{uuid.uuid4().hex}"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search

    return topk_search.topk(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.suffix_sums(token_counts.length_histogram(common.read(spark, sf_dir, "documents")))


def op11_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.digest(licences.find(common.read(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fill_in_middle

    return fill_in_middle.digest(fill_in_middle.transform(common.read(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic_runs

    return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(common.read(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_toxicity, op3_warc_conversion, op4_ngram_jaccard_join, op5_context_tree_scores, op6_benchmark_decontamination,
        op7_resharding, op8_mixing, op9_exact_topk, op10_token_counts, op11_licence_scans, op12_fill_in_middle, op13_periodic_runs, pipeline,
    )
}
ORACLES: dict[str, str] = {}
