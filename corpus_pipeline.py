"""The corpus pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snaptide.llm import latent_decontam, line_dedup, pareto_mix, quality_rules, simhash_pivots
from snaptide.llm.common import written


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that break a quality rule go. See quality_rules.measured() for nulls and empty texts."""
    return quality_rules.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: boilerplate lines of a source are cut from the texts; a document of nothing else goes."""
    return line_dedup.stage(docs)


def copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near copies stays, the one with the least doc_id."""
    return simhash_pivots.kept(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a passage of the benchmark, or a paraphrase of one, go."""
    return latent_decontam.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: as many copies as documents, shared out over the sources; one row a copy, numbered in copy."""
    return pareto_mix.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rule_stage),
    ("line dedup", line_stage),
    ("near copies", copy_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

#: SimHash groups and latent retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
