"""A training corpus from ``documents`` in five stages; each stage's rows are written and read again as the next one's docs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.llm import decontaminate, mixing, near_dedup, quality, sharding
from fieldgauge.llm.store import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest accept."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    return near_dedup.dedup(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents as often as their source's target has room for."""
    return mixing.mix_documents(docs, whole_texts=True)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it."""
    return sharding.shard_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup_stage), ("decontamination", decontamination),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]

# The verdicts of the forest are learned, so SQL can't give these rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
