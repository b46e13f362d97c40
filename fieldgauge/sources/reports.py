"""Run reports and table storage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scoring import field_metrics


def report_rows(scored: DataFrame) -> DataFrame:
    """The report's columns, one row per scored field."""
    return scored.select("run_id", "document_id", "field_path", "status", F.col("expected_json").alias("expected"),
                         F.col("actual_json").alias("actual"), "confidence", "failure_type")


def run_report_csv(scored: DataFrame, path: str) -> None:
    """CSV parts per run, written where the rows are."""
    report_rows(scored).write.mode("overwrite").partitionBy("run_id").option("header", True).option("escape", '"').csv(path)


REPORT_VERSION = 1


def report_headers(scored: DataFrame, runs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(run_id, version, run, processor_version, dataset, scoring_config, metrics, field_metrics), a row for each run.

    ``runs``: run_id and, where known, status, created_at, completed_at, processor_version, dataset and scoring_config; ``metrics``: one row for each run
    (see ``run_metrics``). What is not given is null. Accuracies are rounded to four digits; a run without scored fields has no field metrics.
    """
    per_field = field_metrics(scored).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("field_path", "documents", "correct", "failures", F.round("accuracy", 4).alias("accuracy")))).alias("field_metrics"))
    given = lambda c: (F.col(c) if c in runs.columns else F.lit(None).cast("string")).alias(c)
    head = runs.select("run_id", F.lit(REPORT_VERSION).alias("version"), F.struct(F.col("run_id").alias("id"), *[given(c) for c in ("status", "created_at", "completed_at")]).alias("run"),
                       *[given(c) for c in ("processor_version", "dataset", "scoring_config")])
    if metrics is not None:
        head = head.join(metrics.select("run_id", F.struct(*[c for c in metrics.columns if c != "run_id"]).alias("metrics")), "run_id", "left")
    return head.join(per_field, "run_id", "left")


def run_report(scored: DataFrame, runs: DataFrame, path: str, metrics: DataFrame | None = None) -> None:
    """JSON lines: run headers with run and per-field metrics under ``summary``, failed fields under ``failures``.

    ``scored`` is read twice, and once more for ``metrics`` made of it: give it as a written table (see ``session.materialized``).
    """
    report_headers(scored, runs, metrics).write.mode("overwrite").json(f"{path}/summary")
    report_rows(scored).where("status <> 'correct'").write.mode("overwrite").partitionBy("run_id").json(f"{path}/failures")


# Catalog tables and the columns they are partitioned by.
TABLES = {
    "documents": [], "datasets": [], "dataset_documents": ["dataset_id"], "ground_truth": [], "processors": [], "processor_versions": [],
    "processor_drafts": [], "eval_groups": [], "eval_experiments": [], "runs": [], "run_documents": ["run_id"], "run_steps": ["run_id"],
    "extractions": ["run_id"], "extraction_fields": ["run_id"], "evaluations": ["run_id"], "evaluation_fields": ["run_id"],
    "review_assignments": ["dataset_id"], "review_decisions": ["run_id"], "extraction_cache": [],
}


class TableStore:
    """Parquet catalog tables under one root. Appends add rows; latest-wins views pick the newest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        return f"{self.root}/{name}"

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(*TABLES[name]).parquet(self.path(name))

    def replace_partitions(self, name: str, df: DataFrame) -> None:
        """Idempotent write: only the partitions present in ``df`` are overwritten."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TABLES[name]).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
