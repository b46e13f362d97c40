"""Dataset manifests: export, import and document matching."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..operators.catalog import latest_truth


def match_documents(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Match entries by document id, else by content hash: two equi-joins, never an OR join."""
    by_id = documents.select(F.col("document_id"), F.col("document_id").alias("_id"))
    by_hash = documents.groupBy("sha256").agg(F.min("document_id").alias("_hash"))
    return (entries.join(by_id, "document_id", "left").join(by_hash, "sha256", "left")
            .withColumn("matched_id", F.coalesce("_id", "_hash")).drop("_id", "_hash"))


def manifest_rows(members: DataFrame, documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Manifest entries: membership, document and its latest truth (null without one)."""
    now = latest_truth(truth).select("document_id", F.struct("revision", "value_json", "annotation_status").alias("ground_truth"))
    return (members.select("dataset_id", "document_id", F.coalesce("split", F.lit("unspecified")).alias("split"), "tags")
            .join(documents.select("document_id", "filename", "sha256", "mime_type"), "document_id").join(now, "document_id", "left"))


def manifest_export(members: DataFrame, documents: DataFrame, truth: DataFrame, path: str) -> None:
    """Write one JSON line per entry, partitioned by dataset."""
    manifest_rows(members, documents, truth).write.mode("overwrite").partitionBy("dataset_id").json(path)


MANIFEST = ("dataset_id string, document_id string, filename string, sha256 string, mime_type string, split string, tags array<string>, "
            "ground_truth struct<revision:int,value_json:string,annotation_status:string>")


def manifest_import(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Matched memberships with cleaned tags; entries matching no document carry an error."""
    m = match_documents(entries, documents)
    reason = F.when(F.col("matched_id").isNull(), "document_id or sha256 does not match a document")
    return m.select(F.col("matched_id").alias("document_id"), "filename", F.coalesce("split", F.lit("unspecified")).alias("split"),
                    T.clean_tags_cli(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), "ground_truth", reason.alias("error"))
