"""Incremental and streaming jobs: arrivals, caching, resume, progress, exactly-once scoring."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import latest
from ..operators.scoring import score_fields
from ..schema import ScoringConfig

# Fixed values of the cache contract.
CONTRACT = {"cache_schema": "4", "response_contract": "field-confidence-evidence-v2"}


def cache_key(document_sha256, version_id):
    """Content-and-version key of an extraction; the contract constants retire stale entries."""
    parts = F.struct(F.lit(int(CONTRACT["cache_schema"])).alias("cache_schema"), document_sha256.alias("document_sha256"),
                     version_id.alias("processor_version_id"), F.lit(CONTRACT["response_contract"]).alias("response_contract"))
    return F.sha2(F.to_json(parts), 256)


def cache_split(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (document_id, sha256, processor_version_id) rows against the cache's newest entries."""
    keyed = work.withColumn("cache_key", cache_key(F.col("sha256"), F.col("processor_version_id")))
    newest = latest(cache, ["cache_key"], F.col("created_at"))
    return keyed.join(newest, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_counters(hits: DataFrame) -> DataFrame:
    """Hits per cache entry."""
    return hits.groupBy("cache_key").agg(F.count(F.lit(1)).alias("hits"))


def resume_remaining(snapshot: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Snapshot documents without a final outcome in their run."""
    done = outcomes.where(F.col("status").isin("completed", "failed")).select("run_id", "document_id")
    return snapshot.join(done, ["run_id", "document_id"], "left_anti")


def run_progress(outcomes: DataFrame) -> DataFrame:
    """Completed and failed documents per run; works on a batch and, in update mode, on a stream."""
    return outcomes.groupBy("run_id").agg(F.count_if(F.col("status") == "completed").alias("completed"),
                                          F.count_if(F.col("status") == "failed").alias("failed"))


def change_revision(changes: DataFrame) -> DataFrame:
    """Monotone revision per workspace: the number of committed changes."""
    return changes.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("revision"))


def _put(df: DataFrame, table: str, batch_id: int) -> None:
    """Write a batch's rows to its own partition, so that a retried batch replaces itself; Spark sizes the files."""
    (df.withColumn("batch", F.lit(batch_id)).hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(table))


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """The earliest row of each ``sha256`` (ties: the smallest row), with ``_first`` and ``_last``, the times of the batches that it arrived in.

    On a stream the state is one row for each hash, kept in Spark's state store for all time: a batch costs what it brings, whatever has been
    ingested before. Repeats of one hash are combined before they are moved. The time of a batch stands in the stream's log, so a retried batch has the same one.
    """
    rows = F.struct(*[F.col(c) for c in arrivals.columns])
    now = F.unix_micros(F.current_timestamp())
    kept = arrivals.withColumn("_now", now).groupBy("sha256").agg(F.min_by(rows, F.struct("created_at", F.to_json(rows))).alias("_row"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    return kept.select("_row.*", "_first", "_last")


def stream_ingest_dedup(arrivals: DataFrame, table: str, checkpoint: str):
    """Append arriving documents whose content hash is new, for all time; late arrivals are arrivals like any other.

    A hash is new in the batch in which its first and last arrival fall together. Each batch adds as many files as its new rows fill.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _put(batch.where("_first = _last").drop("_first", "_last"), table, batch_id)
    return first_arrivals(arrivals).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_fields(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, fields) of a batch of predictions: the runs' documents that it names, and of each field its largest row.

    Fields are dealt out as the join with the truth wants them and sorted once for both.
    """
    key = ["document_id", "field_path", "run_id"]
    dealt = batch.where("field_path IS NOT NULL").repartition(*key)
    whole = dealt.groupBy(*key).agg(F.max(F.struct(*[c for c in batch.columns if c not in key])).alias("_r")).select(*key, "_r.*")
    return batch.select("document_id", "run_id").distinct(), whole.select(*batch.columns)


def incremental_scoring(predictions: DataFrame, truth: DataFrame, leaves: DataFrame, table: str, checkpoint: str,
                        config: ScoringConfig = ScoringConfig()):
    """Score landing predictions, each field in the batch in which it lands.

    A batch reads and scores what it brings and no earlier rows. Of the documents that it names it also writes the fields that it does not bring, as
    fields without a prediction (``landed`` is false): these count as long as no batch brings them. A field that lands again replaces the earlier one.
    A row with a null ``field_path`` says that a document was processed; with it, a document without any prediction is scored too.
    ``current_scores`` reads each field's last scoring.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        documents, fields = landed_fields(batch)
        scored = score_fields(truth, fields.withColumn("_landed", F.lit(True)), leaves, config, documents)
        _put(scored.withColumnRenamed("_landed", "landed"), table, batch_id)
    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(scored: DataFrame) -> DataFrame:
    """Each field's last landing, or else its last row without one."""
    last = Window.partitionBy("document_id", "field_path", "run_id").orderBy(F.desc("landed"), F.desc("batch"))
    return scored.withColumn("_last", F.rank().over(last)).where("_last = 1").drop("_last", "landed", "batch")
