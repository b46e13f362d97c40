"""Queries: incremental and streaming jobs, plug-in extraction."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..session import work_path
from ..streaming import jobs as S
from .q_scoring import S0, outcomes, scored
from .registry import query
from .sql import CTES, sql


@query("cache_split", """SELECT document_id, CASE WHEN n%3 = 0 THEN 'hit' ELSE 'miss' END AS outcome FROM (SELECT 'd' || doc_id AS document_id, min(doc_id%3) OVER (PARTITION BY text) AS n FROM documents)""")
def _(v):
    work = v.docs.select("document_id", "sha256", F.lit("pv1").alias("processor_version_id"))
    cache = v.docs.where("n % 3 = 0").select(S.cache_key(F.col("sha256"), F.lit("pv1")).alias("cache_key"), F.col("document_id").alias("source_id"), F.col("n").alias("created_at"))
    hits, misses = S.cache_split(work, cache)
    return hits.select("document_id", F.lit("hit").alias("outcome")).unionByName(misses.select("document_id", F.lit("miss").alias("outcome")))


@query("resume_remaining", sql("SELECT run_id, document_id FROM outcomes WHERE hash_group = 0", "outcomes").replace("WHERE hash_group = 0", "WHERE CAST(substr(document_id, 2) AS BIGINT)%4 = 1"))
def _(v):
    o = outcomes(v)
    waiting = F.substring("document_id", 2, 20).cast("long") % 4 == 1
    return S.resume_remaining(o.select("run_id", "document_id"), o.withColumn("status", F.when(waiting, "running").otherwise(F.col("status"))))


@query("change_revision", "SELECT event_type AS workspace_id, count(*) AS revision FROM events GROUP BY 1")
def _(v):
    return S.change_revision(v.table("events").withColumnRenamed("event_type", "workspace_id"))


@query("run_progress", "SELECT 'u' || user_id%20 AS run_id, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def _(v):
    """The events table as a stream of outcomes, counted in complete mode into a table."""
    spark, path = v.spark, f"{v.sf_dir}/events.parquet"
    stream = spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    o = stream.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    out = work_path(spark, "progress")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)
    q = (S.run_progress(o).writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", work_path(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_ingest_dedup", "SELECT sha256(user_id || ',' || event_type) AS sha256, epoch_us(min(ts)::TIMESTAMP) AS created_us FROM events GROUP BY 1")
def _(v):
    spark = v.spark
    stream = spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    arrivals = stream.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("document_id"), F.col("ts").cast("timestamp").alias("created_at"),
                             F.sha2(F.concat_ws(",", "user_id", "event_type"), 256).alias("sha256"))
    table = work_path(spark, "arrivals")
    S.stream_ingest_dedup(arrivals, table, work_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(table).select("sha256", F.unix_micros("created_at").alias("created_us"))


@query("incremental_scoring", sql(f"SELECT run_id, document_id, field_path, status, CASE WHEN status = 'correct' THEN 1 ELSE 0 END AS score FROM {S0}", S0))
def _(v):
    spark = v.spark
    landing, table = work_path(spark, "landing"), work_path(spark, "scored")
    # a document's fields land in two batches of as many files as Spark writes, and a row that it was processed with the first
    pred = v.pred(0)
    done = v.extractions(0).select("run_id", "document_id", *[F.lit(None).cast(t).alias(c) for c, t in pred.dtypes if c not in ("run_id", "document_id")]).select(*pred.columns)
    odd = F.crc32(F.col("field_path").cast("binary")) % 2 == 1
    checkpoint = work_path(spark, "ckpt")
    for batch in (pred.where(~odd).unionByName(done), pred.where(odd)):
        batch.write.mode("append").parquet(landing)
        S.incremental_scoring(spark.readStream.schema(pred.schema).parquet(landing), v.truth, v.leaves, table, checkpoint).awaitTermination()
    return S.current_scores(spark.read.parquet(table)).select("run_id", "document_id", "field_path", "status", "score")


def _word_counter(batches):
    """A small sample extractor: the number of words and the first word of each document."""
    import pandas as pd
    for b in batches:
        words = [None if t is None else str(len(t.split())) for t in b["text"]]
        count = pd.DataFrame({"document_id": b["document_id"], "field_path": "words", "value_json": words})
        yield count.assign(confidence=1.0, errors=[[] for _ in range(len(count))])


@query("extractor_plugin", r"SELECT 'd' || doc_id AS document_id, 'words' AS field_path, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS VARCHAR) AS value_json FROM documents")
def _(v):
    X.register_extractor("word_counter", _word_counter)
    return X.run_extractor(v.docs.select("document_id", "text"), "word_counter").select("document_id", "field_path", "value_json")
