"""Inputs that must not be lost: late arrivals, silent documents, deep values, unexpected branches, split documents."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldgauge import EvalFrame, ScoringConfig, schema_leaves
from fieldgauge.functions import jsonvals as J
from fieldgauge.operators import consensus, reshape, scoring
from fieldgauge.streaming import jobs

SCHEMA = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string"}}}
TRUTH = "document_id string, field_path string, value_json string, annotation_status string"
PRED = "run_id string, document_id string, field_path string, value_json string"


@pytest.fixture
def leaves(spark):
    return schema_leaves(spark, SCHEMA)


def test_late_arrivals_stay(spark, tmp_path):
    rows = [("d2", 2), ("d3", 3), ("d1", 1), ("d4", 4), ("d5", 5)]
    for n, (doc, day) in enumerate(rows):
        h = F.sha2(F.lit("same" if doc in ("d2", "d5") else doc), 256)
        spark.createDataFrame([(doc, dt.datetime(2024, 1, day))], "document_id string, created_at timestamp").withColumn("sha256", h).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_ingest_dedup(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    kept = {r["document_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {"d1", "d3", "d4"} < kept and len(kept & {"d2", "d5"}) == 1


def test_documents_without_predictions_count(spark, leaves):
    truth = spark.createDataFrame([("x", "a", '"1"', "complete"), ("y", "a", '"2"', "complete")], TRUTH)
    pred = spark.createDataFrame([("r", "x", "a", '"1"')], PRED)
    for extractions in (None, spark.createDataFrame([("r", "x"), ("r", "y")], "run_id string, document_id string")):
        m = EvalFrame(pred, truth, leaves).score(extractions=extractions).metrics().first()
        assert m["scored_documents"] == 2 and m["field_accuracy"] == 0.5 and m["missing_fields"] == 1


def test_depth(spark):
    deep = spark.createDataFrame([(1, '{"z": {"y": [{"x": {"w": {"v": [{"u": ""}, {"t": "found \\"it"}]}}}]}, "a": "no"}'), (2, '"plain"'), (3, '{"a": null}'), (4, "{\"k:1\": 7}")], "k int, v string")
    assert [r[0] for r in deep.orderBy("k").select(J.value_needle(F.col("v"))).collect()] == ['found "it', "plain", None, "7"]
    fields = spark.createDataFrame([("d", "p.q.r.s.t", "2"), ("d", "p.q.a", "1"), ("d", "p.b", "0"), ("d", "z", '"x"')], "document_id string, field_path string, value_json string")
    rows = reshape.unflatten_values(fields, ["document_id"]).collect()
    assert [r["value_json"] for r in rows] == ['{"p":{"b":0,"q":{"a":1,"r":{"s":{"t":2}}}},"z":"x"}']
    flat = reshape.flatten_values(spark.createDataFrame(rows), ["document_id"], "value_json", 5)
    assert {(r["field_path"], r["value_json"]) for r in flat.collect()} == {(r["field_path"], r["value_json"]) for r in fields.collect()}
    with pytest.raises(Exception, match="a value and a parent"):
        reshape.unflatten_values(fields.union(spark.createDataFrame([("d", "p", "1")], fields.schema)), ["document_id"]).collect()
    leaf = '{"type": "string"}'
    for n in range(6):
        leaf = '{"type": "object", "properties": {"l%d": %s}}' % (n, leaf)
    schemas = spark.createDataFrame([("v", leaf)], "processor_version_id string, schema_json string")
    assert [r["field_path"] for r in reshape.schema_leaves_table(schemas).collect()] == ["l5.l4.l3.l2.l1.l0"]
    with pytest.raises(Exception, match="nested deeper"):
        reshape.schema_leaves_table(schemas, 3).collect()


def test_unexpected_branch_fails(spark, leaves):
    rows = spark.createDataFrame([("d", b, "a", '"1"', 0.5) for b in range(4)], "document_id string, branch int, field_path string, value_json string, confidence double")
    docs = rows.select("document_id").distinct()
    with pytest.raises(Exception, match="expected branches 0 to 1"):
        consensus.majority_vote(rows, leaves, docs, 2).collect()
    assert consensus.majority_vote(rows, leaves, docs, 4).where("field_path = 'a'").first()["votes"] == 4
    with pytest.raises(Exception, match="expected branches"):
        consensus.parallel_merge(rows, 3).collect()


def test_split_document_is_scored_once(spark, leaves, tmp_path):
    truth = spark.createDataFrame([("x", "a", '"1"', "complete"), ("x", "b", '"2"', "complete"), ("y", "a", '"3"', "complete")], TRUTH)
    for rows in ([("r", "x", "a", '"1"')], [("r", "x", "b", '"2"'), ("r", "y", None, None)]):
        spark.createDataFrame(rows, PRED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PRED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.incremental_scoring(stream, truth, leaves, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = jobs.current_scores(spark.read.parquet(f"{tmp_path}/out")).select("document_id", "field_path", "status").collect()
    assert sorted(map(tuple, got)) == [("x", "a", "correct"), ("x", "b", "correct"), ("y", "a", "missing")]


def test_fields_are_scored_once_where_they_land(spark, leaves, tmp_path):
    """A batch scores what it brings: no stream state, earlier fields stay, a field that lands again counts anew, and equal truth rows are kept (F2)."""
    truth = spark.createDataFrame([("x", "a", '"1"', "complete"), ("x", "b", '"2"', "complete"), ("y", "a", '"3"', "complete"), ("y", "a", '"3"', "complete")], TRUTH)
    batches = ([("r", "x", "a", '"1"'), ("r", "y", "a", '"0"')], [("r", "x", "b", '"2"'), ("r", "y", "a", '"3"'), ("r", "y", "a", '"0"')])
    for rows in batches:
        spark.createDataFrame(rows, PRED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.incremental_scoring(spark.readStream.schema(PRED).parquet(f"{tmp_path}/in"), truth, leaves, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    table = spark.read.parquet(f"{tmp_path}/out")
    landed = {(r["batch"], r["document_id"], r["field_path"]) for r in table.where("landed").collect()}
    assert landed == {(0, "x", "a"), (0, "y", "a"), (1, "x", "b"), (1, "y", "a")} and not (tmp_path / "ckpt" / "state").exists()
    got = jobs.current_scores(table).select("document_id", "field_path", "status").collect()
    assert sorted(map(tuple, got)) == [("x", "a", "correct"), ("x", "b", "correct"), ("y", "a", "correct"), ("y", "a", "correct")]


def test_hallucinations_make_a_document_scored(spark, leaves):
    truth = spark.createDataFrame([("x", "other", '"1"', "complete")], TRUTH)
    pred = spark.createDataFrame([("r", "x", "made.up", '"1"')], PRED)
    docs = spark.createDataFrame([("r", "x")], "run_id string, document_id string")
    for on in (True, False):
        config = ScoringConfig(include_hallucinations=on)
        assert scoring.score_fields(truth, pred, leaves, config, docs).count() == int(on)
        assert scoring.unscored_documents(docs, truth, leaves, config).count() == int(not on)


def test_array_leaves_are_found(spark):
    arrays = schema_leaves(spark, {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}}})
    truth = spark.createDataFrame([("x", "a", "[1, 2.0]", "complete")], TRUTH)
    pred = spark.createDataFrame([("r", "x", "a", '["1", "2"]')], PRED)
    for given in (arrays, arrays.where("true")):
        assert scoring.score_fields(truth, pred, given).first()["status"] in ("correct", "validation_failed")
