"""Queries: validation, arithmetic, acceptance and guards."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import validate as V
from ..schema import schema_leaves
from .q_catalog import truth_docs
from .registry import query
from .sql import CTES, errors, sql


@query("validate_fields", sql(f"SELECT document_id, field_path, {errors('f', 'value_json')} AS errors FROM pred0", "pred0"))
def _(v):
    return V.validate_fields(v.pred(0), v.leaves).select("document_id", "field_path", F.array_join("errors", "; ").alias("errors"))


@query("validate_required", sql("""SELECT b.document_id, b.field_path, b.field_path || ' is required' AS message FROM base b LEFT JOIN pred0 p ON p.document_id = b.document_id AND p.field_path = b.field_path AND p.value_json NOT IN ('null','""')
 WHERE b.f IN (1,3,5) AND p.document_id IS NULL""", "base", "pred0"))
def _(v):
    return V.validate_required(v.pred(0), v.leaves, v.documents)


@query("validate_array_items", """SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS document_id, CASE l_partkey%4 WHEN 0 THEN 'items[0].qty must be integer' WHEN 1 THEN 'items[1] must be object' ELSE '' END AS errors FROM lineitem""")
def _(v):
    leaves = schema_leaves(v.spark, {"type": "object", "properties": {"items": {"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "integer"}, "sku": {"type": "string"}}}}}})
    p = F.col("l_partkey")
    first = F.concat(F.lit('{"sku": "'), p.cast("string"), F.lit('", "qty": '), F.when(p % 4 == 0, '"two"').otherwise("2"), F.lit("}"))
    rows = v.table("lineitem").select(F.concat_ws("-", F.concat(F.lit("l"), F.col("l_orderkey").cast("string")), "l_linenumber", "l_partkey", "l_suppkey").alias("document_id"), F.lit("items").alias("field_path"),
                                      F.concat(F.lit("["), first, F.when(p % 4 == 1, ', "loose"').otherwise(""), F.lit("]")).alias("value_json"))
    return V.validate_fields(rows, leaves).select("document_id", F.array_join("errors", "; ").alias("errors"))


CTES["parts"] = ((), """SELECT 'o' || o_orderkey AS document_id, o_orderkey AS k, o_orderkey%90 AS net, o_custkey%30 AS tax, o_orderkey%90 + o_custkey%30 + CASE o_orderkey%5 WHEN 0 THEN 1 WHEN 1 THEN 0.01 ELSE 0 END AS gross FROM orders""")


def parts(v):
    k = F.col("o_orderkey")
    net, tax = k % 90, F.col("o_custkey") % 30
    gross = (net + tax).cast("decimal(12,2)") + F.when(k % 5 == 0, 1).when(k % 5 == 1, 0.01).otherwise(0).cast("decimal(12,2)")
    cells = F.array(F.struct(F.lit("net").alias("field_path"), net.cast("string").alias("value_json")), F.struct(F.lit("tax").alias("field_path"), F.when(k % 7 != 0, tax.cast("string")).alias("value_json")),
                    F.struct(F.lit("gross").alias("field_path"), F.concat(F.lit('"'), gross.cast("string"), F.lit('"')).alias("value_json")))
    return v.table("orders").select(F.concat(F.lit("o"), k.cast("string")).alias("document_id"), F.explode(cells).alias("c")).select("document_id", "c.*")


@query("arithmetic_rules", sql("SELECT document_id, 'gross' AS equals_path, CASE WHEN k%7 <> 0 THEN CAST(net + tax AS DOUBLE) END AS expected, CAST(gross AS DOUBLE) AS actual, k%7 <> 0 AND abs(CAST(net + tax AS DOUBLE) - CAST(gross AS DOUBLE)) <= 0.01::DOUBLE AS passed FROM parts", "parts"))
def _(v):
    return V.arithmetic_rules(parts(v), [{"sum": ["net", "tax"], "equals": "gross"}], v.documents).drop("rule")


@query("assess_acceptance", sql(f"""SELECT d.document_id, coalesce(n, 0) + coalesce(miss, 0) = 0 AND coalesce(u, '') = '' AS accepted, coalesce(n, 0) + coalesce(miss, 0) AS n_errors, coalesce(u, '') AS unresolved FROM (SELECT DISTINCT document_id FROM base) d LEFT JOIN (
 SELECT b.document_id, count(*) FILTER (coalesce({errors('b.f', 'p.value_json')}, '') <> '') AS n, count(*) FILTER (p.document_id IS NULL AND b.f IN (1,3,5)) AS miss,
  string_agg(b.field_path, ',' ORDER BY b.field_path) FILTER (p.value_json IS NULL OR p.value_json = 'null' OR {errors('b.f', 'p.value_json')} <> '' OR coalesce(p.confidence < 0.3, true)) AS u
 FROM base b LEFT JOIN pred0 p ON p.document_id = b.document_id AND p.field_path = b.field_path GROUP BY 1) x USING (document_id)""", "base", "pred0"))
def _(v):
    f = v.pred(0).withColumn("errors", F.array().cast("array<string>"))
    out = V.assess_acceptance(f, v.leaves, v.documents, {"threshold": 0.3})
    return out.withColumn("unresolved", F.array_join("unresolved", ","))


@query("spread_errors", sql("SELECT document_id, field_path FROM base WHERE (k%10 = 0) OR (k%10 = 1 AND f = 5) OR (k%10 = 2 AND f = 1)", "base"))
def _(v):
    k = F.col("k") % 10
    e = v.documents.where(k < 3).select("document_id", F.when(k == 0, "").when(k == 1, "customer").otherwise("total").alias("error_path"))
    return V.spread_errors(e, v.leaves)


@query("confidence_gate", sql("SELECT document_id, field_path, confidence IS NULL OR confidence < 0.5 AS escalated FROM pred0", "pred0"))
def _(v):
    return V.confidence_gate(v.pred(0), 0.5).select("document_id", "field_path", "escalated")


@query("span_offset_check", """SELECT doc_id, substr(text, CAST(n_chars//2 AS INTEGER) + 1, 20) = CASE WHEN doc_id%7 = 0 THEN 'shifted' ELSE substr(text, CAST(n_chars//2 AS INTEGER) + 1, 20) END AS span_ok, doc_id%5 <> 0 AS label_ok FROM documents""")
def _(v):
    start = F.floor(F.col("n_chars") / 2).cast("int")
    d = v.table("documents").select("doc_id", F.col("text").alias("context"), start.alias("answer_start"),
                                    F.when(F.col("doc_id") % 7 == 0, "shifted").otherwise(F.substring("text", start + 1, F.lit(20))).alias("text"),
                                    (F.col("doc_id") % 5 == 0).alias("is_impossible"), F.lit(1).alias("n_answers"))
    return V.span_offset_check(d).select("doc_id", "span_ok", "label_ok")


@query("frozen_document_check", sql("SELECT document_id, CASE WHEN n%50 = 0 THEN 'removed' ELSE 'changed' END AS problem FROM docs WHERE n%50 = 0 OR n%50 = 7", "docs"))
def _(v):
    frozen = v.docs.select("document_id", "n", F.when(F.col("n") % 50 == 7, "old").otherwise(F.col("sha256")).alias("sha256"))
    return V.frozen_document_check(frozen, v.docs.where("n % 50 <> 0")).select("document_id", "problem")


@query("reimport_conflict_check", sql("""SELECT document_id, CASE WHEN CAST(substr(document_id, 2) AS BIGINT)%3 = 0 THEN 'same' WHEN CAST(substr(document_id, 2) AS BIGINT)%5 = 0 AND revision = 1 THEN 'replace' ELSE 'conflict' END AS action
 FROM (SELECT document_id, max(revision) AS revision FROM dtruth GROUP BY 1) UNION ALL SELECT 'd' || o_orderkey, 'new' FROM orders WHERE o_orderkey%23 = 0""", "dtruth"))
def _(v):
    k = F.substring("document_id", 2, 20).cast("long")
    latest = truth_docs(v).groupBy("document_id").agg(F.max("revision").alias("revision")).withColumn("value_json", F.lit('{"a": 1.0, "b": 2}')).withColumn("author", F.when(k % 5 == 0, "import").otherwise("me"))
    new = v.documents.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("document_id"), F.when(F.col("k") % 3 == 0, '{"b":2,"a":1}').otherwise('{"b":3}').alias("value_json"))
    return V.reimport_conflict_check(new, latest, "import").select("document_id", "action")


@query("membership_conflict_check", sql("SELECT document_id, CASE WHEN n%20 = 0 THEN 'not_planned' ELSE 'split_changed' END AS problem FROM members WHERE n%20 = 0 OR n%20 = 3", "members"))
def _(v):
    n = F.col("n")
    current = v.members.withColumn("split", F.when(n % 20 == 3, "test").otherwise("dev"))
    planned = v.members.where(n % 20 != 0).select("dataset_id", "sha256", F.lit("dev").alias("split"))
    return V.membership_conflict_check(current, planned).select("document_id", "problem")
