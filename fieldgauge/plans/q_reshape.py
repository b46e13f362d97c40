"""Queries: flattening, unwrapping, canonicalization and merging."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J
from ..operators import catalog as K, reshape as R
from .registry import query
from .sql import CTES, canon, sql


def nested(v):
    """One nested JSON value per order."""
    total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"total": '), total, F.lit(', "empty": {}, "status": "'), F.col("o_orderstatus"), F.lit('", "customer": {"id": '), F.col("o_custkey").cast("string"),
                    F.lit(', "tags": ["'), F.col("o_orderpriority"), F.lit('", 1.50], "note": '), F.when(k % 3 == 0, "null").otherwise("false"), F.lit("}}"))
    return v.table("orders").select(F.concat(F.lit("o"), k.cast("string")).alias("document_id"), k.alias("k"), body.alias("value"))


CTES["flat"] = ((), rf"""SELECT 'o' || o_orderkey AS document_id, o_orderkey AS k, p AS field_path, CASE p WHEN 'total' THEN regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '\.?0+$', '')
 WHEN 'status' THEN '"' || o_orderstatus || '"' WHEN 'customer.id' THEN CAST(o_custkey AS VARCHAR) WHEN 'customer.tags' THEN '["' || o_orderpriority || '",1.5]' ELSE CASE WHEN o_orderkey%3 = 0 THEN 'null' ELSE 'false' END END AS value_json
 FROM orders CROSS JOIN (VALUES ('total'),('status'),('customer.id'),('customer.tags'),('customer.note')) x(p)""")


@query("flatten_values", sql("SELECT document_id, field_path, value_json FROM flat", "flat"))
def _(v):
    return R.flatten_values(nested(v), ["document_id"], "value")


def wrapped(v):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"total": {"value": '), F.col("o_custkey").cast("string"), F.lit(', "confidence": '), F.when(k % 4 == 0, "1.5").when(k % 4 == 1, "true").otherwise("0.75"),
                    F.lit(', "errors": ["'), F.col("o_orderstatus"), F.lit('"]}, "customer": {"name": "'), F.col("o_orderpriority"), F.lit('"}}'))
    return v.table("orders").select(F.concat(F.lit("o"), k.cast("string")).alias("document_id"), body.alias("value"))


UNWRAP_SQL = """SELECT 'o' || o_orderkey AS document_id, 'total' AS field_path, CAST(o_custkey AS VARCHAR) AS value_json, CASE WHEN o_orderkey%4 < 2 THEN NULL ELSE 0.75::DOUBLE END AS confidence, o_orderstatus AS errors FROM orders
 UNION ALL SELECT 'o' || o_orderkey, 'customer.name', '"' || o_orderpriority || '"', NULL, '' FROM orders"""


@query("flatten_predictions", UNWRAP_SQL)
def _(v):
    return R.flatten_predictions(wrapped(v), ["document_id"], "value").select("document_id", "field_path", "value_json", "confidence", F.array_join("errors", ",").alias("errors"))


@query("unwrap_fields", "SELECT document_id, value_json, confidence, errors FROM (" + UNWRAP_SQL + ") WHERE field_path = 'total'")
def _(v):
    d = wrapped(v).withColumn("raw", J.member(F.col("value"), "total"))
    return R.unwrap_fields(d, "raw").select("document_id", "value_json", "confidence", F.array_join("errors", ",").alias("errors"))


@query("path_lookup", sql("""SELECT b.document_id, b.field_path, p.value_json, p.document_id IS NOT NULL AS present FROM base b LEFT JOIN pred0 p ON p.document_id = b.document_id AND p.field_path = b.field_path""", "base", "pred0"))
def _(v):
    flat = v.pred(0).select("document_id", "field_path", "value_json", F.lit(False).alias("is_flat"))
    return R.path_lookup(v.base.select("document_id", "field_path"), flat, ["document_id"])


@query("canonicalize", sql("SELECT b.document_id, b.field_path, p.value_json, p.normalized_json, p.confidence FROM base b LEFT JOIN pred0 p ON p.document_id = b.document_id AND p.field_path = b.field_path", "base", "pred0"))
def _(v):
    out = v.pred(0).select("document_id", "field_path", "value_json", "confidence")
    return R.canonicalize(out, v.leaves, v.documents, ["document_id"])


@query("unflatten_values", sql("""SELECT document_id, '{"customer":{"id":' || max(value_json) FILTER (field_path = 'customer.id') || ',"note":' || max(value_json) FILTER (field_path = 'customer.note') || ',"tags":' || max(value_json) FILTER (field_path = 'customer.tags')
 || '},"status":' || max(value_json) FILTER (field_path = 'status') || ',"total":' || max(value_json) FILTER (field_path = 'total') || '}' AS value_json FROM flat GROUP BY 1""", "flat"))
def _(v):
    return R.unflatten_values(R.flatten_values(nested(v), ["document_id"], "value", 2), ["document_id"])


@query("project_schema", sql("SELECT document_id, field_path, value_json FROM truth WHERE field_path IN ('total', 'customer.name')", "truth"))
def _(v):
    kept = R.project_schema(v.leaves, ["total", "customer"])
    return v.truth.join(kept.select("field_path"), "field_path", "left_semi").select("document_id", "field_path", "value_json")


@query("merge_scoped", sql("""SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.field_path, b.field_path) AS field_path, coalesce(b.value_json, a.value_json) AS value_json
 FROM pred0 a FULL JOIN (SELECT * FROM pred1 WHERE field_path IN ('total','status')) b ON a.document_id = b.document_id AND a.field_path = b.field_path""", "pred0", "pred1"))
def _(v):
    return R.merge_scoped(v.pred(0), v.pred(1), v.leaves, ["document_id"], ["total", "status"])


@query("deep_merge", sql("""SELECT document_id, field_path, value_json FROM flat WHERE NOT (k%4 = 0 AND field_path = 'status') AND NOT (k%4 = 1 AND field_path LIKE 'customer.%') AND NOT (k%4 = 2 AND field_path = 'total')
 UNION ALL SELECT 'o' || o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'status' WHEN 1 THEN 'customer' WHEN 2 THEN 'total.net' ELSE 'extra' END, '"new"' FROM orders""", "flat"))
def _(v):
    k = F.col("o_orderkey") % 4
    up = v.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document_id"),
                                  F.when(k == 0, "status").when(k == 1, "customer").when(k == 2, "total.net").otherwise("extra").alias("field_path"), F.lit('"new"').alias("value_json"))
    return R.deep_merge(R.flatten_values(nested(v), ["document_id"], "value", 2), up, ["document_id"])


@query("table_value_columns", """SELECT column_name AS "column", CAST(min(rp) AS INTEGER) AS first_row, count(*) AS rows FROM (SELECT l_orderkey, c AS column_name, l_linenumber AS rp FROM lineitem CROSS JOIN (VALUES ('flag'),('part'),('qty')) x(c)
 WHERE c <> 'flag' OR l_linenumber%2 = 0) GROUP BY 1""")
def _(v):
    n = F.col("l_linenumber")
    row = F.concat(F.lit('{"part": '), F.col("l_partkey").cast("string"), F.lit(', "qty": 1'), F.when(n % 2 == 0, F.concat(F.lit(', "flag": "'), F.col("l_returnflag"), F.lit('"'))).otherwise(""), F.lit("}"))
    tables = v.table("lineitem").select("l_orderkey", "l_partkey", n.alias("n"), F.concat(F.lit("["), row, F.lit("]")).alias("value_json"))
    cols = K.table_value_columns(tables, ["n"])
    return cols.groupBy("column").agg(F.min("n").alias("first_row"), F.sum("rows").alias("rows"))


@query("schema_leaves", """SELECT 's' || s_suppkey AS processor_version_id, p AS field_path, t AS type, CASE WHEN p = 'when' THEN 'date' END AS format, p = 'name' OR (p = 'party.id' AND s_suppkey%2 = 0) AS required
 FROM supplier CROSS JOIN (VALUES ('name','string'),('when','string'),('rows','array'),('party.id','integer')) x(p, t)""")
def _(v):
    k = F.col("s_suppkey")
    body = F.concat(F.lit('{"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "when": {"type": "string", "format": "date"}, "nothing": {"type": "object", "properties": {}}, '
                          '"rows": {"type": "array", "items": {"type": "object"}}, "party": {"type": "object", "required": ['), F.when(k % 2 == 0, '"id"').otherwise(""), F.lit('], "properties": {"id": {"type": "integer"}}}}}'))
    return R.schema_leaves_table(v.table("supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("processor_version_id"), body.alias("schema_json")), 2)
