"""Queries: votes, merges and cascades over candidate outputs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import jsonvals as J
from ..operators import consensus as C, validate as V
from ..schema import schema_leaves
from .registry import query
from .sql import CTES, canon, dectext, errors, num, pred_cte, sql, txt

for _r in (2, 3):
    pred_cte(_r)


def candidates(v, runs=(1, 2, 3)):
    return v.branches(runs)


CTES["cand"] = (("pred1", "pred2", "pred3"), "SELECT *, 0 AS branch FROM pred1 UNION ALL SELECT *, 1 FROM pred2 UNION ALL SELECT *, 2 FROM pred3")
VALID = f"value_json <> 'null' AND CASE WHEN f IN (2, 6) THEN true ELSE {errors('f', 'value_json')} = '' END"
SIG = rf"CASE WHEN value_json[1] = '\"' THEN '\"' || trim(regexp_replace({txt('value_json')}, '\s+', ' ', 'g')) || '\"' ELSE {canon('value_json')} END".replace('\\"', '"')


@query("majority_vote", sql(f"""SELECT b.document_id, b.field_path, w.value_json, w.confidence, coalesce(w.n, 0) AS votes, round(w.n/3.0::DOUBLE, 6) AS agreement, CASE WHEN w.n IS NULL THEN 'No majority consensus' END AS error FROM base b LEFT JOIN (
 SELECT document_id, field_path, sig, count(*) AS n, arg_min(value_json, branch) AS value_json, arg_min({{'c': confidence}}, branch).c AS confidence FROM (SELECT *, {SIG} AS sig FROM cand WHERE {VALID}) GROUP BY 1, 2, 3 HAVING count(*) >= 2) w
 ON w.document_id = b.document_id AND w.field_path = b.field_path""", "base", "cand"))
def _(v):
    out = C.majority_vote(candidates(v), v.leaves, v.documents, 3)
    return out.drop("voters").withColumn("agreement", F.round("agreement", 6))


POLICIES = {"total": {"tolerance": "0.01", "numeric_strings": True}, "priority": {"case_insensitive": True}, "customer.name": {"case_insensitive": True}}
PSIG = rf"CASE WHEN f IN (4, 5) THEN lower({SIG}) ELSE {SIG} END"
CTES["cells"] = (("base", "cand"), f"""SELECT b.document_id, b.field_path, b.f, a.value_json AS v1, b2.value_json AS v2, c.value_json AS v3, a.confidence AS c1, b2.confidence AS c2, a.sig AS s1, b2.sig AS s2, c.sig AS s3 FROM base b
 LEFT JOIN (SELECT *, {PSIG} AS sig FROM cand WHERE branch = 0 AND {VALID}) a ON a.document_id = b.document_id AND a.field_path = b.field_path LEFT JOIN (SELECT *, {PSIG} AS sig FROM cand WHERE branch = 1 AND {VALID}) b2 ON b2.document_id = b.document_id AND b2.field_path = b.field_path
 LEFT JOIN (SELECT *, {PSIG} AS sig FROM cand WHERE branch = 2 AND {VALID}) c ON c.document_id = b.document_id AND c.field_path = b.field_path""")


def agree(a, b):
    return f"coalesce(CASE WHEN f = 1 THEN abs(CAST({a} AS DECIMAL(38,10)) - CAST({b} AS DECIMAL(38,10))) <= 0.01 ELSE {a} = {b} END, false)"


POLICY_VOTE_SQL = f"""SELECT document_id, field_path, CASE WHEN ab OR ac THEN v1 WHEN bc THEN v2 END AS value_json, CASE WHEN ab OR ac THEN c1 WHEN bc THEN c2 END AS confidence,
 CASE WHEN ab AND ac AND bc THEN 3 WHEN ab OR ac OR bc THEN 2 ELSE 0 END AS votes, CASE WHEN ab AND ac AND bc THEN '0,1,2' WHEN ab THEN '0,1' WHEN ac THEN '0,2' WHEN bc THEN '1,2' ELSE '' END AS voters,
 CASE WHEN NOT (ab OR ac OR bc) THEN 'No majority consensus' END AS error FROM (SELECT *, {agree('s1', 's2')} AS ab, {agree('s1', 's3')} AS ac, {agree('s2', 's3')} AS bc FROM cells)"""


@query("tolerance_vote", sql(POLICY_VOTE_SQL, "cells"))
def _(v):
    """Every field by its own policy: totals within a cent, priorities and names whatever their case, the rest exactly."""
    out = C.majority_vote(candidates(v), v.leaves, v.documents, 3, policies=POLICIES)
    return out.select("document_id", "field_path", "value_json", "confidence", "votes", F.array_join("voters", ",").alias("voters"), "error")


@query("vote_decisions", sql(f"SELECT document_id, field_path AS field, votes, 3 AS voters, 2 AS quorum, votes > 0 AS selected FROM ({POLICY_VOTE_SQL})", "cells"))
def _(v):
    return C.vote_decisions(C.majority_vote(candidates(v), v.leaves, v.documents, 3, policies=POLICIES), 3)


def line_tables(v):
    """Three candidate tables per order: same rows, reversed, and (for k%4=0) one row short."""
    row = lambda e: F.concat(F.lit('{"sku":'), e["sku"].cast("string"), F.lit(',"qty":'), e["qty"].cast("int").cast("string"), F.lit("}"))
    t = (v.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("qty")).groupBy("l_orderkey")
         .agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("sku"), "qty"))).alias("rows")))
    short = F.when(F.col("l_orderkey") % 4 == 0, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    tables = [F.col("rows"), F.reverse("rows"), short]
    json = [F.concat(F.lit("["), F.array_join(F.transform(x, row), ","), F.lit("]")) for x in tables]
    cells = F.array(*[F.struct(F.lit(i).alias("branch"), j.alias("value_json")) for i, j in enumerate(json)])
    return t.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("document_id"), F.lit("items").alias("field_path"), F.explode(cells).alias("c"), F.lit(0.5).alias("confidence")).select("document_id", "field_path", "c.*", "confidence")


ITEMS = {"type": "object", "properties": {"items": {"type": "array", "items": {"type": "object"}}}}


@query("table_vote", "SELECT 'o' || l_orderkey AS document_id, CASE WHEN l_orderkey%4 = 0 THEN 2 ELSE 3 END AS votes, count(DISTINCT l_partkey) AS rows FROM lineitem GROUP BY l_orderkey")
def _(v):
    t = line_tables(v)
    out = C.majority_vote(t, schema_leaves(v.spark, ITEMS), t.select("document_id").distinct(), 3, row_keys={"items": "sku"})
    return out.select("document_id", "votes", F.size(J.elements(F.col("value_json"))).alias("rows"))


@query("table_vote_without_key", "SELECT DISTINCT 'o' || l_orderkey AS document_id, 'No majority consensus; array fields require a row key' AS error FROM lineitem")
def _(v):
    t = line_tables(v)
    return C.majority_vote(t, schema_leaves(v.spark, ITEMS), t.select("document_id").distinct(), 3).select("document_id", "error")


CTES["sigs"] = (("cand",), f"SELECT document_id, field_path, f, branch, value_json, {SIG} AS sig FROM cand")


def fold_sql(changed):
    """Fold of three branches written out: x1, x2, x3 are the changed values in branch order."""
    return f"""SELECT document_id, field_path, CASE WHEN n = 1 THEN v[1] WHEN n = 2 THEN CASE WHEN s[1] = s[2] THEN v[2] ELSE 'null' END
 ELSE CASE WHEN s[1] = s[2] AND s[2] = s[3] THEN v[3] WHEN s[1] <> s[2] AND s[3] = 'null' THEN 'null' ELSE 'null' END END AS value_json,
 CASE WHEN n = 1 THEN false WHEN n = 2 THEN s[1] <> s[2] ELSE CASE WHEN s[1] = s[2] THEN s[2] <> s[3] ELSE s[3] <> 'null' END END AS conflict
 FROM (SELECT document_id, field_path, count(*) AS n, list(value_json ORDER BY branch) AS v, list(sig ORDER BY branch) AS s FROM ({changed}) GROUP BY 1, 2)"""


@query("parallel_merge", sql(fold_sql("SELECT * FROM sigs"), "sigs"))
def _(v):
    return C.parallel_merge(candidates(v), 3).select("document_id", "field_path", "value_json", F.col("error").isNotNull().alias("conflict"))


@query("joined_route_merge", sql(f"""SELECT coalesce(c.document_id, m.document_id) AS document_id, coalesce(c.field_path, m.field_path) AS field_path, coalesce(m.value_json, c.value_json) AS value_json FROM pred0 c FULL JOIN (
 {fold_sql(f"SELECT s.* FROM sigs s LEFT JOIN pred0 p ON p.document_id = s.document_id AND p.field_path = s.field_path WHERE {canon('s.value_json')} IS DISTINCT FROM {canon('p.value_json')}")}) m ON c.document_id = m.document_id AND c.field_path = m.field_path""", "sigs", "pred0"))
def _(v):
    return C.joined_route_merge(candidates(v), 3, v.raw(0).select("document_id", "field_path", "value_json"), v.leaves)


def paged(v):
    return candidates(v).withColumnRenamed("branch", "page")


@query("page_merge", sql(f"""SELECT document_id, field_path, CASE WHEN count(DISTINCT c) = 1 THEN arg_max(value_json, branch) END AS value_json, CASE WHEN count(DISTINCT c) > 1 THEN 'Conflicting page values; configure a merge policy' END AS error
 FROM (SELECT *, {canon('value_json')} AS c FROM cand WHERE value_json <> 'null') GROUP BY 1, 2""", "cand"))
def _(v):
    return C.page_merge(paged(v)).select("document_id", "field_path", "value_json", "error")


@query("page_merge_tables", "SELECT 'o' || l_orderkey AS document_id, count(DISTINCT l_partkey) AS rows, NULL AS error FROM lineitem GROUP BY l_orderkey")
def _(v):
    t = line_tables(v).withColumnRenamed("branch", "page")
    return C.page_merge(t, {"items": "sku"}).select("document_id", F.size(J.elements(F.col("value_json"))).cast("long").alias("rows"), "error")


@query("confidence_merge", sql("""SELECT document_id, field_path, CASE WHEN bc > fc THEN bv ELSE fv END AS value_json, CASE WHEN bc > fc THEN bc ELSE fraw END AS confidence FROM (
 SELECT document_id, field_path, arg_min(value_json, branch) AS fv, arg_min(coalesce(confidence, 0), branch) AS fc, arg_min({'c': confidence}, branch).c AS fraw, max(confidence) FILTER (ok) AS bc, arg_max(value_json, (confidence, -branch)) FILTER (ok) AS bv
 FROM (SELECT *, value_json NOT IN ('null','""') AND coalesce(confidence, 0) > 0 AS ok FROM cand) GROUP BY 1, 2)""", "cand"))
def _(v):
    none = F.array().cast("array<string>")
    p = paged(v).withColumn("evidence", none).withColumn("errors", F.array(F.concat(F.lit("page "), F.col("page").cast("string"))))
    return C.confidence_merge(p).select("document_id", "field_path", "value_json", "confidence")


def tiers(v, runs):
    return candidates(v, runs).withColumn("errors", F.array().cast("array<string>"))


def assess_sql(source):
    """(document_id, accepted) of one accumulated output under threshold 0.1 on critical fields total and status."""
    e = errors("f", "value_json")
    return f"""SELECT d.document_id, coalesce(ok, false) AS accepted FROM (SELECT DISTINCT document_id FROM base) d LEFT JOIN (SELECT document_id, count(*) FILTER ({e} <> '') = 0 AND count(*) FILTER (f IN (1,3,5)) = 3
 AND count(*) FILTER (f IN (1,3) AND (value_json = 'null' OR coalesce(confidence < 0.1, true))) = 0 AS ok FROM {source} GROUP BY 1) x USING (document_id)"""


POLICY = {"critical_fields": ["total", "status"], "threshold": 0.1}
CTES["acc2"] = (("pred1", "pred2"), """SELECT coalesce(b.document_id, a.document_id) AS document_id, coalesce(b.field_path, a.field_path) AS field_path, coalesce(b.f, a.f) AS f, coalesce(b.value_json, a.value_json) AS value_json,
 CASE WHEN b.document_id IS NOT NULL THEN b.confidence ELSE a.confidence END AS confidence FROM pred1 a FULL JOIN pred2 b ON a.document_id = b.document_id AND a.field_path = b.field_path""")
CTES["ok1"] = (("base", "pred1"), assess_sql("pred1"))
CTES["ok2"] = (("base", "acc2"), assess_sql("acc2"))


@query("cascade_select", sql("""SELECT x.document_id, x.field_path, 0 AS tier, true AS accepted, x.value_json FROM pred1 x JOIN ok1 ON ok1.document_id = x.document_id AND ok1.accepted
 UNION ALL SELECT x.document_id, x.field_path, 1, ok2.accepted, x.value_json FROM acc2 x JOIN ok1 ON ok1.document_id = x.document_id AND NOT ok1.accepted JOIN ok2 ON ok2.document_id = x.document_id""", "acc2", "ok1", "ok2"))
def _(v):
    return C.cascade_select(tiers(v, (1, 2)), 2, v.leaves, v.documents, POLICY).drop("confidence")


@query("cascade_unresolved_fill", sql(f"""SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.field_path, b.field_path) AS field_path, coalesce(b.value_json, a.value_json) AS value_json FROM pred1 a FULL JOIN (
 SELECT t.* FROM pred2 t LEFT JOIN pred1 o ON o.document_id = t.document_id AND o.field_path = t.field_path
 WHERE (o.document_id IS NULL AND t.f IN (1,3,5)) OR {errors('t.f', 'o.value_json')} <> '' OR (t.f IN (1,3) AND (o.value_json = 'null' OR coalesce(o.confidence < 0.1, o.document_id IS NOT NULL)))) b
 ON a.document_id = b.document_id AND a.field_path = b.field_path""", "pred1", "pred2"))
def _(v):
    return C.cascade_unresolved_fill(tiers(v, (1, 2)), 2, v.leaves, v.documents, POLICY).select("document_id", "field_path", "value_json")


@query("mean_output_confidence", sql("SELECT d.document_id, round(coalesce(avg(p.confidence), 0), 6) AS mean_confidence FROM (SELECT DISTINCT document_id FROM base) d LEFT JOIN pred0 p USING (document_id) GROUP BY 1", "base", "pred0"))
def _(v):
    return C.mean_output_confidence(v.pred(0), v.documents).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("threshold_cascade", sql("""SELECT p.document_id, p.field_path, p.value_json, 'primary' AS source FROM pred0 p JOIN m ON m.document_id = p.document_id AND c >= 0.5001
 UNION ALL SELECT p.document_id, p.field_path, p.value_json, 'fallback' FROM pred1 p JOIN m ON m.document_id = p.document_id AND c < 0.5001""", "base", "pred0", "pred1").replace("\nSELECT p.document_id", """,
 m AS (SELECT d.document_id, coalesce(avg(p.confidence), 0) AS c FROM (SELECT DISTINCT document_id FROM base) d LEFT JOIN pred0 p USING (document_id) GROUP BY 1)
SELECT p.document_id""", 1))
def _(v):
    cols = ["document_id", "field_path", "value_json", "confidence"]
    return C.threshold_cascade(v.pred(0).select(*cols), v.pred(1).select(*cols), v.documents, 0.5001).drop("confidence")


@query("verify_select", sql("""SELECT x.document_id, x.field_path, x.value_json, x.source FROM (SELECT *, 'primary' AS source FROM pred0 UNION ALL SELECT *, 'verified' FROM pred1) x JOIN (
 SELECT d.document_id, coalesce(bool_or(p.f = 1 AND p.value_json[1] = '"'), false) OR count(*) FILTER (p.f IN (1,3,5) AND p.value_json <> 'null') < 3 AS bad FROM (SELECT DISTINCT document_id FROM base) d LEFT JOIN pred1 p USING (document_id) GROUP BY 1) b
 ON b.document_id = x.document_id AND b.bad = (x.source = 'primary')""", "base", "pred0", "pred1"))
def _(v):
    cols = ["document_id", "field_path", "value_json"]
    return C.verify_select(v.pred(0).select(*cols), v.pred(1).select(*cols), v.leaves, v.documents)


@query("gate_split", sql("SELECT document_id, CASE WHEN accepted THEN 'pass' ELSE 'fail' END AS branch FROM ok1", "ok1"))
def _(v):
    a = V.assess_acceptance(tiers(v, (1,)), v.leaves, v.documents, POLICY)
    good, bad = C.gate_split(a)
    return good.select("document_id", F.lit("pass").alias("branch")).unionByName(bad.select("document_id", F.lit("fail").alias("branch")))
