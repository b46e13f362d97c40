"""Queries: latest-row lookups, ranking, trends and interval unions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K, compare as C
from .q_catalog import truth_docs
from .q_scoring import scored, S0
from .registry import query
from .sql import CTES, sql


@query("latest_truth", sql("SELECT document_id, field_path, revision, value_json, annotation_status FROM truth_all t WHERE revision = (SELECT max(revision) FROM truth_all u WHERE u.document_id = t.document_id AND u.field_path = t.field_path)", "truth_all"))
def _(v):
    return K.latest_truth(v.truth_all.drop("k", "f"), ["document_id", "field_path"])


@query("truth_history", sql("SELECT document_id, revision, annotation_status, CAST(row_number() OVER (PARTITION BY document_id ORDER BY revision DESC) AS INTEGER) AS age FROM dtruth", "dtruth"))
def _(v):
    return K.truth_history(truth_docs(v))


CTES["versions"] = ((), """SELECT 'p' || c_nationkey AS processor_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS version,
 CASE WHEN c_custkey%5 = 0 THEN 'published' ELSE 'draft' END AS status, 'v' || c_custkey AS version_id FROM customer""")


def versions(v):
    from pyspark.sql import Window
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return v.table("customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("processor_id"), F.row_number().over(w).cast("long").alias("version"),
        F.when(F.col("c_custkey") % 5 == 0, "published").otherwise("draft").alias("status"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("version_id"))


@query("resolve_version", sql("SELECT processor_id, version, status, version_id FROM (SELECT *, row_number() OVER (PARTITION BY processor_id ORDER BY CASE WHEN status = 'published' THEN 0 ELSE 1 END, version DESC) AS rn FROM versions) WHERE rn = 1", "versions"))
def _(v):
    return K.resolve_version(versions(v))


@query("resolve_version_explicit", sql("SELECT * FROM versions WHERE version = 3", "versions"))
def _(v):
    return K.resolve_version(versions(v), 3)


@query("draft_next_version", sql("SELECT processor_id, max(version) + 1 AS next_version FROM versions GROUP BY 1", "versions"))
def _(v):
    return K.draft_next_version(versions(v))


CTES["xs"] = ((), """SELECT 'd' || user_id AS document_id, 'p-' || event_type AS processor_id, 'x' || event_id AS extraction_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events""")


def xs(v):
    return v.table("events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"), F.concat(F.lit("p-"), F.col("event_type")).alias("processor_id"),
                                    F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("extraction_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("latest_extraction", sql("SELECT document_id, processor_id, extraction_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id, processor_id ORDER BY created_at DESC, extraction_id DESC) AS rn FROM xs) WHERE rn = 1", "xs"))
def _(v):
    return K.latest_extraction(xs(v), by_processor=True)


@query("representative_run", sql("""SELECT group_id, experiment_id, run_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY group_id, experiment_id ORDER BY CASE WHEN status = 'completed' THEN 0 ELSE 1 END, created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""", "runs"))
def _(v):
    return K.representative_run(v.runs).select("group_id", "experiment_id", "run_id", "status", "created_at")


@query("best_run", sql("""SELECT group_id, score, run_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.group_id ORDER BY score DESC, created_at, run_id) AS rn FROM runs r
 JOIN (SELECT group_id, fingerprint AS bf FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN score IS NOT NULL AND status = 'completed' THEN 0 ELSE 1 END, created_at, run_id) AS rn FROM runs) WHERE rn = 1) b USING (group_id)
 WHERE score IS NOT NULL AND status = 'completed' AND fingerprint = bf) WHERE rn = 1""", "runs"))
def _(v):
    return K.best_run(v.runs)


@query("score_trend", sql("""SELECT group_id, run_id, created_at, score, CAST(row_number() OVER w AS INTEGER) AS pos, round((score - lag(score) OVER w)*100, 4) AS step_points, round((score - first_value(score) OVER w)*100, 4) AS delta_points
 FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs WHERE score IS NOT NULL) WHERE rn <= 4 WINDOW w AS (PARTITION BY group_id ORDER BY created_at, run_id)""", "runs"))
def _(v):
    return K.score_trend(v.runs, 4)


@query("experiment_history", sql("""SELECT group_id, experiment_id, run_id, created_at, row_number() OVER (PARTITION BY group_id, experiment_id ORDER BY created_at, run_id) AS pos FROM (SELECT group_id, coalesce(experiment_id, 'legacy:' || run_id) AS experiment_id, run_id, created_at FROM runs)""", "runs"))
def _(v):
    return K.experiment_history(v.runs).select("group_id", "experiment_id", "run_id", "created_at", "pos")


UNION_SQL = """SELECT document_id, CAST(sum(greatest(end_ms - greatest(start_ms, coalesce(prev, start_ms)), 0)) AS BIGINT) AS latency_ms FROM (
 SELECT *, max(end_ms) OVER (PARTITION BY document_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT document_id, start_ms, start_ms + latency_ms AS end_ms FROM steps WHERE status = 'completed'{0})) GROUP BY 1"""


@query("interval_union_latency", sql(UNION_SQL.format(""), "steps"))
def _(v):
    return K.interval_union_latency(v.steps, ["document_id"], bucket_ms=1500)


@query("interval_union_latency_kinds", sql(UNION_SQL.format(" AND kind IN ('extract','parse')"), "steps"))
def _(v):
    return K.interval_union_latency(v.steps, ["document_id"], ["extract", "parse"])


@query("run_steps_page", sql("SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos, partkey, suppkey) - 1 AS INTEGER) AS step_index, kind || ':' || latency_ms AS step FROM steps ORDER BY document_id, step_index OFFSET 20 LIMIT 20", "steps"))
def _(v):
    traces = v.steps.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "partkey", "suppkey", "kind", "latency_ms"))),
                                                            lambda s: F.concat(s["kind"], F.lit(":"), s["latency_ms"].cast("string"))).alias("steps"))
    return K.run_steps_page(traces, None, 20, 20)


@query("run_cross_baseline", sql("""SELECT r.run_id, r.group_id, b.run_id AS baseline_run_id, round((r.score - b.score)*100, 4) AS delta_points FROM runs r
 JOIN (SELECT group_id, run_id, score FROM runs WHERE created_at = '2024-01-01') b USING (group_id) WHERE r.run_id <> b.run_id""", "runs"))
def _(v):
    return C.run_cross_baseline(v.runs, v.runs.where("created_at = '2024-01-01'")).select("run_id", "group_id", "baseline_run_id", "delta_points")


@query("compare_matrix", sql("""SELECT r.run_id, r.run_id = '5-LOW/r0' AS is_baseline, r.score, round((r.score - b.score)*100, 4) AS delta_points, r.cost_usd, r.documents, r.status
 FROM runs r CROSS JOIN (SELECT score FROM runs WHERE run_id = '5-LOW/r0') b WHERE r.run_id IN ('5-LOW/r0','5-LOW/r2','5-LOW/r4','1-URGENT/r3')""", "runs"))
def _(v):
    return C.compare_matrix(v.runs, ["5-LOW/r0", "5-LOW/r2", "5-LOW/r4", "1-URGENT/r3"])


@query("comparability_check", sql("""SELECT group_id, count(*) AS runs, count(*) >= 2 AND count(DISTINCT dataset_id) = 1 AND count(*) FILTER (status <> 'completed') = 0 AND count(DISTINCT fingerprint) = 1 AS comparable
 FROM runs WHERE created_at < CASE WHEN group_id = '5-LOW' THEN '2024-01-09' WHEN group_id = '2-HIGH' THEN '2024-01-06' ELSE '2024-01-04' END GROUP BY 1""", "runs"))
def _(v):
    from ..operators.validate import comparability_check
    until = F.when(F.col("group_id") == "5-LOW", "2024-01-09").when(F.col("group_id") == "2-HIGH", "2024-01-06").otherwise("2024-01-04")
    r = v.runs.where(F.col("created_at") < until).withColumn("comparison", F.col("group_id"))
    return comparability_check(r, ["comparison"]).select(F.col("comparison").alias("group_id"), "runs", "comparable")


CTES["candidates_cmp"] = ((), """SELECT 'c' || (o_orderkey%40) AS candidate_id, 'r' || (o_orderkey%160) AS run_id, count(*)*10 AS scored, CAST(sum(o_orderkey%7) AS BIGINT) AS net, CAST(sum(CASE WHEN o_orderkey%50 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS regressed FROM orders GROUP BY 1, 2""")


@query("candidate_ledger", sql("""SELECT candidate_id, count(*) AS checks, bool_and(ok) AS accepted, CASE WHEN bool_and(ok) THEN arg_min(run_id, (score, run_id)) END AS accepted_run_id, CASE WHEN bool_and(ok) THEN min(score) END AS confirmed_score FROM (
 SELECT *, net >= greatest(1, ceil(scored*0.29 - 1e-9)) AND regressed <= 1000 AS ok, ((net*37)%101)/100.0::DOUBLE AS score FROM candidates_cmp) GROUP BY 1""", "candidates_cmp"))
def _(v):
    k = F.col("o_orderkey")
    c = v.table("orders").groupBy(F.concat(F.lit("c"), (k % 40).cast("string")).alias("candidate_id"), F.concat(F.lit("r"), (k % 160).cast("string")).alias("run_id")).agg(
        (F.count(F.lit(1)) * 10).alias("scored"), F.sum(k % 7).alias("net"), F.count_if(k % 50 == 3).alias("regressed"))
    runs = c.select("run_id", ((F.col("net") * 37) % 101 / F.lit(100.0)).alias("score"))
    return C.candidate_ledger(c, runs, 0.29, 1000)


CTES["entries"] = ((), """SELECT 'j' || (l_orderkey%200) AS job_id, l_linenumber AS pos, CASE WHEN min(l_partkey)%41 = 0 THEN NULL ELSE (min(l_partkey)%100)/1000.0::DOUBLE END AS cost_usd, min(l_suppkey)%3 = 0 AS accepted FROM lineitem GROUP BY 1, 2""")


@query("budget_and_patience", sql("""SELECT job_id, pos, round(spent, 6) AS spent_usd, complete AS cost_complete, CAST(stalled AS BIGINT) AS stalled,
 CASE WHEN NOT complete THEN 'cost_unavailable' WHEN round(spent, 6) >= 0.15 THEN 'budget_reached' WHEN stalled >= 3 THEN 'patience_exhausted' END AS stop_reason FROM (
 SELECT *, sum(CASE WHEN accepted THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, island ORDER BY pos) AS stalled FROM (
 SELECT *, sum(coalesce(cost_usd, 0)) OVER w AS spent, NOT bool_or(cost_usd IS NULL) OVER w AS complete, sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER w AS island FROM entries WINDOW w AS (PARTITION BY job_id ORDER BY pos)))""", "entries"))
def _(v):
    low = F.min("l_partkey")
    e = v.table("lineitem").groupBy(F.concat(F.lit("j"), (F.col("l_orderkey") % 200).cast("string")).alias("job_id"), F.col("l_linenumber").alias("pos")).agg(
        F.when(low % 41 != 0, (low % 100) / F.lit(1000.0)).alias("cost_usd"), (F.min("l_suppkey") % 3 == 0).alias("accepted"))
    out = C.budget_and_patience(e, 0.15, 3)
    return out.select("job_id", "pos", F.round("spent_usd", 6).alias("spent_usd"), "cost_complete", "stalled", "stop_reason")


@query("configuration_changes", sql("""SELECT s_suppkey AS pair, array_to_string(list_filter([CASE WHEN s_nationkey%4 <> (s_nationkey+s_suppkey)%4 THEN 'Model' END, CASE WHEN s_nationkey%2 <> s_suppkey%2 THEN 'Parser' END, CASE WHEN s_suppkey%3 = 0 THEN 'Prompt' END], lambda x: x IS NOT NULL), ',') AS changes FROM supplier"""))
def _(v):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    s = v.table("supplier").withColumn("pair", k)
    a = s.select("pair", (n % 4).alias("model"), (n % 2).cast("long").alias("parser"), F.lit(0).alias("prompt"))
    b = s.select("pair", ((n + k) % 4).alias("model"), (k % 2).alias("parser"), F.when(k % 3 == 0, 1).otherwise(0).alias("prompt"))
    return C.configuration_changes(a, b, {"model": "Model", "parser": "Parser", "prompt": "Prompt"}, ["pair"]).withColumn("changes", F.array_join("changes", ","))
