"""Queries: catalog views, filters, aggregates and cost."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J
from ..operators import catalog as K, cost as P
from .q_scoring import S0, outcomes, rounded, scored
from .registry import query
from .sql import CTES, sql

CTES["truth_docs"] = (("truth_all",), "SELECT document_id, revision, max(annotation_status) AS annotation_status FROM truth_all GROUP BY 1, 2")
CTES["docmeta"] = (("docs",), """SELECT *, CASE n%4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type FROM docs""")
# Text documents get the truth of the order with the same number.
CTES["dtruth"] = ((), """SELECT 'd' || o_orderkey AS document_id, rev AS revision, CASE WHEN o_orderkey%11 = 0 THEN 'unverified' ELSE 'complete' END AS annotation_status
 FROM orders CROSS JOIN (VALUES (1),(2)) r(rev) WHERE o_orderkey%23 <> 0 AND (rev = 1 OR o_orderkey%7 = 0)""")


def truth_docs(v, prefix="d"):
    k = F.col("o_orderkey")
    revs = F.when(k % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (v.table("orders").where(k % 23 != 0).withColumn("revision", F.explode(revs))
            .select(F.concat(F.lit(prefix), k.cast("string")).alias("document_id"), "revision",
                    F.when(k % 11 == 0, "unverified").otherwise("complete").alias("annotation_status")))


def docmeta(v):
    n = F.col("n")
    return v.docs.withColumn("mime_type", F.when(n % 4 == 0, "text/plain").when(n % 4 == 1, "text/html").when(n % 4 == 2, "application/pdf").otherwise("application/octet-stream"))


@query("failure_filter", sql(f"""SELECT s.document_id, s.status, s.actual_json, x.extraction_id, x.latency_ms, x.cost_usd FROM {S0} s JOIN extractions0 x USING (document_id)
 WHERE s.status = 'incorrect' AND s.field_path = 'total'""", S0, "extractions0"))
def _(v):
    f = K.failure_filter(scored(v), v.extractions(0), "incorrect", "total")
    return f.select("document_id", "status", "actual_json", "extraction_id", "latency_ms", "cost_usd")


@query("document_search", sql("""SELECT d.document_id, filename, mime_type, m.names AS dataset_names, t.revision, t.annotation_status FROM docmeta d
 LEFT JOIN (SELECT document_id, string_agg(DISTINCT name, '||' ORDER BY name) AS names FROM (SELECT document_id, dataset_id AS name FROM docs UNION ALL SELECT document_id, 'all ' || lang FROM docs) GROUP BY 1) m USING (document_id)
 LEFT JOIN (SELECT document_id, max(revision) AS revision, arg_max(annotation_status, revision) AS annotation_status FROM dtruth GROUP BY 1) t USING (document_id)
 WHERE contains(lower(filename), 'pdf') OR contains(lower(mime_type), 'pdf') OR contains(lower(filename), '#.html')""".replace(" OR contains(lower(filename), '#.html')", ""), "docmeta", "docs", "dtruth"))
def _(v):
    d = docmeta(v)
    m = d.select("document_id", F.explode(F.array(F.col("dataset_id"), F.concat(F.lit("all "), F.col("lang")))).alias("dataset_name"))
    return K.document_search(d, m, truth_docs(v), "PDF")


@query("dataset_filter", sql("SELECT document_id, dataset_id, CASE WHEN n%3 = 0 THEN 'test' ELSE 'dev' END AS split FROM members WHERE n%3 = 0 AND list_contains(tags, 'en')", "members"))
def _(v):
    m = v.members.withColumn("split", F.when(F.col("n") % 3 == 0, "test").otherwise("dev"))
    return K.dataset_filter(m, "test", "en").select("document_id", "dataset_id", "split")


@query("item_search_page", sql("""SELECT filename, dataset_id, lang, total, CASE WHEN 110 < total THEN 110 END AS next_offset FROM (SELECT filename, dataset_id, lang, n, count(*) OVER () AS total FROM docs
 WHERE contains(lower(filename || '|' || dataset_id || '|' || lang), 'src1')) ORDER BY n OFFSET 10 LIMIT 100""", "docs"))
def _(v):
    return K.item_search_page(v.docs.select("filename", "dataset_id", "lang", "n"), "SRC1", [F.col("n")], 10, 100).drop("n")


@query("dataset_members", sql("""SELECT m.document_id, m.dataset_id, array_to_string(m.tags, ',') AS tags, d.filename, t.revision, t.annotation_status FROM members m JOIN docmeta d USING (document_id)
 LEFT JOIN (SELECT document_id, max(revision) AS revision, arg_max(annotation_status, revision) AS annotation_status FROM dtruth GROUP BY 1) t USING (document_id)""", "members", "docmeta", "dtruth"))
def _(v):
    m = v.members.select("document_id", "dataset_id", "tags")
    out = K.dataset_members(m, docmeta(v).select("document_id", "filename"), truth_docs(v))
    return out.withColumn("tags", F.array_join("tags", ","))


@query("failed_documents_filter", sql(f"""SELECT DISTINCT s.document_id, 'order ' || s.k || '.txt' AS filename FROM {S0} s WHERE s.status <> 'correct' AND s.field_path = 'total' AND contains('order ' || s.k || '.txt', '7')""", S0))
def _(v):
    d = v.documents.select("document_id", F.concat(F.lit("order "), F.col("k").cast("string"), F.lit(".txt")).alias("filename"))
    return K.failed_documents_filter(scored(v), d, "total", "7")


CTES["answers"] = ((), """SELECT 'run-0' AS run_id, 'o' || o_orderkey AS document_id, 'fee.' || nm AS field_path, CASE WHEN nm = 'status' THEN '"extracted"' ELSE '"' || o_orderstatus || '"' END AS expected_json,
 nm = 'location' AND o_orderkey%5 = 0 AS has_expected FROM orders CROSS JOIN (VALUES ('value'),('status'),('excerpt'),('location')) x(nm) WHERE nm <> 'excerpt' OR o_orderkey%3 <> 0""")


def answers(v):
    names = F.explode(F.array(*[F.lit(n) for n in ("value", "status", "excerpt", "location")]))
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", names.alias("nm")).where("nm <> 'excerpt' or k % 3 <> 0")
    return o.select(F.lit("run-0").alias("run_id"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("document_id"),
                    F.concat(F.lit("fee."), F.col("nm")).alias("field_path"),
                    F.when(F.col("nm") == "status", '"extracted"').otherwise(F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))).alias("expected_json"),
                    ((F.col("nm") == "location") & (F.col("k") % 5 == 0)).alias("has_expected"))


@query("answer_fields", sql("""SELECT document_id, field_path FROM answers a WHERE NOT (field_path IN ('fee.excerpt','fee.location') AND NOT has_expected
 AND (SELECT count(DISTINCT field_path) FROM answers b WHERE b.document_id = a.document_id) = 4)""", "answers"))
def _(v):
    return K.answer_fields(answers(v)).select("document_id", "field_path")


@query("companion_status", sql("SELECT document_id, field_path, 'extracted' AS expected_status FROM answers", "answers"))
def _(v):
    return K.companion_status(answers(v)).select("document_id", "field_path", "expected_status")


@query("scope_filter", sql("SELECT document_id, filename FROM docs WHERE dataset_id = 'src3' AND lang = 'en'", "docs"))
def _(v):
    d = v.docs.withColumnRenamed("dataset_id", "workspace_id").withColumnRenamed("lang", "project_id")
    return K.scope_filter(d, "src3", "en").select("document_id", "filename")


@query("evaluation_document_view", sql(f"""SELECT coalesce(p.document_id, s.document_id) AS document_id, coalesce(p.field_path, s.field_path) AS field_path,
 CASE WHEN s.status IS NOT NULL THEN s.actual_json ELSE p.value_json END AS value_json, s.expected_json, s.status IS NOT NULL AS has_expected, coalesce(s.status, 'unscored') AS status
 FROM pred0 p FULL JOIN {S0} s ON s.document_id = p.document_id AND s.field_path = p.field_path""", S0, "pred0"))
def _(v):
    return K.evaluation_document_view(v.pred(0), scored(v)).drop("run_id", "confidence")


@query("dataset_stats", sql("""SELECT dataset_id, count(*) AS document_count, count(DISTINCT a) AS annotated_count, round(count(DISTINCT a)/count(*)::DOUBLE*100, 1) AS gt_coverage
 FROM (SELECT m.dataset_id, t.document_id AS a FROM members m LEFT JOIN (SELECT DISTINCT document_id FROM dtruth) t USING (document_id)) GROUP BY 1""", "members", "dtruth"))
def _(v):
    return K.dataset_stats(v.members, truth_docs(v))


@query("group_rollup", sql("""SELECT group_id, count(DISTINCT experiment_id) AS experiment_count, count(experiment_id) AS run_count FROM runs GROUP BY 1""", "runs"))
def _(v):
    r = v.runs
    e = r.where("experiment_id is not null").select("experiment_id", "group_id").distinct()
    return K.group_rollup(r.select("group_id").distinct(), e, r)


@query("run_listing", sql(f"""SELECT r.run_id, x.n AS extraction_count, coalesce(e.n, 0) AS evaluation_count FROM (VALUES ('run-0'),('run-1')) r(run_id)
 JOIN (SELECT 'run-0' AS run_id, count(*) AS n FROM extractions0 UNION ALL SELECT 'run-1', count(*) FROM extractions1) x USING (run_id)
 LEFT JOIN (SELECT run_id, count(DISTINCT document_id) AS n FROM {S0} GROUP BY 1) e USING (run_id)""", "extractions0", "extractions1", S0))
def _(v):
    x = v.extractions(0).unionByName(v.extractions(1))
    return K.run_listing(x.select("run_id").distinct(), x, scored(v).select("run_id", "document_id").distinct())


CTES["usage"] = (("extractions0",), """SELECT run_id, document_id, k AS pos, input_tokens, output_tokens, 'tier-' || k%3 AS tier FROM extractions0""")


@query("usage_totals", sql("""SELECT run_id, 'input_tokens' AS key, CAST(sum(input_tokens) AS DOUBLE) AS total, NULL AS first_value FROM usage GROUP BY 1 UNION ALL
 SELECT run_id, 'output_tokens', CAST(sum(output_tokens) AS DOUBLE), NULL FROM usage GROUP BY 1 UNION ALL
 SELECT run_id, 'tier', NULL, '"' || arg_min(tier, pos) || '"' FROM usage GROUP BY 1""", "usage"))
def _(v):
    u = v.extractions(0).select("run_id", F.col("k").alias("pos"), F.to_json(F.struct(
        "input_tokens", "output_tokens", F.concat(F.lit("tier-"), (F.col("k") % 3).cast("string")).alias("tier"))).alias("usage_json"))
    return K.usage_totals(u, ["run_id"])


@query("folder_counts", sql("""SELECT path, regexp_extract(path, '([^/]+)/$', 1) AS name, regexp_extract(path, '^(.*/)[^/]+/$', 1) AS parent_path, CAST(sum(n) AS BIGINT) AS document_count FROM (
 SELECT folder AS path, 1 AS n FROM docs UNION ALL SELECT dataset_id || '/', 0 FROM docs) GROUP BY 1""", "docs"))
def _(v):
    return K.folder_counts(v.docs)


@query("first_run_per_version", sql("SELECT experiment_id AS processor_version_id, status AS name, min(created_at) AS first_run_at FROM runs GROUP BY 1, 2", "runs"))
def _(v):
    return K.first_run_per_version(v.runs.select(F.col("experiment_id").alias("processor_version_id"), F.col("status").alias("name"), "created_at"))


@query("run_totals", sql("""SELECT group_id, CASE WHEN count(*) = count(cost_usd) THEN round(sum(cost_usd), 6) END AS total_cost_usd, CAST(sum(documents*1000) AS BIGINT) AS duration_ms, count(*) AS runs
 FROM (SELECT group_id || CASE WHEN status = 'failed' THEN '-failed' ELSE '' END AS group_id, cost_usd, documents FROM runs) GROUP BY 1""", "runs"))
def _(v):
    start = F.to_timestamp("created_at")
    r = v.runs.select(F.concat("group_id", F.when(F.col("status") == "failed", "-failed").otherwise("")).alias("group_id"), "cost_usd",
                      start.alias("started_at"), (start + F.make_dt_interval(secs=F.col("documents").cast("int"))).alias("completed_at"))
    return rounded(K.run_totals(r, ["group_id"]), "total_cost_usd")


@query("warnings_rollup", sql("SELECT run_id, CAST(sum(k%4) AS BIGINT) AS warnings, count(*) FILTER (k%4 > 0) AS documents_with_warnings FROM extractions0 GROUP BY 1", "extractions0"))
def _(v):
    w = v.extractions(0).withColumn("warnings", F.when(F.col("k") % 4 > 0, F.array_repeat(F.lit("w"), (F.col("k") % 4).cast("int"))).otherwise(F.array().cast("array<string>")))
    return K.warnings_rollup(w)


@query("datasets_without_experiment_runs", sql("SELECT DISTINCT dataset_id FROM runs r WHERE EXISTS (SELECT 1 FROM runs q WHERE q.dataset_id = r.dataset_id AND q.experiment_id IS NULL)", "runs"))
def _(v):
    return K.datasets_needing_baseline(v.runs.select("dataset_id").distinct(), v.runs)


# ---- cost ------------------------------------------------------------------------------------------
PRICE_SQL = """CASE model WHEN 'gpt-4.1-mini' THEN 0.4::DOUBLE WHEN 'gpt-4o-2024-08-06' THEN 2.5::DOUBLE WHEN 'claude-haiku-4-5' THEN 1.0::DOUBLE END"""
OUT_SQL = """CASE model WHEN 'gpt-4.1-mini' THEN 1.6::DOUBLE WHEN 'gpt-4o-2024-08-06' THEN 10.0::DOUBLE WHEN 'claude-haiku-4-5' THEN 5.0::DOUBLE END"""
CTES["priced"] = (("extractions0",), f"""SELECT *, {PRICE_SQL} AS input_rate, {OUT_SQL} AS output_rate FROM extractions0""")
CTES["estimated"] = (("priced",), """SELECT *, CASE WHEN input_rate IS NULL AND provider = 'local' THEN 0 ELSE (input_tokens*input_rate + output_tokens*output_rate)/1000000 END AS est FROM priced""")


@query("pricing_prefix_join", sql("SELECT document_id, model, CASE model WHEN 'gpt-4o-2024-08-06' THEN 'gpt-4o' WHEN 'house-model' THEN NULL ELSE model END AS alias, input_rate, output_rate FROM priced", "priced"))
def _(v):
    return P.pricing_prefix_join(v.extractions(0), P.price_table(v.spark)).select("document_id", "model", "alias", "input_rate", "output_rate")


@query("estimate_cost", sql("""SELECT grp, CASE WHEN count(*) = count(est) THEN round(sum(est), 8) END AS estimated_usd FROM (SELECT 'g' || k%64 AS grp, est FROM estimated) GROUP BY 1""", "estimated"))
def _(v):
    u = v.extractions(0).withColumn("grp", F.concat(F.lit("g"), (F.col("k") % 64).cast("string")))
    return rounded(P.estimate_cost(u, P.price_table(v.spark), ["grp"]), "estimated_usd", digits=8)


@query("run_cost", sql("""SELECT run_id, CASE WHEN NOT u THEN round(s, 8) END AS cost_usd, CASE WHEN NOT u THEN round(s/n, 8) END AS cost_per_document, CASE WHEN u THEN 'unavailable' ELSE 'estimated' END AS cost_status
 FROM (SELECT run_id, sum(c) AS s, bool_or(c IS NULL) AS u, count(*) AS n FROM (SELECT run_id || '/' || k%16 AS run_id, CASE WHEN cache_hit THEN 0 WHEN cost_usd > 0 THEN cost_usd ELSE round(est, 8) END AS c FROM estimated) GROUP BY 1)""", "estimated"))
def _(v):
    x = v.extractions(0).withColumn("run_id", F.concat("run_id", F.lit("/"), (F.col("k") % 16).cast("string")))
    out = P.run_cost(x, None, P.price_table(v.spark))
    return rounded(out, "cost_usd", "cost_per_document", digits=8)
