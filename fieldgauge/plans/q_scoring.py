"""Queries: scoring, run metrics, comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C, scoring as S
from ..schema import ScoringConfig
from .registry import query
from .sql import CTES, pred_cte, scored_cte, sql

pred_cte(0), pred_cte(1)
S0, S1 = scored_cte(0), scored_cte(1)
TOL, EDIT = scored_cte(0, tol="0.01"), scored_cte(0, edit=1)
BOTH = scored_cte(0, tol="0.01", edit=1)
COUNTS_SQL = """count(*) AS scored_fields, count(*) FILTER (status = 'correct') AS correct_fields,
 count(*) FILTER (match_type = 'exact') AS exact_matches, count(*) FILTER (match_type IN ('normalized','numeric_tolerance')) AS normalized_matches,
 count(*) FILTER (match_type = 'edit_distance') AS edit_distance_matches, count(*) FILTER (status = 'incorrect') AS incorrect_predictions,
 count(*) FILTER (status = 'missing') AS missing_fields, count(*) FILTER (status = 'hallucinated') AS hallucinated_fields,
 count(*) FILTER (status = 'validation_failed') AS validation_failures, count(*) FILTER (status <> 'correct') AS failure_count"""
RATES_SQL = """round(correct_fields/scored_fields::DOUBLE, 6) AS field_accuracy,
 round(correct_fields/nullif(correct_fields+incorrect_predictions+hallucinated_fields+validation_failures, 0)::DOUBLE, 6) AS "precision",
 round(correct_fields/nullif(correct_fields+incorrect_predictions+missing_fields+validation_failures, 0)::DOUBLE, 6) AS recall,
 round((scored_fields-missing_fields)/scored_fields::DOUBLE, 6) AS field_completeness"""
RATES = ("field_accuracy", "precision", "recall", "field_completeness")


def scored(v, r=0, config=ScoringConfig()):
    return S.score_fields(v.truth, v.pred(r), v.leaves, config, v.extractions(r))


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


@query("pair_fields", sql("""SELECT 'run-0' AS run_id, t.document_id, t.field_path, t.value_json AS expected_json, p.value_json, p.normalized_json, p.confidence
 FROM truth t LEFT JOIN pred0 p ON p.document_id = t.document_id AND p.field_path = t.field_path WHERE t.annotation_status <> 'unverified'""", "truth", "pred0"))
def _(v):
    return S.pair_fields(S.annotated_paths(v.truth, v.leaves), v.pred(0), v.extractions(0)).drop("expected_present")


@query("pair_fields_full", sql("""SELECT coalesce(t.document_id, p.document_id) AS document_id, coalesce(t.field_path, p.field_path) AS field_path,
 t.value_json AS expected_json, p.value_json AS value_json FROM truth t FULL JOIN pred0 p ON p.document_id = t.document_id AND p.field_path = t.field_path""", "truth", "pred0"))
def _(v):
    t = v.truth.select("document_id", "field_path", F.col("value_json").alias("expected_json"))
    return t.join(v.pred(0).select("document_id", "field_path", "value_json"), ["document_id", "field_path"], "full")


STATUS_COLS = ["run_id", "document_id", "field_path", "status", "match_type", "score", "expected_json", "actual_json",
               "normalized_expected", "normalized_actual", "confidence", "failure_type"]


@query("field_status", sql(f"SELECT {', '.join(STATUS_COLS)}, validation_errors FROM {S0}", S0))
def _(v):
    return scored(v).select(*STATUS_COLS, F.array_join("validation_errors", "; ").alias("validation_errors"))


@query("match_type", sql(f"SELECT field_path, status, match_type, count(*) AS n FROM {BOTH} GROUP BY ALL", BOTH))
def _(v):
    s = scored(v, config=ScoringConfig(numeric_tolerance="0.01", edit_distance_max=1))
    return s.groupBy("field_path", "status", "match_type").agg(F.count(F.lit(1)).alias("n"))


@query("numeric_tolerance_match", sql(f"SELECT document_id, field_path, expected_json, actual_json FROM {TOL} WHERE match_type = 'numeric_tolerance'", TOL))
def _(v):
    s = scored(v, config=ScoringConfig(numeric_tolerance="0.01"))
    return s.where("match_type = 'numeric_tolerance'").select("document_id", "field_path", "expected_json", "actual_json")


@query("edit_distance_match", sql(f"SELECT document_id, field_path, expected_json, actual_json FROM {EDIT} WHERE match_type = 'edit_distance'", EDIT))
def _(v):
    s = scored(v, config=ScoringConfig(edit_distance_max=1))
    return s.where("match_type = 'edit_distance'").select("document_id", "field_path", "expected_json", "actual_json")


@query("annotated_paths", sql("""SELECT document_id, field_path, max(present) AS expected_present, max(e) AS expected_json FROM (
 SELECT document_id, field_path, true AS present, value_json AS e FROM truth WHERE annotation_status <> 'unverified'
 UNION ALL SELECT DISTINCT document_id, 'total', false, NULL FROM truth WHERE annotation_status <> 'unverified'
 UNION ALL SELECT DISTINCT document_id, 'note', false, NULL FROM truth WHERE annotation_status <> 'unverified' AND k%50 = 1) GROUP BY 1, 2""", "truth"))
def _(v):
    extra = v.documents.where("k % 50 = 1").select(F.lit("run-0").alias("run_id"), "document_id", F.lit("note").alias("field_path"), F.lit('"x"').alias("value_json"))
    p = v.pred(0).select("run_id", "document_id", "field_path", "value_json").unionByName(extra)
    return S.annotated_paths(v.truth, v.leaves, ScoringConfig(required_fields=("total",), include_hallucinations=True), p)


@query("unscored_documents", sql("""SELECT e.run_id, e.document_id, CASE WHEN u THEN 'ground_truth_unverified' ELSE 'ground_truth_missing' END AS reason FROM extractions0 e
 LEFT JOIN (SELECT document_id, bool_or(annotation_status = 'unverified') AS u FROM truth GROUP BY 1) t USING (document_id) WHERE u IS NULL OR u""", "extractions0", "truth"))
def _(v):
    return S.unscored_documents(v.extractions(0), v.truth, v.leaves)


@query("document_metrics", sql(f"""SELECT *, {RATES_SQL}, CAST(CASE WHEN failure_count = 0 THEN 1 ELSE 0 END AS INTEGER) AS document_accuracy
 FROM (SELECT run_id, document_id, {COUNTS_SQL}, round(avg(confidence), 6) AS average_confidence FROM {S0} GROUP BY 1, 2)""", S0))
def _(v):
    return rounded(S.document_metrics(scored(v)).drop("f1"), *RATES, "average_confidence")


RUN_SQL = f"""SELECT run_id, count(*) AS scored_documents, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in S.COUNTS)},
 count(*) FILTER (failure_count = 0) AS perfect_documents, avg(c) AS average_confidence
 FROM (SELECT run_id, document_id, {COUNTS_SQL}, round(avg(confidence), 4) AS c FROM %s GROUP BY 1, 2) GROUP BY 1"""


@query("run_metrics", sql(f"""SELECT x.* EXCLUDE (average_confidence), {RATES_SQL}, round(perfect_documents/scored_documents::DOUBLE, 6) AS document_accuracy,
 round(average_confidence, 4) AS average_confidence, d.documents, d.documents - scored_documents AS unscored_documents
 FROM ({RUN_SQL % S0} UNION ALL {RUN_SQL % S1}) x CROSS JOIN (SELECT count(*) AS documents FROM orders) d""", S0, S1))
def _(v):
    both = scored(v, 0).unionByName(scored(v, 1))
    m = S.run_metrics(both, v.extractions(0).unionByName(v.extractions(1))).drop("f1")
    return rounded(rounded(m, *RATES, "document_accuracy"), "average_confidence", digits=4)


@query("field_metrics", sql(f"""SELECT run_id, field_path, count(*) AS documents, count(*) FILTER (status = 'correct') AS correct,
 count(*) FILTER (status <> 'correct') AS failures, round(count(*) FILTER (status = 'correct')/count(*)::DOUBLE, 6) AS accuracy FROM {S0} GROUP BY 1, 2""", S0))
def _(v):
    return rounded(S.field_metrics(scored(v)), "accuracy")


@query("failure_counts", sql(f"""SELECT run_id, field_path, failures, round(failures/sum(failures) OVER ()::DOUBLE, 6) AS share,
 CAST(row_number() OVER (ORDER BY failures DESC, field_path) AS INTEGER) AS rank
 FROM (SELECT run_id, field_path, count(*) AS failures FROM {S0} WHERE status <> 'correct' GROUP BY 1, 2)""", S0))
def _(v):
    return rounded(S.failure_counts(scored(v)), "share")


@query("preview_score", sql(f"SELECT field_path, status, count(*) AS n FROM {S0} GROUP BY 1, 2", S0))
def _(v):
    """All fields of a candidate that belongs to no run, scored against the truth of the documents that it answers."""
    candidate = v.pred(0).withColumn("run_id", F.lit("preview"))
    s = S.score_fields(v.truth, candidate, v.leaves)
    return s.groupBy("field_path", "status").agg(F.count(F.lit(1)).alias("n"))


CTES["outcomes"] = ((), """SELECT 'run-' || r AS run_id, 'o' || o_orderkey AS document_id, CASE WHEN o_orderkey%40 = 3 AND r = 0 THEN 'failed' ELSE 'completed' END AS status
 FROM orders CROSS JOIN (VALUES (0),(1)) x(r)""")


def outcomes(v):
    runs = F.explode(F.array(F.lit("run-0"), F.lit("run-1")))
    return (v.documents.select("k", "document_id", runs.alias("run_id"))
            .select("run_id", "document_id", F.when((F.col("k") % 40 == 3) & (F.col("run_id") == "run-0"), "failed").otherwise("completed").alias("status")))


@query("run_execution_metrics", sql(f"""SELECT o.*, x.*  EXCLUDE (run_id), round(total_cost_usd/documents, 8) AS cost_per_document, perfect_documents,
 round(total_cost_usd/greatest(perfect_documents, 1), 8) AS cost_per_correct_document FROM
 (SELECT run_id, count(*) AS documents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM outcomes GROUP BY 1) o
 JOIN (SELECT run_id, count(*) AS results, round(avg(latency_ms), 4) AS average_latency_ms, round(sum(coalesce(cost_usd, 0)), 6) AS total_cost_usd,
  count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses, quantile_disc(latency_ms, 0.95) AS p95_latency_ms
  FROM (SELECT * FROM extractions0 UNION ALL SELECT * FROM extractions1) GROUP BY 1) x ON x.run_id = o.run_id
 JOIN (SELECT run_id, count(*) FILTER (fc = 0) AS perfect_documents FROM (SELECT run_id, document_id, count(*) FILTER (status <> 'correct') AS fc FROM
  (SELECT run_id, document_id, status FROM {S0} UNION ALL SELECT run_id, document_id, status FROM {S1}) GROUP BY 1, 2) GROUP BY 1) m ON m.run_id = o.run_id""",
                                    "outcomes", "extractions0", "extractions1", S0, S1))
def _(v):
    x = v.extractions(0).unionByName(v.extractions(1))
    m = S.run_metrics(scored(v, 0).unionByName(scored(v, 1)))
    out = S.run_execution_metrics(x, outcomes(v), m)
    return rounded(rounded(rounded(out, "average_latency_ms", digits=4), "total_cost_usd"), "cost_per_document", "cost_per_correct_document", digits=8)


@query("run_status", sql("""SELECT run_id, completed, failed, CASE WHEN failed = 0 THEN 'completed' WHEN completed > 0 THEN 'completed_with_failures' ELSE 'failed' END AS status
 FROM (SELECT run_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM outcomes GROUP BY 1)""", "outcomes"))
def _(v):
    nobody = v.runs.where("status = 'cancelling'").select("run_id")
    return S.run_status(outcomes(v), nobody)


# ---- comparison -----------------------------------------------------------------------------------
CTES["changes"] = ((S0, S1), f"""
SELECT coalesce(b.document_id, c.document_id) AS document_id, coalesce(b.field_path, c.field_path) AS field_path, b.status AS baseline_status,
 b.actual_json AS baseline_json, c.status AS candidate_status, c.actual_json AS candidate_json,
 CASE WHEN b.status IS NOT DISTINCT FROM 'correct' AND c.status IS DISTINCT FROM 'correct' THEN 'regressed'
  WHEN b.status IS DISTINCT FROM 'correct' AND c.status IS NOT DISTINCT FROM 'correct' THEN 'improved' ELSE 'unchanged' END AS classification,
 CASE WHEN b.status IS NULL AND c.status <> 'correct' THEN 'new_failure' WHEN b.status <> 'correct' AND c.status = 'correct' THEN 'fixed_failure' END AS failure_transition
FROM (SELECT * FROM {S0} WHERE k%31 <> 0) b FULL JOIN (SELECT * FROM {S1} WHERE k%37 <> 0) c ON b.document_id = c.document_id AND b.field_path = c.field_path""")


def two_runs(v):
    """Two scored runs of which each lacks some documents."""
    num = F.substring("document_id", 2, 20).cast("long")
    return scored(v, 0).where(num % 31 != 0), scored(v, 1).where(num % 37 != 0)


@query("compare_fields", sql("SELECT * FROM changes", "changes"))
def _(v):
    return C.compare_fields(*two_runs(v))


CTES["doc_changes"] = ((S0, S1), f"""SELECT coalesce(b.document_id, c.document_id) AS document_id,
 CASE WHEN coalesce(b.ok, false) AND NOT coalesce(c.ok, false) THEN 'regressed' WHEN NOT coalesce(b.ok, false) AND coalesce(c.ok, false) THEN 'improved' ELSE 'unchanged' END AS classification,
 CASE WHEN b.ok IS NULL AND NOT c.ok THEN 'new_failure' WHEN NOT b.ok AND c.ok THEN 'fixed_failure' END AS failure_transition FROM
 (SELECT document_id, bool_and(status = 'correct') AS ok FROM {S0} WHERE k%31 <> 0 GROUP BY 1) b FULL JOIN
 (SELECT document_id, bool_and(status = 'correct') AS ok FROM {S1} WHERE k%37 <> 0 GROUP BY 1) c ON b.document_id = c.document_id""")


@query("compare_documents", sql("SELECT * FROM doc_changes", "doc_changes"))
def _(v):
    return C.compare_documents(*two_runs(v))


@query("compare_summary", sql("""SELECT count(*) FILTER (classification = 'improved') AS improved, count(*) FILTER (classification = 'regressed') AS regressed,
 count(*) FILTER (classification = 'unchanged') AS unchanged, count(*) FILTER (failure_transition = 'new_failure') AS new_failure,
 count(*) FILTER (failure_transition = 'fixed_failure') AS fixed_failure FROM changes""", "changes"))
def _(v):
    return C.compare_summary(C.compare_fields(*two_runs(v)))


@query("metric_delta_gate", sql(f"""SELECT metric, round(b, 6) AS baseline, round(c, 6) AS candidate, round(c - b, 6) AS delta, c - b < -0.001 AS violates FROM (
 SELECT 'field_accuracy' AS metric, b.correct_fields/b.scored_fields::DOUBLE AS b, c.correct_fields/c.scored_fields::DOUBLE AS c FROM b, c
 UNION ALL SELECT 'document_accuracy', b.perfect_documents/b.scored_documents::DOUBLE, c.perfect_documents/c.scored_documents::DOUBLE FROM b, c
 UNION ALL SELECT 'precision', b.p, c.p FROM b, c UNION ALL SELECT 'recall', b.r, c.r FROM b, c UNION ALL SELECT 'f1', 2*b.p*b.r/(b.p+b.r), 2*c.p*c.r/(c.p+c.r) FROM b, c
 UNION ALL SELECT 'field_completeness', (b.scored_fields-b.missing_fields)/b.scored_fields::DOUBLE, (c.scored_fields-c.missing_fields)/c.scored_fields::DOUBLE FROM b, c)""", S0, S1)
       .replace("\nSELECT metric", ",\n" + ",\n".join(
           f"{n} AS (SELECT *, correct_fields/(correct_fields+incorrect_predictions+hallucinated_fields+validation_failures)::DOUBLE AS p, correct_fields/(correct_fields+incorrect_predictions+missing_fields+validation_failures)::DOUBLE AS r FROM ({RUN_SQL % s}))"
           for n, s in (("b", S0), ("c", S1))) + "\nSELECT metric"))
def _(v):
    g = C.metric_delta_gate(S.run_metrics(scored(v, 0)), S.run_metrics(scored(v, 1)), 0.001)
    return rounded(g, "baseline", "candidate")


CTES["cells"] = ((S0, S1), f"""SELECT document_id, field_path, b.expected_json, b.actual_json AS before_json, c.actual_json AS after_json, b.status AS before_status, c.status AS after_status,
 CASE WHEN b.status <> 'correct' AND c.status = 'correct' THEN 'fixed' WHEN b.status = 'correct' AND c.status <> 'correct' THEN 'regressed' ELSE 'same' END AS change
 FROM {S0} b JOIN {S1} c USING (document_id, field_path)""")


@query("paired_inner_guarded", sql(f"""SELECT violation, change, count(*) AS n FROM (
 SELECT CASE WHEN b.status IS NULL OR c.status IS NULL THEN 'coverage_changed' END AS violation,
 CASE WHEN b.status <> 'correct' AND c.status = 'correct' THEN 'fixed' WHEN b.status = 'correct' AND c.status <> 'correct' THEN 'regressed' ELSE 'same' END AS change
 FROM (SELECT * FROM {S0} WHERE k%31 <> 0) b FULL JOIN (SELECT * FROM {S1} WHERE k%37 <> 0) c ON b.document_id = c.document_id AND b.field_path = c.field_path) GROUP BY ALL""", S0, S1))
def _(v):
    return C.paired_inner_guarded(*two_runs(v)).groupBy("violation", "change").agg(F.count(F.lit(1)).alias("n"))


@query("paired_compare", sql("""SELECT field_path, count(*) AS scored, count(*) FILTER (change = 'fixed') AS fixed, count(*) FILTER (change = 'regressed') AS regressed,
 count(*) FILTER (change = 'fixed') - count(*) FILTER (change = 'regressed') AS net FROM cells GROUP BY 1""", "cells"))
def _(v):
    return C.paired_compare(C.paired_inner_guarded(scored(v, 0), scored(v, 1), strict=True))


@query("paired_examples", sql("""SELECT * FROM (SELECT change, document_id, field_path, before_json, after_json,
 CAST(row_number() OVER (PARTITION BY change ORDER BY document_id, field_path) AS INTEGER) AS rank FROM cells WHERE change <> 'same') WHERE rank <= 12""", "cells"))
def _(v):
    e = C.paired_examples(C.paired_cells(scored(v, 0), scored(v, 1)))
    return e.select("change", "document_id", "field_path", "before_json", "after_json", "rank")


GATE_SQL = """SELECT *, greatest(1, CAST(ceil(scored*0.002 - 1e-9) AS BIGINT)) AS required_net, net >= greatest(1, CAST(ceil(scored*0.002 - 1e-9) AS BIGINT)) AND regressed <= 4000 AS passed FROM (
 SELECT count(*) AS scored, count(*) FILTER (change = 'fixed') AS fixed, count(*) FILTER (change = 'regressed') AS regressed,
 count(*) FILTER (change = 'fixed') - count(*) FILTER (change = 'regressed') AS net,
 round((count(*) FILTER (change = 'fixed') - count(*) FILTER (change = 'regressed'))/count(*)::DOUBLE, 8) AS gain FROM cells)"""


@query("acceptance_gate", sql(GATE_SQL, "cells"))
def _(v):
    t = C.paired_totals(C.paired_cells(scored(v, 0), scored(v, 1)))
    return rounded(C.acceptance_gate(t, 0.002, 4000), "gain", digits=8)


@query("baseline_drift", sql(f"""SELECT count(*) AS scored, count(*) FILTER (b.status <> 'correct' AND c.status = 'correct') AS fixed,
 count(*) FILTER (b.status = 'correct' AND c.status <> 'correct') AS regressed FROM {S0} b JOIN {TOL} c USING (document_id, field_path)""", S0, TOL))
def _(v):
    control = scored(v, 0, ScoringConfig(numeric_tolerance="0.01"))
    return C.paired_totals(C.paired_cells(scored(v, 0), control)).select("scored", "fixed", "regressed")


@query("scored_cells", sql(f"SELECT run_id, document_id, field_path, count(*) AS n, count(*) > 1 AS duplicate FROM (SELECT * FROM {S0} UNION ALL SELECT * FROM {S0} WHERE k%100 = 1) GROUP BY 1, 2, 3", S0))
def _(v):
    s = scored(v)
    return C.scored_cells(s.unionByName(s.where(F.substring("document_id", 2, 20).cast("long") % 100 == 1)))
