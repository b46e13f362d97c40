"""Queries: sampling, splits, snapshots, fingerprints and coverage."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..functions import text as T
from .q_catalog import truth_docs
from .registry import query
from .sql import CTES, sql


@query("hash_sample", sql("SELECT document_id, row_number() OVER (ORDER BY sha256('s1' || sha256)) AS sample_rank FROM members WHERE list_contains(tags, 'en') OR list_contains(tags, 'p1') ORDER BY sample_rank LIMIT 200", "members"))
def _(v):
    return B.hash_sample(v.members, 200, "s1", ["en", "p1"]).select("document_id", "sample_rank")


@query("stratified_split", sql("""SELECT document_id, lang AS stratum, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT *, CAST(round_even(n_all*(0.7::DOUBLE/1.0::DOUBLE), 0) AS BIGINT) AS a, CAST(round_even(n_all*(0.2::DOUBLE/1.0::DOUBLE), 0) AS BIGINT) AS b FROM (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('s2' || sha256)) AS rn, count(*) OVER (PARTITION BY lang) AS n_all FROM members))""", "members"))
def _(v):
    return B.stratified_split(v.members, {"train": 0.7, "validation": 0.2, "test": 0.1}, "s2", "lang")


@query("ordered_split", sql("""SELECT document_id, CASE WHEN i >= b2 THEN 'test' WHEN i >= b1 THEN 'validation' ELSE 'train' END AS split FROM (
 SELECT *, greatest(1, CAST(round_even(n_all*0.8::DOUBLE, 0) AS BIGINT)) AS b1, greatest(greatest(1, CAST(round_even(n_all*0.8::DOUBLE, 0) AS BIGINT)) + 1, CAST(round_even(n_all*(0.8::DOUBLE+0.1::DOUBLE), 0) AS BIGINT)) AS b2 FROM (
 SELECT document_id, row_number() OVER (ORDER BY sha256) - 1 AS i, count(*) OVER () AS n_all FROM members))""", "members"))
def _(v):
    return B.ordered_split(v.members, {"train": 0.8, "validation": 0.1, "test": 0.1})


CTES["lab"] = ((), "SELECT 'd' || doc_id AS document_id, 'title ' || doc_id AS title, quality = 1 AS positive FROM labels")


def lab(v):
    d = F.col("doc_id").cast("string")
    return v.table("labels").select(F.concat(F.lit("d"), d).alias("document_id"), F.concat(F.lit("title "), d).alias("title"), (F.col("quality") == 1).alias("positive"))


@query("balanced_holdout_select", sql("""SELECT document_id, positive, rank, CASE WHEN rank <= 2 THEN 'test' ELSE 'dev' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY positive ORDER BY sha256('["b-seed","' || title || '"]')) AS rank FROM lab) WHERE rank <= 6""", "lab"))
def _(v):
    return B.balanced_holdout_select(lab(v), 12, 4, "b-seed").select("document_id", "positive", "rank", "split")


@query("family_disjoint_holdout", sql("""SELECT document_id, family, CASE WHEN list_contains(taken, family) THEN 'test' ELSE 'dev' END AS split FROM docs CROSS JOIN (
 SELECT list_reduce(list_prepend({'left': 40::BIGINT, 'size': 0::BIGINT, 'family': '', 'taken': []::VARCHAR[]}, list({'left': 0::BIGINT, 'size': size, 'family': family, 'taken': []::VARCHAR[]} ORDER BY key)),
  lambda a, f: CASE WHEN f.size <= a.left THEN {'left': a.left - f.size, 'size': 0::BIGINT, 'family': '', 'taken': list_append(a.taken, f.family)} ELSE a END).taken AS taken FROM (
  SELECT family, count(*) AS size, sha256('["fam-v1","' || family || '"]') AS key FROM docs GROUP BY 1)) g""", "docs"))
def _(v):
    return B.family_disjoint_holdout(v.docs, 40, "fam-v1").select("document_id", "family", "split")


def truth_values(v):
    return truth_docs(v).withColumn("value_json", F.concat(F.lit('{"b": '), F.col("revision").cast("string"), F.lit(', "a": "'), F.col("document_id"), F.lit('"}')))


CTES["snap"] = (("members", "dtruth"), """SELECT m.dataset_id, m.document_id, m.sha256, t.revision, CASE WHEN t.revision IS NOT NULL THEN '{"a":"' || m.document_id || '","b":' || t.revision || '}' END AS value_json, t.annotation_status
 FROM members m LEFT JOIN (SELECT * FROM dtruth d WHERE revision = (SELECT max(revision) FROM dtruth e WHERE e.document_id = d.document_id)) t USING (document_id)""")


@query("benchmark_snapshot", sql("SELECT dataset_id, document_id, sha256, revision, value_json, annotation_status FROM snap", "snap"))
def _(v):
    from ..functions import jsonvals as J
    return B.benchmark_snapshot(v.members, truth_values(v)).withColumn("value_json", J.canonical(F.col("value_json")))


@query("benchmark_fingerprint", sql("""SELECT dataset_id, sha256(string_agg(d, '' ORDER BY p)) AS fingerprint, CAST(sum(n) AS BIGINT) AS documents FROM (SELECT dataset_id, substr(b, 1, 3) AS p, sha256(string_agg(d, '' ORDER BY b)) AS d, sum(n) AS n FROM (
 SELECT dataset_id, substr(sha256(document_id), 1, 6) AS b, count(*) AS n, sha256(string_agg(sha256(document_id || '|' || sha256 || '|' || coalesce(CAST(revision AS VARCHAR), '') || '|' || coalesce(value_json, '') || '|' || coalesce(annotation_status, '')), '' ORDER BY document_id)) AS d FROM snap GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""", "snap"))
def _(v):
    return B.benchmark_fingerprint(B.benchmark_snapshot(v.members, truth_values(v)))


# QA labels derived from order fields: raw answers of several shapes.
ANSWER_SQL = """CASE f WHEN 1 THEN CASE k%3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' ELSE '' END WHEN 2 THEN CASE k%4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN '' ELSE '[]/[]/2020' END
 WHEN 3 THEN CASE k%3 WHEN 0 THEN 'Perpetual' WHEN 1 THEN '2/30/2020' ELSE strftime(o_orderdate, '%Y-%m-%d') END ELSE CASE k%5 WHEN 0 THEN '' ELSE ' ' || o_orderpriority || ' ' END END"""
CTES["qa"] = ((), f"""SELECT *, {ANSWER_SQL} AS raw, k%2 = 0 AS is_impossible, CASE WHEN k%2 = 0 THEN 0 ELSE 1 END AS n_answers FROM (SELECT o_orderkey AS k, 'o' || o_orderkey AS document_id, o_orderdate, o_orderpriority, f,
 CASE f WHEN 1 THEN 'termination_for_convenience' WHEN 2 THEN 'effective_date' WHEN 3 THEN 'expiration_date' ELSE 'renewal_term' END AS field_path FROM orders CROSS JOIN (VALUES (1),(2),(3),(4)) x(f))""")
CTES["qa_out"] = (("qa",), """SELECT document_id, field_path, raw AS raw_answer, CASE WHEN f = 1 THEN trim(raw) <> '' WHEN trim(raw) = '' THEN is_impossible WHEN f IN (2,3) THEN lower(trim(raw)) = 'perpetual' OR iso IS NOT NULL ELSE true END AS included,
 CASE WHEN f = 1 THEN CASE lower(trim(raw)) WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' END WHEN trim(raw) = '' THEN CASE WHEN is_impossible THEN 'null' END
  WHEN f = 3 AND lower(trim(raw)) = 'perpetual' THEN '"perpetual"' WHEN f IN (2,3) THEN '"' || iso || '"' ELSE '"' || trim(raw) || '"' END AS value_json,
 CASE WHEN f = 1 THEN CASE WHEN trim(raw) <> '' THEN 'human_binary_answer' ELSE 'missing_binary_answer' END WHEN trim(raw) = '' THEN CASE WHEN is_impossible THEN 'no_annotated_clause' ELSE 'clause_present_but_normalized_answer_missing' END
  WHEN f = 3 AND lower(trim(raw)) = 'perpetual' THEN 'human_answer' WHEN f IN (2,3) THEN CASE WHEN iso IS NOT NULL THEN 'complete_date_to_iso' ELSE 'partial_or_non_single_date' END ELSE 'human_answer' END AS reason
 FROM (SELECT *, strftime(CASE WHEN regexp_full_match(trim(raw), '\\d+/\\d+/\\d\\d') THEN try_strptime(trim(raw), '%m/%d/%y') ELSE try_strptime(trim(raw), ['%m/%d/%Y','%Y-%m-%d']) END, '%Y-%m-%d') AS iso FROM qa)""")


def qa(v):
    k, f = F.col("k"), F.col("f")
    d = lambda p: F.date_format("o_orderdate", p)
    raw = (F.when(f == 1, F.when(k % 3 == 0, "Yes").when(k % 3 == 1, " no").otherwise(""))
           .when(f == 2, F.when(k % 4 == 0, d("MM/dd/yy")).when(k % 4 == 1, d("MM/dd/yyyy")).when(k % 4 == 2, "").otherwise("[]/[]/2020"))
           .when(f == 3, F.when(k % 3 == 0, "Perpetual").when(k % 3 == 1, "2/30/2020").otherwise(d("yyyy-MM-dd")))
           .otherwise(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))))
    names = F.element_at(F.array(*[F.lit(n) for n in ("termination_for_convenience", "effective_date", "expiration_date", "renewal_term")]), f)
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", "o_orderpriority", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("f"))
    return o.select(F.concat(F.lit("o"), k.cast("string")).alias("document_id"), names.alias("field_path"), names.alias("column_key"), raw.alias("raw"),
                    (k % 2 == 0).alias("is_impossible"), F.when(k % 2 == 0, 0).otherwise(1).alias("n_answers"))


def qa_truth(v):
    q = qa(v)
    return B.qa_truth_build(q.select("document_id", "column_key", "is_impossible", "n_answers"), q.select("document_id", "column_key", "field_path", "raw"))


@query("qa_truth_build", sql("SELECT * FROM qa_out", "qa_out"))
def _(v):
    return qa_truth(v)


@query("normalize_answer", sql("SELECT field_path, reason, included, count(*) AS n, count(DISTINCT value_json) AS distinct_values FROM qa_out GROUP BY ALL", "qa_out"))
def _(v):
    q = qa(v).withColumn("a", T.normalize_answer(F.col("field_path"), F.col("raw"), F.col("is_impossible"), F.col("n_answers")))
    return q.groupBy("field_path", F.col("a.reason").alias("reason"), F.col("a.included").alias("included")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("a.value_json").alias("distinct_values"))


@query("field_coverage", sql("""SELECT field_path, count(*) FILTER (included) AS scored, count(*) FILTER (included AND value_json NOT IN ('null','false')) AS positive,
 count(*) FILTER (included AND value_json IN ('null','false')) AS negative, (SELECT count(*) FROM orders) - count(*) FILTER (included) AS unscored FROM qa_out GROUP BY 1""", "qa_out"))
def _(v):
    return B.field_coverage(v.documents, qa_truth(v))


@query("coverage_report", sql("SELECT field_path, reason, count(*) AS documents FROM qa_out GROUP BY 1, 2", "qa_out"))
def _(v):
    return B.reason_histogram(v.documents, qa_truth(v))


@query("cohort_coverage", sql("""SELECT field, count(*) FILTER (c AND vj) AS real_value_targets, count(*) FILTER (c) AS real_status_targets, count(*) FILTER (NOT c AND vj) AS regression_value_targets, count(*) FILTER (NOT c) AS regression_status_targets
 FROM (SELECT field_path AS field, k%4 <> 0 AS c, value_json <> 'null' AS vj FROM truth) GROUP BY 1""", "truth"))
def _(v):
    t = v.truth.select(F.col("field_path").alias("field"), F.when(F.col("k") % 4 != 0, "real").otherwise("regression").alias("cohort"),
                       F.when(F.col("value_json") != "null", F.col("value_json")).alias("value_json"), F.lit('"extracted"').alias("status_json"))
    return B.cohort_coverage(t, ["real", "regression"])


@query("review_queue_unscored", sql("""SELECT document_id, string_agg(field_path, ',' ORDER BY field_path) AS unscored_fields FROM base b
 WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.document_id = b.document_id AND t.field_path = b.field_path) GROUP BY 1""", "base", "truth"))
def _(v):
    return B.review_queue_unscored(v.documents, v.leaves, v.truth).withColumn("unscored_fields", F.array_join("unscored_fields", ","))


@query("clone_dataset", sql("SELECT 'copy' AS dataset_id, document_id, array_to_string(tags, ',') AS tags FROM members WHERE dataset_id = 'src5'", "members"))
def _(v):
    return B.clone_dataset(v.members, "src5", "copy").select("dataset_id", "document_id", F.array_join("tags", ",").alias("tags"))


@query("dataset_split_overview", sql("SELECT CASE WHEN CAST(substr(document_id, 2) AS BIGINT)%4 = 0 THEN 'test' ELSE 'dev' END AS split, count(*) AS documents, count(*) FILTER (positive) AS positive FROM lab GROUP BY 1", "lab"))
def _(v):
    m = lab(v).withColumn("split", F.when(F.substring("document_id", 2, 20).cast("long") % 4 == 0, "test").otherwise("dev"))
    return B.dataset_split_overview(m)
