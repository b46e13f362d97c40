"""Queries: files in, files out. Inputs are written from the tables to the shared work folder first."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J, text as T
from ..operators import benchmark as B
from ..session import materialized, work_path
from ..sources import annotations as A, ingest as I, manifest as M, reports as R
from .q_catalog import docmeta, truth_docs
from .q_scoring import S0, scored, rounded
from .registry import query
from .sql import CTES, dectext, num, sql


@query("ingest_documents", """SELECT 'b' || g || '.txt' AS filename, sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256, CAST(octet_length(encode(string_agg(text, chr(10) ORDER BY doc_id) || chr(10))) AS BIGINT) AS size_bytes, 'text/plain' AS mime_type, 1 AS page_count
 FROM (SELECT doc_id, replace(text, chr(13), ' ') AS text, doc_id//25 AS g FROM documents) GROUP BY g""")
def _(v):
    # Files of 25 documents each, in document order.
    path = work_path(v.spark, "files")
    d = v.table("documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit(" ")).alias("text"), F.floor(F.col("doc_id") / 25).alias("g"))
    d.repartition("g").sortWithinPartitions("g", "doc_id").select("text", "g").write.partitionBy("g").text(path)
    files = I.ingest_documents(v.spark, path, "*.txt")
    name = F.concat(F.lit("b"), F.regexp_extract("path", r"g=(\d+)/", 1), F.lit(".txt"))
    return files.select(name.alias("filename"), "sha256", F.col("size_bytes").cast("long").alias("size_bytes"), "mime_type", "page_count")


@query("dedup_by_content", sql("SELECT d.document_id, s.survivor_id, d.document_id <> s.survivor_id AS duplicate FROM docs d JOIN (SELECT sha256, arg_min(document_id, n) AS survivor_id FROM docs GROUP BY 1) s USING (sha256)", "docs"))
def _(v):
    return I.dedup_by_content(v.docs.select("document_id", "sha256", "created_at")).select("document_id", "survivor_id", "duplicate")


CTES["bindocs"] = (("docs",), """SELECT document_id, filename, n, CASE WHEN n%6 = 0 THEN 'application/octet-stream' WHEN n%6 = 1 THEN 'image/png' END AS supplied,
 CASE WHEN n%7 = 0 THEN '%PDF-1.4 ' || repeat('/Type /Page x ', CAST(n%5 AS INTEGER)) || '/Type /Pages' WHEN n%7 = 1 THEN '%PDF-1.5 /Linearized 1 /L 10 /N 12 ' ELSE text END AS content FROM docs""")


def binary(v):
    n = F.col("n")
    body = (F.when(n % 7 == 0, F.concat(F.lit("%PDF-1.4 "), F.repeat(F.lit("/Type /Page x "), (n % 5).cast("int")), F.lit("/Type /Pages")))
            .when(n % 7 == 1, "%PDF-1.5 /Linearized 1 /L 10 /N 12 ").otherwise(F.col("text")))
    return v.docs.select("document_id", "filename", F.when(n % 6 == 0, "application/octet-stream").when(n % 6 == 1, "image/png").alias("supplied"), body.cast("binary").alias("content"))


@query("mime_resolution", sql("""SELECT document_id, CASE WHEN contains(substr(content, 1, 1000), '%PDF-') THEN 'application/pdf' WHEN supplied = 'image/png' THEN supplied WHEN n%4 = 0 THEN 'text/plain' WHEN n%4 = 1 THEN 'text/html' WHEN n%4 = 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type FROM bindocs""", "bindocs"))
def _(v):
    return binary(v).select("document_id", I.mime_resolution(F.col("filename"), F.col("supplied"), F.col("content")).alias("mime_type"))


@query("pdf_page_count", sql("SELECT document_id, CAST(CASE WHEN n%7 = 0 THEN greatest(n%5, 1) WHEN n%7 = 1 THEN 12 ELSE 1 END AS INTEGER) AS pages FROM bindocs", "bindocs"))
def _(v):
    return binary(v).select("document_id", I.pdf_page_count(F.col("content")).alias("pages"))


@query("annotations_csv_import", sql(r"""SELECT 'f' || o_orderkey || '.pdf' AS filename, 'total' AS field_path, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '\.?0+$', '') AS value_json FROM orders UNION ALL
 SELECT 'f' || o_orderkey || '.pdf', 'meta.status', '"' || o_orderstatus || '"' FROM orders WHERE o_orderkey%3 <> 0 UNION ALL SELECT 'f' || o_orderkey || '.pdf', 'meta.flag', CASE WHEN o_orderkey%2 = 0 THEN 'null' ELSE 'false' END FROM orders"""))
def _(v):
    path = work_path(v.spark, "csv")
    k = F.col("o_orderkey")
    wide = v.table("orders").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("filename"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("Total"),
                                    F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("Status"), F.when(k % 2 == 0, "null").otherwise("false").alias("Flag"))
    wide.write.option("header", True).csv(path)
    return A.annotations_csv_import(v.spark, path, {"Total": "total", "Status": "meta.status", "Flag": "meta.flag"})


@query("annotations_json_import", """SELECT 'f' || s_suppkey || '.pdf' AS filename, 'name' AS field_path, '"' || s_name || '"' AS value_json FROM supplier UNION ALL SELECT 'f' || s_suppkey || '.pdf', 'where.nation', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def _(v):
    path = work_path(v.spark, "json")
    one = F.concat(F.lit('{"f'), F.col("s_suppkey").cast("string"), F.lit('.pdf": {"name": "'), F.col("s_name"), F.lit('", "where": {"nation": '), F.col("s_nationkey").cast("string"), F.lit("}}}"))
    v.table("supplier").select(one.alias("value")).repartition(64, "value").write.option("maxRecordsPerFile", 1).text(path)
    return A.annotations_json_import(v.spark, path, 2)


@query("annotation_import_checks", """SELECT 'f' || o_orderkey AS filename, 'b.c' AS field_path, 'overlapping' AS problem FROM orders WHERE o_orderkey%10 = 1 UNION ALL SELECT 'f' || o_orderkey, 'a', 'duplicate' FROM orders WHERE o_orderkey%10 = 2
 UNION ALL SELECT 'f' || o_orderkey, 'a', 'no_file' FROM orders WHERE o_orderkey%10 = 3""")
def _(v):
    k = F.col("o_orderkey") % 10
    paths = F.when(k == 1, F.array(F.lit("a"), F.lit("b"), F.lit("b.c"))).when(k == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    a = v.table("orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"), F.explode(paths).alias("field_path"))
    files = v.table("orders").where(k != 3).select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"))
    return A.annotation_import_checks(a, files)


CTES["afiles"] = (("docs",), "SELECT filename, sha256, document_id, n, CASE WHEN n%2 = 0 THEN '{\"a\":' || n%4 || '}' END AS truth_json FROM docs")


def afiles(v):
    n = F.col("n")
    return v.docs.select("filename", "sha256", F.when(n % 2 == 0, F.concat(F.lit('{"a":'), (n % 4).cast("string"), F.lit("}"))).alias("truth_json"), "n")


@query("conflicting_duplicate_annotations", sql("SELECT sha256, count(*) AS files FROM afiles GROUP BY 1 HAVING count(DISTINCT coalesce(truth_json, '-')) > 1", "afiles"))
def _(v):
    return I.conflicting_duplicate_annotations(afiles(v))


@query("import_plan", sql("""SELECT f.filename, m.document_id, m.document_id IS NOT NULL OR f.filename <> x.first AS duplicate, CASE WHEN t.document_id IS NOT NULL THEN 'preserve_existing' WHEN f.truth_json IS NOT NULL THEN 'save' ELSE 'none' END AS annotation_action
 FROM afiles f LEFT JOIN (SELECT * FROM members WHERE n%3 <> 0) m ON m.sha256 = f.sha256 JOIN (SELECT sha256, min(filename) AS first FROM afiles GROUP BY 1) x ON x.sha256 = f.sha256 LEFT JOIN (SELECT DISTINCT document_id FROM dtruth) t ON t.document_id = m.document_id""", "afiles", "members", "dtruth"))
def _(v):
    return I.import_plan(afiles(v), v.members.where("n % 3 <> 0"), truth_docs(v)).drop("sha256")


def manifest_parts(v):
    members = v.members.select("dataset_id", "document_id", F.when(F.col("n") % 3 == 0, "test").alias("split"), F.array(F.concat(F.lit(" "), F.upper("lang")), F.lit("x"), F.lit("X ")).alias("tags"))
    truth = truth_docs(v).withColumn("value_json", F.concat(F.lit('{"rev":'), F.col("revision").cast("string"), F.lit("}")))
    return members, docmeta(v).select("document_id", "filename", "sha256", "mime_type"), truth


MANIFEST_SQL = """SELECT m.dataset_id, m.document_id, d.filename, CASE WHEN m.n%3 = 0 THEN 'test' ELSE 'unspecified' END AS split, t.revision FROM members m JOIN docmeta d USING (document_id)
 LEFT JOIN (SELECT document_id, max(revision) AS revision FROM dtruth GROUP BY 1) t USING (document_id)"""


@query("manifest_export", sql(MANIFEST_SQL, "members", "docmeta", "dtruth"))
def _(v):
    path = work_path(v.spark, "manifest")
    M.manifest_export(*manifest_parts(v), path)
    return v.spark.read.schema(M.MANIFEST).json(path).select("dataset_id", "document_id", "filename", "split", "ground_truth.revision")


@query("manifest_import", sql("""SELECT CASE WHEN CAST(substr(document_id, 2) AS BIGINT)%5 = 4 THEN NULL ELSE document_id END AS document_id, filename, split, lower(x.lang) || ',x' AS tags, CASE WHEN CAST(substr(document_id, 2) AS BIGINT)%5 = 4 THEN 'document_id or sha256 does not match a document' END AS error
 FROM (SELECT m.lang, m.document_id, d.filename, CASE WHEN m.n%3 = 0 THEN 'test' ELSE 'unspecified' END AS split FROM members m JOIN docmeta d USING (document_id)) x""", "members", "docmeta"))
def _(v):
    # A fifth of the entries match by hash only, another fifth by nothing.
    path = work_path(v.spark, "manifest")
    M.manifest_export(*manifest_parts(v), path)
    n = F.substring("document_id", 2, 20).cast("long") % 5
    e = v.spark.read.schema(M.MANIFEST).json(path)
    e = e.select(F.when(n < 3, F.col("document_id")).otherwise(F.lit("gone")).alias("document_id"), F.when(n == 4, "unknown").otherwise(F.col("sha256")).alias("sha256"), "filename", "split", "tags", "ground_truth")
    return M.manifest_import(e, v.members).select("document_id", "filename", "split", F.array_join("tags", ",").alias("tags"), "error")


@query("qa_benchmark_load", """SELECT 'doc ' || doc_id AS title, 'One' AS category, false AS is_impossible, substr(text, CAST(o + 1 AS INTEGER), 40) AS answer, CAST(o AS INTEGER) AS answer_start FROM documents, (VALUES (0), (1), (2)) x(k), LATERAL (SELECT k * (length(text)//3) AS o)
 UNION ALL SELECT 'doc ' || doc_id, 'Two', true, NULL, NULL FROM documents""")
def _(v):
    path = work_path(v.spark, "qa")
    t = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    qa = lambda c, a: F.struct(F.concat(t, F.lit("__" + c)).alias("id"), F.lit(c + "?").alias("question"), F.lit(c == "Two").alias("is_impossible"), a.alias("answers"))
    third = F.floor(F.length("text") / 3).cast("int")
    one = F.array(*[F.struct(F.substring("text", third * k + 1, F.lit(40)).alias("text"), (third * k).alias("answer_start")) for k in range(3)])
    none = F.filter(one, lambda x: F.lit(False))
    d = v.table("documents").select(F.array(F.struct(t.alias("title"), F.array(F.struct(F.col("text").alias("context"), F.array(qa("One", one), qa("Two", none)).alias("qas"))).alias("paragraphs"))).alias("data"))
    d.write.json(path)
    qas = A.qa_benchmark_load(v.spark, path, lines=True)
    return qas.select("title", "category", "is_impossible", F.explode_outer("answers").alias("a")).select("title", "category", "is_impossible", F.col("a.text").alias("answer"), F.col("a.answer_start").cast("int").alias("answer_start"))


@query("qa_benchmark_match", sql("""SELECT title, CASE WHEN n%9 = 0 OR n%11 = 0 THEN 'no exact normalized file or row match' WHEN title <> first THEN 'duplicate content' END AS reason FROM (
 SELECT n, 'T & ' || n AS title, min('T & ' || n) FILTER (n%9 <> 0 AND n%11 <> 0) OVER (PARTITION BY sha256) AS first FROM docs)""", "docs"))
def _(v):
    n = F.col("n")
    title = F.concat(F.lit("T & "), n.cast("string"))
    titles = v.docs.select(title.alias("title"))
    rows = v.docs.where(n % 9 != 0).select(F.concat(F.lit("t _ "), n.cast("string"), F.lit(" -")).alias("row_title"))
    files = v.docs.where(n % 11 != 0).select(F.upper(title).alias("file_title"), "sha256")
    good, out = A.qa_benchmark_match(titles, rows, files)
    return good.select("title", F.lit(None).cast("string").alias("reason")).unionByName(out)


@query("run_report_csv", sql(f"SELECT document_id, field_path, status, expected_json AS expected, actual_json AS actual FROM {S0}", S0))
def _(v):
    path = work_path(v.spark, "report")
    R.run_report_csv(scored(v), path)
    return v.spark.read.option("header", True).option("escape", '"').csv(path).select("document_id", "field_path", "status", "expected", "actual")


@query("run_report", sql(f"""SELECT 1 AS version, 'run-0' AS id, 'completed' AS status, 'pv-1' AS processor_version, 'orders' AS dataset, '{{"numeric_tolerance":null}}' AS scoring_config, d.documents AS scored_documents, field_path, count(*) AS documents,
 count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status <> 'correct') AS failures, round(count(*) FILTER (status = 'correct')/count(*)::DOUBLE, 4) AS accuracy FROM {S0}, (SELECT count(DISTINCT document_id) AS documents FROM {S0}) d GROUP BY d.documents, field_path""", S0))
def _(v):
    path = work_path(v.spark, "report")
    # headers, metrics and failures read the scores: they are made once
    s = materialized(scored(v).select("run_id", "document_id", "field_path", "status", "expected_json", "actual_json", "confidence", "failure_type"), "scored")
    runs = s.select("run_id").distinct().select("run_id", F.lit("completed").alias("status"), F.lit("pv-1").alias("processor_version"), F.lit("orders").alias("dataset"), F.lit('{"numeric_tolerance":null}').alias("scoring_config"))
    R.run_report(s, runs, path, s.groupBy("run_id").agg(F.count_distinct("document_id").alias("scored_documents")))
    kind = ("run_id string, version int, run struct<id:string,status:string>, processor_version string, dataset string, scoring_config string, metrics struct<scored_documents:long>, "
            "field_metrics array<struct<field_path:string,documents:long,correct:long,failures:long,accuracy:double>>")
    m = v.spark.read.schema(kind).json(path + "/summary")
    return m.select("version", "run.id", "run.status", "processor_version", "dataset", "scoring_config", "metrics.scored_documents", F.inline("field_metrics"))


@query("table_store", sql("SELECT run_id, count(*) AS n, count(DISTINCT document_id) AS documents FROM (SELECT run_id, document_id FROM extractions0 UNION ALL SELECT run_id, document_id FROM extractions1) GROUP BY 1", "extractions0", "extractions1"))
def _(v):
    store = R.TableStore(v.spark, work_path(v.spark, "store"))
    for r in (0, 1, 1):  # the second write of run 1 replaces its own partition
        store.replace_partitions("extractions", v.extractions(r))
    return store.read("extractions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents"))
