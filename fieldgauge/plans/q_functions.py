"""Queries: scalar functions, join kinds and set operations over the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J, text as T
from ..functions.sqlfuncs import register_sql_functions
from ..operators import extract as X
from ..operators.validate import with_leaf
from .q_scoring import S0, scored
from .registry import query
from .sql import CTES, canon, cur, dectext, iso, norm, ntext, num, sql, txt

CTES["cells0"] = (("pred0",), f"SELECT document_id, field_path, f, value_json, {txt('value_json')} AS t FROM pred0")


def cells(v):
    return v.pred(0).select("document_id", "field_path", "f", "value_json", J.text(F.col("value_json")).alias("t"))


@query("normal_text", sql(f"SELECT document_id, field_path, {ntext('t')} AS out FROM cells0", "cells0"))
def _(v):
    return cells(v).select("document_id", "field_path", T.normal_text(F.col("t")).alias("out"))


@query("normal_number", sql(f"SELECT document_id, field_path, {dectext(num('t'))} AS out FROM cells0", "cells0"))
def _(v):
    return cells(v).select("document_id", "field_path", T.decimal_text(T.normal_number(F.col("t"))).alias("out"))


@query("normal_currency", sql(f"SELECT document_id, field_path, {cur('t')} AS out FROM cells0", "cells0"))
def _(v):
    return cells(v).select("document_id", "field_path", T.normal_currency(F.col("t")).alias("out"))


@query("normal_date", sql(f"SELECT k, style, coalesce({iso('x')}, lower(x)) AS out FROM dates", "base").replace("WITH ", """WITH dates AS (
 SELECT o_orderkey AS k, style, CASE style WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
 WHEN 4 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 5 THEN strftime(o_orderdate, '%B %d, %Y') ELSE 'Due ' || strftime(o_orderdate, '%Y') END AS x FROM orders CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6)) s(style)),
""", 1))
def _(v):
    d = lambda p: F.date_format("o_orderdate", p)
    styles = F.array(d("yyyy-MM-dd"), d("yyyy/MM/dd"), d("MM/dd/yyyy"), d("MMM dd, yyyy"), d("MMMM dd, yyyy"), F.concat(F.lit("Due "), d("yyyy")))
    x = v.table("orders").select(F.col("o_orderkey").alias("k"), F.posexplode(styles).alias("p", "x"))
    return x.select("k", (F.col("p") + 1).alias("style"), T.normal_date(F.col("x")).alias("out"))


@query("normalize_by_schema", sql(f"SELECT document_id, field_path, {norm('f', 'value_json')} AS out FROM pred0", "pred0"))
def _(v):
    return J.normalize_by_schema(with_leaf(v.pred(0), v.leaves), "value_json", "out").select("document_id", "field_path", "out")


@query("canonical_normalize", sql("SELECT document_id, field_path, normalized_json FROM pred0", "pred0"))
def _(v):
    return v.pred(0).select("document_id", "field_path", "normalized_json")


@query("vote_normalize", sql(rf"""SELECT document_id, field_path, CASE WHEN value_json[1] = '"' THEN coalesce({dectext("try_cast(replace(w, ',', '') AS DECIMAL(38,10))")}, '"' || w || '"') ELSE {canon('value_json')} END AS out
 FROM (SELECT *, {ntext('t')} AS w FROM cells0)""", "cells0"))
def _(v):
    return cells(v).select("document_id", "field_path", J.vote_normalize(F.col("value_json"), F.lit(True), F.lit(True)).alias("out"))


@query("typed_equal", sql(f"""SELECT a.document_id, a.field_path, CASE WHEN a.f = 1 AND a.value_json[1] NOT IN ('"','n') AND b.value_json[1] NOT IN ('"','n') THEN abs(try_cast(a.value_json AS DECIMAL(38,10)) - try_cast(b.value_json AS DECIMAL(38,10))) <= 0.01
 ELSE a.value_json = b.value_json END AS same FROM pred0 a JOIN pred1 b USING (document_id, field_path)""", "pred0", "pred1"))
def _(v):
    b = v.pred(1).select("document_id", "field_path", F.col("value_json").alias("other"))
    j = v.pred(0).join(b, ["document_id", "field_path"])
    tol = F.lit("0.01").cast("decimal(38,10)")
    return j.select("document_id", "field_path", J.typed_equal(J.canonical(F.col("value_json")), J.canonical(F.col("other")), tol).alias("same"))


CTES["objs"] = ((), """SELECT o_orderkey AS k, '{"a":' || o_custkey || ',"b":["' || o_orderstatus || '",' || CASE o_orderkey%3 WHEN 0 THEN '0' WHEN 1 THEN 'false' ELSE '"0"' END || '],"c":{"x":null,"z":1}}' AS out FROM orders""")


def objs(v):
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("k"), F.concat(F.lit('{ "c": {"z": 1.0, "x": null}, "b": ["'), F.col("o_orderstatus"), F.lit('", '),
                                    F.when(k % 3 == 0, "0").when(k % 3 == 1, "false").otherwise('"0"'), F.lit('], "a": '), F.col("o_custkey").cast("string"), F.lit("}")).alias("j"))


@query("canonical_json", sql("SELECT * FROM objs", "objs"))
def _(v):
    return objs(v).select("k", J.canonical(F.col("j")).alias("out"))


@query("content_digest", sql("SELECT k, sha256(out) AS out FROM objs", "objs"))
def _(v):
    return objs(v).select("k", J.digest(F.col("j")).alias("out"))


@query("deep_equal", sql("SELECT k, k%3 = 0 AS same FROM objs", "objs"))
def _(v):
    zero = F.concat(F.lit('{"a": '), F.get_json_object("j", "$.a"), F.lit(', "b": ["'), F.get_json_object("j", "$.b[0]"), F.lit('", 0], "c": {"x": null, "z": 1}}'))
    return objs(v).select("k", (J.canonical(F.col("j")) == J.canonical(zero)).alias("same"))


@query("valid_confidence", "SELECT event_id, CASE WHEN value/50 BETWEEN 0 AND 1 AND event_id%10 <> 0 THEN value/50 END AS confidence FROM events")
def _(v):
    c = F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value") / 50)
    return v.table("events").select("event_id", T.valid_confidence(c).alias("confidence"))


@query("confidence_provenance", """SELECT event_id, c AS confidence, c < 0.9 AS low, CASE WHEN c IS NULL THEN 'Not provided' ELSE CASE WHEN event_type = 'click' THEN 'Model' ELSE 'Rule-based' END || ' ' || CAST(CAST(floor(c*100 + 0.5) AS INTEGER) AS VARCHAR) || '%' END AS label
 FROM (SELECT event_id, event_type, CASE WHEN event_type IN ('click','view') AND value/20 BETWEEN 0 AND 1 THEN value/20 END AS c FROM events)""")
def _(v):
    source = F.when(F.col("event_type") == "click", "model_reported").when(F.col("event_type") == "view", "heuristic").otherwise(F.col("event_type"))
    return (v.table("events").select("event_id", confidence_provenance(F.col("value") / 20, source).alias("p"))
            .select("event_id", "p.confidence", "p.low", "p.label"))


def confidence_provenance(confidence, source):
    from ..operators.consensus import confidence_provenance as provenance
    return provenance(confidence, source)


@query("title_key", r"""SELECT doc_id, trim(regexp_replace(trim(replace(replace(replace(lower(nfc_normalize(t)), 'ß', 'ss'), '&', '_'), '''', '_')), '-+$', '')) AS out FROM (SELECT doc_id, text || ' & Co''s-- ' AS t FROM documents)""")
def _(v):
    t = F.concat("text", F.lit(" & Co's-- "))
    return v.table("documents").select("doc_id", T.title_key(t).alias("out"))


@query("column_key", r"""SELECT doc_id, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') AS out FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", T.column_key(F.col("text")).alias("out"))


@query("compact_text")
def _(v):
    return v.table("documents").select("doc_id", T.compact_text(F.col("text")).alias("out"))


CTES["spans"] = ((), """SELECT o_orderkey AS k, o_orderdate AS d, CASE o_orderkey%5 WHEN 0 THEN 'dated ' || strftime(o_orderdate, '%B %-d, %Y') || '.' WHEN 1 THEN 'the ' || strftime(o_orderdate, '%-d') || 'th day of ' || strftime(o_orderdate, '%B') || ', ' || strftime(o_orderdate, '%Y')
 WHEN 2 THEN 'on ' || strftime(o_orderdate, '%-m/%-d/%y') || ' at' WHEN 3 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'one year after the start' END AS span FROM orders""")


def spans(v):
    d = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey")
    s = (F.when(k % 5 == 0, F.concat(F.lit("dated "), d("MMMM d, yyyy"), F.lit("."))).when(k % 5 == 1, F.concat(F.lit("the "), d("d"), F.lit("th day of "), d("MMMM"), F.lit(", "), d("yyyy")))
         .when(k % 5 == 2, F.concat(F.lit("on "), d("M/d/yy"), F.lit(" at"))).when(k % 5 == 3, F.concat(F.lit("on "), d("yyyy-MM-dd"))).otherwise("one year after the start"))
    return v.table("orders").select(k.alias("k"), "o_orderdate", s.alias("span"))


@query("explicit_date", sql("SELECT k, CASE WHEN k%5 <> 4 THEN strftime(d, '%Y-%m-%d') END AS out FROM spans", "spans"))
def _(v):
    return spans(v).select("k", T.explicit_date(F.date_format("o_orderdate", "MM/dd/yyyy"), F.array(F.lit("no date here"), F.col("span"))).alias("out"))


@query("notice_period", """SELECT o_orderkey AS k, CASE WHEN o_orderkey%7 < 2 THEN NULL ELSE CAST(o_custkey%90 + 1 AS VARCHAR) END AS number,
 CASE o_orderkey%7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'months' WHEN 3 THEN 'business days' WHEN 4 THEN 'calendar days' ELSE 'unclear' END AS unit FROM orders""")
def _(v):
    k = F.col("o_orderkey") % 7
    n = (F.col("o_custkey") % 90 + 1).cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit(" / 180 days"))).when(k == 2, F.concat(n, F.lit(" Months"))).otherwise(F.concat(F.lit(" "), n, F.lit(" days ")))
    span = F.when(k == 1, "within 5 days of the date").when(k == 3, "thirty business  days").when(k == 4, "Calendar days apply").otherwise("prior written notice")
    return v.table("orders").select(F.col("o_orderkey").alias("k"), T.notice_period(raw, F.array(span)).alias("p")).select("k", "p.number", "p.unit")


@query("clean_tags", "SELECT o_orderkey AS k, lower(o_orderpriority) || ',' || lower(o_orderstatus) AS cli, CASE WHEN o_orderpriority < upper(o_orderstatus) THEN o_orderpriority || ',' || o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority END AS api FROM orders")
def _(v):
    tags = F.array(F.concat(F.lit(" "), F.col("o_orderpriority")), F.lit(" "), F.col("o_orderstatus"), F.concat(F.col("o_orderpriority"), F.lit("  ")))
    return v.table("orders").select(F.col("o_orderkey").alias("k"), F.array_join(T.clean_tags_cli(tags), ",").alias("cli"), F.array_join(T.clean_tags_api(tags), ",").alias("api"))


@query("folder_path", "SELECT doc_id, CASE WHEN doc_id%10 = 0 THEN NULL WHEN doc_id%10 = 1 THEN '' ELSE source || '/' || lang || '/' END AS out FROM documents")
def _(v):
    d = F.col("doc_id") % 10
    raw = F.when(d == 0, F.concat(F.col("source"), F.lit("/../x"))).when(d == 1, "/").otherwise(F.concat(F.lit("\\"), F.col("source"), F.lit(" // "), F.col("lang")))
    return v.table("documents").select("doc_id", T.folder_path(raw).alias("out"))


@query("provider_normalize", sql("""SELECT document_id, CASE WHEN k%3 = 0 THEN 'gemini' WHEN k%3 = 1 THEN 'lm-studio' WHEN model LIKE 'claude%' THEN 'anthropic' WHEN model LIKE 'gpt-%' THEN 'openai' ELSE 'openai-compatible' END AS provider FROM extractions0""", "extractions0"))
def _(v):
    k = F.col("k") % 3
    given = F.when(k == 0, " Google").when(k == 1, "LM_Studio")
    return v.extractions(0).select("document_id", T.provider_normalize(given, F.col("model")).alias("provider"))


@query("excerpt_queries", """SELECT item_id, 1 AS queries, trim(regexp_replace(regexp_replace(replace(text, '…', ' '), '\\.{3,}', ' ', 'g'), '\\s+', ' ', 'g')) AS first_query FROM benchmark""".replace("\\\\", "\\"))
def _(v):
    q = T.excerpt_queries(F.col("text"))
    return v.table("benchmark").select("item_id", (F.size(q) >= 1).cast("int").alias("queries"), F.get(q, F.lit(0)).alias("first_query"))


@query("value_needle", sql("SELECT k, CAST(a AS VARCHAR) AS needle FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey%3 = 0 THEN o_orderstatus WHEN o_orderkey%3 = 1 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey%6 = 2 THEN 'deep ' || o_orderpriority ELSE NULL END AS a FROM orders)"))
def _(v):
    k = F.col("o_orderkey")
    j = (F.when(k % 3 == 0, F.concat(F.lit('[{"a": "", "b": null}, {"c": ["'), F.col("o_orderstatus"), F.lit('"]}]'))).when(k % 3 == 1, F.concat(F.lit('{"a": [], "n": '), F.col("o_custkey").cast("string"), F.lit("}")))
         .when(k % 6 == 2, F.concat(F.lit('{"z": {"y": {"x": [{"w": {"v": "", "u": "deep '), F.col("o_orderpriority"), F.lit('"}}]}}, "a": "later"}')))
         .otherwise('{"a": [{"b": ""}]}'))
    return v.table("orders").select(k.alias("k"), J.value_needle(j).alias("needle"))


@query("value_matches_block", sql(r"""SELECT document_id, block_id, contains(lower(text), 'the') OR contains(regexp_replace(lower(text), '[^a-z0-9.]', '', 'g'), 'the') AS hit FROM blocks""", "blocks"))
def _(v):
    return v.blocks.select("document_id", "block_id", T.value_matches_block(F.lit("The"), F.col("text")).alias("hit"))


CTES["invoice"] = ((), """SELECT 'o' || o_orderkey AS document_id, o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS total, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority FROM orders""")


@query("rule_extract", sql(r"""SELECT document_id, 'invoice_number' AS field_path, '"INV-' || k || '"' AS value_json, 0.98::DOUBLE AS confidence FROM invoice UNION ALL
 SELECT document_id, 'invoice_date', '"' || d || '"', 0.95::DOUBLE FROM invoice UNION ALL SELECT document_id, 'vendor.name', '"' || o_orderpriority || ' Ltd"', 0.96::DOUBLE FROM invoice UNION ALL
 SELECT document_id, 'total', regexp_replace(total, '\.?0+$', ''), 0.97::DOUBLE FROM invoice UNION ALL SELECT document_id, 'currency', '"USD"', 0.99::DOUBLE FROM invoice UNION ALL
 SELECT document_id, 'line_items', '[{"amount":5,"description":"Widget ' || k || '","quantity":2},{"amount":1200.5,"description":"Bolt","quantity":3}]', 0.91::DOUBLE FROM invoice""", "invoice"))
def _(v):
    total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Invoice # INV-"), k, F.lit("\nIssued: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nVendor: "), F.col("o_orderpriority"), F.lit(" Ltd\nWidget "), k,
                    F.lit(" 2 $5.00\nBolt 3 1,200.50\nTotal due: $"), total, F.lit("\nSubtotal 1 $1.00"))
    return X.rule_extract(v.table("orders").select(F.concat(F.lit("o"), k).alias("document_id"), text.alias("text")))


@query("sql_functions", sql(f"SELECT document_id, field_path, {ntext('t')} AS words, {dectext(num('t'))} AS number, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM (SELECT *, {txt('value_json')} AS t FROM pred0)", "pred0"))
def _(v):
    register_sql_functions(v.spark)
    cells0 = v.pred(0).withColumn("t", J.text(F.col("value_json")))
    return cells0.select("document_id", "field_path", F.expr("fg_text(t)").alias("words"), T.decimal_text(F.expr("fg_number(t)")).alias("number"), F.expr("fg_confidence(confidence)").alias("confidence"))


# ---- join kinds and set operations -----------------------------------------------------------------
@query("join_equi_inner", sql(f"SELECT s.document_id, s.field_path, s.status, x.latency_ms, x.model FROM {S0} s JOIN extractions0 x USING (document_id) WHERE s.status <> 'correct'", S0, "extractions0"))
def _(v):
    return scored(v).where("status <> 'correct'").join(v.extractions(0), ["run_id", "document_id"]).select("document_id", "field_path", "status", "latency_ms", "model")


@query("dual_key_lookup", sql("SELECT e.n AS entry, coalesce(a.document_id, b.document_id) AS document_id FROM docs e LEFT JOIN members a ON a.document_id = CASE WHEN e.n%3 = 0 THEN e.document_id END LEFT JOIN members b ON b.sha256 = CASE WHEN e.n%3 = 1 THEN e.sha256 END", "docs", "members"))
def _(v):
    from ..sources.manifest import match_documents
    e = v.docs.select(F.col("n").alias("entry"), F.when(F.col("n") % 3 == 0, F.col("document_id")).alias("document_id"), F.when(F.col("n") % 3 == 1, F.col("sha256")).alias("sha256"))
    return match_documents(e, v.members).select("entry", F.col("matched_id").alias("document_id"))


@query("set_union", sql("SELECT document_id, field_path FROM truth UNION SELECT document_id, field_path FROM pred0", "truth", "pred0"))
def _(v):
    return v.truth.select("document_id", "field_path").unionByName(v.pred(0).select("document_id", "field_path")).distinct()


@query("set_difference", sql("SELECT document_id, field_path FROM pred0 EXCEPT SELECT document_id, field_path FROM truth", "truth", "pred0"))
def _(v):
    return v.pred(0).select("document_id", "field_path").join(v.truth, ["document_id", "field_path"], "left_anti").distinct()


@query("set_intersection", sql("SELECT document_id, list_contains(tags, 'en') OR list_contains(tags, 'p2') AS wanted FROM docs", "docs"))
def _(v):
    return v.docs.select("document_id", F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("p2"))).alias("wanted"))
