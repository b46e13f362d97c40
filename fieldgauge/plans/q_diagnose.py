"""Queries: failure diagnosis, source context, leakage and reviews."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J
from ..operators import diagnose as D
from .q_scoring import S0, S1, scored
from .registry import query
from .sql import CTES, canon, sql, txt


@query("top_failing_fields", sql(f"""SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY failed DESC, field_path) AS INTEGER) AS field_rank FROM (SELECT run_id, field_path, count(*) AS scored, count(*) FILTER (status <> 'correct') AS failed,
 min(document_id) FILTER (status = 'correct') AS control_document_id, arg_min(expected_json, document_id) FILTER (status = 'correct') AS control_expected FROM (FROM {S0} UNION ALL FROM {S1}) GROUP BY 1, 2) WHERE failed > 0""", S0, S1))
def _(v):
    return D.top_failing_fields(scored(v).unionByName(scored(v, 1))).drop("control_actual")


CTES["bad"] = ((S0,), f"SELECT run_id, field_path, status, coalesce({canon('expected_json')}, 'null') AS expected, coalesce({canon('actual_json')}, 'null') AS actual, document_id FROM {S0} WHERE status <> 'correct'")


@query("failure_patterns", sql("""SELECT run_id, field_path, CAST(pattern_rank AS INTEGER) AS pattern_rank, pattern_count, status, expected, actual, n AS count, ex AS examples FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, field_path ORDER BY n DESC, first_document, status, expected, actual) AS pattern_rank, count(*) OVER (PARTITION BY run_id, field_path) AS pattern_count FROM (
 SELECT run_id, field_path, status, expected, actual, count(*) AS n, min(document_id) AS first_document, array_to_string(list_sort(list(document_id))[1:2], ',') AS ex FROM bad GROUP BY 1, 2, 3, 4, 5)) WHERE pattern_rank <= 4""", "bad"))
def _(v):
    out = D.failure_patterns(scored(v))
    return out.select("run_id", "field_path", "pattern_rank", "pattern_count", "status", "expected", "actual", "count", F.array_join("examples", ",").alias("examples"))


CTES["fp"] = (("bad",), """SELECT run_id, field_path, CAST(pattern_rank AS INTEGER) AS pattern_rank, status, n, ex FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, field_path ORDER BY n DESC, first_document, status, expected, actual) AS pattern_rank FROM (
 SELECT run_id, field_path, status, expected, actual, count(*) AS n, min(document_id) AS first_document, list_sort(list(document_id))[1:2] AS ex FROM bad GROUP BY 1, 2, 3, 4, 5)) WHERE pattern_rank <= 4""")
CTES["order_page"] = (("base",), "SELECT document_id, string_agg(field_path || ' ' || v, ' ' ORDER BY f) AS text FROM base GROUP BY 1")
CTES["order_needle"] = (("pred0",), rf"SELECT document_id, field_path, trim(regexp_replace({txt('value_json')}, '\s+', ' ', 'g')) AS needle FROM pred0")
CTES["order_source"] = (("order_page", "order_needle", "base"), """SELECT b.document_id, b.field_path, p.text, CASE WHEN n.needle <> '' AND contains(lower(p.text), lower(n.needle)) THEN 'matched extraction evidence' ELSE 'source context; relevance not verified' END AS selection
 FROM base b JOIN order_page p ON p.document_id = b.document_id LEFT JOIN order_needle n ON n.document_id = b.document_id AND n.field_path = b.field_path""")
CTES["shown"] = (("fp",), "SELECT run_id, field_path, pattern_rank, status, n, unnest(ex) AS document_id FROM fp")


@query("failure_sources", sql(f"""SELECT s.run_id, s.field_path, s.pattern_rank, s.status, string_agg(s.document_id || '|' || o.selection || '|' || o.text, ';' ORDER BY s.document_id) AS sources, c.document_id AS control_document_id, q.selection || '|' || q.text AS control FROM shown s JOIN order_source o ON o.document_id = s.document_id AND o.field_path = s.field_path
 LEFT JOIN (SELECT field_path, min(document_id) FILTER (status = 'correct') AS document_id FROM {S0} GROUP BY 1) c ON c.field_path = s.field_path LEFT JOIN order_source q ON q.document_id = c.document_id AND q.field_path = c.field_path
 GROUP BY s.run_id, s.field_path, s.pattern_rank, s.status, c.document_id, q.selection, q.text""", "shown", "order_source", S0))
def _(v):
    """Orders as pages of their true values; what the run cites for a field is the value that it gave."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", F.concat_ws(" ", "field_path", "v").alias("w")))), lambda x: x["w"]), " ")
    page = v.base.groupBy("document_id").agg(words.alias("text")).select("document_id", F.lit(1).alias("page"), "text")
    cited = v.branches((0,)).select(F.lit("run-0").alias("run_id"), "document_id", "field_path", F.lit(1).alias("needle_rank"), J.text(F.col("value_json")).alias("needle"))
    out = D.failure_sources(D.failure_patterns(scored(v)), cited, page)
    show = F.transform("sources", lambda s: F.concat_ws("|", s["document_id"], s["selection"], s["text"]))
    return out.select("run_id", "field_path", "pattern_rank", "status", F.array_join(show, ";").alias("sources"), "control_document_id",
                      F.concat_ws("|", "control_source.selection", "control_source.text").alias("control"))


CTES["page_text"] = (("blocks",), r"""SELECT document_id, page, trim(regexp_replace(string_agg(text, ' ' ORDER BY source_index), '\s+', ' ', 'g')) AS text FROM blocks GROUP BY 1, 2""")
CTES["page_keyed"] = (("page_text",), "SELECT * FROM page_text")


def pages(v):
    return D.page_texts(v.blocks)


@query("page_texts", sql("SELECT * FROM page_text", "page_text"))
def _(v):
    return pages(v)


CTES["needles"] = ((), r"""SELECT 'd' || doc_id AS document_id, 'terms.noticePeriod' AS field_path, 1 AS needle_rank, trim(regexp_replace(substr(text, CAST(n_chars//3 AS INTEGER) + 1, 25), '\s+', ' ', 'g')) AS needle FROM documents WHERE doc_id%3 <> 0
 UNION ALL SELECT 'd' || doc_id, 'terms.noticePeriod', 0, 'no such passage ' || doc_id FROM documents""")


def requests(v):
    d = v.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id", "text", "n_chars")
    f = F.lit("terms.noticePeriod").alias("field_path")
    found = d.where("doc_id % 3 <> 0").select("document_id", f, F.lit(1).alias("needle_rank"), F.substring("text", F.floor(F.col("n_chars") / 3).cast("int") + 1, F.lit(25)).alias("needle"))
    lost = d.select("document_id", f, F.lit(0).alias("needle_rank"), F.concat(F.lit("no such passage "), F.col("doc_id").cast("string")).alias("needle"))
    return found.unionByName(lost)


CTES["ctx_hits"] = (("needles", "page_text"), """SELECT document_id, field_path, page, substr(text, greatest(hit_at - 300, 1), CAST(hit_at - 1 + least(length(needle), 1200) + 400 - greatest(hit_at - 300, 1) + 1 AS INTEGER)) AS text FROM (
 SELECT n.*, p.page, p.text, strpos(lower(p.text), lower(n.needle)) AS hit_at, row_number() OVER (PARTITION BY n.document_id ORDER BY needle_rank, page) AS rn FROM needles n JOIN page_text p USING (document_id)
 WHERE needle <> '' AND strpos(lower(p.text), lower(n.needle)) > 0) WHERE rn = 1""")
CTES["ctx_windows"] = (("page_text",), """SELECT document_id, page, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page, start) AS rn FROM (
 SELECT document_id, page, start, w AS text, (length(lw) - length(replace(lw, 'terms', '')))//5 + (length(lw) - length(replace(lw, 'notice', '')))//6 + (length(lw) - length(replace(lw, 'period', '')))//6 AS score FROM (
 SELECT document_id, page, start, substr(text, CAST(start + 1 AS INTEGER), 1600) AS w, lower(substr(text, CAST(start + 1 AS INTEGER), 1600)) AS lw FROM (SELECT *, unnest(range(0, length(text), 1200)) AS start FROM page_text)))) WHERE rn = 1""")


@query("source_context", sql("""SELECT document_id, field_path, page, text, 'matched extraction evidence' AS selection FROM ctx_hits
 UNION ALL SELECT document_id, 'terms.noticePeriod', page, text, 'source context; relevance not verified' FROM ctx_windows w WHERE NOT EXISTS (SELECT 1 FROM ctx_hits h WHERE h.document_id = w.document_id)
 UNION ALL SELECT 'd' || doc_id, 'terms.noticePeriod', NULL, '', 'source text unavailable' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM page_text p WHERE p.document_id = 'd' || d.doc_id)""", "ctx_hits", "ctx_windows"))
def _(v):
    return D.source_context(requests(v), pages(v))


@query("keyword_windows", sql("SELECT document_id, page, text FROM ctx_windows", "ctx_windows"))
def _(v):
    return D.keyword_windows(v.docs.select("document_id", F.lit("terms.noticePeriod").alias("field_path")), pages(v)).drop("field_path")


@query("contamination_shingles", """WITH sh AS (SELECT DISTINCT substr(text, CAST(o + 1 AS INTEGER), 100) AS s FROM (SELECT text, unnest(range(0, length(text) - 99, 40)) AS o FROM benchmark WHERE length(text) >= 100)),
 w AS (SELECT doc_id, substr(text, CAST(o + 1 AS INTEGER), 100) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 99)) AS o FROM documents WHERE length(text) >= 100))
 SELECT DISTINCT doc_id, 'source_text' AS kind FROM w WHERE s IN (SELECT s FROM sh)""")
def _(v):
    return D.contamination_shingles(v.table("documents"), v.table("benchmark"), id_column="doc_id")


@query("contamination_answers", "SELECT doc_id, 'expected_answer' AS kind FROM documents WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT text AS a FROM benchmark WHERE length(text) >= 12) b WHERE contains(documents.text, a))")
def _(v):
    return D.long_answers(v.table("documents"), v.table("benchmark").select(F.col("text").alias("answer")), "doc_id")


@query("suggest_experiments", sql(f"""SELECT field_path, CAST(scored_documents AS BIGINT) AS scored_documents, CAST(failing_documents AS BIGINT) AS failing_documents, dominant, CAST(rank AS INTEGER) AS rank,
 CASE dominant WHEN 'missing' THEN 'Recover missing ' || field_path WHEN 'hallucinated' THEN 'Ground ' || field_path || ' in the source' WHEN 'validation_failed' THEN 'Check the format of ' || field_path ELSE 'Disambiguate ' || field_path END AS title FROM (
 SELECT *, row_number() OVER (ORDER BY failing_documents DESC, failing_documents/scored_documents::DOUBLE DESC, field_path) AS rank FROM (
 SELECT field_path, sum(n) AS scored_documents, sum(n) FILTER (status <> 'correct') AS failing_documents, arg_min(status, (-n, status)) FILTER (status <> 'correct') AS dominant FROM (SELECT field_path, status, count(*) AS n FROM {S0} GROUP BY 1, 2) GROUP BY 1) WHERE failing_documents > 0) WHERE rank <= 3""", S0))
def _(v):
    return D.suggest_experiments(scored(v), v.leaves).select("field_path", "scored_documents", "failing_documents", "dominant", "rank", "title")


CTES["decisions"] = ((), """SELECT event_id AS decision_id, 'run-0' AS run_id, 'o' || (event_id%(SELECT count(*) FROM orders)) AS document_id, CASE event_id%3 WHEN 0 THEN 'total' WHEN 1 THEN 'status' ELSE 'currency' END AS field_path, 'r' || (user_id%5) AS reviewer,
 CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'corrected' WHEN 'purchase' THEN 'ambiguous' ELSE event_type END AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM events""")


def decisions(v):
    n = v.table("orders").agg(F.count(F.lit(1)).alias("n"))
    e, i = v.table("events").crossJoin(F.broadcast(n)), F.col("event_id")
    status = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "corrected").when(F.col("event_type") == "purchase", "ambiguous").otherwise(F.col("event_type"))
    return e.select(i.alias("decision_id"), F.lit("run-0").alias("run_id"), F.concat(F.lit("o"), (i % F.col("n")).cast("string")).alias("document_id"),
                    F.when(i % 3 == 0, "total").when(i % 3 == 1, "status").otherwise("currency").alias("field_path"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("reviewer"),
                    status.alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("review_backlog", sql(f"""SELECT document_id, field_path, status FROM {S0} s WHERE (confidence < 0.9 OR status <> 'correct') AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.document_id = s.document_id AND d.field_path = s.field_path)""", S0, "decisions"))
def _(v):
    return D.review_backlog(scored(v), decisions(v)).select("document_id", "field_path", "status")


@query("review_decision_latest", sql(f"""SELECT document_id, field_path, reviewer, decision_id, status, updated_at FROM (SELECT d.*, row_number() OVER (PARTITION BY document_id, field_path, reviewer ORDER BY updated_at DESC, decision_id DESC) AS rn FROM decisions d
 WHERE status IN ('accepted','corrected','ambiguous') AND EXISTS (SELECT 1 FROM {S0} s WHERE s.document_id = d.document_id AND s.field_path = d.field_path)) WHERE rn = 1""", S0, "decisions"))
def _(v):
    return D.review_decision_latest(decisions(v), scored(v)).drop("run_id")


@query("review_assignment_queue", """SELECT dataset_id, document_id, reviewer, status FROM (SELECT 'u' || user_id%7 AS dataset_id, 'd' || user_id AS document_id, 'r' || event_id%3 AS reviewer, event_type AS status,
 row_number() OVER (PARTITION BY user_id, event_id%3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND status = 'click' AND substr(document_id, 2)::BIGINT % 2 = 0""")
def _(v):
    u = F.col("user_id")
    e = v.table("events").select(F.concat(F.lit("u"), (u % 7).cast("string")).alias("dataset_id"), F.concat(F.lit("d"), u.cast("string")).alias("document_id"),
                                 F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("reviewer"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("assignment_id"), u.alias("user_id"))
    members = e.where("user_id % 2 = 0").select("dataset_id", "document_id").distinct()
    return D.review_assignment_queue(e.drop("user_id"), members, status="click").select("dataset_id", "document_id", "reviewer", "status")


CTES["quotes"] = ((), r"""SELECT document_id, array_to_string(w[5:17], ' ') || ' unseen words' AS excerpt FROM (
 SELECT 'd' || doc_id AS document_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents) WHERE len(w) >= 20""")


@query("near_text_locate", sql(r"""SELECT document_id, CAST(query_pos AS INTEGER) AS query_pos, query, page FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY query_pos) AS rn FROM (
 SELECT document_id, query_pos, query, sum(h) AS all_hits, coalesce(sum(h) FILTER (page = 1), 0) AS page_hits, coalesce(min(page) FILTER (page = 1), min(page)) AS page FROM (
 SELECT q.*, p.page, (length(p.text) - length(replace(lower(p.text), lower(q.query), '')))//length(q.query) AS h FROM page_text p JOIN (
 SELECT document_id, query, row_number() OVER (PARTITION BY document_id ORDER BY min(i)) - 1 AS query_pos FROM (SELECT document_id, unnest(l) AS query, unnest(range(len(l))) AS i FROM (
 SELECT document_id, list_concat([t], list_filter(regexp_split_to_array(t, '[;.!?]\s+'), lambda x: len(regexp_split_to_array(x, '\s+')) >= 6), [array_to_string(w[1:10], ' '), array_to_string(w[len(w)-9:len(w)], ' ')]) AS l
 FROM (SELECT document_id, t, string_split(t, ' ') AS w FROM (SELECT document_id, trim(regexp_replace(regexp_replace(replace(excerpt, '…', ' '), '\.{3,}', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM quotes)))) GROUP BY 1, 2 QUALIFY query_pos < 8) q USING (document_id))
 WHERE h > 0 GROUP BY 1, 2, 3) WHERE page_hits = 1 OR (page_hits = 0 AND all_hits = 1)) WHERE rn = 1""", "page_text", "quotes"))
def _(v):
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    quotes = v.docs.where(F.size(w) >= 20).select("document_id", F.lit(1).alias("quote_id"), F.concat(F.array_join(F.slice(w, 5, 13), " "), F.lit(" unseen words")).alias("excerpt"), F.lit(1).alias("preferred_page"))
    return D.near_text_locate(quotes, pages(v)).select("document_id", "query_pos", "query", "page")
