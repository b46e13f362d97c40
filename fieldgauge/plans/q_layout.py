"""Queries: layout blocks, boxes, evidence and page text."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvals as J, text as T
from ..operators import layout as L, benchmark as B, canonical as CO, pages as PG
from ..schema import schema_leaves
from .q_diagnose import pages
from .registry import query
from .sql import CTES, sql

STRIP = r"regexp_replace({0}, '^[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+|[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+$', '', 'g')"
CTES["lines"] = ((), rf"""SELECT document_id, i, n, line FROM (SELECT document_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM (
 SELECT 'd' || doc_id AS document_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM documents))""")


CTES["paged_lines"] = ((), rf"""SELECT document_id, page, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT document_id, page, list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM (
 SELECT document_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS page FROM (SELECT 'd' || doc_id AS document_id, string_split(text || chr(12) || 'Annex ' || doc_id || chr(10) || text, chr(12)) AS p FROM documents)))""")


@query("page_line_blocks", sql("""SELECT document_id, CAST(page AS INTEGER) AS page, 'p' || page || '-b' || (i + 1) AS block_id, line AS text, CAST(i AS BIGINT) AS source_index FROM paged_lines""", "paged_lines"))
def _(v):
    two = F.concat("text", F.lit("\fAnnex "), F.substring("document_id", 2, 20), F.lit("\n"), F.col("text"))
    b = L.page_line_blocks(v.docs.withColumn("text", two))
    return b.select("document_id", "page", "block_id", "text", F.col("source_index").cast("long").alias("source_index"))


PRINTABLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^\x09\x0A\x0D\x20-\x7E]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("printable_text", f"""SELECT doc_id, CASE doc_id%3 WHEN 0 THEN {PRINTABLE.format("text")} WHEN 1 THEN {PRINTABLE.format("'é' || text")} ELSE 'ab' END AS out FROM documents""")
def _(v):
    """Whole texts as bytes: as they are, behind a byte that is not UTF-8, and, one in three, a few bytes of Latin-1 only."""
    k, text = F.col("doc_id") % 3, F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    broken = F.concat(F.unhex(F.lit("FFC3A9")), text)
    data = F.when(k == 0, text).when(k == 1, broken).otherwise(F.unhex(F.lit("6162E9")))
    return v.table("documents").select("doc_id", T.printable_bytes(data).alias("out"))


# the references that the pages hold
DECODED = "regexp_replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query("html_block_table", rf"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS line_no, text FROM (SELECT page_id, i, trim(regexp_replace({DECODED.format("x")}, '\s+', ' ', 'g')) AS text FROM (
 SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|$)|<script.*?(</script>|$)|<style.*?(</style>|$)', chr(1), 'g'), '<[^>]*(>|$)', chr(1), 'g'), chr(1)) AS l FROM pages))) WHERE text <> ''""".replace("\\\\", "\\"))
def _(v):
    return L.html_block_table(v.table("pages"), "page_id", "html")


@query("bbox_normalize", """SELECT k, CASE WHEN r > l AND b > t THEN round(l, 4) || ',' || round(t, 4) || ',' || round(r, 4) || ',' || round(b, 4) END AS box FROM (SELECT k, greatest(0, least(1, x0/100::DOUBLE)) AS l, greatest(0, least(1, x1/100::DOUBLE)) AS r,
 greatest(0, least(1, CASE WHEN k%2 = 0 THEN y0/200::DOUBLE ELSE (200 - y1)/200::DOUBLE END)) AS t, greatest(0, least(1, CASE WHEN k%2 = 0 THEN y1/200::DOUBLE ELSE (200 - y0)/200::DOUBLE END)) AS b FROM (
 SELECT l_orderkey*10 + l_linenumber AS k, CAST(l_partkey%90 AS DOUBLE) AS x0, CAST(l_partkey%90 + l_quantity - 3 AS DOUBLE) AS x1, CAST(l_suppkey%150 AS DOUBLE) AS y0, CAST(l_suppkey%150 + l_linenumber*10 AS DOUBLE) AS y1 FROM lineitem))""")
def _(v):
    p, s = (F.col("l_partkey") % 90).cast("double"), (F.col("l_suppkey") % 150).cast("double")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    box = L.bbox_normalize(p, s, p + F.col("l_quantity") - 3, s + F.col("l_linenumber") * 10, F.lit(100.0), F.lit(200.0), F.when(k % 2 == 0, "TOP_LEFT").otherwise("BOTTOMLEFT"))
    return v.table("lineitem").select(k.alias("k"), F.array_join(F.transform(box, lambda x: x.cast("string")), ",").alias("box"))


@query("bbox_union", """SELECT l_orderkey AS k, round(min(l_partkey%500)/1000::DOUBLE, 4) || ',' || round(min(l_suppkey%500)/1000::DOUBLE, 4) || ',' || round(max(l_partkey%500 + l_quantity)/1000::DOUBLE, 4) || ',' || round(max(l_suppkey%500 + 10)/1000::DOUBLE, 4) AS box FROM lineitem GROUP BY 1""")
def _(v):
    rect = F.struct((F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 500).cast("double").alias("y"), F.col("l_quantity").alias("w"), F.lit(10.0).alias("h"))
    g = v.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(rect).alias("rects"))
    return g.select("k", F.array_join(F.transform(L.bbox_union(F.col("rects"), F.lit(1000.0), F.lit(1000.0)), lambda x: x.cast("string")), ",").alias("box"))


TYPES = ("Heading", "title", "list_item", "bullet", "table", "cell", "paragraph")


@query("block_type_map", sql(r"""SELECT document_id, block_id, CASE WHEN source_index%7 IN (0,1) THEN 'heading' WHEN source_index%7 IN (2,3) THEN 'list' WHEN source_index%7 IN (4,5) THEN 'table'
 WHEN regexp_matches(text, '^\s*([-*+•‣◦▪]|\d+[.)])(\s|$)') THEN 'list' ELSE 'text' END AS block_type FROM blocks""", "blocks"))
def _(v):
    t = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("source_index") % 7 + 1).cast("int"))
    return v.blocks.select("document_id", "block_id", L.block_type_map(t, F.col("text")).alias("block_type"))


def tables_md(v):
    """Markdown tables: one per order, a header, a separator and a row per line."""
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_linenumber").cast("string"), F.lit(" |")))), "\n")
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.concat(F.lit("| part | n |\n|---|:--:|\n"), body).alias("md"), F.count(F.lit(1)).alias("n"))


@query("markdown_row_count", "SELECT l_orderkey AS k, count(*) + 1 AS rows FROM lineitem GROUP BY 1")
def _(v):
    return tables_md(v).select("k", L.markdown_row_count(F.col("md")).cast("long").alias("rows"))


@query("usable_table_box", "SELECT k, 0.4::DOUBLE + (k%3)*0.0::DOUBLE >= 0.35 AND k%5 <> 0 AND (k%20 + 1)/100::DOUBLE >= greatest(0.035, least(0.18, n*0.014)) AS usable FROM (SELECT l_orderkey AS k, count(*) + 1 AS n FROM lineitem GROUP BY 1)")
def _(v):
    k = F.col("k")
    width = F.when(k % 5 == 0, 0.2).otherwise(0.4)
    box = F.array(F.lit(0.0), F.lit(0.0), width, (k % 20 + 1) / F.lit(100.0))
    return tables_md(v).select("k", L.usable_table_box(box, L.markdown_row_count(F.col("md"))).alias("usable"))


def layout_items(v):
    """Layout items per document page: every third block a table, some without boxes."""
    i = F.col("source_index")
    return v.blocks.select("document_id", "page", i.alias("source_index"), (i % 3 == 0).alias("is_table"), "text",
                           F.when(i % 4 != 0, F.col("bbox")).alias("bbox"), F.when(i % 3 == 0, "table").otherwise("text").alias("block_type"))


MD_ROWS = r"greatest(1, len(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|') AND NOT regexp_full_match(trim(r), '[|:\-\s]*'))))"
# items -> the boxes of tables without a usable one, placed one after the other
CTES["titems"] = (("blocks",), f"""SELECT document_id, page, source_index AS idx, source_index%3 = 0 AS tb, CASE WHEN source_index%3 = 0 THEN {MD_ROWS} ELSE 1 END AS r, CASE WHEN source_index%4 <> 0 THEN x0 END AS x0,
 CASE WHEN source_index%4 <> 0 THEN y0 END AS y0, CASE WHEN source_index%4 <> 0 THEN x1 END AS x1, CASE WHEN source_index%4 <> 0 THEN y1 END AS y1 FROM blocks""")


def infer_ctes(items: str, name: str) -> None:
    """The placement as a recursion over a page's loose tables, in order; ``items`` names the CTE of the page's items."""
    CTES[f"{name}_s"] = ((items,), f"SELECT *, coalesce(CASE WHEN tb THEN x1 - x0 >= 0.35 AND y1 - y0 >= greatest(0.035, least(0.18, r*0.014::DOUBLE)) ELSE x0 IS NOT NULL END, false) AS solid FROM {items}")
    CTES[f"{name}_l"] = ((f"{name}_s",), f"""SELECT t.document_id, t.page, t.idx, t.r, t.y0 AS hint, row_number() OVER (PARTITION BY t.document_id, t.page ORDER BY t.idx) AS k,
 (SELECT max({{'i': idx, 't': y0, 'b': y1}}) FROM {name}_s p WHERE p.document_id = t.document_id AND p.page = t.page AND p.solid AND p.idx < t.idx) AS prev,
 (SELECT min({{'i': idx, 't': y0}}).t FROM {name}_s p WHERE p.document_id = t.document_id AND p.page = t.page AND p.solid AND p.idx > t.idx) AS next_top,
 (SELECT min({{'i': idx, 't': y0}}).t FROM {name}_s p WHERE p.document_id = t.document_id AND p.page = t.page AND p.tb AND NOT p.solid AND p.y0 IS NOT NULL AND p.idx > t.idx) AS next_hint,
 least(0.028, greatest(0.012, coalesce((SELECT avg((y1 - y0)/r) FROM {name}_s p WHERE p.document_id = t.document_id AND p.page = t.page AND p.tb AND p.solid AND y1 > y0), 0.018)))::DOUBLE AS line
 FROM {name}_s t WHERE t.tb AND NOT t.solid""")
    floor = "coalesce(CASE WHEN q.idx IS NOT NULL AND (l.prev IS NULL OR q.idx >= l.prev.i) THEN q.bottom ELSE l.prev.b END + 0.018::DOUBLE, 0.06::DOUBLE)"
    step = lambda source: f"""SELECT document_id, page, idx, k, round(top, 4) AS top, round(greatest(top + 0.06::DOUBLE, least(0.96::DOUBLE, top + greatest(0.06::DOUBLE, r*line), coalesce(next_top - 0.018::DOUBLE, 9), coalesce(next_hint - 0.018::DOUBLE, 9))), 4) AS bottom
 FROM (SELECT l.*, least(0.92::DOUBLE, greatest(0.04::DOUBLE, {floor}, coalesce(l.hint, {floor}))) AS top FROM {source})"""  # noqa: E731
    CTES[name] = ((f"{name}_l",), f"""SELECT * FROM (WITH RECURSIVE z AS ({step(f"{name}_l l LEFT JOIN (SELECT NULL::BIGINT AS idx, NULL::DOUBLE AS bottom) q ON true WHERE l.k = 1")}
 UNION ALL {step(f"{name}_l l JOIN z q ON q.document_id = l.document_id AND q.page = l.page AND l.k = q.k + 1")}) SELECT * FROM z)""")


infer_ctes("titems", "inferred")


@query("infer_table_boxes", sql("SELECT document_id, page, idx AS source_index, top, bottom FROM inferred", "inferred"))
def _(v):
    return L.infer_table_boxes(layout_items(v)).select("document_id", "page", "source_index", F.col("bbox")[1].alias("top"), F.col("bbox")[3].alias("bottom"))


@query("match_grounding_items", sql("""SELECT i.document_id, i.page, i.source_index, coalesce(CASE WHEN i.source_index%4 <> 0 THEN i.source_index END, t.m) AS grounded_index FROM blocks i
 LEFT JOIN (SELECT document_id, page, source_index%3 = 0 AS tb, text, min(source_index) AS m FROM blocks WHERE source_index%4 <> 0 GROUP BY 1, 2, 3, 4) t ON t.document_id = i.document_id AND t.page = i.page AND t.tb = (i.source_index%3 = 0) AND t.text = i.text""", "blocks"))
def _(v):
    items = layout_items(v)
    return L.match_grounding_items(items, items.where("source_index % 4 <> 0")).select("document_id", "page", "source_index", "grounded_index")


@query("grounded_line_blocks", sql(r"""SELECT document_id, source_index, line_index, CASE WHEN m THEN 'list' ELSE 'text' END AS block_type, CASE WHEN m AND NOT regexp_matches(cut, '^\s*([-*+•‣◦▪]|\d+[.)])(\s|$)') THEN '• ' || cut ELSE cut END AS text FROM (
 SELECT document_id, source_index, line_index, regexp_matches(text, '^\s*([-*+•‣◦▪]|\d+[.)])(\s|$)') AS m, trim(substr(text, line_index*20 + 1, 20)) AS cut FROM blocks CROSS JOIN (VALUES (0),(1)) l(line_index)) WHERE cut <> ''""", "blocks"))
def _(v):
    rect = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("w"), F.lit(2.0).alias("h")))
    lines = F.array(*[F.struct(F.lit(i * 20).alias("start"), F.lit(i * 20 + 20).alias("end"), rect.alias("rects")) for i in (0, 1)])
    items = v.blocks.select("document_id", "page", "source_index", F.lit("paragraph").alias("type"), "text", lines.alias("lines"), F.lit(10.0).alias("page_width"), F.lit(10.0).alias("page_height"))
    return L.grounded_line_blocks(items).select("document_id", "source_index", "line_index", "block_type", "text")


@query("layout_order", sql("""SELECT document_id, page, block_id, row_number() OVER (PARTITION BY document_id, page ORDER BY CASE WHEN y0 IS NULL THEN 1 ELSE 0 END, coalesce(y0, 1), coalesce(x0, 0), source_index) AS position FROM blocks""", "blocks"))
def _(v):
    return L.layout_order(v.blocks).select("document_id", "page", "block_id", "position")


@query("layout_page_merge", sql("""SELECT document_id, page, CASE WHEN source_index%2 = 0 THEN 'text' WHEN source_index%3 = 0 THEN 'table' ELSE 'list' END AS block_type, count(*) AS n FROM blocks WHERE page%5 <> 0 GROUP BY 1, 2, 3
 UNION ALL SELECT document_id, page, 'text', 2 FROM (SELECT DISTINCT document_id, page FROM blocks WHERE page%5 = 0)""", "blocks"))
def _(v):
    b = v.blocks.where("page % 5 <> 0").withColumn("line_index", F.lit(0))
    kind = lambda df, t: df.select("document_id", "page", F.lit(t).alias("block_type"), "text", "bbox", "source_index", "line_index")
    lines, odd = kind(b.where("source_index % 2 = 0"), "text"), b.where("source_index % 2 = 1")
    known = v.blocks.select("document_id", "page").distinct().select("document_id", "page", F.lit("").alias("markdown"), F.lit("first\n\n second ").alias("text"))
    merged = L.layout_page_merge(lines, kind(odd.where("source_index % 3 = 0"), "table"), kind(odd.where("source_index % 3 <> 0"), "list"), known)
    return merged.groupBy("document_id", "page", "block_type").agg(F.count(F.lit(1)).alias("n"))


@query("layout_text_items", sql("""SELECT d.document_id, p.page, b.block_id IS NULL AS blank, count(*) AS n FROM docs d CROSS JOIN (VALUES (1),(2),(3)) p(page) LEFT JOIN blocks b ON b.document_id = d.document_id AND b.page = p.page GROUP BY 1, 2, 3""", "docs", "blocks"))
def _(v):
    out = L.layout_text_items(v.blocks, v.docs.select("document_id", F.lit(3).alias("page_count")))
    return out.groupBy("document_id", "page", F.col("text").isNull().alias("blank")).agg(F.count(F.lit(1)).alias("n"))


CTES["words"] = (("blocks",), """SELECT document_id, page, source_index AS line, pos, w AS text, 10 + pos*60 AS "left", 20 + (source_index%40)*20 AS top, 50 AS width, CASE WHEN pos%11 = 10 THEN 300 ELSE 15 END AS height, (pos*7 + source_index)%101 - 1 AS conf
 FROM (SELECT document_id, page, source_index, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM blocks)""")


@query("ocr_words_to_lines", sql("""SELECT document_id, page, line, string_agg(text, ' ' ORDER BY pos) AS text, round(min("left")/1000::DOUBLE, 4) AS x0, round(max("left" + width)/1000::DOUBLE, 4) AS x1, round(avg(conf) FILTER (conf >= 0)/100, 8) AS confidence
 FROM words WHERE trim(text) <> '' AND height <= 120 GROUP BY 1, 2, 3""", "words"))
def _(v):
    w = v.blocks.select("document_id", "page", F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("source_index").alias("line"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    pos, line = F.col("pos"), F.col("line")
    w = w.withColumns({"left": (10 + pos * 60).cast("double"), "top": (20 + (line % 40) * 20).cast("double"), "width": F.lit(50.0), "height": F.when(pos % 11 == 10, 300.0).otherwise(15.0),
                       "conf": ((pos * 7 + line) % 101 - 1).cast("double"), "page_width": F.lit(1000.0), "page_height": F.lit(1000.0)})
    return L.ocr_words_to_lines(w).select("document_id", "page", "line", "text", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"), F.round("confidence", 8).alias("confidence"))


@query("document_text", sql("SELECT document_id, string_agg(text, chr(10) ORDER BY page, source_index) AS text FROM blocks GROUP BY 1", "blocks"))
def _(v):
    return L.document_text(v.blocks)


@query("valid_evidence", """SELECT event_id, CASE event_id%6 WHEN 0 THEN '{"bbox":[0.1,0.2,0.5,0.4],"page":1,"text":"' || event_type || '"}' ELSE '' END AS out FROM events""")
def _(v):
    i = F.col("event_id")
    box = F.when(i % 6 == 2, "[0.1,0.2,0.5]").when(i % 6 == 3, "[0.5,0.2,0.1,0.4]").otherwise("[0.1,0.2,0.5,0.4]")
    page = F.when(i % 6 == 1, '"1"').when(i % 6 == 4, "9").otherwise("1")
    one = F.concat(F.lit('{"page": '), page, F.lit(', "bbox": '), box, F.lit(', "text": "'), F.col("event_type"), F.lit('"}'))
    ev = F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))
    out = L.valid_evidence(ev, F.when(i % 6 == 5, "null").otherwise("1"), F.lit(3))
    return v.table("events").select("event_id", F.array_join(out, ";").alias("out"))


CTES["doc_needles"] = ((), r"""SELECT 'd' || doc_id AS document_id, f AS field_path, CASE f WHEN 'code' THEN lower(substr(text, CAST(n_chars//2 AS INTEGER) + 1, 8)) ELSE substr(text, 1, 12) END AS needle FROM documents CROSS JOIN (VALUES ('code'),('head')) x(f)""")


def doc_fields(v):
    d = v.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.explode(F.array(
        F.struct(F.lit("code").alias("field_path"), F.lower(F.substring("text", F.floor(F.col("n_chars") / 2).cast("int") + 1, F.lit(8))).alias("needle")),
        F.struct(F.lit("head").alias("field_path"), F.substring("text", 1, 12).alias("needle")))).alias("x"))
    return d.select("document_id", "x.field_path", "x.needle")


CTES["ev_matches"] = (("doc_needles", "blocks"), r"""SELECT n.document_id, n.needle, b.page, b.block_id, b.source_index, b.bbox_source, (b.x1 - b.x0)*(b.y1 - b.y0) AS area FROM (SELECT DISTINCT document_id, needle FROM doc_needles WHERE needle <> '') n JOIN blocks b ON b.document_id = n.document_id AND b.x0 IS NOT NULL
 AND (contains(lower(b.text), lower(n.needle)) OR (regexp_replace(lower(n.needle), '[^a-z0-9.]', '', 'g') <> '' AND contains(regexp_replace(lower(b.text), '[^a-z0-9.]', '', 'g'), regexp_replace(lower(n.needle), '[^a-z0-9.]', '', 'g'))))""")
CTES["ev_best"] = (("ev_matches",), """SELECT document_id, needle, page, block_id, bbox_source FROM (SELECT *, row_number() OVER (PARTITION BY document_id, needle ORDER BY page, CASE WHEN bbox_source = 'inferred' THEN 1 ELSE 0 END, area, source_index) AS rn FROM ev_matches) WHERE rn = 1""")


@query("evidence_text_join", sql("SELECT document_id, needle, block_id FROM ev_matches", "ev_matches"))
def _(v):
    return L.evidence_text_join(doc_fields(v), v.blocks).select("document_id", "needle", "block_id")


@query("best_evidence", sql("SELECT document_id, needle, page, block_id, bbox_source FROM ev_best", "ev_best"))
def _(v):
    e = L.best_evidence(L.evidence_text_join(doc_fields(v), v.blocks))
    return e.select("document_id", "needle", "evidence.page", "evidence.block_id", "evidence.bbox_source")


def grounded(v):
    from ..functions import jsonvals as J
    f = doc_fields(v).select("document_id", "field_path", J.quote(F.col("needle")).alias("value_json"), F.array().cast("array<string>").alias("evidence"))
    status = F.when(F.col("n") % 10 == 0, "compatibility").otherwise("available")
    return L.evidence_for_fields(f, v.blocks, v.docs.select("document_id", status.alias("parser_status")))


@query("evidence_for_fields", sql("SELECT n.document_id, n.field_path, b.page, b.block_id FROM doc_needles n LEFT JOIN ev_best b ON b.document_id = n.document_id AND b.needle = n.needle AND CAST(substr(n.document_id, 2) AS BIGINT)%10 <> 0", "doc_needles", "ev_best"))
def _(v):
    return grounded(v).select("document_id", "field_path", "matched.page", "matched.block_id")


@query("grounding_rate", sql("""SELECT n.field_path, count(*) AS fields, count(b.block_id) AS grounded, round(count(b.block_id)/count(*)::DOUBLE, 6) AS grounding_rate, round(count(*) FILTER (b.bbox_source = 'inferred')/count(b.block_id)::DOUBLE, 6) AS estimated_rate
 FROM doc_needles n LEFT JOIN ev_best b ON b.document_id = n.document_id AND b.needle = n.needle AND CAST(substr(n.document_id, 2) AS BIGINT)%10 <> 0 GROUP BY 1""", "doc_needles", "ev_best"))
def _(v):
    g = L.grounding_rate(grounded(v))
    return g.withColumns({c: F.round(c, 6) for c in ("grounding_rate", "estimated_rate")})


@query("citation_areas", sql("SELECT document_id, block_id, round(6::DOUBLE, 3) AS \"left\", round(y0*100, 3) AS top, round(88::DOUBLE, 3) AS width FROM blocks WHERE x0 IS NOT NULL AND y0 < least(y1, 1.0)", "blocks"))
def _(v):
    scale = F.when(F.col("source_index") % 2 == 0, 1000.0).otherwise(1.0)
    ev = F.array(*[F.struct("page", F.transform("bbox", lambda x: x * scale).alias("bbox"))] * 2)
    sizes = F.create_map(F.col("page"), F.struct(F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height")))
    b = v.blocks.where("bbox is not null").select("document_id", "block_id", F.explode(L.citation_areas(ev, sizes)).alias("a"))
    return b.select("document_id", "block_id", F.round("a.left", 3).alias("left"), F.round("a.top", 3).alias("top"), F.round("a.width", 3).alias("width"))


# ---- quotes on pages --------------------------------------------------------------------------------
CTES["quote_hits"] = (("page_text", "doc_needles"), """SELECT n.document_id, n.field_path, list(p.page ORDER BY p.page) FILTER (contains(replace(p.text, ' ', ''), replace(n.needle, ' ', ''))) AS pages, bool_or(true) AS any_page
 FROM doc_needles n JOIN page_text p USING (document_id) WHERE replace(n.needle, ' ', '') <> '' AND n.needle NOT LIKE '%' || chr(10) || '%' GROUP BY 1, 2""")


def quotes(v):
    """Quotes and pages with blank-free keys (the vectorized Unicode form is tested separately)."""
    key = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    q = doc_fields(v).where(~F.contains("needle", F.lit("\n"))).select("document_id", F.col("field_path").alias("quote_id"), key(F.col("needle")).alias("quote_key"))
    p = pages(v).select("document_id", "page", key(F.col("text")).alias("page_key"))
    c = p.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_key"))), lambda s: s["page_key"]), "").alias("context_key"))
    return q, p, c


QUOTE_SQL = """SELECT n.document_id, n.field_path AS quote_id, coalesce(array_to_string(h.pages, ','), '') AS pages FROM doc_needles n JOIN quote_hits h ON h.document_id = n.document_id AND h.field_path = n.field_path
 JOIN (SELECT document_id, string_agg(replace(text, ' ', ''), '' ORDER BY page) AS ctx FROM page_text GROUP BY 1) c ON c.document_id = n.document_id WHERE contains(ctx, replace(n.needle, ' ', ''))"""


@query("reference_page_lookup", sql(QUOTE_SQL, "quote_hits", "doc_needles", "page_text"))
def _(v):
    return B.reference_page_lookup(*quotes(v)).withColumn("pages", F.array_join("pages", ","))


@query("reference_truth_build", sql(f"SELECT document_id, 'answer' AS field, CASE WHEN bool_or(quote_id = 'code') THEN 'code' ELSE 'head' END AS quote_id FROM ({QUOTE_SQL}) GROUP BY 1", "quote_hits", "doc_needles", "page_text"))
def _(v):
    q, p, c = quotes(v)
    cand = q.select("document_id", F.lit("answer").alias("field"), F.when(F.col("quote_id") == "code", 0).otherwise(1).alias("pos"), "quote_id", F.lit('"x"').alias("value_json"), F.lit("extracted").alias("status"))
    return B.reference_truth_build(cand, B.reference_page_lookup(q, p, c)).select("document_id", "field", "quote_id")


# ---- canonical output with evidence and provenance ----------------------------------------------------
CANON_SCHEMA = {"type": "object", "properties": {"code": {"type": "string"}, "part": {"type": "object", "properties": {"head": {"type": "string"}, "size": {"type": "number"}}}}}


def raw_outputs(v):
    """An output for each document: a wrapped code that cites a region (n % 3 = 0), a malformed one (1) or none (2), a bare head and a size."""
    d, n, q = v.table("documents"), F.col("doc_id"), lambda c: F.coalesce(J.quote(c), F.lit("null"))
    code = F.lower(F.substring("text", F.floor(F.col("n_chars") / 2).cast("int") + 1, F.lit(8)))
    good = '{"page": 1, "bbox": [0.1, 0.2, 0.5, 0.4], "text": "cited", "block_id": "own", "bbox_source": "model", "metadata": {"grounding": "visual"}}'
    cites = F.when(n % 3 == 0, f'[{good}, {{"page": 9, "bbox": [0, 0, 1, 1]}}, "box"]').when(n % 3 == 1, '[{"page": 1, "bbox": [0.5, 0.2, 0.1, 0.4]}, {"page": true, "bbox": [0, 0, 1, 1]}]').otherwise("null")
    body = F.concat(F.lit('{"code": {"value": '), q(code), F.lit(', "confidence": '), F.when(n % 5 == 0, "1.5").otherwise("0.75"), F.lit(', "confidence_source": "model_reported", "errors": ["checked"], "evidence": '), cites,
                    F.when(n % 4 == 0, ', "harness_provenance": {"model": "field-model", "step": 2}, "selection": {"method": "majority_vote"}').otherwise(""),
                    F.lit('}, "part": {"head": '), q(F.substring("text", 1, 12)), F.lit(', "size": {"value": "$1,0'), F.lpad((n % 100).cast("string"), 2, "0"), F.lit('"}}}'))
    return d.select(F.concat(F.lit("d"), n.cast("string")).alias("document_id"), body.alias("output_json"))


CTES["canon_best"] = (("ev_best", "doc_needles"), "SELECT n.document_id, n.field_path, n.needle, b.page, b.block_id, b.bbox_source FROM doc_needles n LEFT JOIN ev_best b ON b.document_id = n.document_id AND b.needle = n.needle AND CAST(substr(n.document_id, 2) AS BIGINT)%10 <> 0")


@query("canonical_output", sql("""SELECT document_id, 'code' AS field_path, needle AS "value", trim(needle, ' ') AS normalized, CASE WHEN n%5 <> 0 THEN 0.75::DOUBLE END AS confidence, 'checked' AS errors, CASE WHEN n%3 = 0 THEN 1 ELSE CASE WHEN page IS NULL THEN 0 ELSE 1 END END AS n_evidence,
 CASE WHEN n%3 = 0 THEN 1 ELSE page END AS page, CASE WHEN n%3 = 0 THEN 'own' ELSE block_id END AS block_id, CASE WHEN n%3 = 0 THEN '"model"' ELSE '"' || bbox_source || '"' END AS bbox_source, CASE WHEN n%3 = 0 THEN '"visual"' END AS grounding,
 CASE WHEN n%4 = 0 THEN 'field-model' ELSE 'run-model' END AS model, CASE WHEN n%4 = 0 THEN '{"method":"majority_vote"}' END AS selection, CASE WHEN n%5 <> 0 THEN 'model_reported' END AS confidence_source, '{"status":"seen"}' AS parser
 FROM (SELECT *, CAST(substr(document_id, 2) AS BIGINT) AS n FROM canon_best WHERE field_path = 'code')
UNION ALL SELECT document_id, 'part.head', needle, trim(needle, ' '), NULL, '', CASE WHEN page IS NULL THEN 0 ELSE 1 END, page, block_id, '"' || bbox_source || '"', NULL, 'run-model', NULL, NULL, '{"status":"seen"}' FROM canon_best WHERE field_path = 'head'
UNION ALL SELECT 'd' || doc_id, 'part.size', '$1,0' || lpad((doc_id%100)::VARCHAR, 2, '0'), (1000 + doc_id%100)::VARCHAR, NULL, '', 0, NULL, NULL, NULL, NULL, 'run-model', NULL, NULL, '{"status":"seen"}' FROM documents""", "canon_best"))
def _(v):
    status = F.when(F.col("n") % 10 == 0, "compatibility").otherwise("available")
    parsers = v.docs.select("document_id", status.alias("parser_status"), F.lit('{"status":"seen"}').alias("parser_json"), F.lit(8).alias("page_count"))
    out = CO.canonical_output(raw_outputs(v), schema_leaves(v.spark, CANON_SCHEMA), v.blocks, parsers, "pv1", "run-model")
    e, p = F.get(F.col("evidence"), F.lit(0)), F.col("provenance")
    return out.select("document_id", "field_path", J.text(F.col("value_json")).alias("value"), J.text(F.col("normalized_json")).alias("normalized"), "confidence", F.array_join("errors", ",").alias("errors"),
                      F.size("evidence").alias("n_evidence"), e["page"].alias("page"), e["block_id"].alias("block_id"), e["metadata"]["bbox_source"].alias("bbox_source"), e["metadata"]["grounding"].alias("grounding"),
                      p["model"].alias("model"), p["selection"].alias("selection"), p["confidence_source"].alias("confidence_source"), p["parser"].alias("parser"))


# ---- pages from four raw sources ----------------------------------------------------------------------
def page_sources(v):
    """Pages by page % 4: items and grounded lines (1), items alone (2), markdown (3), plain text (0). Boxes are in units of a 100 x 200 page.

    Of the items, every third is a table (one in four of them without a box), the next a list, the rest are paragraphs; on pages of kind 1 the
    sidecar cuts each paragraph into one line, and boxes one table in five by its cells.
    """
    b = v.blocks.withColumn("g", F.col("page") % 4)
    i, size = F.col("source_index"), [F.lit(100.0).alias("page_width"), F.lit(200.0).alias("page_height")]
    top = F.col("line") * 4.0
    b = b.withColumn("line", i % 40)
    kind = F.when(i % 3 == 0, "table").when(i % 3 == 1, "list_item").otherwise("paragraph")
    box = F.when((i % 4 != 0) | (i % 3 != 0), F.array(F.lit(5.0), 10 + top, F.lit(95.0), 20 + top))
    items = b.where("g in (1, 2)").select("document_id", "page", *size, "source_index", kind.alias("type"), "text", box.alias("bbox"))
    rect = F.array(F.struct(F.lit(10.0).alias("x"), (10 + top).alias("y"), F.lit(50.0).alias("w"), F.lit(2.0).alias("h")))
    lines = F.when(i % 3 == 2, F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), rect.alias("rects"))))
    cells = F.when((i % 3 == 0) & (i % 5 == 0), F.array(F.lit(1.0), 10 + top, F.lit(99.0), 30 + top))
    grounded = b.where("g = 1").select("document_id", "page", *size, "source_index", kind.alias("type"), "text", lines.alias("lines"), cells.alias("bbox"))
    page = b.select("document_id", "page", "g").distinct()
    return items, page.where("g in (1, 3)").select("document_id", "page", F.lit("first\n\n second ").alias("markdown")), page.where("g in (0, 3)").select("document_id", "page", F.lit("only").alias("text")), grounded


CTES["pitems"] = (("blocks",), """SELECT document_id, page, page%4 AS g, source_index AS idx, text, source_index%3 AS m, 10 + (source_index%40)*4 AS t,
 CASE WHEN source_index%3 = 0 THEN 'table' WHEN source_index%3 = 1 OR regexp_matches(text, '^\\s*([-*+•‣◦▪]|\\d+[.)])(\\s|$)') THEN 'list' ELSE 'text' END AS block_type FROM blocks""".replace("\\\\", "\\"))
CTES["pspans"] = (("pitems",), f"""SELECT document_id, page, idx, m = 0 AS tb, CASE WHEN m = 0 THEN {MD_ROWS} ELSE 1 END AS r, CASE WHEN m <> 0 THEN 0.1 WHEN idx%4 <> 0 THEN 0.05 END::DOUBLE AS x0, CASE WHEN m <> 0 OR idx%4 <> 0 THEN round(least(1, t/200::DOUBLE), 4) END AS y0,
 CASE WHEN m <> 0 THEN 0.6 WHEN idx%4 <> 0 THEN 0.95 END::DOUBLE AS x1, CASE WHEN m <> 0 THEN round(least(1, (t + 2)/200::DOUBLE), 4) WHEN idx%4 <> 0 THEN round(least(1, (t + 10)/200::DOUBLE), 4) END AS y1
 FROM pitems WHERE g IN (1, 2) AND (m = 0 OR (m = 2 AND g = 1))""")
infer_ctes("pspans", "pinferred")
CTES["pblocks"] = (("pitems", "pinferred"), """SELECT document_id, page, block_type, 'p' || page || '-g' || (idx + 1) || '-1' AS block_id, text, round(least(1, t/200::DOUBLE), 4) AS top, round(least(1, (t + 2)/200::DOUBLE), 4) AS bottom, 'grounding' AS bbox_source FROM pitems WHERE g = 1 AND m = 2
 UNION ALL SELECT p.document_id, p.page, 'table', 'p' || p.page || '-t' || (p.idx + 1), text, coalesce(f.top, round(least(1, t/200::DOUBLE), 4)), coalesce(f.bottom, CASE WHEN g = 1 AND p.idx%5 = 0 THEN round(least(1, (t + 20)/200::DOUBLE), 4) ELSE round(least(1, (t + 10)/200::DOUBLE), 4) END),
  CASE WHEN f.idx IS NOT NULL THEN 'inferred' WHEN g = 1 AND p.idx%5 = 0 THEN 'grounding' ELSE 'item' END FROM pitems p LEFT JOIN pinferred f ON f.document_id = p.document_id AND f.page = p.page AND f.idx = p.idx WHERE g IN (1, 2) AND m = 0
 UNION ALL SELECT document_id, page, 'list', 'p' || page || '-l' || (idx + 1), text, round(least(1, t/200::DOUBLE), 4), round(least(1, (t + 10)/200::DOUBLE), 4), 'item' FROM pitems WHERE g IN (1, 2) AND block_type = 'list' AND NOT (g = 1 AND m = 2)""")


@query("merge_page_sources", sql("""SELECT document_id, page, block_id, block_type, top, bottom, bbox_source FROM pblocks
 UNION ALL SELECT document_id, page, 'p' || page || '-b' || (idx + 1), block_type, round(least(1, t/200::DOUBLE), 4), round(least(1, (t + 10)/200::DOUBLE), 4), 'item' FROM pitems p WHERE g = 2 AND NOT EXISTS (SELECT 1 FROM pblocks b WHERE b.document_id = p.document_id AND b.page = p.page)
 UNION ALL SELECT document_id, page, 'p' || page || '-b' || i, 'text', CASE i WHEN 1 THEN 0.06 ELSE 0.48 END::DOUBLE, CASE i WHEN 1 THEN 0.1 ELSE 0.52 END::DOUBLE, 'synthetic' FROM (SELECT DISTINCT document_id, page, g FROM pitems WHERE g IN (0, 3)) CROSS JOIN (VALUES (1),(2)) x(i) WHERE g = 3 OR i = 1""", "pblocks", "pitems"))
def _(v):
    out = PG.merge_page_sources(*page_sources(v))
    return out.select("document_id", "page", "block_id", "block_type", F.col("bbox")[1].alias("top"), F.col("bbox")[3].alias("bottom"), "bbox_source")
