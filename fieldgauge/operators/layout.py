"""Page layout: line blocks, boxes, tables, evidence and citations. A page's blocks are few by nature."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsonvals as J, text as T
from .ranking import ranked

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LIST_MARKER = r"^\s*(?:[-*+•‣◦▪]|\d+[.)])(?:\s|$)"
PAGE = ["document_id", "page"]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGE_SPACE, "")


def page_line_blocks(documents: DataFrame) -> DataFrame:
    """Form-feed pages and their non-empty trimmed lines as blocks with evenly spread synthetic boxes."""
    paged = documents.select("document_id", F.posexplode(F.split("text", "\f")).alias("p", "page_text"))
    lines = F.filter(F.transform(F.split("page_text", LINE_BREAK), strip), lambda s: s != "")
    lines = F.when((F.size(lines) == 0) & (F.col("page_text") != ""), F.array(F.col("page_text"))).otherwise(lines)
    out = (paged.select("document_id", (F.col("p") + 1).alias("page"), lines.alias("lines"))
           .select("document_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "text")))
    top = F.least(F.lit(0.92), 0.06 + F.col("i") / F.col("n") * 0.84)
    box = F.array(F.lit(0.06), F.round(top, 4), F.lit(0.94), F.round(F.least(F.lit(0.98), top + 0.04), 4))
    return out.select("document_id", "page", F.format_string("p%d-b%d", "page", F.col("i") + 1).alias("block_id"),
                      F.col("i").alias("source_index"), "text", box.alias("bbox"))


BREAK = "\x01"
# comments and elements that are not shown, to their end or the page's, whichever comes first
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)(?=[\s/>]).*?(?:</\1\s*>|\z)"
# a tag, quoted attributes first; one with an odd quote ends at its first >, one without an end at the page's
TAG = r"""(?s)</?[a-zA-Z][^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>|</?[a-zA-Z][^>]*+(?:>|\z)|<[!?/][^>]*+(?:>|\z)"""


def _unescaped():
    import html

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def decode(s):
        return s.map(html.unescape, na_action="ignore")
    decode.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(decode, "string")


def html_block_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, line_no, text): the visible text runs of HTML pages, one for each stretch between tags, white space collapsed.

    Markup is cut away by patterns on columns; only character references are decoded in Arrow batches. A ``<`` that begins no tag is text. A hidden
    element ends at the first closing tag of its name. Pages without text give no rows.
    """
    shown = F.regexp_replace(F.regexp_replace(F.translate(html, BREAK, " "), HIDDEN, BREAK), TAG, BREAK)
    decoded = pages.select(key, _unescaped()(shown).alias("shown"))
    runs = F.filter(F.transform(F.split("shown", BREAK), T.collapse), lambda x: x != "")
    return decoded.select(key, F.posexplode(runs).alias("line_no", "text"))


def bbox_normalize(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column,
                   origin: Column | None = None, bottom_left: bool = True) -> Column:
    """Absolute edges to a clamped top-left box in [0,1] (4 digits); null for a degenerate box or page."""
    named = F.replace(F.upper(F.coalesce(origin, F.lit("BOTTOMLEFT" if bottom_left else "TOPLEFT"))), F.lit("_"), F.lit("")) if origin is not None else F.lit("BOTTOMLEFT" if bottom_left else "TOPLEFT")
    down = F.contains(named, F.lit("TOPLEFT"))
    unit = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    y0, y1 = F.when(down, top).otherwise(height - bottom), F.when(down, bottom).otherwise(height - top)
    usable = (width > 0) & (height > 0)
    w, h = F.when(usable, width), F.when(usable, height)
    a, b, c, d = unit(left, w), unit(y0, h), unit(right, w), unit(y1, h)
    return F.when(usable & (c > a) & (d > b), F.array(*[F.round(x, 4) for x in (a, b, c, d)]))


def bbox_union(rects: Column, width: Column, height: Column) -> Column:
    """Extent of an array of {x, y, w, h} rectangles, normalized and clamped; null without a usable one."""
    good = F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0))
    side = lambda fn, value: fn(F.transform(good, value))
    unit = lambda v, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)), 4)
    box = F.array(unit(side(F.array_min, lambda r: r["x"]), width), unit(side(F.array_min, lambda r: r["y"]), height),
                  unit(side(F.array_max, lambda r: r["x"] + r["w"]), width), unit(side(F.array_max, lambda r: r["y"] + r["h"]), height))
    return F.when((F.size(good) > 0) & (width > 0) & (height > 0), box)


def block_type_map(type_: Column, text: Column, is_list: Column | None = None) -> Column:
    """heading / list / table / text from type aliases; text with a list marker is a list."""
    t = F.lower(F.coalesce(type_, F.lit("text")))
    flagged = text.rlike(LIST_MARKER) if is_list is None else (is_list | text.rlike(LIST_MARKER))
    return (F.when(t.isin("heading", "title", "header"), "heading")
            .when(t.isin("list", "list_item", "list-item", "bullet", "numbered_list_item"), "list")
            .when(t.isin("table", "table_cell", "cell"), "table")
            .when(flagged, "list").otherwise("text"))


def list_text(text: Column, marker: Column | None = None) -> Column:
    m = F.coalesce(marker, F.lit("•")) if marker is not None else F.lit("•")
    return F.when(text.rlike(LIST_MARKER), text).otherwise(F.concat(m, F.lit(" "), text))


def markdown_row_count(text: Column) -> Column:
    """Meaningful pipe-delimited rows: separator rows do not count; at least one."""
    rows = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda r: F.contains(r, F.lit("|")) & ~r.rlike(r"^[|:\-\s]*$"))
    return F.greatest(F.size(rows), F.lit(1))


def usable_table_box(bbox: Column, rows: Column) -> Column:
    """A table's own box must be wide, and tall enough for its rows."""
    need = F.greatest(F.lit(0.035), F.least(F.lit(0.18), rows * 0.014))
    return F.coalesce((bbox[2] - bbox[0] >= 0.35) & (bbox[3] - bbox[1] >= need), F.lit(False))


GAP = 0.018


def infer_table_boxes(items: DataFrame) -> DataFrame:
    """Estimated boxes for tables without a usable one: each below what stands before it on the page, above what stands after it.

    ``items``: (document_id, page, source_index, is_table, text, bbox). Windows over a page's items give each such table its solid neighbours,
    the next table's hint (the top of its unusable box) and the page's mean height of a table row; one fold over the page's few loose tables
    places them in order, since a placed table stands before the next one. Pages without such a table are not grouped.
    """
    rows = F.when(F.col("is_table"), markdown_row_count(F.col("text"))).otherwise(1)
    shaped = items.select(*PAGE, "source_index", "is_table", rows.alias("rows"), "bbox")
    solid = F.when(F.col("is_table"), usable_table_box(F.col("bbox"), F.col("rows"))).otherwise(F.col("bbox").isNotNull())
    shaped = shaped.withColumn("solid", solid).where(F.col("is_table") | F.col("solid"))
    wanted = shaped.where("is_table and not solid").select(*PAGE).distinct()
    b, i, on_page = F.col("bbox"), F.col("source_index"), Window.partitionBy(*PAGE)
    before = on_page.orderBy(i.cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    after = on_page.orderBy(i.cast("long").desc()).rangeBetween(Window.unboundedPreceding, -1)
    span = F.when(F.col("solid"), F.struct(i.alias("index"), b[1].alias("top"), b[3].alias("bottom")))
    hint = F.when(~F.col("solid") & b.isNotNull(), F.struct(i.alias("index"), b[1].alias("top")))
    height = F.when(F.col("is_table") & F.col("solid") & (b[3] > b[1]), (b[3] - b[1]) / F.col("rows"))
    near = shaped.join(wanted, PAGE, "left_semi").select(
        *PAGE, "source_index", "solid", "rows", hint["top"].alias("hint"), F.max(span).over(before).alias("previous"), F.min(span).over(after)["top"].alias("next_top"),
        F.min(hint).over(after)["top"].alias("next_hint"), F.avg(height).over(on_page).alias("height"))
    line = F.least(F.lit(0.028), F.greatest(F.lit(0.012), F.coalesce("height", F.lit(0.018))))
    loose = near.where(~F.col("solid")).select(*PAGE, F.struct("source_index", "hint", "rows", line.alias("line"), "previous", "next_top", "next_hint").alias("t"))

    def place(state, t):
        placed = F.when(state["index"].isNotNull() & (t["previous"].isNull() | (state["index"] >= t["previous"]["index"])), state["bottom"]).otherwise(t["previous"]["bottom"])
        floor = F.coalesce(placed + GAP, F.lit(0.06))
        top = F.least(F.lit(0.92), F.greatest(F.lit(0.04), floor, F.coalesce(t["hint"], floor)))
        limit = F.least(top + F.greatest(F.lit(0.06), t["rows"] * t["line"]), t["next_top"] - GAP, t["next_hint"] - GAP)
        bottom = F.greatest(top + 0.06, F.least(F.lit(0.96), limit))
        box = F.struct(t["source_index"].alias("source_index"), F.array(F.lit(0.035), F.round(top, 4), F.lit(0.965), F.round(bottom, 4)).alias("bbox"))
        return F.struct(t["source_index"].cast("int").alias("index"), F.round(bottom, 4).alias("bottom"), F.concat(state["boxes"], F.array(box)).alias("boxes"))
    kind = dict(items.dtypes)["source_index"]
    start = F.expr(f"named_struct('index', cast(null as int), 'bottom', cast(null as double), 'boxes', cast(array() as array<struct<source_index:{kind},bbox:array<double>>>))")
    folded = loose.groupBy(*PAGE).agg(F.array_sort(F.collect_list("t")).alias("tables"))
    return folded.select(*PAGE, F.inline(F.aggregate("tables", start, place, lambda x: x["boxes"])))


def match_grounding_items(items: DataFrame, grounded: DataFrame) -> DataFrame:
    """Sidecar item of each layout item: same index and type, else the first of its type with equal text."""
    key = [*PAGE, "block_type"]
    by_index = grounded.select(*key, F.col("source_index"), F.col("source_index").alias("_same"))
    by_text = grounded.where(F.col("text") != "").groupBy(*key, "text").agg(F.min("source_index").alias("_text"))
    return (items.join(by_index, [*key, "source_index"], "left").join(by_text, [*key, "text"], "left")
            .withColumn("grounded_index", F.coalesce("_same", "_text")).drop("_same", "_text"))


def grounded_line_blocks(items: DataFrame) -> DataFrame:
    """Item text cut by line spans into typed, boxed blocks; lines with empty text or no box are dropped.

    ``items``: (document_id, page, source_index, type, text, lines array<struct<start,end,rects>>, page_width, page_height).
    """
    lines = items.select(*PAGE, "source_index", "type", F.col("text").alias("item_text"), "page_width", "page_height",
                         F.posexplode("lines").alias("line_index", "line"))
    cut = strip(F.substring("item_text", F.col("line.start") + 1, F.col("line.end") - F.col("line.start")))
    typed = block_type_map(F.col("type"), strip(F.col("item_text")))
    out = lines.withColumn("block_type", typed).withColumn("cut", cut).where("cut <> ''")
    box = bbox_union(F.col("line.rects"), F.col("page_width"), F.col("page_height"))
    return (out.select(*PAGE, "source_index", "line_index", "block_type",
                       F.when(F.col("block_type") == "list", list_text(F.col("cut"))).otherwise(F.col("cut")).alias("text"), box.alias("bbox"))
            .where("bbox is not null"))


def layout_order(blocks: DataFrame) -> DataFrame:
    """Reading order per page: boxed first, then top, left, source index, line index."""
    boxed = F.when(F.col("bbox").isNull(), 1).otherwise(0)
    top, left = F.coalesce(F.col("bbox")[1], F.lit(1.0)), F.coalesce(F.col("bbox")[0], F.lit(0.0))
    line = F.coalesce(F.col("line_index"), F.lit(10 ** 9)) if "line_index" in blocks.columns else F.lit(10 ** 9)
    return ranked(blocks, PAGE, boxed * 1000 + F.floor(top * 100), [boxed, top, left, F.coalesce("source_index", F.lit(10 ** 9)), line], rank="position")


BLOCK = [*PAGE, "block_type", "text", "bbox", "source_index", "line_index"]


def layout_page_merge(lines: DataFrame, tables: DataFrame, lists: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of every page: grounded lines, tables and lists not already present, else the page's plain text.

    ``pages``: (document_id, page, markdown, text), one row per page known to any source.
    """
    shape = lambda df: df.select(*PAGE, "block_type", "text", "bbox", "source_index",
                                 F.col("line_index") if "line_index" in df.columns else F.lit(None).cast("int").alias("line_index"))
    have = lines.where("block_type = 'table'").select(*PAGE, "text").distinct()
    fresh = tables.where("text <> '' or bbox is not null").join(have, [*PAGE, "text"], "left_anti")
    grounded_items = lines.select(*PAGE, "source_index").distinct()
    listed = lists.where("text <> ''").join(grounded_items, [*PAGE, "source_index"], "left_anti")
    blocks = shape(lines).unionByName(shape(fresh)).unionByName(shape(listed))
    bare = pages.join(blocks.select(*PAGE).distinct(), PAGE, "left_anti")
    content = F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(F.coalesce("text", F.lit("")))
    rows = F.filter(F.transform(F.split(content, LINE_BREAK), strip), lambda s: s != "")
    filled = bare.select(*PAGE, rows.alias("r")).select(*PAGE, F.size("r").alias("n"), F.posexplode("r").alias("i", "text"))
    top = F.least(F.lit(0.92), 0.06 + F.col("i") / F.col("n") * 0.84)
    plain = filled.select(*PAGE, F.lit("text").alias("block_type"), "text", F.array(F.lit(0.06), F.round(top, 4), F.lit(0.94), F.round(F.least(F.lit(0.98), top + 0.04), 4)).alias("bbox"),
                          F.col("i").alias("source_index"), F.lit(None).cast("int").alias("line_index"))
    return layout_order(blocks.unionByName(plain))


def layout_text_items(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Flat text items (document_id, page, source_index, text, bbox) on their pages; pages without items are kept."""
    every = page_counts.select("document_id", F.explode(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))).alias("page"))
    box = F.coalesce("bbox", F.array(*[F.lit(x) for x in (0.06, 0.06, 0.94, 0.1)]))
    return every.join(items.select(*PAGE, "source_index", "text", box.alias("bbox")), PAGE, "left")


def ocr_words_to_lines(words: DataFrame) -> DataFrame:
    """Word boxes to line blocks: union box, mean confidence / 100, words joined; words taller than 12% of the page are noise.

    ``words``: (document_id, page, block, par, line, pos, text, left, top, width, height, conf, page_width, page_height).
    """
    good = words.where((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("height") <= F.col("page_height") * 0.12))
    r = lambda v, size: F.round(v / F.first(size), 4)
    return good.groupBy(*PAGE, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("w")))), lambda s: s["w"]), " ").alias("text"),
        F.array(r(F.min("left"), "page_width"), r(F.min("top"), "page_height"),
                r(F.max(F.col("left") + F.col("width")), "page_width"), r(F.max(F.col("top") + F.col("height")), "page_height")).alias("bbox"),
        (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"))


def document_text(blocks: DataFrame) -> DataFrame:
    """Block texts joined by newline in page and source order; the output is one document's text per row."""
    parts = F.array_sort(F.collect_list(F.struct("page", "source_index", "text")))
    return blocks.where("text <> ''").groupBy("document_id").agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n").alias("text"))


def valid_evidence(evidence: Column, value: Column, page_count: Column) -> Column:
    """Well-formed regions of an evidence JSON array, deduplicated, as {bbox, page, text} texts; none for null values.

    Malformed geometry is dropped, never clamped into apparent evidence.
    """
    def clean(e):
        page, text = J.member(e, "page"), J.member(e, "text")
        box = J.elements(J.member(e, "bbox"))
        n = page.try_cast("int")
        at = lambda i: F.get(box, F.lit(i)).try_cast("double")
        numbers = (F.size(box) == 4) & F.forall(box, lambda b: (J.kind(b) == "number") & F.coalesce(b.try_cast("double").between(0, 1), F.lit(False)))
        ok = (page.rlike(r"^\d+$") & (n >= 1) & (page_count.isNull() | (page_count <= 0) | (n <= page_count)) & numbers
              & (at(0) < at(2)) & (at(1) < at(3)) & (text.isNull() | (J.kind(text) == "string")))
        shown = F.concat(F.lit('{"bbox":['), F.array_join(box, ","), F.lit('],"page":'), page, F.lit(',"text":'), F.coalesce(text, F.lit('""')), F.lit("}"))
        return F.when(F.coalesce(ok, F.lit(False)), shown)
    none = F.array().cast("array<string>")
    kept = F.array_distinct(F.filter(F.transform(J.elements(evidence), clean), lambda e: e.isNotNull()))
    return F.when(J.is_null(value) | (J.kind(evidence) != "array") | evidence.isNull(), none).otherwise(F.coalesce(kept, none))


def evidence_text_join(needles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, needle) x boxed blocks of the same document whose text holds it.

    A document's distinct needles travel as one array to its blocks: the join emits one row per block, matches
    are exploded from it, and no value-block pair that does not match is ever materialized.
    """
    listed = (needles.where(F.col("needle") != "").select("document_id", "needle").distinct()
              .withColumn("_c", T.compact_alnum(F.col("needle"))).groupBy("document_id")
              .agg(F.collect_list(F.struct(F.col("needle"), F.lower("needle").alias("low"), F.col("_c").alias("compact"))).alias("_needles")))
    shaped = blocks.where("bbox is not null and text <> ''").join(listed, "document_id")
    shaped = shaped.withColumn("_low", F.lower("text")).withColumn("_compact", T.compact_alnum(F.col("text")))
    match = F.filter("_needles", lambda n: F.contains(F.col("_low"), n["low"]) | ((n["compact"] != "") & F.contains(F.col("_compact"), n["compact"])))
    keep = [c for c in blocks.columns]
    return shaped.select(*keep, F.explode(match["needle"]).alias("needle"))


def best_evidence(matches: DataFrame, keys: list[str] = ["document_id", "needle"], more: list[str] = []) -> DataFrame:
    """Earliest page, grounded before inferred, smallest area, lowest source index: a map-side combined min_by.

    ``more``: further columns of the block to keep."""
    b = F.col("bbox")
    area = F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])
    order = F.struct(F.col("page").alias("a"), F.when(F.col("bbox_source") == "inferred", 1).otherwise(0).alias("b"), area.alias("c"),
                     F.coalesce("source_index", F.lit(10 ** 9)).alias("d"))
    return matches.groupBy(*keys).agg(F.min_by(F.struct("page", "bbox", "text", "block_id", "bbox_source", *more), order).alias("evidence"))


def evidence_for_fields(fields: DataFrame, blocks: DataFrame, parsers: DataFrame) -> DataFrame:
    """Fields with their supplied evidence, else the best matching block where the parser saw the real layout.

    ``fields``: (document_id, field_path, value_json, evidence array of texts); ``parsers``: (document_id, parser_status).
    """
    df = J.sealed(fields, fields.columns, [J.value_needle(F.col("value_json")).alias("needle")])
    lacking = df.where((F.size("evidence") == 0) & (F.coalesce("needle", F.lit("")) != ""))
    seen = parsers.where("parser_status = 'available'").select("document_id")
    best = best_evidence(evidence_text_join(lacking.join(seen, "document_id", "left_semi"), blocks))
    joined = df.join(best.withColumnRenamed("evidence", "_best"), ["document_id", "needle"], "left")
    return joined.withColumn("matched", F.when(F.size("evidence") == 0, F.col("_best"))).drop("_best", "needle")


def citation_areas(evidence: Column, pages: Column) -> Column:
    """Boxes as percent left/top/width/height; absolute boxes are divided by their page's size; duplicates collapse.

    ``evidence``: array<struct<page,bbox>>, ``pages``: map<int, struct<width,height>>.
    """
    def area(e):
        b, size = e["bbox"], pages[e["page"]]
        absolute = F.array_max(b) > 1
        w, h = F.when(absolute, size["width"]).otherwise(1.0), F.when(absolute, size["height"]).otherwise(1.0)
        unit = lambda v, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / s))
        usable = (F.size(b) == 4) & (e["page"] >= 1) & (w > 0) & (h > 0)
        l, t, r, d = (unit(b[i], F.when(s > 0, s)) for i, s in enumerate((w, h, w, h)))
        return F.when(usable & (r > l) & (d > t), F.struct(e["page"].alias("page"), (l * 100).alias("left"), (t * 100).alias("top"),
                                                          ((r - l) * 100).alias("width"), ((d - t) * 100).alias("height")))
    return F.array_distinct(F.filter(F.transform(evidence, area), lambda a: a.isNotNull()))


def grounding_rate(fields: DataFrame) -> DataFrame:
    """Per field: share of rows with evidence, and the share of estimated boxes among them."""
    has = F.col("matched").isNotNull()
    return fields.groupBy("field_path").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(has).alias("grounded"), F.avg(F.when(has, 1.0).otherwise(0.0)).alias("grounding_rate"),
        F.avg(F.when(has, F.when(F.col("matched.bbox_source") == "inferred", 1.0).otherwise(0.0))).alias("estimated_rate"))
