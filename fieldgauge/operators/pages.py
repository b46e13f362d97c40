"""Pages of a parsed document from four raw sources: items, markdown, plain text and grounded items."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialized
from . import layout as L
from .layout import LINE_BREAK, PAGE, strip

ITEMS, MARKDOWN, TEXT, GROUNDED = 1, 2, 4, 8
BLOCK = [*PAGE, "block_id", "block_type", "text", "bbox", "bbox_source", "source_index", "line_index"]


def aligned_pages(items: DataFrame, markdown: DataFrame, text: DataFrame, grounded: DataFrame) -> DataFrame:
    """(document_id, page, sources, width, height, markdown, text): every page that any source knows, in one grouping.

    ``sources`` is a mask of ITEMS, MARKDOWN, TEXT and GROUNDED. A size is the items' own, else the grounded items', else 1. Rows of a source without
    items (null ``source_index``) still make their page known.
    """
    def part(df: DataFrame, bit: int, **has) -> DataFrame:
        size = lambda name, on: (F.when(F.col(name) > 0, F.col(name)) if on else F.lit(None)).cast("double")
        return df.select(
            *PAGE, F.lit(bit).alias("bit"), *[size(f"page_{side}", bit == kind).alias(f"{side}_{kind}") for side in ("width", "height") for kind in (ITEMS, GROUNDED)],
            *[(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in ("markdown", "text")])
    rows = (part(items, ITEMS).unionByName(part(markdown, MARKDOWN, markdown=1)).unionByName(part(text, TEXT, text=1)).unionByName(part(grounded, GROUNDED)))
    side = lambda name: F.coalesce(F.max(f"{name}_{ITEMS}"), F.max(f"{name}_{GROUNDED}"), F.lit(1.0))
    return rows.groupBy(*PAGE).agg(F.bit_or("bit").alias("sources"), side("width").alias("width"), side("height").alias("height"), F.max("markdown").alias("markdown"), F.max("text").alias("text"))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """A box in [0, 1] from one in page units or already in [0, 1]; null if it is missing, short or degenerate."""
    scaled = F.array_max(box) > 1
    w, h = F.when(scaled, width).otherwise(1.0), F.when(scaled, height).otherwise(1.0)
    unit = lambda v, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)), 4)
    x0, y0, x1, y1 = (unit(F.get(box, F.lit(k)), size) for k, size in enumerate((w, h, w, h)))
    return F.when((F.size(box) >= 4) & (w > 0) & (h > 0) & (x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def plain_blocks(pages: DataFrame) -> DataFrame:
    """The trimmed, non-empty lines of a page's content, with evenly spread synthetic boxes."""
    rows = F.filter(F.transform(F.split("content", LINE_BREAK), strip), lambda s: s != "")
    lines = pages.select(*PAGE, rows.alias("r")).select(*PAGE, F.size("r").alias("n"), F.posexplode("r").alias("i", "text"))
    top = F.least(F.lit(0.92), 0.06 + F.col("i") / F.col("n") * 0.84)
    box = F.array(F.lit(0.06), F.round(top, 4), F.lit(0.94), F.round(F.least(F.lit(0.98), top + 0.04), 4))
    return lines.select(*PAGE, F.format_string("p%d-b%d", F.col("page").cast("int"), F.col("i") + 1).alias("block_id"), F.lit("text").alias("block_type"), "text", box.alias("bbox"),
                        F.lit("synthetic").alias("bbox_source"), F.col("i").alias("source_index"), F.lit(None).cast("int").alias("line_index"))


def merge_page_sources(items: DataFrame, markdown: DataFrame, text: DataFrame, grounded: DataFrame) -> DataFrame:
    """Blocks of every page in reading order: grounded lines, tables, lists, else whatever the page has.

    ``items``: (document_id, page, page_width, page_height, source_index, type, text, bbox), boxes in page units or [0, 1].
    ``grounded``: the same pages' sidecar (…, source_index, type, text, lines array<struct<start,end,rects>>, bbox), where ``bbox`` is the box of a table's cells.
    ``markdown``: (document_id, page, markdown), ``text``: (document_id, page, text).

    A table is boxed by its sidecar item, else by itself; if its own box cannot hold its rows, by the space between its neighbours (``infer_table_boxes``).
    It is left out if it has neither text nor box, or if a grounded block of the page is the same table. A list is left out if its sidecar item was cut into lines.
    A page without any such block shows its items; one without items its markdown, else its text.
    """
    pages = materialized(aligned_pages(items, markdown, text, grounded), "pages")
    sizes = pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    known = grounded.where("source_index IS NOT NULL").drop("page_width", "page_height").join(sizes, PAGE)
    cut = L.grounded_line_blocks(known)
    lines = materialized(cut.select(*PAGE, F.format_string("p%d-g%d-%d", F.col("page").cast("int"), F.col("source_index") + 1, F.col("line_index") + 1).alias("block_id"), "block_type", "text", "bbox",
                       F.lit("grounding").alias("bbox_source"), F.col("source_index").cast("int").alias("source_index"), F.col("line_index").cast("int").alias("line_index")), "page-lines")

    shaped = items.where("source_index IS NOT NULL").drop("page_width", "page_height").join(sizes, PAGE)
    words = F.coalesce("text", F.lit(""))
    shaped = shaped.select(*PAGE, F.col("source_index").cast("int").alias("source_index"), L.block_type_map(F.col("type"), words).alias("block_type"), words.alias("text"),
                           unit_box(F.col("bbox"), F.col("page_width"), F.col("page_height")).alias("bbox"))
    side = known.select(*PAGE, "source_index", L.block_type_map(F.col("type"), F.coalesce("text", F.lit(""))).alias("block_type"), F.coalesce("text", F.lit("")).alias("text"),
                        unit_box(F.col("bbox"), F.col("page_width"), F.col("page_height")).alias("cells"), (F.coalesce(F.size("lines"), F.lit(0)) > 0).alias("lined"))
    matched = L.match_grounding_items(shaped, side).join(side.select(*PAGE, F.col("source_index").alias("grounded_index"), "cells", "lined"), [*PAGE, "grounded_index"], "left")
    matched = materialized(matched, "page-items")  # tables, lists and the rest are taken from it

    # grounded blocks are neighbours too; several lines of one item count as one span
    spans = lines.groupBy(*PAGE, "source_index").agg(F.min(F.col("bbox")[0]).alias("a"), F.min(F.col("bbox")[1]).alias("b"), F.max(F.col("bbox")[2]).alias("c"), F.max(F.col("bbox")[3]).alias("d"))
    around = spans.select(*PAGE, "source_index", F.lit(False).alias("is_table"), F.lit("").alias("text"), F.array("a", "b", "c", "d").alias("bbox"))
    tables = matched.where("block_type = 'table'")
    inferred = L.infer_table_boxes(tables.select(*PAGE, "source_index", F.lit(True).alias("is_table"), "text", "bbox").unionByName(around)).withColumnRenamed("bbox", "inferred")
    boxed = tables.join(inferred, [*PAGE, "source_index"], "left").withColumn("own", F.coalesce("cells", "bbox"))
    same = lines.where("block_type = 'table'").select(*PAGE, "text").distinct()
    numbered = lambda letter: F.format_string(f"p%d-{letter}%d", F.col("page").cast("int"), F.col("source_index") + 1).alias("block_id")
    none = F.lit(None).cast("int").alias("line_index")
    fresh = boxed.join(same, [*PAGE, "text"], "left_anti").withColumn("shown", F.coalesce("inferred", "own")).where("text <> '' OR shown IS NOT NULL")
    table_blocks = fresh.select(*PAGE, numbered("t"), "block_type", F.when(F.col("text") == "", "Table").otherwise(F.col("text")).alias("text"), F.col("shown").alias("bbox"),
                                F.when(F.col("inferred").isNotNull(), "inferred").when(F.col("cells").isNotNull(), "grounding").otherwise("item").alias("bbox_source"), "source_index", none)
    listed = matched.where("block_type = 'list' AND NOT coalesce(lined, false) AND text <> ''")
    list_blocks = listed.select(*PAGE, numbered("l"), "block_type", L.list_text(F.col("text")).alias("text"), "bbox", F.when(F.col("bbox").isNotNull(), "item").alias("bbox_source"), "source_index", none)
    blocks = materialized(lines.unionByName(table_blocks).unionByName(list_blocks), "page-blocks")

    with_blocks = blocks.select(*PAGE).distinct()
    at = F.least(F.lit(0.84), F.col("source_index") * 0.05)
    default = F.array(F.lit(0.06), F.round(0.06 + at, 4), F.lit(0.94), F.round(0.1 + at, 4))
    rest = matched.where("text <> ''").join(with_blocks, PAGE, "left_anti")
    item_blocks = rest.select(*PAGE, numbered("b"), "block_type", "text", F.coalesce("bbox", default).alias("bbox"), F.when(F.col("bbox").isNotNull(), "item").otherwise("synthetic").alias("bbox_source"), "source_index", none)
    blocks = blocks.unionByName(item_blocks)
    content = F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(F.coalesce("text", F.lit("")))
    bare = pages.join(blocks.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, content.alias("content"))
    return L.layout_order(blocks.select(*BLOCK).unionByName(plain_blocks(bare).select(*BLOCK)))
