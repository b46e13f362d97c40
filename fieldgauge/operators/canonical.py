"""Canonical output: every schema field of a document's output with value, evidence and provenance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from .layout import best_evidence, evidence_text_join
from .validate import with_leaf

EVIDENCE = "array<struct<page:int,bbox:array<double>,text:string,block_id:string,metadata:map<string,string>>>"
# What an evidence item may say beside its metadata, and what a block's evidence keeps of it.
SAID = ("bbox_source", "grounding", "source_index")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    steps = "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(v, "$" + steps, kind)


def _is(v: Column, *kinds: str) -> Column:
    """Is a variant of one of these kinds? Numbers keep apart whole (BIGINT) and fractional ones."""
    found, test = F.schema_of_variant(v), F.lit(False)
    for k in kinds:
        test = test | F.startswith(found, F.lit(k))
    return F.coalesce(test, F.lit(False))


def _region(e: Column, page_count: Column) -> Column:
    """An evidence item as a region, null if its geometry or text is malformed: boxes are rejected, never clamped."""
    page, box, words, meta = (_at(e, k) for k in ("page", "bbox", "text", "metadata"))
    number = _at(e, "page", "long")
    corners = F.transform(F.when(_is(box, "ARRAY"), box).try_cast("array<variant>"), lambda b: F.when(_is(b, "BIGINT", "DECIMAL", "DOUBLE"), b.try_cast("double")))
    fine = F.forall(corners, lambda c: F.coalesce(c.between(0, 1), F.lit(False))) & (F.size(corners) == 4)
    a, b, c, d = (F.get(corners, F.lit(i)) for i in range(4))
    good = (_is(e, "OBJECT") & _is(page, "BIGINT") & (number >= 1) & (page_count.isNull() | (page_count <= 0) | (number <= page_count)) & fine & (a < c) & (b < d)
            & (words.isNull() | _is(words, "STRING")))
    none = F.create_map().cast("map<string,string>")
    text_of = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    own = F.transform_values(F.when(_is(meta, "OBJECT"), meta).try_cast("map<string,variant>"), lambda k, v: text_of(v))
    more = F.array(*[F.struct(F.lit(k).alias("key"), F.when(_at(e, k).isNotNull(), text_of(_at(e, k))).alias("value")) for k in SAID])
    own = F.coalesce(own, none)
    new = F.map_from_entries(F.filter(more, lambda m: m["value"].isNotNull() & ~F.map_contains_key(own, m["key"])))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(
        number.cast("int").alias("page"), corners.alias("bbox"), F.coalesce(_at(e, "text", "string"), F.lit("")).alias("text"),
        _at(e, "block_id", "string").alias("block_id"), F.map_concat(own, new).alias("metadata")))


def output_fields(outputs: DataFrame, leaves: DataFrame, output: str = "output_json") -> DataFrame:
    """One row for each document and schema leaf with what the output says of it, wrapped (an object with a ``value``) or bare.

    An output is parsed once and read by the leaves' paths, nested objects only. Output that is not JSON gives null fields.
    """
    paths = [(r["field_path"], r["type"]) for r in leaves.select("field_path", "type").collect()]  # schema-sized
    parsed = outputs.select("document_id", F.try_parse_json(output).alias("o"))
    cells = [F.struct(F.lit(p).alias("field_path"), F.lit(t).cast("string").alias("type"), _at(F.col("o"), p).alias("raw")) for p, t in paths]
    if not cells:
        raise ValueError("the schema has no leaves")
    rows = parsed.select("document_id", F.inline(F.array(*cells)))
    wrapped = _is(F.col("raw"), "OBJECT") & _at(F.col("raw"), "value").isNotNull()
    rows = rows.withColumn("wrapped", wrapped)
    inner = lambda name: F.when(F.col("wrapped"), _at(F.col("raw"), name))
    as_object = F.when(_is(F.col("raw"), "OBJECT"), F.col("raw"))
    text_at = lambda name: F.try_variant_get(as_object, f"$.{name}", "string")
    value = F.when(F.col("wrapped"), _at(F.col("raw"), "value")).otherwise(F.col("raw"))
    json_at = lambda name: F.to_json(F.try_variant_get(as_object, f"$.{name}", "variant"))
    confidence = F.when(_is(inner("confidence"), "BIGINT", "DECIMAL", "DOUBLE"), inner("confidence").try_cast("double"))
    errors = F.transform(F.when(_is(inner("errors"), "ARRAY"), inner("errors")).try_cast("array<variant>"), lambda e: F.coalesce(e.try_cast("string"), F.to_json(e)))
    evidence = F.when(_is(inner("evidence"), "ARRAY"), inner("evidence")).try_cast("array<variant>")
    model = F.try_variant_get(as_object, "$.harness_provenance.model", "string")
    return rows.select(
        "document_id", "field_path", "type",
        F.when(F.col("raw").isNotNull(), J.canonical(F.coalesce(F.to_json(value), F.lit("null")))).alias("value_json"), T.valid_confidence(confidence).alias("confidence"),
        F.coalesce(errors, F.array().cast("array<string>")).alias("errors"), evidence.alias("_evidence"), F.nullif(model, F.lit("")).alias("_model"),
        json_at("harness_provenance").alias("harness"), json_at("selection").alias("selection"), text_at("confidence_source").alias("_said"))


def canonical_output(outputs: DataFrame, leaves: DataFrame, blocks: DataFrame, parsers: DataFrame, processor_version_id: str, model: str, output: str = "output_json") -> DataFrame:
    """(document_id, field_path, value_json, normalized_json, confidence, errors, evidence, provenance), a row for each document and leaf.

    Evidence is what the output itself cites in well-formed regions. Where it cites none, and the parser saw the real layout, it is the block that
    best shows the value: earliest page, grounded before inferred, smallest area, lowest source index (one map-side combined ``min_by``).
    ``parsers``: (document_id, parser_status, parser_json, page_count); ``blocks``: (document_id, page, block_id, source_index, text, bbox, bbox_source).
    Provenance names the processor version, the model of the field's harness or else the run's, its harness, selection and parser, and the source of
    a confidence that counts.
    """
    known = parsers.select("document_id", "parser_status", "parser_json", F.col("page_count").alias("_pages"))
    fields = output_fields(outputs, leaves, output).join(known, "document_id", "left")
    regions = F.filter(F.transform("_evidence", lambda e: _region(e, F.col("_pages"))), lambda r: r.isNotNull())
    named = J.extraction_normalize(fields, "value_json", F.col("type"))
    cited = J.sealed(named, [c for c in named.columns if c not in ("_evidence", "_pages")], [
        F.coalesce(regions, F.array()).cast(EVIDENCE).alias("_cited"), J.value_needle(F.col("value_json")).alias("needle")])
    lacking = cited.where((F.size("_cited") == 0) & (F.col("parser_status") == "available") & (F.coalesce("needle", F.lit("")) != ""))
    best = best_evidence(evidence_text_join(lacking, blocks), more=[c for c in SAID[1:] if c in blocks.columns]).withColumnRenamed("evidence", "_best")
    joined = cited.join(best, ["document_id", "needle"], "left")
    b = F.col("_best")
    has = [c for c in SAID if c in blocks.columns]
    kept = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), (b[k] if k == "source_index" else J.quote(b[k])).cast("string").alias("value")) for k in has]), lambda m: m["value"].isNotNull()))
    shown = F.array(F.struct(b["page"].alias("page"), b["bbox"].alias("bbox"), b["text"].alias("text"), b["block_id"].alias("block_id"), kept.alias("metadata"))).cast(EVIDENCE)
    fallback = (F.size("_cited") == 0) & (F.col("parser_status") == "available") & b.isNotNull()
    provenance = F.struct(
        F.lit(processor_version_id).alias("processor_version_id"), F.coalesce("_model", F.lit(model)).alias("model"), F.col("harness"), F.col("selection"),
        F.when(F.col("confidence").isNotNull(), F.col("_said")).alias("confidence_source"), F.col("parser_json").alias("parser"))
    return joined.select("document_id", "field_path", "value_json", "normalized_json", "confidence", "errors",
                         F.when(fallback, shown).otherwise(F.col("_cited")).alias("evidence"), provenance.alias("provenance"))
