"""Rule-based invoice extraction over a text corpus, and user-supplied extractors."""
from __future__ import annotations

import importlib
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J

# Invoice patterns and the heuristic confidence of each field.
PATTERNS = {
    "invoice_number": (r"(?im)invoice\s*(?:#|number|no\.?)\s*[:#]?\s*([A-Z0-9][A-Z0-9-]+)", r"(?im)\b(INV-[A-Z0-9-]+)\b"),
    "invoice_date": (r"(?im)(?:issued|invoice\s+date|date)\s*[:\-]?\s*(\d{4}-\d{2}-\d{2})",),
    "vendor.name": (r"(?im)vendor\s*[:\-]\s*([^\n]+)", r"(?im)^([A-Z][A-Z &.-]{3,})\s+INVOICE$"),
    "total": (r"(?im)(?:total\s+due|amount\s+due|grand\s+total|total)\s*[:\-]?\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]{2})?)",),
}
LINE_ITEM = r"(?im)^(.+?)\s+(\d+)\s+\$?([0-9][0-9,]*\.[0-9]{2})$"
CONFIDENCE = {"invoice_number": 0.98, "invoice_date": 0.95, "vendor.name": 0.96, "total": 0.97, "currency": 0.99, "line_items": 0.91}
FIELD_SCHEMA = "document_id string, field_path string, value_json string, confidence double, errors array<string>"


def _first(patterns: tuple[str, ...], text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def rule_extract(documents: DataFrame) -> DataFrame:
    """(document_id, field_path, value_json, confidence): six invoice fields per document; nulls where nothing matches."""
    text = F.col("text")
    amount = lambda s: F.regexp_replace(s, ",", "")
    parts = [F.regexp_extract_all(text, F.lit(LINE_ITEM), F.lit(g)) for g in (1, 2, 3)]
    rows = F.filter(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("d", "q", "a"))]),
                    lambda r: ~F.lower(F.trim(r["d"])).rlike("^(subtotal|tax|total)"))
    items = F.transform(rows, lambda r: F.concat(
        F.lit('{"amount":'), J.T.decimal_text(amount(r["a"]).cast("decimal(38,10)")), F.lit(',"description":'), J.quote(F.trim(r["d"])),
        F.lit(',"quantity":'), r["q"].cast("int").cast("string"), F.lit("}")))
    null = F.lit("null")
    values = {n: F.coalesce(J.quote(_first(p, text)), null) for n, p in PATTERNS.items() if n != "total"}
    values["total"] = F.coalesce(J.T.decimal_text(amount(_first(PATTERNS["total"], text)).try_cast("decimal(38,10)")), null)
    values["currency"] = F.when(F.contains(text, F.lit("$")) | text.rlike(r"(?i)\bUSD\b"), '"USD"').otherwise(null)
    values["line_items"] = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    cells = F.array(*[F.struct(F.lit(n).alias("field_path"), values[n].alias("value_json"), F.lit(c).alias("c")) for n, c in CONFIDENCE.items()])
    out = documents.select("document_id", F.explode(cells).alias("x")).select("document_id", "x.field_path", "x.value_json", "x.c")
    return out.select("document_id", "field_path", "value_json", F.when(F.col("value_json") != "null", F.col("c")).otherwise(0.0).alias("confidence"))


_EXTRACTORS: dict = {}


def register_extractor(name: str, fn) -> None:
    """Register ``fn(iterator of pandas.DataFrame) -> iterator of pandas.DataFrame`` under a name."""
    clean = str(name or "").strip().lower()
    if not clean or not callable(fn):
        raise ValueError("an extractor name and a callable are required")
    _EXTRACTORS[clean] = fn


def resolve_extractor(ref: str, group: str = "fieldgauge.extractors"):
    """A registered name, ``module:attribute``, or an installed entry point."""
    if ref.lower() in _EXTRACTORS:
        return _EXTRACTORS[ref.lower()]
    if ":" in ref:
        module, attribute = ref.split(":", 1)
        fn = getattr(importlib.import_module(module), attribute)
    else:
        found = [e for e in entry_points(group=group) if e.name == ref]
        if not found:
            raise ValueError(f"extractor not found: {ref}")
        fn = found[0].load()
    if not callable(fn):
        raise ValueError(f"extractor {ref} is not callable")
    return fn


SLICE = 4_000_000  # characters


def _slices(batches):
    """The rows of each batch, a few at a time: less than ``SLICE`` characters and one more row. What an extractor makes of them stays small."""
    for b in batches:
        size = sum(b[c].map(lambda v: len(v) if isinstance(v, (str, bytes)) else 0).astype("int64") for c in b.columns)
        for _, rows in b.groupby(size.cumsum() // SLICE):
            yield rows.reset_index(drop=True)


def run_extractor(documents: DataFrame, ref: str) -> DataFrame:
    """Apply an extractor to all documents, in slices of Arrow batches on the executors, and check its result columns."""
    fn, wanted = resolve_extractor(ref), ["document_id", "field_path", "value_json", "confidence", "errors"]

    def checked(batches):
        for out in fn(_slices(batches)):
            missing = [c for c in wanted if c not in out.columns]
            if missing:
                raise ValueError(f"extractor result lacks {missing}")
            yield out[wanted]
    return documents.mapInPandas(checked, FIELD_SCHEMA)
