"""Field schemas: JSON Schema leaves as a small dimension, scoring settings."""
from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

LEAF_FIELDS = ("field_path string, pos int, type string, format string, required boolean, enum array<string>, "
               "min_length int, max_length int, pattern string, pattern_valid boolean, minimum double, maximum double, "
               "not_blank boolean, date_lte_today boolean, item_type string, item_types map<string,string>")


@dataclass(frozen=True)
class ScoringConfig:
    """Per-run scoring settings."""
    numeric_tolerance: str | None = None
    edit_distance_max: int = 0
    required_fields: tuple[str, ...] = ()
    include_hallucinations: bool = False


def _valid_regex(pattern):
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def leaf_rows(schema: dict, prefix: str = "", required: bool = False) -> list[dict]:
    """Leaves of one JSON Schema in declaration order: arrays are leaves, empty objects vanish."""
    if schema.get("type") != "object":
        rules = schema.get("validation") or {}
        items = schema.get("items") or {}
        pattern = schema.get("pattern")
        enum = rules.get("enum", schema.get("enum"))
        return [dict(
            field_path=prefix, type=schema.get("type"), format=schema.get("format"), required=required,
            enum=[json.dumps(e, ensure_ascii=False) for e in enum] if enum is not None else None,
            min_length=schema.get("minLength"), max_length=schema.get("maxLength"),
            pattern=pattern if pattern and _valid_regex(pattern) else None,
            pattern_valid=_valid_regex(pattern) if pattern else None,
            minimum=rules.get("minimum", rules.get("min", schema.get("minimum"))),
            maximum=rules.get("maximum", rules.get("max", schema.get("maximum"))),
            not_blank=bool(rules.get("not_blank")), date_lte_today=bool(rules.get("date_lte_today")),
            item_type=items.get("type"),
            item_types={k: v.get("type") for k, v in (items.get("properties") or {}).items()} or None)] if prefix else []
    wanted = set(schema.get("required") or [])
    return [row for key, child in (schema.get("properties") or {}).items()
            for row in leaf_rows(child, f"{prefix}.{key}" if prefix else key, key in wanted)]


def leaf_grid(documents: DataFrame, keys: list[str], leaves: DataFrame, *columns: str) -> DataFrame:
    """Every document with every leaf's ``columns``: a literal array of schema size, exploded in one narrow step."""
    rows = getattr(leaves, "_rows", None) or [r.asDict() for r in leaves.select(*columns).collect()]
    kinds = dict(leaves.dtypes)
    cells = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in columns]) for r in rows]
    none = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in columns) + ">>")
    return documents.select(*keys, F.inline(F.array(*cells) if cells else none))


def has_arrays(leaves: DataFrame) -> bool:
    """Does the schema have array leaves? Without them scoring stays in compiled code. Leaves are schema-sized."""
    rows = getattr(leaves, "_rows", None)
    return not leaves.where("type = 'array'").isEmpty() if rows is None else any(r["type"] == "array" for r in rows)


def schema_leaves(spark: SparkSession, schema: dict) -> DataFrame:
    """The leaf dimension of a schema. Its size is that of the schema document, so joins to it broadcast."""
    rows = []
    for pos, leaf in enumerate(leaf_rows(schema)):
        rows.append({**leaf, "pos": pos})
    # A literal table: its size is known to the optimizer, unlike that of a parallelized list.
    literal = json.dumps(rows, ensure_ascii=False)
    parsed = F.from_json(F.lit(literal), f"array<struct<{LEAF_FIELDS}>>")
    leaves = spark.range(1).select(F.inline(parsed))
    leaves._rows = rows
    return leaves
