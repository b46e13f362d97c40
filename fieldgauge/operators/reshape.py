"""Nested values to tall field rows and back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..schema import leaf_grid
from .validate import with_leaf

NONE = "array<struct<key:string,value:string>>"


def nesting(v: Column) -> Column:
    """How many objects stand inside each other in a JSON text, arrays not entered: one fold over its braces with a state of three numbers."""
    marks = F.filter(F.regexp_extract_all(v, F.lit(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]]'), F.lit(0)), lambda t: ~F.startswith(t, F.lit('"')))
    start = F.struct(F.lit(0).alias("objects"), F.lit(0).alias("arrays"), F.lit(0).alias("most"))

    def step(s, t):
        arrays = s["arrays"] + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)
        objects = s["objects"] + F.when(s["arrays"] > 0, 0).when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.struct(objects.alias("objects"), arrays.alias("arrays"), F.greatest(s["most"], objects).alias("most"))
    return F.coalesce(F.aggregate(marks, start, step, lambda s: s["most"]), F.lit(0))


def _descend(df: DataFrame, keys: list[str], value: str, stop: Column | None, max_depth: int | None) -> DataFrame:
    """Explode object members level by level in one narrow pass; a leaf passes through every level unchanged.

    Members are addressed by dotted paths. Without ``max_depth`` the deepest value is measured first, in one aggregation, and there are as many
    levels; with it, an object further down fails the job instead of being cut.
    """
    levels = max_depth
    if levels is None:
        levels = df.agg(F.max(nesting(F.col(value)))).first()[0] or 0
    cur = df.select(*keys, F.lit("").alias("field_path"), F.col(value).alias("v"))
    for _ in range(levels):
        inner = (J.kind(F.col("v")) == "object") & (~stop if stop is not None else F.lit(True))
        same = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value")))
        cur = cur.select(*keys, "field_path", F.explode(F.when(inner, J.members(F.col("v"))).otherwise(same)).alias("m"))
        path = (F.when(F.col("m.key").isNull(), F.col("field_path")).when(F.col("field_path") == "", F.col("m.key"))
                .otherwise(F.concat_ws(".", "field_path", "m.key")))
        cur = cur.select(*keys, path.alias("field_path"), F.col("m.value").alias("v"))
    if max_depth is not None:
        deeper = (J.kind(F.col("v")) == "object") & (~stop if stop is not None else F.lit(True))
        guard = F.when(deeper, F.raise_error(F.lit(f"value nested deeper than {max_depth} levels")).cast("string"))
        cur = cur.where(F.coalesce(guard, F.lit("")) == "")
    return cur.where("field_path <> ''")


def flatten_values(df: DataFrame, keys: list[str], value: str, max_depth: int | None = None) -> DataFrame:
    """(keys, field_path, value_json): dotted leaf paths of nested values of any depth; arrays stay whole, empty objects vanish."""
    return _descend(df, keys, value, None, max_depth).select(*keys, "field_path", J.canonical(F.col("v")).alias("value_json"))


def flatten_predictions(df: DataFrame, keys: list[str], value: str, max_depth: int | None = None) -> DataFrame:
    """Like flatten_values but an object holding a ``value`` member is one field; adds its unwrapped columns."""
    wrapped = F.contains("v", F.lit('"value"')) & J.member(F.col("v"), "value").isNotNull()
    flat = _descend(df, keys, value, wrapped, max_depth)
    return unwrap_fields(flat.select(*keys, "field_path", F.col("v").alias("raw_json")), "raw_json")


def unwrap_fields(df: DataFrame, raw: str) -> DataFrame:
    """Split ``{value, confidence, evidence, errors}`` (or a bare value) into columns."""
    r = F.col(raw)
    keep = df.columns
    df = df.withColumns({"_i": J.member(r, "value"), "_c": J.member(r, "confidence"), "_e": J.member(r, "errors"), "_v": J.member(r, "evidence")})
    wrapped = F.col("_i").isNotNull()
    df = df.withColumn("_x", F.when(wrapped, F.col("_i")).otherwise(r))
    return J.sealed(df, [c for c in keep if c not in ("value_json", "confidence", "errors")], [
        J.canonical(F.col("_x")).alias("value_json"),
        F.when(wrapped, T.valid_confidence(J.number(F.col("_c")).cast("double"))).alias("confidence"),
        F.when(wrapped, F.col("_v")).alias("evidence_json"),
        F.coalesce(F.when(wrapped, F.transform(J.elements(F.col("_e")), J.text)), F.array().cast("array<string>")).alias("errors")])


def path_lookup(wanted: DataFrame, flat: DataFrame, keys: list[str]) -> DataFrame:
    """Value at a path: a flattened key wins over the nested path; ``present`` tells missing from null."""
    f = flat.groupBy(*keys, "field_path").agg(
        F.max_by("value_json", F.when(F.col("is_flat"), 1).otherwise(0)).alias("value_json"), F.lit(True).alias("_p"))
    return (wanted.join(f, [*keys, "field_path"], "left")
            .withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p"))


def canonicalize(output: DataFrame, leaves: DataFrame, documents: DataFrame, keys: list[str], arrays: bool = True) -> DataFrame:
    """Schema leaves x output: one row per document and leaf with its normalized value; absent leaves are null rows.

    Paths outside the schema are dropped.
    """
    grid = leaf_grid(documents, keys, leaves, "field_path")
    have = [c for c in output.columns if c not in (*keys, "field_path", "normalized_json")]
    joined = with_leaf(grid.join(output.select(*keys, "field_path", *have), [*keys, "field_path"], "left"), leaves)
    return J.extraction_normalize(joined, "value_json", J.leaf("type")).drop("_leaf")


def unflatten_values(fields: DataFrame, keys: list[str], out: str = "value_json") -> DataFrame:
    """Nested JSON object per key from dotted paths of any depth, keys sorted; one aggregation.

    A document's fields are schema-bounded, so every group is small. In path order, each field closes the objects that
    it is not part of and opens those that are new. A path that is both a value and a parent fails the job.
    """
    parts = F.split("field_path", r"\.")
    rows = fields.select(*keys, F.struct(parts.alias("p"), F.col("value_json").alias("v")).alias("f")).groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("f"))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("text"))

    def put(s, f):
        up, seen = F.slice(f["p"], F.lit(1), F.size(f["p"]) - 1), s["open"]
        inside = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        same = F.size(F.filter(F.transform(up, lambda x, i: F.slice(up, F.lit(1), i + 1) == F.slice(inside, F.lit(1), i + 1)), lambda x: x))
        clash = (F.size(seen) > 0) & (F.slice(f["p"], F.lit(1), F.size(seen)) == seen)
        ends = F.repeat(F.lit("}"), F.size(inside) - same)
        begins = F.array_join(F.transform(F.slice(up, same + 1, F.greatest(F.size(up) - same, F.lit(0))), lambda x: F.concat(J.quote(x), F.lit(":{"))), "")
        comma = F.when(F.size(seen) > 0, F.lit(",")).otherwise(F.lit(""))
        line = F.concat(s["text"], ends, comma, begins, J.quote(F.element_at(f["p"], -1)), F.lit(":"), f["v"])
        guard = F.raise_error(F.concat(F.lit("a value and a parent: "), F.array_join(seen, "."))).cast("string")
        return F.struct(f["p"].alias("open"), F.when(clash, guard).otherwise(line).alias("text"))
    end = lambda s: F.concat(F.lit("{"), s["text"], F.repeat(F.lit("}"), F.greatest(F.size(s["open"]) - 1, F.lit(0))), F.lit("}"))
    return rows.select(*keys, F.aggregate("f", start, put, end).alias(out))


def project_schema(leaves: DataFrame, paths: list[str]) -> DataFrame:
    """Leaves selected by their own path or by a parent path; all of them for an empty list."""
    if not paths:
        return leaves
    keep = F.lit(False)
    for p in paths:
        keep = keep | (F.col("field_path") == p) | F.startswith("field_path", F.lit(p + "."))
    return leaves.where(keep)


def merge_scoped(current: DataFrame, incoming: DataFrame, leaves: DataFrame, keys: list[str], paths: list[str] | None = None) -> DataFrame:
    """Overlay incoming leaves that are inside the scope; a returned wrapped null also overwrites."""
    scope = leaves.select("field_path") if paths is None else leaves.where(F.col("field_path").isin(paths)).select("field_path")
    inside = incoming.join(scope, "field_path", "left_semi").select(*keys, "field_path", F.col("value_json").alias("_in"), F.lit(True).alias("_has"))
    return (current.select(*keys, "field_path", "value_json").join(inside, [*keys, "field_path"], "full")
            .select(*keys, "field_path", F.when(F.col("_has"), F.col("_in")).otherwise(F.col("value_json")).alias("value_json")))


def deep_merge(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Right-biased merge of flattened values: updated paths win, and replace whatever they cover or sit inside.

    Ancestor matches are equi-joins on exploded prefixes, both ways.
    """
    def prefixes(df):
        parts = F.split("field_path", r"\.")
        n = F.size(parts)
        above = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
        return df.select(*keys, "field_path", F.explode(above).alias("prefix"))
    new = updates.select(*keys, "field_path", "value_json")
    covered = prefixes(current).join(new.select(*keys, F.col("field_path").alias("prefix")), [*keys, "prefix"], "left_semi").select(*keys, "field_path")
    around = prefixes(new).select(*keys, F.col("prefix").alias("field_path"))
    same = new.select(*keys, "field_path")
    gone = covered.unionByName(around).unionByName(same).distinct()
    return current.select(*keys, "field_path", "value_json").join(gone, [*keys, "field_path"], "left_anti").unionByName(new)


def schema_leaves_table(schemas: DataFrame, max_depth: int = 12) -> DataFrame:
    """Leaf rows of many stored JSON Schemas: (processor_version_id, field_path, type, format, required).

    Levels are narrow steps of one pass; a schema nested deeper than ``max_depth`` fails the job instead of being cut.
    """
    key = "processor_version_id"
    cur = schemas.select(key, F.lit("").alias("field_path"), F.col("schema_json").alias("v"), F.lit(False).alias("required"))
    for _ in range(max_depth):
        is_object = J.text(J.member(F.col("v"), "type")) == "object"
        required = F.transform(J.elements(J.member(F.col("v"), "required")), J.text)
        same = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value")))
        children = F.coalesce(J.members(J.member(F.col("v"), "properties")), F.array().cast(NONE))
        cur = cur.select(key, "field_path", "required", required.alias("_req"), F.explode(F.when(is_object, children).otherwise(same)).alias("m"))
        path = (F.when(F.col("m.key").isNull(), F.col("field_path")).when(F.col("field_path") == "", F.col("m.key"))
                .otherwise(F.concat_ws(".", "field_path", "m.key")))
        cur = cur.select(key, path.alias("field_path"), F.col("m.value").alias("v"),
                         F.when(F.col("m.key").isNull(), F.col("required")).otherwise(F.coalesce(F.array_contains("_req", F.col("m.key")), F.lit(False))).alias("required"))
    deeper = J.text(J.member(F.col("v"), "type")) == "object"
    cur = cur.where(F.when(deeper, F.raise_error(F.lit(f"schema nested deeper than {max_depth} levels")).cast("boolean")).otherwise(F.lit(True)))
    return cur.where("field_path <> ''").select(key, "field_path", J.text(J.member(F.col("v"), "type")).alias("type"),
                                                J.text(J.member(F.col("v"), "format")).alias("format"), "required")
