"""JSON values travel as canonical text: VARIANT parses them, strings are compared and grouped."""
from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T


def kind(v: Column) -> Column:
    """JSON type of a value's text: string, number, boolean, null, array or object."""
    c = F.substring(F.ltrim(v), 1, 1)
    return (F.when(v.isNull(), None).when(c == '"', "string").when(c == "[", "array").when(c == "{", "object")
            .when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number"))


def text(v: Column) -> Column:
    """Scalar content as text (string contents unquoted); null for JSON null."""
    plain = F.substring(v, F.lit(2), F.length(v) - 2)
    k = F.substring(v, 1, 1)
    return (F.when(v == "null", None)
            .when((k == '"') & ~F.contains(v, F.lit("\\")), plain)
            .when(k == '"', F.try_variant_get(F.try_parse_json(v), "$", "string"))
            .otherwise(v))


def quote(x: Column) -> Column:
    """JSON string literal of a text column."""
    wrapped = F.to_json(F.struct(x.alias("v")))
    simple = ~x.rlike(r'["\\\x00-\x1f\x7f/]')
    return (F.when(x.isNull(), None).when(simple, F.concat(F.lit('"'), x, F.lit('"')))
            .otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)))


def number(v: Column) -> Column:
    """Decimal of a JSON number; null for every other kind."""
    return F.when(kind(v) == "number", v.try_cast("decimal(38,10)"))


def canonical(v: Column) -> Column:
    """Canonical JSON: sorted keys, compact, plain numbers; 0, false and "0" stay distinct."""
    k = kind(v)
    return (F.when(k.isin("object", "array"), F.to_json(F.try_parse_json(v)))
            .when(k == "number", F.coalesce(T.decimal_text(number(v)), v))
            .otherwise(F.trim(v)))


def digest(v: Column) -> Column:
    return F.sha2(canonical(v), 256)


def is_empty(v: Column) -> Column:
    """No value: absent, JSON null or the empty string."""
    return v.isNull() | v.isin("null", '""')


def elements(v: Column) -> Column:
    """Array elements as canonical JSON texts; null unless the value is an array."""
    arr = F.try_parse_json(F.when(kind(v) == "array", v)).cast("array<variant>")
    return F.transform(arr, lambda e: F.coalesce(F.to_json(e), F.lit("null")))


def members(v: Column) -> Column:
    """Object members as array<struct<key,value>> of canonical JSON texts, keys sorted."""
    obj = F.try_parse_json(F.when(kind(v) == "object", v)).cast("map<string,variant>")
    return F.transform(F.map_entries(obj), lambda e: F.struct(
        e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))


def member(v: Column, key: str) -> Column:
    """One member's JSON text; null when absent, 'null' when explicitly null."""
    path = "$['" + key + "']"
    got = F.try_variant_get(F.try_parse_json(F.when(kind(v) == "object", v)), path, "variant")
    return F.when(got.isNull(), None).otherwise(F.coalesce(F.to_json(got), F.lit("null")))


def is_null(v: Column) -> Column:
    return v.isNull() | (v == "null")


def let(x: Column, fn) -> Column:
    """Evaluate ``x`` once and use it many times (inside lambdas, where columns cannot be staged)."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def apart(x: Column, by: Column) -> Column:
    """``x`` itself, in a projection that Spark leaves out of its whole-stage code as it holds a lambda (over ``by``, any short column).

    The single method made of a long projection passes the 8,000 bytes up to which the JVM compiles methods, and would be interpreted for
    every row. On its own, the projection is split into small methods. Only ``by`` goes through the lambda, ``x`` stays compiled code.
    The lambda is never called: no text is shorter than nothing, so that its array is always null.
    """
    never = F.when(F.length(by.cast("string")) < 0, F.array(by))
    return F.when(F.exists(never, lambda e: e.isNotNull()).isNull(), x)


def _element_by_type(v: Column, type_: Column) -> Column:
    def of(k, t):
        return (F.when(v == "null", "null")
                .when(type_.isin("number", "integer"), F.coalesce(
                    F.when(k != "boolean", T.decimal_text(T.normal_number(t))), quote(T.normal_text(t))))
                .when(type_ == "string", quote(T.normal_text(t))).otherwise(canonical(v)))
    return let(F.struct(kind(v).alias("k"), text(v).alias("t")), lambda s: of(s["k"], s["t"]))


def normalize_array(v: Column, item_type: Column, item_types: Column) -> Column:
    """Array value with every element (or every property of an object element) in comparison form."""
    def element(e):
        by_property = F.concat(F.lit("{"), F.array_join(F.transform(members(e), lambda m: F.concat(
            quote(m["key"]), F.lit(":"), _element_by_type(m["value"], F.coalesce(item_types[m["key"]], F.lit(""))))), ","), F.lit("}"))
        return F.when(kind(e) == "object", by_property).otherwise(_element_by_type(e, F.coalesce(item_type, F.lit(""))))
    return F.concat(F.lit("["), F.array_join(F.transform(elements(v), element), ","), F.lit("]"))


def sealed(df: DataFrame, keep: list, computed: list) -> DataFrame:
    """Select ``keep`` and, through a one-element inline, ``computed``.

    Later filters stay above the inline instead of being rewritten into the (long) computing expressions;
    filters on the kept columns still reach the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def settled(df: DataFrame, keep: list, computed: list, by: Column) -> DataFrame:
    """As ``sealed``, but ``computed`` is worked out in compiled code below the inline: what stands inside an inline is interpreted. ``by``: see ``apart``."""
    made = df.select(*keep, apart(F.struct(*computed), by).alias("_made"))
    return made.select(*made.columns[:-1], F.inline(F.array("_made")))


def per_context(fn):
    """Build a set of columns once per SparkContext: long expressions cost many gateway calls."""
    cache: dict = {}

    @wraps(fn)
    def cached(*args):
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]
    return cached


def leaf(name: str) -> Column:
    """A rule of the joined field definition (see ``validate.with_leaf``)."""
    return F.col("_leaf")[name]


@per_context
def _stages(p: str, numbers: bool, arrays: bool, checks: bool) -> list[dict[str, Column]]:
    v, k, t, n, num, d, c, w, cv = (F.col(f"{p}_{s}") for s in ("v", "k", "t", "n", "num", "d", "c", "w", "cv"))
    type_, format_ = leaf("type"), F.coalesce(leaf("format"), F.lit(""))
    numeric = type_.isin("number", "integer")
    currency = (format_ == "currency") | ((type_ == "string") & F.endswith("field_path", F.lit("currency")))
    words = F.when(format_ == "date", F.coalesce(d, n)).when(c.isNotNull(), c).otherwise(n)
    norm = F.when(k.isNull() | (k == "null"), "null")
    if arrays:
        norm = norm.when((type_ == "array") & (k == "array"), normalize_array(v, leaf("item_type"), leaf("item_types")))
    norm = (norm.when(numeric & (format_ != "date") & num.isNotNull(), T.decimal_text(num))
            .when((format_ == "date") | numeric | (type_ == "string"), quote(w)).otherwise(cv))
    if checks:
        listed = leaf("enum").isNotNull()
        plain = listed & format_.isin("date", "currency")
        return [
            {p + "_k": apart(kind(v), F.col("field_path")), p + "_t": text(v)},
            {p + "_cv": apart(F.when(listed, canonical(v)), k), p + "_n": F.when(plain & ~k.isin("array", "object"), T.normal_text(t)),
             p + "_num": F.when(plain & numeric & k.isin("string", "number"), T.normal_number(t)),
             p + "_d": F.when(format_ == "date", T.parse_date(t)), p + "_c": F.when(format_ == "currency", T.normal_currency(t))},
            {p + "_w": apart(F.when(plain, words), k)}, {p + "_norm": apart(F.when(plain, norm), k)}]
    return [
        {p + "_k": apart(kind(v), F.col("field_path")), p + "_t": text(v)},
        {p + "_cv": apart(canonical(v), k), p + "_n": F.when(~k.isin("array", "object"), T.normal_text(t)),
         p + "_num": F.when((F.lit(True) if numbers else numeric) & k.isin("string", "number"), T.normal_number(t)),
         p + "_d": F.when(format_ == "date", T.parse_date(t)), p + "_c": F.when(currency, T.normal_currency(t))},
        {p + "_w": apart(words, k)}, {p + "_norm": apart(norm, k)}]


def stage(df: DataFrame, values: dict[str, Column], numbers: bool = False, arrays: bool = True, checks: bool = False) -> DataFrame:
    """Add the parsed forms of values (with their ``_leaf``) as columns ``{p}_...`` for each prefix p; ``_norm`` is the comparison form.

    Each form is computed once per row and reused: as separate projections they are not inlined again. The values go through them together.
    With ``checks``, only the forms that ``validate.staged_errors`` reads under the row's rules are made; the others are null.
    """
    df = df.withColumns({p + "_v": v for p, v in values.items()})
    for columns in zip(*[_stages(p, numbers, arrays, checks) for p in values]):
        df = df.withColumns({n: c for group in columns for n, c in group.items()})
    return df


def normalize_by_schema(df: DataFrame, value: str, out: str, arrays: bool = True) -> DataFrame:
    """Add ``out``: the comparison form of ``value`` under its joined field definition."""
    return sealed(stage(df, {"_z": F.col(value)}, arrays=arrays), df.columns, [F.col("_z_norm").alias(out)])


def extraction_normalize(df: DataFrame, value: str, type_: Column, out: str = "normalized_json") -> DataFrame:
    """Add the value stored beside a raw extraction: stripped strings, numeric strings as numbers."""
    keep = df.columns
    df = df.withColumns({"_x_k": kind(F.col(value)), "_x_t": text(F.col(value))})
    k, t = F.col("_x_k"), F.col("_x_t")
    df = df.withColumn("_x_num", apart(F.when(type_.isin("number", "integer") & (k == "string"), T.normal_number(t)), k))
    n = F.col("_x_num")
    as_number = F.when(type_ == "integer", T.decimal_text(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("decimal(38,0)"))).otherwise(T.decimal_text(n))
    result = (F.when(k.isNull() | (k == "null"), F.lit(None).cast("string"))
              .when(n.isNotNull(), as_number)
              .when((type_ == "string") & k.isin("string", "number", "boolean"), quote(F.trim(t)))
              .otherwise(canonical(F.col(value))))
    return sealed(df.withColumn("_x_out", apart(result, k)), keep, [F.col("_x_out").alias(out)])


def vote_normalize(v: Column, case_insensitive: Column, numeric_strings: Column) -> Column:
    """Comparison form of a candidate: whitespace collapsed, optional case folding and numeric strings."""
    t = T.collapse(text(v))
    return vote_form(v, F.when(case_insensitive, T.casefold(t)).otherwise(t), numeric_strings)


def vote_form(v: Column, folded: Column, numeric_strings: Column) -> Column:
    """The comparison form of a candidate from its collapsed (and folded) text."""
    as_number = F.when(numeric_strings, T.decimal_text(F.regexp_replace(folded, ",", "").try_cast("decimal(38,10)")))
    return (F.when(kind(v) == "string", F.coalesce(as_number, quote(folded))).otherwise(canonical(v)))


def typed_equal(a: Column, b: Column, tolerance: Column) -> Column:
    """Equal normalized candidates: numbers within tolerance, otherwise same type and value."""
    both = (kind(a) == "number") & (kind(b) == "number")
    return F.when(both, F.abs(number(a) - number(b)) <= tolerance).otherwise(
        F.when(kind(a) == "array", False).otherwise(a == b))


def table_signature(v: Column, row_key: Column) -> Column:
    """Order-free form of a table: rows sorted by key; null when a key is absent or repeated. The table is parsed once."""
    def row(r):
        cell = r.try_cast("map<string,variant>")[row_key]
        return F.struct(text(F.coalesce(F.to_json(cell), F.lit("null"))).alias("key"), F.coalesce(F.to_json(r), F.lit("null")).alias("row"))

    def sorted_rows(keyed):
        keys = keyed["key"]
        usable = ~F.array_contains(F.transform(keys, lambda k: k.isNull()), F.lit(True)) & (F.size(F.array_distinct(keys)) == F.size(keys))
        return F.when(usable, F.concat(F.lit("["), F.array_join(F.sort_array(keyed)["row"], ","), F.lit("]")))
    rows = F.try_parse_json(F.when(kind(v) == "array", v)).cast("array<variant>")
    return F.when(row_key.isNotNull(), let(F.transform(rows, row), sorted_rows))


def try_member_text(v: Column, key: Column) -> Column:
    """Text of one member of an object; null when absent or null."""
    return F.get(F.transform(F.filter(members(v), lambda m: m["key"] == key), lambda m: text(m["value"])), F.lit(0))


_TOKENS = r'"(?:[^"\\]++|\\.)*+"\s*:?|-?[0-9][0-9.eE+-]*|true|false'


def value_needle(v: Column) -> Column:
    """First non-empty scalar inside a value, as search text, at any depth and in the order of the text."""
    scalars = F.filter(F.regexp_extract_all(v, F.lit(_TOKENS), F.lit(0)), lambda t: ~F.endswith(t, F.lit(":")))
    found = F.filter(F.transform(scalars, text), lambda s: s.isNotNull() & (F.trim(s) != ""))
    return F.when(kind(v).isin("object", "array"), F.get(found, F.lit(0))).when(~is_empty(v), text(v))
