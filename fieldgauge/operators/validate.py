"""Field, object, arithmetic and acceptance checks. Violations are rows or arrays, never exceptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..schema import leaf_grid


def _typed(v: Column, type_: Column) -> Column:
    k = J.kind(v)
    return (F.when(type_.isin("string", "number", "boolean", "array", "object"), k == type_)
            .when(type_ == "integer", (k == "number") & v.rlike(r"^\s*-?\d+\s*$"))
            .otherwise(True))


def _when(condition: Column, message) -> Column:
    return F.when(condition, F.lit(message) if isinstance(message, str) else message)


def item_errors(v: Column, path: Column, item_type: Column, item_types: Column) -> Column:
    """Type errors of array items, with the item index in the path."""
    def of_item(e, i):
        at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        own = F.when((e != "null") & ~_typed(e, item_type), F.array(F.concat(at, F.lit(" must be "), item_type)))
        parts = F.transform(F.filter(J.members(e), lambda m: (m["value"] != "null") & ~_typed(
            m["value"], F.coalesce(item_types[m["key"]], F.lit("")))),
            lambda m: F.concat(at, F.lit("."), m["key"], F.lit(" must be "), item_types[m["key"]]))
        return F.coalesce(own, F.when(item_types.isNotNull(), parts), F.array().cast("array<string>"))
    ruled = item_type.isNotNull() | item_types.isNotNull()
    return F.coalesce(F.flatten(F.transform(J.elements(F.when(ruled, v)), of_item)), F.array().cast("array<string>"))


SEPARATOR = "\u001f"


@J.per_context
def staged_errors(p: str, today: str | None = None, arrays: bool = False) -> Column:
    """Messages for one staged leaf value (see ``jsonvals.stage``). ``today``: ISO date, default the current one."""
    v, k, t, cv, d, c, norm = (F.col(f"{p}_{s}") for s in ("v", "k", "t", "cv", "d", "c", "norm"))
    path, leaf = F.col("field_path"), J.leaf
    type_, format_ = leaf("type"), F.coalesce(leaf("format"), F.lit(""))
    is_text = k == "string"
    literal = F.when(format_.isin("date", "currency"), norm).otherwise(cv)
    number = F.when(k == "number", v.try_cast("double"))
    now = F.current_date().cast("string") if today is None else F.lit(today)
    rules = F.concat_ws(
        SEPARATOR,
        _when(leaf("enum").isNotNull() & ~F.array_contains(leaf("enum"), literal)
              & ~F.array_contains(leaf("enum"), cv), "value is not in enum"),
        _when(is_text & leaf("not_blank") & (F.trim(t) == ""), "value must not be blank"),
        _when(is_text & (format_ == "date") & d.isNull(), "value is not a valid date"),
        _when(is_text & (format_ == "currency") & ~c.rlike("^[A-Z]{3}$"), "value is not a supported ISO currency"),
        _when(is_text & (F.length(t) < leaf("min_length")), "value is shorter than minLength"),
        _when(is_text & (F.length(t) > leaf("max_length")), "value is longer than maxLength"),
        _when(is_text & ~F.rlike(t, leaf("pattern")), "value does not match pattern"),
        _when(is_text & ~leaf("pattern_valid"), "schema pattern is invalid"),
        _when(number < leaf("minimum"), "value is below minimum"),
        _when(number > leaf("maximum"), "value is above maximum"),
        _when(leaf("date_lte_today") & (d > now), "date is in the future"))
    text = (F.when(k.isNull() | (k == "null") | type_.isNull(), "")
            .when(~_typed(v, type_), F.concat(path, F.lit(" must be "), type_)).otherwise(rules))
    out = F.array_remove(F.split(text, SEPARATOR), "")  # the arguments of a lambda function would be interpreted
    return F.when((type_ == "array") & (k == "array"), item_errors(v, path, leaf("item_type"), leaf("item_types"))).otherwise(out) if arrays else out


def with_errors(df: DataFrame, value: Column, out: str = "errors", today: str | None = None, arrays: bool = True) -> DataFrame:
    """Add the message array of ``value`` under the joined leaf definition."""
    return J.settled(J.stage(df, {"_y": value}, arrays=False, checks=True), [c for c in df.columns if c != out], [staged_errors("_y", today, arrays).alias(out)], F.col("_y_k"))


def with_leaf(df: DataFrame, leaves: DataFrame, how: str = "left") -> DataFrame:
    """Attach each field's definition as a struct. The leaf dimension is schema-sized."""
    return df.join(leaves.select("field_path", F.struct(*[c for c in leaves.columns if c != "field_path"]).alias("_leaf")), "field_path", how)


def validate_fields(predictions: DataFrame, leaves: DataFrame, value: str = "value_json", today=None) -> DataFrame:
    """Predictions with an ``errors`` array; fields outside the schema have none."""
    return with_errors(with_leaf(predictions, leaves), F.col(value), today=today).drop("_leaf")


def validate_required(predictions: DataFrame, leaves: DataFrame, documents: DataFrame, keys=("document_id",)) -> DataFrame:
    """(keys, field_path, message) for required leaves that are absent, null or empty."""
    filled = predictions.where(~J.is_empty(F.col("value_json"))).select(*keys, "field_path")
    wanted = leaf_grid(documents, list(keys), leaves.where("required"), "field_path")
    return (wanted.join(filled, [*keys, "field_path"], "left_anti")
            .withColumn("message", F.concat(F.col("field_path"), F.lit(" is required"))))


def arithmetic_rules(predictions: DataFrame, rules: list[dict], documents: DataFrame, keys=("document_id",)) -> DataFrame:
    """(keys, rule, equals_path, expected, actual, passed): do the summed fields equal another field?

    ``rules``: ``{"sum": [paths], "equals": path, "tolerance": 0.01}``. Missing or non-numeric parts fail.
    One aggregation over the predictions evaluates every rule.
    """
    as_number = F.coalesce(J.number(F.col("value_json")).cast("double"),
                           F.when(J.kind(F.col("value_json")) == "string", J.text(F.col("value_json")).try_cast("double")))
    finite = F.when(~F.isnan(as_number) & (F.abs(as_number) != float("inf")), as_number)
    paths = sorted({p for r in rules for p in [*r["sum"], r["equals"]]})
    aggs = [F.max(F.when(F.col("field_path") == p, finite)).alias(f"_v{i}") for i, p in enumerate(paths)]
    wide = documents.select(*keys).join(
        predictions.where(F.col("field_path").isin(paths)).groupBy(*keys).agg(*aggs), list(keys), "left")
    at = {p: F.col(f"_v{i}") for i, p in enumerate(paths)}
    checks = []
    for i, r in enumerate(rules):
        expected = sum((at[p] for p in r["sum"]), F.lit(0.0))
        ok = F.abs(expected - at[r["equals"]]) <= F.lit(float(r.get("tolerance", 0.01)))
        checks.append(F.struct(F.lit(i).alias("rule"), F.lit(r["equals"]).alias("equals_path"), expected.alias("expected"),
                               at[r["equals"]].alias("actual"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return wide.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


def confidence_gate(fields: DataFrame, threshold: float, missing: str = "escalate") -> DataFrame:
    """Adds ``escalated``: confidence known and below the threshold, or unknown under ``escalate``."""
    c = T.valid_confidence(F.col("confidence"))
    unknown = c.isNull() if missing == "escalate" else F.lit(False)
    return fields.withColumn("escalated", F.when(c.isNull(), unknown).otherwise(c < threshold))


def assess_acceptance(fields: DataFrame, leaves: DataFrame, documents: DataFrame, policy: dict | None = None,
                      keys=("document_id",)) -> DataFrame:
    """(keys, accepted, n_errors, unresolved): acceptance of each document's output.

    ``fields`` carries value_json, confidence and field errors. Schema errors, field errors, empty critical
    fields, low or unknown confidence and failed arithmetic rules are unioned and aggregated once per document.
    """
    policy = policy or {}
    keys = list(keys)
    critical = policy.get("critical_fields")
    is_critical = F.col("field_path").isin(critical) if critical else F.lit(True)
    joined = with_errors(with_leaf(fields, leaves, "inner"), F.col("value_json"), "_errors")
    schema_errors = F.col("_errors")
    own_errors = F.coalesce(F.col("errors"), F.array().cast("array<string>"))
    unresolved = (F.size(schema_errors) > 0) | (F.size(own_errors) > 0) | (is_critical & J.is_empty(F.col("value_json")))
    if policy.get("threshold") is not None:
        c = T.valid_confidence(F.col("confidence"))
        unknown = policy.get("missing_confidence", "escalate") == "escalate"
        low = F.when(c.isNull(), F.lit(unknown)).otherwise(c < float(policy["threshold"]))
        unresolved = unresolved | (is_critical & ~J.is_empty(F.col("value_json")) & low)
    found = joined.select(*keys, "field_path", (F.size(schema_errors) + F.size(own_errors)).alias("n"),
                          unresolved.alias("u"))
    wanted = leaves.agg(F.collect_list(F.when(F.col("required"), F.col("field_path"))).alias("required"),
                        F.collect_list(F.when(is_critical, F.col("field_path"))).alias("critical"))
    per_doc = found.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("u"), F.col("field_path"))).alias("bad"),
        F.collect_set("field_path").alias("seen"), F.sum("n").alias("n"))
    base = documents.select(*keys).join(per_doc, keys, "left").crossJoin(F.broadcast(wanted))
    none = F.array().cast("array<string>")
    seen = F.coalesce(F.col("seen"), none)
    absent = F.array_except(F.col("critical"), seen)
    missing_required = F.array_except(F.col("required"), seen)
    out = base.select(*keys, F.array_union(F.coalesce(F.col("bad"), none), F.array_union(absent, missing_required)).alias("bad"),
                      (F.coalesce(F.col("n"), F.lit(0)) + F.size(missing_required)).alias("n"))
    if policy.get("rules"):
        failed = (arithmetic_rules(fields, policy["rules"], documents, keys).where(~F.col("passed"))
                  .groupBy(*keys).agg(F.collect_set("equals_path").alias("rule_paths"), F.count(F.lit(1)).alias("rule_n")))
        out = (out.join(failed, keys, "left").select(
            *keys, F.array_union("bad", F.coalesce(F.col("rule_paths"), none)).alias("bad"),
            (F.col("n") + F.coalesce(F.col("rule_n"), F.lit(0))).alias("n")))
    return out.select(*keys, ((F.col("n") == 0) & (F.size("bad") == 0)).alias("accepted"),
                      F.col("n").cast("long").alias("n_errors"), F.array_sort("bad").alias("unresolved"))


def spread_errors(errors: DataFrame, leaves: DataFrame, keys=("document_id",)) -> DataFrame:
    """(keys, field_path): leaves unresolved by errors at a field or at any object above it ('' = whole output)."""
    # Every leaf lists its own path and all ancestors, so the match is an equi-join.
    steps = F.split("field_path", r"\.")
    above = leaves.select("field_path", F.explode(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ".")))).alias("error_path"))
    return errors.select(*keys, "error_path").distinct().join(above, "error_path").select(*keys, "field_path").distinct()


def span_offset_check(qas: DataFrame) -> DataFrame:
    """Answer spans (context, answer_start, text, is_impossible, n_answers) with their two consistency flags."""
    s = F.substring("context", F.col("answer_start") + 1, F.length("text"))
    return (qas.withColumn("span_ok", (F.col("answer_start") >= 0) & (s == F.col("text")))
            .withColumn("label_ok", F.col("is_impossible") == (F.col("n_answers") == 0)))


def frozen_document_check(frozen: DataFrame, documents: DataFrame) -> DataFrame:
    """Frozen benchmark documents that disappeared or whose content hash changed."""
    now = documents.select("document_id", F.col("sha256").alias("current_sha256"))
    return (frozen.select("document_id", F.col("sha256").alias("frozen_sha256")).join(now, "document_id", "left")
            .where(~F.col("frozen_sha256").eqNullSafe(F.col("current_sha256")))
            .withColumn("problem", F.when(F.col("current_sha256").isNull(), "removed").otherwise("changed")))


def comparability_check(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per requested comparison: may its runs be compared? Same group, dataset and fingerprint, all completed."""
    return (runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("group_id").alias("groups"), F.count_distinct("dataset_id").alias("datasets"),
        F.count_distinct("fingerprint").alias("fingerprints"),
        F.count_if(F.col("fingerprint").isNull()).alias("without_fingerprint"),
        F.count_if(F.col("status") != "completed").alias("not_completed"))
        .withColumn("comparable", (F.col("runs") >= 2) & (F.col("groups") == 1) & (F.col("datasets") == 1)
                    & (F.col("not_completed") == 0)
                    & ((F.col("fingerprints") == 0) | ((F.col("fingerprints") == 1) & (F.col("without_fingerprint") == 0)))))


def reimport_conflict_check(incoming: DataFrame, latest_truth: DataFrame, earlier_author: str) -> DataFrame:
    """Import action per document: new, same, replace (untouched earlier import) or conflict."""
    old = latest_truth.select("document_id", F.col("value_json").alias("old_json"), "author", "revision")
    same = J.canonical(F.col("old_json")) == J.canonical(F.col("value_json"))
    untouched = (F.col("author") == earlier_author) & (F.col("revision") == 1)
    return incoming.join(old, "document_id", "left").withColumn(
        "action", F.when(F.col("revision").isNull(), "new").when(same, "same").when(untouched, "replace").otherwise("conflict"))


def membership_conflict_check(current: DataFrame, planned: DataFrame) -> DataFrame:
    """Saved memberships that are not planned, or whose split was edited."""
    plan = planned.select("dataset_id", "sha256", F.col("split").alias("planned_split"))
    return (current.join(plan, ["dataset_id", "sha256"], "left")
            .where(~F.col("split").eqNullSafe(F.col("planned_split")))
            .withColumn("problem", F.when(F.col("planned_split").isNull(), "not_planned").otherwise("split_changed")))
