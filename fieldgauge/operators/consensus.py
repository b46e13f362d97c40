"""Resolving many candidate outputs: votes, merges, cascades, gates.

Candidates are rows (document_id, branch, field_path, value_json, confidence, ...), at most one per document,
branch and field. Branches and tiers are configuration, so per-field arrays of them are small by construction.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..schema import leaf_grid
from .validate import assess_acceptance, validate_required, with_errors, with_leaf

DF = ["document_id", "field_path"]


def confidence_provenance(confidence: Column, source: Column) -> Column:
    """struct(confidence, low, label): a score counts only with a trusted source; low means known and below 0.9."""
    c = F.when(source.isin("model_reported", "heuristic"), T.valid_confidence(confidence))
    name = F.when(source == "model_reported", "Model").otherwise("Rule-based")
    label = F.when(c.isNull(), "Not provided").otherwise(F.concat(name, F.lit(" "), F.floor(c * 100 + 0.5).cast("string"), F.lit("%")))
    return F.struct(c.alias("confidence"), (c < 0.9).alias("low"), label.alias("label"))


def _expected(df: DataFrame, branches: int) -> DataFrame:
    """``df``; a row of a branch or tier that is not configured fails the job, as its vote would otherwise be lost."""
    wrong = F.raise_error(F.concat(F.lit(f"expected branches 0 to {branches - 1}, found "), F.coalesce(F.col("branch").cast("string"), F.lit("null")))).cast("boolean")
    return df.where(F.when(F.col("branch").between(0, branches - 1), F.lit(True)).otherwise(wrong))


def _by_branch(df: DataFrame, branches: int, item: Column, keys: list[str]) -> DataFrame:
    """One array of items per key in branch order. One slot per branch keeps the state bounded."""
    slots = [F.max(F.when(F.col("branch") == b, item)).alias(f"_s{b}") for b in range(branches)]
    return df.groupBy(*keys).agg(*slots).select(*keys, F.filter(F.array(*[F.col(f"_s{b}") for b in range(branches)]), lambda s: s.isNotNull()).alias("_items"))


def vote_policies(leaves: DataFrame, defaults: dict, policies: dict[str, dict] | None = None) -> DataFrame:
    """``leaves`` with the vote settings of each field: its own where it has some, else the ``defaults``.

    Settings are tolerance, case_insensitive, numeric_strings and row_key. Formats do not count in a vote.
    """
    for path, policy in (policies or {}).items():
        if unknown := set(policy) - {"tolerance", "case_insensitive", "numeric_strings", "row_key"}:
            raise ValueError(f"unknown settings of {path}: {sorted(unknown)}")
    kinds = {"tolerance": "decimal(38,10)", "case_insensitive": "boolean", "numeric_strings": "boolean", "row_key": "string"}

    def setting(name):
        value = F.lit(defaults.get(name)).cast(kinds[name])
        for path, policy in (policies or {}).items():
            if policy.get(name) is not None:
                value = F.when(F.col("field_path") == path, F.lit(policy[name]).cast(kinds[name])).otherwise(value)
        return value
    return leaves.withColumns({"format": F.lit(None).cast("string"), **{name: setting(name) for name in kinds}})


def majority_vote(candidates: DataFrame, leaves: DataFrame, documents: DataFrame, branches: int, quorum: int | None = None,
                  tolerance: str = "0", row_keys: dict[str, str] | None = None, case_insensitive: bool = False,
                  numeric_strings: bool = False, policies: dict[str, dict] | None = None) -> DataFrame:
    """Per document and leaf: the unique group of agreeing schema-valid values with at least ``quorum`` members.

    A value joins the first group all of whose members it equals (numbers within the field's tolerance), so no chains form.
    Tables are equal when they hold the same rows by their row key; without a key they never agree.
    ``policies`` gives fields settings of their own, {path: {tolerance, case_insensitive, numeric_strings, row_key}}; the other
    arguments hold for the rest. A field without a tolerance is counted map-side; only fields with one gather a cell's candidates.
    """
    quorum = quorum or branches // 2 + 1
    policies = {path: dict(p) for path, p in (policies or {}).items()}
    for path, name in (row_keys or {}).items():
        policies.setdefault(path, {}).setdefault("row_key", name)
    settled = vote_policies(leaves, {"tolerance": str(tolerance), "case_insensitive": case_insensitive, "numeric_strings": numeric_strings}, policies)
    v = F.col("value_json")
    named = with_leaf(_expected(candidates, branches).where(~J.is_null(v)), settled, "inner")
    checked = with_errors(named, v, "_errors").where(F.size("_errors") == 0)
    ruled = F.struct(*[J.leaf(n).alias(n) for n in ("row_key", "case_insensitive", "numeric_strings", "tolerance")])
    checked = checked.select(*DF, "branch", "value_json", "confidence", ruled.alias("_leaf"))
    checked = checked.withColumn("_t", J.apart(T.collapse(J.text(v)), F.col("field_path")))
    checked = checked.withColumn("_f", J.apart(F.when(J.leaf("case_insensitive"), T.casefold(F.col("_t"))).otherwise(F.col("_t")), F.col("field_path")))
    signature = F.when(J.kind(v) == "array", J.table_signature(v, J.leaf("row_key"))).otherwise(J.vote_form(v, F.col("_f"), J.leaf("numeric_strings")))
    staged = J.settled(checked, [*DF, "branch", "value_json", "confidence", J.leaf("tolerance").alias("tolerance")], [signature.alias("sig")], F.col("field_path"))
    limits = {str(tolerance), *(str(p["tolerance"]) for p in policies.values() if p.get("tolerance") is not None)}
    near = {x for x in limits if float(x) != 0}
    parts = []
    if quorum > 1 and len(near) < len(limits):
        parts.append(_counted(staged.where("tolerance = 0") if near else staged, branches, quorum))
    if quorum <= 1 or near:
        parts.append(_folded(staged.where("tolerance <> 0") if parts else staged, branches, quorum))
    voted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    grid = leaf_grid(documents, ["document_id"], leaves, "field_path", "type")
    message = F.when(F.col("type") == "array", "No majority consensus; array fields require a row key").otherwise("No majority consensus")
    votes = F.coalesce("votes", F.lit(0))
    return grid.join(voted, DF, "left").select(
        *DF, "value_json", "confidence", votes.cast("int").alias("votes"),
        F.when(votes > 0, votes / F.lit(float(branches))).alias("agreement"), F.when(votes == 0, message).alias("error"),
        F.coalesce("voters", F.array().cast("array<int>")).alias("voters"))


def vote_decisions(votes: DataFrame, branches: int, quorum: int | None = None) -> DataFrame:
    """(document_id, field, votes, voters, quorum, selected): what a vote decided, a row for each document and field."""
    needed = quorum or branches // 2 + 1
    return votes.select("document_id", F.col("field_path").alias("field"), "votes", F.lit(branches).alias("voters"), F.lit(needed).alias("quorum"), (F.col("votes") > 0).alias("selected"))


def _counted(staged: DataFrame, branches: int, quorum: int) -> DataFrame:
    """Exact votes: equal values are counted map-side; the first branch of the one group that reaches the quorum speaks for it."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("branch").cast("int")))
    groups = (staged.where(F.col("sig").isNotNull()).groupBy(*DF, "sig")
              .agg(F.count(F.lit(1)).alias("votes"), bits.alias("_bits"), F.min_by(F.struct("value_json", "confidence"), "branch").alias("_x")).where(F.col("votes") >= quorum))
    if 2 * quorum <= branches:  # more than one group may reach it
        groups = groups.groupBy(*DF).agg(F.count(F.lit(1)).alias("_n"), F.first("votes").alias("votes"), F.first("_bits").alias("_bits"), F.first("_x").alias("_x")).where("_n = 1")
    said = F.filter(F.sequence(F.lit(0), F.lit(branches - 1)), lambda b: F.call_function("getbit", F.col("_bits"), b) == 1)
    return groups.select(*DF, "votes", "_x.value_json", "_x.confidence", said.alias("voters"))


def _folded(staged: DataFrame, branches: int, quorum: int) -> DataFrame:
    """Votes with a tolerance: a cell's candidates, one for each branch, are folded into groups in branch order."""
    item = F.struct(F.col("branch").cast("int").alias("branch"), F.col("sig"), J.number(F.col("sig")).alias("num"), F.col("value_json"), F.col("confidence"), F.col("tolerance"))
    grouped = _by_branch(staged, branches, item, DF)

    def same(a, b):
        return F.coalesce(F.when(a["num"].isNotNull() & b["num"].isNotNull(), F.abs(a["num"] - b["num"]) <= b["tolerance"])
                          .otherwise(a["sig"] == b["sig"]), F.lit(False))

    def add(groups, x):
        fits = F.transform(groups, lambda g: F.forall(g, lambda m: same(m, x)))
        at = F.array_position(fits, F.lit(True))
        return F.when(at == 0, F.concat(groups, F.array(F.array(x)))).otherwise(
            F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(x))).otherwise(g)))
    empty = F.filter(F.array(F.col("_items")), lambda g: F.lit(False))
    won = F.filter(F.aggregate("_items", empty, add), lambda g: F.size(g) >= quorum)
    voted = J.settled(grouped, DF, [F.when(F.size(won) == 1, F.get(won, F.lit(0))).alias("_w")], F.col("field_path")).where("_w IS NOT NULL")
    first = F.get(F.col("_w"), F.lit(0))
    return voted.select(*DF, F.size("_w").cast("long").alias("votes"), first["value_json"].alias("value_json"), first["confidence"].alias("confidence"), F.col("_w.branch").alias("voters"))


def _merges(candidates: DataFrame, branches: int, current: DataFrame | None, conflict: str) -> DataFrame:
    """(document_id, field_path, now, given, changes, value_json, error) for each field: its current value, whether it has one, how many
    branches change it, and the fold of their changes in branch order.

    The current value travels as one more row of its field, so that one exchange and one grouping meet all. Forms are worked out after the
    grouping, in compiled code, and only where texts differ: equal texts have equal forms.
    """
    rows = _expected(candidates, branches).where(F.col("value_json").isNotNull()).select(*DF, F.col("branch").cast("int").alias("branch"), "value_json")
    if current is not None:
        rows = rows.unionByName(current.select(*DF, F.lit(-1).alias("branch"), "value_json"))
    said = lambda b: F.max(F.when(F.col("branch") == b, F.col("value_json")))
    wide = rows.repartition(*DF).groupBy(*DF).agg(*[said(b).alias(f"_s{b}") for b in range(branches)], said(-1).alias("now"), F.max(F.col("branch") == -1).alias("given"))
    by, now = F.col("field_path"), F.col("now")
    slots = [F.col(f"_s{b}") for b in range(branches)]
    if current is not None:
        differs = F.exists(F.array(*slots), lambda x: x != now)
        wide = wide.withColumn("_c", J.apart(F.when(differs, J.canonical(now)), by))
        wide = wide.withColumns({f"_s{b}": J.apart(F.when(s.isNull() | s.eqNullSafe(now), None).when(~J.canonical(s).eqNullSafe(F.col("_c")), s), by) for b, s in enumerate(slots)})
    wide = wide.withColumn("_items", F.array_compact(F.array(*slots)))
    last = F.coalesce(*reversed(slots), F.lit(None))
    # a text that is no array, object or escaped string has a form, so equal ones agree; the others are folded by their forms
    plain = ~F.substring(F.ltrim(last), 1, 1).isin("[", "{") & ~F.contains(last, F.lit("\\"))
    agreed = (F.size("_items") < 2) | (plain & (F.size(F.array_distinct("_items")) == 1))
    wide = wide.select(*DF, "now", "given", F.size("_items").alias("changes"), last.alias("_last"), agreed.alias("_agreed"), *slots)
    form = lambda s: F.when(~F.col("_agreed") & s.isNotNull() & (J.kind(s) != "array"), T.collapse(J.text(s)))
    wide = wide.withColumns({f"_t{b}": J.apart(form(s), by) for b, s in enumerate(slots)})
    wide = wide.withColumns({f"_g{b}": J.apart(F.when(~F.col("_agreed") & s.isNotNull() & (J.kind(s) != "array"), J.vote_form(s, F.col(f"_t{b}"), F.lit(False))), by) for b, s in enumerate(slots)})
    none = F.lit(None).cast("string")
    items = F.filter(F.array(*[F.struct(s.alias("value_json"), F.col(f"_g{b}").alias("sig"), none.alias("error")) for b, s in enumerate(slots)]), lambda x: x["value_json"].isNotNull())
    wide = wide.withColumn("_folds", F.when(~F.col("_agreed"), items))
    clash = F.struct(F.lit("null").alias("value_json"), F.lit("null").alias("sig"), F.lit(conflict).alias("error"))
    folded = F.aggregate(F.slice("_folds", F.lit(2), F.greatest(F.size("_folds") - 1, F.lit(0))), F.get("_folds", F.lit(0)),
                         lambda a, x: F.when(F.coalesce(a["sig"] == x["sig"], F.lit(False)), x).otherwise(clash))
    wide = wide.withColumn("_r", F.when(~F.col("_agreed"), folded))
    return wide.select(*DF, "now", "given", "changes", F.when(F.col("_agreed"), F.col("_last")).otherwise(F.col("_r.value_json")).alias("value_json"), F.col("_r.error").alias("error"))


def merge_changes(candidates: DataFrame, branches: int, current: DataFrame | None = None,
                  conflict: str = "Parallel branches conflict; use consensus or disjoint field scopes") -> DataFrame:
    """Fold the branches' changed fields in order: equal values keep the last, differing ones become null plus an error.

    Fields equal to ``current`` (at most one row for each document and field) are not changes. Two tables always conflict, having no row key here.
    """
    return _merges(candidates, branches, current, conflict).where("changes > 0").select(*DF, "value_json", "error")


def parallel_merge(candidates: DataFrame, branches: int, current: DataFrame | None = None) -> DataFrame:
    return merge_changes(candidates, branches, current)


def joined_route_merge(candidates: DataFrame, branches: int, current: DataFrame, leaves: DataFrame) -> DataFrame:
    """Converging connections: merge the changes, then overlay them on the shared input where its fields are the schema's."""
    merged = _merges(candidates, branches, current, "Connected branches conflict; resolve them with a majority-vote block")
    scope = leaves.select("field_path").distinct().withColumn("_scoped", F.lit(True))
    over = F.col("_scoped").isNotNull() & (F.col("changes") > 0)
    met = merged.join(F.broadcast(scope), "field_path", "left").where(F.col("given") | over)
    return met.select(*DF, F.when(over, F.col("value_json")).otherwise(F.col("now")).alias("value_json"))


def page_merge(pages: DataFrame, row_keys: dict[str, str] | None = None) -> DataFrame:
    """Merge per-page outputs (document_id, page, field_path, value_json, confidence).

    Equal values keep the last page's; differing ones are a conflict, or, for tables with a row key, the union of
    rows by key. Rows without a key, or with one key and different content, are reported as violations.
    """
    rows = pages.where(~J.is_null(F.col("value_json"))).withColumn("_c", J.canonical(F.col("value_json")))
    agg = rows.groupBy(*DF).agg(
        F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.max_by(F.struct("value_json", "confidence"), "page").alias("_last"))
    differs = F.col("_lo") != F.col("_hi")
    base = agg.select(*DF, F.when(~differs, F.col("_last.value_json")).alias("value_json"), F.when(~differs, F.col("_last.confidence")).alias("confidence"),
                      F.when(differs, "Conflicting page values; configure a merge policy").alias("error"))
    if not row_keys:
        return base
    key = F.lit(None).cast("string")
    for path, name in row_keys.items():
        key = F.when(F.col("field_path") == path, name).otherwise(key)
    tables = (rows.where(F.col("field_path").isin(list(row_keys)) & (J.kind(F.col("value_json")) == "array"))
              .select(*DF, "page", F.posexplode(J.elements(F.col("value_json"))).alias("pos", "row")))
    cell = F.get(F.transform(F.filter(J.members(F.col("row")), lambda m: m["key"] == key), lambda m: J.text(m["value"])), F.lit(0))
    per_key = tables.withColumn("_k", cell).groupBy(*DF, "_k").agg(
        F.min("row").alias("_a"), F.max("row").alias("_b"), F.min(F.struct("page", "pos")).alias("_at"))
    bad = F.col("_k").isNull() | (F.col("_a") != F.col("_b"))
    union = per_key.groupBy(*DF).agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("_b").alias("r")))), lambda e: e["r"]), ","), F.lit("]")).alias("_u"),
        F.bool_or(bad).alias("_bad"))
    merged = F.col("error").isNotNull() & F.col("_u").isNotNull()
    return base.join(union, DF, "left").select(
        *DF, F.when(merged & ~F.col("_bad"), F.col("_u")).otherwise(F.col("value_json")).alias("value_json"), "confidence",
        F.when(merged & F.col("_bad"), "Page table rows have missing or conflicting keys").when(merged, None).otherwise(F.col("error")).alias("error"))


def confidence_merge(pages: DataFrame) -> DataFrame:
    """Legacy page merge: a strictly more confident non-empty value replaces the current one, ties keep the earlier.

    ``pages``: (document_id, page, field_path, value_json, confidence, evidence, errors); arrays are unioned.
    """
    c = F.coalesce(T.valid_confidence(F.col("confidence")), F.lit(0.0))
    ranked = pages.withColumn("_c", c)
    first = ranked.groupBy(*DF).agg(
        F.min_by(F.struct("page", "value_json", "confidence", "_c"), "page").alias("_f"),
        F.max_by(F.struct("page", "value_json", "confidence", "_c"),
                 F.when(~J.is_empty(F.col("value_json")) & (F.col("_c") > 0), F.struct("_c", (-F.col("page")).alias("p")))).alias("_b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors"))
    better = F.coalesce(F.col("_b._c") > F.col("_f._c"), F.lit(False))
    pick = F.when(better, F.col("_b")).otherwise(F.col("_f"))
    return first.select(*DF, pick["value_json"].alias("value_json"), T.valid_confidence(pick["confidence"]).alias("confidence"), "evidence", "errors")


def concatenate_pages(pages: DataFrame) -> DataFrame:
    """Bare (unwrapped) list values of successive pages joined in page order."""
    rows = pages.where(J.kind(F.col("value_json")) == "array")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "value_json"))), lambda p: J.elements(p["value_json"])))
    return rows.groupBy(*DF).agg(F.concat(F.lit("["), F.array_join(joined, ","), F.lit("]")).alias("value_json"))


def cascade_select(candidates: DataFrame, tiers: int, leaves: DataFrame, documents: DataFrame, policy: dict) -> DataFrame:
    """Overlay tiers in order until the accumulated output is accepted; otherwise all tiers.

    One aggregation lays the tiers of a leaf side by side; accumulation is a coalesce, with no window.
    """
    item = F.struct("value_json", "confidence", "errors")
    slots = [F.max(F.when(F.col("branch") == t, item)).alias(f"_t{t}") for t in range(tiers)]
    wide = _expected(candidates, tiers).groupBy(*DF).agg(*slots)
    upto = [F.struct(F.lit(t).alias("tier"), F.coalesce(*[F.col(f"_t{i}") for i in range(t, -1, -1)]).alias("x")) for t in range(tiers)]
    acc = (wide.select(*DF, F.explode(F.array(*upto)).alias("e")).where(F.col("e.x").isNotNull())
           .select(*DF, F.col("e.tier").alias("tier"), "e.x.value_json", "e.x.confidence", "e.x.errors"))
    steps = documents.select("document_id", F.explode(F.array(*[F.lit(t) for t in range(tiers)])).alias("tier"))
    verdict = assess_acceptance(acc, leaves, steps, policy, ["document_id", "tier"])
    chosen = verdict.groupBy("document_id").agg(F.coalesce(F.min(F.when(F.col("accepted"), F.col("tier"))), F.lit(tiers - 1)).alias("tier"),
                                                F.bool_or("accepted").alias("accepted"))
    return acc.join(chosen, ["document_id", "tier"]).select(*DF, "tier", "accepted", "value_json", "confidence")


def cascade_unresolved_fill(candidates: DataFrame, tiers: int, leaves: DataFrame, documents: DataFrame, policy: dict) -> DataFrame:
    """Field scope: each later tier overwrites only the fields still unresolved (tiers are few)."""
    cols = ["value_json", "confidence", "errors"]
    candidates = _expected(candidates, tiers)
    current = candidates.where("branch = 0").select(*DF, *cols)
    for t in range(1, tiers):
        open_ = assess_acceptance(current, leaves, documents, policy).select("document_id", F.explode("unresolved").alias("field_path"))
        fill = candidates.where(F.col("branch") == t).select(*DF, F.struct(*cols).alias("_new")).join(open_, DF, "left_semi")
        merged = current.select(*DF, F.struct(*cols).alias("_old")).join(fill, DF, "full")
        x = F.coalesce("_new", "_old")
        current = merged.select(*DF, *[x[c].alias(c) for c in cols])
    return current


def mean_output_confidence(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """Mean of the valid leaf confidences per document, 0 when there is none."""
    agg = fields.groupBy("document_id").agg(F.avg(T.valid_confidence(F.col("confidence"))).alias("c"))
    return documents.select("document_id").join(agg, "document_id", "left").select("document_id", F.coalesce("c", F.lit(0.0)).alias("mean_confidence"))


def threshold_cascade(primary: DataFrame, fallback: DataFrame, documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Primary output where its mean confidence reaches the threshold, else the fallback's."""
    choice = mean_output_confidence(primary, documents).select("document_id", (F.col("mean_confidence") >= threshold).alias("_p"))
    both = primary.withColumn("source", F.lit("primary")).unionByName(fallback.withColumn("source", F.lit("fallback")))
    return both.join(choice, "document_id").where(F.col("_p") == (F.col("source") == "primary")).drop("_p")


def verify_select(primary: DataFrame, verified: DataFrame, leaves: DataFrame, documents: DataFrame) -> DataFrame:
    """Verified output unless it fails the type or required checks; then the primary one."""
    types_only = leaves.select("field_path", "pos", "type", *[F.lit(None).cast(t).alias(n) for n, t in dict(leaves.dtypes).items()
                                                           if n not in ("field_path", "pos", "type", "item_type", "item_types")], "item_type", "item_types")
    wrong = with_errors(with_leaf(verified, types_only, "inner"), F.col("value_json"), "_e").where(F.size("_e") > 0).select("document_id")
    absent = validate_required(verified, leaves, documents).select("document_id")
    bad = wrong.unionByName(absent).distinct().withColumn("_bad", F.lit(True))
    both = primary.withColumn("source", F.lit("primary")).unionByName(verified.withColumn("source", F.lit("verified")))
    return both.join(bad, "document_id", "left").where(F.coalesce("_bad", F.lit(False)) == (F.col("source") == "primary")).drop("_bad")


def gate_split(assessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, unresolved) documents of an assessment."""
    return assessed.where("accepted"), assessed.where(~F.col("accepted"))
