"""Run-to-run comparison: changes, summaries, gates, candidate ledgers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsonvals as J
from .ranking import top_k
from .scoring import FAILURES, ratio

QUALITY = ("field_accuracy", "document_accuracy", "precision", "recall", "f1", "field_completeness")
OPERATING = ("cost_usd", "average_latency_ms", "p95_latency_ms")


def _class(before_ok: Column, after_ok: Column) -> Column:
    return F.when(before_ok & ~after_ok, "regressed").when(~before_ok & after_ok, "improved").otherwise("unchanged")


def compare_fields(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Union of both runs' (document, field) keys with classification and failure transition."""
    side = lambda df, p: df.select("document_id", "field_path", F.col("status").alias(p + "_status"),
                                   F.col("actual_json").alias(p + "_json"))
    j = side(baseline, "baseline").join(side(candidate, "candidate"), ["document_id", "field_path"], "full")
    b, c = F.col("baseline_status"), F.col("candidate_status")
    before, after = F.coalesce(b == "correct", F.lit(False)), F.coalesce(c == "correct", F.lit(False))
    moved = (F.when(b.isNull() & c.isin(*FAILURES), "new_failure").when(b.isin(*FAILURES) & after, "fixed_failure"))
    return j.withColumn("classification", _class(before, after)).withColumn("failure_transition", moved)


def compare_documents(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Document level: a document is good when every scored field is correct. Sides are reduced before the join."""
    def side(df, p):
        return df.groupBy("document_id").agg(F.bool_and(F.col("status") == "correct").alias(p + "_ok"),
                                             F.bool_or(F.col("status").isin(*FAILURES)).alias(p + "_failed"))
    j = side(baseline, "baseline").join(side(candidate, "candidate"), "document_id", "full")
    before, after = F.coalesce("baseline_ok", F.lit(False)), F.coalesce("candidate_ok", F.lit(False))
    moved = (F.when(F.col("baseline_ok").isNull() & F.col("candidate_failed"), "new_failure")
             .when(F.col("baseline_failed") & after, "fixed_failure"))
    return j.select("document_id", _class(before, after).alias("classification"), moved.alias("failure_transition"))


def compare_summary(changes: DataFrame) -> DataFrame:
    c, t = F.col("classification"), F.col("failure_transition")
    return changes.agg(*[F.count_if(c == n).alias(n) for n in ("improved", "regressed", "unchanged")],
                       *[F.count_if(t == n).alias(n) for n in ("new_failure", "fixed_failure")])


def metric_delta_gate(baseline: DataFrame, candidate: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(metric, baseline, candidate, delta, violates): only quality metrics gate. One row of metrics per side."""
    names = [m for m in (*QUALITY, *OPERATING) if m in baseline.columns and m in candidate.columns]
    tall = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in names])).alias("x")).select("x.*")
    j = tall(baseline, "baseline").join(tall(candidate, "candidate"), "metric").where("baseline is not null and candidate is not null")
    delta = F.col("candidate") - F.col("baseline")
    return j.withColumn("delta", F.round(delta, 6)).withColumn(
        "violates", F.col("metric").isin(*QUALITY) & (delta < -abs(float(threshold))))


def scored_cells(scored: DataFrame) -> DataFrame:
    """(document, field) cells with how often each was scored; n > 1 is a violation."""
    return (scored.where(F.col("status").isin(*FAILURES, "correct")).groupBy("run_id", "document_id", "field_path")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("duplicate", F.col("n") > 1))


def paired_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full pairing of two runs' scored cells with violation columns (coverage, expected value, duplicates)."""
    def side(df, p):
        return (df.where(F.col("status").isin(*FAILURES, "correct")).groupBy("document_id", "field_path")
                .agg(F.count(F.lit(1)).alias(p + "_n"), F.max("status").alias(p + "_status"),
                     F.max("expected_json").alias(p + "_expected"), F.max("actual_json").alias(p + "_json")))
    j = side(before, "before").join(side(after, "after"), ["document_id", "field_path"], "full")
    both = F.col("before_n").isNotNull() & F.col("after_n").isNotNull()
    x, y = F.col("before_expected"), F.col("after_expected")
    same = F.when(x.eqNullSafe(y), True).otherwise(J.canonical(x).eqNullSafe(J.canonical(y)))
    problem = (F.when(~both, "coverage_changed").when((F.col("before_n") > 1) | (F.col("after_n") > 1), "duplicate")
               .when(~same, "expected_changed"))
    b, a = F.col("before_status") == "correct", F.col("after_status") == "correct"
    return j.withColumn("violation", J.apart(problem, F.col("before_n"))).withColumn(
        "change", F.when(~b & a, "fixed").when(b & ~a, "regressed").otherwise("same"))


def paired_inner_guarded(before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """Guarded pairing; ``strict`` fails the job on the first violation instead of returning it."""
    cells = paired_cells(before, after)
    if not strict:
        return cells
    guard = F.when(F.col("violation").isNotNull(), F.raise_error(F.concat(F.lit("Runs cannot be paired: "), F.col("violation"))))
    return cells.where(F.coalesce(guard.cast("string"), F.lit("ok")) == "ok")


def paired_compare(cells: DataFrame) -> DataFrame:
    """Per-field fixed/regressed buckets of paired cells."""
    return (cells.groupBy("field_path").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("change") == "fixed").alias("fixed"),
        F.count_if(F.col("change") == "regressed").alias("regressed"))
        .withColumn("net", F.col("fixed") - F.col("regressed")))


def paired_totals(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = cells.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("change") == "fixed").alias("fixed"),
        F.count_if(F.col("change") == "regressed").alias("regressed"))
    return out.withColumn("net", F.col("fixed") - F.col("regressed")).withColumn("gain", ratio(F.col("net"), F.col("scored")))


def paired_examples(cells: DataFrame, k: int = 12) -> DataFrame:
    """First ``k`` fixes and regressions in key order."""
    return top_k(cells.where(F.col("change") != "same"), ["change"], [F.col("document_id"), F.col("field_path")], k)


def acceptance_gate(totals: DataFrame, min_gain: float, max_regressions: int) -> DataFrame:
    required = F.greatest(F.lit(1), F.ceil(F.col("scored") * F.lit(float(min_gain)) - F.lit(1e-9)))
    return totals.withColumn("required_net", required.cast("long")).withColumn(
        "passed", (F.col("net") >= required) & (F.col("regressed") <= max_regressions))


def candidate_ledger(comparisons: DataFrame, runs: DataFrame, min_gain: float, max_regressions: int) -> DataFrame:
    """Accept a candidate iff screening and every confirmation pair pass; keep its weakest verified run.

    ``comparisons``: (candidate_id, phase, run_id, scored, net, regressed), phase in screening/paired/against_saved;
    ``runs``: (run_id, score) of the candidate's own runs.
    """
    gated = acceptance_gate(comparisons, min_gain, max_regressions)
    verdict = gated.groupBy("candidate_id").agg(F.bool_and("passed").alias("accepted"), F.count(F.lit(1)).alias("checks"))
    weakest = (comparisons.select("candidate_id", "run_id").distinct().join(runs, "run_id").groupBy("candidate_id")
               .agg(F.min_by("run_id", F.struct("score", "run_id")).alias("run_id"), F.min("score").alias("score")))
    return (verdict.join(weakest, "candidate_id", "left").select(
        "candidate_id", "checks", "accepted", F.when(F.col("accepted"), F.col("run_id")).alias("accepted_run_id"),
        F.when(F.col("accepted"), F.col("score")).alias("confirmed_score")))


def budget_and_patience(entries: DataFrame, budget: float | None, patience: int) -> DataFrame:
    """Running spend, stalled streak and stop reason per job, in entry order.

    ``entries``: (job_id, pos, cost_usd, accepted). A job holds at most its candidate limit of entries.
    """
    w = Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("cost_usd").isNull() | F.isnan("cost_usd") | (F.col("cost_usd") < 0)
    df = (entries.withColumn("spent_usd", F.sum(F.when(bad, 0.0).otherwise(F.col("cost_usd"))).over(w))
          .withColumn("cost_complete", ~F.bool_or(bad).over(w))
          .withColumn("_island", F.sum(F.when(F.col("accepted"), 1).otherwise(0)).over(w)))
    streak = Window.partitionBy("job_id", "_island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("stalled", F.sum(F.when(F.col("accepted"), 0).otherwise(1)).over(streak))
    limit = F.lit(False) if budget is None else (F.col("spent_usd") >= F.lit(float(budget)))
    unknown = F.lit(False) if budget is None else ~F.col("cost_complete")
    stop = F.when(unknown, "cost_unavailable").when(limit, "budget_reached").when(F.col("stalled") >= patience, "patience_exhausted")
    df = df.withColumn("stop_reason", stop)
    first = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("pos"))).over(Window.partitionBy("job_id"))
    return df.withColumn("stop_pos", first).drop("_island")


def run_cross_baseline(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every candidate run beside its group's baseline (one baseline row per group)."""
    b = baseline.select("group_id", F.col("run_id").alias("baseline_run_id"), F.col("score").alias("baseline_score"))
    return (runs.join(b, "group_id").where(F.col("run_id") != F.col("baseline_run_id"))
            .withColumn("delta_points", F.round((F.col("score") - F.col("baseline_score")) * 100, 4)))


def compare_matrix(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """2-4 runs side by side, baseline (the oldest) first."""
    picked = runs.where(F.col("run_id").isin(run_ids))
    first = picked.agg(F.min_by(F.struct("run_id", "score"), F.struct("created_at", "run_id")).alias("b"))
    return picked.crossJoin(F.broadcast(first)).select(
        "run_id", (F.col("run_id") == F.col("b.run_id")).alias("is_baseline"), "score",
        F.round((F.col("score") - F.col("b.score")) * 100, 4).alias("delta_points"),
        *[c for c in ("model", "parser", "cost_usd", "average_latency_ms", "cache_hits", "documents", "status") if c in runs.columns])


def configuration_changes(before: DataFrame, after: DataFrame, labels: dict[str, str], on: list[str]) -> DataFrame:
    """Labels of the configuration keys whose values differ between two versions."""
    b = before.select(*on, F.struct(*labels).alias("b"))
    a = after.select(*on, F.struct(*labels).alias("a"))
    diffs = F.array(*[F.when(~F.col("b")[k].eqNullSafe(F.col("a")[k]), F.lit(v)) for k, v in labels.items()])
    listed = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("Configuration unavailable"))).otherwise(
        F.filter(diffs, lambda x: x.isNotNull()))
    return b.join(a, on, "full").select(*on, listed.alias("changes"))
