"""Field scoring: pair predictions with truth, classify every pair, aggregate metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..schema import ScoringConfig, has_arrays
from .ranking import nearest_rank
from .validate import staged_errors, with_leaf

FAILURES = ("incorrect", "missing", "hallucinated", "validation_failed")
KEY = ["run_id", "document_id"]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _verified(truth: DataFrame) -> DataFrame:
    return truth.where(F.coalesce(F.col("annotation_status"), F.lit("complete")) != "unverified")


def annotated_paths(truth: DataFrame, leaves: DataFrame, config: ScoringConfig = ScoringConfig(),
                    predictions: DataFrame | None = None) -> DataFrame:
    """(document_id, field_path, expected_present, expected_json): what gets scored in verified documents.

    Annotated schema leaves, plus ``required_fields``, plus predicted paths outside the schema when
    hallucinations are included. A path without annotation has ``expected_present = false``.
    Without any schema leaf, every annotated path is scored, and no predicted path is outside the schema.
    """
    known, bare = leaves.select("field_path"), not leaves.take(1)
    all_truth = _verified(truth).select("document_id", "field_path", F.col("value_json").alias("expected_json"))
    base = (all_truth if bare else all_truth.join(known, "field_path", "left_semi")).select(
        "document_id", "field_path", F.lit(True).alias("expected_present"), "expected_json")
    extra = None
    if config.required_fields:
        docs = all_truth.select("document_id").distinct()
        extra = docs.select("document_id", F.explode(F.array(*[F.lit(p) for p in config.required_fields])).alias("field_path"))
    if config.include_hallucinations and predictions is not None and not bare:
        outside = predictions.select("document_id", "field_path").join(known, "field_path", "left_anti")
        outside = outside.join(all_truth.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "field_path")
        extra = outside if extra is None else extra.unionByName(outside)
    if extra is None:
        return base
    # One shuffle adds the extra paths and keeps an annotation where there is one.
    flagged = extra.select("document_id", "field_path", F.lit(False).alias("p"), F.lit(None).cast("string").alias("e"))
    marked = all_truth.select("document_id", "field_path", F.lit(True).alias("p"), F.col("expected_json").alias("e"))
    in_schema = base.select("document_id", "field_path", F.lit(True).alias("wanted"))
    merged = (marked.join(in_schema, ["document_id", "field_path"], "left")
              .withColumn("wanted", F.coalesce("wanted", F.lit(False)))
              .unionByName(flagged.withColumn("wanted", F.lit(True))))
    return (merged.groupBy("document_id", "field_path")
            .agg(F.bool_or("wanted").alias("wanted"), F.bool_or("p").alias("expected_present"), F.max("e").alias("expected_json"))
            .where("wanted").drop("wanted"))


def unscored_documents(extractions: DataFrame, truth: DataFrame, leaves: DataFrame,
                       config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """(run_id, document_id, reason) for extractions without a usable verified annotation. Without schema leaves any annotation is usable.

    With hallucinations included, any verified annotation makes a document usable: its predicted paths are scored.
    """
    known = leaves.select("field_path", F.lit(True).alias("known"))
    marked = truth.join(known, "field_path", "left") if leaves.take(1) else truth.withColumn("known", F.lit(True))
    per_doc = (marked.groupBy("document_id")
               .agg(F.bool_or(F.coalesce(F.col("annotation_status"), F.lit("complete")) == "unverified").alias("unverified"),
                    F.count_if(F.col("known")).alias("n_known")))
    usable = F.lit(bool(config.required_fields) or config.include_hallucinations) | (F.col("n_known") > 0)
    reason = (F.when(F.col("unverified"), "ground_truth_unverified")
              .when(F.col("unverified").isNull() | ~usable, "ground_truth_missing"))
    return (extractions.select(*KEY).join(per_doc, "document_id", "left")
            .select(*KEY, reason.alias("reason")).where(F.col("reason").isNotNull()))


def pair_fields(truth_paths: DataFrame, predictions: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """One row per (run, document, scored path) with its prediction, absent predictions included.

    ``extractions`` says which documents each run has processed. Without it, every run is taken to have processed every
    document of the truth: a document without predictions is then a document of missing fields.
    """
    if extractions is not None:
        docs = extractions.select(*KEY).distinct()
    else:
        runs = predictions.agg(F.collect_set("run_id").alias("_runs"))  # one row; runs are few
        docs = truth_paths.select("document_id").distinct().crossJoin(F.broadcast(runs)).select(F.explode("_runs").alias("run_id"), "document_id")
    # one narrow row a document against all its fields: hashed, so that the fields are not sorted for it
    wanted = docs.hint("shuffle_hash").join(truth_paths, "document_id")
    cols = [c for c in ("value_json", "normalized_json", "confidence", "_landed") if c in predictions.columns]
    got = predictions.select(*KEY, "field_path", *cols)
    # sorted by document first: a run's name is the same in most rows, and sorting would compare whole keys
    met = wanted.join(got, ["document_id", "field_path", "run_id"], "left")
    return met.select(*KEY, *[c for c in met.columns if c not in KEY])


def classify(pairs: DataFrame, leaves: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Status, match type, score and validation errors of every pair."""
    normalized = F.col("normalized_json") if "normalized_json" in pairs.columns else F.lit(None).cast("string")
    tolerant, arrays = config.numeric_tolerance is not None, has_arrays(leaves)
    df = with_leaf(pairs, leaves)
    df = J.stage(df, {"_e": F.col("expected_json"), "_a": F.when(~J.is_null(normalized), normalized).otherwise(F.col("value_json"))}, tolerant, arrays)
    df = df.withColumn("validation_errors", J.apart(staged_errors("_a", None, arrays), F.col("_a_k")))
    e, a = F.col("_e_v"), F.col("_a_v")
    match = (F.when(F.col("_e_cv") == F.col("_a_cv"), "exact")
             .when(F.col("_e_norm") == F.col("_a_norm"), "normalized"))
    if tolerant:
        gap = F.abs(F.col("_e_num") - F.col("_a_num"))
        match = match.when(gap <= F.lit(str(config.numeric_tolerance)).cast("decimal(38,10)"), "numeric_tolerance")
    if config.edit_distance_max > 0:
        both = (F.col("_e_k") == "string") & (F.col("_a_k") == "string")
        match = match.when(both & (F.levenshtein("_e_n", "_a_n", config.edit_distance_max) >= 0), "edit_distance")
    df = df.withColumns({"_match": J.apart(match.otherwise("none"), F.col("_a_k")), "_bad": F.size("validation_errors") > 0,
                         "_empty": J.is_empty(a), "_null": F.col("expected_present") & J.is_null(e)})
    status = (F.when(F.col("_null") & F.col("_empty"), "correct")
              .when(F.col("_null") & F.col("_bad"), "validation_failed")
              .when(F.col("_null"), "hallucinated")
              .when(F.col("_empty"), "missing")
              .when(F.col("_bad"), "validation_failed")
              .when(F.col("expected_present") & (F.col("_match") != "none"), "correct")
              .otherwise("incorrect"))
    df = df.withColumn("status", status)
    ok = F.col("status") == "correct"
    landed = [F.coalesce("_landed", F.lit(False)).alias("_landed")] if "_landed" in df.columns else []
    return J.sealed(df, [*KEY, "field_path", *landed], [
        F.col("status"), F.when(ok & F.col("_null"), "exact").when(ok, F.col("_match")).otherwise("none").alias("match_type"),
        F.when(ok, 1).otherwise(0).alias("score"), F.col("expected_present"), F.col("expected_json"),
        F.col("value_json").alias("actual_json"),
        F.col("_e_norm").alias("normalized_expected"), F.col("_a_norm").alias("normalized_actual"),
        F.col("confidence") if "confidence" in df.columns else F.lit(None).cast("double").alias("confidence"),
        F.when(~ok, F.col("status")).alias("failure_type"), F.col("validation_errors")])


def score_fields(truth: DataFrame, predictions: DataFrame, leaves: DataFrame,
                 config: ScoringConfig = ScoringConfig(), extractions: DataFrame | None = None) -> DataFrame:
    """Latest truth x predictions -> one scored row per (run, document, annotated field)."""
    paths = annotated_paths(truth, leaves, config, predictions)
    return classify(pair_fields(paths, predictions, extractions), leaves, config)


def _counts() -> list[Column]:
    n = lambda s: F.count_if(F.col("status") == s)
    return [
        F.count(F.lit(1)).alias("scored_fields"), n("correct").alias("correct_fields"),
        F.count_if(F.col("match_type") == "exact").alias("exact_matches"),
        F.count_if(F.col("match_type").isin("normalized", "numeric_tolerance")).alias("normalized_matches"),
        F.count_if(F.col("match_type") == "edit_distance").alias("edit_distance_matches"),
        n("incorrect").alias("incorrect_predictions"), n("missing").alias("missing_fields"),
        n("hallucinated").alias("hallucinated_fields"), n("validation_failed").alias("validation_failures"),
        F.count_if(F.col("status") != "correct").alias("failure_count")]


COUNTS = ("scored_fields", "correct_fields", "exact_matches", "normalized_matches", "edit_distance_matches",
          "incorrect_predictions", "missing_fields", "hallucinated_fields", "validation_failures", "failure_count")


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    p = ratio(c("correct_fields"), c("correct_fields") + c("incorrect_predictions") + c("hallucinated_fields") + c("validation_failures"))
    r = ratio(c("correct_fields"), c("correct_fields") + c("incorrect_predictions") + c("missing_fields") + c("validation_failures"))
    return df.withColumns({
        "field_accuracy": ratio(c("correct_fields"), c("scored_fields")), "precision": p, "recall": r,
        "field_completeness": ratio(c("scored_fields") - c("missing_fields"), c("scored_fields")),
    }).withColumn("f1", F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def document_metrics(scored: DataFrame) -> DataFrame:
    """Counts and rates per (run, document). Rates are unrounded."""
    agg = scored.groupBy(*KEY).agg(*_counts(), F.avg("confidence").alias("average_confidence"))
    return _rates(agg).withColumn("document_accuracy", F.when(F.col("failure_count") == 0, 1).otherwise(0))


def run_metrics(scored: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Micro-averaged metrics per run; average_confidence is a mean of 4-digit per-document means."""
    per_doc = scored.groupBy(*KEY).agg(*_counts(), F.round(F.avg("confidence"), 4).alias("c"))
    agg = per_doc.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("scored_documents"), *[F.sum(n).alias(n) for n in COUNTS],
        F.count_if(F.col("failure_count") == 0).alias("perfect_documents"), F.avg("c").alias("average_confidence"))
    out = _rates(agg).withColumn("document_accuracy", ratio(F.col("perfect_documents"), F.col("scored_documents")))
    if extractions is None:
        return out
    totals = extractions.groupBy("run_id").agg(F.count_distinct("document_id").alias("documents"))
    return (totals.join(out, "run_id", "left")
            .withColumn("unscored_documents", F.col("documents") - F.coalesce("scored_documents", F.lit(0))))


def run_execution_metrics(extractions: DataFrame, outcomes: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Completed/failed counts, mean and nearest-rank p95 latency, cost and cache use per run."""
    done = extractions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("results"), F.avg("latency_ms").alias("average_latency_ms"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("total_cost_usd"),
        F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"))
    p95 = nearest_rank(extractions, ["run_id"], "latency_ms", 0.95, "p95_latency_ms")
    by_outcome = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    out = (by_outcome.join(done, "run_id", "left").join(p95, "run_id", "left")
           .withColumn("cost_per_document", ratio(F.col("total_cost_usd"), F.greatest(F.col("documents"), F.lit(1)))))
    if metrics is None:
        return out
    good = metrics.select("run_id", "perfect_documents")
    return out.join(good, "run_id", "left").withColumn(
        "cost_per_correct_document",
        F.when(F.col("perfect_documents").isNotNull(), ratio(F.col("total_cost_usd"), F.greatest(F.col("perfect_documents"), F.lit(1)))))


def run_status(outcomes: DataFrame, cancelled: DataFrame) -> DataFrame:
    """cancelled / completed / completed_with_failures / failed per run."""
    flags = cancelled.select("run_id", F.lit(True).alias("was_cancelled")).distinct()
    per_run = outcomes.groupBy("run_id").agg(F.count_if(F.col("status") == "completed").alias("completed"),
                                             F.count_if(F.col("status") == "failed").alias("failed"))
    status = (F.when(F.col("was_cancelled"), "cancelled").when(F.col("failed") == 0, "completed")
              .when(F.col("completed") > 0, "completed_with_failures").otherwise("failed"))
    return per_run.join(flags, "run_id", "left").select("run_id", "completed", "failed", status.alias("status"))


def field_metrics(scored: DataFrame) -> DataFrame:
    agg = scored.groupBy("run_id", "field_path").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "correct").alias("correct"),
        F.count_if(F.col("status") != "correct").alias("failures"))
    return agg.withColumn("accuracy", ratio(F.col("correct"), F.col("documents")))


def failure_counts(scored: DataFrame) -> DataFrame:
    """Failures per field with their share of the run's failures and rank."""
    from pyspark.sql import Window
    agg = (scored.where(F.col("status").isin(*FAILURES)).groupBy("run_id", "field_path")
           .agg(F.count(F.lit(1)).alias("failures")))
    w = Window.partitionBy("run_id")
    return agg.select("run_id", "field_path", "failures",
                      ratio(F.col("failures"), F.sum("failures").over(w)).alias("share"),
                      F.row_number().over(w.orderBy(F.desc("failures"), "field_path")).alias("rank"))
