"""Catalog views: listings, filters, rollups and latest-row lookups over the saved tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsonvals as J, text as T
from .ranking import latest, ranked, top_k
from .scoring import FAILURES, ratio


# ---- filters and views -----------------------------------------------------------------------------
def scope_filter(df: DataFrame, workspace: str, project: str) -> DataFrame:
    """Restrict a read to one scope; on partitioned tables this prunes partitions."""
    return df.where((F.col("workspace_id") == workspace) & (F.col("project_id") == project))


def failure_filter(scored: DataFrame, extractions: DataFrame, status: str | None = None, field_path: str | None = None) -> DataFrame:
    """Non-correct fields with their extraction's latency and cost, filtered before the join."""
    rows = scored.where(F.col("status") != "correct")
    if status:
        rows = rows.where(F.col("status") == status)
    if field_path:
        rows = rows.where(F.col("field_path") == field_path)
    return rows.join(extractions.select("run_id", "document_id", "extraction_id", "latency_ms", "cost_usd"), ["run_id", "document_id"])


def latest_truth(truth: DataFrame, by: list[str] = ["document_id"]) -> DataFrame:
    """Newest annotation revision per key."""
    return latest(truth, by, F.col("revision"))


def truth_status(truth: DataFrame) -> DataFrame:
    """(document_id, revision, annotation_status) of the newest revision; reads three columns only."""
    return truth.groupBy("document_id").agg(
        F.max("revision").alias("revision"), F.max_by("annotation_status", "revision").alias("annotation_status"))


def document_search(documents: DataFrame, memberships: DataFrame, truth: DataFrame, query: str) -> DataFrame:
    """Case-insensitive filename or type search with dataset names and latest annotation state."""
    q = query.lower()
    hits = documents.where(F.contains(F.lower("filename"), F.lit(q)) | F.contains(F.lower("mime_type"), F.lit(q)))
    names = memberships.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("dataset_name")), "||").alias("dataset_names"))
    return (hits.join(names, "document_id", "left").join(truth_status(truth), "document_id", "left")
            .select("document_id", "filename", "mime_type", "dataset_names", "revision", "annotation_status"))


def dataset_filter(members: DataFrame, split: str | None = None, tag: str | None = None) -> DataFrame:
    if split:
        members = members.where(F.coalesce("split", F.lit("unspecified")) == split)
    return members.where(F.array_contains("tags", tag)) if tag else members


def dataset_members(members: DataFrame, documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Members with document, split, tags and the latest annotation revision and status."""
    return (members.join(documents, "document_id").join(truth_status(truth), "document_id", "left"))


def item_search_page(items: DataFrame, query: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of the items whose JSON contains the text, each row with the total and the next offset."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must be nonnegative and limit between 1 and 100")
    hits = items.where(F.contains(F.lower(F.to_json(F.struct(*items.columns))), F.lit(query.lower())))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(*order).offset(offset).limit(limit)
    after = F.lit(offset + limit)
    return page.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(after < F.col("total"), after).cast("long"))


def failed_documents_filter(scored: DataFrame, documents: DataFrame, field_path: str | None = None, search: str = "") -> DataFrame:
    """Documents with a failed field (or one failed field) whose name or field keys contain the text."""
    failed = scored.where(F.col("status").isin(*FAILURES))
    if field_path:
        failed = failed.where(F.col("field_path") == field_path)
    out = documents.join(failed.select("document_id"), "document_id", "left_semi")
    if search:
        s = F.lit(search.lower())
        by_key = scored.where(F.contains(F.lower("field_path"), s)).select("document_id").distinct().withColumn("_key", F.lit(True))
        out = (out.join(by_key, "document_id", "left")
               .where(F.contains(F.lower("filename"), s) | F.coalesce("_key", F.lit(False))).drop("_key"))
    return out


def companion_status(scored: DataFrame) -> DataFrame:
    """Each leaf with the expected ``.status`` value of its parent object."""
    parent = F.regexp_extract("field_path", r"^(.*)\.[^.]*$", 1)
    own = scored.withColumn("parent", parent)
    status = (scored.where(F.endswith("field_path", F.lit(".status")) & (J.kind(F.col("expected_json")) == "string"))
              .select("run_id", "document_id", parent.alias("parent"), J.text(F.col("expected_json")).alias("expected_status")))
    return own.join(status, ["run_id", "document_id", "parent"], "left").drop("parent")


def evaluation_document_view(predictions: DataFrame, scored: DataFrame) -> DataFrame:
    """Union of predicted and scored field keys; the scored actual wins over the prediction."""
    p = predictions.select("run_id", "document_id", "field_path", F.col("value_json").alias("_p"), F.col("confidence"))
    s = scored.select("run_id", "document_id", "field_path", F.col("actual_json").alias("_a"), "expected_json", "status", F.lit(True).alias("_s"))
    j = p.join(s, ["run_id", "document_id", "field_path"], "full")
    return j.select("run_id", "document_id", "field_path", F.when(F.col("_s"), F.col("_a")).otherwise(F.col("_p")).alias("value_json"),
                    "confidence", "expected_json", F.coalesce("_s", F.lit(False)).alias("has_expected"),
                    F.coalesce("status", F.lit("unscored")).alias("status"))


def answer_fields(fields: DataFrame, keys=("run_id", "document_id")) -> DataFrame:
    """Drop ``.excerpt``/``.location`` companions of complete answers unless they are annotated themselves."""
    parent = F.regexp_extract("field_path", r"^(.*)\.[^.]*$", 1)
    name = F.regexp_extract("field_path", r"([^.]*)$", 1)
    f = fields.withColumn("_parent", parent).withColumn("_name", name)
    four = F.array(*[F.lit(n) for n in ("value", "status", "excerpt", "location")])
    complete = (f.where(F.col("_name").isin("value", "status", "excerpt", "location") & (F.col("_parent") != ""))
                .groupBy(*keys, "_parent").agg((F.size(F.array_intersect(F.collect_set("_name"), four)) == 4).alias("_complete")))
    hidden = F.col("_name").isin("excerpt", "location") & ~F.col("has_expected") & F.coalesce("_complete", F.lit(False))
    return f.join(complete, [*keys, "_parent"], "left").where(~hidden).drop("_parent", "_name", "_complete")


def table_value_columns(values: DataFrame, keys: list[str], value: str = "value_json") -> DataFrame:
    """Columns of array-of-object values: union of row keys, ordered by first appearance."""
    rows = values.select(*keys, F.posexplode(J.elements(F.col(value))).alias("row_pos", "row"))
    cells = rows.select(*keys, "row_pos", F.posexplode(J.members(F.col("row"))).alias("key_pos", "m"))
    return cells.groupBy(*keys, F.col("m.key").alias("column")).agg(
        F.min(F.struct("row_pos", "key_pos")).alias("first"), F.count(F.lit(1)).alias("rows"))


# ---- aggregations ----------------------------------------------------------------------------------
def dataset_stats(members: DataFrame, truth: DataFrame) -> DataFrame:
    """document_count, annotated_count and coverage percent per dataset."""
    annotated = truth.select("document_id").distinct().withColumn("_a", F.lit(1))
    agg = members.join(annotated, "document_id", "left").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("document_count"), F.count_distinct(F.when(F.col("_a") == 1, F.col("document_id"))).alias("annotated_count"))
    return agg.withColumn("gt_coverage", F.round(ratio(F.col("annotated_count"), F.col("document_count")) * 100, 1))


def group_rollup(groups: DataFrame, experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """experiment_count and run_count per group; both sides are reduced before they meet."""
    per_exp = runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"))
    per_group = experiments.join(per_exp, "experiment_id", "left").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("experiment_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("run_count"))
    return groups.join(per_group, "group_id", "left").select(
        "group_id", F.coalesce("experiment_count", F.lit(0)).alias("experiment_count"), F.coalesce("run_count", F.lit(0)).alias("run_count"))


def run_listing(runs: DataFrame, extractions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Runs with extraction and evaluation counts, each pre-aggregated so the joins do not fan out."""
    x = extractions.groupBy("run_id").agg(F.count(F.lit(1)).alias("extraction_count"))
    e = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("evaluation_count"))
    return (runs.join(x, "run_id", "left").join(e, "run_id", "left")
            .na.fill(0, ["extraction_count", "evaluation_count"]))


def usage_totals(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric usage keys summed over steps; for other keys the first value. Needs ``pos`` and ``usage_json``."""
    cells = steps.select(*keys, "pos", F.explode(J.members(F.col("usage_json"))).alias("m"))
    number = J.number(F.col("m.value")).cast("double")
    return cells.groupBy(*keys, F.col("m.key").alias("key")).agg(
        F.sum(number).alias("total"), F.min_by(F.when(number.isNull(), F.col("m.value")), F.when(number.isNull(), F.col("pos"))).alias("first_value"))


def folder_counts(documents: DataFrame) -> DataFrame:
    """Every folder and its ancestors with the number of documents exactly in it."""
    path = T.folder_path(F.col("folder"))
    exact = documents.select(path.alias("path")).where("path <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    folders = exact.select(F.explode(prefixes).alias("path"), F.lit(0).cast("long").alias("n")).unionByName(exact)
    return folders.groupBy("path").agg(F.sum("n").alias("document_count")).select(
        "path", F.regexp_extract("path", r"([^/]+)/$", 1).alias("name"), F.regexp_extract("path", r"^(.*/)[^/]+/$", 1).alias("parent_path"), "document_count")


def warnings_rollup(extractions: DataFrame) -> DataFrame:
    """Warning counts per run. ``warnings`` is an array."""
    return extractions.groupBy("run_id").agg(F.sum(F.size("warnings")).alias("warnings"), F.count_if(F.size("warnings") > 0).alias("documents_with_warnings"))


def first_run_per_version(runs: DataFrame) -> DataFrame:
    return runs.groupBy("processor_version_id", "name").agg(F.min("created_at").alias("first_run_at"))


def run_totals(runs: DataFrame, by: list[str]) -> DataFrame:
    """Total cost (unknown if any run's is) and duration in milliseconds (never negative)."""
    ms = F.greatest(F.unix_millis("completed_at") - F.unix_millis("started_at"), F.lit(0))
    return runs.groupBy(*by).agg(F.when(~F.bool_or(F.col("cost_usd").isNull()), F.sum("cost_usd")).alias("total_cost_usd"),
                                 F.sum(ms).alias("duration_ms"), F.count(F.lit(1)).alias("runs"))


# ---- latest / windows ------------------------------------------------------------------------------
def truth_history(truth: DataFrame) -> DataFrame:
    """Revisions of each document, newest first (revisions of one document are few)."""
    w = Window.partitionBy("document_id").orderBy(F.desc("revision"))
    return truth.withColumn("age", F.row_number().over(w))


def resolve_version(versions: DataFrame, version: int | None = None) -> DataFrame:
    """Published first, then the highest version; or the explicitly numbered one."""
    if version is not None:
        return versions.where(F.col("version") == version)
    return latest(versions, ["processor_id"], F.struct((F.col("status") == "published").cast("int"), F.col("version")))


def latest_extraction(extractions: DataFrame, by_processor: bool = False) -> DataFrame:
    keys = ["document_id", "processor_id"] if by_processor else ["document_id"]
    return latest(extractions, keys, F.struct("created_at", "extraction_id"))


def representative_run(runs: DataFrame) -> DataFrame:
    """Per experiment the newest completed run, else the newest."""
    return latest(runs, ["group_id", "experiment_id"], F.struct((F.lower("status") == "completed").cast("int"), F.col("created_at"), F.col("run_id")))


def best_run(runs: DataFrame) -> DataFrame:
    """Per group the best completed score among runs that share the baseline's fingerprint.

    The baseline is the oldest completed scored run, else the oldest.
    """
    scored = F.col("score").isNotNull() & (F.col("status") == "completed")
    base = runs.groupBy("group_id").agg(F.min_by("fingerprint", F.struct((~scored).cast("int"), F.col("created_at"), F.col("run_id"))).alias("base_fingerprint"))
    same = runs.where(scored).join(base, "group_id").where(F.col("fingerprint") == F.col("base_fingerprint"))
    return same.groupBy("group_id").agg(F.max("score").alias("score"), F.min_by("run_id", F.struct(-F.col("score"), F.col("created_at"), F.col("run_id"))).alias("run_id"))


def score_trend(runs: DataFrame, k: int = 8) -> DataFrame:
    """Last ``k`` scored runs per group in time order, with the step and the delta to the first shown."""
    recent = top_k(runs.where("score is not null"), ["group_id"], [F.desc("created_at"), F.desc("run_id")], k)
    w = Window.partitionBy("group_id").orderBy("created_at", "run_id")
    return recent.select("group_id", "run_id", "created_at", "score", F.row_number().over(w).alias("pos"),
                         F.round((F.col("score") - F.lag("score").over(w)) * 100, 4).alias("step_points"),
                         F.round((F.col("score") - F.first("score").over(w)) * 100, 4).alias("delta_points"))


def experiment_history(runs: DataFrame) -> DataFrame:
    """Runs by experiment in date order; a run without one is its own experiment."""
    exp = runs.withColumn("experiment_id", F.coalesce("experiment_id", F.concat(F.lit("legacy:"), F.col("run_id"))))
    return ranked(exp, ["group_id", "experiment_id"], F.substring("created_at", 1, 10), [F.col("created_at"), F.col("run_id")], rank="pos")


def interval_union_latency(steps: DataFrame, keys: list[str], kinds: list[str] | None = None, bucket_ms: int = 3_600_000) -> DataFrame:
    """Time covered by completed step intervals: overlap counted once, gaps not at all.

    A key's intervals are swept in start-time buckets: the furthest end of all earlier buckets is prefixed
    from bucket totals, so a hot key is spread over its buckets.
    """
    done = steps.where((F.col("status") == "completed") & (F.col("kind").isin(kinds) if kinds else F.lit(True)))
    # Equal starts collapse map-side: only the longest of them can add covered time.
    spans = done.groupBy(*keys, "start_ms").agg(F.max(F.col("start_ms") + F.col("latency_ms")).alias("end_ms"))
    spans = spans.withColumn("_bucket", F.floor(F.col("start_ms") / bucket_ms))
    tops = spans.groupBy(*keys, "_bucket").agg(F.max("end_ms").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_bucket", F.max("_top").over(before).alias("_before"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    swept = spans.withColumn("_prev", F.max("end_ms").over(w)).join(tops, [*keys, "_bucket"])
    seen = F.greatest("_prev", "_before")
    covered = F.greatest(F.col("end_ms") - F.greatest(F.col("start_ms"), seen), F.lit(0))
    return swept.groupBy(*keys).agg(F.sum(covered).cast("long").alias("latency_ms"))


def run_steps_page(traces: DataFrame, document_id: str | None, offset: int, limit: int) -> DataFrame:
    """Page of exploded step traces: (document_id, step_index, step). ``traces.steps`` is an array."""
    rows = traces if document_id is None else traces.where(F.col("document_id") == document_id)
    return (rows.select("document_id", F.posexplode("steps").alias("step_index", "step"))
            .orderBy("document_id", "step_index").offset(offset).limit(limit))


def draft_next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("processor_id").agg((F.max("version") + 1).alias("next_version"))


def datasets_needing_baseline(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets that have runs outside any experiment (semi join)."""
    loose = runs.where(F.coalesce("experiment_id", F.lit("")) == "")
    return datasets.join(loose.select("dataset_id"), "dataset_id", "left_semi")
