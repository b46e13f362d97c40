"""Failure diagnosis: recurring mismatches, source context, leakage of source text, review queues."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonvals as J, text as T
from ..session import materialized
from .ranking import latest, top_k
from .scoring import FAILURES, ratio

REVIEW_STATES = ("accepted", "corrected", "ground_truth_issue", "ambiguous", "ignored")


def top_failing_fields(scored: DataFrame, k: int = 8) -> DataFrame:
    """Per run, fields by failure count; one passing control document each. Counts are combined map-side."""
    ok = F.col("status") == "correct"
    agg = scored.groupBy("run_id", "field_path").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(~ok).alias("failed"),
        F.min(F.when(ok, F.struct("document_id", "expected_json", "actual_json"))).alias("_control")).where(F.col("failed") > 0)
    agg = agg.select("run_id", "field_path", "scored", "failed", F.col("_control.document_id").alias("control_document_id"),
                     F.col("_control.expected_json").alias("control_expected"), F.col("_control.actual_json").alias("control_actual"))
    return top_k(agg, ["run_id"], [F.desc("failed"), F.col("field_path")], k, "field_rank")


def failure_patterns(scored: DataFrame, fields: int = 8, patterns: int = 4, examples: int = 2) -> DataFrame:
    """Per run, top mismatch patterns (status, expected, actual) of the top failing fields, with example documents.

    The scoring is done once: its narrow columns are written to the shared folder. Hot patterns are reduced map-side;
    the examples of a pattern are cut to a few per task before the shuffle.
    """
    scored = materialized(scored.select("run_id", "field_path", "status", "document_id", "expected_json", "actual_json"), "scored")
    sig = ["run_id", "field_path", "status", "expected", "actual"]
    bad = scored.where(F.col("status") != "correct").select(
        "run_id", "field_path", "status", F.coalesce(J.canonical(F.col("expected_json")), F.lit("null")).alias("expected"),
        F.coalesce(J.canonical(F.col("actual_json")), F.lit("null")).alias("actual"), "document_id")
    counts = materialized(bad.groupBy(*sig).agg(F.count(F.lit(1)).alias("count"), F.min("document_id").alias("first_document")), "patterns")
    n = counts.groupBy("run_id", "field_path").agg(F.count(F.lit(1)).alias("pattern_count"))
    best = top_k(counts, ["run_id", "field_path"], [F.desc("count"), F.col("first_document"), F.col("status"), F.col("expected"), F.col("actual")], patterns, "pattern_rank")
    top = top_failing_fields(scored, fields)
    kept = best.join(top, ["run_id", "field_path"]).join(n, ["run_id", "field_path"])
    picked = top_k(bad.join(kept.select(*sig), sig, "left_semi"), sig, [F.col("document_id")], examples, "_r")
    shown = picked.groupBy(*sig).agg(F.array_sort(F.collect_list("document_id")).alias("examples"))
    return kept.join(shown, sig).select("run_id", "field_path", "field_rank", "scored", "failed", "control_document_id", "control_expected", "control_actual",
                                        "pattern_count", "pattern_rank", "status", "expected", "actual", "count", "examples")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(document_id, page, text): block texts of a page joined by spaces with whitespace normalized."""
    parts = F.array_sort(F.collect_list(F.struct("source_index", "text")))
    joined = F.array_join(F.transform(parts, lambda b: b["text"]), " ")
    return blocks.where(F.col("text") != "").groupBy("document_id", "page").agg(T.collapse(joined).alias("text"))


def source_context(requests: DataFrame, pages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First quote found in a page's text, as a window around it; (document_id, field_path, page, text, selection).

    ``requests``: (document_id, field_path, needle_rank, needle), the excerpt first, and the columns ``by``, each of whose values is answered by
    itself. Every request row gets an answer: a matched window, a keyword window, or none.
    """
    key = ["document_id", "field_path", *by]
    needles = requests.withColumn("_n", T.collapse(F.col("needle"))).where(F.col("_n") != "")
    # a document's needles travel as one array; a page's text leaves the join once for each hit only
    asked_of = needles.groupBy("document_id").agg(F.collect_list(F.struct("field_path", *by, "needle_rank", "_n")).alias("_needles"))
    low = pages.join(asked_of, "document_id").withColumn("_low", F.lower("text"))
    at = F.filter(F.transform("_needles", lambda x: F.struct(*[x[c].alias(c) for c in ("field_path", *by, "needle_rank", "_n")],
                                                             F.call_function("locate", F.lower(x["_n"]), F.col("_low")).alias("_at"))), lambda x: x["_at"] > 0)
    hit = low.select("document_id", "page", "text", F.inline(at))
    start = F.greatest(F.col("_at") - 300, F.lit(1))
    end = F.col("_at") - 1 + F.least(F.length("_n"), F.lit(1200)) + 400
    window = F.substring("text", start, end - start + 1)
    found = (hit.groupBy(*key).agg(F.min_by(F.struct("page", window.alias("text")), F.struct("needle_rank", "page")).alias("_f")))
    asked = requests.select(*key).distinct()
    missing = asked.join(found, key, "left_anti")
    fallback = keyword_windows(missing.select("document_id", "field_path").distinct() if by else missing, pages)
    fallback = missing.join(fallback, ["document_id", "field_path"]).select(*key, "page", "text") if by else fallback
    matched = found.select(*key, F.col("_f.page").alias("page"), F.col("_f.text").alias("text"), F.lit("matched extraction evidence").alias("selection"))
    none = missing.join(fallback, key, "left_anti").select(*key, F.lit(None).cast("int").alias("page"), F.lit("").alias("text"), F.lit("source text unavailable").alias("selection"))
    return matched.unionByName(fallback.withColumn("selection", F.lit("source context; relevance not verified"))).unionByName(none)


def failure_sources(patterns: DataFrame, needles: DataFrame, pages: DataFrame) -> DataFrame:
    """``patterns`` (see ``failure_patterns``) plus the source text of each example and of the passing control.

    The text is fetched after the top patterns are known: only the pages of the few documents they name (fields x (patterns x examples + 1) of a run) are read on,
    and no text takes part in the ranking. ``needles``: (run_id, document_id, field_path, needle_rank, needle), what the run's extraction cites for a field.
    Adds ``sources``, array<struct<document_id,page,text,selection>> in the order of ``examples``, and ``control_source``; a run without a control has null there.
    """
    key = ["run_id", "document_id", "field_path"]
    patterns = materialized(patterns, "patterns-shown")
    shown = patterns.select("run_id", "field_path", "pattern_rank", F.posexplode("examples").alias("pos", "document_id"))
    control = patterns.select("run_id", "field_path", F.col("control_document_id").alias("document_id")).where("document_id IS NOT NULL")
    wanted = materialized(shown.select(*key).unionByName(control.select(*key)).distinct(), "documents-shown")
    nothing = wanted.select(*key, F.lit(None).cast("int").alias("needle_rank"), F.lit("").alias("needle"))
    asked = needles.select(*key, "needle_rank", "needle").join(wanted, key, "left_semi").unionByName(nothing)
    context = source_context(asked, pages.join(wanted.select("document_id").distinct(), "document_id", "left_semi"), ("run_id",))
    context = materialized(context.select(*key, F.struct("document_id", "page", "text", "selection").alias("source")), "sources-shown")
    listed = shown.join(context, key).groupBy("run_id", "field_path", "pattern_rank").agg(F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("_s"))
    beside = context.select("run_id", "field_path", F.col("document_id").alias("control_document_id"), F.col("source").alias("control_source"))
    return (patterns.join(listed, ["run_id", "field_path", "pattern_rank"], "left").join(beside, ["run_id", "field_path", "control_document_id"], "left")
            .select(*patterns.columns, F.col("_s.source").alias("sources"), "control_source"))


def field_words(path: Column) -> Column:
    """Lower-case words of three or more letters in a field path, camel case split."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(path, r"([a-z])([A-Z])", "$1 $2")), F.lit(r"[a-z]{3,}"), F.lit(0))


def keyword_windows(requests: DataFrame, pages: DataFrame, size: int = 1600, step: int = 1200) -> DataFrame:
    """The 1600-character window with most occurrences of the field name's words; the earliest among equals."""
    texts = pages.where(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    windows = texts.select("document_id", "page", F.explode(starts).alias("start"), "text").select(
        "document_id", "page", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))
    asked = requests.select("document_id", F.struct("field_path", field_words(F.col("field_path")).alias("words")).alias("f")).groupBy("document_id").agg(F.collect_set("f").alias("_asked"))
    low = F.col("_low")
    count = lambda w: ((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")
    score = lambda f: F.struct(f["field_path"].alias("field_path"), F.aggregate(f["words"], F.lit(0), lambda a, w: a + count(w)).alias("_score"))
    scored = windows.join(asked, "document_id").withColumn("_low", F.lower("text")).select("document_id", "page", "start", "text", F.inline(F.transform("_asked", score)))
    best = scored.groupBy("document_id", "field_path").agg(F.max_by(F.struct("page", "text"), F.struct("_score", (-F.col("page")).alias("p"), (-F.col("start")).alias("s"))).alias("_b"))
    return best.select("document_id", "field_path", F.col("_b.page").alias("page"), F.col("_b.text").alias("text"))


def aligned_blocks(texts: DataFrame, id_column: str, block: int, hop: int, reach: int) -> DataFrame:
    """Every ``hop``-th block of each text: (id, piece, lead, around); ``around`` starts ``lead`` characters before it.

    Texts are first cut into short chunks with their neighbours' edges, since taking a substring of a long text
    walks it from the start.
    """
    size = hop * max(1, 1024 // hop)
    chunks = texts.select(id_column, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("c"))
    edges = F.transform("c", lambda x, i: F.struct(
        F.coalesce(F.right(F.get("c", i - 1), F.lit(hop - 1)), F.lit("")).alias("pre"),
        F.concat(x, F.coalesce(F.left(F.get("c", i + 1), F.lit(reach)), F.lit(""))).alias("body"), F.length(x).alias("n")))
    local = chunks.select(id_column, F.explode(edges).alias("e")).select(id_column, "e.*")
    at = local.select(id_column, F.length("pre").alias("k"), F.concat("pre", "body").alias("all"), F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(hop))).alias("p"))
    lead = F.least(F.col("k") + F.col("p"), F.lit(hop - 1))
    return at.select(id_column, F.substring("all", F.col("k") + F.col("p") + 1, F.lit(block)).alias("piece"), lead.alias("lead"),
                     F.substring("all", F.col("k") + F.col("p") - lead + 1, F.lit(hop - 1 + reach)).alias("around")).where(F.length("piece") == block)


def contamination_shingles(texts: DataFrame, sources: DataFrame, answers: DataFrame | None = None, id_column: str = "document_id",
                           length: int = 100, stride: int = 40) -> DataFrame:
    """(id, kind): texts that copy a source shingle or a long expected answer; exact over whole texts.

    A text containing a 100-character shingle contains one whole 40-character block at a multiple of 61, so only
    every 61st block of a text is looked up. Sources list the 40-character pieces of their shingles at 61 offsets;
    a hit is confirmed against the full shingle in the text's neighbourhood. Semi joins emit no pairs.
    """
    block = stride
    hop = length - block + 1
    n = F.length("text")
    shingles = (sources.where(n >= length).select(F.explode(F.sequence(F.lit(0), n - length, F.lit(stride))).alias("o"), "text")
                .select(F.substring("text", F.col("o") + 1, F.lit(length)).alias("shingle")).distinct())
    pieces = shingles.select("shingle", F.explode(F.sequence(F.lit(0), F.lit(hop - 1))).alias("j")).select(
        F.substring("shingle", F.col("j") + 1, F.lit(block)).alias("piece"), "j", "shingle")
    cut = aligned_blocks(texts.where(n >= length), id_column, block, hop, length)
    t, s = cut.alias("t"), pieces.alias("s")
    exact = (F.col("t.piece") == F.col("s.piece")) & (F.col("s.j") <= F.col("t.lead")) & (
        F.substring("t.around", F.col("t.lead") - F.col("s.j") + 1, F.lit(length)) == F.col("s.shingle"))
    copied = t.join(s, exact, "left_semi").select(id_column).distinct().withColumn("kind", F.lit("source_text"))
    if answers is None:
        return copied
    return copied.unionByName(long_answers(texts, answers, id_column))


def long_answers(texts: DataFrame, answers: DataFrame, id_column: str, least: int = 12) -> DataFrame:
    """Texts containing an expected answer of at least 12 characters; exact over whole texts.

    Any 12 characters contain a whole 6-character block at a multiple of 7, so a text lists every 7th block and an
    answer the pieces of its first 12 characters. Texts whose head matches are then checked against the answers
    that share the head, held as arrays.
    """
    block, hop, n = least // 2, least // 2 + 1, F.length("text")
    # answers that share a head are dealt over 64 arrays, so that one common beginning makes no unbounded value
    heads = (answers.where(F.length("answer") >= least).groupBy(F.substring("answer", 1, least).alias("head"), F.pmod(F.xxhash64("answer"), F.lit(64)).alias("_part"))
             .agg(F.collect_set("answer").alias("answers")))
    pieces = heads.select("head").distinct().select("head", F.explode(F.sequence(F.lit(0), F.lit(hop - 1))).alias("j")).select(
        "head", "j", F.substring("head", F.col("j") + 1, F.lit(block)).alias("piece"))
    cut = aligned_blocks(texts.where(n >= least), id_column, block, hop, least)
    seen = (cut.join(pieces, "piece").where((F.col("j") <= F.col("lead")) & (F.substring("around", F.col("lead") - F.col("j") + 1, F.lit(least)) == F.col("head")))
            .select(id_column, "head").distinct())
    hit = (seen.join(heads, "head").join(texts.select(id_column, "text"), id_column)
           .where(F.exists("answers", lambda a: F.contains(F.col("text"), a))))
    return hit.select(id_column).distinct().withColumn("kind", F.lit("expected_answer"))


KINDS = {"missing": ("Recover missing {}", "Prompt refinement"), "hallucinated": ("Ground {} in the source", "Grounding"),
         "validation_failed": ("Check the format of {}", "Schema compliance")}


def suggest_experiments(scored: DataFrame, leaves: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Per run the top failing fields by documents and rate, with the dominant failure and a suggested experiment."""
    # A document counts once per field, however often it was scored.
    per_doc = scored.groupBy("run_id", "field_path", "document_id").agg(F.min("status").alias("status"), F.bool_or(J.kind(F.col("expected_json")).isin("array", "object")).alias("s"))
    per_status = per_doc.groupBy("run_id", "field_path", "status").agg(F.count(F.lit(1)).alias("n"), F.bool_or("s").alias("s"))
    bad = F.col("status").isin(*FAILURES)
    agg = per_status.groupBy("run_id", "field_path").agg(
        F.sum("n").alias("scored_documents"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("failing_documents"),
        F.min_by(F.when(bad, F.col("status")), F.when(bad, F.struct((-F.col("n")).alias("n"), F.col("status")))).alias("dominant"),
        F.coalesce(F.bool_or(F.when(bad, F.col("s"))), F.lit(False)).alias("structured")).where("failing_documents > 0")
    if leaves is not None:
        arrays = leaves.where(F.col("type").isin("array", "object")).select("field_path", F.lit(True).alias("_arr"))
        agg = agg.join(arrays, "field_path", "left").withColumn("structured", F.col("structured") | F.coalesce("_arr", F.lit(False))).drop("_arr")
    ranked = top_k(agg.withColumn("rate", ratio(F.col("failing_documents"), F.col("scored_documents"))), ["run_id"],
                   [F.desc("failing_documents"), F.desc("rate"), F.col("field_path")], k)
    title = F.when(F.col("structured"), F.format_string("Verify the structure of %s", "field_path")).otherwise(F.format_string("Disambiguate %s", "field_path"))
    kind = F.when(F.col("structured"), "Structured extraction").otherwise("Prompt refinement")
    for status, (t, name) in KINDS.items():
        title = F.when(F.col("dominant") == status, F.format_string(t.replace("{}", "%s"), "field_path")).otherwise(title)
        kind = F.when(F.col("dominant") == status, name).otherwise(kind)
    return ranked.withColumn("title", title).withColumn("kind", kind)


def review_backlog(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Failed or low-confidence scored fields that nobody has reviewed."""
    low = (T.valid_confidence(F.col("confidence")) < 0.9)
    open_ = scored.where(F.coalesce(low, F.lit(False)) | F.col("status").isin(*FAILURES))
    return open_.join(reviews, ["run_id", "document_id", "field_path"], "left_anti")


def review_decision_latest(decisions: DataFrame, scored: DataFrame) -> DataFrame:
    """Last decision per (run, document, field, reviewer) with a known status and an existing scored field."""
    valid = decisions.where(F.col("status").isin(*REVIEW_STATES))
    known = valid.join(scored, ["run_id", "document_id", "field_path"], "left_semi")
    return latest(known, ["run_id", "document_id", "field_path", "reviewer"], F.struct("updated_at", "decision_id"))


def review_assignment_queue(assignments: DataFrame, members: DataFrame, reviewer: str | None = None, status: str | None = None) -> DataFrame:
    """Current assignments of dataset members, optionally for one reviewer or status."""
    now = latest(assignments, ["dataset_id", "document_id", "reviewer"], F.struct("updated_at", "assignment_id"))
    if reviewer:
        now = now.where(F.col("reviewer") == reviewer)
    if status:
        now = now.where(F.col("status") == status)
    return now.join(members, ["dataset_id", "document_id"], "left_semi")


def near_text_locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Locate quotes: the first query string with exactly one hit, on the preferred page when that page has any.

    ``quotes``: (document_id, quote_id, excerpt, preferred_page).
    """
    asked = quotes.select("document_id", "quote_id", "preferred_page", F.posexplode(T.excerpt_queries(F.col("excerpt"))).alias("query_pos", "query"))
    asked = asked.groupBy("document_id").agg(F.collect_list(F.struct("quote_id", "preferred_page", "query_pos", "query")).alias("_asked"))
    low = F.col("_low")
    hits = lambda q: ((F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).cast("int")
    met = F.filter(F.transform("_asked", lambda x: F.struct(*[x[c].alias(c) for c in ("quote_id", "preferred_page", "query_pos", "query")], hits(F.lower(x["query"])).alias("_h"))), lambda x: x["_h"] > 0)
    found = pages.join(asked, "document_id").withColumn("_low", F.lower("text")).select("document_id", "page", F.inline(met))
    here = F.col("page") == F.col("preferred_page")
    agg = found.groupBy("document_id", "quote_id", "query_pos").agg(
        F.sum("_h").alias("all_hits"), F.sum(F.when(here, F.col("_h")).otherwise(0)).alias("page_hits"),
        F.min("page").alias("_first"), F.min(F.when(here, F.col("page"))).alias("_pref"), F.first("query").alias("query"))
    unique = agg.where((F.col("page_hits") == 1) | ((F.col("page_hits") == 0) & (F.col("all_hits") == 1)))
    best = unique.groupBy("document_id", "quote_id").agg(F.min_by(F.struct("query_pos", "query", F.coalesce("_pref", "_first").alias("page")), "query_pos").alias("_b"))
    return best.select("document_id", "quote_id", "_b.query_pos", "_b.query", "_b.page")
