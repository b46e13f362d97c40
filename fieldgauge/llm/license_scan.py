"""License scans: ordered signature rules behind a keyword prefilter, in Column expressions alone.

A text is read as its words (A-Z in lower case; words of ASCII letters, digits and characters beyond ASCII). One regex of all keywords marks the
places where a rule can stand; texts without a mark are done. At a marked word only the rules of that keyword are tried, one regex on the ``REACH`` words before it
and one on those after it, so the work grows with the marked places and not with text length times rules.

Detections overlap: "apache license" stands inside "licensed under the apache license version 2 0". They are sorted by their first word, longest and best first, and
passed once: one is suppressed if it lies inside a detection of better priority, or inside a longer one of the same priority. The pass keeps the furthest end for each
priority and a tally for each label, so its state is of fixed size however many detections a text has. Base rules are counted at all their places and are never suppressed.

Every row is worked on by itself: no shuffle, no state between rows. ``score`` is the sureness of the best detection that stays, 0 without any.

Defined results: a null or empty text has no words and no detections; repeated rows give equal results; empty tables give no rows; further columns are carried, the
operator's own win where names clash.
"""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonvals import sealed
from .license_rules import REACH, RULES, SURENESS, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"  # no word holds it
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def blanks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


def keyword_regex(keywords: list[str]) -> str:
    """Any keyword as a whole word of a text with single blanks, tried by first letter."""
    by_letter = defaultdict(list)
    for k in sorted(keywords):
        by_letter[k[0]].append(k[1:])
    return " (" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")(?= )"


def rule_table(rules: list[Rule], labels: list[str]) -> Column:
    """The rules of each keyword, as one literal map."""
    by_keyword = defaultdict(list)
    for r in rules:
        by_keyword[r.keyword].append(f"named_struct('label', {labels.index(r.label)}, 'priority', {r.priority}, 'base', {str(r.base).lower()}, "
                                     f"'before', r'(?:^| )({r.before})$', 'after', r'^({r.after})(?: |$)')")
    return F.expr("map(" + ", ".join(f"'{k}', array({', '.join(v)})" for k, v in by_keyword.items()) + ")")


def _places(words: Column, reach: int) -> Column:
    """Each marked word with the words around it."""
    marked = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(MARK), F.struct(i.alias("at"), F.substr(w, F.lit(2)).alias("keyword")))), lambda p: p.isNotNull())

    def around(p):
        first = F.greatest(F.lit(0), p["at"] - reach)
        before = F.array_join(F.slice(words, first + 1, p["at"] - first), " ")
        after = F.array_join(F.slice(words, p["at"] + 2, F.lit(reach)), " ")
        plain = [F.replace(x, F.lit(MARK), F.lit("")) for x in (before, after)]
        return F.struct(p["at"].alias("at"), p["keyword"].alias("keyword"), F.when(p["at"] > 0, F.concat(plain[0], F.lit(" "))).otherwise("").alias("before"),
                        F.when(F.length(plain[1]) > 0, F.concat(F.lit(" "), plain[1])).otherwise("").alias("after"))
    return F.transform(marked, around)


def _detections(places: Column, table: Column) -> Column:
    """All detections, sorted: earliest first, then longest, then best."""
    def at_place(p):
        fits = F.filter(F.element_at(table, p["keyword"]), lambda r: F.rlike(p["after"], r["after"]) & F.rlike(p["before"], r["before"]))
        return F.transform(fits, lambda r: F.struct(
            (p["at"] - blanks(F.call_function("regexp_extract", p["before"], r["before"], F.lit(1)))).alias("start"),
            (-(p["at"] + 1 + blanks(F.call_function("regexp_extract", p["after"], r["after"], F.lit(1))))).alias("minus_end"),
            r["priority"].alias("priority"), r["label"].alias("label"), r["base"].alias("base")))
    return F.array_sort(F.flatten(F.transform(places, at_place)))


def _tally(detections: Column, labels: int) -> Column:
    """For each label, the number of detections that stay, and their first and last word; one pass with a state of fixed size."""
    levels = len(SURENESS)
    spans = "array<struct<stop:int,start:int>>"
    tallies = "array<struct<n:int,first_word:int,last_word:int,priority:int>>"
    state = F.struct(F.array_repeat(F.expr("named_struct('stop', -1, 'start', -1)"), levels).cast(spans).alias("far"),
                     F.array_repeat(F.expr("named_struct('n', 0, 'first_word', cast(null as int), 'last_word', cast(null as int), 'priority', cast(null as int))"), labels).cast(tallies).alias("tally"))

    def step(s, d):
        stop, level = -d["minus_end"], d["priority"]

        def holds(f, k):
            inside = (k < level) & (f["stop"] >= stop)
            longer = (k == level) & ((f["stop"] > stop) | (f["stop"] == stop) & (f["start"] < d["start"]))
            return inside | longer
        lost = F.exists(F.transform(s["far"], holds), lambda x: x) & ~d["base"]
        far = F.transform(s["far"], lambda f, k: F.when((k == level) & (stop > f["stop"]), F.struct(stop.alias("stop"), d["start"].alias("start"))).otherwise(f))
        tally = F.transform(s["tally"], lambda t, k: F.when((k == d["label"]) & ~lost, F.struct(
            (t["n"] + 1).alias("n"), F.coalesce(t["first_word"], d["start"]).alias("first_word"), F.greatest(t["last_word"], stop - 1).alias("last_word"),
            F.least(t["priority"], level).alias("priority"))).otherwise(t))
        return F.struct(far.cast(spans).alias("far"), tally.cast(tallies).alias("tally"))
    return F.aggregate(detections, state, step, lambda s: s["tally"])


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, reach: int = REACH) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and detections (by label: n, first_word, last_word, priority)."""
    labels = sorted({r.label for r in rules})
    carried = [c for c in docs.columns if c not in OWN]
    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    low = F.translate("whole", UPPER, LOWER)
    words = given.select("*", F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("plain")).drop("whole")
    marked = words.select("*", F.regexp_replace(F.concat(F.lit(" "), "plain", F.lit(" ")), keyword_regex([*{r.keyword for r in rules}]), " " + MARK + "$1").alias("marked"))
    counted = marked.select("*", F.when(F.length("plain") > 0, blanks(F.col("plain")) + 1).otherwise(0).cast("long").alias("n_words"),
                            F.when(F.contains("marked", F.lit(MARK)), F.split(F.trim("marked"), " ")).alias("words")).drop("plain", "marked")
    placed = counted.select("*", _places(F.col("words"), reach).alias("places")).drop("words")
    found = placed.select("*", _detections(F.col("places"), rule_table(rules, labels)).alias("found")).drop("places")
    tallied = found.select("*", F.filter("found", lambda d: d["base"]).alias("base"), _tally(F.col("found"), len(labels)).alias("tally")).drop("found")
    names = F.array(*[F.lit(x) for x in labels])
    seen = F.filter(F.zip_with("tally", names, lambda t, name: F.when(t["n"] > 0, F.struct(
        name.alias("label"), t["n"].alias("n"), t["first_word"].alias("first_word"), t["last_word"].alias("last_word"), t["priority"].alias("priority")))), lambda d: d.isNotNull())
    listed = tallied.select("*", F.coalesce(seen, F.array().cast("array<struct<label:string,n:int,first_word:int,last_word:int,priority:int>>")).alias("detections")).drop("tally")
    base = F.coalesce(F.col("base"), F.array().cast(tallied.schema["base"].dataType))
    sure = F.array(*[F.lit(x) for x in SURENESS])
    return sealed(
        listed, [F.col(f"in_{c}").alias(c) for c in carried], [F.col("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda d: F.element_at(names, d["label"] + 1)))), ",").alias("base_labels"),
        F.array_join(F.transform("detections", lambda d: d["label"]), ",").alias("labels"),
        F.when(F.size("detections") > 0, F.element_at(sure, F.array_min(F.transform("detections", lambda d: d["priority"])) + 1)).otherwise(0.0).alias("score"), F.col("detections")])


def license_verdicts(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text")).drop("text", "detections")


def _license_sql(rules: list[Rule] = RULES, reach: int = REACH) -> str:
    """The same by joins: every word with a rule's keyword, then the detections inside others."""
    rows = ",\n".join(f"('{r.label}', {r.priority}, {str(r.base).lower()}, '{r.keyword}', '(?:^| )({r.before})$', '^({r.after})(?: |$)')" for r in rules)
    sure = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(SURENESS))
    return rf"""
WITH r(label, priority, base, keyword, before, after) AS (VALUES {rows}),
n AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT id, i, w[i] AS keyword, w[greatest(1, i - {reach}):i - 1] AS b, w[i + 1:i + {reach}] AS a FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM n) WHERE w[i] IN (SELECT keyword FROM r)),
q AS (SELECT id, i, keyword, CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') || ' ' ELSE '' END AS b, CASE WHEN len(a) > 0 THEN ' ' || array_to_string(a, ' ') ELSE '' END AS a FROM p),
d AS MATERIALIZED (SELECT id, label, priority, base, i - 1 - len(list_filter(string_split(regexp_extract(b, before, 1), ' '), lambda x: x <> '')) AS start,
    i + len(list_filter(string_split(regexp_extract(a, after, 1), ' '), lambda x: x <> '')) AS stop FROM q JOIN r USING (keyword) WHERE regexp_matches(b, before) AND regexp_matches(a, after)),
k AS (SELECT * FROM d WHERE base OR NOT EXISTS (SELECT 1 FROM d e WHERE e.id = d.id AND e.start <= d.start AND e.stop >= d.stop
    AND (e.priority < d.priority OR e.priority = d.priority AND e.stop - e.start > d.stop - d.start))),
b AS (SELECT id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM d WHERE base GROUP BY id),
l AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CASE min(priority) {sure} END AS score FROM k GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM n LEFT JOIN b USING (id) LEFT JOIN l USING (id)
"""


LICENSE_SQL = _license_sql()
