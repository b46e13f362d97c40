"""Literal cases: normalization, scoring, votes, boxes, dates, costs."""
import json

import pytest
from pyspark.sql import functions as F

from fieldgauge import EvalFrame, ScoringConfig, schema_leaves
from fieldgauge.functions import jsonvals as J, text as T
from fieldgauge.operators import benchmark as B, catalog as K, compare as C, consensus as V, cost as P, diagnose as D, extract as X, layout as L

CONTRACT = {"type": "object", "properties": {
    "document_name": {"type": "string"}, "effective_date": {"type": "string", "format": "date"},
    "renewal_term": {"type": "string"}, "termination_for_convenience": {"type": "boolean"}}}
GOLD = {"document_name": '"Agreement"', "effective_date": '"2014-05-08"', "renewal_term": "null", "termination_for_convenience": "false"}


def values(spark, exprs, schema="x string"):
    return spark.createDataFrame(exprs, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def fields(spark, mapping, run="r"):
    rows = [(run, "d", k, v, None) for k, v in mapping.items()]
    return spark.createDataFrame(rows, "run_id string, document_id string, field_path string, value_json string, normalized_json string")


def truth(spark, mapping, status="complete"):
    return spark.createDataFrame([("d", k, v, status, 1) for k, v in mapping.items()],
                                 "document_id string, field_path string, value_json string, annotation_status string, revision int")


def statuses(spark, predicted, gold=GOLD, config=ScoringConfig(), schema=CONTRACT):
    s = EvalFrame(fields(spark, predicted), truth(spark, gold), schema_leaves(spark, schema)).score(config)
    return {r.field_path: (r.status, r.match_type) for r in s.fields.collect()}


def test_all_gold_is_correct_and_each_failure_is_classified(spark):
    assert all(s == "correct" for s, _ in statuses(spark, GOLD).values())
    got = statuses(spark, {"document_name": '"agreement "', "effective_date": '"5/9/14"', "renewal_term": '"1 year"', "extra": '"x"'})
    assert got == {"document_name": ("correct", "normalized"), "effective_date": ("incorrect", "none"),
                   "renewal_term": ("hallucinated", "none"), "termination_for_convenience": ("missing", "none")}


def test_validation_fails_even_when_values_match(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}, "rows": {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "number"}}}}}}
    got = statuses(spark, {"n": "7", "rows": '[{"q": "1,000"}]'}, {"n": "7", "rows": '[{"q": 1000}]'}, schema=schema)
    assert got["n"] == ("validation_failed", "none") and got["rows"] == ("validation_failed", "none")
    assert statuses(spark, {"rows": '[{"q": 1000.0}]'}, {"rows": '[{"q": 1000}]'}, schema=schema)["rows"] == ("correct", "exact")


def test_tolerance_and_edit_distance(spark):
    schema = {"type": "object", "properties": {"t": {"type": "number"}, "s": {"type": "string"}}}
    gold = {"t": "10.00", "s": '"kitten"'}
    assert statuses(spark, {"t": "10.01", "s": '"kittens"'}, gold, schema=schema) == {"t": ("incorrect", "none"), "s": ("incorrect", "none")}
    assert statuses(spark, {"t": "10.01", "s": '"kittens"'}, gold, ScoringConfig("0.01", 1), schema) == {"t": ("correct", "numeric_tolerance"), "s": ("correct", "edit_distance")}


def test_required_and_outside_fields(spark):
    got = statuses(spark, {"note": '"n"'}, {"document_name": '"A"'}, ScoringConfig(required_fields=("effective_date",), include_hallucinations=True))
    assert got == {"document_name": ("missing", "none"), "effective_date": ("missing", "none"), "note": ("incorrect", "none")}


@pytest.mark.parametrize("raw,want", [("5/8/14", "2014-05-08"), ("1/1/98", "1998-01-01"), ("2020/2/3", "2020-02-03"), ("jan 3, 2026", "2026-01-03"),
                                      ("February 3, 2020", "2020-02-03"), ("2/30/2020", None), ("20205-1-1", None), ("1/2/200", None)])
def test_dates(spark, raw, want):
    assert one(spark, T.parse_date(F.lit(raw))) == want


@pytest.mark.parametrize("field,raw,impossible,n,want", [
    ("renewal_term", "", True, 0, (True, "null")), ("renewal_term", "", False, 1, (False, None)), ("termination_for_convenience", "No", True, 0, (True, "false")),
    ("effective_date", "5/8/14", False, 1, (True, '"2014-05-08"')), ("effective_date", "[]/[]/2020", False, 1, (False, None)),
    ("effective_date", "5/8/14; 5/9/14", False, 1, (False, None)), ("expiration_date", "Perpetual", False, 1, (True, '"perpetual"')),
    ("expiration_date", "upon approval", False, 1, (False, None))])
def test_answers(spark, field, raw, impossible, n, want):
    r = one(spark, T.normalize_answer(F.lit(field), F.lit(raw), F.lit(impossible), F.lit(n)))
    assert (r["included"], r["value_json"]) == want


def test_explicit_dates_and_notice_periods(spark):
    spans = lambda *s: F.array(*[F.lit(x) for x in s])
    assert one(spark, T.explicit_date(F.lit("1/1/2027"), spans("one year after signing"))) is None
    assert one(spark, T.explicit_date(F.lit("1/1/2027"), spans("January 1, 2027"))) == "2027-01-01"
    period = lambda raw, s: one(spark, T.notice_period(F.lit(raw), spans(s)))
    assert tuple(period("30 days", "prior notice")) == ("30", "unclear")
    assert tuple(period("10 days", "ten business days")) == ("10", "business days")
    assert period("60 / 180 days", "x") is None and period("5 days", "within 5 days of") is None


def test_currency_text_and_canonical_json(spark):
    assert [one(spark, T.normal_currency(F.lit(c))) for c in ("us$", "€", "gbp", "1 $", "none")] == ["USD", "EUR", "GBP", "USD", "none"]
    assert one(spark, T.normal_text(F.lit("  Straße \n ONE "))) == "strasse one"
    assert [one(spark, J.canonical(F.lit(v))) for v in ("1e3", "1000.0", "0", "false", '"0"', '{"b": 1.0, "a": [2]}')] == ["1000", "1000", "0", "false", '"0"', '{"a":[2],"b":1}']


def test_confidence_bounds(spark):
    got = [one(spark, T.valid_confidence(F.lit(c))) for c in (0.0, 1.0, -1.0, 1.1, float("nan"), float("inf"))]
    assert got == [0.0, 1.0, None, None, None, None]


def test_table_vote_needs_a_key(spark):
    schema = {"type": "object", "properties": {"rows": {"type": "array"}}}
    a, b = '[{"sku":"a","n":1},{"sku":"b","n":2}]', '[{"sku":"b","n":2},{"sku":"a","n":1}]'
    c = spark.createDataFrame([("d", i, "rows", v, 0.6) for i, v in enumerate((a, b, "[]"))], "document_id string, branch int, field_path string, value_json string, confidence double")
    docs, leaves = c.select("document_id").distinct(), schema_leaves(spark, schema)
    won = V.majority_vote(c, leaves, docs, 3, row_keys={"rows": "sku"}).first()
    assert (won.value_json, won.confidence, won.votes) == (a, 0.6, 2)
    assert V.majority_vote(c, leaves, docs, 3).first().value_json is None


def test_tolerance_votes_form_no_chains(spark):
    schema = {"type": "object", "properties": {"t": {"type": "number"}}}
    c = spark.createDataFrame([("d", i, "t", v, None) for i, v in enumerate(("1.00", "1.01", "1.02"))], "document_id string, branch int, field_path string, value_json string, confidence double")
    r = V.majority_vote(c, schema_leaves(spark, schema), c.select("document_id").distinct(), 3, tolerance="0.01").first()
    assert (r.value_json, r.votes) == ("1.00", 2)


def test_interval_union_spans_buckets(spark):
    s = spark.createDataFrame([("d", t, n, "x", "completed") for t, n in ((1000, 2000), (2000, 2000), (3600000, 1000))], "document_id string, start_ms long, latency_ms long, kind string, status string")
    for bucket in (500, 1500, 10_000_000):
        assert K.interval_union_latency(s, ["document_id"], bucket_ms=bucket).first().latency_ms == 4000


def test_costs(spark):
    u = spark.createDataFrame([("a", "openai", "gpt-4.1-mini-2025-04-14", 561316, 45737), ("b", "openai", "gpt-unknown", 1, 1), ("c", "local", "rules", 9, 9)],
                              "k string, provider string, model string, input_tokens long, output_tokens long")
    got = {r.k: r.estimated_usd for r in P.estimate_cost(u, P.price_table(spark), ["k"]).collect()}
    assert got == {"a": pytest.approx(0.2977056), "b": None, "c": 0.0}


def test_invoice_rules(spark):
    text = "ACME INDUSTRIES INVOICE\nInvoice # INV-1042\nIssued: 2026-01-03\nVendor: ACME INDUSTRIES\nWidget 2 $1,000.00\nTotal due: $1,204.19\nSubtotal 1 $1.00"
    got = {r.field_path: r.value_json for r in X.rule_extract(spark.createDataFrame([("d", text)], "document_id string, text string")).collect()}
    assert got["invoice_number"] == '"INV-1042"' and got["total"] == "1204.19" and got["vendor.name"] == '"ACME INDUSTRIES"' and got["currency"] == '"USD"'
    assert json.loads(got["line_items"]) == [{"amount": 1000, "description": "Widget", "quantity": 2}]


def test_malformed_regions_are_dropped(spark):
    good = {"page": 1, "bbox": [0.1, 0.1, 0.2, 0.2], "text": "t"}
    bad = [{**good, "page": p} for p in ("1", True, 0, 9)] + [{**good, "bbox": b} for b in ([0, 0, 1], [0, 0, 1, 1, 1], [-1, 0, 1, 1], [0, 0, 2, 1], [1, 0, 0, 1], [0, 1, 1, 1], "x")] + [{**good, "text": 5}]
    out = lambda ev, v="1": one(spark, L.valid_evidence(F.lit(json.dumps(ev)), F.lit(v), F.lit(3)))
    assert out(bad) == [] and len(out([good, good])) == 1 and out([good], "null") == []


def test_inferred_tables_follow_order(spark):
    items = [("d", 1, 0, False, "head", [0.1, 0.05, 0.9, 0.1]), ("d", 1, 1, True, "|a|b|\n|-|-|\n|1|2|", [0.1, 0.2, 0.2, 0.21]), ("d", 1, 2, True, "|a|\n|1|", None)]
    df = spark.createDataFrame(items, "document_id string, page int, source_index int, is_table boolean, text string, bbox array<double>")
    boxes = {r.source_index: r.bbox for r in L.infer_table_boxes(df).collect()}
    assert boxes[1][1] == 0.2 and boxes[2][1] >= boxes[1][3] and all(b[0] == 0.035 and b[3] > b[1] for b in boxes.values())


def test_html_lines_skip_hidden_content(spark):
    html = "<html><style>a{}</style><body><p>One  two</p><script>x()</script><div>three</div></body></html>"
    got = L.html_block_table(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id", "html").collect()
    assert [(r.line_no, r.text) for r in got] == [(0, "One two"), (1, "three")]


def test_shingles_match_brute_force_at_every_offset(spark):
    import random
    rng = random.Random(7)
    source = "".join(rng.choice("abcdefgh \n") for _ in range(400))
    texts = [(i, "".join(rng.choice("xyz") for _ in range(i)) + source[o:o + n] + "q" * (i % 90)) for i, (o, n) in enumerate([(40, 100), (41, 100), (80, 99), (0, 139), (120, 160), (13, 130)] * 30)]
    brute = {i for i, t in texts if any(source[o:o + 100] in t for o in range(0, 301, 40))}
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id for r in D.contamination_shingles(df, spark.createDataFrame([(source,)], "text string"), id_column="doc_id").collect()}
    assert got == brute and 0 < len(brute) < len(texts)
    answers = [source[5:17], source[30:80], "never seen here"]
    brute = {i for i, t in texts if any(a in t for a in answers)}
    assert {r.doc_id for r in D.long_answers(df, spark.createDataFrame([(a,) for a in answers], "answer string"), "doc_id").collect()} == brute


def test_splits_cover_everything_and_ignore_order(spark):
    m = spark.range(137).select(F.concat(F.lit("d"), "id").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") % 3).cast("string").alias("kind"))
    a = B.stratified_split(m, {"a": 0.5, "b": 0.3, "c": 0.2}, "s", "kind")
    b = B.stratified_split(m.repartition(7).orderBy(F.desc("sha256")), {"a": 0.5, "b": 0.3, "c": 0.2}, "s", "kind")
    assert a.count() == 137 and set(map(tuple, a.collect())) == set(map(tuple, b.collect()))
    assert B.hash_sample(m, 20, "s").count() == 20


def test_greedy_family_holdout_matches_plain_greedy(spark):
    import hashlib
    sizes = {f"f{i}": 1 + i * i % 7 for i in range(60)}
    df = spark.createDataFrame([(f, f"{f}-{n}") for f, s in sizes.items() for n in range(s)], "family string, document_id string")
    left, held = 23, set()
    for f in sorted(sizes, key=lambda f: hashlib.sha256(f'["k","{f}"]'.encode()).hexdigest()):
        if sizes[f] <= left:
            held.add(f)
            left -= sizes[f]
    assert left == 0
    got = {r.family for r in B.family_disjoint_holdout(df, 23, "k").where("split = 'test'").collect()}
    assert got == held


def test_comparing_a_run_with_itself_changes_nothing(spark):
    s = EvalFrame(fields(spark, GOLD), truth(spark, GOLD), schema_leaves(spark, CONTRACT)).score().fields
    assert C.compare_summary(C.compare_fields(s, s)).first().asDict() == {"improved": 0, "regressed": 0, "unchanged": 4, "new_failure": 0, "fixed_failure": 0}
