"""Work that must stay small: methods the JVM compiles, parallel landings, scores made once, extractors fed in slices."""
import re
from glob import glob

import pytest
from pyspark.sql import functions as F

from fieldgauge import session
from fieldgauge.operators import compare, extract
from fieldgauge.plans import QUERIES, q_scoring, q_sources
from fieldgauge.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fixed_plans(spark, tmp_path, monkeypatch):
    """Plans as first made, and intermediates under ``tmp_path``."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    yield tmp_path
    spark.conf.unset("spark.sql.adaptive.enabled")


def longest_method(spark, df):
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text))


def test_scoring_is_compiled(spark, fixed_plans):
    v = Views(spark, SF)
    scored = q_scoring.scored(v)
    assert 0 < longest_method(spark, scored) <= 8000
    cells = compare.paired_inner_guarded(scored, q_scoring.scored(v, 1), strict=True)
    assert 0 < longest_method(spark, compare.paired_compare(cells)) <= 8000


def test_votes_are_compiled(spark, fixed_plans):
    """Checks and comparison forms stand in projections, not inside a generator or a lambda function's arguments, where they are interpreted."""
    for name in ("majority_vote", "tolerance_vote", "table_vote"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        generators = [line for line in plan.split("\n") if "Generate " in line]
        assert generators and not any("regexp" in g or "concat_ws" in g for g in generators), name
        assert "filter(split(" not in plan and longest_method(spark, df) <= 8000, name


def test_predictions_land_in_parallel(spark, fixed_plans):
    assert QUERIES["incremental_scoring"](spark, SF).count() > 0
    assert len(glob(f"{fixed_plans}/fieldgauge/landing-*/part-*")) > 2


def test_report_scores_once(spark, fixed_plans, monkeypatch):
    given = []
    real = q_sources.R.run_report
    monkeypatch.setattr(q_sources.R, "run_report", lambda s, *rest: (given.append(s), real(s, *rest)))
    assert QUERIES["run_report"](spark, SF).count() > 0
    assert all("/scored-" in f for f in given[0].inputFiles())


def test_extractors_get_slices(spark):
    def sizes(batches):
        import pandas as pd
        for b in batches:
            n = int(b["text"].str.len().sum())
            yield pd.DataFrame({"document_id": b["document_id"], "field_path": "n", "value_json": str(n), "confidence": 1.0, "errors": [[] for _ in range(len(b))]})
    extract.register_extractor("sizes", sizes)
    docs = spark.range(12).coalesce(1).select(F.col("id").cast("string").alias("document_id"), F.repeat(F.lit("x"), 1_500_000).alias("text"))
    got = extract.run_extractor(docs, "sizes").collect()
    assert len(got) == 12 and max(int(r["value_json"]) for r in got) < extract.SLICE + 1_500_000


def test_merges_meet_in_one_grouping(spark, fixed_plans):
    """The current value joins its field's grouping; forms are made after it, and not inside the aggregation (F8)."""
    for name in ("joined_route_merge", "parallel_merge"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
        groupings = [line for line in plan if "Aggregate(" in line]
        assert groupings and not any("regexp" in g or "try_cast" in g for g in groupings), name
        assert not any("SortMergeJoin" in line for line in plan), name


def test_merges_of_odd_values(spark):
    said = {"a": ["1.0", "1", None], "b": ['"x"', '"y"', None], "c": ['"x"', '"y"', "null"], "d": ["[1]", "[1]", None], "e": ["[1]", None, None],
            "f": ['"a  b"', '"a b"', '"a b "'], "g": ['"\\u0041"', '"A"', None], "h": ["2", "2.00", "2"], "i": [None, None, None], "z": ["5", "5", None]}
    rows = [("o", b, p, v) for p, values in said.items() for b, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "document_id string, branch int, field_path string, value_json string")
    now = spark.createDataFrame([("o", "a", "1"), ("o", "b", None), ("o", "h", "2"), ("o", "i", "7"), ("o", "j", "8"), ("o", "z", "4")], "document_id string, field_path string, value_json string")
    from fieldgauge.operators import consensus
    changes = {r["field_path"]: (r["value_json"], r["error"] is not None) for r in consensus.merge_changes(cells, 3, now).collect()}
    assert changes == {"b": ("null", True), "c": ("null", False), "d": ("null", True), "e": ("[1]", False), "f": ('"a b "', False), "g": ('"A"', False), "z": ("5", False)}
    leaves = spark.createDataFrame([(p,) for p in "abcdefghij"], "field_path string")
    over = {r["field_path"]: r["value_json"] for r in consensus.joined_route_merge(cells, 3, now, leaves).collect()}
    assert over == {"a": "1", "b": "null", "c": "null", "d": "null", "e": "[1]", "f": '"a b "', "g": '"A"', "h": "2", "i": "7", "j": "8", "z": "4"}
