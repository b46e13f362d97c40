"""Each stage takes what the one before kept; clean documents stay, planted ones go."""
import corpus_pipeline
from fieldgauge.llm import decontaminate, near_dedup, quality
from fieldgauge.llm.store import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = {r["doc_id"] for r in quality.judge(docs, table(spark, SF, "labels")).where("kept").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert all(labels.get(i) != 0 for i in kept)
    two = corpus_pipeline.STAGES[1][1](spark, one, SF).cache()
    verdicts = {r["doc_id"]: r["kept"] for r in near_dedup.near_duplicates(one, 80).collect()}
    assert {r["doc_id"] for r in two.collect()} == {i for i, k in verdicts.items() if k}
    three = corpus_pipeline.STAGES[2][1](spark, two, SF).cache()
    hit = {r["doc_id"] for r in decontaminate.find_leaks(two, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - hit and hit
    four = corpus_pipeline.STAGES[3][1](spark, three, SF).cache()
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {r["doc_id"] for r in three.collect()}
    five = corpus_pipeline.STAGES[4][1](spark, four, SF)
    assert five.count() == four.count() and set(five.columns) == {*docs.columns, "shard", "slot"}


def test_stages_on_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
