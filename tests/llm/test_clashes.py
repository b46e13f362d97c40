"""Columns that bear the operators' own names are carried; the language sample never shrinks to nothing."""
import pytest

import corpus_pipeline
from fieldgauge.llm import language_id, line_dedup, mixing, near_dedup
from fieldgauge.llm.store import table

SF = "/root/testdata/sf0.001"
OWN = ["size", "taken", "target", "source_size", "some_kept", "all_kept", "many", "_id", "_name", "_group", "_row", "_dropped", "_take", "take", "draw", "shard_size", "tape", "name", "group_name", "kept"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["one two three four five six seven\nline of its own", "one two three four five six seven\nline of its own", "another text with other words in it altogether\nline of its own", None, ""]
    data = [(k, t, "en", f"s{k % 2}", *range(len(OWN))) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s0", *range(len(OWN)))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in OWN))


@pytest.mark.parametrize("run", [mixing.mix_documents, lambda d: mixing.mix_documents(d, whole_texts=True), near_dedup.dedup, line_dedup.without_repeats])
def test_own_names_are_carried(rows, run):
    out = run(rows)
    assert out.columns == rows.columns
    got = out.collect()
    assert got and all([r[c] for c in OWN] == list(range(len(OWN))) for r in got)


def test_pipeline_carries_own_names(spark, rows):
    docs = table(spark, SF, "documents").crossJoin(rows.select(*OWN).limit(1))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert set(OWN) < set(docs.columns), name
    assert docs.select(*OWN).distinct().count() == 1


def test_language_share_is_never_nothing():
    assert language_id._share(256, 300_000_000) > 0 and language_id._share(256, 10 ** 15) == 1 and language_id._share(256, 10) == language_id.DRAWS
