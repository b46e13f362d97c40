"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded selection.

Every source is cut into shards by a seeded hash, so a source of any size is spread over many tasks. A shard's documents,
in seeded order and repeated ``max_repeats`` times, form a tape of tokens. Tokens are dealt in blocks of ``block_tokens``:
the blocks of the whole mix go to the sources by the highest quotients target / (2 n + 1), and a source's blocks go to its
shards in the same way. A shard then takes its first so many blocks of its tape, which is a seeded choice because the order is.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, sorted last; a null doc_id
takes part like any other; equal rows are separate documents whose takes may differ; an empty table gives an empty result;
further input columns are left alone (``mix_documents``) or not read (``mixture``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import SPACE, word_count, written


def _seats(rows: DataFrame, by: list[str], share: str, blocks: str, total: str, order: list) -> DataFrame:
    """Add ``seats``: ``blocks`` dealt over the rows of each group by the highest quotients share / (2 n + 1).

    With k rows in a group and the divisor total / (blocks - k/2), rounding deals at most ``blocks``; with the divisor
    total / (blocks + k/2), at least ``blocks``. Only the seats between the two are ranked: at most about 2k rows.
    """
    k = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rounded = lambda edge: F.greatest(F.lit(0.0), F.floor(F.col(share) * edge / F.col(total) + 0.5)).cast("long")
    rows = rows.withColumn("_k", k.cast("double")).withColumn("_lo", F.when(F.col(total) > 0, rounded(F.col(blocks) - F.col("_k") / 2)).otherwise(F.lit(0)))
    rows = rows.withColumn("_hi", F.when(F.col(total) > 0, F.greatest(F.col("_lo"), rounded(F.col(blocks) + F.col("_k") / 2))).otherwise(F.lit(0)))
    rows = rows.withColumn("_open", F.col(blocks) - F.sum("_lo").over(Window.partitionBy(*by)))
    seat = rows.withColumn("_n", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo"), F.col("_hi") - 1))))
    quotient = F.when(F.col("_n").isNotNull(), F.col(share) / (2 * F.col("_n") + 1))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc_nulls_last(), *order))
    seat = seat.withColumn("_won", (F.col("_n").isNotNull() & (rank <= F.col("_open"))).cast("long"))
    names = [c for c in rows.columns if not c.startswith("_")]
    return (seat.groupBy(*names, "_lo").agg(F.sum("_won").alias("_more"))
            .select(*names, (F.col("_lo") + F.col("_more")).alias("seats")))


def source_targets(sizes: DataFrame, weights: Column | None = None, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> also weight, target, full. Targets sum to the total; none is above ``max_repeats`` sizes.

    Sources are ordered by size per weight; the first ones are full (target = ``max_repeats`` sizes) as long as their
    share of what is left would exceed that. One row per source: the window over them is one small task.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = weights if weights is not None else ((F.row_number().over(order) - 1) % 3 + 1)
    rows = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    everything = Window.partitionBy(F.lit(0))
    ratio = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(max_repeats) * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_rate", left / weight_left).withColumn("_full", cap <= F.col("weight") * F.col("_rate"))
    # the rate of the first source that is not full holds for all that follow
    rows = rows.withColumn("_pos", F.when(~F.col("_full"), F.row_number().over(ratio)))
    rows = rows.withColumn("_at", F.min(F.when(~F.col("_full"), F.struct("_pos", "_rate"))).over(everything)["_rate"])
    return rows.select("source", "source_size", "weight", F.when(F.col("_full"), cap.cast("double")).otherwise(F.col("weight") * F.col("_at")).alias("target"),
                       F.col("_full").alias("full"))


def mixture(docs: DataFrame, seed: str = "mix-1", block_tokens: int = 16, shard_tokens: int = 16384, max_shards: int = 1024,
            max_repeats: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, and the columns named in ``keep``, each behind ``in_``."""
    keep = keep or []
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], "doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text")))).alias("draw"))
    if not keep:
        rows = written(rows, "mix-rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats=max_repeats)
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("blocks", F.floor(F.col("total") / block_tokens + 0.5).cast("long"))
    sources = sources.withColumn("zero", F.lit(0))
    sources = _seats(sources, ["zero"], "target", "blocks", "total", [F.col("source").asc_nulls_last()])
    sources = sources.withColumn("shards", F.least(F.lit(max_shards), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_tokens)).cast("long"))
    sources = sources.select("source", "source_size", "target", "full", "shards", F.col("seats").alias("source_blocks"))
    # one row per source; the join is on an equal (null-safe) key and Spark broadcasts it only if it is small
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", F.conv(F.substring("draw", 1, 7), 16, 10).cast("long") % F.col("shards"))
    shards = rows.groupBy("source", "shard", "source_size", "source_blocks", "full").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("in_source", F.col("source_size").cast("double"))
    shards = _seats(shards, ["source"], "shard_size", "source_blocks", "in_source", [F.col("shard")])
    most = F.lit(max_repeats) * F.col("shard_size")
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size",
                           F.when(F.col("full"), most).otherwise(F.least(most, F.col("seats") * block_tokens)).alias("tape"))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    within = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(within)).withColumn("_start", F.col("_end") - F.col("size"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("tape") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("tape") - rounds * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - F.col("_start"))
    return rows.select(*[f"in_{c}" for c in keep], "doc_id", "source", "size", "source_size", "target",
                       (rounds * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, whole_texts: bool = False, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a document comes once per full take, and once more, cut to its
    leading words, where a block ends inside it. ``n_chars``, if there, follows the cut text. With ``whole_texts`` no text is cut:
    the one document in which a shard's tape ends comes once more if half of it or more is taken, so a shard's words differ by half of that at most."""
    columns = docs.columns
    mixed = mixture(docs, keep=columns, **options).where(F.col("taken") > 0)
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    cut = F.col("taken") - whole * F.col("size")
    if whole_texts:
        whole, cut = whole + (2 * cut >= F.col("size")).cast("long"), F.lit(0).cast("long")
    takes = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    mixed = mixed.select(*[f"in_{c}" for c in columns], F.explode(takes).alias("take"))
    given = F.col("in_text")
    words = F.split(given, rf"(?<=[{SPACE}])(?=[^{SPACE}])")
    # text before the first word is a piece of its own
    lead = given.rlike(rf"^[{SPACE}]").cast("int")
    mixed = mixed.withColumn("in_text", F.when(F.col("take") == 0, given).otherwise(F.array_join(F.slice(words, 1, F.col("take").cast("int") + lead), "")))
    if "n_chars" in columns:
        mixed = mixed.withColumn("in_n_chars", F.when(F.col("take") == 0, F.col("in_n_chars")).otherwise(F.length("in_text").cast(docs.schema["n_chars"].dataType)))
    return mixed.select(*[F.col(f"in_{c}").alias(c) for c in columns])


MIX_SQL = """
WITH r AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    md5('mix-1' || coalesce('|' || doc_id::VARCHAR, '') || coalesce('|' || md5(text), '')) AS draw FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
    FROM s1 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
s3 AS (SELECT *, 3 * source_size <= weight * rate AS filled FROM s2),
s4 AS (SELECT *, (SELECT rate FROM s3 WHERE NOT filled ORDER BY pos LIMIT 1) AS at_rate, (SELECT sum(source_size)::DOUBLE FROM s3) AS total, (SELECT count(*)::DOUBLE FROM s3) AS k FROM s3),
s5 AS (SELECT *, CASE WHEN filled THEN (3 * source_size)::DOUBLE ELSE weight * at_rate END AS target, floor(total / 16 + 0.5)::BIGINT AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN total > 0 THEN greatest(0, floor(target * (blocks - k / 2) / total + 0.5)) ELSE 0 END::BIGINT AS lo,
    CASE WHEN total > 0 THEN greatest(0, floor(target * (blocks + k / 2) / total + 0.5)) ELSE 0 END::BIGINT AS hi FROM s5),
c1 AS (SELECT source, target, unnest(range(lo, hi)) AS n FROM s6),
c2 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * n + 1) DESC, source NULLS LAST) AS place FROM c1),
s7 AS (SELECT s6.source, s6.source_size, s6.target, s6.filled, s6.lo + (SELECT count(*) FROM c2 WHERE c2.source IS NOT DISTINCT FROM s6.source
    AND c2.place <= s6.blocks - (SELECT sum(lo) FROM s6)) AS source_blocks, least(1024, ceil(greatest(s6.source_size, 1) / 16384.0))::BIGINT AS shards FROM s6),
d AS (SELECT r.*, s7.source_size, s7.target, s7.filled, s7.source_blocks, ('0x' || substr(draw, 1, 7))::BIGINT % s7.shards AS shard
    FROM r JOIN s7 ON r.source IS NOT DISTINCT FROM s7.source),
h0 AS (SELECT source, shard, source_size, source_blocks, filled, sum(size)::BIGINT AS shard_size FROM d GROUP BY ALL),
h1 AS (SELECT *, count(*) OVER (PARTITION BY source)::DOUBLE AS k FROM h0),
h2 AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0, floor(shard_size * (source_blocks - k / 2) / source_size::DOUBLE + 0.5)) ELSE 0 END::BIGINT AS lo,
    CASE WHEN source_size > 0 THEN greatest(0, floor(shard_size * (source_blocks + k / 2) / source_size::DOUBLE + 0.5)) ELSE 0 END::BIGINT AS hi FROM h1),
h3 AS (SELECT *, source_blocks - sum(lo) OVER (PARTITION BY source) AS opened FROM h2),
e1 AS (SELECT source, shard, shard_size, opened, unnest(range(lo, hi)) AS n FROM h3),
e2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * n + 1)::DOUBLE DESC, shard) AS place FROM e1),
e3 AS (SELECT source, shard, count(*) AS more FROM e2 WHERE place <= opened GROUP BY ALL),
h4 AS (SELECT h3.source, h3.shard, h3.shard_size, CASE WHEN filled THEN 3 * h3.shard_size
    ELSE least(3 * h3.shard_size, (h3.lo + coalesce(e3.more, 0)) * 16) END AS tape
    FROM h3 LEFT JOIN e3 ON h3.source IS NOT DISTINCT FROM e3.source AND h3.shard = e3.shard),
f AS (SELECT d.*, h4.shard_size, h4.tape, sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
    FROM d JOIN h4 ON d.source IS NOT DISTINCT FROM h4.source AND d.shard = h4.shard),
g AS (SELECT *, CASE WHEN shard_size > 0 THEN tape // shard_size ELSE 0 END AS rounds FROM f)
SELECT doc_id, source, size, source_size, target, (rounds * size + greatest(0, least(e, tape - rounds * shard_size) - (e - size)))::BIGINT AS taken FROM g
"""
