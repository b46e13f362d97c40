"""Sharding by histogram sort: exact counts of bytes below candidate keys, refined until the splitters are good enough.

A row's key is the hexadecimal text hash followed by the hexadecimal doc_id hash, so copies of a text lie together and a large
group of copies can still be divided. Round one counts bytes and rows of the 4,096 leading three-digit prefixes. Only prefixes
that hold a wanted boundary farther than the tolerance from an edge, or more rows than a slot range may have, are split again, by
two digits after the longest part that all their keys share. At most that many numbers reach the driver, at any input size.
Then rows move once, to the range (leaf) they belong to, where they are numbered; a leaf's offset makes slots gapless.

Defined results: a null text has no bytes (size 8, crc32 0); a null doc_id is a key like any other; rows equal in doc_id and text
have one key, stay in one leaf and get different slots; an empty table gives an empty result; further columns are carried along
by ``shard_documents``, whose own columns win where names clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

KEY_DIGITS = 32


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(digits(F.xxhash64(F.coalesce(text, F.lit("")))), digits(F.xxhash64(doc_id)))


def _leaf(key: Column, rounds: list[dict[str, int]]) -> Column:
    """The leaf's prefix: three digits, lengthened wherever a round has split that prefix."""
    at = F.substring(key, 1, 3)
    for longer in rounds:
        lengths = F.create_map(*[F.lit(x) for pair in sorted(longer.items()) for x in pair])
        at = F.coalesce(F.substring(key, F.lit(1), lengths[at]), at)
    return at


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, leaf_share: float = 1 / 2048) -> tuple[list[dict[str, int]], list[tuple]]:
    """``keys``: (key, size). Returns the rounds of splitting and the leaves in order: (prefix, shard, slot offset)."""
    grown, leaves = [], []
    counts = keys.groupBy(F.substring("key", 1, 3).alias("prefix")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    leaves = [tuple(r) for r in counts.collect()]
    total, many = sum(x[1] for x in leaves), sum(x[2] for x in leaves)
    goals = [total * i / shards for i in range(1, shards)]
    while True:
        leaves.sort()
        split, below, g = {}, 0, 0
        for prefix, size, rows, low, high in leaves:
            while g < len(goals) and goals[g] <= below:
                g += 1
            wanted = any(min(t - below, below + size - t) > tolerance * total / shards for t in goals[g:g + 2 + int(size * shards / max(total, 1))] if below < t < below + size)
            if low != high and (wanted or rows > max(64, many * leaf_share)):
                same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), KEY_DIGITS)
                split[prefix] = min(KEY_DIGITS, max(same, len(prefix)) + 2)
            below += size
        if not split:
            break
        before, grown = _leaf(F.col("key"), grown), [*grown, split]
        counts = (keys.where(before.isin(list(split))).groupBy(_leaf(F.col("key"), grown).alias("prefix"))
                  .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")))
        leaves = [x for x in leaves if x[0] not in split] + [tuple(r) for r in counts.collect()]
    placed, below, slots = [], 0, {}
    for prefix, size, rows, *_ in leaves:
        # a leaf goes where its middle lies; leaves come in key order, so shards are ranges
        shard = min(shards - 1, int((below + size / 2) * shards / max(total, 1)))
        placed.append((prefix, shard, slots.get(shard, 0)))
        slots[shard], below = slots.get(shard, 0) + rows, below + size
    return grown, placed


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """``docs`` with ``shard`` (sizes near equal, key ranges in order) and ``slot`` (gapless from 0 in each shard)."""
    carried = [c for c in docs.columns if c not in ("shard", "slot")]
    plain = docs.select(sort_key(F.col("text"), F.col("doc_id")).alias("key"), size_bytes(F.col("text")).alias("size"))
    rounds, leaves = splitters(written(plain, "shard-keys"), shards, tolerance)
    keyed = docs.select(*[F.col(c).alias(f"in_{c}") for c in carried], sort_key(F.col("text"), F.col("doc_id")).alias("key"))
    return _numbered(keyed, rounds, leaves).select(*[F.col(f"in_{c}").alias(c) for c in carried], "shard", "slot")


def _numbered(keyed: DataFrame, rounds, leaves) -> DataFrame:
    """Add shard and slot; leaves number some thousands at any input size, so the small side is broadcast."""
    places = keyed.sparkSession.createDataFrame(leaves, "leaf string, shard int, offset long")
    rows = keyed.withColumn("leaf", _leaf(F.col("key"), rounds)).join(F.broadcast(places), "leaf")
    number = F.row_number().over(Window.partitionBy("shard", "leaf").orderBy("key"))
    return rows.withColumn("slot", (F.col("offset") + number - 1).cast("long"))


def shard_sizes(docs: DataFrame, shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard. The texts themselves do not move."""
    slim = docs.select("doc_id", size_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                       sort_key(F.col("text"), F.col("doc_id")).alias("key"))
    slim = written(slim, "shard-keys")
    rounds, leaves = splitters(slim, shards, tolerance)
    return _numbered(slim, rounds, leaves).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
