"""Exact ranking and prefix aggregates that never put a whole hot key into one task.

A caller supplies ``bucket``: a monotone function of the order key (hash prefix, day, value range).
Bucket totals are aggregated map-side, prefixed over the few bucket rows, and joined back; only one
bucket of one key is ever sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_bucket(hex_digest: Column, chars: int = 4) -> Column:
    """Order-preserving bucket of a uniform hexadecimal digest."""
    return F.substring(hex_digest, 1, chars)


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, n_before, n_total): rows of the key in earlier buckets and in all of them."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n_here"))
    w = Window.partitionBy(*keys).orderBy(bucket)
    return counts.select(
        *keys, bucket,
        F.coalesce(F.sum("n_here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
        F.sum("n_here").over(Window.partitionBy(*keys)).alias("n_total"))


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
           rank: str = "rank", total: str | None = None) -> DataFrame:
    """Exact 1-based position of every row inside its key, and optionally the key's row count."""
    with_bucket = df.withColumn("_bucket", bucket)
    keyed = with_bucket if keys else with_bucket.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    offsets = bucket_offsets(keyed, by, "_bucket")
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    out = (keyed.withColumn("_local", local)
           .join(offsets, [*by, "_bucket"])
           .withColumn(rank, (F.col("n_before") + F.col("_local")).cast("long")))
    if total:
        out = out.withColumn(total, F.col("n_total").cast("long"))
    return out.drop("_bucket", "_local", "n_before", "n_total", "_all")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The rank filter lets Spark cut to k rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key, by a map-side combined max_by (no window, no sort)."""
    rest = columns or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, name: str, width: float = 256) -> DataFrame:
    """Nearest-rank quantile (value at position ceil(q*n)) from counts of distinct values.

    Counts are first summed over ranges of ``width``; only the range that holds the position is put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_range", F.floor(F.col(value) / width))
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_here"))
    w = Window.partitionBy(*keys)
    ranges = ranges.withColumns({"_upto": F.sum("_here").over(w.orderBy("_range")), "_at": F.ceil(F.sum("_here").over(w) * F.lit(q) - F.lit(1e-9))})
    hit = ranges.where((F.col("_upto") >= F.col("_at")) & (F.col("_upto") - F.col("_here") < F.col("_at"))).withColumn("_before", F.col("_upto") - F.col("_here"))
    running = F.col("_before") + F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    return (counts.join(hit.select(*keys, "_range", "_before", "_at"), [*keys, "_range"]).withColumn("_c", running)
            .where(F.col("_c") >= F.col("_at")).groupBy(*keys).agg(F.min(value).alias(name)))
