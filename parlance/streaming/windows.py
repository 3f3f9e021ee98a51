"""Event-time windows that run on batches and streams alike: the same plan, with a watermark where df is a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, at: str, late: str) -> DataFrame:
    return df.withWatermark(at, late) if df.isStreaming else df


def session_windows(df: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start_us, end_us, n): sessions that a gap of silence ends. Rows without a time are in none; a null key is a key."""
    g = _late(df.filter(F.col(at).isNotNull()), at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def tumbling_counts(df: DataFrame, at: str, key: str, width: str, late: str = "1 hour") -> DataFrame:
    """(key, start_us, n, total): counts and sums of `value` in adjacent windows."""
    g = _late(df.filter(F.col(at).isNotNull()), at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.unix_micros("w.start").alias("start_us"), "n", "total")


def first_seen(df: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; in a stream, keys are forgotten once the watermark has passed them."""
    if df.isStreaming:
        return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])
