"""Adjacent time windows, their snapshots and trends.

Windows are half-open, adjacent and anchored at a given end, oldest first; empty windows appear with zero counts. Rows without a
time are in no window.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def parse_period(text: str) -> timedelta:
    """7d, 4w, 1m (30 days) or 1y (365 days)."""
    m = re.fullmatch(r"\s*(\d+)([dwmy])\s*", text)
    if not m or not int(m[1]):
        raise ValueError(f"no period: {text!r}")
    return timedelta(days=int(m[1]) * _DAYS[m[2]])


def spine(spark: SparkSession, end: datetime, period: timedelta, n: int) -> DataFrame:
    """(no, window_start, window_end) of n windows before end."""
    rows = [(i, end - (n - i) * period, end - (n - i - 1) * period) for i in range(n)]
    return spark.createDataFrame(rows, "no bigint, window_start timestamp, window_end timestamp")


def window_no(at: Column, end: datetime, period: timedelta, n: int) -> Column:
    """The number of the window that holds an instant, or null: arithmetic, so no range join is needed."""
    seconds = int(period.total_seconds())
    start = F.lit(end - n * period).cast("timestamp")
    no = F.floor((F.unix_micros(at) - F.unix_micros(start)) / F.lit(seconds * 1_000_000)).cast("bigint")
    return F.when((no >= 0) & (no < n), no)


def snapshots(df: DataFrame, at: str, end: datetime, period: timedelta, n: int, aggregates: dict[str, Column]) -> DataFrame:
    """One row per window, empty ones included: no, window_start, n_rows and the aggregates."""
    per = df.withColumn("no", window_no(F.col(at), end, period, n)).filter(F.col("no").isNotNull()).groupBy("no").agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in aggregates.items()])
    return spine(df.sparkSession, end, period, n).join(per, "no", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))


def deltas(snaps: DataFrame, column: str) -> DataFrame:
    """snaps with the change of column from the window before, and in per cent of it (0 where that is empty)."""
    # One row per window: a single ordered partition of n rows.
    before = F.lag(column).over(Window.orderBy("no"))
    pct = F.when(F.coalesce(before, F.lit(0)) == 0, 0.0).otherwise((F.col(column) - before) * 100.0 / before)
    return snaps.withColumn("delta", F.coalesce(F.col(column) - before, F.lit(0))).withColumn("pct", F.coalesce(pct, F.lit(0.0)))


def entropy(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """(group, n_labels, entropy): Shannon entropy of the labels in bits, over its greatest possible value; 0 for one label."""
    counts = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(*group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"), F.sum(F.col("c") * F.log2("c")).alias("clog"))
    bits = F.log2("n") - F.col("clog") / F.col("n")
    return g.select(*group, "n_labels", F.when(F.col("n_labels") > 1, bits / F.log2("n_labels")).otherwise(0.0).alias("entropy"))
