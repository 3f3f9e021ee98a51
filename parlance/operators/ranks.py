"""Ordinal ranks within groups of any size.

Rows are range-partitioned by group and order and numbered within their piece; the pieces of a group meet as one summary row each. So a
group with a third of all rows is spread over many tasks, where a window over the group would hold it in one.

Null groups are a group; ties need a last order column that tells rows apart; nulls come first; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import materialize


def ranked(df: DataFrame, group: list[str], order: list[str], to: str, size: str | None = None) -> DataFrame:
    """df with the rank from 1 of each row in its group, and with size the rows of the group (BIGINT)."""
    pieces = materialize(df.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id()), "ranks")
    numbered = pieces.withColumn("_no", F.row_number().over(Window.partitionBy(*group, "_piece").orderBy(*order)))
    counts = pieces.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # At most as many rows as there are pieces and groups.
    whole = Window.partitionBy(*group)
    counts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_piece").alias("_p"), (F.sum("_n").over(whole.orderBy("_piece")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_of"))
    on = F.col("_piece") == F.col("_p")
    for i, c in enumerate(group):
        on &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = numbered.join(counts, on).withColumn(to, (F.col("_no") + F.col("_before")).cast("bigint"))
    return out.select(*df.columns, to, *([F.col("_of").cast("bigint").alias(size)] if size else []))
