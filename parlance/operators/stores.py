"""Tables of accepted rows: insert if absent, upsert, delete by age, ledgers.

Stores are DataFrames; writing them is left to the caller or to `write_replacing`. Null keys are rows of their own: they neither
match nor are matched (insert keeps them; upsert appends them). Empty tables on either side are fine. Extra columns that only
one side has are filled with null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order. Window group limits drop other rows before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The rows to append: the first of each key that the store lacks, and all rows without a key."""
    named = first_per_key(rows.filter(F.col(key).isNotNull()), [key], order)
    return named.join(store.select(key).distinct(), key, "left_anti").unionByName(rows.filter(F.col(key).isNull()))


def upsert(store: DataFrame, rows: DataFrame, key: list[str], order: list[str | Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """The store after the rows, the last of each key in order, replaced those of the same key; columns in keep stay as they were."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = Window.partitionBy(*key)
    new = rows.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.max("_n").over(last)).filter("_n = _m").drop("_n", "_m")
    for c in keep:
        old = store.select(*key, F.col(c).alias(f"_{c}"))
        new = new.join(old, key, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return store.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def purge(store: DataFrame, key: str, refers: str, at: str, before: Column) -> DataFrame:
    """The store without rows older than `before`; references to them become null. Rows without a time stay."""
    old = F.coalesce(F.col(at) < before, F.lit(False))
    gone = store.filter(old).select(F.col(key).alias("_gone")).distinct()
    kept = store.filter(~old)
    return kept.join(gone, kept[refers] == F.col("_gone"), "left").withColumn(refers, F.when(F.col("_gone").isNull(), F.col(refers))).drop("_gone")


def unprocessed(files: DataFrame, ledger: DataFrame, path: str) -> DataFrame:
    """The files that the ledger does not list."""
    return files.join(ledger.select(path).distinct(), path, "left_anti")


def write_replacing(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrites only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def update(store: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The store with columns set from rows of the same key where the row's value is not null; rows without a match add nothing.

    Several rows of one key must agree: the greatest value counts.
    """
    new = rows.groupBy(*key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    d = store.join(new, key, "left")
    return d.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in store.columns])


def truncate(spark, path: str) -> int:
    """Empties the Parquet table at path and gives the number of rows it had."""
    old = spark.read.parquet(path)
    n, schema = old.count(), old.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def settings(store: DataFrame, values: dict[str, str]) -> DataFrame:
    """The store of settings (key, value) with values replaced or added; a handful of rows."""
    new = store.sparkSession.createDataFrame(list(values.items()) or [("", "")], "key string, value string").filter(F.col("key") != "")
    return store.join(new, "key", "left_anti").unionByName(new)


def by_prefix(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals the value; if there are none, those that it begins with."""
    near = df.filter(F.col(column).startswith(value))
    exact = near.filter(F.col(column) == value).select(F.lit(True).alias("_exact")).limit(1)
    # One row at most: a join with it is no product.
    return near.join(F.broadcast(exact), F.lit(True), "left").filter(F.col("_exact").isNull() | (F.col(column) == value)).drop("_exact")
