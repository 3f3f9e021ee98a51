"""Incremental ingestion: micro-batches appended to a store once per hash, and a queue that is sent at least once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.operators.stores import insert_if_absent


def append_new(stream: DataFrame, store: str, key: str, order: list[str | Column], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's rows whose key the Parquet store lacks. A batch that is run again adds nothing new.

    The store must exist (it may be empty): write its schema first.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        insert_if_absent(spark.read.parquet(store), batch, key, order).write.mode("append").parquet(store)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def send_queue(stream: DataFrame, send: Callable[[DataFrame], None], checkpoint: str, allowed: bool) -> StreamingQuery | None:
    """Hands micro-batches to send and acknowledges them after it returned (at least once). Nothing is sent unless it is allowed."""
    if not allowed:
        return None
    return stream.writeStream.foreachBatch(lambda b, _: send(b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_days(df: DataFrame, at: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows of the last days; rows without a time are kept."""
    limit = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(at).isNull() | (F.col(at) >= limit))
