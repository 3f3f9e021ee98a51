"""Invented session logs from a seed: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ["Fix the login timeout", "Add a test for the parser", "Explain the retry loop", "Refactor the cache", "Review the pull request"]
PLACES = ["src/auth.py", "src/cache.py", "lib/parser.ts", "tests/test_io.py"]


def sessions(spark: SparkSession, n: int, turns: int = 6, seed: int = 42) -> DataFrame:
    """(rec_id, session_id, type, timestamp, message) of n sessions of user and assistant turns; a tenth of the answers tell of an error, and tasks recur."""
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    d = spark.range(n * turns).withColumn("no", F.col("id") % turns)
    user = F.col("no") % 2 == 0
    fails = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("fails")), F.lit(10)) == 0
    said = F.when(user, F.concat(pick(TASKS, "task"), F.lit(" in "), pick(PLACES, "place"))).when(fails, F.lit("Error: the test failed")).otherwise(F.lit("Done."))
    role = F.when(user, "user").otherwise("assistant")
    at = F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 30), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.select(F.col("id").alias("rec_id"), F.format_string("demo-%06d", F.expr(f"id div {turns}")).alias("session_id"), role.alias("type"), at.alias("timestamp"), F.struct(role.alias("role"), said.alias("content")).alias("message"))
