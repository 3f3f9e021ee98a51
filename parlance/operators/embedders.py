"""Embedders by name: functions from texts to vectors, run in Arrow batches or as Spark ML stages; register others in EMBEDDERS.

Every embedder gives (key, vector) of each row of df; null and blank texts have the zero vector, whose cosine with any is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize

#: Buckets of the hashed terms.
BUCKETS = 512


def hashed_tfidf(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """TF-IDF over terms of two word characters or more, hashed into buckets, of length one."""
    from parlance.operators import tfidf

    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: w != "")
    counts = df.select(key, F.explode(F.transform(terms, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))
    w = tfidf.weights(counts, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return df.select(key).join(w, key, "left").select(key, vector.alias("vector"))


def batched(encode: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> Callable[..., DataFrame]:
    """An embedder from a function of a list of texts, such as a local model's; it must be the same for equal texts."""

    def embed(df: DataFrame, key: str, text: str) -> DataFrame:
        rows = df.select(key, F.coalesce(text, F.lit("")).alias("_text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("_text").to_pylist()
                found = iter(encode([t for t in texts if t.strip()]))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([[float(x) for x in next(found)] if t.strip() else [] for t in texts], pa.list_(pa.float64()))], names=[key, "vector"])

        made = materialize(rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>"), "embedded")
        size = made.agg(F.max(F.size("vector"))).first()[0] or 0
        return made.withColumn("vector", F.when(F.size("vector") == 0, F.array_repeat(F.lit(0.0), size)).otherwise(F.col("vector")))

    return embed


EMBEDDERS: dict[str, Callable[..., DataFrame]] = {"tfidf": hashed_tfidf}


def embed(df: DataFrame, key: str, text: str, name: str = "tfidf") -> DataFrame:
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](df, key, text)
