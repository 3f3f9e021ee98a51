"""A sink for text files with names of one's own, one writer per file, written as a stream of lines.

Rows go to their file in order of `order`; a file is held by one task, a line at a time, however long it is. Null lines are left out.
A task that is run again writes its files again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, line: str, order: list[str]) -> DataFrame:
    """Writes the lines of each path (a URI whose folder need not exist); (path, n): the files and their lines, as they are written."""
    rows = df.select(F.col(path).alias("path"), F.col(line).alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).filter("line IS NOT NULL")
    rows = rows.repartition("path").sortWithinPartitions("path", *[f"_o{i}" for i in range(len(order))]).select("path", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, n, done = None, None, 0, []
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("line").to_pylist(), strict=True):
                if path != at:
                    if out is not None:
                        out.close()
                        done.append((at, n))
                    fs, place = pa.fs.FileSystem.from_uri(path)
                    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    at, out, n = path, fs.open_output_stream(place), 0
                out.write(text.encode("utf-8", "surrogatepass") + b"\n")
                n += 1
        if out is not None:
            out.close()
            done.append((at, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n"])

    return rows.mapInArrow(run, "path string, n bigint")


def array_lines(items: DataFrame, path: str, item: str, order: list[str], head: str = "[", tail: str = "]") -> DataFrame:
    """(path, part, _k, line): items (JSON texts) of each path as the lines of one JSON array between head and tail (expressions of path's rows)."""
    from pyspark.sql import Window

    w = Window.partitionBy(path).orderBy(*order)
    d = items.withColumn("_k", F.row_number().over(w).cast("bigint"))
    body = d.select(F.col(path).alias("path"), F.lit(1).alias("part"), "_k", F.concat(F.when(F.col("_k") > 1, ",").otherwise(""), F.col(item)).alias("line"))
    ends = d.groupBy(F.col(path).alias("path")).agg(F.min(F.expr(head) if head != "[" else F.lit("[")).alias("h"))
    first = ends.select("path", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("_k"), F.col("h").alias("line"))
    last = ends.select("path", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("_k"), F.lit(tail).alias("line"))
    return body.unionByName(first).unionByName(last)


def json_report(df: DataFrame, path: str) -> None:
    """The rows as JSON lines in a folder."""
    df.write.mode("overwrite").json(path)
