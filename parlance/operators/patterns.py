"""Many substrings sought in many texts at once, in place of a nested-loop join on containment.

The patterns are the bounded side (MAX_PATTERNS characters in all, checked): an Aho-Corasick automaton of them goes to every task,
and each text is read once, whatever the number of patterns. More patterns are worked off in blocks.

Null texts and null or empty patterns match nothing; repeated patterns count once; matching is case-sensitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 4_000_000


def contained(df: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(key, pattern): the distinct patterns that each text contains."""
    import ahocorasick

    rows = df.select(key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    blocks: list[list[str]] = [[]]
    held = 0
    for r in patterns.select(F.col(pattern).alias("p")).filter(F.length("p") > 0).distinct().orderBy("p").toLocalIterator():
        if held + len(r["p"]) > MAX_PATTERNS and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(r["p"])
        held += len(r["p"])
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {pattern} string"

    def search(block: list[str]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = ahocorasick.Automaton()
            for p in sent.value:
                a.add_word(p, p)
            a.make_automaton()
            for b in batches:
                at, found = [], []
                if sent.value:
                    for i, t in enumerate(b.column("_text").to_pylist()):
                        for p in sorted({p for _, p in a.iter(t)}):
                            at.append(i)
                            found.append(p)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, pattern])

        return rows.mapInArrow(run, schema)

    out = search(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(search(block))
    return out
