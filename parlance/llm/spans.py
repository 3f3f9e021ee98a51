"""Long exact spans shared between records (problem 10).

Words are cut into chunks by a gear rolling hash whose value depends on the last GEAR words only; a word is a cut where its hash is
the least (the last of equal ones) of a window of WINDOW neighbouring ones, so that insertions shift no cut but the nearest. A
chunk goes from a cut to the next one, with the words that placed its first cut. Chunks are deduplicated by digest: one row per
chunk, grouped, and those of two records or more are kept. Every run of `span` words has one chunk that its own words fix, the one
that begins at the least word of its first window (see `anchors`), so a run can be shared only if that chunk is; such runs alone
are hashed, grouped and, where two records hold them, marked.

Cut rule: with GEAR + 3 * WINDOW <= span + 2 the chunk that begins in the first window of a run ends within the run.

Chunks of very many records are known beforehand by a bounded summary of frequent digests; they are marked as shared where they are
read and dealt at random, so no task gets all rows of one. Documents without a shared chunk are not read again.

Defined results: null, empty and blank texts and texts below `span` words give no rows; repeated rows (the same text under two ids)
share all their words; whole texts are read however long; extra columns are ignored; an empty table gives an empty table. Chunks and
runs are compared by 64-bit digests of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.hashing import U64, Prefixes, Vocabulary, counts_of, heavy, mix, window_starts, words_of
from parlance.session import materialize

SPAN, GEAR, WINDOW = 40, 8, 11
#: Each word shifts the gear hash by so many bits: 64 bits hold the last GEAR words.
_SHIFT = 64 // GEAR
#: Tasks that the rows of a frequent chunk are dealt to at random.
SALTS = 1 << 16


def least_in(rank: np.ndarray, size: int) -> np.ndarray:
    """Position of the last least value of rank[i : i + size] for every i; windows that reach over the end are cut short."""
    at, have = np.arange(len(rank)), 1
    while have < size and len(rank) > have:
        step = min(have, size - have)
        left, right = at[:-step], at[step:]
        at = np.concatenate([np.where(rank[right] <= rank[left], right, left), at[-step:]])
        have += step
    return at


def anchors(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word, the position of the least of the WINDOW hashes from it on; -1 where the window is not whole within its text.

    These positions are the cuts. A window begins GEAR - 1 words behind the start of a text, where hashes have all their words.
    """
    n = len(codes)
    out = np.full(n, -1, dtype=np.int64)
    if not n:
        return out
    gear = np.zeros(n, dtype=U64)
    table = mix(codes)
    for j in range(GEAR):
        gear[j:] += table[: n - j] << U64(_SHIFT * j)
    doc, start = window_starts(np.maximum(lengths - (GEAR - 1), 0), WINDOW)
    first = np.cumsum(lengths) - lengths
    rest = np.maximum(lengths - (GEAR - 1), 0)
    # Window starts count words that have a hash; here they count all words.
    start = start - (np.cumsum(rest) - rest)[doc] + first[doc] + GEAR - 1
    out[start] = least_in(mix(gear), WINDOW)[start]
    return out


def chunks(codes: np.ndarray, lengths: np.ndarray, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first cut, digest) of every chunk between two cuts of one text."""
    at = anchors(codes, lengths)
    at = np.unique(at[at >= 0])
    doc = np.searchsorted(np.cumsum(lengths), at, side="right")
    same = doc[1:] == doc[:-1]
    a, b, doc = at[:-1][same], at[1:][same], doc[1:][same]
    return doc, a, prefixes.runs(a - (GEAR - 1), b + 1)


def _read(batch: pa.RecordBatch, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    return words_of((t or "" for t in batch.column("text").to_pylist()), str.split, vocabulary)


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(doc, cuts): the records (doc, text) that hold chunks of other records too, and where those chunks begin."""
    vocabulary = Vocabulary()

    def digests(b: pa.RecordBatch) -> np.ndarray:
        codes, lengths = _read(b, vocabulary)
        doc, _, digest = chunks(codes, lengths, Prefixes(codes))
        order = np.lexsort((digest, doc))
        doc, digest = doc[order], digest[order]
        # A chunk counts once a record: a frequent one is in two records at least.
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
        return digest[new]

    frequent = docs.sparkSession.sparkContext.broadcast(heavy(docs.select("text"), digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = _read(b, vocabulary)
            doc, a, digest = chunks(codes, lengths, Prefixes(codes))
            known = counts_of(frequent.value, digest) > 1
            first = np.cumsum(lengths) - lengths
            salt = np.where(known, (mix(digest + doc.astype(U64)) % U64(SALTS)).astype(np.int64) + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(salt.astype(np.int32)), b.column("doc").take(pa.array(doc)), pa.array((a - first[doc]).astype(np.int32))], names=["digest", "salt", "doc", "cut"])

    rows = docs.mapInArrow(run, f"digest bigint, salt int, doc {docs.schema['doc'].dataType.simpleString()}, cut int")
    w = Window.partitionBy("digest", "salt")
    found = rows.withColumn("shared", (F.col("salt") > 0) | (F.min("doc").over(w) != F.max("doc").over(w))).filter("shared")
    return found.groupBy("doc").agg(F.collect_list("cut").alias("cuts"))


def shared_windows(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(digest, doc, at): the runs of span words that may stand in another record, by record and start."""
    if GEAR + 3 * WINDOW > span + 2:
        raise ValueError(f"span must be at least {GEAR + 3 * WINDOW - 2} words")
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = materialize(shared_chunks(docs), "chunks")
    vocabulary = Vocabulary()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = _read(batch, vocabulary)
            first = np.cumsum(lengths) - lengths
            cuts = batch.column("cuts")
            marked = np.zeros(len(codes) + 1, dtype=bool)
            marked[cuts.flatten().to_numpy() + np.repeat(first, cuts.value_lengths().to_numpy())] = True
            doc, start = window_starts(lengths, span)
            passing = marked[anchors(codes, lengths)[start + GEAR - 1]] if len(start) else np.zeros(0, dtype=bool)
            doc, start = doc[passing], start[passing]
            yield pa.RecordBatch.from_arrays([pa.array(Prefixes(codes).runs(start, start + span).view(np.int64)), batch.column("doc").take(pa.array(doc)), pa.array((start - first[doc]).astype(np.int32))], names=["digest", "doc", "at"])

    return docs.join(found, "doc").select("doc", "text", "cuts").mapInArrow(windows, f"digest bigint, doc {docs.schema['doc'].dataType.simpleString()}, at int")


def shared_words(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(key, shared_words): records with words in shared spans, and how many words those are."""
    found = materialize(shared_windows(docs, key, text, span), "windows")
    # Least and greatest record of a digest are pre-aggregated in each task, so a passage of many records costs no more.
    both = found.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter(F.col("lo") != F.col("hi")).select("digest")
    starts = found.join(both, "digest", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # Windows of one record overlap: each adds the words from its start to the next one's, span at most.
    step = F.aggregate(
        F.zip_with("at", F.slice(F.concat("at", F.array(F.lit(2**31 - 1))), F.lit(2), F.size("at")), lambda x, y: F.least(y - x, F.lit(span))),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )
    return starts.select(F.col("doc").alias(key), step.alias("shared_words"))
