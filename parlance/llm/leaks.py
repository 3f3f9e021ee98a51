"""Evaluation passages in corpus documents, exact or with a budget of word edits (problem 9).

Every run of `passage` words of every item is a pattern. With a budget of e edits a pattern is split into e + 1 pieces, one of
which must stand unchanged in any match (pigeonhole): piece hits are found by hash, and the words around each hit are verified by
Myers' bit-parallel edit distance over words. With e = 0 the only piece is the pattern itself and the distance must be zero.

The items are the bounded side: their patterns are sent to every task after a check of their number (MAX_ITEM_WORDS words); more
items are worked off in blocks of that size, one after the other, so no document is read by parts, no item is left out, and the
driver holds one block.

Defined results: null, blank and short texts on either side give no rows; an item whose text repeats another's is reported under
each of their ids; a document is reported once per item; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.hashing import BASE, U64, fold_words, mix, window_starts
from parlance.session import materialize

PASSAGE = 10
#: Words of items that one pass over the documents may hold.
MAX_ITEM_WORDS = 2_000_000


def myers(pattern: list[int], text: list[int]) -> int:
    """The least edit distance between pattern and any run of text, by Myers' bit vectors (any length; 64 symbols are one word)."""
    m = len(pattern)
    if not m:
        return 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        # A match may start anywhere in the text: no carry enters the lowest bit.
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


class Patterns:
    """The passages of a block of items as word numbers, and their pieces by hash."""

    def __init__(self, items: list[tuple[int, str]], passage: int, edits: int) -> None:
        self.passage, self.edits = passage, edits
        self.words: dict[str, int] = {}
        self.items: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            w = [self.words.setdefault(x, len(self.words) + 1) for x in fold_words(text)]
            for i in range(len(w) - passage + 1):
                p = tuple(w[i : i + passage])
                if not self.items[p] or self.items[p][-1] != item:
                    self.items[p].append(item)
        bounds = [passage * k // (edits + 1) for k in range(edits + 2)]
        #: Length of pieces -> sorted hashes, and for each hash the patterns and offsets it stands for.
        self.pieces: dict[int, tuple[np.ndarray, list[list[tuple[tuple[int, ...], int]]]]] = {}
        by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for p in self.items:
            for a, b in zip(bounds, bounds[1:], strict=False):
                by[b - a][int(self.hash(np.array(p[a:b], dtype=U64), np.array([0]), b - a)[0])].append((p, a))
        for size, found in by.items():
            keys = np.array(sorted(found), dtype=U64)
            self.pieces[size] = keys, [found[int(k)] for k in keys]

    @staticmethod
    def hash(codes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(start), dtype=U64)
        for i in range(size):
            h = h * U64(BASE) + codes[start + i]
        return mix(h)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text index, item, edits) of every text and an item of which it holds a passage, with the least word edits of any."""
        get = self.words.get
        codes: list[int] = []
        lengths: list[int] = []
        for t in texts:
            w = fold_words(t)
            lengths.append(len(w))
            codes.extend(get(x, 0) for x in w)
        all_codes, n = np.array(codes, dtype=np.int64), np.array(lengths, dtype=np.int64)
        last = np.cumsum(n)
        found: dict[tuple[int, int], int] = {}
        for size, (keys, stands) in self.pieces.items():
            doc, start = window_starts(n, size)
            # Only runs of words that items know can be a piece.
            known = np.concatenate([[0], np.cumsum(all_codes > 0)])
            full = known[start + size] - known[start] == size
            doc, start = doc[full], start[full]
            h = self.hash(all_codes.astype(U64), start, size)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            for d, s, k in zip(doc[hit].tolist(), start[hit].tolist(), at[hit].tolist(), strict=True):
                low, high = int(last[d] - n[d]), int(last[d])
                for pattern, offset in stands[k]:
                    items = self.items[pattern]
                    if all(found.get((d, i), 1) == 0 for i in items):
                        continue
                    a = max(low, s - offset - self.edits)
                    b = min(high, s - offset + self.passage + self.edits)
                    edits = myers(list(pattern), codes[a:b])
                    if edits <= self.edits:
                        for i in items:
                            found[d, i] = min(edits, found.get((d, i), edits))
        yield from sorted((d, i, e) for (d, i), e in found.items())


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", passage: int = PASSAGE, edits: int = 0) -> DataFrame:
    """(doc_key, item_key, edits): documents that hold `passage` successive words of an item with at most `edits` word edits, and the
    least edits of any passage."""
    if not 0 <= edits < passage:
        raise ValueError("edits must be less than the words of a passage")
    docs = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = f"{doc_key} {docs.schema['doc'].dataType.simpleString()}, {item_key} bigint, edits int"

    def search_block(block: list[tuple[int, str]]) -> DataFrame:
        """The leaks of a block of items, written; its patterns are given up then, so that the driver holds one block at a time."""
        patterns = docs.sparkSession.sparkContext.broadcast(Patterns(block, passage, edits))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(patterns.value.search(b.column("text").to_pylist()))
                columns = [b.column("doc").take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[doc_key, item_key, "edits"])

        found = materialize(docs.mapInArrow(search, schema), "leaks")
        patterns.destroy()
        return found

    out, block, held = None, [], 0
    for r in items.select(F.col(item_key).cast("bigint").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).orderBy("item").toLocalIterator():
        n = len(fold_words(r["text"]))
        if held and held + n > MAX_ITEM_WORDS:
            found = search_block(block)
            out, block, held = found if out is None else out.unionByName(found), [], 0
        block.append((r["item"], r["text"]))
        held += n
    found = search_block(block)
    return found if out is None else out.unionByName(found)
