"""Vectorised word, window and set hashes over batches of texts, and frequent keys of whole tables.

Everything here works on numpy arrays that hold the words of many texts one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
#: Multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Vocabulary(dict):
    """Word -> 64-bit hash; emptied when it holds too many words, so that its size is bounded."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words_of(texts: Iterable[str], split: Callable[[str], list[str]], vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one text after another, number of words of each text)."""
    codes: list[int] = []
    lengths: list[int] = []
    for t in texts:
        w = split(t)
        lengths.append(len(w))
        codes.extend(map(vocabulary.__getitem__, w))
    return np.array(codes, dtype=U64), np.array(lengths, dtype=np.int64)


def fold_words(text: str) -> list[str]:
    """The lower-cased runs of letters and digits."""
    return WORD.findall(text.lower())


def window_starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, start) of every window of size words that lies within one text."""
    n = np.maximum(lengths - size + 1, 0)
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return doc, first[doc] + within


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, U64(base), dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Prefixes:
    """Polynomial prefix sums, by which the hash of any run of words costs one step."""

    def __init__(self, codes: np.ndarray) -> None:
        self.sums = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(codes * powers(len(codes), BASE), out=self.sums[1:])
        self.back = powers(len(codes) + 1, INVERSE)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


SHINGLE_BITS = 48


def shingle_sets(texts: Iterable[str], k: int, least_words: int, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word runs of each text with at least least_words words, sorted by both. Hashes have 48 bits."""
    codes, lengths = words_of(texts, fold_words, vocabulary)
    doc, start = window_starts(np.where(lengths >= least_words, lengths, 0), k) if len(lengths) else (np.zeros(0, int), np.zeros(0, int))
    if len(doc) and (lengths < least_words).any():
        # Texts left out still take their place among the words.
        first = np.cumsum(lengths) - lengths
        short_first = np.cumsum(np.where(lengths >= least_words, lengths, 0)) - np.where(lengths >= least_words, lengths, 0)
        start = start - short_first[doc] + first[doc]
    h = np.zeros(len(doc), dtype=U64)
    for i in range(k):
        h = h * U64(BASE) + codes[start + i] if len(doc) else h
    h = mix(h) >> U64(64 - SHINGLE_BITS)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(doc):
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def pack48(h: np.ndarray) -> bytes:
    """48-bit values as 6 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8").astype(U64, copy=False)


# Heavy keys ----------------------------------------------------------------------------------------------------------------
#: Keys of a summary: HEAVY pairs of eight bytes each are sent to every executor, whatever the data.
HEAVY = 1 << 16


def _merge(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a, b])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([n, m])[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def heavy(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], k: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of at most k 64-bit keys: every key that makes up more than 3/k of all is among them.

    keys gives the keys of a batch, each once for every row that is to count. Each task keeps a frequent-items summary (Misra and
    Gries) of 8 k counters, and hands on those above 1/k of its keys; counts are never above the true ones and at most 2/k of all
    below. So what is sent is bounded at any size, and any key that is not among them has few rows for one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, total = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0
        for b in batches:
            if b.num_rows:
                x = keys(b)
                total += len(x)
                have, n = _merge(have, n, *np.unique(x, return_counts=True))
                if len(have) > 8 * k:
                    n = n - np.partition(n, len(n) - k - 1)[len(n) - k - 1]
                    have, n = have[n > 0], n[n > 0]
        keep = n > max(total // k, 1)
        yield pa.RecordBatch.from_arrays([pa.array([None, *have[keep].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[keep].tolist()], pa.int64())], names=["key", "n"])

    found = materialize(df.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "heavy")
    total = (found.filter("key IS NULL").first() or [None, 0])[1]
    rows = found.filter(F.col("key").isNotNull() & (F.col("n") > total // k)).toPandas()
    at = rows["key"].to_numpy(dtype=np.int64).view(U64)
    order = np.argsort(at)
    return at[order], rows["n"].to_numpy(dtype=np.int64)[order]


def counts_of(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The count of each key in a summary, 0 for those it does not hold."""
    have, n = known
    if not len(have):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, n[at], 0)
