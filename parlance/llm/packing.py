"""Filling containers of fixed capacity with whole items by a grouping genetic algorithm on islands (problem 8).

A chromosome is a packing, a gene one filled bin. Crossover injects whole well-filled bins of one parent into the other, removes
the bins that would hold an item twice, lets displaced items take the place of smaller ones where that fills a bin better, and puts
the rest back best-fit, largest first; mutation empties the least filled bins in the same way. Fitness is the number of bins, then the mean square of their fill.

Items are dealt by hash to slices of about SLICE items at any size of table. ISLANDS islands evolve each slice apart, each in a row
and task of its own; after every epoch of generations the elite of each migrates to the next one of the ring, EPOCHS times. The best
island gives the slice's packing. Bins filled to FULL or more are kept; the items of the others of all slices are dealt anew and
evolve once more. An island evolves LEAST generations at least, and stops early only once it has the least number of bins that its
sizes allow.

An item longer than the capacity is the only one that is split: into full containers and one rest, which is an item like any.

Defined results: null and blank texts hold no item; repeated texts are items of their own; empty tables give no containers; extra
columns are ignored. The same table and seed give the same packing.
"""

from __future__ import annotations

import base64
import bisect
import os
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize

CAPACITY, SLICE, FULL = 2048, 2048, 0.995
ISLANDS, EPOCHS, POPULATION, GENERATIONS, LEAST = 3, 3, 6, 12, 2
#: A vocabulary file of ranks, and the pattern that splits text before the merges (fixed values of the public tokenizer).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens) of every text that is not null or blank."""
    rows = df.select(key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    # The file is sent along for executors that lack it.
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))).encode_ordinary
        for b in batches:
            texts = b.column("_text").to_pylist()
            at = [i for i, t in enumerate(texts) if t.strip()]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array([len(encode(texts[i])) for i in at], pa.int64())], names=[key, "tokens"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, tokens bigint")


#: Bytes of an item's name: its key and the number of its piece.
NAME = 12
#: Bins that a displaced item tries to fill better.
TRIED = 64

# One island ---------------------------------------------------------------------------------------------------------------------
Packing = list[list[int]]  # bins of item numbers


class Island:
    """Packings of items of the given sizes."""

    def __init__(self, sizes: list[int], capacity: int, seed: int) -> None:
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.least = -(-sum(sizes) // capacity) if sizes else 0

    def load(self, b: list[int]) -> int:
        s = self.sizes
        return sum(s[i] for i in b)

    def fitness(self, p: Packing) -> tuple[int, float]:
        """Greater is better: fewer bins, then fuller ones."""
        return -len(p), sum((self.load(b) / self.capacity) ** 2 for b in p) / max(len(p), 1)

    def insert(self, bins: Packing, items: list[int]) -> Packing:
        """The items put best-fit into the bins, largest first, new bins where none fits."""
        free = sorted((self.capacity - self.load(b), k) for k, b in enumerate(bins))
        for i in sorted(items, key=lambda i: -self.sizes[i]):
            at = bisect.bisect_left(free, (self.sizes[i], -1))
            if at < len(free):
                left, k = free.pop(at)
                bins[k].append(i)
            else:
                left, k = self.capacity, len(bins)
                bins.append([i])
            bisect.insort(free, (left - self.sizes[i], k))
        return bins

    def first(self, shaken: bool) -> Packing:
        """Best fit decreasing; shaken: over items in slightly shuffled order."""
        if not shaken:
            return self.insert([], list(range(len(self.sizes))))
        bins: Packing = []
        order = sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i] * self.rng.uniform(0.8, 1.25))
        for s in range(0, len(order), 256):
            self.insert(bins, order[s : s + 256])
        return bins

    def replace(self, bins: Packing, items: list[int]) -> list[int]:
        """Items that fill a bin better than one in it take its place; the items that are left over."""
        s, rest = self.sizes, []
        free = [self.capacity - self.load(b) for b in bins]
        # The bins with most room are looked at; a bin without room gains nothing.
        open_ = sorted((k for k, f in enumerate(free) if f > 0), key=lambda k: -free[k])[:TRIED]
        if not open_:
            return items
        of = np.repeat(np.arange(len(open_)), [len(bins[k]) for k in open_])
        held = [(k, x) for k in open_ for x in range(len(bins[k]))]
        size, room = np.array([s[bins[k][x]] for k, x in held]), np.array([free[k] for k in open_])
        for i in sorted(items, key=lambda i: -s[i]):
            gain = s[i] - size
            gain[gain > room[of]] = 0
            at = int(gain.argmax())
            if gain[at] > 0:
                k, x = held[at]
                bins[k][x], i = i, bins[k][x]
                size[at] += gain[at]
                room[of[at]] -= gain[at]
            rest.append(i)
        return rest

    def cross(self, a: Packing, b: Packing) -> Packing:
        """Bins of b, the better filled the likelier, injected into a."""
        ranked = sorted(b, key=self.load, reverse=True)
        n = max(1, len(ranked) // 3)
        start = self.rng.randrange(max(1, len(ranked) // 2))
        injected = [list(x) for x in ranked[start : start + self.rng.randint(1, n)]]
        held = {i for x in injected for i in x}
        kept, displaced = [], []
        for x in a:
            if held.isdisjoint(x):
                kept.append(list(x))
            else:
                displaced += [i for i in x if i not in held]
        bins = injected + kept
        return self.insert(bins, self.replace(bins, displaced))

    def mutate(self, p: Packing) -> Packing:
        """The least filled bins and a few others emptied and put back."""
        ranked = sorted(p, key=self.load)
        out = ranked[: self.rng.randint(1, max(1, len(p) // 20))]
        rest = ranked[len(out) :]
        self.rng.shuffle(rest)
        more = rest[: len(out)]
        bins = [list(x) for x in rest[len(more) :]]
        return self.insert(bins, self.replace(bins, [i for x in out + more for i in x]))

    def evolve(self, elites: list[Packing], population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
        """The best packing after the generations, from the elites and new packings on."""
        if not self.sizes:
            return []
        pool = [[list(b) for b in e] for e in elites] or [self.first(False)]
        while len(pool) < population:
            pool.append(self.first(True))
        for g in range(generations):
            ranked = sorted(((self.fitness(p), -k, p) for k, p in enumerate(pool)), key=lambda x: x[:2], reverse=True)
            if g >= LEAST and len(ranked[0][2]) <= self.least:
                break
            elite = [p for _, _, p in ranked[: population // 2]]
            children = []
            while len(elite) + len(children) < population:
                a, b = self.rng.sample(elite, 2) if len(elite) > 1 else (elite[0], elite[0])
                child = self.cross(a, b)
                children.append(self.mutate(child) if self.rng.random() < 0.5 else child)
            pool = elite + children
        return max(pool, key=self.fitness)


# Islands over the cluster ---------------------------------------------------------------------------------------------------------
#: A slice's items by name and size, and the bin of each item in the elites of its islands; from: the island of an elite.
_STATE = "slice int, island int, origin int, names binary, sizes binary, bins binary"


def _bins(data: bytes) -> Packing:
    at = np.frombuffer(data, dtype=np.int32)
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.nonzero(np.diff(at[order]))[0] + 1)] if len(at) else []


def _placed(p: Packing, n: int) -> bytes:
    at = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(p):
        at[b] = k
    return at.tobytes()


def _pack(items: DataFrame, slices: int, capacity: int, seed: int) -> DataFrame:
    """(slice, bin, item, size, load) of items (item binary, size)."""
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(slices)).cast("int"))

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        """The items of a slice, for each of its islands."""
        pairs = sorted(zip(table["item"].to_pylist(), table["size"].to_pylist(), strict=True))
        row = (key[0].as_py(), b"".join(p[0] for p in pairs), np.array([p[1] for p in pairs], dtype=np.int32).tobytes())
        return pa.table({"slice": pa.array([row[0]] * ISLANDS, pa.int32()), "island": pa.array(range(ISLANDS), pa.int32()), "origin": pa.array(range(ISLANDS), pa.int32()),
                         "names": pa.array([row[1]] * ISLANDS, pa.binary()), "sizes": pa.array([row[2]] * ISLANDS, pa.binary()), "bins": pa.array([None] * ISLANDS, pa.binary())})

    def epoch(number: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            """An island evolves from its own elite and the one that came; its elite stays and goes on to the next island."""
            rows = sorted(table.to_pylist(), key=lambda r: r["origin"] != r["island"])
            own, at, island = rows[0], key[0].as_py(), key[1].as_py()
            sizes = np.frombuffer(own["sizes"], dtype=np.int32).tolist()
            best = Island(sizes, capacity, hash((seed, at, island, number))).evolve([_bins(r["bins"]) for r in rows if r["bins"] is not None])
            placed = _placed(best, len(sizes))
            return pa.table({"slice": pa.array([at, at], pa.int32()), "island": pa.array([island, (island + 1) % ISLANDS], pa.int32()), "origin": pa.array([island, island], pa.int32()),
                             "names": pa.array([own["names"], None], pa.binary()), "sizes": pa.array([own["sizes"], None], pa.binary()), "bins": pa.array([placed, placed], pa.binary())})

        return run

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        """The best island of a slice."""
        rows = [r for r in table.to_pylist() if r["names"] is not None]
        sizes = np.frombuffer(rows[0]["sizes"], dtype=np.int32)
        judge = Island(sizes.tolist(), capacity, 0)
        best = max(sorted(rows, key=lambda r: r["island"]), key=lambda r: judge.fitness(_bins(r["bins"])))
        at = np.frombuffer(best["bins"], dtype=np.int32)
        names = best["names"]
        return pa.table({"slice": pa.array([key[0].as_py()] * len(at), pa.int32()), "bin": pa.array(at), "item": pa.array([names[i * NAME : (i + 1) * NAME] for i in range(len(at))], pa.binary()),
                         "size": pa.array(sizes.astype(np.int64)), "load": pa.array(np.bincount(at, weights=sizes)[at].astype(np.int64))})

    state = dealt.groupBy("slice").applyInArrow(settle, _STATE)
    for number in range(EPOCHS):
        # Slices and islands fill all tasks evenly: one row each.
        state = state.groupBy("slice", "island").applyInArrow(epoch(number), _STATE)
    return materialize(state.groupBy("slice").applyInArrow(choose, "slice int, bin int, item binary, size bigint, load bigint"), "packing")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """(container_id, key, piece_no, tokens): every item of size 1 or more in containers of the capacity. key is a BIGINT."""
    s = materialize(sizes.select(F.col(key).cast("bigint").alias("k"), F.col(size).cast("bigint").alias("s")).filter(F.col("s") > 0), "sizes")
    whole = F.when(F.col("s") > capacity, F.expr(f"s div {capacity}")).otherwise(F.lit(0))
    # Full containers of items that are too long.
    full = s.filter(F.col("s") > capacity).select("k", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece_no"))
    full = full.select(F.xxhash64(F.lit(0), "k", "piece_no").alias("container_id"), "k", F.col("piece_no").cast("bigint"), F.lit(capacity).cast("bigint").alias("tokens"))
    rest = s.select("k", whole.alias("piece_no"), (F.col("s") - whole * capacity).alias("size")).filter(F.col("size") > 0)
    items = rest.select(F.to_binary(F.concat(F.lpad(F.hex("k"), 16, "0"), F.lpad(F.hex("piece_no"), 8, "0")), F.lit("hex")).alias("item"), "size")
    slices = max(1, round(s.count() / SLICE))
    one = _pack(items, slices, capacity, seed)
    good = F.col("load") >= FULL * capacity
    # The items of poorly filled bins are dealt anew: few of each slice.
    open_ = materialize(one.filter(~good).select("item", "size"), "open")
    two = _pack(open_, max(1, round(open_.count() / SLICE)), capacity, seed + 1)
    done = one.filter(good).select(F.lit(1).alias("round"), "slice", "bin", "item", "size").unionByName(two.select(F.lit(2).alias("round"), "slice", "bin", "item", "size"))
    number = lambda a, n: F.conv(F.substring(F.hex("item"), a, n), 16, -10).cast("bigint")
    packed = done.select(F.xxhash64("round", "slice", "bin").alias("container_id"), number(1, 16).alias("k"), number(17, 8).alias("piece_no"), F.col("size").alias("tokens"))
    return full.unionByName(packed).withColumnRenamed("k", key)
