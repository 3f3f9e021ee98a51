"""Near-duplicate texts by a binary trie self-join (problem 3).

A text is the set of its k-word runs; two texts are near duplicates if the Jaccard similarity of their sets reaches the
threshold, that is if at most rate * (|A| + |B|) members differ, rate = (1 - t) / (1 + t). The join is exact:

* Members are ordered rarest first: those that a bounded summary of frequent members does not hold by their hash, then the frequent
  ones by count (any one order is right). Two near duplicates share a member within the first |A| - ceil(t |A|) + 1 of each. The
  first member that both hold is the root of their subtree; before it lie only differing members, so a pair starts with as many
  errors as the two positions.
* Below the root the members still to come are an odd sketch: one bit per member, added modulo 2. Two sketches never differ in
  more bits than their sets do in members, so walking both tries together, adding up differing bits and pruning pairs beyond the
  error budget, drops no near duplicate.
* Pairs that are left are verified on the sets themselves.

One row per member of a prefix is sent, at any size: nothing is pruned by a structure that fills up. Rows of one task and part go
packed. A root that more than BLOCK texts share is known from the summary of roots; it is split into blocks, and each pair of
blocks is one group, so no task holds a hot root. Such texts have nothing but frequent members in their prefix: they are light
edits of one text, near duplicates of each other for the most part, so that the pairs of blocks are the pairs asked for. Texts with
equal sets are one class; only its least id takes part, and the class is opened up at the end.

Defined results: keys are BIGINT; null and blank texts and texts below the least number of words take no part; repeated rows are
near duplicates with similarity 1; whole texts are read; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import trie
from parlance.llm.hashing import U64, Vocabulary, counts_of, heavy, mix, pack48, shingle_sets, unpack48
from parlance.session import materialize

#: Bits of an odd sketch.
SKETCH = 128
#: Texts of one block of a hot root, and rows of a part (the work of one task).
BLOCK, PART = 1 << 15, 100_000
#: Rows that a task holds back to pack them together.
PACK = 1_000_000

Summary = tuple[np.ndarray, np.ndarray]


def text_sets(df: DataFrame, key: str, text: str, k: int, least_words: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, set, cls, *carry) of every text with least_words words or more: its number of members, the members, and a digest of the set."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), *carry, F.col(text).alias("text")).filter(F.col("text").isNotNull())
    vocabulary = Vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = shingle_sets(b.column("text").to_pylist(), k, least_words, vocabulary)
            at, first = np.unique(doc, return_index=True)
            bounds = [*first.tolist(), len(h)]
            sets = [pack48(h[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(idx) for i in range(1 + len(carry))] + [pa.array(np.diff(bounds), pa.int32()), pa.array(sets, pa.binary()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())],
                names=["id", *carry, "n", "set", "cls"],
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *carry))
    return rows.mapInArrow(run, f"{kinds}, n int, set binary, cls binary")


def _members(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row index, member) of a batch of sets."""
    sets = b.column("set").to_pylist()
    n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), unpack48(b"".join(sets)) if sets else np.zeros(0, dtype=U64)


def frequent_members(sets: DataFrame) -> Summary:
    """The frequent members of all sets, mixed, and their counts: a bounded summary."""
    return heavy(sets.select("n", "set"), lambda b: mix(_members(b)[1]))


class Ordered:
    """The members of a batch of sets (n, set), rarest first: row, mixed member, position, and the sizes and prefixes of the sets."""

    def __init__(self, b: pa.RecordBatch, known: Summary, threshold: float) -> None:
        row, h = _members(b)
        self.n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        m = mix(h)
        order = self._order(row, m, counts_of(known, m))
        self.row, self.m = row[order], m[order]
        self.first = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(row)) - self.first[self.row]
        prefix = self.n - np.ceil(threshold * self.n - 1e-9).astype(np.int64) + 1
        #: Where the members of prefixes are.
        self.at = np.nonzero(self.pos < prefix[self.row])[0]

    @staticmethod
    def _order(row: np.ndarray, m: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By row, count (in steps of an eighth of a doubling) and member: in one sort of 64 bits where these tell all members apart."""
        level = np.where(counts > 0, np.minimum(1 + 8 * np.log2(np.maximum(counts, 1)), 255), 0).astype(U64)
        if len(row) and row[-1] < 1 << 16:
            key = (row.astype(U64) << U64(48)) | (level << U64(40)) | (m >> U64(24))
            order = np.argsort(key)
            if (key[order][1:] != key[order][:-1]).all():
                return order
        return np.lexsort((m, level, row))

    def sketches(self) -> np.ndarray:
        """Odd sketches of the members after each one of the prefixes, by running sums modulo 2 from the end."""
        bit = (self.m >> U64(40)) % U64(SKETCH)
        sk = np.zeros((len(self.row) + 1, SKETCH // 64), dtype=U64)
        sk[np.arange(len(self.row)), (bit // U64(64)).astype(np.int64)] = U64(1) << (bit % U64(64))
        acc = np.bitwise_xor.accumulate(sk[::-1], axis=0)[::-1]
        return acc[self.at + 1] ^ acc[(self.first + self.n)[self.row[self.at]]]


def roots(sets: DataFrame, threshold: float, known: Summary | None = None) -> DataFrame:
    """Packed rows (key, id, size, position, role, sketch) of the subtrees that the texts of sets (id, n, set) belong to, dealt to
    parts by key. A root of more than BLOCK texts is dealt to blocks: its key is of root and pair of blocks, the role tells the block.
    """
    sc = sets.sparkSession.sparkContext
    order = sc.broadcast(frequent_members(sets) if known is None else known)
    hot = sc.broadcast(heavy(sets.select("n", "set"), lambda b: (lambda o: o.m[o.at])(Ordered(b, order.value, threshold))))
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(total * (1 - threshold) / PART))

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, ids, n, pos, role, sk = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (key % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        first = np.nonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))[0].tolist()
        rows = []
        for s, e in zip(first, [*first[1:], len(part)], strict=True):
            at = order[s:e]
            small = [np.diff(ids[at], prepend=0), n[at].astype(np.int32), pos[at].astype(np.int32), role[at].astype(np.int8)]
            rows.append((int(part[at[0]]), pack48(key[at]), *[pa.compress(x.tobytes(), "zstd", asbytes=True) for x in small], sk[at].tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "key", "id", "n", "pos", "role", "sk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            o = Ordered(b, order.value, threshold)
            at, r = o.at, o.row[o.at]
            # Every row of a hot root goes to the pair of its block with each block.
            blocks = np.maximum(-(-counts_of(hot.value, o.m[at]) // BLOCK), 1)
            copies = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            # What deals a text to a block: a mix of its members.
            deal = np.bitwise_xor.reduceat(mix(o.m + U64(1)), o.first)
            m = o.m[at][copies]
            mine = (mix(deal[r[copies]] ^ m) % blocks[copies].astype(U64)).astype(np.int64)
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            key = mix(m ^ mix((lo.astype(U64) << U64(32)) + hi.astype(U64))) >> U64(16)
            role = np.where(lo == hi, 0, np.where(mine == lo, 1, 2))
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((key, ids[r[copies]], o.n[r[copies]], o.pos[at][copies], role, o.sketches()[copies]))
            if sum(len(h[0]) for h in held) >= PACK:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    rows = sets.select("id", "n", "set").mapInArrow(run, "part int, key binary, id binary, n binary, pos binary, role binary, sk binary")
    return rows.repartitionById(parts, "part")


def trie_pairs(found: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: candidate pairs of the subtrees, once for each task that keeps them."""
    rate = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for b in batches:
            for key, *small, sk in zip(*[b.column(c).to_pylist() for c in ("key", "id", "n", "pos", "role", "sk")], strict=True):
                h = unpack48(key)
                cols[0].append(h)
                for c, data, kind in zip(cols[1:5], small, (np.int64, np.int32, np.int32, np.int8), strict=True):
                    c.append(np.frombuffer(pa.decompress(data, len(h) * np.dtype(kind).itemsize, "zstd", asbytes=True), dtype=kind).astype(np.int64))
                cols[1][-1] = np.cumsum(cols[1][-1])
                cols[5].append(np.frombuffer(sk, dtype=U64).reshape(-1, SKETCH // 64))
        if not cols[0]:
            return
        key, ids, n, pos, role, sk = (np.concatenate(c) for c in cols)
        order = np.lexsort((*sk.T[::-1], role, key))
        key, ids, n, pos, role, sk = key[order], ids[order], n[order], pos[order], role[order], sk[order]
        # Roots of the walk: the rows of one key and role.
        starts = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (role[1:] != role[:-1])]))[0]
        ends = np.append(starts[1:], len(key))
        whole = np.nonzero((role[starts] == 0) & (ends - starts > 1))[0]
        one = np.nonzero((role[starts[:-1]] == 1) & (role[starts[1:]] == 2) & (key[starts[:-1]] == key[starts[1:]]))[0]
        i, j = trie.join(sk, starts, ends, np.concatenate([whole, one]), np.concatenate([whole, one + 1]), pos, n, rate, n - pos)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        # A pair that several roots of the part keep goes on once.
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = (a != b) & np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    return found.mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, similarity) of the pairs whose sets reach the threshold."""
    pairs = materialize(pairs, "candidates")
    # Only sets that are in a pair are moved.
    s = sets.select("id", "n", "set").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    return compare(pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b"), threshold)


def compare(both: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, similarity) of the pairs (a, b, na, nb, sa, sb: sizes and members of both sets) that reach the threshold."""
    kind = both.schema["a"].dataType.simpleString()
    both = both.select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            # Members of both sides in one sort: a member that stands twice in a row is shared.
            h = np.concatenate([unpack48(b"".join(b.column(c).to_pylist())) for c in ("sa", "sb")])
            row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            shared = np.bincount(row[1:][same], minlength=len(na))
            sim = shared / (na + nb - shared)
            # Exact in whole numbers: the threshold has two decimals.
            ok = shared * 100 >= round(threshold * 100) * (na + nb - shared)
            keep = pa.array(np.nonzero(ok)[0])
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), pa.array(shared[ok].astype(np.int64)), pa.array(sim[ok])], names=["a", "b", "shared", "similarity"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, shared bigint, similarity double")


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep): every id of a class of two or more equal sets, with the class's least id."""
    rep = sets.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("cls", "rep")
    return sets.select("id", "cls").join(rep, "cls").select("id", "rep")


def links(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives (a, b, shared, similarity) with a < b, members (id, rep) of classes with copies) of materialised sets."""
    copies = materialize(classes(sets), "classes")
    heads = sets.select("id", "n", "set").join(copies.filter(F.col("id") != F.col("rep")).select("id"), "id", "left_anti")
    pairs = trie_pairs(roots(heads, threshold), threshold)
    return verify(pairs.distinct(), sets, threshold), copies


def near_pairs(df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, k: int = 5, least_words: int = 20) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of near duplicates, the copies of each class included."""
    sets = materialize(text_sets(df, key, text, k, least_words), "sets")
    found, copies = links(sets, threshold)
    a, b = copies.select(F.col("rep").alias("a"), F.col("id").alias("ia")), copies.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = found.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    within = copies.select("rep", F.col("id").alias("x")).join(copies.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_classes(df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, k: int = 5, least_words: int = 20) -> DataFrame:
    """(key, class_id, n_copies, n_links): one row per text that takes part: the least id with an equal set, the texts of that set, and the other sets near it."""
    sets = materialize(text_sets(df, key, text, k, least_words), "sets")
    found, copies = links(sets, threshold)
    found = materialize(found, "links")
    degree = found.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = copies.groupBy(F.col("rep").alias("class_id")).agg(F.count(F.lit(1)).alias("n_copies"))
    rows = sets.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    rows = rows.join(degree, "class_id", "left").join(sizes, "class_id", "left")
    return rows.select(F.col("id").alias(key), "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
