"""The most similar vectors of every vector, by shifted space-filling curves (problem 5).

Vectors of length one are projected to DIMS random orthogonal directions (from a seed), shifted at random, cut into 2**BITS cells a
direction, and ordered by their Hilbert key; each of CURVES orderings has a projection and shift of its own. All orderings go
through one shuffle: rows are dealt to ranges of keys whose bounds come from a bounded sample (SAMPLE rows), sorted within their
range, and every vector is compared with the WINDOW neighbours before and behind it, in blocks, in half precision. The first and
last WINDOW vectors of each range then meet those of the range beside it, so that windows go on over the bounds. The best of all
orderings are merged and ranked again by the exact cosine of the full vectors.

The index is fitted on the sample only (bounds of ranges and the scale of projections); every vector is indexed. Ranges hold
about ROWS_PER_RANGE vectors at any size. Keys that are alike (copies of one vector) are spread over ranges by a random tail of the
key, so no task gets all of them.

Defined results: vectors that are null, of another length, all zero, or hold null, NaN or infinity take no part; an exact copy has
cosine 1; of equally similar neighbours any k may be named; tables of one vector or none give no pairs; extra columns are
ignored. Recall on the test data is measured in tests and stated in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import materialize

DIMS, BITS, CURVES, WINDOW = 16, 3, 4, 512
SAMPLE, ROWS_PER_RANGE = 20_000, 20_000
#: What half precision may take from a cosine, and neighbours kept beyond k until the exact ranking.
SLACK, SPARE = 0.002, 3


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys (uint64) of n x d whole coordinates below 2**bits, d * bits <= 64 (Skilling's transposition, all rows at once)."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            flip = (x[i] & q) != 0
            t = np.where(flip, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q = np.uint32(q >> 1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ np.uint32(q - 1), t)
        q = np.uint32(q >> 1)
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row indexes, vectors as float64) of the usable lists of a column."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.nonzero(lengths == dim)[0]
    flat = column.take(pa.array(rows)).flatten()
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(rows) else np.zeros((0, dim))
    ok = np.isfinite(v).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
    ok &= np.isfinite(norm) & (norm > 0)
    return rows[ok], v[ok] / norm[ok, None]


class Curves:
    """The orderings: projections, shifts and ranges, fitted on a sample of vectors of length one."""

    def __init__(self, sample: np.ndarray, total: int, dim: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.dims = min(DIMS, dim)
        self.maps, self.bounds = [], []
        ranges = max(1, -(-total // ROWS_PER_RANGE))
        sample = sample if len(sample) else np.zeros((1, dim))
        for _ in range(CURVES):
            r = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : self.dims]
            y = sample @ r
            self.maps.append((r, y.std(axis=0) + 1e-12, y.mean(axis=0), rng.uniform(0, 1, size=self.dims)))
        for c in range(CURVES):
            keys = np.sort(self.keys(sample, c, rng))
            self.bounds.append(keys[(np.arange(1, ranges) * len(keys)) // ranges] if len(keys) else keys)

    def keys(self, v: np.ndarray, curve: int, rng: np.random.Generator) -> np.ndarray:
        r, scale, mean, shift = self.maps[curve]
        y = (v @ r - mean) / scale
        cells = np.clip(((y + 2.5) / 5 * (1 << BITS) + shift).astype(np.int64), 0, (1 << BITS) - 1)
        key = hilbert(cells, BITS)
        spare = np.uint64(64 - self.dims * BITS)
        # The random tail orders rows of one cell and spreads copies.
        return (key << spare) | (rng.integers(0, 1 << 62, size=len(v)).astype(np.uint64) >> np.uint64(62 - int(spare)))


def candidates(vectors: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """(a, b): for each usable vector a of (id, v) its k + SPARE most similar vectors b within the windows, of cosine least - SLACK or more."""
    spark = vectors.sparkSession
    total = vectors.count()
    sampled = vectors.sample(min(1.0, SAMPLE * 1.2 / max(total, 1)), seed=5).limit(SAMPLE)
    sample = usable(pa.array([r["v"] for r in sampled.select("v").collect()], pa.list_(pa.float64())), dim)[1]
    curves = spark.sparkContext.broadcast(Curves(sample, total, dim))
    kind = vectors.schema["id"].dataType.simpleString()
    # Two ranges a task, so that a task reads as much at any size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_RANGE) * CURVES // 2)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            rows, v = usable(b.column("v"), dim)
            ids, half = b.column("id").take(pa.array(rows)), v.astype(np.float16)
            data = pa.array([x.tobytes() for x in half], pa.binary())
            rng = np.random.default_rng([n, len(rows)])
            for c in range(CURVES):
                keys = curves.value.keys(v, c, rng)
                part = np.searchsorted(curves.value.bounds[c], keys, side="right") * CURVES + c
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array((keys >> np.uint64(1)).astype(np.int64)), ids, data], names=["part", "key", "id", "half"])

    dealt = vectors.select("id", "v").mapInArrow(index, f"part int, key bigint, id {kind}, half binary").repartition(tasks, "part").sortWithinPartitions("part", "key")
    keep = k + SPARE
    schema = f"a {kind}, b {kind}, border int, place int, half binary"

    def best(v: np.ndarray, w: np.ndarray, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, row of w) of the keep most similar ones of each row, of cosine least - SLACK or more; apart: pairs that do not count."""
        sim = v @ w.T
        if apart is not None:
            sim[apart] = -2
        hit = sim >= least - SLACK
        for i in np.nonzero(hit.sum(axis=1) > keep)[0]:
            row = np.where(hit[i], sim[i], -2)
            hit[i] = False
            hit[i, np.argpartition(-row, keep)[:keep]] = True
        return np.nonzero(hit)

    def compare(ids: np.ndarray, v: np.ndarray, fresh: int) -> tuple[list, list]:
        """Neighbours of the rows from fresh - WINDOW on; rows before fresh were compared with one another already."""
        left, right = [], []
        for s in range(max(0, fresh - WINDOW), len(ids), WINDOW):
            e = min(len(ids), s + WINDOW)
            lo, hi = max(0, s - WINDOW), min(len(ids), e + WINDOW)
            apart = np.zeros((e - s, hi - lo), dtype=bool)
            apart[np.arange(e - s), np.arange(s - lo, e - lo)] = True
            i, j = best(v[s:e], v[lo:hi], apart)
            left.append(ids[s:e][i])
            right.append(ids[lo:hi][j])
        return left, right

    def border(part: int, ids: np.ndarray, v: np.ndarray, last: bool) -> pa.RecordBatch:
        """Rows at an end of a range, by the border they lie at and how far from it. Borders of a curve are CURVES apart, as ranges are."""
        n = len(ids)
        place = np.arange(n, 0, -1) if last else np.arange(1, n + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([None] * n, b_type), pa.array(np.full(n, part + CURVES if last else part, dtype=np.int32)), pa.array((place * (-1 if last else 1)).astype(np.int32)), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())],
            names=["a", "b", "border", "place", "half"],
        )

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "border", "place", "half"])

    b_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, v, head = None, np.zeros(0, dtype=np.int64), np.zeros((0, dim), dtype=np.float32), 0
        for b in batches:
            if not b.num_rows:
                continue
            parts, new_ids = b.column("part").to_numpy(), b.column("id").to_numpy(zero_copy_only=False)
            new_v = np.frombuffer(b"".join(b.column("half").to_pylist()), dtype=np.float16).reshape(-1, dim).astype(np.float32)
            starts = np.nonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))[0]
            for s, e in zip(starts, [*starts[1:], len(parts)], strict=True):
                if parts[s] != part:
                    if part is not None:
                        yield border(part, ids[-WINDOW:], v[-WINDOW:], True)
                    part, ids, v, head = int(parts[s]), new_ids[:0], new_v[:0], 0
                fresh = len(ids)
                ids, v = np.concatenate([ids, new_ids[s:e]]), np.concatenate([v, new_v[s:e]])
                if head < WINDOW:
                    # The first rows of a range, as they come.
                    more = min(WINDOW - head, len(ids) - fresh)
                    rows = border(part, ids[fresh : fresh + more], v[fresh : fresh + more], False)
                    yield rows.set_column(3, "place", pa.array(np.arange(head + 1, head + more + 1, dtype=np.int32)))
                    head += more
                left, right = compare(ids, v, fresh)
                yield linked(np.concatenate(left), np.concatenate(right))
                # The last rows of the range so far are neighbours of the next batch.
                ids, v = ids[-2 * WINDOW :], v[-2 * WINDOW :]
        if part is not None:
            yield border(part, ids[-WINDOW:], v[-WINDOW:], True)

    def meet(table: pa.Table) -> pa.Table:
        """The rows before a border and those behind it, WINDOW apart at most."""
        ids, place = table.column("a").to_numpy(), table.column("place").to_numpy()
        v = np.frombuffer(b"".join(table.column("half").to_pylist()), dtype=np.float16).reshape(-1, dim).astype(np.float32)
        before, behind = np.nonzero(place < 0)[0], np.nonzero(place > 0)[0]
        if not len(before) or not len(behind):
            return pa.table({"a": pa.array(ids[:0]), "b": pa.array(ids[:0])})
        far = place[behind][None, :] - place[before][:, None] > WINDOW
        i, j = best(v[before], v[behind], far)
        x, y = best(v[behind], v[before], far.T)
        return pa.table({"a": pa.array(np.concatenate([ids[before][i], ids[behind][x]])), "b": pa.array(np.concatenate([ids[behind][j], ids[before][y]]))})

    walked = materialize(dealt.mapInArrow(walk, schema), "walked")
    met = walked.filter(F.col("border").isNotNull()).groupBy("border").applyInArrow(meet, f"a {kind}, b {kind}")
    return walked.filter(F.col("border").isNull()).select("a", "b").unionByName(met)


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, least: float = -1.0) -> DataFrame:
    """(id, neighbour, cosine, rank): the up to k most similar vectors of each usable vector, of cosine `least` or more."""
    vectors = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dim)
    pairs = candidates(vectors, dim, k, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialize(pairs, "neighbours")
    # Only vectors that are in a pair are sent to the exact ranking.
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    exact = vectors.join(ids, "id", "left_semi")
    both = pairs.join(exact.toDF("a", "va"), "a").join(exact.toDF("b", "vb"), "b")
    kind = vectors.schema["id"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                va, vb = (usable(b.column(c), dim)[1] for c in ("va", "vb"))
                cos = (va * vb).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(cos)], names=["a", "b", "cosine"])

    scored = both.select("a", "b", "va", "vb").mapInArrow(rank, f"a {kind}, b {kind}, cosine double").filter(F.col("cosine") >= least)
    each = scored.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour")))).alias("p"), "cosine").select("p.*", "cosine")
    # Rows beyond the k-th are dropped before the shuffle already (window group limit), however many name one vector.
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "neighbour", "cosine", F.col("rank").cast("bigint").alias("rank"))


def similar_pairs(df: DataFrame, key: str, vector: str, dim: int, k: int, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of cosine `least` or more of which one is among the k most similar of the other."""
    found = nearest(df, key, vector, dim, k, least)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
