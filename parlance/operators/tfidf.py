"""Term statistics and exact similarity of texts on relational TF-IDF vectors.

tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1, rows of length one. Texts without terms have no vector. Empty tables give
empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, c)."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))


def weights(counts: DataFrame, key: str, least_df: int = 1, group: str | None = None) -> DataFrame:
    """(key, term, w, df): vectors of length one. With group (a column of counts) each group has texts and frequencies of its own.

    Without, the number of texts is one aggregate; with, it is joined by group.
    """
    by = [group] if group else []
    counts = materialize(counts, "terms")
    vocabulary = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_df)
    raw = counts.join(vocabulary, [*by, "term"])
    if group:
        raw = raw.join(counts.groupBy(group).agg(F.countDistinct(key).alias("_n")), group)
    else:
        raw = raw.withColumn("_n", F.lit(counts.select(key).distinct().count()))
    raw = raw.withColumn("raw", (1 + F.log("c")) * (F.log((1.0 + F.col("_n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(*by, key, "term", (F.col("raw") / F.col("norm")).alias("w"), "df")


def term_stats(df: DataFrame, key: str, tokens: Column, least_df: int = 1) -> DataFrame:
    """(term, df, tfidf_avg): documents with each term and its mean weight over all texts that have terms."""
    counts = term_counts(df, key, tokens)
    w = weights(counts, key, least_df)
    n = df.filter(F.size(tokens) > 0).count()
    return w.groupBy("term").agg(F.max("df").alias("df"), (F.sum("w") / F.lit(max(n, 1))).alias("tfidf_avg"))


def equal_texts(counts: DataFrame, key: str) -> DataFrame:
    """(key, rep): each text with the least key of the texts with the same terms as often; compared by 96 bits of hash."""
    mark = F.array_sort(F.collect_list(F.struct("term", "c")))
    d = counts.groupBy(key).agg(mark.alias("_t")).select(key, F.xxhash64("_t").alias("_a"), F.hash("_t").alias("_b"))
    return d.join(d.groupBy("_a", "_b").agg(F.min(key).alias("rep")), ["_a", "_b"]).select(key, "rep")


#: Texts of a block: each pair of blocks is looked at in one task, so that candidates are never sent or written.
BLOCK = 1 << 14
#: Candidates of a block pair that are listed at once.
AT_ONCE = 1 << 19


def _packed(table: pa.Table) -> dict[str, np.ndarray]:
    """A block's texts in order of key: keys, where each one's terms begin, the terms, weights, lengths of the rest from each term on."""
    table = table.take(pa.array(np.argsort(table.column("k").to_numpy(), kind="stable")))
    lists = table.column("t").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    begin = lists.offsets.to_numpy().astype(np.int64)
    begin -= begin[0]
    flat = lists.flatten()
    w = flat.field("w").to_numpy()
    total = np.concatenate([[0.0], np.cumsum(w * w)])
    rest = np.sqrt(np.maximum(np.repeat(total[begin[1:]], np.diff(begin)) - total[:-1], 0.0))
    return {"k": table.column("k").to_numpy(), "begin": begin, "h": flat.field("h").to_numpy(), "w": w, "rest": rest}


def _near(x: dict, y: dict, same: bool, threshold: float, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, similarity) of the pairs of `threshold` or more; with same only those of y before x.

    The first term that a pair shares (terms rarest first) bounds its cosine by the product of the lengths of both rests from there
    on, and the number of shared terms by that of either rest.
    """
    least = (threshold + share - 1) / share - 1e-9
    names, code = np.unique(np.concatenate([x["h"], y["h"]]), return_inverse=True)
    cx, cy = code[: len(x["h"])], code[len(x["h"]) :]
    nx, ny = np.diff(x["begin"]), np.diff(y["begin"])
    rx, ry = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    left_x, left_y = np.repeat(x["begin"][1:], nx) - np.arange(len(cx)), np.repeat(y["begin"][1:], ny) - np.arange(len(cy))
    px, py = np.flatnonzero(x["rest"] >= least), np.flatnonzero(y["rest"] >= least)
    place = 2.0 * cy[py] + np.maximum(1 - y["rest"][py], 0)
    order = np.argsort(place, kind="stable")
    place, py = place[order], py[order]
    low = np.searchsorted(place, 2.0 * cx[px] - 0.5)
    many = np.searchsorted(place, 2.0 * cx[px] + np.minimum(1 - least / x["rest"][px], 1) + 1e-6) - low
    bounds = np.cumsum(np.bincount(rx[px], many, len(nx)).astype(np.int64))
    dense, out, start = np.zeros(len(names)), [], 0
    where = np.searchsorted(rx[px], np.arange(len(nx) + 1))
    while start < len(nx):
        # Whole rows of x, at least one.
        stop = max(start + 1, int(np.searchsorted(bounds, (bounds[start - 1] if start else 0) + AT_ONCE, side="right")))
        p = np.arange(where[start], where[stop])
        n = many[p]
        i = np.repeat(px[p], n)
        j = py[np.repeat(low[p], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        a, b = rx[i], ry[j]
        ok = share * x["rest"][i] * y["rest"][j] + (1 - share) * np.minimum(left_x[i], left_y[j]) / np.minimum(nx[a], ny[b]) >= threshold - 1e-9
        if same:
            ok &= b < a
        pairs = np.unique(a[ok] * np.int64(len(ny)) + b[ok])
        a, b = pairs // max(len(ny), 1), pairs % max(len(ny), 1)
        edges = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            mine = slice(x["begin"][a[s]], x["begin"][a[s] + 1])
            dense[cx[mine]] = x["w"][mine]
            size = ny[b[s:e]]
            first = np.cumsum(size) - size
            at = np.repeat(y["begin"][b[s:e]] - first, size) + np.arange(size.sum())
            got = dense[cy[at]]
            similarity = np.add.reduceat(got * y["w"][at], first)
            if share < 1:
                similarity = share * similarity + (1 - share) * np.add.reduceat((got > 0).astype(np.int64), first) / np.minimum(nx[a[s]], size)
            dense[cx[mine]] = 0
            keep = np.flatnonzero(similarity >= threshold)
            if len(keep):
                out.append((a[s:e][keep], b[s:e][keep], similarity[keep]))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _pairs(vectors: DataFrame, key: str, term: Column, threshold: float, share: float) -> DataFrame:
    kind = vectors.schema[key].dataType.simpleString()
    spark = vectors.sparkSession
    texts = vectors.select(F.col(key).alias("k"), F.xxhash64(term).alias("h"), "w", "df").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "h", "w"))).alias("t"))
    texts = materialize(texts.select("k", F.transform("t", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("t")), "vectors")
    n = max(1, -(-texts.count() // BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        import io

        to = io.BytesIO()
        np.savez(to, **_packed(table.select(["k", "t"])))
        return pa.table({"block": table.column("block")[:1].cast(pa.int64()), "data": pa.array([to.getvalue()], pa.binary())})

    blocks = texts.withColumn("block", F.expr(f"pmod(xxhash64(k), {n}L)")).groupBy("block").applyInArrow(pack, "block bigint, data binary")
    blocks = materialize(blocks, "blocks")

    def run(batches):
        import io

        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (dict(np.load(io.BytesIO(batch.column(c)[r].as_py()))) for c in ("x", "y"))
                a, b, s = _near(x, y, batch.column("i")[r].as_py() == batch.column("j")[r].as_py(), threshold, share)
                a, b = x["k"][a], y["k"][b]
                yield from pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s}).to_batches(max_chunksize=1 << 16)

    # Each task reads the blocks of its pairs where they lie. The batches hold one pair each.
    left, right = blocks.toDF("i", "x"), blocks.toDF("j", "y")
    both = left.hint("shuffle_replicate_nl").join(right, F.col("j") <= F.col("i"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        return materialize(both.mapInArrow(run, f"a {kind}, b {kind}, similarity double"), "pairs")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def cosine_pairs(vectors: DataFrame, key: str, threshold: float, group: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of cosine `threshold` or more of sparse vectors (key, term, w, df) of length one; with
    group only pairs of one group. Keys are integers; terms are compared by 64 bits of hash.

    Texts are dealt to blocks, which are written once; each pair of blocks is joined in one task by the terms that bound the cosine.
    """
    # A term of a group is a term of its own.
    term = F.concat_ws("\x1f", F.col(group).cast("string"), "term") if group else F.col("term")
    return _pairs(vectors, key, term, threshold, 1.0)


def blended_pairs(vectors: DataFrame, key: str, threshold: float, share: float = 0.6) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of `threshold` or more of share x cosine + (1 - share) x containment, the part of the text
    with fewer distinct terms whose terms the other has (pairs without a common term are left out)."""
    return _pairs(vectors, key, F.col("term"), threshold, share)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
