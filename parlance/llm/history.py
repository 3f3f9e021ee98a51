"""New batches against everything accepted before (problem 7).

The accepted history is a folder of append-only tables, bucketed on disk by hash (`CLUSTERED BY ... INTO n BUCKETS`):

* `content`: digests of the texts without outer blanks, by digest;
* `paragraphs`: one row per paragraph hash and text, by paragraph. A paragraph is a k-word run; of each distinct set of paragraphs
  those are kept that a near copy may share first, in an order fixed when the history begins (frequent ones last), each with the
  set's id, size, position and odd sketch of the paragraphs behind it;
* `sets`: the paragraphs of each distinct set (6 bytes each), by the set's id, a digest of it;
* `files`: resolved paths, by path.

A batch is compared with these tables only, never with the old texts. Each comparison is a join within buckets: the batch's hashes
are dealt to the buckets, the history's side is read where it lies and never shuffled.

* full copies: a semi-join of content digests;
* near copies: a join on paragraph hashes that keeps pairs whose positions and sketches fit the error budget (see `neardup`, it
  drops no near copy); then coverage is counted on the paragraphs of both sides;
* several batches are decided at once, as if one after the other: within the new items the verdicts are the fixed point of
  "accepted if all earlier neighbours are rejected, rejected if one is accepted", worked out in rounds over the links.

`accept` appends what was accepted. Paragraphs that very many sets share are salted over buckets: the number of salts of a paragraph
only grows, and a batch asks all of them.

Items with equal paragraph sets are one node (its first item speaks for it), so repeats cause no pairs among themselves.

Defined results: a null or blank path repeats no file; a null text equals no text and is accepted; blank texts equal each other;
repeated rows are decided each in their turn; an empty history or empty batches give no rejections; extra columns are ignored. Two
sets of one 64-bit id are both compared, so that a clash of ids changes no verdict.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import neardup
from parlance.llm.hashing import HEAVY, U64, counts_of, heavy, mix
from parlance.session import materialize

#: Sets that share one salt of a paragraph, at most about so many.
SALT = 1 << 16


def resolve(path: str | None) -> str | None:
    """A path with / for \\ and without `.`, `..` and doubled /; null if blank."""
    if path is None or not path.strip():
        return None
    p = posixpath.normpath(path.replace("\\", "/"))
    return "/" + p.lstrip("/") if p.startswith("//") else p


def digest(text: str | None) -> bytes | None:
    """128-bit digest of a text without outer blanks."""
    return None if text is None else xxhash.xxh3_128_digest(text.strip().encode("utf-8", "surrogatepass"))


def _with(df: DataFrame, column: str, to: str, f, kind: str, drop: bool = True) -> DataFrame:
    """df with a column computed by f from another one, in Arrow batches."""
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if not (drop and x.name == column)] + [f"{to} {kind}"])
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [c for c in b.schema.names if not (drop and c == column)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([f(x) for x in b.column(column).to_pylist()], arrow)], names=[*keep, to])

    return df.mapInArrow(run, schema)


def _set_id() -> F.Column:
    """A 48-bit id of a set: of its digest."""
    return F.shiftrightunsigned(F.xxhash64("cls"), 16)


class History:
    """The accepted history in a folder."""

    _TABLES = {
        "content": ("hash BINARY", "hash"),
        "paragraphs": ("key BIGINT, id BIGINT, meta BIGINT, s0 BIGINT, s1 BIGINT", "key"),
        "sets": ("id BIGINT, n INT, set BINARY, part INT", "id"),
        "files": ("path STRING", "path"),
        # Not bucketed: bounded summaries of the frequent paragraphs of each append; those of the first fix the order.
        "frequent": ("part INT, member BIGINT, n BIGINT, shared BIGINT", None),
    }

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8, k: int = 5, least_words: int = 20, buckets: int | None = None) -> None:
        """buckets: of the tables, as long as they live; as many as there are shuffle partitions if it is not given."""
        self.spark, self.path = spark, path
        self.threshold, self.k, self.least_words = threshold, k, least_words
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "history_" + xxhash.xxh3_64_hexdigest(path)
        for name, (columns, by) in self._TABLES.items():
            place = f"CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS" if by else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{name} ({columns}) USING parquet OPTIONS (compression 'zstd') {place} LOCATION '{path}/{name}'")

    # Tables ----------------------------------------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        """Each bucket of what is appended is one file."""
        by = self._TABLES[name][1]
        rows = df.select(*self.table(name).columns)
        (rows.repartition(self.buckets, by).sortWithinPartitions(by) if by else rows.coalesce(1)).write.insertInto(f"{self.name}_{name}")

    def _order(self) -> neardup.Summary:
        """The frequent paragraphs that fix the order: bounded by the size of a summary."""
        rows = self.table("frequent").filter((F.col("part") == 0) & (F.col("n") > 0)).select("member", "n").toPandas()
        at = rows["member"].to_numpy(dtype=np.int64).view(U64)
        order = np.argsort(at)
        return at[order], rows["n"].to_numpy(dtype=np.int64)[order]

    def _salts(self) -> neardup.Summary:
        """The paragraphs that more than SALT sets have in front, and the sets: the HEAVY most frequent at most."""
        total = self.table("frequent").groupBy("member").agg(F.sum("shared").alias("n")).filter(F.col("n") > SALT)
        rows = total.orderBy(F.desc("n"), "member").limit(HEAVY).toPandas()
        at = rows["member"].to_numpy(dtype=np.int64).view(U64)
        order = np.argsort(at)
        return at[order], rows["n"].to_numpy(dtype=np.int64)[order]

    def _fronts(self, sets: DataFrame, ask: bool, carry: str = "id") -> DataFrame:
        """(key, id, meta, s0, s1) of the paragraphs in front of each set: to be kept, or (ask) to be looked up under all salts."""
        sc = self.spark.sparkContext
        order, salted, threshold = sc.broadcast(self._order()), sc.broadcast(self._salts()), self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                o = neardup.Ordered(b, order.value, threshold)
                ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                m, r, sk = o.m[o.at], o.row[o.at], o.sketches()[:, :2]
                salts = np.maximum(-(-counts_of(salted.value, m) // SALT), 1)
                if ask:
                    at = np.repeat(np.arange(len(m)), salts)
                    salt = (np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(U64)
                else:
                    at, salt = np.arange(len(m)), mix(ids[r].view(U64) ^ m) % salts.astype(U64)
                key = mix(m[at] ^ mix(salt)) >> U64(16)
                meta = (o.n[r[at]] << 32) | o.pos[o.at][at]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[r[at]]), pa.array(meta), *[pa.array(np.ascontiguousarray(sk[at, i]).view(np.int64)) for i in (0, 1)]], names=["key", "id", "meta", "s0", "s1"])

        return sets.select("id", "n", "set").mapInArrow(run, "key bigint, id bigint, meta bigint, s0 bigint, s1 bigint")

    def add_texts(self, df: DataFrame, key: str, text: str) -> None:
        """Appends the digests and paragraphs of accepted texts."""
        rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
        hashes = _with(rows.select("text"), "text", "hash", digest, "binary").distinct()
        self._append("content", hashes.join(self.table("content"), "hash", "left_anti"))
        # Equal sets are one; where they are read already, so that copies meet in no task.
        sets = neardup.text_sets(rows, "id", "text", self.k, self.least_words).select(_set_id().alias("id"), "n", "set")
        sets = sets.groupBy("id").agg(F.first("n").alias("n"), F.first("set").alias("set")).join(self.table("sets").select("id"), "id", "left_anti")
        part = (self.table("sets").agg(F.max("part")).first()[0] or 0) + 1
        self._append("sets", sets.withColumn("part", F.lit(part)))
        new = self.table("sets").filter(F.col("part") == part)
        began = not self.table("frequent").isEmpty()
        members, n = self._order() if began else neardup.frequent_members(new)
        if not began:
            self._append("frequent", self._frequent(0, members, n, np.zeros(len(n), dtype=np.int64)))
        order, threshold = self.spark.sparkContext.broadcast((members, n)), self.threshold
        found, shared = heavy(new.select("n", "set"), lambda b: (lambda o: o.m[o.at])(neardup.Ordered(b, order.value, threshold)))
        self._append("frequent", self._frequent(part, found, np.zeros(len(found), dtype=np.int64), shared))
        self._append("paragraphs", self._fronts(new, False))

    def _frequent(self, part: int, members: np.ndarray, n: np.ndarray, shared: np.ndarray) -> DataFrame:
        rows = pa.table({"part": pa.array([part] * len(members), pa.int32()), "member": pa.array(members.view(np.int64)), "n": pa.array(n), "shared": pa.array(shared)})
        return self.spark.createDataFrame(rows) if len(members) else self.spark.createDataFrame([(part, 0, 0, 0)], "part int, member bigint, n bigint, shared bigint")

    def add_files(self, df: DataFrame, path: str) -> None:
        """Appends the resolved paths of files that were read."""
        rows = _with(df.select(F.col(path).alias("raw")), "raw", "path", resolve, "string").filter(F.col("path").isNotNull()).distinct()
        self._append("files", rows.join(self.table("files"), "path", "left_anti"))

    # Decision --------------------------------------------------------------------------------------------------------------
    def decide(self, items: DataFrame, item: str = "item_id", batch: str = "batch_no", path: str = "file_path", text: str = "text") -> DataFrame:
        """(batch_no, item_id, verdict): `file`, `exact` or `near` for rejected items, `accepted` for the others."""
        new = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(batch).cast("bigint").alias("batch_no"), F.col(path).alias("raw"), F.col(text).alias("text"))
        new = _with(_with(new, "raw", "path", resolve, "string"), "text", "hash", digest, "binary", drop=False)
        # Paths: known files, or the same path in an earlier batch.
        first = new.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min("batch_no").alias("first_batch"))
        files = self.table("files").withColumn("known", F.lit(True))
        new = new.join(first, "path", "left").join(files, "path", "left")
        new = new.withColumn("file", F.coalesce("known", F.lit(False)) | F.coalesce(F.col("first_batch") < F.col("batch_no"), F.lit(False)))
        new = new.join(self.table("content").withColumn("copied", F.lit(True)), "hash", "left")
        new = materialize(new.select("item_id", "batch_no", "hash", "file", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(~F.col("file") & F.col("copied").isNull(), F.col("text")).alias("text")), "items")
        kept = new.filter(~F.col("file") & ~F.col("copied"))

        sets = materialize(neardup.text_sets(kept, "item_id", "text", self.k, self.least_words, carry=("batch_no",)), "item_sets")
        rank = F.struct("batch_no", "id")
        # The first item of each set is its node.
        nodes = materialize(sets.groupBy("cls").agg(F.min_by("id", rank).alias("node"), F.min("batch_no").alias("node_batch")), "nodes")
        edges, old = self._edges(sets, nodes)
        status = self._rounds(nodes, edges, old)

        # Texts that are too short for paragraphs: the first of each digest is accepted.
        of = sets.select(F.col("id").alias("item_id"), "cls").join(nodes.select("cls", "node"), "cls").select("item_id", "node")
        rows = kept.select("item_id", "batch_no", "hash").join(of, "item_id", "left").join(status, "node", "left")
        heads = rows.filter(F.col("item_id") == F.col("node")).select("node", F.col("hash").alias("head"))
        rows = rows.join(heads, "node", "left")
        lead = rows.filter(F.col("node").isNull() & F.col("hash").isNotNull()).groupBy("hash").agg(F.min(F.struct("batch_no", "item_id")).alias("lead"))
        rows = rows.join(lead, "hash", "left")
        verdict = (
            F.when(F.col("node").isNull(), F.when(F.col("hash").isNull() | (F.col("lead.item_id") == F.col("item_id")), "accepted").otherwise("exact"))
            .when(F.col("near"), "near")
            .when(F.col("item_id") == F.col("node"), "accepted")
            .when(F.col("hash") == F.col("head"), "exact")
            .otherwise("near")
        )
        fixed = new.filter(F.col("file") | F.col("copied")).select("batch_no", "item_id", F.when(F.col("file"), "file").otherwise("exact").alias("verdict"))
        return rows.select("batch_no", "item_id", verdict.alias("verdict")).unionByName(fixed)

    def _edges(self, sets: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links between nodes (a, b), nodes that are near a text of the history (node))."""
        heads = materialize(sets.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").select("id", "n", "set"), "heads")
        size, pos = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)))
        asked = self._fronts(heads, True).toDF("key", "a", "meta_a", "s0_a", "s1_a")
        differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_a"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_a")))
        # Paragraphs in front differ; of those behind at least as many do as sketches do, or as one side has more of.
        n, m, x, y = size(F.col("meta")), size(F.col("meta_a")), pos(F.col("meta")), pos(F.col("meta_a"))
        errors = F.greatest(differ.cast("bigint"), F.abs((n - x) - (m - y))) + x + y
        rate = (1 - self.threshold) / (1 + self.threshold)
        met = asked.join(self.table("paragraphs"), "key").filter(errors <= rate * (n + m) + 1e-9)
        pairs = materialize(met.select("a", F.col("id").alias("b")).distinct(), "candidates")
        # Coverage is counted where the history's sets lie: only those that were met are read on.
        both = pairs.join(heads.toDF("a", "na", "sa"), "a").join(self.table("sets").select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb")), "b")
        old = materialize(neardup.compare(both, self.threshold).select(F.col("a").alias("node")).distinct(), "old")
        # Nodes near the history are decided and decide nothing.
        open_ = materialize(heads.join(old.withColumnRenamed("node", "id"), "id", "left_anti"), "open")
        found = neardup.trie_pairs(neardup.roots(open_, self.threshold), self.threshold).distinct()
        return neardup.verify(found, open_, self.threshold).select("a", "b"), old

    def _rounds(self, nodes: DataFrame, edges: DataFrame, old: DataFrame) -> DataFrame:
        """(node, near): whether each node is near the history or an accepted earlier node."""
        at = nodes.select("node", "node_batch")
        ranked = edges.join(at.toDF("a", "ba"), "a").join(at.toDF("b", "bb"), "b")
        before = F.struct("ba", "a") < F.struct("bb", "b")
        links = ranked.select(F.when(before, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(before, F.col("a")).otherwise(F.col("b")).alias("earlier")).distinct()
        links = materialize(links, "links")
        rejected = old
        while not links.isEmpty():
            # Nodes of the graph without an open earlier link are accepted; their later neighbours are rejected.
            accepted = links.select("earlier").distinct().join(links.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
            out = materialize(links.join(accepted, "earlier", "left_semi").select(F.col("later").alias("node")).distinct(), "rejected")
            rejected = rejected.unionByName(out)
            gone = out.select(F.col("node").alias("later"))
            # Links out of rejected nodes no longer count, nor do those into them.
            rest = links.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
            links = materialize(rest, "links")
        return nodes.select("node").join(rejected.select("node", F.lit(True).alias("near")), "node", "left").select("node", F.coalesce("near", F.lit(False)).alias("near"))

    def accept(self, items: DataFrame, verdicts: DataFrame, item: str = "item_id", path: str = "file_path", text: str = "text") -> None:
        """Appends the files of all decided items and the texts of the accepted ones."""
        self.add_files(items, path)
        ids = verdicts.filter(F.col("verdict") == "accepted").select(F.col("item_id").alias(item))
        self.add_texts(items.join(ids, item, "left_semi"), item, text)
