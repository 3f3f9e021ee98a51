"""Queries of the relational core, text features, sessions, periods and similarity, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import features, text
from parlance.operators import graph, periods, ranks, sessions, stores, tfidf
from parlance.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(c) -> F.Column:
    return F.count(F.lit(1)) if c is None else c.cast("bigint")


def r6(c):
    return F.round(c, 6)


_STRIP = r"regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


# Scans, filters, stores -----------------------------------------------------------------------------------------------------------
@query(f"""
SELECT source, count(*) AS n_rows, count(*) FILTER (n = 1) AS n_unique, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM (SELECT source, text, row_number() OVER (PARTITION BY sha256({_STRIP}) ORDER BY id) AS n FROM prompts WHERE text IS NOT NULL) GROUP BY source""")
def exact_dedup_by_source(spark: SparkSession, d: str) -> DataFrame:
    """First occurrence per hash of the stripped text."""
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("id", "source", F.length("text").alias("n"), text.content_hash(F.col("text")).alias("h"))
    first = p.groupBy("h").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    return p.join(first, ["h", "id"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("first").alias("n_unique"), F.sum("n").cast("bigint").alias("n_chars"))


@query(f"""
SELECT b.source, count(*) AS n_new FROM (
  SELECT source, item_id, h, row_number() OVER (PARTITION BY h ORDER BY item_id) AS n FROM (SELECT *, sha256({_STRIP}) AS h FROM prompt_batches WHERE text IS NOT NULL)) b
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT sha256({_STRIP}) AS h FROM prompts WHERE text IS NOT NULL) p WHERE p.h = b.h) GROUP BY b.source""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the batches that the prompts lack, by hash."""
    h = text.content_hash(F.col("text"))
    store = read_table(spark, d, "prompts").filter("text IS NOT NULL").select(h.alias("h"))
    rows = read_table(spark, d, "prompt_batches").filter("text IS NOT NULL").select("item_id", "source", h.alias("h"))
    return stores.insert_if_absent(store, rows, "h", ["item_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_new"))


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (duplicate_of IS NULL) AS n_unique, count(DISTINCT session_id) AS n_sessions, count(DISTINCT nullif(trim(project), '')) AS n_projects,
  epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS last_us FROM prompts""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts")
    return p.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("duplicate_of").isNull()).alias("n_unique"),
        F.countDistinct("session_id").alias("n_sessions"),
        F.countDistinct(F.nullif(F.trim("project"), F.lit(""))).alias("n_projects"),
        F.unix_micros(F.min("ingested_at").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.max("ingested_at").cast("timestamp")).alias("last_us"),
    )


@query("""
SELECT id, source, length(text) AS n_chars FROM prompts WHERE duplicate_of IS NULL AND text ILIKE '%ledger%' ORDER BY ingested_at DESC NULLS LAST, id DESC LIMIT 20""")
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 of the newest rows with a keyword (a top-k search)."""
    p = read_table(spark, d, "prompts").filter(F.col("duplicate_of").isNull() & F.col("text").ilike("%ledger%"))
    return p.orderBy(F.desc_nulls_last("ingested_at"), F.desc("id")).limit(20).select("id", "source", F.length("text").cast("bigint").alias("n_chars"))


@query("""
SELECT source, count(*) AS n, CAST(min(id) AS BIGINT) AS first_id FROM prompts
WHERE ingested_at >= TIMESTAMP '2025-01-01' AND ingested_at < TIMESTAMP '2025-07-01' AND source <> '' GROUP BY source""")
def time_range_by_source(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter((F.col("ingested_at") >= F.lit("2025-01-01").cast("timestamp_ntz")) & (F.col("ingested_at") < F.lit("2025-07-01").cast("timestamp_ntz")) & (F.col("source") != ""))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""SELECT b.source, count(*) AS n_items, count(DISTINCT b.file_path) AS n_files FROM prompt_batches b
WHERE NOT EXISTS (SELECT 1 FROM processed_sessions s WHERE s.file_path = b.file_path) GROUP BY b.source""")
def unprocessed_files(spark: SparkSession, d: str) -> DataFrame:
    """Anti-join against the ledger of files."""
    rows = stores.unprocessed(read_table(spark, d, "prompt_batches"), read_table(spark, d, "processed_sessions"), "file_path")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("file_path").alias("n_files"))


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 48) GROUP BY o_orderpriority""")
def semi_and_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    back, large = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), li.filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = o.join(back, "o_orderkey", "left_semi").join(large, "o_orderkey", "left_anti")
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT n_name, r_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name, r_name""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Facts with four dimensions; the facts are pre-aggregated by customer before the small dimensions join."""
    li, o = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    by = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    out = by.join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return out.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_lines"), F.round(F.sum("rev"), 2).alias("revenue"))


@query("""
WITH new AS (SELECT source, project, text FROM (SELECT *, row_number() OVER (PARTITION BY source, project ORDER BY item_id DESC) AS n FROM prompt_batches WHERE project IS NOT NULL) WHERE n = 1),
old AS (SELECT source, project, text FROM (SELECT *, row_number() OVER (PARTITION BY source, project ORDER BY id DESC) AS n FROM prompts WHERE project IS NOT NULL) WHERE n = 1)
SELECT coalesce(n.source, o.source) AS source, count(*) AS n_projects, CAST(sum(length(coalesce(n.text, o.text))) AS BIGINT) AS n_chars, count(n.source) AS n_updated
FROM old o FULL JOIN new n ON o.source = n.source AND o.project = n.project GROUP BY 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest text by source and project, replaced by that of the batches."""
    last = lambda t, k: stores.first_per_key(read_table(spark, d, t).filter("project IS NOT NULL"), ["source", "project"], [F.desc(k)])
    store = last("prompts", "id").select("source", "project", "text", F.lit(0).alias("new"), F.col("id").alias("k"))
    rows = read_table(spark, d, "prompt_batches").filter("project IS NOT NULL").select("source", "project", "text", F.lit(1).alias("new"), F.col("item_id").alias("k"))
    out = stores.upsert(store, rows, ["source", "project"], ["k"])
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n_projects"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.sum("new").cast("bigint").alias("n_updated"))


@query("""
WITH gone AS (SELECT id FROM prompts WHERE ingested_at < TIMESTAMP '2025-01-01'), kept AS (SELECT * FROM prompts WHERE ingested_at IS NULL OR ingested_at >= TIMESTAMP '2025-01-01')
SELECT source, count(*) AS n, count(CASE WHEN duplicate_of NOT IN (SELECT id FROM gone) THEN duplicate_of END) AS n_refs FROM kept GROUP BY source""")
def purge_by_age(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").select("id", "source", "duplicate_of", "ingested_at")
    out = stores.purge(p, "id", "duplicate_of", "ingested_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("duplicate_of").alias("n_refs"))


# Aggregates -------------------------------------------------------------------------------------------------------------------------
@query("""
SELECT project, count(DISTINCT session_id) AS n_sessions, count(*) AS n_prompts, round(avg(effectiveness_score), 8) AS avg_eff, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  epoch_us(min(ingested_at)) AS first_us, epoch_us(max(ingested_at)) AS last_us FROM prompts WHERE trim(coalesce(project, '')) <> '' GROUP BY project""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter(F.trim(F.coalesce("project", F.lit(""))) != "")
    return p.groupBy("project").agg(
        F.countDistinct("session_id").alias("n_sessions"),
        F.count(F.lit(1)).alias("n_prompts"),
        F.round(F.avg("effectiveness_score"), 8).alias("avg_eff"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.unix_micros(F.min("ingested_at").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.max("ingested_at").cast("timestamp")).alias("last_us"),
    )


@query("SELECT coalesce(task_type, '') AS task_type, count(*) AS n FROM telemetry_event GROUP BY 1")
def task_type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "telemetry_event").groupBy(F.coalesce("task_type", F.lit("")).alias("task_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT * FROM telemetry_event), m AS (SELECT task_type FROM t WHERE task_type IS NOT NULL GROUP BY task_type ORDER BY count(*) DESC, min(queue_id) LIMIT 1)
SELECT count(*) AS n, round(avg(score_total), 8) AS avg_total, round(max(score_total), 4) AS max_total, round(avg(score_structure), 8) AS avg_structure, round(avg(score_context), 8) AS avg_context,
round(avg(score_position), 8) AS avg_position, round(avg(score_repetition), 8) AS avg_repetition, round(avg(score_clarity), 8) AS avg_clarity, (SELECT task_type FROM m) AS mode_task FROM t""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the scores and the most frequent task, the one seen first of equal ones."""
    t = read_table(spark, d, "telemetry_event")
    parts = ["structure", "context", "position", "repetition", "clarity"]
    by = t.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.min("queue_id").alias("first"), F.sum("score_total").alias("s"), F.count("score_total").alias("c"), F.max("score_total").alias("m"), *[F.sum(f"score_{p}").alias(f"s_{p}") for p in parts], *[F.count(f"score_{p}").alias(f"c_{p}") for p in parts])
    return by.agg(
        F.sum("n").alias("n"),
        F.round(F.sum("s") / F.sum("c"), 8).alias("avg_total"),
        F.round(F.max("m"), 4).alias("max_total"),
        *[F.round(F.sum(f"s_{p}") / F.sum(f"c_{p}"), 8).alias(f"avg_{p}") for p in parts],
        F.max_by("task_type", F.when(F.col("task_type").isNotNull(), F.struct("n", -F.col("first")))).alias("mode_task"),
    )


_BIN = "CASE WHEN score_total <= 20 THEN '0-20' WHEN score_total <= 40 THEN '20-40' WHEN score_total <= 60 THEN '40-60' WHEN score_total <= 80 THEN '60-80' ELSE '80-100' END"


@query(f"""SELECT source, {_BIN} AS bin, count(*) AS n, round(avg(effectiveness_score), 8) AS avg_eff FROM telemetry_event WHERE score_total IS NOT NULL GROUP BY 1, 2""")
def score_bins(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telemetry_event").filter("score_total IS NOT NULL")
    return t.groupBy("source", F.expr(_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("effectiveness_score"), 8).alias("avg_eff"))


@query("""
WITH a AS (SELECT source, task_type, round(avg(score_total), 6) AS v, count(*) AS n FROM telemetry_event WHERE task_type IS NOT NULL AND score_total IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT source, first(task_type ORDER BY v DESC, task_type) AS best_type, first(task_type ORDER BY v, task_type) AS worst_type, round(max(v), 4) AS best, round(min(v), 4) AS worst FROM a GROUP BY source""")
def best_and_worst_type(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telemetry_event").filter("task_type IS NOT NULL AND score_total IS NOT NULL")
    a = t.groupBy("source", "task_type").agg(r6(F.avg("score_total")).alias("v"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return a.groupBy("source").agg(
        F.min(F.struct(-F.col("v"), "task_type"))["task_type"].alias("best_type"),
        F.min(F.struct("v", "task_type"))["task_type"].alias("worst_type"),
        F.round(F.max("v"), 4).alias("best"),
        F.round(F.min("v"), 4).alias("worst"),
    )


@query("""
WITH s AS (SELECT session_id, id, effectiveness_score AS v FROM prompts WHERE effectiveness_score IS NOT NULL AND len(string_split_regex(trim(text), '\\s+')) >= 5)
SELECT session_id, first(id ORDER BY v DESC, id) AS best_id, first(id ORDER BY v, id) AS worst_id, count(*) AS n FROM s GROUP BY session_id HAVING count(*) >= 2""")
def best_and_worst_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter(F.col("effectiveness_score").isNotNull() & (F.size(F.split(F.trim("text"), r"\s+")) >= 5))
    g = p.groupBy("session_id").agg(F.min(F.struct(-F.col("effectiveness_score"), "id"))["id"].alias("best_id"), F.min(F.struct("effectiveness_score", "id"))["id"].alias("worst_id"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 2")


@query("""
WITH r AS (SELECT source, score_total AS x, effectiveness_score AS y, row_number() OVER (PARTITION BY source ORDER BY score_total, queue_id) AS rx, row_number() OVER (PARTITION BY source ORDER BY effectiveness_score, queue_id) AS ry
FROM telemetry_event WHERE score_total IS NOT NULL AND effectiveness_score IS NOT NULL)
SELECT source, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY source HAVING count(*) >= 3""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson, and Spearman on ordinal ranks."""
    t = read_table(spark, d, "telemetry_event").filter("score_total IS NOT NULL AND effectiveness_score IS NOT NULL").select("source", "queue_id", F.col("score_total").alias("x"), F.col("effectiveness_score").alias("y"))
    r = ranks.ranked(ranks.ranked(t, ["source"], ["x", "queue_id"], "rx"), ["source"], ["y", "queue_id"], "ry")
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("x", "y")).alias("pearson"), r6(F.corr("rx", "ry")).alias("spearman")).filter("n >= 3")


@query("""
SELECT source, round(avg(score_total) FILTER (task_type = 'debug'), 8) AS debug, round(avg(score_total) FILTER (task_type = 'implement'), 8) AS implement,
round(avg(score_total) FILTER (task_type = 'explain'), 8) AS explain, round(avg(score_total) FILTER (task_type = 'refactor'), 8) AS refactor FROM telemetry_event GROUP BY source""")
def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["debug", "implement", "explain", "refactor"]
    p = read_table(spark, d, "telemetry_event").groupBy("source").pivot("task_type", kinds).agg(F.round(F.avg("score_total"), 8))
    return p


@query("""
WITH w AS (SELECT DISTINCT source, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 2)) AS word FROM prompts WHERE text IS NOT NULL)
SELECT source, count(*) AS vocabulary FROM w GROUP BY source""")
def vocabulary_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("source", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter(F.length("word") > 2)
    return w.distinct().groupBy("source").agg(F.count(F.lit(1)).alias("vocabulary"))


@query("""
WITH c AS (SELECT source, task_type, count(*) AS c FROM telemetry_event WHERE task_type IS NOT NULL GROUP BY 1, 2), g AS (SELECT source, sum(c) AS n, count(*) AS k, sum(c * log2(c)) AS cl FROM c GROUP BY source)
SELECT source, k AS n_labels, round(CASE WHEN k > 1 THEN (log2(n) - cl / n) / log2(k) ELSE 0 END, 6) AS entropy FROM g""")
def task_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = periods.entropy(read_table(spark, d, "telemetry_event").filter("task_type IS NOT NULL"), ["source"], "task_type")
    return e.select("source", "n_labels", r6(F.col("entropy")).alias("entropy"))


@query("""
WITH o AS (SELECT source, effectiveness_score AS v, row_number() OVER (PARTITION BY source ORDER BY ingested_at, id) AS n, count(*) OVER (PARTITION BY source) AS c FROM prompts WHERE effectiveness_score IS NOT NULL)
SELECT source, round(avg(v) FILTER (n <= c // 2), 6) AS older, round(avg(v) FILTER (n > c // 2), 6) AS newer FROM o WHERE c >= 10 GROUP BY source""")
def older_and_newer_half(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("effectiveness_score IS NOT NULL")
    o = ranks.ranked(p.select("source", "ingested_at", "id", "effectiveness_score"), ["source"], ["ingested_at", "id"], "no", "n").filter("n >= 10")
    half = F.expr("n div 2")
    return o.groupBy("source").agg(r6(F.avg(F.when(F.col("no") <= half, F.col("effectiveness_score")))).alias("older"), r6(F.avg(F.when(F.col("no") > half, F.col("effectiveness_score")))).alias("newer"))


@query("""
WITH w AS (SELECT source, lower(regexp_extract(trim(text), '^\\S+')) AS first_word, min(id) AS seen, count(*) AS n FROM prompts WHERE trim(coalesce(text, '')) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM w) SELECT source, first_word, n, k AS rank FROM r WHERE k <= 5""")
def top_first_words(spark: SparkSession, d: str) -> DataFrame:
    """Five most frequent first words by source; of equal ones those seen first."""
    p = read_table(spark, d, "prompts").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = p.groupBy("source", F.lower(F.regexp_extract(F.trim("text"), r"^\S+", 0)).alias("first_word")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "seen"))
    return w.withColumn("rank", k.cast("bigint")).filter("rank <= 5").select("source", "first_word", "n", "rank")


@query("""
SELECT source, round(avg(length(text)), 8) AS avg_chars, count(*) FILTER (length(text) < 30) AS tiny, count(*) FILTER (length(text) >= 30 AND length(text) < 80) AS short,
count(*) FILTER (length(text) >= 80 AND length(text) < 200) AS medium, count(*) FILTER (length(text) >= 200) AS long, round(median(length(text)), 2) AS median_chars FROM prompts WHERE text IS NOT NULL GROUP BY source""")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").withColumn("n", F.length("text"))
    return p.groupBy("source").agg(
        F.round(F.avg("n"), 8).alias("avg_chars"),
        F.count_if(F.col("n") < 30).alias("tiny"),
        F.count_if(F.col("n").between(30, 79)).alias("short"),
        F.count_if(F.col("n").between(80, 199)).alias("medium"),
        F.count_if(F.col("n") >= 200).alias("long"),
        F.round(F.median("n"), 2).alias("median_chars"),
    )


@query("""SELECT session_id, count(*) AS n, count(DISTINCT source) AS n_sources FROM prompts GROUP BY session_id HAVING count(*) >= 10""")
def busy_sessions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "prompts").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources")).filter("n >= 10")


@query("""
SELECT coalesce(source, 'all') AS source, coalesce(task_type, 'all') AS task_type, count(*) AS n FROM (SELECT coalesce(source, '') AS source, coalesce(task_type, '') AS task_type FROM telemetry_event) GROUP BY ROLLUP (source, task_type)""")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telemetry_event").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("task_type", F.lit("")).alias("task_type"))
    r = t.rollup("source", "task_type").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("task_type", F.lit("all")).alias("task_type"), "n")


@query("""
SELECT effectiveness_score IS NULL AS unrated, CASE WHEN length(text) < 40 THEN 'short' ELSE 'long' END AS size, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM prompts WHERE text IS NOT NULL GROUP BY 1, 2""")
def short_and_unrated(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL")
    return p.groupBy(F.col("effectiveness_score").isNull().alias("unrated"), F.when(F.length("text") < 40, "short").otherwise("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("n_sessions"))
