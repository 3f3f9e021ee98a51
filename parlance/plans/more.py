"""Further queries: repetition across sessions, lookups, set operations, fences, tools, tiers and style trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import features, text
from parlance.operators import graph, patterns, tfidf
from parlance.plans.reports import QUERIES, SQL, query, r6
from parlance.session import materialize, read_table

__all__ = ["QUERIES", "SQL"]

_S = r"regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')"


@query(f"""
WITH t AS (SELECT sha256({_S}) AS h, session_id, source, length(text) AS n FROM prompts WHERE text IS NOT NULL),
g AS (SELECT h, count(*) AS c, count(DISTINCT session_id) AS s, max(n) AS n FROM t GROUP BY h HAVING count(DISTINCT session_id) >= 2)
SELECT s AS n_sessions, count(*) AS n_topics, CAST(sum(c) AS BIGINT) AS n_prompts, CAST(max(n) AS BIGINT) AS longest FROM g GROUP BY s""")
def repeated_across_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Texts (but for case and white space) that recur in two sessions or more."""
    h = F.sha2(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " "), 256)
    t = read_table(spark, d, "prompts").filter("text IS NOT NULL").select(h.alias("h"), "session_id", F.length("text").alias("n"))
    # Sessions are distinct per hash in two steps; a frequent text is pre-aggregated by session first.
    by = t.groupBy("h", "session_id").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    g = by.groupBy("h").agg(F.sum("c").alias("c"), F.count("session_id").alias("s"), F.max("n").alias("n")).filter("s >= 2")
    return g.groupBy(F.col("s").alias("n_sessions")).agg(F.count(F.lit(1)).alias("n_topics"), F.sum("c").cast("bigint").alias("n_prompts"), F.max("n").cast("bigint").alias("longest"))


@query()
def recurring_topics(spark: SparkSession, d: str) -> DataFrame:
    """Groups of similar prompts (stems, 0.75 or more, linked directly or by others) of two sessions or more, named by their least id.

    Texts that are equal but for case and white space are one node; prompts without session share one (tested against brute force).
    """
    h = F.sha2(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " "), 256)
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select(h.alias("h"), "id", F.coalesce("session_id", F.lit("unknown")).alias("session"), "text")
    texts = materialize(p.groupBy("h").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text")), "texts")
    vectors = tfidf.weights(tfidf.term_counts(texts, "id", text.stem4(F.col("text"))), "id")
    topics = graph.connected_components(tfidf.blended_pairs(vectors, "id", 0.75).select("a", "b"))
    member = texts.select("h", "id").join(topics.toDF("id", "topic"), "id", "left").select("h", F.coalesce("topic", "id").alias("topic_id"))
    by = p.groupBy("h", "session").agg(F.count(F.lit(1)).alias("c")).join(member, "h").groupBy("topic_id", "session").agg(F.sum("c").alias("c"))
    g = by.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("c").alias("n_prompts")).filter("n_sessions >= 2")
    return g.join(member.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_texts")), "topic_id").select("topic_id", "n_sessions", "n_texts", "n_prompts")


@query("""SELECT s.source, count(DISTINCT s.file_path) AS n_files, count(DISTINCT b.session_id) AS n_sessions FROM processed_sessions s JOIN prompts b ON contains(s.file_path, b.session_id) WHERE starts_with(b.session_id, 's00-') GROUP BY s.source""")
def sessions_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Files whose path contains a session, whatever its name: a join on containment (the SQL has the names of the test data only)."""
    files = read_table(spark, d, "processed_sessions").select("source", "file_path")
    found = patterns.contained(files.select("file_path").distinct(), "file_path", "file_path", read_table(spark, d, "prompts"), "session_id")
    return files.join(found, "file_path").groupBy("source").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("session_id").alias("n_sessions"))


@query("""
WITH p AS (SELECT DISTINCT project FROM prompts WHERE project IS NOT NULL), b AS (SELECT DISTINCT project FROM prompt_batches WHERE project IS NOT NULL)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM p INTERSECT SELECT * FROM b) UNION ALL SELECT 'prompts', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM b)
UNION ALL SELECT 'batches', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM p) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM p UNION SELECT * FROM b)""")
def project_sets(spark: SparkSession, d: str) -> DataFrame:
    p, b = (read_table(spark, d, t).select("project").filter("project IS NOT NULL").distinct().withColumn("_" + t, F.lit(1)) for t in ("prompts", "prompt_batches"))
    # One full join in place of four set operations.
    j = p.join(b, "project", "full")
    inp, inb = F.col("_prompts").isNotNull(), F.col("_prompt_batches").isNotNull()
    n = j.agg(F.count_if(inp & inb).alias("both"), F.count_if(inp & ~inb).alias("prompts"), F.count_if(inb & ~inp).alias("batches"), F.count(F.lit(1)).alias("either"))
    return n.unpivot([], ["both", "prompts", "batches", "either"], "part", "n")


@query("""
WITH l AS (SELECT source, id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM prompts WHERE text IS NOT NULL),
f AS (SELECT source, starts_with(trim(line), '```') AS fence, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS n FROM l)
SELECT source, count(*) AS n_lines, count(*) FILTER (fence) AS n_fences, count(*) FILTER (NOT fence AND n % 2 = 1) AS n_inside FROM f GROUP BY source""")
def fenced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines inside code fences by the parity of a running count, kept in an array so that no text is shuffled."""
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("source", F.split("text", "\n").alias("l"))
    fence = lambda x: F.startswith(F.trim(x), F.lit("```"))
    start = F.struct(F.lit(0).cast("bigint").alias("fences"), F.lit(0).cast("bigint").alias("inside"))
    run = F.aggregate("l", start, lambda s, x: F.when(fence(x), F.struct((s["fences"] + 1).alias("fences"), s["inside"].alias("inside"))).otherwise(F.struct(s["fences"].alias("fences"), (s["inside"] + s["fences"] % 2).alias("inside"))))
    p = p.select("source", F.size("l").cast("bigint").alias("n"), run.alias("r"))
    return p.groupBy("source").agg(F.sum("n").alias("n_lines"), F.sum("r.fences").alias("n_fences"), F.sum("r.inside").alias("n_inside"))


@query("""
WITH c AS (SELECT CASE WHEN json_valid(content) THEN content END AS c FROM api_conversation_history WHERE content LIKE '[%'),
b AS (SELECT unnest(json_extract(c, '$[*]')) AS b FROM c WHERE c IS NOT NULL)
SELECT json_extract_string(b, '$.name') AS tool, count(*) AS n FROM b WHERE json_extract_string(b, '$.type') = 'tool_use' GROUP BY 1""")
def tool_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Calls by tool over exploded blocks."""
    blocks = F.from_json("content", "array<struct<type:string,name:string>>")
    whole = F.try_parse_json("content").isNotNull()
    b = read_table(spark, d, "api_conversation_history").filter(F.col("content").startswith("[") & whole).select(F.explode(blocks).alias("b"))
    return b.filter("b.type = 'tool_use'").groupBy(F.col("b.name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT source, CASE WHEN score_total >= 85 THEN 'EXPERT' WHEN score_total >= 70 THEN 'STRONG' WHEN score_total >= 50 THEN 'GOOD' WHEN score_total >= 30 THEN 'BASIC' ELSE 'DRAFT' END AS tier,
count(*) AS n, round(min(score_total), 6) AS lowest, round(max(score_total), 6) AS highest FROM telemetry_event WHERE score_total IS NOT NULL GROUP BY 1, 2""")
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telemetry_event").filter("score_total IS NOT NULL")
    return t.groupBy("source", features.tier(F.col("score_total")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), r6(F.min("score_total")).alias("lowest"), r6(F.max("score_total")).alias("highest"))


@query("""
WITH s AS (SELECT source, unnest(list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 4 AND NOT contains(x, '.') THEN left(x, 4) ELSE x END)) AS s FROM prompts WHERE text IS NOT NULL),
g AS (SELECT source, s, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, s) AS rank FROM g) SELECT source, s AS stem, n, rank FROM r WHERE rank <= 10""")
def frequent_stems(spark: SparkSession, d: str) -> DataFrame:
    """Ten most frequent stems by source (a top-k report)."""
    s = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("source", F.explode(text.stem4(F.col("text"))).alias("stem"))
    g = s.groupBy("source", "stem").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "stem")).cast("bigint")).filter("rank <= 10").select("source", "stem", "n", "rank")


@query("""
WITH p AS (SELECT task_type, CASE WHEN created_at >= TIMESTAMP '2025-07-01' THEN 1 ELSE 0 END AS late FROM telemetry_event WHERE task_type IS NOT NULL AND created_at IS NOT NULL),
g AS (SELECT task_type, count(*) FILTER (late = 0) AS a, count(*) FILTER (late = 1) AS b FROM p GROUP BY task_type)
SELECT task_type, a AS before, b AS after, round(b * 1.0 / sum(b) OVER () - a * 1.0 / sum(a) OVER (), 6) AS gain FROM g""")
def category_shift(spark: SparkSession, d: str) -> DataFrame:
    """Change of each task's share from one period to the next."""
    p = read_table(spark, d, "telemetry_event").filter("task_type IS NOT NULL AND created_at IS NOT NULL")
    late = F.col("created_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    g = p.groupBy("task_type").agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    # One row per task: a window over all of them is one small partition.
    w = Window.partitionBy(F.lit(1))
    return g.withColumn("gain", r6(F.col("after") / F.sum("after").over(w) - F.col("before") / F.sum("before").over(w)))


@query("""
SELECT lang, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) > len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]')) THEN 'zh' ELSE 'en' END AS found, count(*) AS n FROM documents GROUP BY 1, 2""")
def language_against_label(spark: SparkSession, d: str) -> DataFrame:
    """Script language beside the given label, which is at times null or wrong."""
    c = text.script_counts(F.coalesce("text", F.lit("")))
    t = read_table(spark, d, "documents").select("lang", text.language(c).alias("found"))
    return t.groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT install_id, queue_id, score_total, row_number() OVER (PARTITION BY install_id ORDER BY created_at DESC NULLS LAST, queue_id DESC) AS n FROM telemetry_event WHERE score_total IS NOT NULL),
l AS (SELECT install_id, count(*) AS c, avg(score_total) FILTER (n <= 25) AS new, avg(score_total) FILTER (n > 25 AND n <= 50) AS old FROM r WHERE n <= 50 GROUP BY install_id HAVING count(*) >= 10)
SELECT install_id, c AS n, round(new, 6) AS newer, round(old, 6) AS older, CASE WHEN old IS NULL THEN 'short' WHEN new - old > 3 THEN 'improving' WHEN new - old < -3 THEN 'declining' ELSE 'stable' END AS trend FROM l""")
def score_trend(spark: SparkSession, d: str) -> DataFrame:
    """Latest fifty scores of each installation in halves (the feature is the latest N)."""
    w = Window.partitionBy("install_id").orderBy(F.desc_nulls_last("created_at"), F.desc("queue_id"))
    r = read_table(spark, d, "telemetry_event").filter("score_total IS NOT NULL").withColumn("n", F.row_number().over(w)).filter("n <= 50")
    g = r.groupBy("install_id").agg(F.count(F.lit(1)).alias("c"), F.avg(F.when(F.col("n") <= 25, F.col("score_total"))).alias("new"), F.avg(F.when(F.col("n") > 25, F.col("score_total"))).alias("old")).filter("c >= 10")
    change = F.col("new") - F.col("old")
    trend = F.when(F.col("old").isNull(), "short").when(change > 3, "improving").when(change < -3, "declining").otherwise("stable")
    return g.select("install_id", F.col("c").alias("n"), r6(F.col("new")).alias("newer"), r6(F.col("old")).alias("older"), trend.alias("trend"))


@query("""SELECT p.source, p.session_id, count(*) AS n, round(max(e.score_total), 6) AS best FROM prompts p JOIN telemetry_event e ON p.id = e.queue_id WHERE e.score_total > 40 GROUP BY 1, 2""")
def scores_of_sessions(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one join on a key with a filter, which reaches the scan."""
    p, e = read_table(spark, d, "prompts"), read_table(spark, d, "telemetry_event").filter("score_total > 40")
    j = p.select("id", "source", "session_id").join(e.select(F.col("queue_id").alias("id"), "score_total"), "id")
    return j.groupBy("source", "session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score_total")).alias("best"))
