"""Queries over the sessions of agents in claude_session, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import agents, sessions, timestamps
from parlance.plans.reports import QUERIES, SQL, query, r6
from parlance.session import materialize, read_table

__all__ = ["QUERIES", "SQL"]

_STRIP = r"regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
TURNS = r"""
r AS (SELECT session_id, rec_id, type AS role, message.content AS c, timestamp AS raw FROM claude_session WHERE type IN ('user', 'assistant') AND message IS NOT NULL AND session_id IS NOT NULL),
b AS (SELECT *, CASE WHEN ltrim(c) LIKE '[%' AND json_valid(c) THEN json_extract(c, '$[*]') END AS bl FROM r),
q AS (SELECT session_id, rec_id, role, raw,
  CASE WHEN bl IS NULL THEN c ELSE coalesce(array_to_string(list_transform(list_filter(bl, lambda x: json_extract_string(x, '$.type') = 'text'), lambda x: json_extract_string(x, '$.text')), ' '), '') END AS text,
  CASE WHEN role = 'assistant' AND bl IS NOT NULL THEN list_filter(bl, lambda x: json_extract_string(x, '$.type') = 'tool_use') ELSE [] END AS used FROM b),
turns AS (SELECT *, len(used) AS calls, role = 'assistant' AND coalesce(regexp_matches(text, '[Ee]rror|[Tt]raceback'), false) AS failed,
  row_number() OVER (PARTITION BY session_id ORDER BY rec_id) - 1 AS turn_no, count(*) OVER (PARTITION BY session_id) AS n_turns FROM q)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return agents.turns_of_lines(read_table(spark, d, "claude_session"))


@query(f"""
WITH {TURNS}, p AS (SELECT session_id, turn_no, failed, list_transform(used, lambda x: [coalesce(json_extract_string(x, '$.name'), ''), coalesce(split_part(json_extract_string(x, '$.input.file_path'), '/', -1), '')]) AS u FROM turns WHERE calls > 0)
SELECT session_id, turn_no, array_to_string(list_transform(u, lambda x: x[1] || CASE WHEN x[2] <> '' THEN '(' || x[2] || ')' ELSE '' END || CASE WHEN failed THEN ':err' ELSE '' END), '→') AS fingerprint FROM p""")
def step_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Every assistant turn with calls as one comparable string."""
    t = _turns(spark, d).withColumn("fingerprint", agents.fingerprint(F.col("tools"), F.col("paths"), F.col("failed")))
    return t.filter("fingerprint IS NOT NULL").select("session_id", "turn_no", "fingerprint")


@query()
def agent_loops(spark: SparkSession, d: str) -> DataFrame:
    """Loops of one or two steps in every session (tested against a greedy pass)."""
    return agents.loops(_turns(spark, d))


@query(f"""
WITH {TURNS}, w AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN failed END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad,
  first_value(CASE WHEN role = 'assistant' THEN calls END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead, {_STRIP} AS s FROM turns),
u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n, median(length(coalesce(text, ''))) OVER (PARTITION BY session_id) AS m FROM w WHERE role = 'user')
SELECT session_id, turn_no, round(CASE WHEN n > 1 AND i = 0 AND regexp_matches(s, '{agents.GREETING}') THEN 0.0 WHEN n > 1 AND i = n - 1 AND regexp_matches(s, '{agents.SIGN_OFF}') THEN 0.0
  WHEN n = 1 OR i = 0 THEN 1.0 WHEN i = n - 1 THEN 0.8 ELSE 0.3 + 0.2 * i / (n - 1) END, 6) AS position, round(CASE WHEN m > 0 THEN least(length(coalesce(text, '')) / m, 1.0) ELSE 1.0 END, 6) AS length,
  round(least(coalesce(ahead, 0) / 5.0, 1.0), 6) AS tool, CASE WHEN coalesce(bad, false) AND NOT (length(s) < 20 AND regexp_matches(s, '{agents.LOW_INFO}')) THEN 1.0 ELSE 0.0 END AS error FROM u""")
def agent_signals(spark: SparkSession, d: str) -> DataFrame:
    """Position (greetings and closings count nothing), length, tool and error signals of every user turn."""
    s = agents.signals(_turns(spark, d))
    return s.select("session_id", "turn_no", *[r6(F.col(c)).alias(c) for c in ("position", "length", "tool")], "error")


@query(f"""
WITH {TURNS}, g AS (SELECT session_id, count(*) FILTER (role = 'user') AS n_users, count(*) FILTER (role = 'assistant') AS n_assistants, avg(failed::INT) FILTER (role = 'assistant') AS error_rate,
  avg((calls > 0)::INT) FILTER (role = 'assistant') AS tool_rate, avg(({_STRIP} LIKE '%?')::INT) FILTER (role = 'user') AS question_rate, avg(length(coalesce(text, ''))) FILTER (role = 'user') AS user_chars,
  avg(regexp_matches({_STRIP}, '{agents.CONFIRMATION}')::INT) FILTER (role = 'user') AS confirm_rate FROM turns GROUP BY session_id)
SELECT session_id, n_users, n_assistants, round(error_rate, 6) AS error_rate, round(tool_rate, 6) AS tool_rate, round(question_rate, 6) AS question_rate, round(user_chars, 6) AS user_chars, round(confirm_rate, 6) AS confirm_rate FROM g""")
def session_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = agents.ratios(_turns(spark, d))
    return g.select("session_id", "n_users", "n_assistants", *[r6(F.col(c)).alias(c) for c in ("error_rate", "tool_rate", "question_rate", "user_chars", "confirm_rate")])


@query()
def distilled_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with its session's kind, its importance by six signals and whether it is kept (tested by hand)."""
    t = agents.distilled(_turns(spark, d), columns=["role"])
    return t.select("session_id", "turn_no", "role", "kind", r6(F.col("importance")).alias("importance"), "kept")


@query()
def session_exports(spark: SparkSession, d: str) -> DataFrame:
    """What a next session must know of each: goal, decisions, actions, files and what comes next (tested by hand)."""
    return agents.exports(read_table(spark, d, "claude_session"))


_INSTANT = "epoch_us(TRY_CAST(raw AS TIMESTAMPTZ))"


def _seconds(t: DataFrame) -> DataFrame:
    return timestamps.with_instant(t.withColumn("_zone", F.lit(None).cast("string")), "raw", "_zone", "at").drop("_zone")


@query(f"""
WITH {TURNS}, g AS (SELECT session_id, CAST(sum(calls) AS BIGINT) AS n_calls, count(*) FILTER (failed) AS n_errors, (max({_INSTANT}) - min({_INSTANT})) // 1000000 AS seconds FROM turns GROUP BY session_id),
l AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS k FROM turns WHERE role = 'assistant' AND turn_no >= n_turns - 20),
s AS (SELECT session_id, bool_or(coalesce(regexp_matches(text, '{"|".join(agents.ERROR_WORDS)}'), false)) AS bad FROM l WHERE k <= 3 GROUP BY session_id),
e AS (SELECT g.*, CASE WHEN coalesce(bad, false) THEN 'error' ELSE 'success' END AS status FROM g LEFT JOIN s USING (session_id)),
v AS (SELECT *, round(CASE WHEN status = 'success' THEN 0.3 ELSE 0 END + CASE WHEN seconds BETWEEN 600 AND 7200 THEN 0.15 WHEN seconds > 7200 THEN 0.05 ELSE 0 END + CASE WHEN n_calls > 0 THEN 0.1 + 0.25 * greatest(1 - 2 * n_errors / n_calls, 0) ELSE 0 END + 0.1, 2) AS effectiveness FROM e)
SELECT session_id, n_calls, n_errors, seconds, status, effectiveness, repeat('★', round_even(effectiveness * 5, 0)::INT) || repeat('☆', 5 - round_even(effectiveness * 5, 0)::INT) AS stars FROM v""")
def session_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """How each session ended, how long it took and how effective it was."""
    t = _seconds(_turns(spark, d))
    g = t.groupBy("session_id").agg(F.sum(F.size("tools")).cast("bigint").alias("n_calls"), F.count_if(F.col("failed")).alias("n_errors"), F.expr("(max(at) - min(at)) div 1000000").alias("seconds"))
    e = g.join(agents.final_status(t), "session_id")
    e = e.withColumn("effectiveness", agents.effectiveness(F.col("status"), F.col("seconds"), F.col("n_calls"), F.col("n_errors")))
    return e.select("session_id", "n_calls", "n_errors", "seconds", "status", "effectiveness", agents.stars(F.col("effectiveness")).alias("stars"))


@query()
def session_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Calls, errors, turns lost in loops and loops that were left, by session (tested by hand)."""
    t = materialize(_turns(spark, d), "turns")
    return agents.efficiency(t, agents.loops(t))


@query(f"""
WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM turns WHERE role = 'assistant'),
g AS (SELECT session_id, any_value(n) AS n, avg(CASE WHEN i < n // 2 THEN failed::INT END) AS r1, avg(CASE WHEN i >= n // 2 THEN failed::INT END) AS r2, coalesce(sum(CASE WHEN i >= n - 3 THEN failed::INT END) = 3, false) AS abandoned,
  count(*) FILTER (calls = 0 AND length({_STRIP}) < 50) AS stalls FROM a GROUP BY session_id)
SELECT session_id, n, round(r1, 6) AS first_rate, round(r2, 6) AS second_rate, abandoned, coalesce(n >= 4 AND r2 > 1.5 * r1 AND r2 > 0.2, false) AS escalated, stalls FROM g""")
def agent_frustration(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that ended in errors, whose errors grew, or that stalled."""
    g = agents.frustration(_turns(spark, d))
    return g.select("session_id", "n", r6(F.col("first_rate")).alias("first_rate"), r6(F.col("second_rate")).alias("second_rate"), "abandoned", "escalated", "stalls")


@query()
def agent_quality(spark: SparkSession, d: str) -> DataFrame:
    """Composite quality of every session (efficiency, focus, outcome; the weights of parts that are missing go to the others) with one line on it."""
    j = agents.summaries(_seconds(_turns(spark, d)))
    parts = {"efficiency": F.col("productive") * 100, "focus": F.col("focus") * 100, "outcome": F.col("effectiveness") * 100, "prompt": F.lit(None).cast("double")}
    j = j.withColumn("quality", F.round(sessions.quality(parts), 1))
    return j.select("session_id", "quality", agents.insight(F.col("quality"), F.col("productive") * 100).alias("insight"), "stalls")


@query(f"""
WITH {TURNS}, f AS (SELECT unnest(list_transform(used, lambda x: json_extract_string(x, '$.input.file_path'))) AS file FROM turns), c AS (SELECT file, count(*) AS n FROM f WHERE file IS NOT NULL GROUP BY file)
SELECT file, n, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, file) AS rank FROM c) WHERE rank <= 10""")
def top_files(spark: SparkSession, d: str) -> DataFrame:
    """Ten files that tools touched most (a top-k report)."""
    c = _turns(spark, d).select(F.explode("paths").alias("file")).filter("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "file").limit(10)
    # Ten rows are ranked; the table was cut by a distributed top-k.
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "file"))).alias("l")).select(F.posexplode("l").alias("i", "x"))
    return ranked.select("x.file", (-F.col("x.m")).alias("n"), (F.col("i") + 1).cast("bigint").alias("rank"))


@query(f"""
WITH {TURNS}, s AS (SELECT session_id, count(*) AS n, sum(calls) AS c, count(*) FILTER (failed) AS e, (max({_INSTANT}) - min({_INSTANT})) / 1000000 AS t, min({_INSTANT}) AS a, max({_INSTANT}) AS b FROM turns GROUP BY session_id)
SELECT count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_turns, CAST(sum(c) AS BIGINT) AS n_calls, CAST(sum(e) AS BIGINT) AS n_errors, round(sum(n) / count(*), 1) AS turns_per_session, round(avg(t), 1) AS avg_seconds, min(a) AS first_us, max(b) AS last_us FROM s""")
def agent_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals and means over all sessions."""
    t = _seconds(_turns(spark, d))
    s = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tools")).alias("c"), F.count_if(F.col("failed")).alias("e"), F.min("at").alias("a"), F.max("at").alias("b"))
    return s.agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_turns"), F.sum("c").cast("bigint").alias("n_calls"), F.sum("e").alias("n_errors"), F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("turns_per_session"),
        F.round(F.avg((F.col("b") - F.col("a")) / 1000000), 1).alias("avg_seconds"), F.min("a").alias("first_us"), F.max("b").alias("last_us"),
    )
