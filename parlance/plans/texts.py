"""Queries over text features, sessions, loops, periods and similarity, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import features, text
from parlance.operators import graph, patterns, periods, sessions, tfidf
from parlance.operators.timestamps import normalise
from parlance.plans.reports import QUERIES, SQL, query, r6
from parlance.session import materialize, read_table

__all__ = ["QUERIES", "SQL"]

_S = r"regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CJK = "[一-鿿㐀-䶿豈-﫿]"


def _n(pattern: str, of: str = "text") -> str:
    """SQL that counts matches."""
    return f"CAST(len(regexp_extract_all({of}, '{pattern}')) AS BIGINT)"


# Text -------------------------------------------------------------------------------------------------------------------------------
@query(f"""
WITH c AS (SELECT source, regexp_replace(text, '```[\\s\\S]*?```', '', 'g') AS t FROM prompts WHERE text IS NOT NULL),
n AS (SELECT source, {_n(_CJK, "t")} AS cjk, {_n("[a-zA-Z]", "t")} AS latin FROM c)
SELECT source, CASE WHEN cjk > latin THEN 'zh' ELSE 'en' END AS lang, count(*) AS n, CAST(sum(cjk) AS BIGINT) AS cjk, CAST(sum(latin) AS BIGINT) AS latin FROM n GROUP BY 1, 2""")
def language_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Languages by script; the data hold no kana or hangul (tests do)."""
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL")
    c = text.script_counts(F.col("text"))
    p = p.select("source", *[v.alias(k) for k, v in c.items()])
    p = p.withColumn("lang", text.language({k: F.col(k) for k in c}))
    return p.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("cjk").alias("cjk"), F.sum("latin").alias("latin"))


@query(f"""
WITH t AS (SELECT source, text, {_S} AS s FROM prompts WHERE text IS NOT NULL),
e AS (SELECT source, CASE WHEN length(s) = 0 THEN 0 ELSE greatest(1, CASE WHEN {_n(_CJK)} / length(s) > 0.3
  THEN CAST(floor(length(regexp_replace(text, '[\\s　-〿＀-￯.,;:!?"''()\\[\\]{{}}]+', '', 'g')) * 3 / 2) AS BIGINT)
  ELSE CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 13 / 10) AS BIGINT) END) END AS n FROM t)
SELECT source, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS most FROM e GROUP BY source""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("source", text.estimate_tokens(F.col("text")).alias("n"))
    return p.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("n").alias("most"))


def _category_sql() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{p}')''' for p in phrases)} THEN '{name}'" for name, phrases in text.CATEGORIES)
    return f"CASE WHEN regexp_matches(text, '{text.SKILL}') THEN 'skill_invocation' {cases} ELSE 'other' END"


@query(f"SELECT source, {_category_sql()} AS category, count(*) AS n FROM prompts WHERE text IS NOT NULL GROUP BY 1, 2")
def categories_by_source(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL")
    return p.groupBy("source", text.category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_CON = features.PATTERNS["constraints"].replace("'", "''")


@query(f"""
WITH t AS (SELECT id, {_S} AS s FROM prompts WHERE text IS NOT NULL)
SELECT id, {_n("[\\p{L}\\p{N}_]+", "s")} AS n_words, CASE WHEN length(s) = 0 THEN 0 ELSE len(string_split(s, chr(10))) END AS n_lines, {_n(_CON, "s")} AS n_constraints,
{_n("```[\\s\\S]*?```", "s")} AS n_code, {_n(features.PATTERNS["files"], "s")} AS n_files, regexp_matches(s, '{features.PATTERNS["errors"]}') AS has_errors,
regexp_matches(s, '{features.PATTERNS["role"]}') AS has_role, {_n(features.PATTERNS["numbers"], "s")} AS n_numbers FROM t""")
def prompt_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts and flags of every prompt."""
    p = features.with_features(read_table(spark, d, "prompts").filter("text IS NOT NULL").select("id", "text"))
    return p.select("id", "n_words", "n_lines", "n_constraints", "n_code", "n_files", "has_errors", "has_role", "n_numbers")


@query()
def prompt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sub-scores and tier of every prompt; the key instruction is placed by segments."""
    p = features.with_features(read_table(spark, d, "prompts").filter("text IS NOT NULL").select("id", "text"))
    p = p.withColumn("at", features.instruction_position(features.segments("text")))
    p = p.select("id", *[r6(c).alias(k) for k, c in features.sub_scores(F.col("at")).items()])
    return p.withColumn("tier", features.tier(F.col("total")))


@query(f"""
WITH t AS (SELECT id, {_S} AS s, text FROM prompts WHERE text IS NOT NULL), l AS (SELECT id, lower(s) AS s, text FROM t),
f AS (SELECT CASE WHEN length(s) < 20 THEN 'min-length' WHEN length(s) < 40 THEN 'short-prompt' END AS rule FROM l
UNION ALL SELECT CASE WHEN s IN ({", ".join(f"'{v}'" for v in text.VAGUE)}) THEN 'vague-prompt' END FROM l
UNION ALL SELECT CASE WHEN ({" OR ".join(f"contains(s, '{w}')" for w in text.DEBUG_WORDS)}) AND NOT ({" OR ".join(f"contains(text, '{w}')" for w in text.REFERENCES)}) AND length(s) >= 20 THEN 'debug-needs-reference' END FROM l)
SELECT rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY rule""")
def lint_rules(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select(F.explode(text.lint(F.col("text"))).alias("v"))
    return p.groupBy(F.col("v.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def _secrets_sql() -> str:
    quote = lambda v: v.replace("'", "''")
    kinds = " UNION ALL ".join(f"SELECT source, '{kind}' AS kind, unnest(regexp_extract_all(text, '{quote(p)}')) AS v FROM prompts" for kind, _, p in text.SECRETS)
    safe = " OR ".join(f"lower(split_part(v, '@', -1)) LIKE '%{d}'" for d in text.SAFE_DOMAINS)
    ips = ", ".join(f"'{x}'" for x in text.SAFE_IPS)
    return f"""WITH k AS ({kinds}) SELECT source, kind, count(*) AS n, count(DISTINCT v) AS n_values FROM k
WHERE NOT (kind = 'email' AND ({safe})) AND NOT (kind = 'ipv4' AND (v IN ({ips}) OR v LIKE '10.%' OR v LIKE '192.168.%')) GROUP BY 1, 2"""


@query(_secrets_sql())
def secrets_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of all kinds."""
    p = read_table(spark, d, "prompts").select("source", F.explode(text.secrets(F.col("text"))).alias("s"))
    return p.groupBy("source", F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s.value").alias("n_values"))


# The features that are asked of the tasks.
ASKED = {
    "errors": ["debug"], "files": ["debug", "implement", "refactor", "test"], "code": ["debug", "implement"], "constraints": ["implement", "refactor", "review"],
    "io_spec": ["implement", "test"], "edge_cases": ["implement", "test"], "examples": ["implement", "test"], "output_format": ["implement", "review", "summarize"],
    "role": ["review", "creative"], "steps": ["implement", "refactor"],
}


def _asked_sql() -> str:
    missing = ", ".join(f"""avg(CASE WHEN regexp_matches(s, '{features.PATTERNS[k].replace("'", "''")}') THEN 0.0 ELSE 1.0 END) AS {k}""" for k in ASKED)
    rows = " UNION ALL ".join(f"""SELECT category, n, '{k}' AS feature, {k} AS missing FROM g WHERE category IN ({", ".join(f"'{t}'" for t in tasks)})""" for k, tasks in ASKED.items())
    return f"WITH c AS (SELECT {_category_sql()} AS category, {_S} AS s FROM prompts WHERE text IS NOT NULL), g AS (SELECT category, count(*) AS n, {missing} FROM c GROUP BY category HAVING count(*) >= 3), u AS ({rows}) SELECT category, n, feature, round(missing, 6) AS missing FROM u WHERE missing > 0.4"


@query(_asked_sql())
def task_feature_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Features that more than four tenths of a task's prompts lack, of those that are asked of the task."""
    p = features.with_features(read_table(spark, d, "prompts").filter("text IS NOT NULL").select(text.category(F.col("text")).alias("category"), "text"))
    g = p.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[F.avg((~F.col(f"has_{k}")).cast("double")).alias(k) for k in ASKED]).filter("n >= 3")
    asked = spark.createDataFrame([(k, t) for k, tasks in ASKED.items() for t in tasks], "feature string, category string")
    g = g.unpivot(["category", "n"], list(ASKED), "feature", "missing").filter("missing > 0.4").join(F.broadcast(asked), ["feature", "category"])
    return g.select("category", "n", "feature", r6(F.col("missing")).alias("missing"))


_DUR = "CASE WHEN value IS NULL THEN 'none' WHEN value <= 1 THEN '<=1' WHEN value <= 10 THEN '1-10' WHEN value <= 100 THEN '10-100' ELSE '>100' END"


@query(f"SELECT event_type, {_DUR} AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def value_buckets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("event_type", F.expr(_DUR).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("avg_value"))


@query("""
SELECT n.token, count(*) AS n_prompts, count(DISTINCT p.session_id) AS n_sessions, round(avg(p.effectiveness_score), 8) AS avg_eff FROM prompts p JOIN name_lexicon n ON contains(p.text, n.token) GROUP BY n.token""")
def pattern_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """Mean effectiveness of the prompts that contain each token: a join on containment."""
    p = read_table(spark, d, "prompts")
    hits = patterns.contained(p, "id", "text", read_table(spark, d, "name_lexicon"), "token")
    return hits.join(p.select("id", "session_id", "effectiveness_score"), "id").groupBy("token").agg(F.count(F.lit(1)).alias("n_prompts"), F.countDistinct("session_id").alias("n_sessions"), F.round(F.avg("effectiveness_score"), 8).alias("avg_eff"))


@query()
def compression_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Mean and greatest share of words that compression saves (Arrow function; tested by hand)."""
    from parlance.functions import rewriting

    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("source", "text", rewriting.compress("text").alias("short"))
    p = p.withColumn("s", rewriting.saved(F.col("text"), F.col("short")))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("s")).alias("avg_saved"), F.max("s").alias("most_saved"))


@query("""
SELECT id, '## Task' || chr(10) || trim(text) || CASE WHEN trim(coalesce(project, '')) <> '' THEN chr(10) || chr(10) || '## Context' || chr(10) || trim(project) ELSE '' END AS prompt FROM prompts WHERE trim(text) <> ''""")
def built_prompts(spark: SparkSession, d: str) -> DataFrame:
    from parlance.functions import rewriting

    p = read_table(spark, d, "prompts").filter("trim(text) <> ''")
    return p.select("id", rewriting.build({"task": F.col("text"), "context": F.coalesce("project", F.lit(""))}).alias("prompt"))


# Sessions -----------------------------------------------------------------------------------------------------------------------------
_TURNS = """turns AS (SELECT session_id, rec_id, type AS role, length(coalesce(message.content, '')) AS len, row_number() OVER w - 1 AS turn_no, count(*) OVER (PARTITION BY session_id) AS n
FROM claude_session WHERE type IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY rec_id))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "claude_session").filter(F.col("type").isin("user", "assistant"))
    t = t.select("session_id", "rec_id", F.col("type").alias("role"), F.length(F.coalesce("message.content", F.lit(""))).cast("bigint").alias("len"))
    return sessions.numbered(t, "session_id", ["rec_id"])


@query(f"""
WITH {_TURNS}, m AS (SELECT session_id, median(len) AS med FROM turns GROUP BY session_id)
SELECT rec_id, turn_no, round(CASE WHEN n = 1 OR turn_no = 0 THEN 1.0 WHEN turn_no = n - 1 THEN 0.8 ELSE 0.3 + 0.2 * turn_no / (n - 1) END, 6) AS position,
round(CASE WHEN med > 0 THEN least(len / med, 1.0) ELSE 0 END, 6) AS length FROM turns JOIN m USING (session_id)""")
def turn_signals(spark: SparkSession, d: str) -> DataFrame:
    """Position and length signals of every turn."""
    t = _turns(spark, d)
    med = t.groupBy("session_id").agg(F.median("len").alias("med"))
    t = t.join(med, "session_id")
    length = F.when(F.col("med") > 0, F.least(F.col("len") / F.col("med"), F.lit(1.0))).otherwise(0.0)
    return t.select("rec_id", "turn_no", r6(sessions.position_signal(F.col("turn_no"), F.col("n_turns"))).alias("position"), r6(length).alias("length"))


@query(f"""
WITH {_TURNS} SELECT rec_id, last_value(CASE WHEN role = 'user' THEN rec_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_before,
first_value(CASE WHEN role = 'user' THEN rec_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rec_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS user_after,
last_value(CASE WHEN role = 'assistant' THEN rec_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS assistant_before,
first_value(CASE WHEN role = 'assistant' THEN rec_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rec_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS assistant_after FROM turns""")
def nearest_turns(spark: SparkSession, d: str) -> DataFrame:
    """As-of joins to the nearest user and assistant turn on both sides, as running frames."""
    t = sessions.neighbours(_turns(spark, d), "session_id", ["rec_id"], "role", "rec_id")
    return t.select("rec_id", "user_before", "user_after", "assistant_before", "assistant_after")


@query(f"""
WITH {_TURNS}, g AS (SELECT session_id, count(*) AS n, avg(len) FILTER (role = 'user') AS user_len, avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END) AS user_share FROM turns GROUP BY session_id)
SELECT CASE WHEN n < 3 THEN 'brief' WHEN user_len > 400 THEN 'specified' WHEN user_share > 0.5 THEN 'driven' ELSE 'balanced' END AS kind, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_turns, round(avg(user_share), 6) AS user_share FROM g GROUP BY 1""")
def session_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by ordered rules over ratios of their turns."""
    user = F.col("role") == "user"
    g = _turns(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(user, F.col("len"))).alias("user_len"), F.avg(user.cast("double")).alias("user_share"))
    kind = F.when(F.col("n") < 3, "brief").when(F.col("user_len") > 400, "specified").when(F.col("user_share") > 0.5, "driven").otherwise("balanced")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_turns"), r6(F.avg("user_share")).alias("user_share"))


@query("""
WITH g AS (SELECT install_id, avg(score_clarity) AS prompt, CASE WHEN count(*) >= 3 THEN avg(score_context) END AS efficiency, avg(CASE WHEN task_type = 'debug' THEN score_position END) AS focus, avg(effectiveness_score) * 25 AS outcome FROM telemetry_event GROUP BY install_id)
SELECT install_id, round((coalesce(prompt * 0.3, 0) + coalesce(efficiency * 0.3, 0) + coalesce(focus * 0.2, 0) + coalesce(outcome * 0.2, 0)) / nullif(CASE WHEN prompt IS NULL THEN 0 ELSE 0.3 END + CASE WHEN efficiency IS NULL THEN 0 ELSE 0.3 END + CASE WHEN focus IS NULL THEN 0 ELSE 0.2 END + CASE WHEN outcome IS NULL THEN 0 ELSE 0.2 END, 0), 9) AS quality FROM g""")
def session_quality(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean over the parts that are there."""
    g = read_table(spark, d, "telemetry_event").groupBy("install_id").agg(
        F.avg("score_clarity").alias("prompt"),
        F.when(F.count(F.lit(1)) >= 3, F.avg("score_context")).alias("efficiency"),
        F.avg(F.when(F.col("task_type") == "debug", F.col("score_position"))).alias("focus"),
        (F.avg("effectiveness_score") * 25).alias("outcome"),
    )
    return g.select("install_id", F.round(sessions.quality({k: F.col(k) for k in sessions.QUALITY}), 9).alias("quality"))


@query("""
WITH e AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id, count(*) AS n, avg(CASE WHEN i < n // 2 THEN f::INT END) AS r1, avg(CASE WHEN i >= n // 2 THEN f::INT END) AS r2, sum(CASE WHEN i >= n - 3 THEN f::INT END) = 3 AS abandoned FROM e GROUP BY user_id)
SELECT user_id, n, abandoned, coalesce(n >= 4 AND r2 > 1.5 * r1 AND r2 > 0.2, false) AS escalated, round(r1, 6) AS first_rate, round(r2, 6) AS second_rate FROM g""")
def frustration_signals(spark: SparkSession, d: str) -> DataFrame:
    g = sessions.frustration(read_table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return g.select("user_id", "n", "abandoned", "escalated", r6(F.col("first_rate")).alias("first_rate"), r6(F.col("second_rate")).alias("second_rate"))


@query("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IS NOT NULL),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS k FROM e)
SELECT user_id, event_type AS fingerprint, min(i) AS start_at, max(i) AS end_at, count(*) AS loops FROM g GROUP BY user_id, event_type, k HAVING count(*) >= 3""")
def single_step_loops(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal steps by gaps and islands."""
    return sessions.single_step_loops(read_table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "fingerprint", "start_at", "end_at", "loops")


@query()
def step_loops(spark: SparkSession, d: str) -> DataFrame:
    """Two-step loops from left to right, then single-step loops among the rest (sequential in SQL; tested against a loop)."""
    return sessions.loops(read_table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IS NOT NULL),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS k FROM e), l AS (SELECT user_id, min(i) AS s, max(i) AS t FROM g GROUP BY user_id, event_type, k HAVING count(*) >= 3)
SELECT e.user_id, count(DISTINCT e.event_id) AS n_inside, round(sum(e.value), 4) AS value FROM e JOIN l ON e.user_id = l.user_id AND e.i BETWEEN l.s AND l.t GROUP BY e.user_id""")
def steps_in_loops(spark: SparkSession, d: str) -> DataFrame:
    """Interval join of steps with the loops that hold them."""
    e = read_table(spark, d, "events").filter("event_type IS NOT NULL")
    found = sessions.single_step_loops(e, "user_id", ["ts", "event_id"], "event_type")
    n = sessions.numbered(e, "user_id", ["ts", "event_id"]).withColumn("position", F.col("turn_no") + 1)
    inside = sessions.within_loops(n, found, "user_id", "position")
    return inside.groupBy("user_id").agg(F.countDistinct("event_id").alias("n_inside"), F.round(F.sum("value"), 4).alias("value"))


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events""")
def carried_error(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("err", F.when(F.col("event_type") == "error", F.col("event_id")))
    return sessions.carry_forward(e, "user_id", ["ts", "event_id"], "err", "last_error").select("user_id", "event_id", "last_error")


@query()
def distilled_turns(spark: SparkSession, d: str) -> DataFrame:
    """Importance of every turn by position, length, shift and uniqueness, and whether distillation keeps it (tested by hand)."""
    t = read_table(spark, d, "claude_session").filter(F.col("type").isin("user", "assistant"))
    t = t.select("session_id", "rec_id", F.col("type").alias("role"), F.coalesce("message.content", F.lit("")).alias("content"))
    t = sessions.numbered(t, "session_id", ["rec_id"])
    s = sessions.semantic_signals(t, "session_id", "turn_no", text.words(F.lower("content")))
    med = t.groupBy("session_id").agg(F.median(F.length("content")).alias("med"))
    t = t.join(s, ["session_id", "turn_no"]).join(med, "session_id")
    signals = {
        "position": sessions.position_signal(F.col("turn_no"), F.col("n_turns")),
        "length": F.when(F.col("med") > 0, F.least(F.length("content") / F.col("med"), F.lit(1.0))).otherwise(0.0),
        "shift": F.col("shift"),
        "unique": F.col("unique"),
    }
    out = sessions.distil(t, "session_id", "turn_no", signals)
    return out.select("session_id", "turn_no", "role", r6(F.col("shift")).alias("shift"), r6(F.col("unique")).alias("unique"), r6(F.col("importance")).alias("importance"), "kept")


@query("""
SELECT queue_id, len(v) AS dim, round(list_sum(list_transform(v, lambda x: coalesce(x, 0))), 6) AS total FROM (SELECT queue_id, [score_total, score_structure, score_context, score_position, score_repetition, score_clarity, effectiveness_score] AS v FROM telemetry_event)""")
def score_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The scores of an event as one vector, nulls as 0."""
    names = ["score_total", "score_structure", "score_context", "score_position", "score_repetition", "score_clarity", "effectiveness_score"]
    v = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    return read_table(spark, d, "telemetry_event").select("queue_id", F.size(v).cast("bigint").alias("dim"), r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"))


_CENTRES = {"even": (14.0, 8.5, 11.5, 8.5, 14.0), "structured": (2.0, 14.0, 12.0, 6.0, 12.0), "brief": (1.0, 3.0, 18.0, 1.0, 8.0)}


def _distance(c: tuple[float, ...]) -> str:
    return " + ".join(f"pow(coalesce(score_{n}, 0) - {v}, 2)" for n, v in zip(("structure", "context", "position", "repetition", "clarity"), c, strict=True))


@query(f"""
WITH x AS (SELECT source, {", ".join(f"{_distance(c)} AS {n}" for n, c in _CENTRES.items())} FROM telemetry_event)
SELECT source, CASE WHEN even <= structured AND even <= brief THEN 'even' WHEN structured <= brief THEN 'structured' ELSE 'brief' END AS centre, count(*) AS n FROM x GROUP BY 1, 2""")
def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of a few given centres for every event: an expression over constants, in place of a join."""
    at = [F.struct(F.expr(_distance(c)).alias("distance"), F.lit(i).alias("i"), F.lit(n).alias("centre")) for i, (n, c) in enumerate(_CENTRES.items())]
    t = read_table(spark, d, "telemetry_event").select("source", F.array_min(F.array(*at))["centre"].alias("centre"))
    return t.groupBy("source", "centre").agg(F.count(F.lit(1)).alias("n"))


# Periods ------------------------------------------------------------------------------------------------------------------------------
_END = datetime(2024, 1, 31)


@query("""
WITH s AS (SELECT i AS no FROM range(8) r(i)), e AS (SELECT floor((epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-06')) / (7 * 86400 * 1000000.0))::BIGINT AS no, value, user_id FROM events WHERE ts >= TIMESTAMP '2023-12-06' AND ts < TIMESTAMP '2024-01-31'),
g AS (SELECT no, count(*) AS n, round(avg(value), 6) AS avg_value, count(DISTINCT user_id) AS users FROM e GROUP BY no),
j AS (SELECT s.no, coalesce(n, 0) AS n_rows, avg_value, coalesce(users, 0) AS users FROM s LEFT JOIN g ON s.no = g.no)
SELECT no, n_rows, avg_value, users, coalesce(n_rows - lag(n_rows) OVER (ORDER BY no), 0) AS delta, round(CASE WHEN coalesce(lag(n_rows) OVER (ORDER BY no), 0) = 0 THEN 0 ELSE (n_rows - lag(n_rows) OVER (ORDER BY no)) * 100.0 / lag(n_rows) OVER (ORDER BY no) END, 6) AS pct FROM j""")
def weekly_trends(spark: SparkSession, d: str) -> DataFrame:
    """Eight adjacent weeks before a given end, empty ones included, with the change from week to week."""
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = periods.snapshots(e, "at", _END, periods.parse_period("1w"), 8, {"avg_value": r6(F.avg("value")), "users": F.countDistinct("user_id")})
    s = periods.deltas(s, "n_rows")
    return s.select("no", "n_rows", "avg_value", F.coalesce("users", F.lit(0).cast("bigint")).alias("users"), "delta", r6(F.col("pct")).alias("pct"))


@query("""
WITH e AS (SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS no, value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31')
SELECT event_type, count(*) FILTER (no = 0) AS before, count(*) FILTER (no = 1) AS after, round(avg(value) FILTER (no = 1) - avg(value) FILTER (no = 0), 6) AS value_change FROM e GROUP BY event_type""")
def two_period_digest(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("no", periods.window_no(F.col("ts").cast("timestamp"), _END, periods.parse_period("15d"), 2)).filter("no IS NOT NULL")
    return e.groupBy("event_type").agg(F.count_if(F.col("no") == 0).alias("before"), F.count_if(F.col("no") == 1).alias("after"), r6(F.avg(F.when(F.col("no") == 1, F.col("value"))) - F.avg(F.when(F.col("no") == 0, F.col("value")))).alias("value_change"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(us) AS start_us, max(us) + 3600 * 1000000::BIGINT AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Event-time sessions that an hour of silence ends; the streaming form gives the same rows."""
    from parlance.streaming.windows import session_windows

    return session_windows(read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "1 hour")


# Similarity ---------------------------------------------------------------------------------------------------------------------------
_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z]+'), lambda x: length(x) > 3)"


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM c), v AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2),
r AS (SELECT doc_id, term, df, (1 + ln(c)) * (ln((1.0 + n) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term), n), z AS (SELECT doc_id, sqrt(sum(raw * raw)) AS z FROM r GROUP BY doc_id)
SELECT term, max(df) AS df, round(sum(raw / z) / max(n), 6) AS tfidf_avg FROM r JOIN z USING (doc_id), n GROUP BY term""")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and mean TF-IDF weight of every term of two documents or more."""
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z]+)"), F.lit(1)), lambda x: F.length(x) > 3)
    s = tfidf.term_stats(read_table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", tokens, least_df=2)
    return s.select("term", "df", r6(F.col("tfidf_avg")).alias("tfidf_avg"))


def _stem_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of one prompt of each set of equal ones, (id, rep) of all prompts)."""
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL").select("id", "text")
    counts = materialize(tfidf.term_counts(p, "id", text.stem4(F.col("text"))), "counts")
    equal = materialize(tfidf.equal_texts(counts, "id"), "equal")
    return tfidf.weights(counts, "id").join(equal.filter("id = rep").select("id"), "id", "left_semi"), equal


def _opened(found: DataFrame, equal: DataFrame, to: str) -> DataFrame:
    """Groups (node, to) of representatives as groups of all prompts; those that are alone in theirs are left out."""
    many = equal.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep", F.lit(True).alias("many"))
    rows = equal.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(many, "rep", "left").filter(F.col(to).isNotNull() | F.col("many"))
    return rows.select("id", F.coalesce(to, "rep").alias(to))


@query()
def similar_groups(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in greedy groups by TF-IDF cosine of 0.85 or more, earliest first (tested against a loop)."""
    vectors, equal = _stem_vectors(spark, d)
    return _opened(graph.leaders(tfidf.cosine_pairs(vectors, "id", 0.85).select("a", "b")), equal, "leader")


@query(r"""
WITH RECURSIVE t AS (SELECT id, unnest(list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 4 AND NOT contains(x, '.') THEN left(x, 4) ELSE x END)) AS term FROM prompts WHERE text IS NOT NULL),
c AS (SELECT id, term, count(*) AS c FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM c), v AS (SELECT term, count(*) AS df FROM c GROUP BY term), r AS (SELECT id, term, (1 + ln(c)) * (ln((1.0 + n) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term), n),
z AS (SELECT id, sqrt(sum(raw * raw)) AS z FROM r GROUP BY id), w AS (SELECT id, term, raw / z AS w FROM r JOIN z USING (id)), p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.9 - 1e-12),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), walk AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.id) SELECT id, min(root) AS component FROM walk GROUP BY id""")
def similar_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of prompts of cosine 0.9 or more."""
    vectors, equal = _stem_vectors(spark, d)
    return _opened(graph.connected_components(tfidf.cosine_pairs(vectors, "id", 0.9)), equal, "component")


@query("""SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, len(embedding) AS dim FROM embeddings""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(F.sqrt(tfidf.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.size("embedding").cast("bigint").alias("dim"))


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """K-means over hashed TF-IDF vectors of the documents (seeded; 2^18 buckets of terms, so that hardly any two terms share one)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    docs = read_table(spark, d, "documents").filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select("doc_id", text.split_words(F.lower("text")).alias("w"))
    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 18).transform(docs)
    v = Normalizer(inputCol="x", outputCol="features").transform(IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf)).select("doc_id", "features")
    v = materialize(v, "vectors")
    model = KMeans(k=8, seed=42, maxIter=10).fit(v)
    return model.transform(v).select("doc_id", F.col("prediction").cast("bigint").alias("cluster"))


@query("""
WITH t AS (SELECT session_id, epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS us FROM claude_session)
SELECT session_id, count(*) AS n_lines, min(us) AS first_us, max(us) AS last_us, (max(us) - min(us)) // 1000000 AS seconds FROM t WHERE us IS NOT NULL GROUP BY session_id""")
def session_durations(spark: SparkSession, d: str) -> DataFrame:
    """First and last instant and length of every session, over mixed timestamps."""
    lines = read_table(spark, d, "claude_session").select("session_id", F.col("timestamp").alias("raw"), F.lit(None).cast("string").alias("zone"))
    t = normalise(lines).withColumnRenamed("utc_us", "at")
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("at").alias("first_us"), F.max("at").alias("last_us"), F.expr("(max(at) - min(at)) div 1000000").alias("seconds"))
