"""Queries over prompts: checks, explanations, comparisons, recommendations, stores, lookups and dashboards, with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import chinese, features, scoring, templates, text
from parlance.operators import agents, embedders, graph, periods, stores, tfidf
from parlance.plans.reports import QUERIES, SQL, query, r6
from parlance.plans.texts import _category_sql
from parlance.session import materialize, read_table
from parlance.sources import demo

__all__ = ["QUERIES", "SQL"]

_S = r"regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_CAT = _category_sql()


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "prompts").filter("text IS NOT NULL")


# Scores -----------------------------------------------------------------------------------------------------------------------------
@query()
def prompt_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every prompt against the threshold: scores, what is missing, lint rules, the rewritten text's gain (tested by hand)."""
    c = scoring.check(_prompts(spark, d).select("id", "text"), "text", model="gpt")
    return c.select("id", "total", "tier", "grade", "passed", "missing", F.transform("lint", lambda x: x["rule"]).alias("lint"), F.transform("suggestions", lambda x: x["category"]).alias("suggested"), F.size("confirmations").cast("bigint").alias("n_confirmed"), "rewrite_gain", "n_tokens")


@query()
def prompt_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Strengths, weaknesses and tips of every prompt (tested by hand)."""
    p = chinese.routed(_prompts(spark, d).select("id", "text", text.category(F.col("text")).alias("task")))
    p = p.withColumn("at", features.instruction_position(features.segments("text")))
    s = scoring.scored(p, "task", position=F.col("at"))
    e = scoring.explain(F.col("task"), F.col("at"))
    return s.select("id", "locale", "total", *[c.alias(k) for k, c in e.items()])


@query()
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean totals of all prompts by source for each model (tested by hand)."""
    p = features.with_features(_prompts(spark, d).select("source", "text", F.lit("other").alias("task")))
    totals = [F.least(F.greatest(features.sub_scores()["total"] + scoring.adjustment(m), F.lit(0.0)), F.lit(100.0)).alias(m) for m in ("", *scoring.MODELS) if m]
    return p.select("source", *totals).groupBy("source").agg(*[r6(F.avg(m)).alias(m) for m in scoring.MODELS])


@query(f"""
WITH t AS (SELECT id, {_S} AS s, {_CAT} AS task FROM prompts WHERE text IS NOT NULL),
f AS (SELECT id, task, len(regexp_extract_all(s, '```[\\s\\S]*?```')) > 0 AS code, len(regexp_extract_all(s, '{_q(features.PATTERNS["files"])}')) > 0 AS files, regexp_matches(s, '{_q(features.PATTERNS["errors"])}') AS errors,
  len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+')) AS n, len(regexp_extract_all(s, '{_q(features.PATTERNS["constraints"])}')) > 0 AS con, regexp_matches(s, '{_q(features.PATTERNS["io_spec"])}') AS io, regexp_matches(s, '{_q(features.PATTERNS["edge_cases"])}') AS edge FROM t)
SELECT id, array_to_string(list_filter([CASE WHEN NOT code THEN 'code' END, CASE WHEN NOT files AND task IN ('debug', 'implement', 'refactor', 'test') THEN 'files' END, CASE WHEN NOT errors AND task = 'debug' THEN 'error' END,
  CASE WHEN n < 20 THEN 'detail' END, CASE WHEN NOT con THEN 'constraints' END, CASE WHEN NOT io THEN 'input and output' END, CASE WHEN NOT edge AND task IN ('implement', 'test') THEN 'edge cases' END], lambda x: x IS NOT NULL), ', ') AS missing FROM f""")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    """What every prompt lacks, the greatest gain first (vague wording aside, which prompt_checks reports)."""
    p = features.with_features(_prompts(spark, d).select("id", "text", text.category(F.col("text")).alias("task")))
    return p.select("id", F.array_join(F.filter(scoring.missing(F.col("task")), lambda x: x != "names"), ", ").alias("missing"))


@query("""
SELECT source, CASE WHEN score_total >= 85 THEN 'A' WHEN score_total >= 60 THEN 'B' WHEN score_total >= 40 THEN 'C' WHEN score_total >= 25 THEN 'D' ELSE 'F' END AS grade, count(*) AS n,
count(*) FILTER (score_total >= 43) AS n_passed FROM telemetry_event WHERE score_total IS NOT NULL GROUP BY 1, 2""")
def grades(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telemetry_event").filter("score_total IS NOT NULL")
    return t.groupBy("source", features.grade(F.col("score_total")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score_total") >= scoring.THRESHOLD).alias("n_passed"))


@query()
def compared_batches(spark: SparkSession, d: str) -> DataFrame:
    """New prompts beside the latest accepted one of their source: which scores higher (tested by hand)."""
    new = read_table(spark, d, "prompt_batches").filter("text IS NOT NULL").select("item_id", "source", F.col("text").alias("a"))
    old = stores.first_per_key(_prompts(spark, d), ["source"], [F.desc("id")]).select("source", F.col("text").alias("b"))
    return scoring.compare(new.join(old, "source"), "a", "b").select("item_id", "score_a", "score_b", "winner")


_ZH = chinese.PATTERNS


def _zh_n(k: str) -> str:
    return f"CAST(len(regexp_extract_all(s, '{_q(_ZH[k])}')) AS BIGINT)"


_ZH_STARTS = " OR ".join(f"starts_with(line, '{v}')" for v in chinese.ACTION_VERBS)


@query(f"""
WITH t AS (SELECT doc_id, {_S} AS s FROM documents WHERE text IS NOT NULL), u AS (SELECT *, trim(split_part(s, chr(10), 1)) AS line FROM t)
SELECT doc_id, {_zh_n("constraints")} AS n_constraints, {_zh_n("sections")} AS n_sections, {_zh_n("code")} AS n_code, {_zh_n("files")} AS n_files, regexp_matches(s, '{_q(_ZH["role"])}') AS has_role,
regexp_matches(s, '{_q(_ZH["output_format"])}') AS has_output_format, regexp_matches(s, '{_q(_ZH["steps"])}') AS has_steps, regexp_matches(s, '{_q(_ZH["errors"])}') AS has_errors,
greatest(1, len(list_filter(string_split_regex(s, '[。！？；!?]+'), lambda x: length(trim(x)) > 0)))::BIGINT AS n_sentences,
CASE WHEN s = '' THEN 0.0 ELSE round(least(CASE WHEN {_ZH_STARTS} THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(line, '{_q(_ZH["files"])}') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(line, '{_q(_ZH["errors"])}') THEN 0.2 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(line, '[一-鿿]')) >= 8 OR length(line) >= 15 THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE END AS opening FROM u""")
def chinese_features(spark: SparkSession, d: str) -> DataFrame:
    """Features by the forms of Chinese, of every document whatever its language."""
    p = chinese.with_features(read_table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))
    return p.select("doc_id", "n_constraints", "n_sections", "n_code", "n_files", "has_role", "has_output_format", "has_steps", "has_errors", "n_sentences", r6(F.col("opening")).alias("opening"))


@query()
def segment_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Where the critical parts of prompts lie (tested by hand)."""
    p = _prompts(spark, d).select("source", features.distribution(features.segments("text")).alias("spread"))
    return p.groupBy("source", "spread").agg(F.count(F.lit(1)).alias("n"))


# Recommendations: prompts joined with what is known of their sessions ---------------------------------------------------------------
_META = "m AS (SELECT session_id, round(avg(effectiveness_score), 6) AS eff FROM prompts WHERE session_id IS NOT NULL GROUP BY session_id HAVING avg(effectiveness_score) IS NOT NULL)"
_JOINED = f"j AS (SELECT p.id, p.text, p.char_count, p.project, m.eff, {_CAT} AS category FROM prompts p JOIN m USING (session_id) WHERE p.duplicate_of IS NULL AND p.text IS NOT NULL)"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts")
    meta = p.filter("session_id IS NOT NULL").groupBy("session_id").agg(r6(F.avg("effectiveness_score")).alias("eff")).filter("eff IS NOT NULL")
    j = p.filter("duplicate_of IS NULL AND text IS NOT NULL").select("id", "text", "char_count", "project", "session_id").join(meta, "session_id")
    return j.withColumn("category", text.category(F.col("text")))


@query(f"""WITH {_META}, {_JOINED} SELECT id, char_count, round(eff, 2) AS effectiveness, project FROM j WHERE eff >= 0.6 ORDER BY eff DESC, char_count DESC, id LIMIT 10""")
def recommended_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Ten prompts of the most effective sessions (a top-k report)."""
    j = _joined(spark, d).filter("eff >= 0.6").orderBy(F.desc("eff"), F.desc_nulls_last("char_count"), "id").limit(10)
    return j.select("id", "char_count", F.round("eff", 2).alias("effectiveness"), "project")


@query(f"""WITH {_META}, {_JOINED} SELECT id, char_count, round(eff, 2) AS effectiveness, category FROM j WHERE char_count < 40 AND eff < 0.4 ORDER BY eff, id LIMIT 5""")
def short_prompt_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Five short prompts of the least effective sessions (a top-k report)."""
    j = _joined(spark, d).filter("char_count < 40 AND eff < 0.4").orderBy("eff", "id").limit(5)
    return j.select("id", "char_count", F.round("eff", 2).alias("effectiveness"), "category")


@query(f"""WITH {_META}, {_JOINED}, g AS (SELECT category, count(*) AS n, round(avg(eff), 6) AS effectiveness FROM j GROUP BY category),
b AS (SELECT category, id AS best_id, row_number() OVER (PARTITION BY category ORDER BY eff DESC, id) AS k FROM j WHERE eff >= 0.5) SELECT g.category, n, effectiveness, best_id FROM g LEFT JOIN b ON g.category = b.category AND k = 1""")
def category_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """Mean effectiveness by category, and the best prompt of each from sessions of a half or more."""
    best = F.min(F.when(F.col("eff") >= 0.5, F.struct(-F.col("eff"), "id")))["id"]
    return _joined(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("eff")).alias("effectiveness"), best.alias("best_id"))


@query(f"""
WITH c AS (SELECT {_CAT} AS category FROM prompts WHERE duplicate_of IS NULL AND text IS NOT NULL), g AS (SELECT count(*) AS n, avg((category = 'debug')::INT) AS debug, avg((category = 'test')::INT) AS test, avg((category = 'review')::INT) AS review FROM c)
SELECT n, round(debug, 6) AS debug, round(test, 6) AS test, round(review, 6) AS review, debug > 0.3 AS much_debugging, n > 20 AND test < 0.05 AS few_tests, n > 20 AND review < 0.03 AS few_reviews FROM g""")
def category_tips(spark: SparkSession, d: str) -> DataFrame:
    """Shares of categories that call for advice."""
    c = read_table(spark, d, "prompts").filter("duplicate_of IS NULL AND text IS NOT NULL").select(text.category(F.col("text")).alias("c"))
    of = lambda k: F.avg((F.col("c") == k).cast("double"))
    g = c.agg(F.count(F.lit(1)).alias("n"), *[of(k).alias(k) for k in ("debug", "test", "review")])
    many = F.col("n") > 20
    return g.select("n", *[r6(F.col(k)).alias(k) for k in ("debug", "test", "review")], (F.col("debug") > 0.3).alias("much_debugging"), (many & (F.col("test") < 0.05)).alias("few_tests"), (many & (F.col("review") < 0.03)).alias("few_reviews"))


# Stores ------------------------------------------------------------------------------------------------------------------------------
@query("""
WITH m AS (SELECT session_id, max(effectiveness_score) AS q FROM prompts WHERE session_id IS NOT NULL AND effectiveness_score > 0.5 GROUP BY session_id)
SELECT source, count(*) AS n, round(sum(coalesce(m.q, p.effectiveness_score)), 4) AS total, count(m.q) AS n_set FROM prompts p LEFT JOIN m USING (session_id) GROUP BY source""")
def update_by_session(spark: SparkSession, d: str) -> DataFrame:
    """A session's quality is written to all its prompts; sessions without one leave theirs as they were."""
    p = read_table(spark, d, "prompts").select("id", "source", "session_id", "effectiveness_score")
    new = p.filter("session_id IS NOT NULL AND effectiveness_score > 0.5").groupBy("session_id").agg(F.max("effectiveness_score").alias("effectiveness_score"))
    out = stores.update(p, new, ["session_id"], ["effectiveness_score"]).withColumnRenamed("effectiveness_score", "e")
    out = out.join(new.select("session_id", F.lit(1).alias("_set")), "session_id", "left")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e"), 4).alias("total"), F.count("_set").alias("n_set"))


@query("""
WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS term FROM prompts WHERE text IS NOT NULL), o AS (SELECT term, count(*) AS n FROM w GROUP BY term),
x AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS term FROM prompt_batches WHERE text IS NOT NULL), b AS (SELECT term, count(*) AS n FROM x GROUP BY term)
SELECT left(coalesce(b.term, o.term), 1) AS letter, count(*) AS n_terms, CAST(sum(coalesce(b.n, o.n)) AS BIGINT) AS total, count(b.term) AS n_replaced FROM o FULL JOIN b ON o.term = b.term GROUP BY 1""")
def upsert_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of terms, those of the new batches in place of the old."""
    counts = lambda t, new: read_table(spark, d, t).filter("text IS NOT NULL").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter(F.length("term") > 3).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("new", F.lit(new))
    out = stores.upsert(counts("prompts", 0), counts("prompt_batches", 1), ["term"], ["n"])
    return out.groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("total"), F.sum("new").cast("bigint").alias("n_replaced"))


@query("""
WITH o AS (SELECT session_id, min(id) AS first_id, max(effectiveness_score) AS eff FROM prompts WHERE session_id IS NOT NULL GROUP BY session_id), n AS (SELECT session_id, min(item_id) AS first_id, 0.5 AS eff FROM prompt_batches WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT coalesce(n.session_id, o.session_id) AS session_id, coalesce(o.first_id, n.first_id) AS first_id, round(CASE WHEN n.session_id IS NULL THEN o.eff ELSE n.eff END, 6) AS eff FROM o FULL JOIN n ON o.session_id = n.session_id""")
def upsert_session_meta(spark: SparkSession, d: str) -> DataFrame:
    """Sessions seen again take the new effectiveness and keep the rest."""
    old = read_table(spark, d, "prompts").filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min("id").alias("first_id"), F.max("effectiveness_score").alias("eff"))
    new = read_table(spark, d, "prompt_batches").filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min("item_id").alias("first_id"), F.lit(0.5).alias("eff"))
    return stores.upsert(old, new, ["session_id"], ["eff"], keep=("first_id",)).select("session_id", "first_id", r6(F.col("eff")).alias("eff"))


_WEEK = "CAST(floor((epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) / 604800000000) AS BIGINT)"


@query(f"""SELECT {_WEEK} AS week, count(*) AS n, round(avg(score_total), 6) AS avg_total FROM telemetry_event WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """The latest twelve weekly snapshots (the feature is the latest N)."""
    t = read_table(spark, d, "telemetry_event").filter("created_at IS NOT NULL")
    week = F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(604800000000)).cast("bigint")
    return t.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score_total")).alias("avg_total")).orderBy(F.desc("week")).limit(12)


# Lookups -----------------------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT source FROM prompts WHERE source <> ''")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "prompts").filter("source <> ''").select("source").distinct()


@query("""SELECT session_id, count(*) AS n, round(avg(effectiveness_score), 6) AS quality FROM prompts WHERE session_id IS NOT NULL GROUP BY session_id HAVING avg(effectiveness_score) IS NOT NULL ORDER BY 3 DESC, session_id LIMIT 20""")
def sessions_by_quality(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best sessions (a top-k report)."""
    g = read_table(spark, d, "prompts").filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("effectiveness_score")).alias("quality"))
    return g.filter("quality IS NOT NULL").orderBy(F.desc("quality"), "session_id").limit(20)


@query("""WITH p AS (SELECT min(left(session_id, 9)) AS p FROM prompts WHERE session_id IS NOT NULL) SELECT session_id, count(*) AS n FROM prompts, p WHERE starts_with(session_id, p.p) GROUP BY session_id""")
def session_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by the first characters of their name, an exact name before all others."""
    p = read_table(spark, d, "prompts").filter("session_id IS NOT NULL")
    first = p.agg(F.min(F.substring("session_id", 1, 9))).first()[0] or ""
    return stores.by_prefix(p.select("session_id"), "session_id", first).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH t AS (SELECT sha256({_S}) AS h, {_CAT} AS category, id FROM prompts WHERE text IS NOT NULL), g AS (SELECT h, any_value(category) AS category, count(*) AS frequency, min(id) AS first_id FROM t GROUP BY h HAVING count(*) >= 3)
SELECT category, first_id, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY frequency DESC, first_id) AS rank FROM g) WHERE rank <= 10""")
def patterns_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Ten most frequent texts of each category (a top-k report)."""
    t = _prompts(spark, d).select("id", text.content_hash(F.col("text")).alias("h"), text.category(F.col("text")).alias("category"))
    g = t.groupBy("h").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("frequency"), F.min("id").alias("first_id")).filter("frequency >= 3")
    w = Window.partitionBy("category").orderBy(F.desc("frequency"), "first_id")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 10").select("category", "first_id", "frequency", "rank")


@query("""SELECT queue_id, score_total, rank FROM (SELECT queue_id, round(score_total, 6) AS score_total, row_number() OVER (PARTITION BY task_type ORDER BY score_total DESC, queue_id) AS rank FROM telemetry_event WHERE task_type IS NOT NULL AND score_total IS NOT NULL) WHERE rank <= 5""")
def features_by_task(spark: SparkSession, d: str) -> DataFrame:
    """Five highest scores of each task (a top-k report)."""
    w = Window.partitionBy("task_type").orderBy(F.desc("score_total"), "queue_id")
    t = read_table(spark, d, "telemetry_event").filter("task_type IS NOT NULL AND score_total IS NOT NULL").withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5")
    return t.select("queue_id", r6(F.col("score_total")).alias("score_total"), "rank")


@query("""SELECT source, count(*) AS n, count(*) FILTER (duplicate_of IS NULL) AS n_unique FROM prompts WHERE embedding IS NULL GROUP BY source""")
def without_embedding(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "prompts").filter("embedding IS NULL")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duplicate_of").isNull()).alias("n_unique"))


# Templates ---------------------------------------------------------------------------------------------------------------------------
@query("""SELECT id, replace(replace('Look at {project} in {source} ({ticket})', '{project}', coalesce(project, '{project}')), '{source}', coalesce(source, '{source}')) AS rendered, CASE WHEN project IS NULL THEN 2 ELSE 1 END + CASE WHEN source IS NULL THEN 1 ELSE 0 END AS n_open FROM prompts""")
def rendered_templates(spark: SparkSession, d: str) -> DataFrame:
    """A template filled in from columns; what has no value stays open."""
    t = templates.render(F.lit("Look at {project} in {source} ({ticket})"), {"project": F.col("project"), "source": F.col("source")})
    p = read_table(spark, d, "prompts").select("id", "project", "source", t.alias("rendered"))
    return p.select("id", "rendered", (F.lit(1) + F.col("project").isNull().cast("int") + F.col("source").isNull().cast("int")).alias("n_open"))


@query(r"""
WITH t AS (SELECT item_id, coalesce(nullif(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], '-'), ''), 'template') AS slug FROM prompt_batches WHERE text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY item_id) AS k FROM t) SELECT item_id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS name FROM n""")
def template_names(spark: SparkSession, d: str) -> DataFrame:
    """A name of its own for each text."""
    return templates.named(read_table(spark, d, "prompt_batches").filter("text IS NOT NULL").select("item_id", "text"), "text", ["item_id"]).select("item_id", "name")


# Dashboards --------------------------------------------------------------------------------------------------------------------------
@query("""
WITH e AS (SELECT max(ingested_at) AS e FROM prompts), s AS (SELECT session_id, count(*) AS n FROM prompts GROUP BY session_id HAVING count(*) >= 60)
SELECT count(*) FILTER (ingested_at > e - INTERVAL 7 DAY) AS n_week, count(*) FILTER (ingested_at > e - INTERVAL 14 DAY AND ingested_at <= e - INTERVAL 7 DAY) AS n_week_before, count(DISTINCT session_id) AS n_sessions, (SELECT count(*) FROM s) AS n_long FROM prompts, e""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The last seven days before the latest row, those before, and sessions of sixty prompts or more."""
    p = read_table(spark, d, "prompts").select("session_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))
    end, week = p.agg(F.max("at")).first()[0] or 0, 7 * 86_400_000_000
    per = p.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") > end - week).alias("a"), F.count_if((F.col("at") > end - 2 * week) & (F.col("at") <= end - week)).alias("b"))
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_week"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_week_before"), F.count("session_id").alias("n_sessions"), F.count_if(F.col("n") >= 60).alias("n_long"))


@query(f"""
WITH c AS (SELECT {_CAT} AS category, effectiveness_score AS e FROM prompts WHERE text IS NOT NULL AND effectiveness_score IS NOT NULL), g AS (SELECT category, round(avg(e), 6) AS eff, count(*) AS n FROM c GROUP BY category),
r AS (SELECT *, row_number() OVER (ORDER BY eff DESC, category) AS best, row_number() OVER (ORDER BY eff, category) AS worst, count(*) OVER () AS k FROM g) SELECT category, eff, n, CASE WHEN best <= 3 THEN 'best' ELSE 'worst' END AS part FROM r WHERE best <= 3 OR (worst = 1 AND k > 3)""")
def effectiveness_insight(spark: SparkSession, d: str) -> DataFrame:
    """The three best categories, and the worst one if there are more."""
    c = _prompts(spark, d).filter("effectiveness_score IS NOT NULL").groupBy(text.category(F.col("text")).alias("category")).agg(r6(F.avg("effectiveness_score")).alias("eff"), F.count(F.lit(1)).alias("n"))
    # One row per category: a window over all of them is one small partition.
    one = Window.partitionBy(F.lit(1))
    r = c.withColumns({"best": F.row_number().over(one.orderBy(F.desc("eff"), "category")), "worst": F.row_number().over(one.orderBy("eff", "category")), "k": F.count(F.lit(1)).over(one)})
    return r.filter((F.col("best") <= 3) | ((F.col("worst") == 1) & (F.col("k") > 3))).select("category", "eff", "n", F.when(F.col("best") <= 3, "best").otherwise("worst").alias("part"))


_SPECIFIC = r"\b\w+\.(?:py|ts|js|go|rs|java|rb|sql|md)\b|\b\w+_\w+\b|line \d+"


@query(f"""
WITH w AS (SELECT CASE WHEN ingested_at >= TIMESTAMP '2025-07-01' THEN 'newer' ELSE 'older' END AS part, text FROM prompts WHERE text IS NOT NULL AND ingested_at IS NOT NULL)
SELECT part, count(*) AS n, round(avg(length(text)), 6) AS avg_chars, round(avg((regexp_matches(text, '{_q(_SPECIFIC)}') OR length(text) > 60)::INT), 6) AS specific, round(avg((length(text) < 30)::INT), 6) AS tiny, count(DISTINCT {_CAT}) AS n_categories FROM w GROUP BY part""")
def style_trends(spark: SparkSession, d: str) -> DataFrame:
    """Style before and after an instant."""
    p = _prompts(spark, d).filter("ingested_at IS NOT NULL").withColumn("part", F.when(F.col("ingested_at") >= F.lit("2025-07-01").cast("timestamp_ntz"), "newer").otherwise("older"))
    n = F.length("text")
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(n)).alias("avg_chars"), r6(F.avg((F.col("text").rlike(_SPECIFIC) | (n > 60)).cast("int"))).alias("specific"), r6(F.avg((n < 30).cast("int"))).alias("tiny"), F.countDistinct(text.category(F.col("text"))).alias("n_categories"))


def _noise_sql() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    prefix = " AND ".join(f"NOT starts_with(s, {quote(p)})" for p in text.NOISE_PREFIX)
    inside = " AND ".join(f"NOT contains(s, {quote(p)})" for p in text.NOISE_INSIDE)
    status = " AND ".join(f"NOT regexp_matches(s, {quote(p)})" for p in text.NOISE_STATUS)
    return f"""WITH t AS (SELECT source, regexp_replace(coalesce(text, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS s FROM prompts)
SELECT source, count(*) AS n, count(*) FILTER (length(s) >= 10 AND s NOT IN ({", ".join(map(quote, text.NOISE_EXACT))}) AND {prefix} AND {inside} AND {status} AND regexp_matches(s, '[a-zA-Z一-鿿]')
AND NOT regexp_matches(s, '(?i)^(?:{"|".join(text.NOISE_COMMANDS)})\\b') AND NOT regexp_matches(s, '<(?:{"|".join(text.NOISE_TOOL_TAGS)})\\b')) AS n_kept FROM t GROUP BY source"""


@query(_noise_sql())
def kept_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that are prompts rather than noise of the tools."""
    return read_table(spark, d, "prompts").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.keep(F.col("text"))).alias("n_kept"))


@query("""
WITH w AS (SELECT CAST(floor((epoch_us(ingested_at) - epoch_us(TIMESTAMP '2025-01-01')) / 2592000000000) AS BIGINT) AS no, text FROM prompts WHERE ingested_at >= TIMESTAMP '2025-01-01' AND ingested_at < TIMESTAMP '2025-06-30' AND text IS NOT NULL),
t AS (SELECT no, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 2)) AS x FROM w), v AS (SELECT no, count(DISTINCT x) AS vocabulary FROM t GROUP BY no),
a AS (SELECT no, count(*) AS n, round(avg(length(text)), 6) AS avg_chars, round(median(length(text)), 2) AS median_chars FROM w GROUP BY no)
SELECT s.no, coalesce(n, 0) AS n, avg_chars, median_chars, coalesce(vocabulary, 0) AS vocabulary FROM range(0, 6) s(no) LEFT JOIN a ON a.no = s.no LEFT JOIN v ON v.no = s.no""")
def window_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Six adjacent windows of thirty days with counts, lengths and vocabulary; empty ones have a row."""
    end, period = datetime(2025, 6, 30), periods.parse_period("1m")
    p = _prompts(spark, d).select(F.col("ingested_at").cast("timestamp").alias("at"), "text")
    a = periods.snapshots(p, "at", end, period, 6, {"avg_chars": r6(F.avg(F.length("text"))), "median_chars": F.round(F.median(F.length("text")), 2)})
    words = p.withColumn("no", periods.window_no(F.col("at"), end, period, 6)).filter("no IS NOT NULL").select("no", F.explode(F.split(F.lower("text"), r"\s+")).alias("x")).filter(F.length("x") > 2)
    v = words.distinct().groupBy("no").agg(F.count(F.lit(1)).alias("vocabulary"))
    return a.join(v, "no", "left").select("no", F.col("n_rows").alias("n"), "avg_chars", "median_chars", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"))


@query("""SELECT 200 AS n_sessions, 1200 AS n_turns, 600 AS n_prompts""")
def demo_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred invented sessions through the turns of agents."""
    t = agents.turns_of_lines(demo.sessions(spark, 200))
    return t.agg(F.countDistinct("session_id").cast("int").alias("n_sessions"), F.count(F.lit(1)).cast("int").alias("n_turns"), F.count_if(F.col("role") == "user").cast("int").alias("n_prompts"))


@query()
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every new prompt's vector by the default embedder: how many of its buckets are filled, and its length."""
    p = read_table(spark, d, "prompt_batches").select("item_id", "text")
    v = embedders.embed(p, "item_id", "text")
    return v.select("item_id", F.size(F.filter("vector", lambda x: x > 0)).alias("filled"), r6(F.sqrt(tfidf.dot(F.col("vector"), F.col("vector")))).alias("norm"))


@query()
def named_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar new prompts with a name and the member that stands best for each (tested by hand)."""
    p = materialize(read_table(spark, d, "prompt_batches").filter("text IS NOT NULL").select("item_id", "text"), "texts")
    vectors = tfidf.weights(tfidf.term_counts(p, "item_id", text.stem4(F.col("text"))), "item_id")
    found = graph.connected_components(tfidf.cosine_pairs(vectors, "item_id", 0.75).select("a", "b")).toDF("item_id", "cluster")
    c = p.join(found, "item_id").withColumn("n", F.length("text"))
    longest = c.groupBy("cluster").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("size"))
    c = c.join(longest, "cluster").withColumn("score", text.canonical_score(F.col("n"), F.col("longest"), F.col("text"), F.lit(None).cast("double")))
    best = c.groupBy("cluster").agg(F.max("size").alias("size"), F.min(F.struct(-F.col("score"), "item_id", "text")).alias("b"))
    return best.select("cluster", "size", F.col("b.item_id").alias("canonical_id"), text.cluster_name(F.col("b.text")).alias("name"))
