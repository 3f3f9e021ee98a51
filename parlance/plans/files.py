"""Queries that write session logs from the test tables in the forms of the tools, and read them with their readers; with the SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.plans.reports import QUERIES, SQL, query
from parlance.session import new_folder, read_table
from parlance.sources import files, readers

__all__ = ["QUERIES", "SQL"]


def _write(df: DataFrame, order: list[str]) -> int:
    """Lines (path, line) written; the number of files."""
    return files.write_lines(df, "path", "line", order).count()


def _by_role(rows: DataFrame) -> DataFrame:
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.countDistinct("session_id").alias("n_sessions"), F.sum(F.size("tools")).cast("bigint").alias("n_tools"), F.count_if(F.col("failed")).alias("n_failed"))


def _uri(folder: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(folder), *[F.lit(p) if isinstance(p, str) else p for p in parts])


_BLOCKS = """b AS (SELECT *, CASE WHEN ltrim(c) LIKE '[%' AND json_valid(c) THEN json_extract(c, '$[*]') END AS bl FROM r),
t AS (SELECT *, CASE WHEN bl IS NULL THEN c ELSE coalesce(array_to_string(list_transform(list_filter(bl, lambda x: json_extract_string(x, '$.type') = 'text'), lambda x: json_extract_string(x, '$.text')), ' '), '') END AS text,
CASE WHEN bl IS NULL THEN 0 ELSE len(list_filter(bl, lambda x: json_extract_string(x, '$.type') = 'tool_use')) END AS calls FROM b)"""
_ROLES = "count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT session_id) AS n_sessions, CAST(sum(calls) AS BIGINT) AS n_tools, count(*) FILTER (regexp_matches(text, '[Ee]rror|[Tt]raceback')) AS n_failed"
_SAID = "(length(trim(coalesce(text, ''))) > 0 OR calls > 0)"


@query(f"""
WITH r AS (SELECT session_id, type AS role, message.content AS c FROM claude_session WHERE session_id IS NOT NULL AND type IN ('user', 'assistant') AND type = message.role), {_BLOCKS}
SELECT role, {_ROLES} FROM t WHERE {_SAID} GROUP BY role""")
def read_claude_code(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines by session: roles, text and tools of blocks."""
    folder = new_folder(spark, "claude-code")
    rows = read_table(spark, d, "claude_session").filter("session_id IS NOT NULL")
    lines = rows.select(_uri(folder, "/-home-dev-app/", F.col("session_id"), ".jsonl").alias("path"), "rec_id", F.to_json(F.struct("type", "timestamp", "message")).alias("line"))
    _write(lines, ["rec_id"])
    return _by_role(readers.claude_code(spark, folder))


@query(f"""
WITH r AS (SELECT session_id, message.role AS role, message.content AS c FROM claude_session WHERE session_id IS NOT NULL AND message.role IN ('user', 'assistant')), {_BLOCKS}
SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT session_id) AS n_sessions, CAST(0 AS BIGINT) AS n_tools, count(*) FILTER (regexp_matches(text, '[Ee]rror|[Tt]raceback')) AS n_failed FROM t WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY role""")
def read_openclaw(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines that name their session, several sessions in one file."""
    folder = new_folder(spark, "openclaw")
    rows = read_table(spark, d, "claude_session").filter("session_id IS NOT NULL AND message.role IS NOT NULL")
    line = F.to_json(F.struct(F.col("message.role").alias("role"), F.col("message.content").alias("content"), "session_id", "timestamp"))
    _write(rows.select(_uri(folder, "/log-", F.pmod("rec_id", F.lit(16)).cast("string"), ".jsonl").alias("path"), "rec_id", line.alias("line")), ["rec_id"])
    return _by_role(readers.openclaw(spark, folder))


@query("""
WITH e AS (SELECT session_id, rec_id, type, message.content AS c, sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rec_id ROWS UNBOUNDED PRECEDING) AS turn FROM claude_session WHERE session_id IS NOT NULL AND type IN ('user', 'assistant', 'system') AND message IS NOT NULL),
g AS (SELECT session_id, turn, type = 'user' AS u, array_to_string(list(c ORDER BY rec_id) FILTER (type <> 'system' AND c IS NOT NULL), chr(10)) AS text, count(*) FILTER (type = 'system') AS calls FROM e GROUP BY 1, 2, 3)
SELECT CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(sum(calls) AS BIGINT) AS n_tools FROM g WHERE length(trim(coalesce(text, ''))) > 0 OR calls > 0 GROUP BY 1""")
def read_codex(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts of events: those between two user messages fold into one assistant turn."""
    folder = new_folder(spark, "codex")
    rows = read_table(spark, d, "claude_session").filter("session_id IS NOT NULL AND type IN ('user', 'assistant', 'system') AND message IS NOT NULL")
    kind = F.when(F.col("type") == "user", "user_message").when(F.col("type") == "assistant", "agent_message").otherwise("function_call")
    payload = F.struct(kind.alias("type"), F.when(F.col("type") != "system", F.col("message.content")).alias("message"), F.when(F.col("type") == "system", F.lit("shell")).alias("name"))
    line = F.to_json(F.struct("timestamp", F.lit("event_msg").alias("type"), payload.alias("payload")))
    _write(rows.select(_uri(folder, "/2025/rollout-", F.col("session_id"), ".jsonl").alias("path"), "rec_id", line.alias("line")), ["rec_id"])
    return _by_role(readers.codex(spark, folder)).select("role", "n", "n_chars", "n_tools")


@query("""
WITH m AS (SELECT session_id, CASE WHEN type = 'user' THEN 'user' WHEN type IN ('gemini', 'model', 'assistant') THEN 'assistant' END AS role, CASE WHEN ltrim(content) LIKE '[%' AND json_valid(content) THEN array_to_string(list_transform(json_extract(content, '$[*]'), lambda x: json_extract_string(x, '$.text')), ' ') ELSE content END AS text FROM gemini_session WHERE session_id IS NOT NULL)
SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT session_id) AS n_sessions FROM m WHERE role IS NOT NULL AND length(trim(coalesce(text, ''))) > 0 GROUP BY role""")
def read_gemini(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document by session with its messages."""
    folder = new_folder(spark, "gemini")
    rows = read_table(spark, d, "gemini_session").filter("session_id IS NOT NULL")
    rows = rows.select(_uri(folder, "/chats/session-", F.col("session_id"), ".json").alias("path"), "rec_id", "session_id", F.to_json(F.struct(F.col("msg_id").alias("id"), "type", "content", "model", "timestamp")).alias("item"))
    lines = files.array_lines(rows, "path", "item", ["rec_id"], """concat('{"sessionId": "', session_id, '", "messages": [')""", "]}")
    _write(lines, ["part", "_k"])
    return _by_role(readers.gemini(spark, folder)).select("role", "n", "n_chars", "n_sessions")


@query(f"""
WITH r AS (SELECT task_id AS session_id, role, content AS c FROM api_conversation_history WHERE task_id IS NOT NULL AND content IS NOT NULL), {_BLOCKS},
k AS (SELECT * FROM t WHERE bl IS NULL OR len(list_filter(bl, lambda x: json_extract_string(x, '$.type') = 'tool_result')) = 0)
SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT session_id) AS n_sessions, CAST(sum(calls) AS BIGINT) AS n_tools FROM k WHERE role IN ('user', 'assistant') AND {_SAID} GROUP BY role""")
def read_cline(spark: SparkSession, d: str) -> DataFrame:
    """One JSON array by task; messages with tool results are no prompts."""
    folder = new_folder(spark, "cline")
    rows = read_table(spark, d, "api_conversation_history").filter("task_id IS NOT NULL AND content IS NOT NULL")
    rows = rows.select(_uri(folder, "/tasks/", F.col("task_id"), "/api_conversation_history.json").alias("path"), "rec_id", F.to_json(F.struct("role", "content")).alias("item"))
    _write(files.array_lines(rows, "path", "item", ["rec_id"]), ["part", "_k"])
    return _by_role(readers.cline(spark, folder)).select("role", "n", "n_chars", "n_sessions", "n_tools")


@query("""
WITH m AS (SELECT conversation_id, unnest(map_values(mapping)) AS v FROM chatgpt_conversations WHERE mapping IS NOT NULL),
t AS (SELECT v.message.author.role AS role, array_to_string(list_filter(v.message.content.parts, lambda p: NOT starts_with(ltrim(p), '{')), '') AS text FROM m WHERE v.message IS NOT NULL)
SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t WHERE role IN ('user', 'assistant') AND length(trim(coalesce(text, ''))) > 0 GROUP BY role""")
def read_chatgpt(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of conversations with mappings."""
    folder = new_folder(spark, "chatgpt")
    rows = read_table(spark, d, "chatgpt_conversations").select(_uri(folder, "/export-", F.pmod("rec_id", F.lit(16)).cast("string"), ".json").alias("path"), "rec_id", F.to_json(F.struct("title", F.col("update_time").alias("create_time"), "mapping")).alias("item"))
    _write(files.array_lines(rows, "path", "item", ["rec_id"]), ["part", "_k"])
    return _by_role(readers.chatgpt(spark, folder)).select("role", "n", "n_chars")


@query("""
WITH m AS (SELECT uuid, unnest(chat_messages) AS m FROM claude_chat_export WHERE chat_messages IS NOT NULL),
t AS (SELECT uuid, CASE WHEN lower(trim(m.sender)) = 'human' THEN 'user' ELSE lower(trim(m.sender)) END AS role, coalesce(nullif(trim(array_to_string(list_transform(list_filter(m.content, lambda x: x.type = 'text'), lambda x: x.text), ' ')), ''), m.text) AS text FROM m)
SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT uuid) AS n_sessions FROM t WHERE role IN ('user', 'assistant') AND length(trim(coalesce(text, ''))) > 0 GROUP BY role""")
def read_claude_chat(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of conversations with chat_messages."""
    folder = new_folder(spark, "claude-chat")
    rows = read_table(spark, d, "claude_chat_export").select(_uri(folder, "/export-", F.pmod("rec_id", F.lit(16)).cast("string"), ".json").alias("path"), "rec_id", F.to_json(F.struct("uuid", "name", "chat_messages")).alias("item"))
    _write(files.array_lines(rows, "path", "item", ["rec_id"]), ["part", "_k"])
    return _by_role(readers.claude_chat(spark, folder)).select("role", "n", "n_chars", "n_sessions")


@query(r"""
WITH p AS (SELECT source, id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text FROM prompts WHERE text IS NOT NULL)
SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT source) AS n_sessions FROM p WHERE length(text) > 0""")
def read_aider(spark: SparkSession, d: str) -> DataFrame:
    """Markdown histories: a header carries forward to the lines after it; the files' names begin with a dot."""
    folder = new_folder(spark, "aider")
    p = read_table(spark, d, "prompts").filter("text IS NOT NULL")
    path = _uri(folder, "/", F.coalesce("source", F.lit("none")), "/.aider.chat.history.md")
    lines = p.select(path.alias("path"), F.lit(1).alias("part"), "id", F.concat(F.lit("#### "), F.regexp_replace("text", r"[\r\n]+", " ")).alias("line"))
    heads = p.select(path.alias("path")).distinct().select("path", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("id"), F.lit("# aider chat started at 2025-03-01 10:00:00").alias("line"))
    _write(lines.unionByName(heads), ["part", "id"])
    r = readers.aider(spark, folder)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.countDistinct("session_id").alias("n_sessions"))


@query(f"""
WITH r AS (SELECT session_id, type AS role, timestamp AS raw, rec_id, message.content AS c FROM claude_session WHERE session_id IS NOT NULL AND type IN ('user', 'assistant') AND type = message.role), {_BLOCKS}
SELECT session_id, count(*) FILTER (role = 'user') AS n_prompts, count(*) AS n_turns, CAST(sum(calls) AS BIGINT) AS n_tools, round(avg(length(text)) FILTER (role = 'user'), 6) AS avg_chars, first(raw ORDER BY rec_id) AS first_seen FROM t WHERE {_SAID} GROUP BY session_id""")
def read_session_meta(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the sessions that a reader gives."""
    folder = new_folder(spark, "claude-code")
    rows = read_table(spark, d, "claude_session").filter("session_id IS NOT NULL")
    _write(rows.select(_uri(folder, "/-home-dev-app/", F.col("session_id"), ".jsonl").alias("path"), "rec_id", F.to_json(F.struct("type", "timestamp", "message")).alias("line")), ["rec_id"])
    m = readers.session_meta(readers.read_sessions(spark, "claude-code", folder))
    return m.select("session_id", "n_prompts", "n_turns", "n_tools", F.round("avg_chars", 6).alias("avg_chars"), "first_seen")
