"""Readers of session logs: each gives rows of one shape, lazily and with explicit schemas.

Shape: source, file, session_id, project, seq (order within the file), role (user or assistant), text, timestamp (as logged), tools
(names), failed (whether the text tells of an error).

Damaged lines and files that are no JSON give no rows; a missing timestamp is null; blank messages give no rows; folders without
matching files raise Spark's own error.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHAPE = ["source", "file", "session_id", "project", "seq", "role", "text", "timestamp", "tools", "failed"]
_BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string>>>"


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(value, file, seq): lines in file order, also of files that are read in several blocks."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))


def _hidden_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value, file, seq) of all files of a name below a folder, where the name begins with a dot: Spark's own sources pass over those.

    Only paths are listed by the driver; the files are read in the tasks, a line at a time.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, it = [], root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    while it.hasNext():
        file = it.next().getPath()
        if file.getName() == name:
            found.append((file.toUri().toString(),))
    files = spark.createDataFrame(found, "file string").repartition(max(1, min(len(found), 1000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, place = pa.fs.FileSystem.from_uri(file)
                with io.TextIOWrapper(fs.open_input_stream(place), "utf-8", "replace") as f:
                    values, at = [], 0
                    for line in f:
                        values.append(line.rstrip("\r\n"))
                        if len(values) == 10_000:
                            yield _numbered(file, values, at)
                            values, at = [], at + len(values)
                    yield _numbered(file, values, at)

    df = files.mapInArrow(run, "value string, file string, row bigint")
    return df.select("value", "file", F.struct(F.lit(0).cast("bigint").alias("block"), "row").alias("seq"))


def _numbered(file: str, values: list[str], at: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "file": pa.array([file] * len(values), pa.string()), "row": pa.array(range(at, at + len(values)), pa.int64())})


def _json(spark: SparkSession, path: str, glob: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_row"))


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1), F.lit(""))


def blocks(content: Column) -> Column:
    """The blocks of a content that is a JSON array; null for plain text."""
    return F.from_json(F.when(F.ltrim(content).startswith("["), content), _BLOCKS)


def content_text(content: Column, joint: str = " ", typed: bool = True) -> Column:
    """Plain content, or its text blocks joined; not typed: all blocks with a text, whatever their type."""
    b = blocks(content)
    said = F.filter(b, (lambda x: x["type"] == "text") if typed else (lambda x: x["text"].isNotNull()))
    return F.when(b.isNull(), content).otherwise(F.array_join(F.transform(said, lambda x: x["text"]), joint))


def tool_names(content: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(F.filter(blocks(content), lambda x: x["type"] == "tool_use"), lambda x: x["name"]), none)


def _shape(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    base = {
        "session_id": stem(F.col("file")),
        "project": parent(F.col("file")),
        "timestamp": F.lit(None).cast("string"),
        "tools": F.array().cast("array<string>"),
        "seq": F.col("seq") if "seq" in df.columns else F.col("_row"),
    }
    base |= cols
    base["failed"] = F.coalesce(base["text"].rlike("[Ee]rror|[Tt]raceback"), F.lit(False))
    out = df.select(F.lit(source).alias("source"), "file", *[base[c].alias(c) for c in SHAPE[2:]])
    said = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return out.filter(F.col("role").isin("user", "assistant") & (said | (F.size("tools") > 0)))


def claude_code(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {type, timestamp, message: {role, content}}; the project is the last part of the folder's dash-coded name."""
    line = F.from_json("value", "type string, timestamp string, message struct<role:string,content:string>")
    df = _lines(spark, path, "*.jsonl").withColumn("j", line).filter(F.col("j.type").isin("user", "assistant") & (F.col("j.type") == F.col("j.message.role")))
    c = F.col("j.message.content")
    tags = F.trim(F.regexp_replace(content_text(c), r"<(ide_\w+|system-reminder)>[\s\S]*?</\1>", ""))
    folder = F.element_at(F.split(parent(F.col("file")), "-"), -1)
    return _shape(df, "claude-code", role=F.col("j.type"), text=F.coalesce(F.nullif(tags, F.lit("")), content_text(c)), timestamp=F.col("j.timestamp"), tools=tool_names(c), project=F.nullif(folder, F.lit("")))


def openclaw(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {role, content, session_id?, timestamp?}; the session in the data wins over the file's name."""
    df = _lines(spark, path, "*.jsonl").withColumn("j", F.from_json("value", "role string, content string, session_id string, timestamp string")).filter("j.role IS NOT NULL")
    return _shape(df, "openclaw", role=F.col("j.role"), text=content_text(F.col("j.content")), session_id=F.coalesce("j.session_id", stem(F.col("file"))), timestamp=F.col("j.timestamp"))


def codex(spark: SparkSession, path: str) -> DataFrame:
    """Rollout lines {timestamp, type, payload}: events between two user messages fold into one assistant turn; the project is the last cwd before a line."""
    schema = "timestamp string, type string, payload struct<type:string,message:string,cwd:string,name:string,exit_code:int,aggregated_output:string>"
    df = _lines(spark, path, "rollout-*.jsonl").withColumn("j", F.from_json("value", schema)).filter("j.payload IS NOT NULL")
    w = Window.partitionBy("file").orderBy("seq")
    p = F.col("j.payload")
    user = p["type"] == "user_message"
    df = df.withColumn("cwd", F.last(p["cwd"], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("user", F.coalesce(user, F.lit(False)))
    df = df.withColumn("turn", F.sum(F.when(F.col("user"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    events = df.filter(p["type"].isin("user_message", "agent_message", "local_shell_call", "function_call", "exec_command_end", "error"))
    tool = F.when(p["type"].isin("local_shell_call", "function_call"), F.coalesce(p["name"], p["type"]))
    said = F.when(p["type"].isin("user_message", "agent_message", "error"), p["message"])
    bad = F.when((p["type"] == "error") | ((p["type"] == "exec_command_end") & (p["exit_code"] != 0)), 1).otherwise(0)
    in_order = lambda c: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("seq", c.alias("v"))), lambda x: x["v"].isNotNull())), lambda x: x["v"])
    g = events.groupBy("file", "turn", "user").agg(F.min("seq").alias("seq"), F.first("cwd", ignorenulls=True).alias("cwd"), F.min("j.timestamp").alias("timestamp"), in_order(said).alias("said"), in_order(tool).alias("tools"), F.max(bad).alias("bad"))
    out = _shape(
        g, "codex", role=F.when(F.col("user"), "user").otherwise("assistant"), text=F.array_join("said", "\n"), timestamp=F.col("timestamp"), tools=F.col("tools"),
        project=F.nullif(F.regexp_extract("cwd", r"([^/]+)/?$", 1), F.lit("")), session_id=F.right(stem(F.col("file")), F.lit(36)),
    )
    failed = g.filter("bad = 1").select("file", "seq", F.lit(True).alias("_bad"))
    return out.join(failed, ["file", "seq"], "left").withColumn("failed", F.col("failed") | F.coalesce("_bad", F.lit(False))).select(*SHAPE)


def aider(spark: SparkSession, path: str) -> DataFrame:
    """Markdown history: a session header carries forward to the `#### ` lines after it."""
    df = _hidden_lines(spark, path, ".aider.chat.history.md")
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started = F.nullif(F.regexp_extract("value", r"^# aider chat started at (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit(""))
    df = df.withColumn("started", F.last(started, ignorenulls=True).over(w)).filter(F.col("value").startswith("#### "))
    return _shape(df, "aider", role=F.lit("user"), text=F.trim(F.substring("value", 6, 1 << 30)), timestamp=F.col("started"), session_id=F.concat_ws("-", F.lit("aider"), parent(F.col("file")), F.regexp_replace("started", r"\D", "")))


def gemini(spark: SparkSession, path: str) -> DataFrame:
    """JSON {sessionId, messages: [{id, type, content, timestamp}]}."""
    df = _json(spark, path, "session-*.json", "sessionId string, projectHash string, messages array<struct<id:string,type:string,content:string,model:string,timestamp:string>>")
    df = df.select("*", F.posexplode("messages").alias("pos", "m")).withColumn("seq", F.struct("_row", "pos"))
    role = F.when(F.col("m.type") == "user", "user").when(F.col("m.type").isin("gemini", "model", "assistant"), "assistant")
    return _shape(df, "gemini", role=role, text=content_text(F.col("m.content"), typed=False), session_id=F.coalesce("sessionId", stem(F.col("file"))), project=F.col("projectHash"), timestamp=F.col("m.timestamp"))


def cline(spark: SparkSession, path: str) -> DataFrame:
    """JSON array [{role, content}]; messages with a tool result are no prompts; the folder is the task."""
    df = _json(spark, path, "api_conversation_history.json", "role string, content string").withColumn("seq", F.col("_row"))
    b = blocks(F.col("content"))
    df = df.filter(~F.coalesce(F.exists(b, lambda x: x["type"] == "tool_result"), F.lit(False)))
    return _shape(df, "cline", role=F.col("role"), text=content_text(F.col("content")), session_id=parent(F.col("file")), tools=tool_names(F.col("content")))


_CHATGPT = "title string, create_time double, mapping map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>"


def chatgpt(spark: SparkSession, path: str) -> DataFrame:
    """Export array [{title, create_time, mapping}]: messages by time; the session is named by time and title."""
    df = _json(spark, path, "*.json", _CHATGPT).filter("mapping IS NOT NULL")
    made = F.date_format(F.timestamp_seconds(F.coalesce("create_time", F.lit(0.0))), "yyyyMMddHHmmss")
    df = df.select("file", "_row", F.concat_ws("-", F.lit("chatgpt"), made, F.substring(F.sha2(F.coalesce("title", F.lit("")), 256), 1, 8)).alias("sid"), F.explode(F.map_values("mapping")).alias("n"))
    m = F.col("n.message")
    df = df.filter("n.message IS NOT NULL").withColumn("seq", F.struct("_row", F.coalesce(m["create_time"], F.lit(0.0)).alias("t")))
    text = F.array_join(F.filter(m["content"]["parts"], lambda p: ~F.ltrim(p).startswith("{")), "")
    return _shape(df, "chatgpt-export", role=m["author"]["role"], text=text, session_id=F.col("sid"), timestamp=F.date_format(F.timestamp_seconds(m["create_time"]), "yyyy-MM-dd HH:mm:ss"), project=F.lit(None).cast("string"))


_CLAUDE = "uuid string, name string, chat_messages array<struct<sender:string,text:string,content:array<struct<type:string,text:string>>,created_at:string>>"


def _unzip(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): conversations of JSON files and of ZIP archives that hold one (conversations.json, else the first .json)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"(?i)\.(json|zip)$")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, files = [], []
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    if file.lower().endswith(".zip"):
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            names = [n for n in z.namelist() if n.endswith(".json")]
                            name = next((n for n in names if n.rsplit("/", 1)[-1] == "conversations.json"), names[0] if names else None)
                            data = z.read(name) if name else b"[]"
                    found = json.loads(data)
                except (ValueError, zipfile.BadZipFile):
                    continue
                for c in found if isinstance(found, list) else [found]:
                    values.append(json.dumps(c, ensure_ascii=False))
                    files.append(file)
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "file": pa.array(files, pa.string())})

    return df.mapInArrow(run, "value string, file string")


def claude_chat(spark: SparkSession, path: str) -> DataFrame:
    """Export of conversations with chat_messages, as JSON or ZIP."""
    df = _unzip(spark, path).withColumn("c", F.from_json("value", _CLAUDE)).select("file", "c", F.posexplode("c.chat_messages").alias("pos", "m")).withColumn("seq", F.col("pos"))
    said = F.array_join(F.transform(F.filter("m.content", lambda x: x["type"] == "text"), lambda x: x["text"]), " ")
    role = F.when(F.lower(F.trim("m.sender")) == "human", "user").otherwise(F.lower(F.trim("m.sender")))
    return _shape(df, "claude-chat-export", role=role, text=F.coalesce(F.nullif(F.trim(said), F.lit("")), F.col("m.text")), session_id=F.col("c.uuid"), project=F.nullif("c.name", F.lit("")), timestamp=F.col("m.created_at"))


READERS = {"claude-code": claude_code, "openclaw": openclaw, "codex": codex, "aider": aider, "gemini": gemini, "cline": cline, "chatgpt-export": chatgpt, "claude-chat-export": claude_chat}


def read_sessions(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Rows of one source by name; register further readers in READERS."""
    if source not in READERS:
        raise ValueError(f"no reader for {source!r}; there are {', '.join(sorted(READERS))}")
    return READERS[source](spark, path)


def detect_export(head: str) -> str | None:
    """The source of an export by its first characters."""
    return "chatgpt-export" if '"mapping"' in head else "claude-chat-export" if '"chat_messages"' in head else None


def session_meta(rows: DataFrame) -> DataFrame:
    """(source, session_id, n_prompts, n_turns, n_tools, n_failed, first_seen, last_seen, avg_chars) of the rows of any reader."""
    user = F.col("role") == "user"
    return rows.groupBy("source", "session_id").agg(
        F.count_if(user).alias("n_prompts"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.size("tools")).cast("bigint").alias("n_tools"),
        F.count_if(F.col("failed")).alias("n_failed"),
        F.min_by("timestamp", "seq").alias("first_seen"),
        F.max_by("timestamp", "seq").alias("last_seen"),
        F.avg(F.when(user, F.length("text"))).alias("avg_chars"),
    )
