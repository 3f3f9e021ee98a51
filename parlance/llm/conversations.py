"""Conversations from message rows: ordered user and assistant turns of undamaged, answered conversations (problem 1).

1. Rows that carry a conversation identifier keep it. Those without are identified as connected components over their reply and
   quote links (`components`); the key is the least message key of the component.
2. Messages are ordered: along the tree of a mapping, by index, or by instant.
3. Conversations that are damaged, empty, do not start with the user or lack a reply are left out.

Mappings and message arrays are checked within their record, without a shuffle. Message rows are numbered in pieces: rows are
range-partitioned by conversation and time, so that a conversation with a third of all rows is spread over many tasks; only one
summary row per conversation and piece meets at the end.

Defined results: null, empty or damaged conversations give no turns, nor do messages whose links lead to several conversations; repeated messages and repeated exports count once; ties of
instants are in order of arrival; empty tables give no turns; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.components import connected_components
from parlance.operators.timestamps import with_instant
from parlance.session import materialize

TURNS = "conv_key string, turn_no bigint, msg_key string, role string"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def role_of(c: Column) -> Column:
    """user, assistant or another role in lower case; human means user; blank is null."""
    r = F.nullif(F.lower(strip(c)), F.lit(""))
    return F.when(r == "human", "user").otherwise(r)


# Identification ------------------------------------------------------------------------------------------------------------
def quote_of(text: Column) -> Column:
    """The text a message quotes: its leading lines that start with >, without the marks; null if there are none."""
    q = F.regexp_extract(text, r"^((?:[ \t]*>[^\n]*(?:\n|$))+)", 1)
    return F.nullif(strip(F.regexp_replace(q, r"(?m)^[ \t]*>[ \t]?", "")), F.lit(""))


#: Characters from which a quoted text names its messages even if several have it.
QUOTE = 40


def identify(messages: DataFrame) -> DataFrame:
    """messages (conv_key, msg_key, reply_to, text and others) with every blank conv_key filled where reply or quote links reach.

    A message links to the message it replies to and to the messages whose whole text it quotes. reply_to may also name what
    messages have in common, such as their file. Of identified messages the links that can reach another one count. Where there
    is a column text_hash (xxhash64 of the stripped text) it stands for the text that is quoted, and identified messages need no text.
    Quoted texts of fewer than QUOTE characters count only where one message has that text. Components that hold messages of one
    conversation take its identifier, those that hold messages of several have none (null), others take their least message key.
    Messages with an identifier keep it.
    """
    open_ = messages.filter(blank(F.col("conv_key")))
    if open_.isEmpty():
        return messages
    replies = messages.select("msg_key", F.col("reply_to").alias("other"), blank(F.col("conv_key")).alias("open")).filter(F.col("other").isNotNull())
    met = open_.select(F.explode(F.array("reply_to", "msg_key")).alias("other")).filter(F.col("other").isNotNull()).distinct()
    reply = replies.filter("open").select("msg_key", "other").unionByName(replies.filter("NOT open").join(met, "other", "left_semi").select("msg_key", "other"))
    quoted = open_.select("msg_key", F.xxhash64(quote_of(F.col("text"))).alias("h"), F.length(quote_of(F.col("text"))).alias("n")).filter(F.col("n") > 0)
    texts = messages.select(F.col("msg_key").alias("m"), (F.col("text_hash") if "text_hash" in messages.columns else F.xxhash64(strip(F.col("text")))).alias("h")).join(quoted.select("h").distinct(), "h", "left_semi").distinct()
    # A quote tells whose it is only if one message has that text, or if the text is long; "ok" is nobody's.
    holders = texts.groupBy("h").agg(F.count(F.lit(1)).alias("holders"))
    quoted = quoted.join(holders, "h").filter((F.col("holders") == 1) | (F.col("n") >= QUOTE))
    # Many messages may have one text: they meet at a node for the text, so no pairs arise.
    texts = texts.join(quoted.select("h").distinct(), "h", "left_semi")
    node = lambda h: F.concat(F.lit("￿quote:"), h.cast("string"))
    links = reply.toDF("a", "b").unionByName(quoted.select(F.col("msg_key").alias("a"), node(F.col("h")).alias("b"))).unionByName(texts.select(F.col("m").alias("a"), node(F.col("h")).alias("b")))
    # Identified ends stand for their conversation: two messages of one are in one component.
    found = connected_components(links.unionByName(open_.select(F.col("msg_key").alias("a"), F.col("msg_key").alias("b"))))
    known = messages.filter(~blank(F.col("conv_key"))).select(F.col("msg_key").alias("node"), F.col("conv_key").alias("known")).join(found, "node").groupBy("component").agg(F.min("known").alias("known"), F.max("known").alias("other"))
    # A component that meets two conversations tells of neither.
    known = known.withColumn("several", F.col("known") != F.col("other")).drop("other")
    keys = materialize(found.join(known, "component", "left").select(F.col("node").alias("msg_key"), F.when(~F.coalesce("several", F.lit(False)), F.coalesce("known", "component")).alias("found_key")).dropDuplicates(["msg_key"]), "keys")
    filled = messages.join(keys, "msg_key", "left")
    return filled.withColumn("conv_key", F.when(blank(F.col("conv_key")), F.col("found_key")).otherwise(F.col("conv_key"))).drop("found_key").select(*messages.columns)


# Order and validation within a record ------------------------------------------------------------------------------------------
def valid(roles: list[str]) -> bool:
    """At least one turn, the first by the user, and every user turn directly followed by an assistant turn."""
    return bool(roles) and roles[0] == "user" and all(b == "assistant" for a, b in zip(roles, [*roles[1:], None], strict=True) if a == "user")


def tree_order(nodes: list[dict]) -> list[dict] | None:
    """The nodes (key, parent, children) from the one root, always on to the last child; null if the mapping is damaged."""
    by = {n["key"]: n for n in nodes}
    roots = [n for n in nodes if not n["parent"]]
    if len(roots) != 1 or len(by) != len(nodes):
        return None
    if any(n["parent"] and n["parent"] not in by for n in nodes) or any(c not in by for n in nodes for c in n["children"] or ()):
        return None
    out, seen, at = [], set(), roots[0]["key"]
    while at is not None:
        if at in seen:
            return None
        seen.add(at)
        out.append(by[at])
        at = by[at]["children"][-1] if by[at]["children"] else None
    return out


def index_order(messages: list[dict]) -> list[dict] | None:
    """The distinct messages (key, index, role) by index; null if the indexes are not 0..n-1 or a role is unknown."""
    by: dict = {}
    for m in messages:
        by.setdefault(m["key"], m)
    out = sorted(by.values(), key=lambda m: (m["index"] is None, m["index"] or 0))
    if [m["index"] for m in out] != list(range(len(out))) or any(m["role"] not in ("user", "assistant") for m in out):
        return None
    return out


def _turns(records: DataFrame, order) -> DataFrame:
    """Turns of records (conv_key, nodes) whose nodes (key, role, said and what order needs) are ordered by `order`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, no, key, role = [], [], [], []
            for c, nodes in zip(b.column("conv_key").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                turns = [n for n in order(nodes) or () if n["said"] and n["role"] in ("user", "assistant")]
                if valid([t["role"] for t in turns]):
                    conv += [c] * len(turns)
                    no += range(len(turns))
                    key += [t["key"] for t in turns]
                    role += [t["role"] for t in turns]
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(no, pa.int64()), pa.array(key, pa.string()), pa.array(role, pa.string())], names=["conv_key", "turn_no", "msg_key", "role"])

    return records.select("conv_key", "nodes").mapInArrow(run, TURNS)


def _one_export(records: DataFrame, size: Column) -> DataFrame:
    """Of several exports of a conversation the one with most messages, the first of equal ones."""
    sized = records.select("conv_key", "rec_id", size.alias("n"))
    best = sized.groupBy("conv_key").agg(F.max(F.struct("n", -F.col("rec_id"))).alias("best")).select((-F.col("best.col2")).alias("rec_id"))
    return records.join(best, "rec_id", "left_semi")


def _fill_record_keys(records: DataFrame, keys: Column) -> DataFrame:
    """Records (conv_key, rec_id, nodes) without identifier take the component of their message keys."""
    lost = records.filter(blank(F.col("conv_key")))
    if lost.isEmpty():
        return records
    node = F.concat(F.lit("￿record:"), F.col("rec_id").cast("string"))
    links = lost.select(node.alias("a"), F.explode(keys).alias("b"))
    found = connected_components(links)
    named = found.filter(F.col("node").startswith("￿record:")).select(F.substring("node", 9, 40).cast("bigint").alias("rec_id"), "component")
    out = records.join(named, "rec_id", "left")
    return out.withColumn("conv_key", F.when(blank(F.col("conv_key")), F.col("component")).otherwise(F.col("conv_key"))).drop("component")


def from_mappings(df: DataFrame) -> DataFrame:
    """Turns of (rec_id, conversation_id, mapping) rows."""
    # A part is plain text unless it is the JSON text of an object with a content_type.
    plain = lambda p: ~blank(p) & ~(F.ltrim(p).startswith("{") & F.try_variant_get(F.try_parse_json(p), "$.content_type", "string").isNotNull())
    nodes = F.transform(
        F.map_entries("mapping"),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"]["parent"].alias("parent"),
            e["value"]["children"].alias("children"),
            role_of(e["value"]["message"]["author"]["role"]).alias("role"),
            F.coalesce(F.exists(e["value"]["message"]["content"]["parts"], plain), F.lit(False)).alias("said"),
        ),
    )
    records = df.filter(F.col("mapping").isNotNull()).select("rec_id", F.col("conversation_id").alias("conv_key"), nodes.alias("nodes"))
    records = _fill_record_keys(records, F.col("nodes.key"))
    return _turns(_one_export(records, F.size("nodes")), tree_order)


def from_message_arrays(df: DataFrame) -> DataFrame:
    """Turns of (rec_id, uuid, chat_messages) rows."""
    said = lambda m: ~blank(m["text"]) | F.coalesce(F.exists(m["content"], lambda c: (c["type"] == "text") & ~blank(c["text"])), F.lit(False))
    nodes = F.transform("chat_messages", lambda m: F.struct(m["uuid"].alias("key"), m["index"].alias("index"), role_of(m["sender"]).alias("role"), said(m).alias("said")))
    records = df.filter(F.col("chat_messages").isNotNull()).select("rec_id", F.col("uuid").alias("conv_key"), nodes.alias("nodes"))
    records = _fill_record_keys(records, F.col("nodes.key"))
    return _turns(_one_export(records, F.size(F.array_distinct("nodes.key"))), index_order)


# Order and validation of message rows ----------------------------------------------------------------------------------------------
def text_of_content(content: Column) -> Column:
    """Plain content, or the text blocks of a JSON array of blocks, joined by line ends."""
    blocks = F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.when(blocks.isNull() | F.exists(blocks, lambda b: b.isNull()), content).otherwise(F.array_join(texts, "\n"))


def order_rows(rows: DataFrame) -> DataFrame:
    """Turns of message rows (conv_key, msg_key, role, at, seq): numbered by (at, seq), only of valid conversations."""
    pieces = rows.repartitionByRange("conv_key", "at", "seq").withColumn("piece", F.spark_partition_id())
    pieces = materialize(pieces, "pieces")
    w = Window.partitionBy("conv_key", "piece").orderBy("at", "seq")
    numbered = pieces.select("conv_key", "piece", "msg_key", "role", (F.row_number().over(w) - 1).alias("no"), F.lead("role").over(w).alias("next"))
    # Within a piece a user turn must be followed by an assistant turn; its last turn is judged with the next piece.
    unanswered = (F.col("role") == "user") & (F.col("next") == "user")
    ends = numbered.groupBy("conv_key", "piece").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(unanswered).alias("bad"),
        F.min(F.struct("no", "role"))["role"].alias("first"),
        F.max(F.struct("no", "role"))["role"].alias("last"),
    )
    # One row per conversation and piece: at most as many as there are partitions.
    v = Window.partitionBy("conv_key").orderBy("piece")
    ends = ends.select(
        "conv_key",
        "piece",
        (F.sum("n").over(v) - F.col("n")).alias("offset"),
        (F.coalesce("bad", F.lit(False)) | ((F.col("last") == "user") & (F.coalesce(F.lead("first").over(v), F.lit("none")) != "assistant"))).alias("broken"),
        F.first("first").over(v).alias("opens"),
    )
    good = ends.groupBy("conv_key").agg(F.max("broken").alias("broken"), F.min("opens").alias("opens")).filter(~F.col("broken") & (F.col("opens") == "user")).select("conv_key")
    offsets = ends.select("conv_key", "piece", "offset").join(good, "conv_key", "left_semi")
    return numbered.join(offsets, ["conv_key", "piece"]).select("conv_key", (F.col("no") + F.col("offset")).cast("bigint").alias("turn_no"), "msg_key", "role")


def from_lines(df: DataFrame) -> DataFrame:
    """Turns of logged lines (rec_id, session_id, uuid, file_path, type, timestamp, message)."""
    rows = df.select("rec_id", "session_id", "uuid", "file_path", "type", "timestamp", "message").filter(F.col("type").isin("user", "assistant"))
    rows = rows.withColumn("zone", F.lit(None).cast("string"))
    rows = with_instant(rows, "timestamp", "zone", "at")
    # Only where lines lack a session are texts compared: open lines keep theirs, of the others a digest goes on.
    lost = not df.filter(F.col("type").isin("user", "assistant") & blank(F.col("session_id"))).isEmpty()
    text_hash = F.xxhash64(strip(F.col("text"))) if lost else F.lit(None).cast("bigint")
    rows = materialize(
        rows.select(
            F.col("session_id").alias("conv_key"), F.col("uuid").alias("msg_key"), F.nullif("file_path", F.lit("")).alias("reply_to"), F.col("rec_id").alias("seq"), "at",
            role_of(F.col("message.role")).alias("role"), text_of_content(F.col("message.content")).alias("text"),
        ).withColumn("said", ~blank(F.col("text"))).withColumn("text_hash", text_hash).withColumn("text", F.when(blank(F.col("conv_key")), F.col("text"))),
        "lines",
    )
    # Lines without a session are joined to the other lines of their file, and to those they quote.
    rows = identify(rows).filter(F.col("conv_key").isNotNull())
    damaged = rows.filter(F.col("at").isNull() | F.col("role").isNull()).select("conv_key").distinct()
    turns = rows.filter(F.col("role").isin("user", "assistant") & F.col("said"))
    turns = turns.groupBy("conv_key", "msg_key").agg(F.min(F.struct("at", "seq", "role")).alias("m")).select("conv_key", "msg_key", "m.role", "m.at", "m.seq")
    return order_rows(turns.join(damaged, "conv_key", "left_anti"))

