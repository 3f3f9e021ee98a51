"""Query p6_found: the content blocks of three nested tables, with their parents and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.shred import shred
from parlance.session import read_table


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def chatgpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the nodes of chatgpt mappings. A null part is of type text, as is JSON text without a content_type."""
    df = read_table(spark, sf_dir, "chatgpt_conversations").filter(F.col("mapping").isNotNull())
    # Only the fields that the rows need are written to JSON; null parts keep their position as ''.
    slim = F.transform_values(
        "mapping",
        lambda k, v: F.when(
            v.isNotNull(),
            F.struct(
                v["parent"].alias("parent"),
                F.when(v["message"].isNotNull(), F.transform(v["message"]["content"]["parts"], lambda p: F.coalesce(p, F.lit("")))).alias("parts"),
            ),
        ),
    )
    flat = shred(df, F.to_json(slim), ["rec_id"], maps=("",), leaves=("",), inherit={"{}": ("parent",)})
    parts = flat.filter(F.col("path") == "{}.parts[]").select(
        "rec_id",
        F.get("ordinals", F.lit(0)).alias("msg_key"),
        _text(F.col("leaves")["{}.parent"]).alias("parent_key"),
        F.get("ordinals", F.lit(1)).alias("block_path"),
        F.col("leaves")[""].alias("part"),
    )
    kind = F.when(F.ltrim("part").startswith("{"), F.try_parse_json("part"))
    kind = F.try_variant_get(kind, "$.content_type", "string")
    return parts.select(F.lit("chatgpt_conversations").alias("tbl"), "rec_id", "msg_key", "parent_key", "block_path", F.coalesce(kind, F.lit("text")).alias("block_type"))


def claude_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content blocks of claude chat messages and the blocks of their input."""
    df = read_table(spark, sf_dir, "claude_chat_export").filter(F.col("chat_messages").isNotNull())
    block = lambda c: F.struct(c["type"].alias("type"))
    slim = F.transform(
        "chat_messages",
        lambda m: F.struct(m["uuid"].alias("uuid"), F.transform(m["content"], lambda c: F.struct(c["type"].alias("type"), F.struct(F.transform(c["input"]["content"], block).alias("content")).alias("input"))).alias("content")),
    )
    flat = shred(df, F.to_json(slim), ["rec_id", "uuid"], leaves=("type",), inherit={"[]": ("uuid",)})
    rows = flat.filter(F.col("path").isin("[].content[]", "[].content[].input.content[]"))
    return rows.select(
        F.lit("claude_chat_export").alias("tbl"),
        "rec_id",
        _text(F.col("leaves")["[].uuid"]).alias("msg_key"),
        _text(F.col("uuid")).alias("parent_key"),
        F.array_join(F.slice("ordinals", 2, 9), ".").alias("block_path"),
        _text(F.col("leaves")["type"]).alias("block_type"),
    )


def api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of api contents at any depth. Plain text is one block."""
    df = read_table(spark, sf_dir, "api_conversation_history").filter(F.col("content").isNotNull())
    keys = ["rec_id", "msg_key", "parent_key"]
    df = df.select("rec_id", _text(F.col("msg_no").cast("string")).alias("msg_key"), _text(F.col("task_id")).alias("parent_key"), "content")
    nested = F.ltrim("content").startswith("[")
    flat = shred(df.filter(nested), F.col("content"), keys, leaves=("type",))
    blocks = flat.filter(F.col("path").rlike(r"^\[\](\.(input\.)?content\[\])*$"))
    blocks = blocks.select(*keys, F.array_join("ordinals", ".").alias("block_path"), _text(F.col("leaves")["type"]).alias("block_type"))
    plain = df.filter(~nested).select(*keys, F.lit("0").alias("block_path"), F.lit("text").alias("block_type"))
    return blocks.unionByName(plain).select(F.lit("api_conversation_history").alias("tbl"), *keys, "block_path", "block_type")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block once; the rows of one record are alike only if a message is repeated in it."""
    columns = ["tbl", "rec_id", "msg_key", "parent_key", "block_path", "block_type"]
    return chatgpt(spark, sf_dir).unionByName(claude_chat(spark, sf_dir)).unionByName(api(spark, sf_dir)).select(*columns).dropDuplicates()


SQL = r"""
WITH RECURSIVE cg AS (SELECT rec_id, unnest(map_entries(mapping)) AS e FROM chatgpt_conversations WHERE mapping IS NOT NULL),
cp AS (SELECT rec_id, e.key AS k, coalesce(e.value.parent, '') AS parent, unnest(e.value.message.content.parts) AS p, unnest(range(len(e.value.message.content.parts))) AS i FROM cg WHERE e.value.message IS NOT NULL),
cm AS (SELECT rec_id, uuid, unnest(chat_messages) AS m FROM claude_chat_export),
cc AS (SELECT rec_id, uuid, m.uuid AS k, unnest(m.content) AS c, unnest(range(len(m.content))) AS i FROM cm),
ce AS (SELECT rec_id, uuid, k, i, unnest(c.input.content) AS e, unnest(range(len(c.input.content))) AS j FROM cc),
ac AS (SELECT rec_id, msg_no, task_id, content, CASE WHEN ltrim(content) LIKE '[%' AND json_valid(content) THEN json_extract(content, '$[*]') ELSE [] END AS a FROM api_conversation_history WHERE content IS NOT NULL),
r AS (SELECT rec_id, msg_no, task_id, CAST(i AS VARCHAR) AS path, b FROM (SELECT rec_id, msg_no, task_id, unnest(a) AS b, unnest(range(len(a))) AS i FROM ac)
UNION ALL SELECT rec_id, msg_no, task_id, path || '.' || i, b FROM (SELECT rec_id, msg_no, task_id, path, unnest(a) AS b, unnest(n) AS i FROM (SELECT rec_id, msg_no, task_id, path, x || y AS a, range(len(x)) || range(len(y)) AS n FROM (
  SELECT rec_id, msg_no, task_id, path, CASE WHEN json_type(b, '$.content') = 'ARRAY' THEN json_extract(b, '$.content[*]') ELSE [] END AS x, CASE WHEN json_type(b, '$.input.content') = 'ARRAY' THEN json_extract(b, '$.input.content[*]') ELSE [] END AS y FROM r))))
SELECT 'chatgpt_conversations' AS tbl, rec_id, k AS msg_key, parent AS parent_key, CAST(i AS VARCHAR) AS block_path, coalesce(CASE WHEN ltrim(p) LIKE '{%' AND json_valid(p) THEN json_extract_string(p, '$.content_type') END, 'text') AS block_type FROM cp
UNION SELECT 'claude_chat_export', rec_id, k, uuid, CAST(i AS VARCHAR), coalesce(c.type, '') FROM cc UNION SELECT 'claude_chat_export', rec_id, k, uuid, i || '.' || j, coalesce(e.type, '') FROM ce
UNION SELECT 'api_conversation_history', rec_id, CAST(msg_no AS VARCHAR), task_id, path, coalesce(json_extract_string(b, '$.type'), '') FROM r
UNION SELECT 'api_conversation_history', rec_id, CAST(msg_no AS VARCHAR), task_id, '0', 'text' FROM ac WHERE NOT ltrim(content) LIKE '[%'"""
