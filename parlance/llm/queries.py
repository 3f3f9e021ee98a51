"""The queries of problems 1, 3, 4, 5, 7, 8, 9 and 10 over whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import conversations, history, leaks, neardup, neighbours, packing, pii, spans
from parlance.session import new_folder, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "chatgpt_conversations": conversations.from_mappings,
        "claude_chat_export": conversations.from_message_arrays,
        "claude_session": conversations.from_lines,
    }
    found = [f(read_table(spark, sf_dir, t)).select(F.lit(t).alias("tbl"), "conv_key", "turn_no", "msg_key", "role") for t, f in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(read_table(spark, sf_dir, "prompts"), threshold=0.6, k=3)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prompt of 20 words or more: its class of equal five-word sets and the number of sets near it (0.8 or more)."""
    return neardup.near_classes(read_table(spark, sf_dir, "prompts"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, msg_no, text) of the prompts and the claude chat messages."""
    prompts = read_table(spark, sf_dir, "prompts").select(F.lit("prompts").alias("tbl"), F.col("id").alias("rec_id"), F.lit(0).cast("bigint").alias("msg_no"), "text")
    chats = read_table(spark, sf_dir, "claude_chat_export").select("rec_id", F.explode(F.transform("chat_messages", lambda m: F.struct(m["index"].alias("index"), m["text"].alias("text")))).alias("m"))
    return prompts.unionByName(chats.select(F.lit("claude_chat_export").alias("tbl"), "rec_id", F.col("m.index").cast("bigint").alias("msg_no"), F.col("m.text").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message that an export repeats counts once."""
    found = pii.items(_texts(spark, sf_dir), ["tbl", "rec_id", "msg_no"], lexicon=read_table(spark, sf_dir, "name_lexicon"))
    return found.distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.redact(_texts(spark, sf_dir), lexicon=read_table(spark, sf_dir, "name_lexicon"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = neighbours.similar_pairs(read_table(spark, sf_dir, "prompts"), "id", "embedding", 64, 5, 0.95)
    events = neighbours.similar_pairs(read_table(spark, sf_dir, "telemetry_event"), "queue_id", "dna_vector", 36, 5, 0.99)
    return prompts.select(F.lit("prompts").alias("tbl"), "id_a", "id_b").unionByName(events.select(F.lit("telemetry_event").alias("tbl"), "id_a", "id_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = history.History(spark, new_folder(spark, "history"), threshold=0.6, k=3)
    past.add_texts(read_table(spark, sf_dir, "prompts"), "id", "text")
    past.add_files(read_table(spark, sf_dir, "processed_sessions"), "file_path")
    verdicts = past.decide(read_table(spark, sf_dir, "prompt_batches"))
    return verdicts.filter("verdict <> 'accepted'")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of 2,048 tokens that hold the documents."""
    return packing.pack(packing.token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with a budget of one word edit: two pieces a passage."""
    return leaks.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), edits=1)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the leaks within the budget those without an edit, as the definition asks."""
    return _leaks(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks within the budget: one word of the passage may be changed, added or left out."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_words(read_table(spark, sf_dir, "documents"), "doc_id", "text")
