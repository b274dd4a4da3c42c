"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from paritymill.llm import (
    decontam, interactions, linededup, lm, neardup, packing, pieces, pii, quality, repair, sharding, tokenfile, toxicity
)
from paritymill.llm.shared import scratch_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40
END = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(text) -> F.Column:
    return F.crc32(text.cast("binary"))


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from those whose crc32(id) mod 10 is not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    scored = lm.score_documents(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base facts, base failures and host-level verdicts of all documents."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(
        "row.doc_id", *[f"facts.{f}" for f in quality.FACTS], "base_failed", "kept", "host_verdict"
    )


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold as copies, edited or paraphrased; all documents, all items."""
    leaks = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("score", F.round("score", 6))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents over all whole texts."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, sources in their corpus proportions."""
    pieces = packing.pack(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end=END
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents, law ``key``: document id and shard count decide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        _crc(text).alias("text_crc32"),
    )
    placed = stage(sharding.assign_shards(facts, "doc_id", SHARDS), "op6-placed")
    slotted = sharding.with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of documents with crc32(id) mod 5 = 0 are never read."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    labelled = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")
    scored = toxicity.score(docs, toxicity.fit(labelled))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back from them."""
    folder = scratch_folder(spark, "token-files")
    tokenfile.write_token_files(
        _table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), keep_space=True, end=END
    )
    return tokenfile.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every whole document text."""
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.span_text(pii.base_spans(F.col("pii"))), 256).alias("base_sha256"),
        pii.span_text(F.col("pii")).alias("spans"),
    )


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat, nearly or exactly, an earlier line of the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = linededup.dropped_by_document(docs).toDF("gone_id", "gone_version", "dropped")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
    sized = docs.select("doc_id", F.xxhash64("text").alias("version"), lines.alias("n_lines"))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version"))
    joined = sized.join(gone, same, "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "n_lines", F.size(dropped).cast("bigint").alias("n_dropped"), F.array_join(dropped, ",").alias("dropped")
    )


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 32k piece model, and the text that they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select(
        "row.doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in all 120 orders, per source, over all documents."""
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that crc32(conv_id:turn) mod 20 deals; nulls are one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    once, twice = F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))
    return conversations.where(dealt != 0).select(
        "conv_id",
        "turn",
        F.when(dealt == 4, "user").otherwise(role).alias("role"),
        F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(dealt == 3, twice).otherwise(once)).alias("copy"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after dealt damage."""
    original = _table(spark, sf_dir, "conversations")
    rows = damaged(original)
    found = repair.conversation_digests(repair.repaired_blocks(rows, repair.plan_repairs(rows)))
    every = original.select(F.struct(F.col("conv_id").alias("id")).alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        F.col("conv.id").alias("conv_id"),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_bloom_lm": op1_bloom_lm,
        "op2_host_quality": op2_host_quality,
        "op3_benchmark_leaks": op3_benchmark_leaks,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_mixture_packing": op5_mixture_packing,
        "op6_jump_sharding": op6_jump_sharding,
        "op7_toxic_spans": op7_toxic_spans,
        "op8_token_files": op8_token_files,
        "op9_personal_data": op9_personal_data,
        "op10_fuzzy_lines": op10_fuzzy_lines,
        "op11_piece_ids": op11_piece_ids,
        "op12_filter_interactions": op12_filter_interactions,
        "op13_conversation_repair": op13_conversation_repair,
    }
