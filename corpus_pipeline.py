"""From raw documents to packed training windows, by five of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritymill.llm import decontam, linededup, neardup, packing, quality
from paritymill.llm.shared import parted, stage

END = 2


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality.judge(docs, docs.columns).where("kept").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat earlier ones; those left without a word go."""
    rest = linededup.dedup_lines(docs, drop_emptied=True)
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` is not in ``gone``; most of them do not travel."""
    gone = stage(gone.select("doc_id").distinct(), "pipeline-gone")
    maybe, rest = parted(docs, "doc_id", gone)
    return maybe.join(gone, "doc_id", "left_anti").select(*docs.columns).union(rest)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id."""
    return without(docs, neardup.near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without(docs, decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, sources in their proportions, ids as little-endian 32-bit."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end=END)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# tokenizing and approximate candidate search have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
