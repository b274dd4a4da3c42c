"""Stage tables of the training-data operators.

A stage table cuts the lineage: it is written once below ``spark.checkpoint.dir``, which all
machines of the cluster see, and read back.  A lost executor costs a re-read.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _test_root() -> str:
    return tempfile.mkdtemp(prefix="llm-stage-")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may leave the setting out; it then gets a temporary
    folder.  A cluster without it raises: no other folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _test_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back with the same schema."""
    spark = df.sparkSession
    folder = scratch_folder(spark, label)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(folder)
    staged = spark.read.schema(df.schema).parquet(folder)
    staged._stage_folder = folder
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for table in tables:
        spark, folder = table.sparkSession, table._stage_folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BITMAP_BITS = 25


def _place(c: str) -> tuple[Column, Column]:
    """Word of the bitmap and bit in it of a BIGINT column."""
    at = F.pmod(F.col(c), F.lit(1 << _BITMAP_BITS))
    return F.shiftright(at, 6), F.expr(f"shiftleft(1L, CAST(pmod({c}, 64) AS INT))")


def _marked(df: DataFrame, key: str, wanted: DataFrame, how: str) -> DataFrame:
    """``df`` with its ``_bit`` and the ``_bits`` that ``wanted`` sets in its word.

    The bitmap has at most 2^19 rows of 64 bits (4 MB), whatever the size of ``wanted``, so it is
    broadcast.  A small ``wanted`` marks few rows; a huge one marks all.
    """
    word, bit = _place(key)
    table = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(table), "_word", how)


def found_in(df: DataFrame, key: str, wanted: DataFrame, exact: bool = True) -> DataFrame:
    """Rows of ``df`` whose BIGINT ``key`` is in ``wanted``; most others are left out by a bitmap before they travel.

    The join is an inner one: Spark would put a semi-join below the bitmap, where it shuffles every row.
    Without ``exact`` nothing travels, and a few other rows stay with those wanted.
    """
    held = _marked(df, key, wanted, "inner")
    maybe = held.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*df.columns)
    return maybe.join(wanted.select(key).distinct(), key).select(*df.columns) if exact else maybe


def parted(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose BIGINT ``key`` may be in ``wanted``, rows whose key is null or surely not); nothing travels.

    What is done for keys in ``wanted`` needs a join of the first only.  ``df`` is read for each.
    """
    held = _marked(df, key, wanted, "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return held.where(hit).select(*df.columns), held.where(~hit).select(*df.columns)


class Scratch:
    """Stage tables of one computation, deleted together once its result no longer reads them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stage(self, df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
        self.tables.append(stage(df, label, options))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()
