"""Streaming counters, sessions and splits, and runs of a stream over what there is.

Streams with keyed state of their own are in ``stateful``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritymill.fixed import DEFAULT_MAX_STALENESS_SECONDS, QUIET_WARNING_SECONDS
from paritymill.functions.columns import flags, micros_between
from paritymill.session import shared_folder
from paritymill.streaming.stateful import use_rocksdb


def distinct_events_stream(df: DataFrame, clock: str, delay: str, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """First arrival of every event id within the watermark."""
    return df.withWatermark(clock, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_counters_stream(df: DataFrame, clock: str, delay: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days with counts and quantity sums: closed ones in append mode, changed ones in update mode."""
    return (
        df.withWatermark(clock, delay)
        .groupBy(F.window(clock, "1 day").alias("day"), *keys)
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("quantity"))
        .select(F.col("day.start").alias("day"), *keys, "row_count", "quantity")
    )


def sliding_windows(daily: DataFrame, days: int) -> DataFrame:
    """Windows of ``days`` days that advance by one day, from daily counters: one copy of a day per window."""
    starts = F.sequence(F.lit(0), F.lit(days - 1))
    rows = daily.select("day", "row_count", "quantity", F.explode(starts).alias("_back"))
    start = F.col("day") - F.make_dt_interval(F.col("_back"))
    return (
        rows.groupBy(start.alias("start"))
        .agg(F.sum("row_count").alias("row_count"), F.sum("quantity").alias("quantity"))
        .select("start", (F.col("start") + F.make_dt_interval(F.lit(days))).alias("end"), "row_count", "quantity")
    )


def quiet_sessions_stream(
    df: DataFrame, clock: str, delay: str, keys: Sequence[str], gap_seconds: int = QUIET_WARNING_SECONDS
) -> DataFrame:
    """Activity sessions of each key, ended by a quiet stretch; open ones too in complete mode."""
    return (
        df.withWatermark(clock, delay)
        .groupBy(F.session_window(clock, f"{gap_seconds} seconds").alias("s"), *keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "row_count")
    )


def split_stale(df: DataFrame, max_staleness_seconds: int = DEFAULT_MAX_STALENESS_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale) rows, so late rows reach a side sink before a watermark drops them."""
    late = micros_between(F.col("received_at"), F.col("observed_at")) > max_staleness_seconds * 1_000_000
    marked = df.withColumn("data_quality_flags", flags((late, "stale_event")))
    return marked.where(~late), marked.where(late)


def run_late_split(stream: DataFrame, clock: str, delay_seconds: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(kept, late) rows of a stream: late ones lie behind the watermark their batch met.

    The watermark of a batch is the latest ``clock`` of all batches before it, less the delay.
    Each batch writes its rows and its latest clock under its number, so a batch that runs
    again after a failure replaces what it wrote.  Rows without a clock are kept.
    """
    spark: SparkSession = stream.sparkSession
    root = shared_folder(spark, label)
    clocks = f"{root}/clocks"
    latest = F.max(F.unix_micros(clock)).alias("latest")

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = None
        if number:
            seen = session.read.schema("batch bigint, latest bigint").parquet(clocks)
            before = seen.where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        late = F.lit(False)
        if before is not None:
            late = F.coalesce(F.unix_micros(clock) < before - delay_seconds * 1_000_000, F.lit(False))
        marked = batch.withColumn("_late", late)
        marked.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        written = session.read.schema(marked.schema).parquet(f"{root}/rows/batch={number}")
        written.agg(latest).write.mode("overwrite").parquet(f"{clocks}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, _late boolean, batch bigint").parquet(f"{root}/rows")
    return rows.where("NOT _late").select(*stream.columns), rows.where("_late").select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def run_available(
    stream: DataFrame, label: str, output_mode: str = "append", keys: Sequence[str] = (), closing_batch: bool = True
) -> DataFrame:
    """Run a stream over everything there is into Parquet, and read the result.

    Checkpoint and output live in the cluster's shared folder.  ``update`` writes the rows that
    each batch changed and reads the latest of every ``keys``, so windows that are still open
    are in it and no batch writes more than it changed.  ``complete`` writes the whole result
    of each batch over the last.  ``closing_batch`` lets a batch without rows close windows at
    the end; it must be off for streams with a time to live, which would ask for such batches
    for ever.
    """
    spark: SparkSession = stream.sparkSession
    use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(closing_batch).lower())
    root = shared_folder(spark, label)
    rows = f"{root}/rows"
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{root}/checkpoint")
    if output_mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    elif output_mode == "update":
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{rows}/batch={n}"))
    else:
        writer = writer.format("parquet").option("path", rows)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if output_mode != "update":
        return spark.read.schema(stream.schema).parquet(rows)
    changed = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(rows)
    rest = [c for c in stream.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)
