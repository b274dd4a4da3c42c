"""Feed consistency and replay order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import DEFAULT_MAX_STALENESS_SECONDS
from paritymill.functions.columns import flags, micros_between
from paritymill.functions.ordered import scan, time_chunk

BOOK_KEYS = ("venue", "channel", "market_id")


def consistency_flags(max_staleness_seconds: int) -> Column:
    """Flags of a row that carries the previous row's ``_seq`` and ``_seen``."""
    late = micros_between(F.col("received_at"), F.col("observed_at")) > max_staleness_seconds * 1_000_000
    return flags(
        (F.col("_seq").isNotNull() & (F.col("sequence") != F.col("_seq") + 1), "sequence_gap"),
        (F.col("_seen").isNotNull() & (F.col("observed_at") < F.col("_seen")), "out_of_order"),
        (late, "stale_event"),
    )


def feed_consistency(
    df: DataFrame,
    order: str,
    chunk: Column,
    max_staleness_seconds: int = DEFAULT_MAX_STALENESS_SECONDS,
    keys: Sequence[str] = BOOK_KEYS,
) -> DataFrame:
    """Gap, order and staleness flags against the previous row in arrival order."""
    seen = scan(
        df, keys, [order], chunk, prior={"_seq": F.col("sequence"), "_seen": F.col("observed_at")}
    )
    return seen.withColumn("data_quality_flags", consistency_flags(max_staleness_seconds)).drop(
        "_seq", "_seen"
    )


def feed_consistency_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    f = F.col("data_quality_flags")
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events_read"),
        F.count_if(F.array_contains(f, "sequence_gap")).alias("sequence_gap_count"),
        F.count_if(F.array_contains(f, "stale_event")).alias("stale_count"),
        F.count_if(F.array_contains(f, "out_of_order")).alias("out_of_order_count"),
    )


def replay_frames(
    df: DataFrame, keys: Sequence[str], order: str, strict: bool, chunk: Column | None = None
) -> DataFrame:
    """Frames numbered from one inside each session.

    strict: keep the recorded order and mark every row whose observed_at went back.
    lenient: stable sort by observed_at.
    """
    one = ("sum", F.lit(1).cast("bigint"))
    if strict:
        out = scan(
            df, keys, [order], chunk,
            prior={"_seen": F.col("observed_at")}, running={"frame_sequence": one},
        )
        back = F.coalesce(F.col("observed_at") < F.col("_seen"), F.lit(False))
        return out.withColumn("order_violation", back).drop("_seen")
    return scan(
        df, keys, ["observed_at", order], chunk if chunk is not None else time_chunk(F.col("observed_at")),
        running={"frame_sequence": one},
    ).withColumn("order_violation", F.lit(False))
