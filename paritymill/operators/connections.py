"""Connection windows, gaps, freshness, lifecycle and run-order checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.functions.columns import (
    age_seconds,
    is_true,
    market_identity,
    micros_between,
    normalized_status,
    seconds_decimal,
)
from paritymill.functions.ordered import scan, time_chunk

_OPEN = ("CONNECTION_OPEN", "RECONNECT")


def connection_windows(events: DataFrame, runs: DataFrame) -> DataFrame:
    """First open, last close (or run end), errors and segments of every connection.

    ``events``: run_id, connection_id, segment_id, event_type, observed_at, ord.
    ``runs``: run_id, started_at, ended_at.
    """
    kind = F.col("event_type")
    opened, closed = kind.isin(*_OPEN), kind == "CONNECTION_CLOSE"
    # segments are summed up before they are listed, so the list holds segments, not rows
    per_segment = events.groupBy("run_id", "connection_id", "segment_id").agg(
        F.min("ord").alias("_first"),
        F.min_by("observed_at", F.when(opened, F.col("ord"))).alias("_opened"),
        F.min(F.when(opened, F.col("ord"))).alias("_opened_ord"),
        F.max_by("observed_at", F.when(closed, F.col("ord"))).alias("_closed"),
        F.max(F.when(closed, F.col("ord"))).alias("_closed_ord"),
        F.count_if(kind == "CONNECTION_ERROR").alias("_errors"),
        F.count(F.lit(1)).alias("_events"),
    )
    per = per_segment.groupBy("run_id", "connection_id").agg(
        F.min_by("_opened", "_opened_ord").alias("opened_at"),
        F.max_by("_closed", "_closed_ord").alias("_last_close"),
        F.sum("_errors").alias("error_count"),
        F.sum("_events").alias("event_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_first", "segment_id"))), lambda x: x["segment_id"]
        ).alias("segment_ids"),
    )
    end = F.coalesce("_last_close", "ended_at")
    lasted = micros_between(end, F.col("opened_at"))
    return per.join(runs.select("run_id", "ended_at"), "run_id").select(
        "run_id", "connection_id", "segment_ids", "opened_at",
        F.when(F.col("opened_at").isNotNull(), end).alias("closed_at"),
        "error_count", "event_count",
        seconds_decimal(F.coalesce(F.when(lasted >= 0, lasted), F.lit(0))).alias("duration_seconds"),
    )


def disconnect_gaps(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Unconnected stretches of a run: lead-in, between windows, tail; all of it if none."""
    opened = windows.where(F.col("opened_at").isNotNull()).select(
        "run_id", "connection_id", "opened_at", "closed_at"
    )
    seen = scan(
        opened, ["run_id"], ["opened_at", "connection_id"], time_chunk(F.col("opened_at"), 86_400),
        prior={"_closed": F.col("closed_at")},
    )
    bounds = runs.select("run_id", "started_at", "ended_at")
    between = seen.where(F.col("_closed").isNotNull() & (F.col("opened_at") >= F.col("_closed"))).select(
        "run_id", F.lit("between").alias("gap_kind"), F.col("_closed").alias("gap_from"),
        F.col("opened_at").alias("gap_to"),
    )
    edges = bounds.join(
        opened.groupBy("run_id").agg(
            F.min("opened_at").alias("_first"),
            F.max_by("closed_at", F.struct("opened_at", "connection_id")).alias("_last"),
        ),
        "run_id",
        "left",
    )
    none = F.col("_first").isNull()
    edge = lambda kind, start, end: F.struct(
        F.lit(kind).alias("gap_kind"), start.alias("gap_from"), end.alias("gap_to")
    )
    listed = F.array_compact(
        F.array(
            F.when(none, edge("whole_run", F.col("started_at"), F.col("ended_at"))),
            F.when(
                F.col("_first") > F.col("started_at"), edge("lead_in", F.col("started_at"), F.col("_first"))
            ),
            F.when(F.col("ended_at") > F.col("_last"), edge("tail", F.col("_last"), F.col("ended_at"))),
        )
    )
    outer = edges.select("run_id", F.explode(listed).alias("_g")).select("run_id", "_g.*")
    return between.unionByName(outer).withColumn(
        "gap_seconds", seconds_decimal(micros_between(F.col("gap_to"), F.col("gap_from")))
    )


def window_overlaps(windows: DataFrame) -> DataFrame:
    """Windows that open before an earlier one of their run has closed."""
    opened = windows.where(F.col("opened_at").isNotNull())
    seen = scan(
        opened, ["run_id"], ["opened_at", "connection_id"], time_chunk(F.col("opened_at"), 86_400),
        prior={"_closed": F.col("closed_at")},
    )
    return seen.where(F.col("opened_at") < F.col("_closed")).drop("_closed")


def coverage(windows: DataFrame, gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """Connected and actual seconds, coverage and the longest gap of every run."""
    on = windows.groupBy("run_id").agg(F.sum("duration_seconds").alias("connected_seconds"))
    off = gaps.groupBy("run_id").agg(F.max("gap_seconds").alias("max_gap_seconds"))
    actual = seconds_decimal(micros_between(F.col("ended_at"), F.col("started_at")))
    out = runs.select("run_id", actual.alias("actual_seconds")).join(on, "run_id", "left").join(
        off, "run_id", "left"
    )
    zero = F.lit(0).cast("decimal(20,6)")
    connected = F.coalesce("connected_seconds", zero)
    return out.select(
        "run_id", "actual_seconds", connected.alias("connected_seconds"),
        F.when(F.col("actual_seconds") > 0, connected.cast("double") / F.col("actual_seconds").cast("double"))
        .otherwise(F.lit(0.0))
        .alias("coverage"),
        F.coalesce("max_gap_seconds", zero).alias("max_gap_seconds"),
    )


def max_quiet_gap(observations: DataFrame, runs: DataFrame, chunk_seconds: int = 3_600) -> DataFrame:
    """Longest wait in whole seconds, rounded up, per run and kind.

    ``observations``: run_id, kind, observed_at.  Counts from the run start to the first
    observation, between observations, and from the last one to the run end.
    """
    bounds = runs.select("run_id", "started_at", "ended_at")
    seen = scan(
        observations.select("run_id", "kind", "observed_at"), ["run_id", "kind"], ["observed_at"],
        time_chunk(F.col("observed_at"), chunk_seconds), prior={"_prev": F.col("observed_at")},
    )
    inner = seen.groupBy("run_id", "kind").agg(
        F.max(F.when(F.col("_prev").isNotNull(), age_seconds(F.col("observed_at"), F.col("_prev")))).alias("_inner"),
        F.min("observed_at").alias("_first"),
        F.max("observed_at").alias("_last"),
        F.count(F.lit(1)).alias("observation_count"),
    )
    zero = F.lit(0).cast("bigint")
    gap = F.greatest(
        zero,
        F.col("_inner"),
        age_seconds(F.col("_first"), F.col("started_at")),
        age_seconds(F.col("ended_at"), F.col("_last")),
    )
    return inner.join(bounds, "run_id").select(
        "run_id", "kind", "observation_count", gap.alias("max_gap_seconds"),
        F.greatest(zero, age_seconds(F.col("ended_at"), F.col("_last"))).alias("last_age_seconds"),
    )


def freshness(observations: DataFrame, at: Column | datetime, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Ages of the last keepalive, lifecycle and order-book observation.

    A keepalive counts as observed only with a source.
    """
    now = at if isinstance(at, Column) else F.lit(at.isoformat()).cast("timestamp")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("observed_at")))
    per = observations.groupBy(*keys).agg(
        last("keepalive").alias("_k"), last("lifecycle").alias("_l"), last("orderbook").alias("_o")
    )
    age = lambda c: F.when(F.col(c) <= now, age_seconds(now, F.col(c)))
    future = F.greatest("_k", "_l", "_o") > now
    return per.select(
        *keys,
        F.when(F.col("_k").isNotNull(), "OBSERVED").otherwise("UNKNOWN_NOT_OBSERVED").alias(
            "transport_keepalive_status"
        ),
        age("_k").alias("transport_keepalive_age_seconds"),
        age("_l").alias("lifecycle_observation_age_seconds"),
        age("_o").alias("orderbook_event_quiet_interval_seconds"),
        is_true(future).alias("observed_in_future"),
    )


_LIFECYCLE = ("open", "closed", "settled", "paused", "unopened")


def lifecycle_observations(df: DataFrame, max_age_seconds: int) -> DataFrame:
    """Normalized status, age and validity of each lifecycle observation.

    Columns: ticker, market_ticker, selected_ticker, status, raw_status, market_type,
    is_mve, mve_collection_ticker, observed_at, evaluated_at.
    """
    shown = F.coalesce("raw_status", "status")
    _, normal = normalized_status(shown)
    state = F.when(normal.isin(*_LIFECYCLE), F.upper(normal)).otherwise("UNKNOWN")
    mve = (
        is_true(F.col("is_mve"))
        | (F.lower(F.coalesce("market_type", F.lit(""))) == "mve")
        | (F.coalesce("mve_collection_ticker", F.lit("")) != "")
    )
    out = df.withColumns(
        {
            "normalized_status": normal,
            "lifecycle_status": state,
            "mve_unsupported": mve,
            "observation_age_seconds": age_seconds(F.col("evaluated_at"), F.col("observed_at")),
            "identity_ok": market_identity(F.col("ticker"), F.col("market_ticker")).eqNullSafe(
                F.col("selected_ticker")
            ),
        }
    )
    return out.withColumn(
        "validity",
        F.when(F.col("mve_unsupported"), "MVE_UNSUPPORTED")
        .when(F.col("observation_age_seconds") > max_age_seconds, "STALE")
        .when(F.col("lifecycle_status") == "UNKNOWN", "UNKNOWN_STATUS")
        .otherwise("VALID"),
    )


def run_order_violations(requests: DataFrame, chunk: Column) -> DataFrame:
    """Violations of subscription request order: index, generation, id reuse, chronology.

    ``requests``: run_id, run_request_index, native_command_id, channel,
    subscription_generation, created_at, ord.
    """
    seen = scan(
        requests, ["run_id"], ["ord"], chunk,
        prior={"_index": F.col("run_request_index"), "_created": F.col("created_at")},
    )
    seen = scan(
        seen, ["run_id", "channel"], ["ord"], chunk, prior={"_generation": F.col("subscription_generation")}
    )
    first_use = requests.groupBy("run_id", "native_command_id").agg(F.min("ord").alias("_first_use"))
    judged = seen.join(first_use, ["run_id", "native_command_id"])
    zero = F.lit(0)
    labels = F.array_compact(
        F.array(
            F.when(
                F.col("run_request_index") != F.coalesce("_index", zero) + 1, F.lit("request_index_not_contiguous")
            ),
            F.when(
                F.col("subscription_generation") != F.coalesce("_generation", zero) + 1,
                F.lit("generation_not_contiguous"),
            ),
            F.when(F.col("ord") != F.col("_first_use"), F.lit("command_id_reused")),
            F.when(F.col("created_at") < F.col("_created"), F.lit("chronology_backwards")),
        )
    )
    return judged.select("run_id", "ord", F.explode(labels).alias("violation"))


def run_record_counts(records: DataFrame) -> DataFrame:
    """Runs whose launch or terminal records are not exactly one."""
    kind = F.col("record_type")
    per = records.groupBy("run_id").agg(
        F.count_if(kind == "runtime_launch").alias("launch_count"),
        F.count_if(kind == "runtime_terminal").alias("terminal_count"),
    )
    return per.withColumn(
        "run_ok", (F.col("launch_count") == 1) & (F.col("terminal_count") == 1)
    )
