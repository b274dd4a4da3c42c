"""Evidence summaries: sequence, bindings, rebuild, trades, dimensions, campaigns, phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import (
    ACK_TYPES,
    BAD_SEQUENCE_STATES,
    CAMPAIGN_SOURCE_TYPES,
    CLOSED_OR_FINAL_STATUSES,
    EVIDENCE_DIMENSIONS,
    EXTENDED_SMOKE_SECONDS,
    MAX_DISCONNECT_SECONDS,
    MAX_KEEPALIVE_AGE_SECONDS,
    MAX_LIFECYCLE_AGE_SECONDS,
    MAX_SMOKE_SECONDS,
    MIN_COVERAGE,
    ORDERBOOK_TYPES,
    QUIET_WARNING_SECONDS,
    REJECT_TYPES,
    SEVEN_DAY_SECONDS,
    WEBSOCKET_SOURCE_TYPES,
)
from paritymill.functions.columns import flags, has, is_true

SEQUENCE_STATES = (
    "RESYNCED_WITH_SNAPSHOT",
    "RESYNC_REQUIRED",
    "SEQUENCE_CONTIGUITY_VERIFIED",
    "SEQUENCE_DUPLICATE",
    "SEQUENCE_GAP_DETECTED",
    "SEQUENCE_NOT_OBSERVED",
    "SEQUENCE_OBSERVED_MONOTONIC",
    "SEQUENCE_OUT_OF_ORDER",
    "SEQUENCE_PRESENT_SEMANTICS_UNKNOWN",
    "UNRECOVERED_GAP",
)
_SEGMENT = ("connection_id", "segment_id")


def histogram(column: str, labels: Sequence[str]) -> Column:
    """Counts of known labels as a map in label order; one pass, no extra shuffle."""
    entries = F.array(
        *[F.struct(F.lit(x).alias("key"), F.count_if(F.col(column) == x).alias("value")) for x in labels]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def sequence_summary(rows: DataFrame, keys: Sequence[str] = _SEGMENT) -> DataFrame:
    """Reasons, sids, state histogram and result per connection segment.

    The sets hold segment reasons (six words) and subscription ids, not rows.
    """
    kind, status, state = F.col("native_type"), F.col("admission_status"), F.col("sequence_state")
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set("segment_boundary_reason")).alias("segment_boundary_reasons"),
        F.array_sort(F.collect_set("sid")).alias("native_sid_values"),
        F.count("seq").alias("native_seq_present_count"),
        histogram("sequence_state", SEQUENCE_STATES).alias("sequence_states"),
        F.count_if(status == "ADMITTED").alias("admitted_rows"),
        F.count_if(status == "EXCLUDED").alias("excluded_rows"),
        F.count_if(kind.isin(*ACK_TYPES)).alias("acknowledgement_count"),
        F.count_if(kind.isin(*REJECT_TYPES)).alias("rejection_count"),
        is_true(F.bool_or(state.isin(*BAD_SEQUENCE_STATES))).alias("_bad"),
        is_true(F.bool_or(state == "SEQUENCE_CONTIGUITY_VERIFIED")).alias("continuity_semantics_supported"),
    )
    return out.withColumn(
        "aggregate_result",
        F.when(F.col("_bad"), "SEQUENCE_INTEGRITY_FAIL")
        .when(F.col("continuity_semantics_supported"), "SEQUENCE_CONTIGUITY_VERIFIED")
        .otherwise("SEQUENCE_INTEGRITY_UNKNOWN"),
    ).drop("_bad")


def sequence_evidence(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """PASS only when every segment verified contiguity and none failed."""
    result = F.col("aggregate_result")
    return summary.groupBy(*by).agg(
        F.bool_or(result == "SEQUENCE_INTEGRITY_FAIL").alias("_fail"),
        F.bool_and(F.col("continuity_semantics_supported")).alias("_pass"),
    ).select(
        *by,
        F.when(F.col("_fail"), "FAIL").when(F.col("_pass"), "PASS").otherwise("UNKNOWN").alias(
            "sequence_integrity"
        ),
    )


def binding_summary(rows: DataFrame, keys: Sequence[str] = _SEGMENT) -> DataFrame:
    """Sets of command ids, generations, bindings, sids and states per channel."""
    bound = rows.where(
        F.col("binding_id").isNotNull() | F.col("generation").isNotNull() | F.col("command_id").isNotNull()
    )
    sets = {
        "command_ids": "command_id", "generations": "generation", "binding_ids": "binding_id",
        "native_sids": "sid", "states": "binding_state",
    }
    return bound.groupBy(*keys, "channel").agg(
        *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(n) for n, c in sets.items()]
    )


def rebuild_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames, rows, exclusions, reason histogram and last validity per book.

    ``rows``: keys, row_index, native_type, disposition, reason.  Reasons are counted
    first; only their counts are listed.
    """
    framed = F.col("disposition") == "FRAME_EMITTED"
    decides = framed | F.col("reason").isNotNull()
    snapshot = F.col("native_type") == "orderbook_snapshot"
    per_reason = rows.groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(framed).alias("_frames"),
        F.count_if(F.col("native_type").isin(*ORDERBOOK_TYPES)).alias("_book_rows"),
        F.count_if(F.col("native_type").isin(*ORDERBOOK_TYPES) & ~framed).alias("_excluded"),
        F.max(F.when(decides, F.col("row_index"))).alias("_last"),
        F.max_by(framed, F.when(decides, F.col("row_index"))).alias("_valid"),
        is_true(F.bool_or(framed & snapshot)).alias("_snap"),
    )
    entry = F.when(F.col("reason").isNotNull(), F.struct(F.col("reason"), F.col("_rows")))
    return per_reason.groupBy(*keys).agg(
        F.sum("_frames").alias("frame_count"),
        F.sum("_book_rows").alias("orderbook_row_count"),
        F.sum("_excluded").alias("excluded_row_count"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("invalidation_reasons"),
        F.max_by("_valid", "_last").alias("native_state_valid"),
        F.bool_or("_snap").alias("snapshot_first_admitted"),
    )


def rebuild_evidence(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """FAIL on any invalidation or unsound book, UNKNOWN without sound frames, else PASS."""
    reasons = F.map_keys("invalidation_reasons")
    real = F.exists(reasons, lambda r: r != "D2A_ROW_EXCLUDED")
    book = F.col("orderbook_row_count") > 0
    sound = F.col("snapshot_first_admitted") & is_true(F.col("native_state_valid"))
    framed = F.col("frame_count") > 0
    bad = real | (book & framed & (~sound | (F.size(reasons) > 0)))
    return summary.groupBy(*by).agg(
        F.bool_or(bad).alias("_bad"),
        F.bool_or(book).alias("_book"),
        is_true(F.bool_or(book & (~framed | ~sound))).alias("_open"),
    ).select(
        *by,
        F.when(F.col("_bad"), "FAIL")
        .when(~F.col("_book") | F.col("_open"), "UNKNOWN")
        .otherwise("PASS")
        .alias("rebuild_integrity"),
    )


def trade_class(selected: Column) -> Column:
    """Class of a native row for the public trade stream; first matching rule wins."""
    return (
        F.when(is_true(F.col("parse_failed")), "quarantined")
        .when(~F.col("native_type").eqNullSafe("trade"), "ignored")
        .when((F.col("admission_status") == "EXCLUDED") | F.col("exclusion_reason").isNotNull(), "quarantined")
        .when(F.coalesce("market_ticker", F.lit("")) == "", "quarantined")
        .when(F.col("channel") != "trade", "quarantined")
        .when(~is_true(selected), "filtered")
        .when(is_true(F.col("private_payload")), "quarantined")
        .when(~is_true(F.col("requested_market")) | F.col("trade_id").isNull(), "quarantined")
        .otherwise("trade")
    )


def classify_trades(rows: DataFrame, selected: Sequence[str] | DataFrame) -> DataFrame:
    """Rows with ``trade_class``; the selection is a list or a table of market_ticker."""
    if isinstance(selected, DataFrame):
        chosen = selected.select("market_ticker").distinct().withColumn("_selected", F.lit(True))
        joined = rows.join(chosen, "market_ticker", "left")
        return joined.withColumn("trade_class", trade_class(F.col("_selected"))).drop("_selected")
    return rows.withColumn("trade_class", trade_class(F.col("market_ticker").isin(*selected)))


def trade_stream_summary(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col("trade_class")
    out = classified.groupBy(*by).agg(
        F.count_if(c == "trade").alias("trade_count"),
        F.count_if(c == "filtered").alias("filtered_nonselected_count"),
        F.count_if(c == "ignored").alias("ignored_nontrade_count"),
        F.count_if(c == "quarantined").alias("quarantined_count"),
    )
    return out.withColumn(
        "status",
        F.when(F.col("quarantined_count") > 0, "QUARANTINED_INPUT")
        .when(F.col("trade_count") > 0, "OBSERVED")
        .otherwise("QUIET_NO_PUBLIC_TRADES"),
    )


def evidence_overall(df: DataFrame, dimensions: Sequence[str] = EVIDENCE_DIMENSIONS) -> DataFrame:
    """FAIL beats INCOMPLETE beats PASS over the evidence dimensions."""
    values = F.array(*[F.col(d) for d in dimensions])
    return df.withColumn(
        "overall_classification",
        F.when(has(values, "FAIL"), "FAIL").when(has(values, "UNKNOWN"), "INCOMPLETE").otherwise("PASS"),
    )


def _within(value: Column, limit: int) -> Column:
    return F.when(value.isNull(), "UNKNOWN").when(value <= limit, "PASS").otherwise("FAIL")


def evidence_dimensions(runs: DataFrame) -> DataFrame:
    """Dimensions of each run from its aggregates.

    Columns: opened_count, coverage, max_gap_seconds, max_keepalive_seconds,
    lifecycle_count, lifecycle_invalid, max_lifecycle_seconds, all_acknowledged,
    any_rejected, binding_failure_count, sequence_integrity, rebuild_integrity,
    actual_seconds, configured_seconds, ended, completed.  What a run cannot show about
    itself stays UNKNOWN.
    """
    opened = F.col("opened_count") > 0
    connected = (
        opened
        & (F.col("coverage") >= float(MIN_COVERAGE))
        & (F.col("max_gap_seconds") <= MAX_DISCONNECT_SECONDS)
    )
    subscribed = (
        opened
        & is_true(F.col("all_acknowledged"))
        & ~is_true(F.col("any_rejected"))
        & (F.col("binding_failure_count") == 0)
    )
    verdict = lambda ok: F.when(is_true(ok), "PASS").otherwise("FAIL")
    unknown = F.lit("UNKNOWN")
    return runs.withColumns(
        {
            "artifact_integrity": unknown,
            "transport_connectivity": verdict(connected),
            "transport_keepalive": _within(F.col("max_keepalive_seconds"), MAX_KEEPALIVE_AGE_SECONDS),
            "subscription_status": verdict(subscribed),
            "sequence_integrity": F.coalesce("sequence_integrity", unknown),
            "rebuild_integrity": F.coalesce("rebuild_integrity", unknown),
            "market_lifecycle_validity": F.when(F.coalesce("lifecycle_count", F.lit(0)) == 0, "UNKNOWN")
            .when(is_true(F.col("lifecycle_invalid")), "FAIL")
            .otherwise(
                _within(F.coalesce("max_lifecycle_seconds", F.lit(0)), MAX_LIFECYCLE_AGE_SECONDS)
            ),
            "duration_evidence": F.when(F.col("actual_seconds") >= F.col("configured_seconds"), "PASS")
            .when(is_true(F.col("ended")), "FAIL")
            .otherwise("UNKNOWN"),
            "process_liveness": verdict(F.col("completed")),
            "supervisor_liveness": unknown,
            "backup_integrity": unknown,
            "replay_qualification": unknown,
        }
    )


def source_type_class() -> Column:
    """Source class from native counts."""
    return (
        F.when(F.col("delta_count") > 0, "WEBSOCKET_DELTA")
        .when(F.col("snapshot_count") > 0, "WEBSOCKET_SNAPSHOT")
        .when(F.col("trade_count") > 0, "WEBSOCKET_PUBLIC_TRADE")
        .otherwise("WEBSOCKET_NO_ORDERBOOK")
    )


def orderbook_freshness(age: Column) -> Column:
    return (
        F.when(age.isNull(), "UNKNOWN_NOT_OBSERVED").when(age > QUIET_WARNING_SECONDS, "QUIET_WARNING").otherwise("FRESH")
    )


def classify_campaigns(df: DataFrame) -> DataFrame:
    """Validation failures and evidence class of each campaign, one row per campaign.

    Counts of heartbeat, recorder, rebuild and daily rows come in as columns.
    """
    recorder = F.col("status") == "recorder_smoke_complete"
    failures = flags(
        (F.col("live_gate_status").isNull() | (F.col("live_gate_status") != "disabled"), "live_gate_not_disabled"),
        (~F.col("production_endpoint_used").eqNullSafe(False), "production_endpoint_used"),
        (~F.col("submit_attempt_count").eqNullSafe(0), "submit_attempts"),
        (
            (F.coalesce("duration_seconds", F.lit(0)) > MAX_SMOKE_SECONDS)
            & ~F.col("mode").eqNullSafe("read_only_websocket_campaign"),
            "duration_exceeds_smoke_maximum",
        ),
        (~F.coalesce(F.col("source_type").isin(*CAMPAIGN_SOURCE_TYPES), F.lit(False)), "source_type_unsupported"),
        (F.coalesce("heartbeat_count", F.lit(0)) == 0, "no_heartbeat"),
        (F.coalesce("bad_heartbeat_count", F.lit(0)) > 0, "unsafe_heartbeat"),
        (recorder & (F.coalesce("recorder_event_count", F.lit(0)) == 0), "recorder_events_missing"),
        (recorder & (F.coalesce("rebuild_frame_count", F.lit(0)) == 0), "rebuild_frames_missing"),
        (recorder & (F.coalesce("daily_validation_count", F.lit(0)) == 0), "daily_validation_missing"),
        (is_true(F.col("secret_like")), "secret_like_field"),
    )
    d = df.withColumn("failures", failures)
    failed = F.size("failures") > 0
    closed = F.lower(F.coalesce("market_status", F.lit(""))).isin(*CLOSED_OR_FINAL_STATUSES)
    events = F.coalesce("event_count", "recorder_event_count", F.lit(0))
    deltas, snaps = F.coalesce("delta_count", F.lit(0)), F.coalesce("snapshot_count", F.lit(0))
    length = F.coalesce("duration_seconds", F.lit(0))
    incomplete = F.lit("LAYER1_WS_CAMPAIGN_INCOMPLETE")
    socket = (
        F.when(events <= 0, incomplete)
        .when(
            (length >= SEVEN_DAY_SECONDS) & (F.col("status") == "websocket_campaign_complete"),
            "LAYER1_WS_CAMPAIGN_PASS_7D",
        )
        .when(deltas > 0, "LAYER1_WS_DELTA_SMOKE_PASS")
        .when(length >= SEVEN_DAY_SECONDS, incomplete)
        .when(
            (snaps > 0) & is_true(F.col("subscription_acknowledged")),
            F.when(length >= EXTENDED_SMOKE_SECONDS, "LAYER1_WS_SNAPSHOT_ONLY_EXTENDED").otherwise(
                "LAYER1_WS_SNAPSHOT_SMOKE_PASS"
            ),
        )
        .otherwise(incomplete)
    )
    code = F.col("blocker_code")
    klass = (
        F.when(code.isin("NO_WS_CREDENTIALS", "WS_CREDENTIAL_STORAGE_UNSAFE"), code)
        .when(code.isin("WS_PRIVATE_KEY_LOAD_FAILED", "AUTH_SIGNATURE_FAILED"), "WS_AUTH_FAILED")
        .when(closed, "MARKET_CLOSED_OR_FINALIZED_ENDS_CAMPAIGN_EVIDENCE")
        .when(failed | is_true(F.col("status") == "websocket_blocked"), incomplete)
        .when(F.col("source_type") == "REST", "LAYER1_REST_SMOKE_PASS")
        .when(F.col("source_type").isin(*WEBSOCKET_SOURCE_TYPES), socket)
        .otherwise(incomplete)
    )
    valid = ~closed & ~(
        F.col("mode").eqNullSafe("read_only_websocket_campaign")
        & ~F.col("selection_gate_result").eqNullSafe("pass")
    )
    blocked = is_true(F.col("status").startswith("websocket_")) & (F.coalesce(code, F.lit("")) != "")
    return d.withColumns(
        {
            "evidence_classification": klass,
            "campaign_evidence_valid": valid,
            "validation_status": F.when(failed, "fail")
            .when(blocked | is_true(F.col("status") == "websocket_auth_blocked"), "blocked")
            .otherwise("pass"),
            "data_integrity_classification": F.when(failed, "DATA_INTEGRITY_FAIL").otherwise(
                "DATA_INTEGRITY_PASS"
            ),
        }
    )


PHASE_GATES = (
    "controlled_exit", "duration_gate", "transport_gate", "subscription_gate", "snapshot_admitted",
    "delta_admitted", "lifecycle_valid", "sequence_safe", "rebuild_noninvalid", "artifact_integrity_gate",
    "source_closed", "safety_gate",
)


def assess_phase(df: DataFrame, required_seconds: int) -> DataFrame:
    """Boolean gates of each closed run, their conjunction, and the fallback rule.

    Columns: terminal_reason, stop_requested, configured_seconds, actual_seconds,
    connection_established, subscription_acknowledged, admitted_snapshot_count,
    admitted_delta_count, segment_count, open_segment_count, sequence_segment_count,
    failed_sequence_count, framed_book_count, unsound_book_count, the evidence
    dimensions, validation_status, and the safety fields.
    """
    is_pass = lambda c: F.col(c).eqNullSafe("PASS")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gates = {
        "controlled_exit": F.col("terminal_reason").eqNullSafe("bounded_duration_complete")
        & F.col("stop_requested").eqNullSafe(False),
        "duration_gate": F.col("configured_seconds").eqNullSafe(required_seconds)
        & is_true(F.col("actual_seconds") >= required_seconds)
        & is_pass("duration_evidence"),
        "transport_gate": is_true(F.col("connection_established")) & is_pass("transport_connectivity"),
        "subscription_gate": is_true(F.col("subscription_acknowledged")) & is_pass("subscription_status"),
        "snapshot_admitted": n("admitted_snapshot_count") > 0,
        "delta_admitted": n("admitted_delta_count") > 0,
        "lifecycle_valid": is_pass("market_lifecycle_validity"),
        "sequence_safe": ~F.col("sequence_integrity").eqNullSafe("FAIL")
        & (n("sequence_segment_count") > 0)
        & (n("failed_sequence_count") == 0),
        "rebuild_noninvalid": ~F.col("rebuild_integrity").eqNullSafe("FAIL")
        & (n("framed_book_count") > 0)
        & (n("unsound_book_count") == 0),
        "artifact_integrity_gate": F.col("validation_status").eqNullSafe("pass") & is_pass("artifact_integrity"),
        "source_closed": (n("segment_count") > 0) & (n("open_segment_count") == 0),
        "safety_gate": F.col("live_gate_status").eqNullSafe("disabled")
        & F.col("production_trading_enabled").eqNullSafe(False)
        & F.col("executable_order_intent").eqNullSafe(False)
        & F.col("production_endpoint_used").eqNullSafe(False)
        & F.col("submit_attempts").eqNullSafe(0),
    }
    g = df.withColumns(gates)
    every = F.lit(True)
    for name in PHASE_GATES:
        every = every & F.col(name)
    operational = F.lit(True)
    for name in PHASE_GATES:
        if name not in ("snapshot_admitted", "delta_admitted", "sequence_safe", "rebuild_noninvalid"):
            operational = operational & F.col(name)
    fallback = (
        operational
        & ~F.col("delta_admitted")
        & ~F.col("sequence_integrity").eqNullSafe("FAIL")
        & ~F.col("rebuild_integrity").eqNullSafe("FAIL")
        & ~(F.col("snapshot_admitted") & ~is_pass("rebuild_integrity"))
    )
    return g.withColumns({"qualified": every, "fallback_allowed": fallback})
