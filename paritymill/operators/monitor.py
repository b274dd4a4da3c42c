"""Operator tables over recorded runs: venues, data, candidates, orders, risk, health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import (
    CANDIDATE_RECORD,
    DEMO_RECONCILIATION_RECORD,
    FILL_SIM_RECORD,
    LEDGER_RECORD,
    MAX_KEEPALIVE_AGE_SECONDS,
    MAX_LIFECYCLE_AGE_SECONDS,
    ORDER_RECORDS,
    QUIET_WARNING_SECONDS,
    RISK_RECORD,
    STALE_VENUE_SECONDS,
    TOTAL,
)
from paritymill.functions.columns import age_seconds, first_filled, has, is_true

_KINDS = {
    "record_type": "string", "venue": "string", "market_id": "string", "market_ticker": "string",
    "strategy": "string", "decision": "string", "observed_at": "timestamp", "event_type": "string",
    "data_quality_flags": "array<string>", "flags": "array<string>", "reasons": "array<string>",
    "rejection_reasons": "array<string>", "gross_edge_per_contract": TOTAL, "gross_edge": TOTAL,
    "estimated_fee_per_contract": TOTAL, "fee_estimate": TOTAL, "net_edge_per_contract": TOTAL,
    "net_edge": TOTAL, "candidate_size": TOTAL, "order_id": "string", "proposal_id": "string",
    "proposal_hash": "string", "candidate_hash": "string", "side": "string", "action": "string",
    "price": TOTAL, "limit_price": TOTAL, "quantity": TOTAL, "size": TOTAL, "notional": TOTAL,
    "status": "string", "reconciliation_mismatch_count": "bigint", "mismatch_count": "bigint",
    "manual_approval_required": "boolean",
}


def with_monitor_columns(records: DataFrame) -> DataFrame:
    add = {c: F.lit(None).cast(k) for c, k in _KINDS.items() if c not in records.columns}
    return records.withColumns(add) if add else records


def _now(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now.isoformat()).cast("timestamp")


def _or(*names: str) -> Column:
    """First number that is neither null nor zero."""
    zero = F.lit(0).cast(TOTAL)
    return F.coalesce(*[F.nullif(F.col(n).cast(TOTAL), zero) for n in names])


def monitor_candidates(records: DataFrame) -> DataFrame:
    r = with_monitor_columns(records).where(F.col("record_type") == CANDIDATE_RECORD)
    return r.select(
        *[c for c in ("run_id", "ord") if c in r.columns],
        "venue",
        first_filled(F.col("market_ticker"), F.col("market_id")).alias("market_ticker"),
        F.coalesce(first_filled(F.col("strategy")), F.lit("same_market_complement")).alias("strategy"),
        _or("gross_edge_per_contract", "gross_edge").alias("edge_before_fees"),
        _or("estimated_fee_per_contract", "fee_estimate").alias("expected_fees"),
        _or("net_edge_per_contract", "net_edge").alias("edge_after_fees"),
        F.col("candidate_size").alias("liquidity"),
        has(F.col("data_quality_flags"), "stale_book").alias("stale"),
        "rejection_reasons",
        F.col("decision").alias("risk_decision"),
    )


def monitor_orders(records: DataFrame, order: str = "ord") -> DataFrame:
    """First row of every order id; rows without an id are told apart by their whole content.

    The first row is found by a combining aggregate per id.
    """
    r = with_monitor_columns(records).where(F.col("record_type").isin(*ORDER_RECORDS))
    ident = first_filled(F.col("order_id"), F.col("proposal_id"))
    content = F.sha2(F.to_json(F.struct(*[c for c in r.columns if c != order])), 256)
    price = _or("price", "limit_price")
    quantity = _or("quantity", "size")
    shown = r.select(
        *[c for c in ("run_id",) if c in r.columns],
        F.col(order).alias("ord"),
        F.coalesce(ident, F.concat(F.lit("#"), content)).alias("_key"),
        ident.alias("order_id"),
        first_filled(F.col("proposal_hash"), F.col("candidate_hash")).alias("proposal_hash"),
        F.coalesce(first_filled(F.col("venue")), F.lit("kalshi_demo")).alias("venue"),
        first_filled(F.col("market_ticker"), F.col("market_id")).alias("market_ticker"),
        "side",
        F.coalesce(first_filled(F.col("action")), F.lit("paper_propose")).alias("action"),
        price.alias("price"),
        quantity.alias("quantity"),
        F.coalesce(
            F.nullif("notional", F.lit(0).cast(TOTAL)),
            (price.cast("decimal(20,10)") * quantity.cast("decimal(17,8)")).cast(TOTAL),
        ).alias("notional"),
        F.coalesce(first_filled(F.col("status")), F.lit("paper")).alias("status"),
        F.col("record_type").alias("source"),
    )
    keys = [c for c in ("run_id",) if c in shown.columns]
    rest = [c for c in shown.columns if c not in (*keys, "_key")]
    return shown.groupBy(*keys, "_key").agg(F.min_by(F.struct(*rest), "ord").alias("_r")).select(*keys, "_r.*")


def venue_status(venues: DataFrame, now: datetime | Column) -> DataFrame:
    """Venue rows with defaults filled and staleness against ``now``."""
    age = F.greatest(F.lit(0).cast("bigint"), age_seconds(_now(now), F.col("last_event_ts")))
    stale = F.coalesce("data_staleness_seconds", age)
    return venues.select(
        "run_id", "venue",
        F.coalesce(first_filled(F.col("mode")), F.lit("read_only")).alias("mode"),
        F.coalesce(first_filled(F.col("connectivity")), F.lit("unknown")).alias("connectivity"),
        "last_event_ts",
        stale.alias("data_staleness_seconds"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        is_true(stale > STALE_VENUE_SECONDS).alias("is_stale"),
    )


def run_rollup(records: DataFrame, order: str = "ord") -> DataFrame:
    """Per run: data status, risk, reconciliation and evidence layers, in one aggregate."""
    r = with_monitor_columns(records)
    kind = F.col("record_type")

    def first_of(name: str, value: str) -> Column:
        return F.min_by(value, F.when(kind == name, F.col(order)))

    market_data = kind.isin("live_market_data_event", "market_data_snapshot") | (
        F.col("venue").isNotNull() & F.col("market_id").isNotNull() & F.col("observed_at").isNotNull()
        & F.col("event_type").isNotNull()
    )
    gap = has(F.col("data_quality_flags"), "sequence_gap") | has(F.col("flags"), "sequence_gap")
    stale = F.exists(
        F.coalesce("data_quality_flags", F.array().cast("array<string>")), lambda x: x.contains("stale")
    )
    layer = lambda c: F.when(is_true(F.bool_or(c)), "pass").otherwise("missing")
    out = r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(is_true(market_data)).alias("event_count"),
        F.count_distinct(F.when(is_true(market_data), F.col("market_id"))).alias("market_count"),
        F.max_by("observed_at", F.when(is_true(market_data) & F.col("observed_at").isNotNull(), F.col(order))).alias(
            "last_event_time"
        ),
        F.count_if(gap).alias("gap_count"),
        F.when(is_true(F.bool_or(stale)), "WARN").otherwise("OK").alias("stale_flag_status"),
        first_of(RISK_RECORD, "reasons").alias("risk_reasons"),
        first_of(RISK_RECORD, "decision").alias("risk_decision"),
        F.coalesce(
            F.nullif(first_of(LEDGER_RECORD, "reconciliation_mismatch_count"), F.lit(0).cast("bigint")),
            F.nullif(first_of(DEMO_RECONCILIATION_RECORD, "mismatch_count"), F.lit(0).cast("bigint")),
            F.lit(0),
        ).alias("mismatch_count"),
        F.lit("pass").alias("layer_0_schema"),
        layer(market_data).alias("layer_1_recorder"),
        layer(kind == FILL_SIM_RECORD).alias("layer_2_simulation"),
        layer(kind == LEDGER_RECORD).alias("layer_3_ledger"),
        layer(kind == RISK_RECORD).alias("layer_4_risk"),
    )
    on = lambda label: has(F.col("risk_reasons"), label)
    return out.withColumns(
        {
            "kill_switch": on("kill_switch_active"),
            "stale_data": on("stale_data"),
            "data_gap": on("data_gap"),
            "fee_missing": on("missing_fee_model"),
            "edge_insufficient": on("insufficient_net_edge"),
            "exposure_limit": on("exposure_limit_breach"),
            "daily_loss_limit": on("daily_loss_limit_breach"),
            "reconciliation_mismatch": on("reconciliation_mismatch"),
            "reconciliation_status": F.when(F.col("mismatch_count") > 0, "mismatch").otherwise("clean"),
        }
    )


def monitor_health(rollup: DataFrame, venues: DataFrame, campaigns: DataFrame | None = None) -> DataFrame:
    """Health of each run: NO_DATA, BLOCKED, WARNING or OK_PAPER, the first that applies.

    ``venues`` comes from ``venue_status``; ``campaigns`` (optional) carries run_id,
    validation_status, any_fail, any_unknown, running.
    """
    v = venues.groupBy("run_id").agg(F.bool_or("is_stale").alias("_stale"), F.count(F.lit(1)).alias("_venues"))
    runs = rollup.join(v, "run_id", "full_outer")
    if campaigns is not None:
        runs = runs.join(
            campaigns.select("run_id", "validation_status", "any_fail", "any_unknown", "running"), "run_id", "left"
        )
        blocked = F.col("validation_status").isin("fail", "blocked") | F.col("any_fail")
        warned = F.col("any_unknown") | F.col("running")
    else:
        blocked = warned = F.lit(False)
    unsafe = (
        F.col("kill_switch")
        | (F.col("risk_decision") == "reject")
        | F.col("reconciliation_mismatch")
        | (F.col("mismatch_count") > 0)
    )
    health = (
        F.when(F.coalesce("record_count", F.lit(0)) + F.coalesce("_venues", F.lit(0)) == 0, "NO_DATA")
        .when(is_true(blocked), "BLOCKED")
        .when(is_true(warned), "WARNING")
        .when(is_true(unsafe), "BLOCKED")
        .when(is_true(F.col("_stale")), "WARNING")
        .otherwise("OK_PAPER")
    )
    return runs.select(
        "run_id",
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        is_true(F.col("_stale")).alias("venue_stale"),
        health.alias("health"),
    )


def refresh_running(campaigns: DataFrame, now: datetime | Column) -> DataFrame:
    """Age the freshness of running campaigns by the time since it was evaluated.

    Columns: running, evaluated_at, keepalive_age, lifecycle_age, quiet_age,
    transport_keepalive, market_lifecycle_validity, message_freshness.
    """
    elapsed = F.greatest(F.lit(0).cast("bigint"), age_seconds(_now(now), F.col("evaluated_at")))
    running = is_true(F.col("running"))
    out = campaigns.withColumns(
        {
            c: F.when(running & F.col("evaluated_at").isNotNull(), F.col(c) + elapsed).otherwise(F.col(c))
            for c in ("keepalive_age", "lifecycle_age", "quiet_age")
        }
    )
    over = lambda c, limit: running & is_true(F.col(c) > limit)
    return out.withColumns(
        {
            "transport_keepalive": F.when(over("keepalive_age", MAX_KEEPALIVE_AGE_SECONDS), "FAIL").otherwise(
                F.col("transport_keepalive")
            ),
            "market_lifecycle_validity": F.when(
                over("lifecycle_age", MAX_LIFECYCLE_AGE_SECONDS), "FAIL"
            ).otherwise(F.col("market_lifecycle_validity")),
            "message_freshness": F.when(
                running & F.col("quiet_age").isNotNull(),
                F.when(F.col("quiet_age") > QUIET_WARNING_SECONDS, "QUIET_WARNING").otherwise("FRESH"),
            ).otherwise(F.col("message_freshness")),
        }
    )


def monitor_positions(positions: DataFrame) -> DataFrame:
    """Position rows with the monitor's defaults."""
    p = with_monitor_columns(positions)
    for c, k in (("currency", "string"), ("instrument_type", "string"), ("source", "string"), ("fees", TOTAL),
                 ("fees_paid", TOTAL), ("average_price", TOTAL), ("exposure", TOTAL), ("market", "string")):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(k))
    f = lambda *cs: first_filled(*[F.col(c) for c in cs])
    return p.select(
        F.coalesce(f("venue"), F.lit("paper")).alias("venue"),
        f("market_id", "market", "proposal_id").alias("market_id"),
        f("market_ticker", "market", "proposal_id").alias("market_ticker"),
        F.coalesce(f("currency"), F.lit("USD")).alias("currency"),
        F.coalesce(f("instrument_type"), F.lit("binary_prediction")).alias("instrument_type"),
        "side", "quantity", "average_price",
        _or("exposure", "notional").alias("exposure"),
        _or("fees", "fees_paid").alias("fees"),
        F.coalesce(f("source"), F.lit("paper_ledger")).alias("source"),
    )


def monitor_tables(
    records: DataFrame, venues: DataFrame, now: datetime | Column, positions: DataFrame
) -> dict[str, DataFrame]:
    """All monitor tables over one record set and its positions."""
    rollup, status = run_rollup(records), venue_status(venues, now)
    return {
        "venues": status,
        "runs": rollup,
        "candidates": monitor_candidates(records),
        "orders": monitor_orders(records),
        "positions": monitor_positions(positions),
        "health": monitor_health(rollup, status),
    }

