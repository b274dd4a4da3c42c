"""Risk decisions, manual approval, order previews and limit screens."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, PROPOSAL_RECORD, RISK_RECORD, TOTAL
from paritymill.functions.columns import dec, flags, has, is_true


def risk_decisions(df: DataFrame) -> DataFrame:
    """Ordered blocker labels and a decision that always leaves approval to a person."""
    dq = F.col("data_quality_flags")
    reasons = flags(
        (F.lit(True), "manual_approval_required"),
        (has(dq, "stale_book", "stale_event"), "stale_data"),
        (has(dq, "sequence_gap", "data_gap"), "data_gap"),
        (F.col("fee_status") == "missing", "missing_fee_model"),
        (F.col("fee_status") == "unknown", "unknown_fee_model"),
        (F.col("net_edge_per_contract") < F.col("minimum_net_edge_per_contract"), "insufficient_net_edge"),
        (F.col("projected_exposure") > F.col("max_exposure"), "exposure_limit_breach"),
        (F.col("open_order_count") > F.col("max_open_orders"), "open_order_limit_breach"),
        (F.col("daily_loss") > F.col("max_daily_loss"), "daily_loss_limit_breach"),
        (F.col("reconciliation_mismatch_count") > 0, "reconciliation_mismatch"),
        (is_true(F.col("kill_switch_active")), "kill_switch_active"),
    )
    out = df.withColumn("reasons", reasons)
    return out.withColumns(
        {
            "decision": F.when(F.size("reasons") > 1, "reject").otherwise("manual_review_required"),
            "approved": F.lit(False),
            "manual_approval_required": F.lit(True),
            "record_type": F.lit(RISK_RECORD),
            "executable_order_intent": F.lit(False),
        }
    )


def risk_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("risk_decision_count"))


def pending_approvals(risk: DataFrame, requested_at: datetime, expires_at: datetime) -> DataFrame:
    """Pending approvals of the risk decisions without blockers."""
    if requested_at.tzinfo is None or expires_at.tzinfo is None:
        raise ValueError("approval times must be timezone-aware")
    if expires_at <= requested_at:
        raise ValueError("expires_at must be later than requested_at")
    clear = risk.where(
        (F.col("decision") == "manual_review_required")
        & (F.size("reasons") == 1)
        & has(F.col("reasons"), "manual_approval_required")
    )
    # fixed format: keys sorted, one space after every comma and colon
    ident = F.sha2(
        F.format_string(
            '{"candidate_hash": "%s", "expires_at": "%s", "proposal_id": "%s", "requested_at": "%s"}',
            F.col("candidate_hash"),
            F.lit(expires_at.isoformat()),
            F.col("proposal_id"),
            F.lit(requested_at.isoformat()),
        ),
        256,
    )
    return clear.select(
        ident.alias("approval_id"),
        "proposal_id",
        "candidate_hash",
        F.lit(requested_at.isoformat()).cast("timestamp").alias("requested_at"),
        F.lit(expires_at.isoformat()).cast("timestamp").alias("expires_at"),
        F.lit(False).alias("reusable"),
    )


def approval_reasons(now: Column) -> Column:
    """Every reason an approval record ``a_*`` does not satisfy the pending one."""
    return flags(
        (~F.col("a_approval_id").eqNullSafe(F.col("approval_id")), "approval_id_mismatch"),
        (~F.col("a_proposal_id").eqNullSafe(F.col("proposal_id")), "proposal_id_mismatch"),
        (~F.col("a_candidate_hash").eqNullSafe(F.col("candidate_hash")), "candidate_hash_mismatch"),
        (~is_true(F.col("a_approved")), "approval_not_granted"),
        (is_true(F.col("a_used")), "approval_already_used"),
        (now > F.col("expires_at"), "approval_expired"),
    )


def verify_approvals(
    pending: DataFrame, approvals: DataFrame, now: datetime | Column, on: str = "proposal_id"
) -> DataFrame:
    """Verify approval records against the pending approvals they are filed under."""
    at = now if isinstance(now, Column) else F.lit(now.isoformat()).cast("timestamp")
    fields = ("approval_id", "proposal_id", "candidate_hash", "approved", "used")
    a = approvals.select(F.col(on).alias("_on"), *[F.col(c).alias(f"a_{c}") for c in fields])
    joined = pending.join(a, F.col(on) == F.col("_on")).withColumn("_bad", approval_reasons(at))
    ok = F.size("_bad") == 0
    return joined.select(
        *pending.columns,
        F.when(ok, "approved_for_paper_once").otherwise("reject").alias("status"),
        ok.alias("approved"),
        F.when(ok, F.array(F.lit("manual_approval_verified"), F.lit("single_use_only")))
        .otherwise(F.col("_bad"))
        .alias("reasons"),
    )


def order_preview_screen(
    proposals: DataFrame,
    max_order_quantity: Decimal | str,
    max_total_notional: Decimal | str,
    time_in_force: str = "fok",
    order_prefix: str = "demo",
) -> DataFrame:
    """First failing guard per proposal, null when both legs may be previewed.

    Works on the nested legs, so a proposal is screened without a shuffle.
    """
    legs = F.col("legs")
    qty_cap = dec(str(max_order_quantity), "decimal(17,8)")
    notional = F.aggregate(
        legs,
        F.lit(0).cast(TOTAL),
        lambda acc, leg: (acc + leg["limit_price"] * leg["quantity"]).cast(TOTAL),
    )
    sides = F.array_sort(F.transform(legs, lambda leg: leg["side"]))
    bad_qty = F.exists(legs, lambda leg: (leg["quantity"] <= 0) | (leg["quantity"] > qty_cap))
    fraction = F.exists(legs, lambda leg: leg["quantity"] != F.floor(leg["quantity"]))
    price_range = F.exists(legs, lambda leg: ~leg["limit_price"].between(dec("0"), dec("1")))
    cents = F.exists(
        legs, lambda leg: leg["limit_price"] != leg["limit_price"].cast("decimal(4,2)").cast(PRICE)
    )
    reason = (
        F.when(F.col("record_type") != PROPOSAL_RECORD, "record_type")
        .when(F.size(legs) != 2, "leg_count")
        .when(~sides.eqNullSafe(F.array(F.lit("no"), F.lit("yes"))), "leg_sides")
        .when(price_range, "price_range")
        .when(bad_qty, "leg_quantity_limit")
        .when(fraction, "whole_contracts_required")
        .when(cents, "cent_precision_required")
        .when(notional > dec(str(max_total_notional), TOTAL), "total_notional_limit")
    )
    previews = F.transform(
        legs,
        lambda leg: F.struct(
            F.concat_ws(
                "-",
                F.lit(order_prefix),
                F.substring("proposal_id", 1, 16),
                leg["side"],
                F.lit(time_in_force),
            ).alias("client_order_id"),
            F.col("market_id").alias("ticker"),
            leg["side"].alias("side"),
            leg["quantity"].cast("bigint").alias("count"),
            (leg["limit_price"] * 100).cast("bigint").alias("price_cents"),
            F.lit(time_in_force).alias("time_in_force"),
        ),
    )
    out = proposals.withColumns({"blocked_by": reason, "total_notional": notional})
    return out.withColumn("request_previews", F.when(F.col("blocked_by").isNull(), previews))


def preview_chain(
    proposals: DataFrame,
    risk: DataFrame,
    approvals: DataFrame,
    ledger: DataFrame,
    reconciliation: DataFrame,
    now: datetime | Column,
) -> DataFrame:
    """Fail-closed gates of a proposal over its risk, approval, ledger and reconciliation rows.

    Every side holds one row per proposal_id.  The first failing gate is named.
    """
    at = now if isinstance(now, Column) else F.lit(now.isoformat()).cast("timestamp")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "proposal_id", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "proposal_id"]
        ).withColumn(f"{prefix}_present", F.lit(True))

    joined = proposals
    for df, prefix in ((risk, "risk"), (approvals, "appr"), (ledger, "ledg"), (reconciliation, "reco")):
        joined = joined.join(side(df, prefix), "proposal_id", "left")

    def off(prefix: str) -> Column:
        return F.col(f"{prefix}_present").isNull() | ~F.col(f"{prefix}_candidate_hash").eqNullSafe(
            F.col("candidate_hash")
        )

    only_manual = F.array(F.lit("manual_approval_required"))
    gate = (
        F.when(off("risk"), "risk_missing_or_mismatched")
        .when(~F.col("risk_decision").eqNullSafe("manual_review_required"), "risk_not_passing")
        .when(~F.col("risk_reasons").eqNullSafe(only_manual), "risk_blocked")
        .when(off("appr"), "approval_missing_or_mismatched")
        .when(at > F.col("appr_expires_at"), "approval_expired")
        .when(is_true(F.col("appr_used")), "approval_already_used")
        .when(
            ~is_true(F.col("appr_approved")) | ~F.col("appr_status").eqNullSafe("approved_for_paper_once"),
            "approval_not_granted",
        )
        .when(off("ledg"), "ledger_without_proposal")
        .when(~F.col("ledg_reconciliation_mismatch_count").eqNullSafe(0), "ledger_mismatch")
        .when(off("reco"), "reconciliation_missing_or_mismatched")
        .when(
            ~F.col("reco_approval_id").eqNullSafe(F.col("appr_approval_id")),
            "reconciliation_approval_mismatch",
        )
        .when(~F.col("reco_mismatch_count").eqNullSafe(0), "reconciliation_mismatch")
    )
    return joined.select(
        *proposals.columns, gate.alias("first_failing_gate"), gate.isNull().alias("preview_allowed")
    )


def limit_screen(df: DataFrame, limits: dict, required_base_url: str) -> DataFrame:
    """First failing pre-trade limit of a request, null when approved.

    Columns: execution_mode, base_url, demo_opt_in, side, price, quantity,
    current_position, current_inventory, current_daily_loss.
    """
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    cap = {k: dec(str(v), "decimal(28,8)") for k, v in limits.items()}
    name = (
        F.when(F.col("execution_mode") != "demo", "execution_mode")
        .when(F.col("base_url") != required_base_url, "base_url")
        .when(~is_true(F.col("demo_opt_in")), "demo_opt_in")
        .when(~F.col("price").between(dec("0"), dec("1")), "price_boundary")
        .when(F.col("quantity") > cap["max_order_quantity"], "max_order_quantity")
        .when(F.col("price") * F.col("quantity") > cap["max_notional"], "max_notional")
        .when(F.abs(F.col("current_position") + signed) > cap["max_position_abs"], "max_position_abs")
        .when(F.abs(F.col("current_inventory") + signed) > cap["max_position_abs"], "max_inventory_abs")
        .when(F.col("current_daily_loss") > cap["max_daily_loss"], "max_daily_loss")
    )
    return df.withColumns({"limit_name": name, "approved": name.isNull()})
