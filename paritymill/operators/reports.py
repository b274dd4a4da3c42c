"""Daily and rolling validation reports over mixed records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import CANDIDATE_RECORD, DATE_FIELDS, DEMO_PREVIEW_RECORD, DEMO_RECONCILIATION_RECORD
from paritymill.fixed import FILL_SIM_RECORD, LEDGER_RECORD, QTY, TOTAL, WINDOW_DAYS
from paritymill.functions.columns import date_label, flags, has
from paritymill.functions.ordered import CHUNK_ROWS, chunk_of, scan_net

_KINDS = {
    "flags": "array<string>",
    "data_quality_flags": "array<string>",
    "reasons": "array<string>",
    "rejection_reasons": "array<string>",
    "record_type": "string",
    "decision": "string",
    "up": "boolean",
    "dry_run": "boolean",
    "false_positive_style_rejection": "boolean",
    "rejection_outcome": "string",
    "data_lag_seconds": TOTAL,
    "gap_count": "bigint",
    "total_fees": TOTAL,
    "reconciliation_mismatch_count": "bigint",
    "mismatch_count": "bigint",
    "kill_switch_event_count": "bigint",
    "failed_leg_incident_count": "bigint",
    "failed_leg_quantity": QTY,
    "full_fill_count": "bigint",
    "partial_fill_count": "bigint",
    "request_preview_count": "bigint",
    "order_count": "bigint",
    "gross_edge": TOTAL,
    "total_estimated_gross_edge": TOTAL,
    "gross_edge_per_contract": "decimal(20,18)",
    "candidate_size": QTY,
    "net_edge_after_cost": TOTAL,
    "total_estimated_net_edge": TOTAL,
    "simulated_total_net_edge": TOTAL,
    "paper_pnl": TOTAL,
    "realized_net_pnl": TOTAL,
    "demo_pnl": TOTAL,
}


def with_report_columns(records: DataFrame) -> DataFrame:
    """Add the report columns a record set lacks as nulls, so mixed sources fit."""
    missing = {c: F.lit(None).cast(k) for c, k in _KINDS.items() if c not in records.columns}
    return records.withColumns(missing) if missing else records


def record_date(records: DataFrame) -> Column:
    """First present of the nine date fields, as a date."""
    return F.coalesce(*[date_label(F.col(c).cast("string")) for c in DATE_FIELDS if c in records.columns])


def _gap_flag() -> Column:
    gap = ("sequence_gap", "data_gap")
    return has(F.col("flags"), *gap) | has(F.col("data_quality_flags"), *gap)


def _kill_switch() -> Column:
    return has(F.col("reasons"), "kill_switch_active") | F.coalesce(
        F.col("record_type") == "kill_switch_event", F.lit(False)
    )


def daily_report(records: DataFrame, by: Sequence[str] = ("report_date",)) -> DataFrame:
    """One pass of conditional sums per day (or per ``by``)."""
    r = with_report_columns(records)
    kind = F.col("record_type")

    def of(name: str, condition: Column | None = None) -> Column:
        c = kind == name
        return c if condition is None else c & condition

    cand, status, sim = CANDIDATE_RECORD, "recorder_status", FILL_SIM_RECORD
    ledger = of(LEDGER_RECORD)
    zero = F.lit(0).cast(TOTAL)
    slipped = has(F.col("flags"), "slippage_applied") | has(F.col("data_quality_flags"), "slippage_applied")
    return r.groupBy(*by).agg(
        F.count_if(of(status, F.col("up"))).alias("recorder_uptime_count"),
        F.count_if(of(status, ~F.col("up"))).alias("recorder_downtime_count"),
        F.coalesce(F.max(F.when(of(status), F.greatest("data_lag_seconds", zero))), zero).alias(
            "max_data_lag_seconds"
        ),
        (F.count_if(_gap_flag()) + F.coalesce(F.sum("gap_count"), F.lit(0))).alias("gap_count"),
        F.count_if(of(cand)).alias("candidate_count"),
        F.count_if(of(cand, F.col("decision") == "paper_candidate")).alias("paper_candidate_count"),
        F.count_if(of(cand, F.col("decision") == "audit_only")).alias("audit_only_count"),
        F.count_if(of(cand, F.col("decision") == "reject")).alias("reject_count"),
        F.count_if(of("manual_approval_decision")).alias("paper_outcome_count"),
        F.count_if(of("demo_outcome")).alias("demo_outcome_count"),
        F.coalesce(F.sum(F.when(ledger, F.col("total_fees"))).cast(TOTAL), zero).alias("total_fees"),
        F.count_if(of(sim, slipped)).alias("slippage_incident_count"),
        F.count_if(of(sim, F.col("failed_leg_quantity") > 0)).alias("failed_leg_incident_count"),
        F.coalesce(F.sum(F.when(ledger, F.col("reconciliation_mismatch_count"))), F.lit(0)).alias(
            "reconciliation_mismatch_count"
        ),
        F.count_if(_kill_switch()).alias("kill_switch_event_count"),
    )


def daily_rejections(records: DataFrame, by: Sequence[str] = ("report_date",)) -> DataFrame:
    """Counts of every rejection reason of rejected candidates."""
    r = with_report_columns(records).where(
        (F.col("record_type") == CANDIDATE_RECORD) & (F.col("decision") == "reject")
    )
    return (
        r.select(*by, F.explode("rejection_reasons").alias("reason"))
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("reason_count"))
    )


def log_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per record type plus approvals, rejections and skipped actions."""
    kind = F.col("record_type")
    risk, life = kind == "risk_decision", kind == "lifecycle_intent"
    return records.groupBy(*by, "record_type").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(risk & F.coalesce("approved", F.lit(False))).alias("risk_approval_count"),
        F.count_if(risk & ~F.coalesce("approved", F.lit(False))).alias("risk_rejection_count"),
        F.count_if(life & (F.col("result_status") == "skipped")).alias("skipped_action_count"),
    )


def _pnl() -> tuple[Column, Column]:
    zero = F.lit(0).cast(TOTAL)
    return F.coalesce("paper_pnl", "realized_net_pnl", zero), F.coalesce("demo_pnl", zero)


def in_windows(records: DataFrame, as_of: date, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """One row per record and window that holds it; undated records are in every window."""
    r = with_report_columns(records).withColumn("_date", record_date(records))
    end = F.lit(as_of.isoformat()).cast("date")
    windows = F.array(*[F.lit(d) for d in sorted(days)])
    inside = F.filter(
        windows,
        lambda d: F.col("_date").isNull()
        | ((F.col("_date") <= end) & (F.datediff(end, F.col("_date")) < d)),
    )
    return r.withColumn("window_days", F.explode(inside)).withColumn(
        "_start", F.date_sub(end, F.col("window_days") - 1)
    )


def rolling_windows(records: DataFrame, as_of: date, days: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Validation sums of the windows that end on ``as_of``."""
    w = in_windows(records, as_of, days)
    kind, zero = F.col("record_type"), F.lit(0).cast(TOTAL)
    count0 = F.lit(0).cast("bigint")
    cand = kind == CANDIDATE_RECORD
    paper, demo = _pnl()
    gross = F.coalesce(
        "gross_edge",
        "total_estimated_gross_edge",
        F.when(cand, (F.col("gross_edge_per_contract") * F.col("candidate_size")).cast(TOTAL)),
        zero,
    )
    net = F.coalesce("net_edge_after_cost", "total_estimated_net_edge", "simulated_total_net_edge", zero)
    failed = F.coalesce(
        "failed_leg_incident_count",
        F.when(kind == FILL_SIM_RECORD, (F.col("failed_leg_quantity") > 0).cast("bigint")),
        count0,
    )
    demo_orders = F.when(
        (kind == DEMO_PREVIEW_RECORD) & (F.col("dry_run") == F.lit(False)), F.col("request_preview_count")
    )
    reconciled = F.when(kind == DEMO_RECONCILIATION_RECORD, F.col("order_count"))
    kill = F.coalesce("kill_switch_event_count", _kill_switch().cast("bigint"))
    false_positive = F.coalesce("false_positive_style_rejection", F.lit(False)) | F.coalesce(
        F.col("rejection_outcome") == "false_positive_style", F.lit(False)
    )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c).cast(TOTAL), zero)

    def number(c: Column | str) -> Column:
        return F.coalesce(F.sum(c), count0)

    sums = w.groupBy("window_days").agg(
        F.min("_start").alias("start_date"),
        F.count_if(cand).alias("candidate_count"),
        F.count_if(cand & (F.col("decision") == "paper_candidate")).alias("paper_candidate_count"),
        number(demo_orders).alias("demo_order_count"),
        number(reconciled).alias("_reconciled"),
        number("full_fill_count").alias("_full"),
        number("partial_fill_count").alias("_partial"),
        number(failed).alias("failed_leg_incident_count"),
        total(gross).alias("gross_edge"),
        total(net).alias("net_edge_after_cost"),
        total(paper).alias("paper_pnl"),
        total(demo).alias("demo_pnl"),
        number(F.coalesce("mismatch_count", "reconciliation_mismatch_count")).alias(
            "reconciliation_mismatch_count"
        ),
        number(F.coalesce("gap_count", count0) + _gap_flag().cast("bigint")).alias("data_gap_count"),
        number(kill).alias("kill_switch_event_count"),
        F.count_if(false_positive).alias("false_positive_style_rejection_count"),
        F.count_if(F.col("_date").isNull()).alias("undated_record_count"),
    )
    base = F.when(F.col("demo_order_count") != 0, F.col("demo_order_count")).otherwise(F.col("_reconciled"))

    def rate(c: str) -> Column:
        return F.when(base == 0, F.lit(0.0)).otherwise(F.col(c).cast("double") / base)

    return sums.withColumns(
        {
            "end_date": F.lit(as_of.isoformat()).cast("date"),
            "fill_success_rate": rate("_full"),
            "partial_fill_rate": rate("_partial"),
        }
    ).drop("_reconciled", "_full", "_partial")


def max_drawdown(
    records: DataFrame,
    as_of: date,
    order: str,
    days: Sequence[int] = WINDOW_DAYS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Largest fall of running PnL from its running peak (at least zero) per window.

    Undated points stand at the window start; points of one day keep their input order.
    Three windows are three keys for all rows, so the running totals are scanned in
    chunks of (day, rows) and only chunk summaries are ordered per window.
    """
    paper, demo = _pnl()
    points = (
        in_windows(records, as_of, days)
        .select(
            "window_days",
            F.coalesce("_date", "_start").alias("day"),
            F.col(order).alias("ord"),
            (paper + demo).cast(TOTAL).alias("pnl"),
        )
        .where(F.col("pnl") != 0)
    )
    chunk = F.struct(F.col("day").alias("day"), chunk_of(F.col("ord"), chunk_rows).alias("part"))
    walked = scan_net(points, ["window_days"], ["day", "ord"], chunk, F.col("pnl"), "max", "equity", "peak")
    fall = F.greatest(F.col("peak") - F.col("equity"), F.lit(0).cast(TOTAL))
    return walked.groupBy("window_days").agg(F.max(fall).cast(TOTAL).alias("max_drawdown"))


def artifact_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("record_type", F.lit("")).alias("record_type")).agg(
        F.count(F.lit(1)).alias("artifact_count")
    )


def unmet_prerequisites(
    windows: DataFrame,
    live_readonly_data_days: int = 0,
    paper_history_days: int = 0,
    fee_slippage_validated: bool = False,
    legal_review_complete: bool = False,
) -> DataFrame:
    """Ordered unmet prerequisites of a rolling report, one row."""
    bad = F.coalesce(F.max(F.col("reconciliation_mismatch_count") > 0), F.lit(False))
    return windows.agg(bad.alias("_bad")).select(
        flags(
            (F.lit(live_readonly_data_days < 90), "missing real 30-90 day live-readonly data"),
            (F.lit(paper_history_days < 30), "missing 30+ day paper trading history"),
            (F.col("_bad"), "unresolved reconciliation mismatch status"),
            (F.lit(not fee_slippage_validated), "unvalidated fee/slippage assumptions"),
            (F.lit(not legal_review_complete), "missing legal/platform review"),
        ).alias("prerequisites_unmet")
    )
