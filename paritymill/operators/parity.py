"""Complement-parity candidates, scan reports and scenario stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import CANDIDATE_RECORD, FILL_SIM_RECORD, PRICE, QTY, TOTAL
from paritymill.functions.columns import dec, flags, has, is_true, sorted_labels

_DEFAULTS = {
    "estimated_slippage_per_contract": (PRICE, "0"),
    "failed_leg_reserve_per_contract": (PRICE, "0"),
    "minimum_net_edge_per_contract": (PRICE, "0"),
    "fee_status": ("string", "missing"),
    "fee_per_contract": (PRICE, None),
    "fee_source_note": ("string", "scanner fixture fee assumption"),
    "stale_book": ("boolean", "false"),
    "invalid_book_state": ("boolean", "false"),
    "data_quality_flags": ("array<string>", None),
}


def resolve_fees(df: DataFrame, fees: DataFrame) -> DataFrame:
    """Attach the fee row of each venue; a venue without one has a missing fee.

    ``fees``: venue, fee_status, fee_per_contract, fee_source_note, one row per venue.
    Spark broadcasts the fee side when its size is below the session's threshold.
    """
    kept = [c for c in df.columns if c not in ("fee_status", "fee_per_contract", "fee_source_note")]
    f = fees.select(
        F.col("venue").alias("_venue"), "fee_status", "fee_per_contract", "fee_source_note"
    )
    return df.select(*kept).join(f, F.col("venue") == F.col("_venue"), "left").select(
        *kept,
        F.coalesce("fee_status", F.lit("missing")).alias("fee_status"),
        F.when(F.col("fee_status") == "supplied", F.col("fee_per_contract")).alias("fee_per_contract"),
        F.coalesce("fee_source_note", F.lit("no fee row for venue")).alias("fee_source_note"),
    )


def _with_defaults(df: DataFrame) -> DataFrame:
    out = df
    for name, (kind, value) in _DEFAULTS.items():
        base = F.col(name) if name in df.columns else F.lit(None)
        default = F.lit(None).cast(kind) if value is None else F.lit(value).cast(kind)
        out = out.withColumn(name, F.coalesce(base.cast(kind), default))
    return out


def input_errors() -> Column:
    """Labels of everything that makes a top-of-book row unusable."""
    one, zero = dec("1"), dec("0")

    def outside(name: str) -> Column:
        c = F.col(name)
        return ~F.coalesce(c.between(zero, one), F.lit(False))

    def negative(name: str) -> Column:
        return ~F.coalesce(F.col(name) >= 0, F.lit(False))

    return flags(
        (F.coalesce(F.col("venue"), F.lit("")) == "", "venue_required"),
        (F.coalesce(F.col("market_id"), F.lit("")) == "", "market_id_required"),
        (outside("best_yes_bid"), "best_yes_bid_out_of_range"),
        (outside("best_no_bid"), "best_no_bid_out_of_range"),
        (negative("yes_bid_size"), "yes_bid_size_negative"),
        (negative("no_bid_size"), "no_bid_size_negative"),
        (negative("estimated_slippage_per_contract"), "slippage_negative"),
        (negative("failed_leg_reserve_per_contract"), "reserve_negative"),
        (negative("minimum_net_edge_per_contract"), "minimum_edge_negative"),
        (~F.col("fee_status").isin("supplied", "missing", "unknown"), "fee_status_unknown_word"),
        (
            (F.col("fee_status") == "supplied") & F.col("fee_per_contract").isNull(),
            "supplied_fee_without_value",
        ),
    )


def complement_candidates(df: DataFrame, fees: DataFrame | None = None) -> DataFrame:
    """Candidate per top-of-book row: edges, size, flags, decision and rejection reasons.

    Rows that fail validation keep their place with ``errors`` filled and no decision.
    Pure projection: no shuffle, one codegen stage.
    """
    src = _with_defaults(resolve_fees(df, fees) if fees is not None else df)
    one, zero = dec("1"), dec("0")
    yes, no = dec(F.col("best_yes_bid")), dec(F.col("best_no_bid"))
    src = src.withColumns(
        {
            "best_yes_bid": yes,
            "best_no_bid": no,
            "yes_bid_size": dec(F.col("yes_bid_size"), QTY),
            "no_bid_size": dec(F.col("no_bid_size"), QTY),
        }
    ).withColumn("errors", input_errors())
    fee = F.when(F.col("fee_status") == "supplied", F.col("fee_per_contract"))
    dq = sorted_labels(
        F.concat(
            F.coalesce("data_quality_flags", F.array().cast("array<string>")),
            flags(
                (is_true(F.col("stale_book")), "stale_book"),
                (is_true(F.col("invalid_book_state")), "invalid_book_state"),
            ),
        )
    )
    priced = src.withColumns(
        {
            "yes_ask": (one - no).cast(PRICE),
            "no_ask": (one - yes).cast(PRICE),
            "gross_edge_per_contract": (yes + no - one).cast(PRICE),
            "candidate_size": F.least("yes_bid_size", "no_bid_size"),
            "estimated_fee_per_contract": fee,
            "data_quality_flags": dq,
            "_stale": F.lit(False),
        }
    ).withColumn("_stale", has(F.col("data_quality_flags"), "stale_book", "invalid_book_state"))
    priced = priced.withColumn(
        "net_edge_per_contract",
        (
            F.col("gross_edge_per_contract")
            - F.coalesce("estimated_fee_per_contract", zero)
            - F.col("estimated_slippage_per_contract")
            - F.col("failed_leg_reserve_per_contract")
        ).cast(PRICE),
    )
    gross, net = F.col("gross_edge_per_contract"), F.col("net_edge_per_contract")
    thin = F.col("candidate_size") <= 0
    missing, unknown = F.col("fee_status") == "missing", F.col("fee_status") == "unknown"
    blocked = F.col("_stale") | thin | missing | unknown
    decided = priced.withColumns(
        {
            "total_estimated_net_edge": (net * F.col("candidate_size")).cast(TOTAL),
            "flags": flags(
                (F.lit(True), "manual_review_required"),
                (F.col("_stale"), "stale_book"),
                (thin, "insufficient_depth"),
                (missing, "missing_fee_model"),
                (unknown, "unknown_fee_model"),
                (gross > 0, "crossed_book"),
                (gross == 0, "locked_book"),
            ),
            "decision": F.when(F.size("errors") > 0, F.lit(None).cast("string"))
            .when(gross <= 0, "reject")
            .when(blocked, "audit_only")
            .when(net > F.col("minimum_net_edge_per_contract"), "paper_candidate")
            .otherwise("reject"),
        }
    )
    paper = F.col("decision") == "paper_candidate"
    eaten = (gross > 0) & (net <= gross)
    reasons = flags(
        (F.col("_stale"), "stale_book"),
        (thin, "insufficient_depth"),
        (missing, "missing_fee_model"),
        (unknown, "unknown_fee_model"),
        (gross <= 0, "no_complement_edge"),
        (eaten & F.col("estimated_fee_per_contract").isNotNull(), "fee_adjustment"),
        (eaten & (F.col("estimated_slippage_per_contract") > 0), "slippage_adjustment"),
        (eaten & (F.col("failed_leg_reserve_per_contract") > 0), "failed_leg_reserve"),
        (F.col("decision") == "reject", "not_paper_candidate"),
    )
    return decided.withColumns(
        {
            "rejection_reasons": F.when(paper, F.array().cast("array<string>")).otherwise(
                F.array_sort(reasons)
            ),
            "record_type": F.lit(CANDIDATE_RECORD),
            "research_use": F.lit("audit_or_paper_research_record_only"),
            "executable_order_intent": F.lit(False),
        }
    ).drop("_stale", "stale_book", "invalid_book_state", "fee_per_contract")


def complement_from_canonical(df: DataFrame, fees: DataFrame | None = None) -> DataFrame:
    """The same candidate from the canonical YES book: NO bid is one minus YES ask."""
    yes_side = df.withColumns(
        {
            "best_no_bid": (dec("1") - dec(F.col("best_yes_ask"))).cast(PRICE),
            "no_bid_size": F.col("yes_ask_size"),
        }
    ).drop("best_yes_ask", "yes_ask_size")
    return complement_candidates(yes_side, fees)


def scan_report(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by decision and fee status and the summed edge, per ``by`` columns (or overall)."""
    status, decision = F.col("fee_status"), F.col("decision")
    return candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(decision == "paper_candidate").alias("paper_candidate_count"),
        F.count_if(decision == "audit_only").alias("audit_only_count"),
        F.count_if(decision == "reject").alias("reject_count"),
        F.count_if(status == "missing").alias("missing_fee_count"),
        F.count_if(status == "unknown").alias("unknown_fee_count"),
        F.sum("total_estimated_net_edge").alias("total_estimated_net_edge"),
    )


def scan_rollup(candidates: DataFrame) -> DataFrame:
    """Scan counts rolled up over venue and decision (an extension of the report)."""
    return candidates.rollup("venue", "decision").agg(F.count(F.lit(1)).alias("candidate_count"))


def label_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every label of an array column."""
    return (
        df.select(*by, F.explode(column).alias("label"))
        .groupBy(*by, "label")
        .agg(F.count(F.lit(1)).alias("label_count"))
    )


def fill_stress(candidates: DataFrame, scenarios: Sequence[dict] | DataFrame) -> DataFrame:
    """Two-leg fill outcome of every candidate under every scenario.

    ``scenarios`` given as plain records become an array literal that is exploded in
    place, so the candidates are neither shuffled nor joined.  A DataFrame of scenarios
    must carry ``venue`` and ``market_id`` and is joined on them.
    Fields: policy (fok|ioc), target_size, yes_available_size, no_available_size,
    yes_slippage_per_contract, no_slippage_per_contract, latency_shock_per_contract,
    failed_leg_reserve_per_contract (null takes the candidate's).  Records may leave the
    sizes out; the candidate's own bid sizes then apply.
    """
    if isinstance(scenarios, DataFrame):
        s = scenarios.withColumnRenamed(
            "failed_leg_reserve_per_contract", "_reserve_override"
        )
        rows = candidates.join(s, ["venue", "market_id"])
    else:
        rows = candidates.withColumn("_s", F.explode(F.array(*[_scenario(x) for x in scenarios])))
        rows = rows.select(*candidates.columns, "_s.*")
    rows = rows.withColumns(
        {
            "target_size": F.coalesce("target_size", "candidate_size").cast(QTY),
            "yes_available_size": F.coalesce("yes_available_size", "yes_bid_size").cast(QTY),
            "no_available_size": F.coalesce("no_available_size", "no_bid_size").cast(QTY),
            "_reserve": F.coalesce("_reserve_override", "failed_leg_reserve_per_contract").cast(PRICE),
        }
    )
    short = (F.col("policy") == "fok") & (
        (F.col("yes_available_size") < F.col("target_size"))
        | (F.col("no_available_size") < F.col("target_size"))
    )
    none = F.lit(0).cast(QTY)
    rows = rows.withColumns(
        {
            "filled_yes_size": F.when(short, none).otherwise(F.least("target_size", "yes_available_size")),
            "filled_no_size": F.when(short, none).otherwise(F.least("target_size", "no_available_size")),
        }
    )
    y, n = F.col("filled_yes_size"), F.col("filled_no_size")
    net = (
        F.col("gross_edge_per_contract")
        - F.coalesce("estimated_fee_per_contract", dec("0"))
        - F.col("yes_slippage_per_contract")
        - F.col("no_slippage_per_contract")
        - F.col("latency_shock_per_contract")
        - F.col("_reserve")
    ).cast(PRICE)
    rows = rows.withColumns(
        {
            "completed_pair_size": F.least(y, n),
            "failed_leg_quantity": F.abs(y - n).cast(QTY),
            "yes_fill_price": (F.col("yes_ask") + F.col("yes_slippage_per_contract")).cast(PRICE),
            "no_fill_price": (F.col("no_ask") + F.col("no_slippage_per_contract")).cast(PRICE),
            "simulated_net_edge_per_pair": net,
        }
    )
    return rows.withColumns(
        {
            "simulated_total_net_edge": (
                F.col("simulated_net_edge_per_pair") * F.col("completed_pair_size")
            ).cast(TOTAL),
            "failed_leg_reserve_total": (F.col("_reserve") * F.col("failed_leg_quantity")).cast(TOTAL),
            "fill_flags": flags(
                (F.lit(True), "manual_review_required"),
                (F.lit(True), "not_trade_recommendation"),
                ((y == 0) & (n == 0) & (F.col("target_size") > 0), "blocked_by_fok_depth"),
                (F.col("failed_leg_quantity") > 0, "partial_fill"),
                (F.col("_reserve") > 0, "failed_leg_reserve_applied"),
                (
                    (F.col("yes_slippage_per_contract") > 0) | (F.col("no_slippage_per_contract") > 0),
                    "slippage_applied",
                ),
                (F.col("latency_shock_per_contract") > 0, "latency_shock_applied"),
            ),
            "fill_record_type": F.lit(FILL_SIM_RECORD),
        }
    ).drop("_reserve", "_reserve_override")


def _scenario(record: dict) -> Column:
    def amount(name: str, kind: str, default: str | None) -> Column:
        value = record.get(name, default)
        return F.lit(None if value is None else str(value)).cast(kind)

    return F.struct(
        F.lit(record.get("name", "scenario")).alias("scenario"),
        F.lit(record["policy"]).alias("policy"),
        amount("target_size", QTY, None).alias("target_size"),
        amount("yes_available_size", QTY, None).alias("yes_available_size"),
        amount("no_available_size", QTY, None).alias("no_available_size"),
        amount("yes_slippage_per_contract", PRICE, "0").alias("yes_slippage_per_contract"),
        amount("no_slippage_per_contract", PRICE, "0").alias("no_slippage_per_contract"),
        amount("latency_shock_per_contract", PRICE, "0").alias("latency_shock_per_contract"),
        amount("failed_leg_reserve_per_contract", PRICE, None).alias("_reserve_override"),
    )


def fill_summary(fills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Simulation, partial-fill and blocked counts."""
    f = F.col("fill_flags")
    return fills.groupBy(*by).agg(
        F.count(F.lit(1)).alias("simulations"),
        F.count_if(F.array_contains(f, "partial_fill")).alias("partial_fill_count"),
        F.count_if(F.array_contains(f, "blocked_by_fok_depth")).alias("blocked_by_fok_depth_count"),
    )
