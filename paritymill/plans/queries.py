"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritymill.fixed import TOTAL
from paritymill.functions.ordered import CHUNK_ROWS, chunk_of, spread
from paritymill.functions.columns import record_hash
from paritymill.functions.safety import payload_safety, redact_payload
from paritymill.operators import (
    books,
    connections,
    controls,
    evidence,
    feed,
    fifo,
    integrity,
    ledger,
    monitor,
    native,
    parity,
    proposals,
    quotes,
    rebuild,
    reconcile,
    reports,
    selection,
)
from paritymill.plans import views as V
from paritymill.session import shared_folder, stage
from paritymill.sources import jsonl, records
from paritymill.streaming import stateful, streams

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def joined(array: Column | str) -> Column:
    """Label array as text, for a type every engine hashes alike."""
    return F.array_join(array, "|")


def _tagged(kind: str, column: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))


@register("scan_report")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = parity.complement_candidates(V.v_top_of_book(spark, sf_dir))
    return parity.scan_report(cand, by=["venue"]).withColumn(
        "total_estimated_net_edge", V.d6(F.col("total_estimated_net_edge"))
    )


@register("complement_candidate")
def complement_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_candidates(spark, sf_dir).select(
        V.line_key().alias("line_key"),
        "venue",
        "market_id",
        V.d6(F.col("yes_ask")).alias("yes_ask"),
        V.d6(F.col("no_ask")).alias("no_ask"),
        V.d6(F.col("gross_edge_per_contract")).alias("gross_edge"),
        V.d6(F.col("net_edge_per_contract")).alias("net_edge"),
        V.d6(F.col("candidate_size")).alias("candidate_size"),
        V.d6(F.col("total_estimated_net_edge")).alias("total_edge"),
        "decision",
        joined("flags").alias("flags"),
        joined("rejection_reasons").alias("rejection_reasons"),
    )


@register("complement_from_canonical")
def complement_from_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.v_top_of_book(spark, sf_dir)
    yes_book = top.withColumns(
        {
            "best_yes_ask": (F.lit("1").cast(V.PRICE) - F.col("best_no_bid")).cast(V.PRICE),
            "yes_ask_size": F.col("no_bid_size"),
        }
    ).drop("best_no_bid", "no_bid_size")
    return parity.scan_report(
        parity.complement_from_canonical(yes_book), by=["venue", "fee_status"]
    ).withColumn("total_estimated_net_edge", V.d6(F.col("total_estimated_net_edge")))


@register("fee_resolution")
def fee_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees per supplier from a fee table; suppliers without a row have a missing fee."""
    top = V.v_top_of_book(spark, sf_dir).withColumn("venue", F.col("l_suppkey").cast("string"))
    key = F.col("s_suppkey").cast("string")
    # poor suppliers' rows carry a name that no venue has
    fees = V.table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") > 2000, key).otherwise(F.concat(F.lit("none-"), key)).alias("venue"),
        F.when(F.col("s_acctbal") > 6000, "unknown").otherwise("supplied").alias("fee_status"),
        F.lit("0.02").cast(V.PRICE).alias("fee_per_contract"),
        F.lit("supplier fee").alias("fee_source_note"),
    )
    cand = parity.complement_candidates(top, fees)
    return parity.scan_report(cand, by=["venue"]).withColumn(
        "total_estimated_net_edge", V.d6(F.col("total_estimated_net_edge"))
    )


@register("scan_label_counts")
def scan_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = V.v_candidates(spark, sf_dir)
    tagged = [
        _tagged("rejection_reason", "rejection_reasons"), _tagged("data_flag", "data_quality_flags")
    ]
    both = cand.select(F.explode(F.concat(*tagged)).alias("x"))
    return both.groupBy("x.kind", "x.label").agg(F.count(F.lit(1)).alias("label_count"))


@register("scan_rollup")
def scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.scan_rollup(V.v_candidates(spark, sf_dir))


@register("fill_stress")
def fill_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = V.v_candidates(spark, sf_dir).select(
        "market_id", "candidate_size", "yes_bid_size", "no_bid_size", "yes_ask", "no_ask",
        "gross_edge_per_contract", "estimated_fee_per_contract", "failed_leg_reserve_per_contract",
        "l_orderkey", "l_linenumber",
    )
    # candidates travel once and narrow; the scenarios multiply them where their market is
    near = spread(cand, ["market_id"], ["l_orderkey", "l_linenumber"]).drop("l_orderkey", "l_linenumber")
    fills = parity.fill_stress(near, V.SCENARIOS)
    sums = {
        "completed": "completed_pair_size", "failed_leg": "failed_leg_quantity",
        "net_edge": "simulated_total_net_edge", "reserve_total": "failed_leg_reserve_total",
        "yes_price_sum": "yes_fill_price", "no_price_sum": "no_fill_price",
    }
    marks = {
        "slippage_count": "slippage_applied", "latency_count": "latency_shock_applied",
        "reserve_count": "failed_leg_reserve_applied",
    }
    part = fills.groupBy("market_id", "_salt", "scenario").agg(
        F.count(F.lit(1)).alias("simulations"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.count_if(F.array_contains("fill_flags", c)).alias(n) for n, c in marks.items()],
    )
    return part.groupBy("market_id", "scenario").agg(
        F.sum("simulations").alias("simulations"),
        *[V.d6(F.sum(n)).alias(n) for n in sums],
        *[F.sum(n).alias(n) for n in marks],
    )


@register("fill_summary")
def fill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = parity.fill_stress(V.v_candidates(spark, sf_dir), V.SCENARIOS)
    return parity.fill_summary(fills, by=["venue", "scenario"])


@register("fair_value")
def fair_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.fair_value(V.v_two_sided(spark, sf_dir))
    return out.select("book_key", V.d6(F.col("fair_value")).alias("fair_value"), "fair_value_error")


@register("quote_bands")
def quote_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.quote_bands(V.v_two_sided(spark, sf_dir))
    cols = ("fair_value", "adjusted_fair_value", "inventory_skew", "bid_price", "ask_price", "target_spread")
    return out.select("book_key", *[V.d6(F.col(c)).alias(c) for c in cols])


@register("risk_decisions")
def risk_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controls.risk_decisions(V.v_risk_inputs(spark, sf_dir))
    return out.select("proposal_id", "decision", joined("reasons").alias("reasons"))


@register("risk_report")
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.risk_report(controls.risk_decisions(V.v_risk_inputs(spark, sf_dir)))


@register("proposal_join")
def proposal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, sims = V.v_proposal_sides(spark, sf_dir)
    made = proposals.propose_all(cand, sims, "sim_key")
    return made.select(
        "line_key",
        "proposal_id",
        F.size("legs").cast("bigint").alias("leg_count"),
        F.when(F.col("simulated"), joined("risk_reasons")).otherwise("missing_simulation").alias("risk_reasons"),
        V.d6(F.col("completed_pair_size")).alias("completed"),
    )


@register("order_preview_screen")
def order_preview_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand, sims = V.v_proposal_sides(spark, sf_dir)
    made, _ = proposals.propose(cand, sims, "sim_key")
    out = controls.order_preview_screen(made, "25", "20")
    return out.select(
        "proposal_id",
        "line_key",
        "blocked_by",
        V.d6(F.col("total_notional")).alias("total_notional"),
        F.try_element_at("request_previews", F.lit(1))["client_order_id"].alias("first_order_id"),
    )


@register("limit_screen")
def limit_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.table(spark, sf_dir, "lineitem")
    requests = li.select(
        V.line_key().alias("request_id"),
        F.when(F.col("l_linenumber") == 7, "paper").otherwise("demo").alias("execution_mode"),
        F.when(F.col("l_suppkey") % 13 == 0, "other").otherwise("demo-endpoint").alias("base_url"),
        (F.col("l_partkey") % 17 != 0).alias("demo_opt_in"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        (V.price4(F.col("l_discount")) * F.lit(10)).cast("decimal(20,18)").alias("price"),
        V.qty2(F.col("l_quantity")).alias("quantity"),
        V.qty2(F.col("l_linenumber") * 5).alias("current_position"),
        V.qty2(F.col("l_linenumber") * 7 - 20).alias("current_inventory"),
        V.qty2(F.col("l_tax") * 100).alias("current_daily_loss"),
    )
    limits = {"max_order_quantity": 45, "max_notional": 25, "max_position_abs": 40, "max_daily_loss": 7}
    return controls.limit_screen(requests, limits, "demo-endpoint").select(
        "request_id", "limit_name", "approved"
    )


# --- books -----------------------------------------------------------------
def _book_output(df: DataFrame) -> DataFrame:
    m = books.book_metrics(df)
    return m.select(
        "event_id",
        "instrument_id",
        joined("errors").alias("errors"),
        *[
            V.d6(F.col(c)).alias(c)
            for c in ("best_bid", "best_ask", "spread", "mid", "bid_depth", "ask_depth")
        ],
        "bid_level_count",
        "ask_level_count",
    )


@register("book_normalize_yes_no")
def book_normalize_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book_output(books.normalize_yes_no(V.v_yes_no_payloads(spark, sf_dir)))


@register("book_normalize_bid_offer")
def book_normalize_bid_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book_output(books.normalize_bid_offer(V.v_bid_offer_payloads(spark, sf_dir)))


@register("book_validity")
def book_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = books.mark_books(books.normalize_yes_no(V.v_yes_no_payloads(spark, sf_dir)))
    state = F.when(F.size("errors") == 0, "valid").otherwise(joined("errors"))
    return marked.groupBy("instrument_id", state.alias("state")).agg(F.count(F.lit(1)).alias("book_count"))


@register("book_metrics")
def book_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = books.book_metrics(books.normalize_yes_no(V.v_yes_no_payloads(spark, sf_dir)))
    return m.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        V.d6(F.max("best_bid")).alias("max_bid"),
        V.d6(F.min("best_ask")).alias("min_ask"),
        V.d6(F.sum("spread")).alias("spread_sum"),
        V.d6(F.sum("bid_depth")).alias("bid_depth_sum"),
        V.d6(F.sum("ask_depth")).alias("ask_depth_sum"),
    )


@register("book_quality_flags")
def book_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books.normalize_bid_offer(V.v_bid_offer_payloads(spark, sf_dir))
    labels = joined(books.quality_flags(F.col("state"))).alias("labels")
    return b.groupBy(labels).agg(F.count(F.lit(1)).alias("book_count"))


@register("book_hash")
def book_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books.normalize_yes_no(V.v_yes_no_payloads(spark, sf_dir))
    return b.select("event_id", books.book_hash().alias("book_hash"))


# --- feed ------------------------------------------------------------------
def _flagged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.feed_consistency(
        V.v_feed(spark, sf_dir), "event_id", chunk_of(F.col("event_id"), CHUNK_ROWS), 30 * 60
    )


@register("feed_consistency")
def feed_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged_feed(spark, sf_dir).select(
        "event_id", "venue", "market_id", "sequence", joined("data_quality_flags").alias("flags")
    )


@register("feed_consistency_summary")
def feed_consistency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.feed_consistency_summary(_flagged_feed(spark, sf_dir), by=["market_id"])


@register("replay_frames")
def replay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.v_feed(spark, sf_dir)
    strict = feed.replay_frames(f, ["market_id"], "event_id", True, chunk_of(F.col("event_id"), CHUNK_ROWS))
    lenient = feed.replay_frames(f, ["market_id"], "event_id", False)
    cols = ("event_id", "frame_sequence", "order_violation")
    return strict.select(F.lit("strict").alias("mode"), *cols).unionByName(
        lenient.select(F.lit("lenient").alias("mode"), *cols)
    )


# --- rebuild ---------------------------------------------------------------
@register("book_rebuild")
def book_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_rebuilt(spark, sf_dir).select(
        "row_index", "market_ticker", "connection_id", "epoch", "disposition", "reason",
        "reset_reason", "frame_count",
    )


@register("book_frames")
def book_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rebuild.top_of_book(V.v_rebuilt(spark, sf_dir))
    return top.select(
        "row_index", "market_ticker",
        *[V.d6(F.col(c)).alias(c) for c in ("best_bid", "best_bid_size", "best_ask", "best_ask_size")],
        "bid_level_count", "ask_level_count", "book_state",
    )


@register("book_ladder_hash")
def book_ladder_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rebuild.with_frame_hash(rebuild.book_frames(V.v_rebuilt(spark, sf_dir)))
    return frames.select("row_index", "market_ticker", "frame_hash")


# --- ledger, fifo, reconciliation -------------------------------------------
@register("fifo_attribution")
def fifo_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fifo.fifo_attribution(
        V.v_fills(spark, sf_dir), chunk_of(F.col("ord"), CHUNK_ROWS), quantity_chunk=100_000
    )
    return out.select(
        "instrument_id", "supplied_fills",
        *[
            V.d6(F.col(c)).alias(c)
            for c in ("total_fees", "realized_gross_pnl", "realized_net_pnl", "ending_inventory")
        ],
    )


def _ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # chunks of a year of days: a proposal has few rows, a hot one is still cut
    return ledger.replay_ledger(V.v_ledger(spark, sf_dir), ["day", "event_key"], chunk_of(F.col("day"), 365))


@register("paper_ledger")
def paper_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = _ledger(spark, sf_dir)["positions"]
    return positions.select(
        "proposal_id", "side",
        V.d6(F.col("quantity")).alias("quantity"),
        F.round(F.col("average_price").cast("double"), 10).alias("average_price"),
        V.d6(F.col("fees_paid")).alias("fees_paid"),
    )


@register("paper_ledger_state")
def paper_ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _ledger(spark, sf_dir)["state"]
    money = ("total_fees", "realized_gross_pnl", "realized_net_pnl")
    return state.select(
        "paper_order_count", "paper_fill_count", "settlement_count", "reconciliation_mismatch_count",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in money],
    )


@register("paper_ledger_mismatches")
def paper_ledger_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)["mismatches"].select("event_key", "proposal_id", "reason")


def _reconciled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    audits, events = V.v_demo_orders(spark, sf_dir)
    return reconcile.reconcile(audits, events, chunk_of(F.col("ord"), CHUNK_ROWS))


@register("reconcile_orders")
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _reconciled(spark, sf_dir)["orders"]
    return o.select(
        "audit_id", "client_order_id", "accepted", "rejected", "canceled", "errored", "timed_out",
        V.d6(F.col("filled_quantity")).alias("filled_quantity"),
        F.round(F.col("average_fill_price").cast("double"), 10).alias("average_fill_price"),
        "fully_filled",
    )


@register("reconcile_mismatches")
def reconcile_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)["mismatches"].select(
        "audit_id", "client_order_id", "event_id", "ord", "reason"
    )


@register("reconcile_state")
def reconcile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconciliation_state(_reconciled(spark, sf_dir))


# --- reports ---------------------------------------------------------------
AS_OF = date(2001, 8, 1)


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, the forms every engine hashes alike."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind.startswith("decimal"):
            c = V.d6(c)
        elif kind == "date":
            c = c.cast("string")
        elif kind == "timestamp":
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


@register("daily_report")
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(reports.daily_report(V.v_records(spark, sf_dir)))


@register("daily_rejections")
def daily_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_rejections(V.v_records(spark, sf_dir))


@register("rolling_windows")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plain(reports.rolling_windows(V.v_records(spark, sf_dir), AS_OF))
    return out.withColumns(
        {c: F.round(c, 10) for c in ("fill_success_rate", "partial_fill_rate")}
    )


@register("max_drawdown")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (7, 30, 90, 2500)
    return _plain(reports.max_drawdown(V.v_records(spark, sf_dir), AS_OF, "ord", days))


@register("artifact_counts")
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.artifact_counts(V.v_records(spark, sf_dir))


@register("unmet_prerequisites")
def unmet_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = reports.rolling_windows(V.v_records(spark, sf_dir), AS_OF)
    return reports.unmet_prerequisites(windows, paper_history_days=45).select(
        joined("prerequisites_unmet").alias("prerequisites_unmet")
    )


@register("log_counts")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.v_events(spark, sf_dir)
    kinds = {
        "signup": "frame", "click": "quote_candidate", "view": "risk_decision",
        "error": "lifecycle_intent", "purchase": "adapter_submission",
    }
    pairs = [F.lit(x) for item in kinds.items() for x in item]
    logs = ev.select(
        F.create_map(*pairs)[F.col("event_type")].alias("record_type"),
        (F.col("event_id") % 3 == 0).alias("approved"),
        F.when(F.col("event_id") % 4 == 0, "skipped").otherwise("accepted").alias("result_status"),
    )
    return reports.log_counts(logs)


# --- connections -----------------------------------------------------------
def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = V.v_runs(spark, sf_dir)
    return connections.connection_windows(V.v_connection_events(spark, sf_dir), runs), runs


@register("connection_windows")
def connection_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _ = _windows(spark, sf_dir)
    return _plain(w.withColumn("segment_ids", joined("segment_ids")))


@register("disconnect_gaps")
def disconnect_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(connections.disconnect_gaps(*_windows(spark, sf_dir)))


@register("window_overlaps")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _ = _windows(spark, sf_dir)
    # neighbouring users share a run here, so that windows do overlap
    shared = w.withColumn(
        "run_id", F.concat(F.lit("R-"), (F.substring_index("run_id", "-", -1).cast("bigint") % 5).cast("string"))
    )
    out = connections.window_overlaps(shared).groupBy("run_id").agg(F.count(F.lit(1)).alias("overlap_count"))
    return out


@register("coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, runs = _windows(spark, sf_dir)
    out = connections.coverage(w, connections.disconnect_gaps(w, runs), runs)
    return _plain(out).withColumn("coverage", F.round("coverage", 10))


@register("max_quiet_gap")
def max_quiet_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections.max_quiet_gap(V.v_observations(spark, sf_dir), V.v_runs(spark, sf_dir), 86_400)


@register("freshness")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections.freshness(
        V.v_observations(spark, sf_dir), datetime(2024, 2, 1, tzinfo=timezone.utc)
    )


@register("lifecycle_observations")
def lifecycle_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    words = ("active", "initialized", "finalized", "inactive", "closed", "mystery", "open")
    status = F.element_at(F.array(*[F.lit(w) for w in words]), (e % 7 + 1).cast("int"))
    ticker = F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string"))
    df = V.v_events(spark, sf_dir).select(
        e.alias("event_id"),
        ticker.alias("ticker"),
        F.when(e % 8 == 0, F.concat(ticker, F.lit(" "))).otherwise(ticker).alias("market_ticker"),
        ticker.alias("selected_ticker"),
        status.alias("status"),
        F.lit(None).cast("string").alias("raw_status"),
        F.when(e % 19 == 0, "MVE").otherwise("binary").alias("market_type"),
        F.lit(False).alias("is_mve"),
        F.lit(None).cast("string").alias("mve_collection_ticker"),
        F.col("ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))).alias("evaluated_at"),
    )
    out = connections.lifecycle_observations(df, 3_000)
    return out.select(
        "event_id", "normalized_status", "lifecycle_status", "observation_age_seconds", "validity", "identity_ok"
    )


@register("run_order_violations")
def run_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    requests = V.v_events(spark, sf_dir).select(
        F.concat(F.lit("R-"), F.floor(e / 100).cast("string")).alias("run_id"),
        (e % 100 + F.when(e % 23 == 0, 2).otherwise(1)).alias("run_request_index"),
        F.when(e % 31 == 0, e % 100).otherwise(e % 100 + 1000).alias("native_command_id"),
        F.when(e % 2 == 0, "trade").otherwise("orderbook_delta").alias("channel"),
        (F.floor((e % 100) / 2) + F.when(e % 37 == 0, 3).otherwise(1)).alias("subscription_generation"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("k") % 10).cast("int"))).alias("created_at"),
        e.alias("ord"),
    )
    return connections.run_order_violations(requests, chunk_of(F.col("ord"), CHUNK_ROWS))


# --- market selection ------------------------------------------------------
SELECTED_AT = datetime(2026, 8, 1, tzinfo=timezone.utc)


def _selected(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    markets = selection.enrich_events(V.v_markets(spark, sf_dir), V.v_market_events(spark, sf_dir), "ord")
    return selection.select_markets(markets, SELECTED_AT, options.pop("duration", 1800), **options)


@register("market_selection")
def market_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for duration in (1800, 900, 604_800):
        one = _selected(spark, sf_dir, duration=duration).select(
            "ord", "selection_profile", "selection_gate_result", "primary_rejection_reason",
            joined("rejection_reasons").alias("reasons"), "occurrence_class", "dual_interpretation_pass",
            "seconds_to_close", "seconds_to_deadline", "lifecycle_deadline_source", "market_lifecycle_status",
        )
        out = one if out is None else out.unionByName(one)
    return out


@register("discovery_audit")
def discovery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.discovery_audit(_selected(spark, sf_dir))


@register("near_miss_topk")
def near_miss_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.near_misses(_selected(spark, sf_dir)).select(
        "market_id_hash", "event_id_hash", "lifecycle_margin_seconds", "close_margin_seconds",
        "expiration_margin_seconds", "occurrence_margin_seconds", "event_category_class", "match_like",
        "current_quote", "closes_early",
    )


@register("candidate_rank")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ranges are drawn from a sample of the rows, so a ranking reads them twice
    sel = _selected(spark, sf_dir).select(
        "ord", "activity", "closes_early", "seconds_to_deadline", "current_quote", "ticker", "market_ticker"
    )
    sel = stage(sel, "selected-markets")
    a = selection.candidate_rank(sel, True).select(F.lit("activity").alias("mode"), "ord", "candidate_rank")
    b = selection.candidate_rank(sel, False).select(F.lit("deadline").alias("mode"), "ord", "candidate_rank")
    return a.unionByName(b)


@register("eligible_candidates")
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sel = _selected(spark, sf_dir)
    out = selection.eligible_candidates(sel, F.col("orderbook_level_count") > 2, eligible_limit=12)
    return out.select("ord", "candidate_rank", "eligible")


@register("market_dedupe")
def market_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three part keys share a ticker
    m = V.v_markets(spark, sf_dir)
    same = F.concat(F.when(F.col("ord") % 41 == 0, "MKT ").otherwise("MKT-"), F.floor(F.col("ord") / 3).cast("string"))
    m = m.withColumns({"ticker": same, "market_ticker": F.lit(None).cast("string")})
    return selection.dedupe_markets(m, "ord").select("ord", "ticker", "duplicate_count")


@register("market_event_enrich")
def market_event_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.enrich_events(V.v_markets(spark, sf_dir), V.v_market_events(spark, sf_dir), "ord")
    return out.select("ord", "event_ticker", "event_category", "event_title", "event_metadata_fetched", "event_reason")


@register("event_identity_check")
def event_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.v_market_events(spark, sf_dir)
    return ev.select("ord", "event_ticker", selection.event_identity_ok().alias("identity_ok"))


@register("missing_events")
def missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_ticker")
    events = V.v_market_events(spark, sf_dir).withColumn(
        "event_ticker", F.when(F.col("ord") % 3 == 0, known).otherwise(F.concat(F.lit("OTHER-"), known))
    )
    return selection.missing_events(V.v_markets(spark, sf_dir), events)


@register("market_status_normalize")
def market_status_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.normalize_status(V.v_markets(spark, sf_dir))
    return out.groupBy("raw_status", "status").agg(F.count(F.lit(1)).alias("market_count"))


@register("market_identity_check")
def market_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.check_identity(V.v_markets(spark, sf_dir)).select(
        "ord", "market_identity", "identity_error"
    )


@register("market_activity")
def market_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = selection.with_market_columns(V.v_markets(spark, sf_dir))
    return m.select(
        "ord", V.d6(selection.activity_score()).alias("activity"),
        selection.quote_indicator().alias("current_quote"), selection.is_match().alias("match_like"),
    )


# --- native rows, admission, evidence ----------------------------------------
@register("native_envelope")
def native_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_native(spark, sf_dir).select(
        "ord", "native_type", "channel", "request_id", "sid", "envelope_rejection", "market_ticker", "seq",
        F.col("provenance.channel").alias("channel_source"), F.col("provenance.sid").alias("sid_source"),
    )


@register("pricing_values")
def pricing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    token = V.pick(e % 4, "true", "false", '"yes"', "1")
    inner = F.concat(F.lit('"params":{"use_yes_price":'), token, F.lit("}"))
    payload = F.concat(
        F.lit('{"type":"x"'), F.when(e % 3 == 0, F.concat(F.lit(","), inner)).otherwise(""),
        F.lit(',"msg":{"a":1'), F.when(e % 5 == 0, F.concat(F.lit(","), inner)).otherwise(""),
        F.when(e % 7 == 0, F.concat(F.lit(',"msg":{"params":{"msg":{'), inner, F.lit("}}}"))).otherwise(""), F.lit("}}"),
    )
    df = V.v_events(spark, sf_dir).select("event_id", payload.alias("payload"))
    return df.select("event_id", joined(native.pricing_values(F.col("payload"))).alias("pricing_values"))


@register("sequence_state")
def sequence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_admitted(spark, sf_dir).select(
        "campaign_id", "ord", "native_type", "sequence_state", "admission_status", "exclusion_reason",
        "resync_state", "segment_number", "segment_boundary_reason",
    )


@register("binding_state")
def binding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritymill.operators.admission import bind_rows

    _, requests, _ = V.v_transport(spark, sf_dir)
    out = bind_rows(V.v_native(spark, sf_dir), requests, chunk_of(F.col("ord"), CHUNK_ROWS))
    return out.select(
        "campaign_id", "connection_epoch", "ord", "binding_channel", "generation", "command_id",
        "run_request_index", "binding_state", "binding_observation",
    )


def _map_text(column: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
        "|",
    )


@register("sequence_summary")
def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.sequence_summary(V.v_recorded(spark, sf_dir))
    return out.withColumns(
        {
            "segment_boundary_reasons": joined("segment_boundary_reasons"),
            "native_sid_values": joined("native_sid_values"),
            "sequence_states": _map_text("sequence_states"),
        }
    )


@register("sequence_evidence")
def sequence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evidence.sequence_summary(V.v_recorded(spark, sf_dir))
    return evidence.sequence_evidence(summary, ["connection_id"])


@register("binding_summary")
def binding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.binding_summary(V.v_recorded(spark, sf_dir))
    sets = ("command_ids", "generations", "binding_ids", "native_sids", "states")
    return out.select("connection_id", "segment_id", "channel", *[joined(c).alias(c) for c in sets])


@register("rebuild_summary")
def rebuild_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.rebuild_summary(V.v_rebuilt(spark, sf_dir), rebuild.BOOK)
    return out.withColumn("invalidation_reasons", _map_text("invalidation_reasons"))


@register("rebuild_evidence")
def rebuild_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evidence.rebuild_summary(V.v_rebuilt(spark, sf_dir), rebuild.BOOK)
    return evidence.rebuild_evidence(summary, ["connection_id"])


@register("segment_contradictions")
def segment_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("row_index")
    rows = V.v_recorded(spark, sf_dir).withColumns(
        {
            "sid": F.when(e % 1600 == 799, "99").otherwise("7"),
            "market_id": F.when(e % 2000 == 1555, "odd").otherwise(F.col("market_ticker")),
            "requested_market_tickers": F.array(*[F.lit(f"M-{i}") for i in range(10)]),
            "use_yes_price": F.when(e % 40 == 0, F.array(F.lit("false"))).when(
                e % 2400 == 2250, F.array(F.lit("true"))
            ),
        }
    )
    out = rebuild.segment_contradictions(rows, ["sid"], explicit_unified=False)
    return out.select("row_index", "segment_id", "segment_error")


@register("public_trades")
def public_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.classify_trades(V.v_recorded(spark, sf_dir), [f"M-{i}" for i in (0, 1, 2, 9)])
    return evidence.trade_stream_summary(out, by=["connection_id"])


@register("selected_market_semi_join")
def selected_market_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("n_nationkey") % 2 == 0, "M-").otherwise("OTHER-")
    chosen = V.table(spark, sf_dir, "nation").select(
        F.concat(prefix, F.col("n_nationkey").cast("string")).alias("market_ticker")
    )
    out = evidence.classify_trades(V.v_recorded(spark, sf_dir), chosen)
    return out.where(F.col("trade_class") == "trade").select("row_index", "market_ticker", "trade_id")


@register("evidence_dimensions")
def evidence_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.evidence_overall(evidence.evidence_dimensions(V.v_dimension_inputs(spark, sf_dir)))
    return out.select("run_id", *evidence.EVIDENCE_DIMENSIONS, "overall_classification")


@register("evidence_overall")
def evidence_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    grades = V.table(spark, sf_dir, "orders").select(
        k.alias("run"),
        *[
            F.when(k % (40 + i) == 0, "FAIL").when(k % (20 + i) == 1, "UNKNOWN").otherwise("PASS").alias(d)
            for i, d in enumerate(evidence.EVIDENCE_DIMENSIONS)
        ],
    )
    return evidence.evidence_overall(grades).select("run", "overall_classification")


@register("campaign_classify")
def campaign_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.classify_campaigns(V.v_campaigns(spark, sf_dir)).select(
        "campaign", joined("failures").alias("failures"), "evidence_classification", "campaign_evidence_valid",
        "validation_status", "data_integrity_classification",
    )


@register("phase_assessment")
def phase_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.assess_phase(V.v_phase_runs(spark, sf_dir), 1800)
    return out.select("run", *evidence.PHASE_GATES, "qualified", "fallback_allowed")


@register("segment_chain_audit")
def segment_chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.segment_chain_audit(V.v_segment_lines(spark, sf_dir), "v1")


@register("frame_hash_chain")
def frame_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rebuild.with_frame_hash(rebuild.book_frames(V.v_rebuilt(spark, sf_dir)))
    return integrity.frame_hash_chain(frames, rebuild.BOOK, "row_index")


@register("record_hash")
def record_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.v_events(spark, sf_dir)
    fields = {c: F.col(c) for c in ("user_id", "event_id", "event_type", "props")}
    return ev.select("event_id", record_hash(fields).alias("record_hash"))


@register("quote_hysteresis")
def quote_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.quote_hysteresis(
        V.v_quotes(spark, sf_dir), "0.02", chunk_of(F.col("ord"), CHUNK_ROWS), max_open=2
    )
    return out.select("instrument_id", "side", "ord", "action", "result_status", V.d6(F.col("accepted_price")).alias("accepted_price"))


# --- approvals -------------------------------------------------------------
def _approval_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    risk = controls.risk_decisions(V.v_risk_inputs(spark, sf_dir))
    pending = controls.pending_approvals(
        risk, datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 1, 2, tzinfo=timezone.utc)
    )
    n = F.conv(F.substring("approval_id", 1, 4), 16, 10).cast("bigint")
    approvals = pending.select(
        F.when(n % 7 == 0, F.lit("other")).otherwise(F.col("approval_id")).alias("approval_id"),
        "proposal_id",
        F.when(n % 11 == 0, F.lit("bad")).otherwise(F.col("candidate_hash")).alias("candidate_hash"),
        (n % 5 != 0).alias("approved"),
        (n % 9 == 0).alias("used"),
    )
    return pending, approvals


@register("approval_verify")
def approval_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, approvals = _approval_sides(spark, sf_dir)
    out = controls.verify_approvals(pending, approvals, datetime(2026, 1, 1, 12, tzinfo=timezone.utc))
    return out.select("approval_id", "proposal_id", "status", "approved", joined("reasons").alias("reasons"))


@register("preview_chain")
def preview_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    digest = lambda bad: F.sha2(F.concat(F.when(bad, "x").otherwise(""), key), 256)
    base = o.select(key.alias("proposal_id"), F.sha2(key, 256).alias("candidate_hash"))
    # a side without a row for a proposal has one under another name
    named = lambda gone: F.when(gone, F.concat(F.lit("other-"), key)).otherwise(key).alias("proposal_id")
    risk = o.select(
        named(k % 17 == 0), digest(k % 19 == 0).alias("candidate_hash"),
        F.when(k % 5 == 0, "reject").otherwise("manual_review_required").alias("decision"),
        F.when(k % 23 == 0, F.array(F.lit("manual_approval_required"), F.lit("stale_data"))).otherwise(
            F.array(F.lit("manual_approval_required"))
        ).alias("reasons"),
    )
    approvals = o.select(
        named(k % 7 == 0), F.sha2(key, 256).alias("candidate_hash"),
        F.concat(F.lit("A"), key).alias("approval_id"),
        F.when(k % 11 == 0, F.lit("2025-01-01T00:00:00Z")).otherwise("2027-01-01T00:00:00Z").cast("timestamp").alias("expires_at"),
        (k % 13 == 0).alias("used"), (k % 4 != 0).alias("approved"),
        F.when(k % 4 != 0, "approved_for_paper_once").otherwise("reject").alias("status"),
    )
    ledger_side = o.select(
        named(k % 29 == 0), F.sha2(key, 256).alias("candidate_hash"),
        (k % 31 == 0).cast("bigint").alias("reconciliation_mismatch_count"),
    )
    recon = o.select(
        named(k % 37 == 0), F.sha2(key, 256).alias("candidate_hash"),
        F.concat(F.when(k % 41 == 0, "B").otherwise("A"), key).alias("approval_id"),
        (k % 43 == 0).cast("bigint").alias("mismatch_count"),
    )
    out = controls.preview_chain(
        base, risk, approvals, ledger_side, recon, datetime(2026, 1, 1, tzinfo=timezone.utc)
    )
    return out.select("proposal_id", "first_failing_gate", "preview_allowed")


# --- monitor ---------------------------------------------------------------
MONITOR_NOW = datetime(2001, 8, 1, 0, 10, tzinfo=timezone.utc)


@register("monitor_health")
def monitor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = monitor.run_rollup(V.v_monitor_records(spark, sf_dir))
    return monitor.monitor_health(r, monitor.venue_status(V.v_venues(spark, sf_dir), MONITOR_NOW))


@register("monitor_rollup")
def monitor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.run_rollup(V.v_monitor_records(spark, sf_dir))
    return _plain(out.withColumn("risk_reasons", joined("risk_reasons")))


@register("monitor_venues")
def monitor_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.venue_status(V.v_venues(spark, sf_dir), MONITOR_NOW))


@register("monitor_orders")
def monitor_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.monitor_orders(V.v_monitor_records(spark, sf_dir))
    return _plain(out.select("run_id", "ord", "order_id", "venue", "market_ticker", "action", "price", "quantity", "notional", "status", "source"))


@register("monitor_candidates")
def monitor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.monitor_candidates(V.v_monitor_records(spark, sf_dir))
    return _plain(out.select("run_id", "ord", "market_ticker", "strategy", "edge_before_fees", "liquidity", "stale", "risk_decision"))


@register("monitor_refresh")
def monitor_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    campaigns = V.table(spark, sf_dir, "orders").select(
        k.alias("campaign"), (k % 3 != 0).alias("running"),
        (F.lit("2001-08-01T00:10:00Z").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 90).cast("decimal(18,6)"))).alias("evaluated_at"),
        (k % 100).alias("keepalive_age"), (k % 110).alias("lifecycle_age"), F.when(k % 5 != 0, k % 300).alias("quiet_age"),
        F.lit("PASS").alias("transport_keepalive"), F.lit("PASS").alias("market_lifecycle_validity"),
        F.lit("UNKNOWN").alias("message_freshness"),
    )
    return monitor.refresh_running(campaigns, MONITOR_NOW).drop("evaluated_at")


@register("monitor_positions")
def monitor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with missing names, clocks and amounts, filled by the monitor's defaults."""
    k = F.col("l_orderkey")
    text = lambda every, c: F.when(k % every == 0, F.lit("")).when(k % every != 1, c)
    positions = V.table(spark, sf_dir, "lineitem").select(
        text(5, F.lit("v")).alias("venue"), text(3, F.concat(F.lit("M-"), F.col("l_partkey").cast("string"))).alias("market_id"),
        F.concat(F.lit("P-"), k.cast("string")).alias("proposal_id"), F.col("l_returnflag").alias("side"),
        F.col("l_quantity").cast("decimal(28,8)").alias("quantity"), (F.col("l_linenumber") % 2).cast(TOTAL).alias("exposure"),
        F.col("l_suppkey").cast(TOTAL).alias("notional"), (F.col("l_linenumber") % 3).cast(TOTAL).alias("fees_paid"),
    )
    out = monitor.monitor_positions(positions)
    return _plain(out.select("venue", "market_id", "market_ticker", "currency", "side", "quantity", "exposure", "fees", "source"))


@register("run_record_counts")
def run_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 7 == 0, "runtime_launch").when(e % 7 == 3, "runtime_terminal").otherwise("frame")
    rows = V.v_events(spark, sf_dir).select(
        F.concat(F.lit("R-"), F.floor(e / 7).cast("string")).alias("run_id"),
        F.when(e % 91 != 0, kind).otherwise("runtime_terminal").alias("record_type"),
    )
    return connections.run_record_counts(rows)


@register("required_channels")
def required_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    acks = V.v_events(spark, sf_dir).select(
        F.concat(F.lit("C-"), F.floor(e / 4).cast("string")).alias("connection_id"),
        V.pick(F.floor(e / 3) % 4, "orderbook_delta", "trade", "ticker", "trade").alias("channel"),
    )
    out = selection.required_channels_acknowledged(acks, ["orderbook_delta", "trade"], ["connection_id"])
    return out.withColumn("acknowledged_channels", joined("acknowledged_channels"))


@register("native_source_class")
def native_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source class and order-book freshness of every user's events."""
    kind = F.col("event_id") % 5
    seen = V.v_events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if((kind == 0) & (F.col("user_id") % 3 == 0)).alias("delta_count"),
        F.count_if((kind == 1) & (F.col("user_id") % 2 == 0)).alias("snapshot_count"),
        F.count_if(kind == 2).alias("trade_count"),
        F.max(F.when(F.col("user_id") % 4 != 0, F.col("event_id") % 600)).alias("age"),
    )
    return seen.select(
        "user_id", evidence.source_type_class().alias("source_type"), evidence.orderbook_freshness(F.col("age")).alias("freshness")
    )


# --- sources and safety ------------------------------------------------------
def _written(spark: SparkSession, lines: DataFrame, label: str) -> str:
    """Write text lines below the shared folder, to be scanned back."""
    folder = shared_folder(spark, label)
    lines.write.text(folder)
    return folder


def _event_lines(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    e = F.col("event_id")
    good = F.to_json(F.struct("event_id", "event_type", "user_id"))
    line = good
    if broken:
        line = F.when(e % 97 == 0, F.substring(good, 1, 12)).when(e % 89 == 0, "[1,2]").when(e % 83 == 0, "  ").otherwise(good)
    return V.v_events(spark, sf_dir).select(line.alias("value"))


@register("jsonl_strict_scan")
def jsonl_strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, _event_lines(spark, sf_dir, False), "jsonl-strict")
    good, _ = jsonl.read_jsonl(spark, folder, "event_id bigint, event_type string, user_id bigint")
    return good.select("event_id", "event_type", "user_id")


@register("jsonl_quarantine_scan")
def jsonl_quarantine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, _event_lines(spark, sf_dir, True), "jsonl-quarantine")
    good, bad = jsonl.read_jsonl(spark, folder, "event_id bigint, event_type string", "quarantine")
    return good.select("event_type").unionByName(bad.select(F.col("warning").alias("event_type"))).groupBy(
        "event_type"
    ).agg(F.count(F.lit(1)).alias("line_count"))


@register("jsonl_canonical_write")
def jsonl_canonical_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = V.v_fills(spark, sf_dir).select("ord", "side", "price", "instrument_id", "quantity")
    folder = shared_folder(spark, "jsonl-canonical")
    jsonl.write_jsonl(fills.where(F.col("ord") % 2 == 0), folder)
    jsonl.write_jsonl(fills.where(F.col("ord") % 2 == 1), folder, "append")
    return spark.read.text(folder).select(F.col("value").alias("line"))


@register("mixed_artifact_union")
def mixed_artifact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.v_events(spark, sf_dir)
    a = ev.where(F.col("event_id") % 2 == 0).select(F.to_json(F.struct(F.lit("frame").alias("record_type"), "event_id")).alias("value"))
    b = ev.where(F.col("event_id") % 2 == 1).select(F.to_json(F.struct(F.lit("quote").alias("record_type"), "user_id")).alias("value"))
    mixed = jsonl.read_mixed(
        spark,
        [
            (_written(spark, a, "mixed-a"), "record_type string, event_id bigint"),
            (_written(spark, b, "mixed-b"), "record_type string, user_id bigint"),
        ],
    )
    return mixed.groupBy("record_type").agg(
        F.count(F.lit(1)).alias("record_count"), F.count("event_id").alias("event_ids"), F.count("user_id").alias("user_ids")
    )


@register("live_event_validation")
def live_event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    df = V.v_events(spark, sf_dir).select(
        "event_id", F.lit(1).alias("schema_version"), F.when(e % 11 != 0, "kalshi_demo").otherwise("").alias("venue"),
        F.lit("book").alias("channel"), F.lit("M").alias("market_id"), F.lit("snapshot").alias("event_type"),
        (e % 13).alias("sequence"), F.concat(iso, F.when(e % 7 == 0, "").otherwise("+00:00")).alias("observed_at"),
        F.concat(iso, F.lit("Z")).alias("received_at"),
        F.when(e % 17 == 0, "web").otherwise("mock_websocket").alias("source_type"),
        F.when(e % 19 == 0, F.lit('{"a":{"Api_Key":1}}')).otherwise(F.col("props")).alias("payload"),
        F.array().cast("array<string>").alias("tags"),
    )
    return records.validate_live_events(df).select("event_id", joined("errors").alias("errors"))


@register("snapshot_round_trip")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as snapshot lines and read back typed."""
    books_in = books.normalize_yes_no(V.v_yes_no_payloads(spark, sf_dir)).select(
        F.lit("kalshi_demo").alias("exchange"), F.col("event_id").cast("string").alias("ticker"),
        F.lit("2026-01-01T00:00:00Z").cast("timestamp").alias("observed_at"),
        F.lit("2026-01-01T00:00:01Z").cast("timestamp").alias("recorded_at"),
        F.lit("fixture").alias("source_type"), "instrument_id", "source", "bids", "asks",
    )
    folder = shared_folder(spark, "snapshots")
    records.write_snapshots(books_in, folder)
    out = books.book_metrics(records.read_snapshots(spark, folder))
    return out.select(
        F.col("ticker").cast("bigint").alias("event_id"), joined("errors").alias("errors"),
        V.d6(F.col("best_bid")).alias("best_bid"), V.d6(F.col("best_ask")).alias("best_ask"),
        V.d6(F.col("bid_depth")).alias("bid_depth"),
    )


def _book_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixture document per order that has lines; top-level fields default the rows."""
    li = V.table(spark, sf_dir, "lineitem")
    text = lambda c: F.concat(F.lit('"'), c.cast("decimal(6,2)").cast("string"), F.lit('"'))
    row = F.concat(
        F.lit('{"venue":"v","market_id":"'), F.col("l_partkey").cast("string"), F.lit('","best_yes_bid":'),
        text(F.col("l_discount") + 0.45), F.lit(',"best_no_bid":'), text(F.col("l_tax") + 0.46),
        F.lit(',"yes_bid_size":'), text(F.col("l_quantity")), F.lit(',"no_bid_size":'), text(51 - F.col("l_quantity")),
        F.when(F.col("l_returnflag") == "A", F.lit(',"fee_status":"unknown"')).otherwise(""), F.lit("}"),
    )
    docs = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("rows"))
    return docs.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("["), "rows", F.lit("]")))
        .otherwise(
            F.concat(
                F.lit('{"source":"s","fee_status":"supplied","fee_per_contract":"0.01","minimum_net_edge_per_contract":"0.005","'),
                F.when(F.col("l_orderkey") % 3 == 1, "markets").otherwise("books"), F.lit('":['), "rows", F.lit("]}"),
            )
        )
        .alias("document"),
    )


@register("scan_fixture")
def scan_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.books_from_documents(_book_documents(spark, sf_dir))
    cand = parity.complement_candidates(rows)
    return cand.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("sequence").alias("max_sequence"),
        F.count_if(F.col("decision") == "paper_candidate").alias("paper_candidate_count"),
        F.count_if(F.col("fee_status") == "missing").alias("missing_fee_count"),
        V.d6(F.sum("net_edge_per_contract")).alias("net_edge_sum"),
    )


@register("scenario_fixture")
def scenario_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    one = lambda p, t: F.concat(F.lit('{"policy":"' + p + '","target_size":"'), t.cast("string"), F.lit('"}'))
    doc = F.when(
        k % 2 == 0, F.concat(F.lit('{"scenarios":['), one("fok", k % 9), F.lit(","), one("ioc", k % 7), F.lit("]}"))
    ).otherwise(one("ioc", k % 5))
    out = records.scenarios_from_documents(o.select("o_orderkey", doc.alias("document")))
    return out.select("o_orderkey", "sequence", "policy", V.d6(F.col("target_size")).alias("target_size"))


@register("paged_list_union")
def paged_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    pages = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("page")).agg(
        F.concat(
            F.lit('{"cursor":"","markets":['),
            F.array_join(F.collect_list(F.to_json(F.struct(F.col("p_partkey").alias("ticker")))), ","), F.lit("]}"),
        ).alias("document")
    )
    out = records.explode_pages(pages, "document", "markets")
    return out.select("page", F.get_json_object("item", "$.ticker").cast("bigint").alias("ticker"))


@register("facts_flatten")
def facts_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing per supplier built from its nation, flattened to facts."""
    s = V.table(spark, sf_dir, "supplier")
    cents = lambda c: c.cast("decimal(14,2)").cast("string")
    fact = lambda year, c: F.concat(
        F.lit('{"val":'), cents(c), F.lit(f',"fy":{year},"fp":"FY","form":"10-K","filed":"{year + 1}-02-01","end":"{year}-12-31","accn":"a-'),
        F.col("s_suppkey").cast("string"), F.lit(f'-{year}"}}'),
    )
    doc = F.concat(
        F.lit('{"cik":'), F.col("s_suppkey").cast("string"), F.lit(',"entityName":"'), F.col("s_name"),
        F.lit('","facts":{"odd":3,"us-gaap":{"Balance":{"label":"Account balance","units":{"USD":['),
        fact(2022, F.col("s_acctbal")), F.lit(","), fact(2023, F.col("s_acctbal") * 2),
        F.lit(']}},"Nation":{"units":{"count":['), fact(2023, F.col("s_nationkey")), F.lit("]}}}}}"),
    )
    return _plain(records.flatten_company_facts(s.select(doc.alias("document"))))


@register("manifest_coverage")
def manifest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritymill.fixed import REPORT_INPUT_KINDS

    p = V.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in REPORT_INPUT_KINDS]), (F.col("p_partkey") % 22 + 1).cast("int"))
    manifest = p.select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("local_path"), kind.alias("input_kind"),
        (F.col("p_size") % 4 == 0).alias("required"),
    )
    # later lines belong to files that the manifest does not name
    folder = F.when(F.col("l_shipdate") < "1996-01-01", "part/").otherwise("later/")
    rows = V.table(spark, sf_dir, "lineitem").select(
        F.concat(folder, F.col("l_partkey").cast("string")).alias("local_path")
    )
    return records.manifest_coverage(manifest, rows)


@register("manifest_entries")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    entry = F.concat(
        F.lit('{"local_path":"'), F.when(k % 9 == 0, "https://x/").otherwise("data/"), k.cast("string"),
        F.lit('","input_kind":"'), F.when(k % 5 == 0, "strange").otherwise("local_risk_review"),
        F.lit('","display_label":"d","rights_note":"r"'),
        F.when(k % 7 != 0, F.lit(',"assumption_scope":"a"')).otherwise(""), F.lit(',"required":true}'),
    )
    docs = p.select(k.alias("manifest_id"), F.concat(F.lit('{"inputs":['), entry, F.lit("]}")).alias("document"))
    return records.manifest_entries(docs).select("manifest_id", "local_path", joined("errors").alias("errors"))


@register("descriptor_validation")
def descriptor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    row = F.concat(
        F.lit('{"name":"n","status":"'), V.pick(e % 4, "pass", "fail", "skipped", "odd"), F.lit('"'),
        F.when(e % 5 != 0, F.lit(',"note":"x"')).otherwise(""), F.when(e % 7 == 0, F.lit(',"Excerpt":"q"')).otherwise(""),
        F.when(e % 11 == 0, F.lit(',"my_token":"q"')).otherwise(""), F.lit("}"),
    )
    df = V.v_events(spark, sf_dir).select("event_id", row.alias("row_json"))
    return records.validate_descriptor_rows(df, ["name", "note"]).select("event_id", joined("errors").alias("errors"))


@register("fixture_snapshots")
def fixture_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = V.v_yes_no_payloads(spark, sf_dir).select(F.col("event_id").alias("fixture_id"), "payload")
    markets = payloads.select("fixture_id", F.concat(F.lit("F-"), (F.col("fixture_id") % 100).cast("string")).alias("ticker"))
    out = records.fixture_snapshots(markets, payloads, "2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z")
    return out.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("snapshot_count"), F.count_if(F.size("errors") > 0).alias("error_count"),
        F.sum(F.size("bids").cast("bigint")).alias("bid_levels"),
    )


def _text_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts inside JSON payloads with safe, secret and private keys."""
    d = F.col("doc_id")
    body = F.to_json(F.struct(F.col("text").alias("text"), F.col("lang").alias("lang")))
    extra = F.when(d % 5 == 0, F.lit('"Auth_Token":"abc"')).when(d % 5 == 1, F.lit('"order_id":7')).when(
        d % 5 == 2, F.lit('"cfg":{"my_secret":{"a":[1,2]}}')
    ).otherwise(F.lit('"n":1'))
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("{"), extra, F.lit(',"body":'), body, F.lit("}")).alias("payload")
    )


@register("payload_safety")
def payload_safety_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payload_safety(_text_payloads(spark, sf_dir), "payload")
    return out.select(
        "doc_id", joined("secret_keys").alias("secret_keys"), joined("private_keys").alias("private_keys"), "payload_safe"
    )


@register("payload_redact")
def payload_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact_payload(_text_payloads(spark, sf_dir), "payload")
    return out.select(
        "doc_id",
        F.get_json_object("payload", "$.Auth_Token").alias("auth_token"),
        F.get_json_object("payload", "$.cfg.my_secret").alias("nested_secret"),
        F.sha2(F.get_json_object("payload", "$.body.text"), 256).alias("text_hash"),
    )


# --- streams ---------------------------------------------------------------
@register("feed_consistency_stream")
def feed_consistency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    feed_rows = V.stream_events(spark, sf_dir).select(
        F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("venue"),
        F.lit("orderbook").alias("channel"),
        F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string")).alias("market_id"),
        e.alias("event_id"),
        (e + F.floor(e / 17)).alias("sequence"),
        F.col("ts").alias("received_at"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))).alias("observed_at"),
    )
    out = streams.run_available(
        stateful.feed_consistency_stream(feed_rows, "event_id", 30 * 60), "feed-stream"
    )
    return out.select("market_id", "arrival", "sequence", "flags")


@register("rebuild_stream")
def rebuild_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = V.messages_of(V.stream_events(spark, sf_dir)).where(F.col("native_type") != "heartbeat")
    out = streams.run_available(
        stateful.rebuild_stream(rebuild.parse_book_messages(msgs)), "rebuild-stream"
    )
    return out.select(
        "row_index", "market_ticker", "disposition", "reason", "frame_count",
        V.d6(F.col("best_bid")).alias("best_bid"), V.d6(F.col("best_ask")).alias("best_ask"),
    )


@register("sequence_stream")
def sequence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound rows written once and read as a stream."""
    prepared = V.v_prepared(spark, sf_dir)
    folder = shared_folder(spark, "sequence-in")
    prepared.write.parquet(folder)
    live = spark.readStream.schema(prepared.schema).parquet(folder)
    out = streams.run_available(stateful.sequence_stream(live, contiguous=True), "sequence-stream")
    return out.select(
        "campaign_id", "connection_epoch", "subscription", "ord", "sequence_state", "admission_status",
        "exclusion_reason", "resync_state", "failures",
    )


@register("event_identity_stream")
def event_identity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, repeated and conflicting arrivals of demo events."""
    live = V.stream_events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 500))
    found = stateful.event_identity_stream(V.demo_events(live), ["audit_id", "event_id"], "ord", "event_hash")
    return streams.run_available(found, "identity-stream")


@register("late_split_stream")
def late_split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in three batches, those behind the watermark kept in a sink of their own."""
    events = V.v_events(spark, sf_dir).select("event_id", "ts")
    folder, files = shared_folder(spark, "late-in"), 8
    turn = F.when(F.col("event_id") % 10 < 6, 0).when(F.col("event_id") % 10 < 9, 1).otherwise(2)
    for arrival in range(3):
        events.where(turn == arrival).repartition(files).write.mode("append").parquet(folder)
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    kept, late = streams.run_late_split(live, "ts", 3 * 24 * 3600, "late-stream")
    sinks = [df.select("event_id", F.lit(name).alias("sink")) for df, name in ((kept, "kept"), (late, "late"))]
    return sinks[0].unionByName(sinks[1])


@register("distinct_events_stream")
def distinct_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.stream_events(spark, sf_dir).select((F.col("event_id") % 500).alias("event_id"), "ts")
    return streams.run_available(streams.distinct_events_stream(ev, "ts", "60 days"), "distinct-stream").select("event_id")


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stream_events(spark, sf_dir).select(
        "ts", F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string")).alias("market_id"),
        (F.floor(F.col("value") / 10) + 1).alias("quantity"),
    )


@register("daily_counters_stream")
def daily_counters_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.daily_counters_stream(_clocked(spark, sf_dir), "ts", "1 hour", ["market_id"])
    return _plain(streams.run_available(out, "daily-stream", "update", ["day", "market_id"]))


@register("sliding_counters_stream")
def sliding_counters_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = streams.daily_counters_stream(_clocked(spark, sf_dir), "ts", "1 hour")
    return _plain(streams.sliding_windows(streams.run_available(daily, "sliding-stream", "update", ["day"]), 7))


@register("quiet_sessions_stream")
def quiet_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.quiet_sessions_stream(_clocked(spark, sf_dir), "ts", "1 hour", ["market_id"])
    return _plain(streams.run_available(out, "session-stream", "complete"))


@register("stale_split_stream")
def stale_split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.stream_events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("received_at"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))).alias("observed_at"),
    )
    fresh, stale = streams.split_stale(ev, 30 * 60)
    a = streams.run_available(fresh.select("event_id"), "fresh-stream").select("event_id", F.lit("fresh").alias("sink"))
    b = streams.run_available(stale.select("event_id"), "stale-stream").select("event_id", F.lit("stale").alias("sink"))
    return a.unionByName(b)
