"""Market-shaped views over the generic star-schema tables.

Each ``v_*`` function derives one market relation from whole tables; the oracle
module states the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, QTY
from paritymill.functions.ordered import CHUNK_ROWS, chunk_of, scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  Clock times in it carry no zone; all views read them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price4(c: Column) -> Column:
    """A double with at most four decimals as an exact price."""
    return c.cast("decimal(10,4)").cast(PRICE)


def qty2(c: Column) -> Column:
    return c.cast("decimal(14,2)").cast(QTY)


def d6(c: Column) -> Column:
    """Exact decimal with at most six decimals, as a double."""
    return c.cast("decimal(24,6)").cast("double")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows spread evenly before work that costs far more than their bytes.

    A file is cut by its bytes; rows of thirty bytes that become parsed messages would leave
    all of that work to the few tasks that read it.
    """
    return df.repartition(key)


def v_top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one top-of-book row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    status = (
        F.when(F.col("l_returnflag") == "A", "supplied")
        .when(F.col("l_returnflag") == "N", "missing")
        .otherwise("unknown")
    )
    return li.select(
        F.concat(F.lit("venue_"), F.col("l_linestatus")).alias("venue"),
        F.concat(F.lit("M-"), F.col("l_partkey").cast("string")).alias("market_id"),
        (F.lit("0.45").cast(PRICE) + price4(F.col("l_discount"))).cast(PRICE).alias("best_yes_bid"),
        (F.lit("0.46").cast(PRICE) + price4(F.col("l_tax"))).cast(PRICE).alias("best_no_bid"),
        qty2(F.col("l_quantity")).alias("yes_bid_size"),
        qty2(F.lit(51) - F.col("l_quantity")).alias("no_bid_size"),
        F.lit("0").cast(PRICE).alias("estimated_slippage_per_contract"),
        F.lit("0.005").cast(PRICE).alias("failed_leg_reserve_per_contract"),
        F.lit("0.01").cast(PRICE).alias("minimum_net_edge_per_contract"),
        status.alias("fee_status"),
        F.when(F.col("l_returnflag") == "A", F.lit("0.01").cast(PRICE)).alias("fee_per_contract"),
        F.lit("view").alias("fee_source_note"),
        (F.year("l_shipdate") < 1996).alias("stale_book"),
        F.lit(False).alias("invalid_book_state"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )


def line_key() -> Column:
    """Text that identifies a lineitem row; the table has no unique key of its own."""
    money = lambda name: F.col(name).cast("decimal(14,2)").cast("string")
    return F.concat_ws(
        ":",
        F.col("l_orderkey").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        money("l_quantity"),
        money("l_extendedprice"),
        money("l_discount"),
        money("l_tax"),
        "l_returnflag",
        "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )


SCENARIOS = (
    {"name": "fok20", "policy": "fok", "target_size": "20"},
    {
        "name": "ioc30", "policy": "ioc", "target_size": "30",
        "yes_slippage_per_contract": "0.01", "no_slippage_per_contract": "0.02",
    },
    {
        "name": "ioc_all", "policy": "ioc", "latency_shock_per_contract": "0.005",
        "failed_leg_reserve_per_contract": "0",
    },
    {
        "name": "fok_thin", "policy": "fok", "target_size": "10",
        "yes_available_size": "8", "failed_leg_reserve_per_contract": "0.02",
    },
)


def v_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritymill.operators.parity import complement_candidates

    return complement_candidates(v_top_of_book(spark, sf_dir))


def v_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical YES books from V3, some of them one-sided or empty."""
    top = v_top_of_book(spark, sf_dir)
    line = F.col("l_linenumber")
    return top.select(
        line_key().alias("book_key"),
        F.when(~line.isin(1, 3), F.col("best_yes_bid")).alias("best_bid"),
        F.when(~line.isin(2, 3), (F.lit("1").cast(PRICE) - F.col("best_no_bid")).cast(PRICE)).alias(
            "best_ask"
        ),
        qty2(F.col("l_quantity") - 25).alias("inventory"),
    )


def v_risk_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = v_candidates(spark, sf_dir)
    return cand.select(
        line_key().alias("proposal_id"),
        F.sha2(line_key(), 256).alias("candidate_hash"),
        "fee_status",
        "net_edge_per_contract",
        "minimum_net_edge_per_contract",
        F.when(F.col("l_linenumber") == 7, F.array(F.lit("sequence_gap")))
        .when(F.array_contains("data_quality_flags", "stale_book"), F.array(F.lit("stale_event")))
        .otherwise(F.array().cast("array<string>"))
        .alias("data_quality_flags"),
        qty2(F.col("l_extendedprice")).alias("projected_exposure"),
        F.lit("60000").cast(QTY).alias("max_exposure"),
        F.col("l_linenumber").cast("bigint").alias("open_order_count"),
        F.lit(5).cast("bigint").alias("max_open_orders"),
        qty2(F.col("l_tax") * 100).alias("daily_loss"),
        F.lit("6").cast(QTY).alias("max_daily_loss"),
        (F.col("l_suppkey") % 11 == 0).cast("bigint").alias("reconciliation_mismatch_count"),
        (F.col("l_partkey") % 97 == 0).alias("kill_switch_active"),
    )


def v_proposal_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, simulations) keyed by market, each with a content hash; lines 1 to 3 simulate other markets."""
    from paritymill.operators.parity import fill_stress

    cand = v_candidates(spark, sf_dir)
    chosen = cand.withColumns(
        {"candidate_hash": F.sha2(line_key(), 256), "line_key": line_key()}
    )
    market = F.when(F.col("l_linenumber") < 4, F.concat(F.lit("other-"), "market_id")).otherwise(F.col("market_id"))
    sims = fill_stress(cand, SCENARIOS[1:2]).withColumns(
        {"market_id": market, "simulation_hash": F.sha2(F.concat(F.lit("sim:"), line_key()), 256), "sim_key": line_key()}
    )
    return chosen, sims


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant for a clock and the number in ``props``."""
    return table(spark, sf_dir, "events").withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "k": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"),
        }
    )


def v_feed(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """V1: a feed per market with gaps, late rows and rows out of order."""
    ev = v_events(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("venue"),
        F.lit("orderbook").alias("channel"),
        F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string")).alias("market_id"),
        F.col("ts").alias("received_at"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))).alias("observed_at"),
        "event_type",
        "user_id",
        "value",
    )
    step = F.lit(1).cast("bigint") + (F.col("event_id") % 17 == 0).cast("bigint")
    return scan(
        ev, ["market_id"], ["event_id"], chunk_of(F.col("event_id"), chunk_rows),
        running={"sequence": ("sum", step)},
    )


def _pairs(*levels: tuple[Column, int]) -> Column:
    parts = [
        F.concat(F.lit('["'), price.cast("decimal(6,2)").cast("string"), F.lit(f'","{size}"]'))
        for price, size in levels
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: native snapshot, delta and heartbeat messages as JSON payloads."""
    return messages_of(dealt(v_events(spark, sf_dir), "event_id"))


def messages_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    tenth = lambda c: c / F.lit(10)
    yes = _pairs((tenth(e % 3 + 1), 5), (tenth(e % 3 + 2), 7))
    no = F.when(e % 37 == 0, _pairs((tenth(e % 4 + 1), 6), (tenth(e % 4 + 1), 4))).otherwise(
        _pairs((tenth(e % 4 + 1), 6), (tenth(e % 4 + 3), 4))
    )
    market = F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string"))
    price = F.when(e % 103 == 0, "1.20").otherwise(tenth(e % 9 + 1).cast("decimal(6,2)").cast("string"))
    size = F.when(
        F.col("event_type") == "purchase", -F.floor(F.col("value") / 10)
    ).otherwise(F.floor("value") + 1)
    delta = F.when(e % 101 == 0, "x").otherwise(size.cast("string"))
    kind = (
        F.when(F.col("event_type") == "signup", "orderbook_snapshot")
        .when(F.col("event_type") == "error", "heartbeat")
        .otherwise("orderbook_delta")
    )
    head = F.concat(
        F.lit('{"type":"'), kind, F.lit('","sid":1,"seq":'), e.cast("string"),
        F.lit(',"msg":{"market_ticker":"'), market, F.lit('"'),
    )
    body = (
        F.when(
            kind == "orderbook_snapshot",
            F.concat(F.lit(',"yes_dollars_fp":'), yes, F.lit(',"no_dollars_fp":'), no),
        )
        .when(
            kind == "orderbook_delta",
            F.concat(
                F.lit(',"side":"'), F.when(e % 2 == 0, "yes").otherwise("no"),
                F.lit('","price_dollars":"'), price, F.lit('","delta_fp":"'), delta, F.lit('"'),
            ),
        )
        .otherwise(F.lit(""))
    )
    return events.select(
        e.cast("bigint").alias("row_index"),
        market.alias("market_ticker"),
        F.concat(F.lit("conn-"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("connection_id"),
        F.lit("seg-1").alias("segment_id"),
        kind.alias("native_type"),
        F.col("ts").alias("received_at"),
        F.concat(head, body, F.lit("}}")).alias("payload"),
        "user_id",
        "event_type",
        "value",
        "k",
    )


def v_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritymill.operators.rebuild import parse_book_messages, rebuild_books

    msgs = v_messages(spark, sf_dir).where(F.col("native_type") != "heartbeat")
    return rebuild_books(parse_book_messages(msgs))


def v_yes_no_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST-shaped YES/NO books, one per event."""
    e = F.col("event_id")
    tenth = lambda c: c / F.lit(10)
    yes = _pairs((tenth(e % 3 + 1), 5), (tenth(e % 3 + 2), 7))
    no = _pairs((tenth(e % 4 + 1), 6), (tenth(e % 4 + 3), 4))
    body = F.concat(
        F.lit('{"market_ticker":"'), F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string")),
        F.lit('","orderbook_fp":{"yes_dollars":'), F.when(e % 5 == 0, F.lit("null")).otherwise(yes),
        F.lit(',"no_dollars":'), no, F.lit("}}"),
    )
    return v_events(spark, sf_dir).select("event_id", body.alias("payload"))


def v_bid_offer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid/offer books; prices as objects or scalars, some books empty."""
    e = F.col("event_id")
    cents = lambda c: (c / F.lit(100)).cast("decimal(6,2)").cast("string")
    bid = F.when(
        e % 2 == 0, F.concat(F.lit('{"px":{"value":"'), cents(e % 40 + 10), F.lit('"},"qty":"3"}'))
    ).otherwise(F.concat(F.lit('{"px":"'), cents(e % 40 + 10), F.lit('","qty":"3"}')))
    offer = F.concat(
        F.lit('{"px":{"value":"'), cents(e % 30 + 45), F.lit('"},"qty":"'), (e % 7 + 1).cast("string"),
        F.lit('"}'),
    )
    full = F.concat(F.lit('"bids":['), bid, F.lit('],"offers":['), offer, F.lit("]"))
    state = F.when(e % 6 == 0, "HALTED").otherwise("OPEN")
    body = F.concat(
        F.lit('{"marketData":{"marketSlug":"slug-'), (F.col("user_id") % 10).cast("string"),
        F.lit('","state":"'), state, F.lit('",'),
        F.when(e % 11 == 0, F.lit('"bids":[],"offers":null')).otherwise(full), F.lit("}}"),
    )
    return v_events(spark, sf_dir).select("event_id", body.alias("payload"), state.alias("state"))


def v_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: explicit fills, one instrument per user."""
    return v_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.when(F.col("event_type").isin("purchase", "click", "signup"), "buy").otherwise("sell").alias("side"),
        (F.col("event_id") % 99 + 1).cast("decimal(10,2)").alias("_cents"),
        qty2(F.floor(F.col("value") / 10) + 1).alias("quantity"),
        F.col("event_id").alias("ord"),
        "ts",
    ).select(
        "instrument_id", "side",
        (F.col("_cents") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE).alias("price"),
        "quantity", F.lit("0.01").cast(PRICE).alias("fee"), "ord", "ts",
    )


def v_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: proposals from orders, fills and settlements from lineitem."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 97 != 0)
    key = F.col("o_orderkey").cast("string")
    empty = lambda kind: F.lit(None).cast(kind)
    proposals = orders.select(
        F.lit("paper_complement_order_proposal").alias("record_type"),
        key.alias("proposal_id"),
        F.sha2(key, 256).alias("candidate_hash"),
        F.sha2(F.concat(F.lit("s"), key), 256).alias("simulation_hash"),
        empty("string").alias("side"),
        empty(PRICE).alias("price"),
        empty(QTY).alias("quantity"),
        empty(PRICE).alias("fee"),
        empty(PRICE).alias("payout_per_contract"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("day"),
        F.concat(F.lit("!"), key).alias("event_key"),
    )
    li = table(spark, sf_dir, "lineitem")
    proposal = F.col("l_orderkey").cast("string")
    fill = F.col("l_returnflag") != "R"
    bad_candidate = F.col("l_partkey") % 50 == 0
    bad_simulation = F.col("l_suppkey") % 40 == 7
    rows = li.select(
        F.when(fill, "paper_fill").otherwise("paper_settlement").alias("record_type"),
        proposal.alias("proposal_id"),
        F.when(fill, F.sha2(F.concat(F.when(bad_candidate, "x").otherwise(""), proposal), 256)).alias(
            "candidate_hash"
        ),
        F.when(
            fill, F.sha2(F.concat(F.when(bad_simulation, "x").otherwise("s"), proposal), 256)
        ).alias("simulation_hash"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("side"),
        F.when(fill, (F.lit("0.3").cast(PRICE) + price4(F.col("l_discount"))).cast(PRICE)).alias("price"),
        qty2(F.when(fill, F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") / 4))).alias("quantity"),
        F.when(fill, price4(F.col("l_tax"))).alias("fee"),
        F.when(~fill, F.when(F.col("l_discount") > 0.05, 1).otherwise(0).cast(PRICE)).alias(
            "payout_per_contract"
        ),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"),
        line_key().alias("event_key"),
    )
    return proposals.unionByName(rows)


def _order_id() -> Column:
    return F.concat_ws("-", F.lit("O"), F.col("user_id").cast("string"), F.col("block").cast("string"))


def demo_events(ev: DataFrame) -> DataFrame:
    """Demo order events of a table or stream of events with their block."""
    e = F.col("event_id")
    audit, order_id = F.concat(F.lit("A-"), F.col("block").cast("string")), _order_id()
    ident = F.when(e % 10 < 4, F.concat(F.lit("D-"), F.floor(e / 2).cast("string"))).otherwise(
        F.concat(F.lit("E-"), e.cast("string"))
    )
    kind = (
        F.when(F.col("event_type") == "signup", "accepted")
        .when(F.col("event_type") == "click", "partial_fill")
        .when(F.col("event_type") == "purchase", "full_fill")
        .when(
            F.col("event_type") == "view",
            F.when(e % 3 == 0, "cancel").when(e % 3 == 1, "rejected").otherwise("timeout"),
        )
        .when(e % 4 == 0, "error")
        .otherwise("backfill")
    )
    return ev.select(
        audit.alias("audit_id"),
        e.alias("ord"),
        ident.alias("event_id"),
        F.sha2(F.concat(ident, (F.col("user_id") % 2).cast("string")), 256).alias("event_hash"),
        kind.alias("event_type"),
        F.when(kind == "backfill", "partial_fill").alias("resolved_event_type"),
        F.concat(F.when(e % 41 == 0, "X-").otherwise("P-"), F.col("block").cast("string")).alias("proposal_id"),
        F.sha2(F.col("block").cast("string"), 256).alias("candidate_hash"),
        F.concat(F.when(e % 43 == 0, "NO-").otherwise("APP-"), F.col("block").cast("string")).alias("approval_id"),
        order_id.alias("client_order_id"),
        ((e % 99 + 1).cast("decimal(10,2)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE).alias("price"),
        (e % 10 + 1).cast(QTY).alias("quantity"),
        "ts",
    )


def v_demo_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """V8: (audited orders, demo events) with repeated and conflicting event ids."""
    ev = v_events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 500))
    audit, order_id = F.concat(F.lit("A-"), F.col("block").cast("string")), _order_id()
    audits = ev.where(F.col("user_id") % 13 != 0).groupBy("user_id", "block").agg(F.lit(1).alias("_one")).select(
        audit.alias("audit_id"),
        F.concat(F.lit("P-"), F.col("block").cast("string")).alias("proposal_id"),
        F.sha2(F.col("block").cast("string"), 256).alias("candidate_hash"),
        F.concat(F.lit("APP-"), F.col("block").cast("string")).alias("approval_id"),
        F.when(F.col("block") % 2 == 0, "submitted").otherwise("dry_run").alias("status"),
        order_id.alias("client_order_id"),
        F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("side"),
        F.lit("20").cast(QTY).alias("submitted_quantity"),
    )
    return audits, demo_events(ev)


def v_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: mixed report records, one per order."""
    o = table(spark, sf_dir, "orders")
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 8
    names = (
        "offline_complement_research_candidate", "recorder_status", "paper_ledger_state",
        "offline_taker_fill_simulation", "manual_approval_decision", "demo_outcome",
        "kalshi_demo_submission_preview", "kalshi_demo_reconciliation_state",
    )
    record_type = F.element_at(F.array(*[F.lit(n) for n in names]), (kind + 1).cast("int"))
    total = "decimal(38,18)"
    money = F.col("o_totalprice").cast("decimal(14,2)")
    pnl = ((money - 250_000) * F.lit("0.001").cast("decimal(4,3)")).cast(total)
    on = lambda n, c: F.when(kind == n, c)
    decision = (
        F.when(F.col("o_orderstatus") == "F", "paper_candidate")
        .when(F.col("o_orderstatus") == "O", "audit_only")
        .otherwise("reject")
    )
    return o.select(
        k.alias("ord"),
        record_type.alias("record_type"),
        F.when(k % 53 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("report_date"),
        on(0, decision).alias("decision"),
        on(0, F.lit("0.02").cast(PRICE)).alias("gross_edge_per_contract"),
        on(0, (k % 50).cast(QTY)).alias("candidate_size"),
        on(0, ((k % 50) * F.lit("0.01").cast("decimal(3,2)")).cast(total)).alias("total_estimated_net_edge"),
        on(0, F.when(k % 3 == 0, F.array(F.lit("no_complement_edge"), F.lit("not_paper_candidate"))).otherwise(
            F.array(F.lit("not_paper_candidate"))
        )).alias("rejection_reasons"),
        on(1, F.col("o_orderstatus") != "P").alias("up"),
        on(1, (F.col("o_custkey") % 100).cast(total)).alias("data_lag_seconds"),
        on(1, k % 3).alias("gap_count"),
        F.when(k % 29 == 0, F.array(F.lit("data_gap")))
        .when((kind == 3) & (k % 2 == 1), F.array(F.lit("slippage_applied")))
        .otherwise(F.array().cast("array<string>"))
        .alias("flags"),
        on(2, (k % 7).cast(total)).alias("total_fees"),
        on(2, (k % 5 == 0).cast("bigint")).alias("reconciliation_mismatch_count"),
        on(2, pnl).alias("realized_net_pnl"),
        on(3, (k % 4).cast(QTY)).alias("failed_leg_quantity"),
        on(3, ((k % 9) * F.lit("0.1").cast("decimal(2,1)")).cast(total)).alias("simulated_total_net_edge"),
        on(4, F.when(k % 11 == 0, F.array(F.lit("kill_switch_active"))).otherwise(
            F.array(F.lit("manual_approval_verified"))
        )).alias("reasons"),
        on(5, (-pnl * F.lit("0.5").cast("decimal(2,1)")).cast(total)).alias("demo_pnl"),
        on(6, F.col("o_custkey") % 2 == 0).alias("dry_run"),
        on(6, F.lit(2).cast("bigint")).alias("request_preview_count"),
        on(7, k % 3).alias("order_count"),
        on(7, k % 2).alias("full_fill_count"),
        on(7, (k % 3 == 1).cast("bigint")).alias("partial_fill_count"),
        on(7, (k % 10 == 7).cast("bigint")).alias("mismatch_count"),
        F.when(k % 101 == 0, True).alias("false_positive_style_rejection"),
    )


def v_connection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: connection evidence; a run per user, a connection per user and day."""
    user, day = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    kind = (
        F.when(F.col("event_type") == "signup", "CONNECTION_OPEN")
        .when(F.col("event_type") == "click", "RECONNECT")
        .when(F.col("event_type") == "purchase", "CONNECTION_CLOSE")
        .when(F.col("event_type") == "error", "CONNECTION_ERROR")
        .otherwise("SUBSCRIPTION_ACKNOWLEDGED")
    )
    return v_events(spark, sf_dir).select(
        F.concat(F.lit("R-"), user).alias("run_id"),
        F.concat_ws("-", F.lit("C"), user, day).alias("connection_id"),
        F.concat(F.lit("S-"), (F.col("event_id") % 3).cast("string")).alias("segment_id"),
        kind.alias("event_type"),
        F.col("ts").alias("observed_at"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("source_type"),
    )


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user over the days the user was seen."""
    return v_events(spark, sf_dir).groupBy("user_id").agg(
        F.date_trunc("day", F.min("ts")).alias("started_at"),
        (F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 1 DAY")).alias("ended_at"),
    ).select(F.concat(F.lit("R-"), F.col("user_id").cast("string")).alias("run_id"), "started_at", "ended_at")


def v_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("source_type") == "error", "keepalive")
        .when(F.col("source_type") == "view", "lifecycle")
        .otherwise("orderbook")
    )
    return v_connection_events(spark, sf_dir).select("run_id", kind.alias("kind"), "observed_at")


def v_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: market metadata from part, with every kind of defect."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    base = F.lit("2026-08-01T00:00:00+00:00").cast("timestamp")

    def at(seconds: Column) -> Column:
        moment = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
        return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    ident = F.concat(F.when(k % 41 == 0, "MKT ").otherwise("MKT-"), k.cast("string"))
    words = ("active", "open", "open", "trading", "closed", "inactive", "", "odd", "open")
    close = F.col("p_size") * 600
    return p.select(
        k.alias("ord"),
        ident.alias("ticker"),
        F.when(k % 43 == 0, F.lit("OTHER")).when(k % 2 == 0, ident).alias("market_ticker"),
        F.when(k % 47 != 0, F.concat(F.lit("EV-"), F.regexp_extract("p_brand", "([0-9]+)", 1))).alias(
            "event_ticker"
        ),
        F.element_at(F.array(*[F.lit(w) for w in words]), (k % 9 + 1).cast("int")).alias("status"),
        F.concat(F.col("p_name"), F.when(k % 17 == 0, " Match!").otherwise("")).alias("title"),
        F.lit("binary").alias("market_type"),
        F.when(k % 23 == 0, F.lit("2026-08-01T05:00:00")).otherwise(at(close)).alias("close_time"),
        F.when(k % 13 != 0, at(close + 7200)).alias("expected_expiration_time"),
        F.element_at(F.array(F.lit("true"), F.lit("no"), F.lit(" FALSE "), F.lit("maybe")), (k % 4 + 1).cast("int")).alias(
            "can_close_early"
        ),
        F.when(k % 8 == 0, at(F.lit(14_400))).alias("early_close_deadline"),
        (k % 16 == 0).alias("early_close_deadline_authoritative"),
        F.when(k % 5 == 0, at(close)).when(k % 5 == 1, at(F.lit(-3600))).when(k % 5 == 2, "soon").alias(
            "occurrence_datetime"
        ),
        F.when(k % 7 == 0, "n/a").when(k % 3 == 0, "0").otherwise(
            F.col("p_retailprice").cast("decimal(14,2)").cast("string")
        ).alias("volume_24h_fp"),
        F.when(k % 6 == 0, "12.5").otherwise("0").alias("yes_bid_size_fp"),
        (F.col("p_size") % 5).cast("bigint").alias("orderbook_level_count"),
    )


def v_market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of V7: nations as events, regions as categories, later copies win."""
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    category = F.when(F.col("r_regionkey") == 0, "Sports").otherwise(F.concat(F.lit("Topic "), "r_name"))
    return s.select(
        F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("EV-"), F.col("n_nationkey").cast("string")).alias("event_ticker"),
        category.alias("category"),
        F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.col("n_name"), F.lit(" outcome "), F.col("s_suppkey").cast("string"))).alias(
            "title"
        ),
        F.lit("sub").alias("sub_title"),
        F.array(
            F.struct(
                F.concat(F.lit("EV-"), F.when(F.col("s_suppkey") % 10 == 3, F.lit(99)).otherwise(F.col("n_nationkey")).cast("string")).alias(
                    "event_ticker"
                ),
                F.concat(F.lit("MKT-"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.lit(None).cast("string").alias("market_ticker"),
            )
        ).alias("markets"),
    )


REQUESTED_MARKETS = ("M-0", "M-1")


def v_transport(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, requests, connections) of recorded campaigns with faults of every kind."""
    e = F.col("event_id")
    slot, block = e % 50, F.floor(e / 50) * 50
    ev = v_events(spark, sf_dir).select(
        "*",
        F.concat(F.lit("camp-"), F.floor(e / 1000).cast("string")).alias("campaign_id"),
        (F.floor((e % 1000) / 250) + 1).alias("connection_epoch"),
    )
    requests = ev.where(slot.isin(0, 1)).select(
        "campaign_id", "connection_epoch", e.alias("ord"),
        F.when(slot == 0, "orderbook_delta").otherwise("trade").alias("channel"),
        (e + 1).alias("command_id"),
    )
    connections = ev.groupBy("campaign_id", "connection_epoch").agg(F.min(e).alias("_first")).drop("_first")
    kind = (
        F.when(slot.isin(3, 4, 23), "subscribed")
        .when(slot == 33, "error")
        .when(F.col("event_type") == "signup", "orderbook_snapshot")
        .when(F.col("event_type") == "purchase", "trade")
        .when(e % 67 == 0, "heartbeat")
        .otherwise("orderbook_delta")
    )
    channel = F.when(slot.isin(3, 23), "orderbook_delta").when(slot == 4, "trade")
    answered = F.when(slot == 4, block + 2).otherwise(block + 1)
    request = F.when(slot.isin(3, 4, 23), answered).when(
        slot == 33, F.when(block % 200 == 0, block + 1).otherwise(block + 40)
    )
    sid = F.when((slot == 23) & (block % 150 == 0), 9).when(e % 71 == 0, 8).when(e % 73 != 0, 7)
    seq = e + F.when(e % 29 == 0, 1).when(e % 31 == 0, -1).otherwise(0)
    number = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c.cast("string"))).otherwise("")
    text = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":"'), c, F.lit('"'))).otherwise("")
    market = F.when(e % 59 != 0, F.concat(F.lit("M-"), (F.col("user_id") % 3).cast("string")))
    top = F.concat(
        F.lit('{"type":"'), kind, F.lit('"'), text("channel", channel), number("id", request),
        number("sid", sid), number("seq", F.when(e % 61 != 0, seq)),
    )
    inner = F.concat(F.lit(',"msg":{"k":1'), text("market_ticker", market), text("trade_id", F.when(e % 83 != 0, F.concat(F.lit("T"), e.cast("string")))), F.lit("}}"))
    messages = dealt(ev.where(~slot.isin(0, 1)), "event_id").select(
        "campaign_id", "connection_epoch", e.alias("ord"), F.col("ts").alias("received_at"),
        F.concat(top, inner).alias("payload"),
    )
    return messages, requests, connections


def v_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of V_transport with envelope, market and sequence columns."""
    from paritymill.operators.native import native_envelope, native_scalar

    messages, _, _ = v_transport(spark, sf_dir)
    p = F.col("payload")
    return native_envelope(messages).withColumns(
        {
            "market_ticker": native_scalar(p, "market_ticker", kinds=("STRING",)),
            "seq": native_scalar(p, "seq"),
            "seq_is_int": native_scalar(p, "seq", kinds=("BIGINT",)).isNotNull(),
            "trade_id": native_scalar(p, "trade_id"),
        }
    )


def v_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native rows as the sequence automaton reads them."""
    from paritymill.operators.admission import bind_rows, prepare_rows

    _, requests, _ = v_transport(spark, sf_dir)
    chunk = chunk_of(F.col("ord"), CHUNK_ROWS)
    return prepare_rows(bind_rows(v_native(spark, sf_dir), requests, chunk), requests, REQUESTED_MARKETS, chunk)[0]


def v_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritymill.operators.admission import admit_rows

    _, requests, connections = v_transport(spark, sf_dir)
    return admit_rows(
        v_native(spark, sf_dir), requests, connections, REQUESTED_MARKETS,
        chunk_of(F.col("ord"), CHUNK_ROWS), contiguous=True,
    )


def pick(index: Column, *words: str | None) -> Column:
    """Word number ``index`` of a fixed list."""
    return F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (index + 1).cast("int"))


RECORDED_STATES = (
    "SEQUENCE_CONTIGUITY_VERIFIED", "SEQUENCE_OBSERVED_MONOTONIC", "SEQUENCE_NOT_OBSERVED",
    "SEQUENCE_PRESENT_SEMANTICS_UNKNOWN",
)


def v_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded native rows with states already assigned."""
    e = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "signup", "orderbook_snapshot")
        .when(F.col("event_type") == "purchase", "trade")
        .when(F.col("event_type") == "error", pick(e % 3, "subscribed", "error", "heartbeat"))
        .otherwise("orderbook_delta")
    )
    segment = F.floor(e / 40)
    state = F.when(
        (segment % 5 == 0) & (e % 11 == 0), pick(e % 2, "SEQUENCE_GAP_DETECTED", "SEQUENCE_DUPLICATE")
    ).when(segment % 5 == 1, pick(e % 2 + 2, *RECORDED_STATES)).otherwise(pick(e % 4, *RECORDED_STATES))
    return v_events(spark, sf_dir).select(
        e.alias("row_index"),
        F.concat(F.lit("conn-"), (segment % 7).cast("string")).alias("connection_id"),
        F.concat(F.lit("seg-"), segment.cast("string")).alias("segment_id"),
        pick(segment % 3, "INITIAL_CONNECTION", "RESUBSCRIPTION", "INTEGRITY_FAILURE").alias(
            "segment_boundary_reason"
        ),
        kind.alias("native_type"),
        F.when(kind == "trade", "trade").when(kind.isin("subscribed", "error", "heartbeat"), kind).otherwise(
            "orderbook_delta"
        ).alias("channel"),
        F.when(e % 13 != 0, (e % 3 + 7).cast("string")).alias("sid"),
        F.when(e % 17 != 0, e.cast("string")).alias("seq"),
        state.alias("sequence_state"),
        pick(e % 5, "ADMITTED", "EXCLUDED", "ADMITTED", "NOT_APPLICABLE", "ADMITTED").alias("admission_status"),
        F.when(e % 5 == 1, "SEQUENCE_GAP").alias("exclusion_reason"),
        F.when(e % 19 != 0, F.floor(e / 400) + 1).alias("generation"),
        F.when(e % 19 != 0, F.floor(e / 200) + 1).alias("command_id"),
        F.when(e % 19 != 0, F.concat(F.lit("b-"), F.floor(e / 400).cast("string"))).alias("binding_id"),
        pick(e % 3, "ACKNOWLEDGED", "REQUESTED", "CONFLICTED").alias("binding_state"),
        F.when(e % 23 != 0, F.concat(F.lit("M-"), (F.col("user_id") % 10).cast("string"))).alias("market_ticker"),
        (F.col("user_id") % 10 != 9).alias("requested_market"),
        F.when(e % 29 != 0, F.concat(F.lit("T"), e.cast("string"))).alias("trade_id"),
        (e % 31 == 0).alias("private_payload"),
        (e % 37 == 0).alias("parse_failed"),
    )


def v_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign summaries, one per order, over every class of outcome."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("campaign"),
        pick(k % 5, "REST", "WEBSOCKET_DELTA", "WEBSOCKET_SNAPSHOT", "SYNTHETIC", "OTHER").alias("source_type"),
        pick(k % 6, "recorder_smoke_complete", "websocket_campaign_complete", "websocket_smoke_complete",
             "websocket_blocked", "smoke_complete", "websocket_auth_blocked").alias("status"),
        pick(k % 3, "read_only_websocket_campaign", "read_only_websocket_campaign", "smoke").alias("mode"),
        F.when(k % 31 == 0, "enabled").otherwise("disabled").alias("live_gate_status"),
        (k % 37 == 0).alias("production_endpoint_used"),
        (k % 41 == 0).cast("bigint").alias("submit_attempt_count"),
        pick(k % 4, "600", "1200", "604800", "1800").cast("bigint").alias("duration_seconds"),
        F.when(k % 7 != 0, k % 4).alias("heartbeat_count"),
        (k % 43 == 0).cast("bigint").alias("bad_heartbeat_count"),
        (k % 5).alias("recorder_event_count"),
        (k % 4).alias("rebuild_frame_count"),
        (k % 3).alias("daily_validation_count"),
        (k % 47 == 0).alias("secret_like"),
        F.when(k % 2 == 0, k % 6).alias("event_count"),
        (k % 3).alias("delta_count"),
        (k % 4).alias("snapshot_count"),
        (k % 8 != 0).alias("subscription_acknowledged"),
        F.when(k % 53 == 0, "NO_WS_CREDENTIALS").when(k % 59 == 0, "AUTH_SIGNATURE_FAILED").when(
            k % 9 == 0, "DEMO_NO_ELIGIBLE_MARKET"
        ).alias("blocker_code"),
        pick(k % 11, "open", "open", "closed", "open", "paused", "open", "settled", "open", "open", "open", None).alias(
            "market_status"
        ),
        F.when(k % 13 != 0, "pass").otherwise("reject").alias("selection_gate_result"),
    )


def v_phase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed runs with their evidence, one per order; most gates hold for most runs."""
    k = F.col("o_orderkey")
    grade = lambda n: F.when(k % n == 0, "FAIL").when(k % (n + 4) == 0, "UNKNOWN").otherwise("PASS")
    return table(spark, sf_dir, "orders").select(
        k.alias("run"),
        F.when(k % 17 != 0, "bounded_duration_complete").otherwise("error").alias("terminal_reason"),
        (k % 19 == 0).alias("stop_requested"),
        F.lit(1800).cast("bigint").alias("configured_seconds"),
        F.when(k % 13 == 0, 1799).otherwise(1801).cast("bigint").alias("actual_seconds"),
        (k % 23 != 0).alias("connection_established"),
        (k % 29 != 0).alias("subscription_acknowledged"),
        (k % 3).alias("admitted_snapshot_count"),
        (k % 4).alias("admitted_delta_count"),
        (k % 7).alias("segment_count"),
        (k % 31 == 0).cast("bigint").alias("open_segment_count"),
        (k % 5).alias("sequence_segment_count"),
        (k % 11 == 0).cast("bigint").alias("failed_sequence_count"),
        (k % 6).alias("framed_book_count"),
        (k % 10 == 0).cast("bigint").alias("unsound_book_count"),
        grade(21).alias("duration_evidence"), grade(22).alias("transport_connectivity"),
        grade(26).alias("subscription_status"), grade(27).alias("market_lifecycle_validity"),
        grade(8).alias("sequence_integrity"), grade(9).alias("rebuild_integrity"),
        grade(33).alias("artifact_integrity"),
        F.when(k % 25 == 0, "fail").otherwise("pass").alias("validation_status"),
        F.lit("disabled").alias("live_gate_status"),
        F.lit(False).alias("production_trading_enabled"),
        F.lit(False).alias("executable_order_intent"),
        (k % 71 == 0).alias("production_endpoint_used"),
        F.lit(0).cast("bigint").alias("submit_attempts"),
    )


def v_dimension_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run aggregates of V9: windows, gaps and waits of every user's run."""
    from paritymill.operators import connections as C

    events, runs = v_connection_events(spark, sf_dir), v_runs(spark, sf_dir)
    windows = C.connection_windows(events, runs)
    cover = C.coverage(windows, C.disconnect_gaps(windows, runs), runs)
    waits = C.max_quiet_gap(v_observations(spark, sf_dir), runs, 86_400)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    per = waits.groupBy("run_id").agg(
        of("keepalive", "max_gap_seconds").alias("max_keepalive_seconds"),
        of("lifecycle", "max_gap_seconds").alias("max_lifecycle_seconds"),
        F.coalesce(of("lifecycle", "observation_count"), F.lit(0)).alias("lifecycle_count"),
    )
    opened = windows.groupBy("run_id").agg(F.count("opened_at").alias("opened_count"))
    number = F.regexp_extract("run_id", "([0-9]+)", 1).cast("bigint")
    return cover.join(per, "run_id").join(opened, "run_id").select(
        "run_id", "opened_count", "coverage", "max_gap_seconds", "max_keepalive_seconds",
        "lifecycle_count", (number % 9 == 0).alias("lifecycle_invalid"),
        "max_lifecycle_seconds", (number % 4 != 0).alias("all_acknowledged"),
        (number % 10 == 1).alias("any_rejected"), (number % 6 == 5).cast("bigint").alias("binding_failure_count"),
        pick(number % 3, "PASS", "UNKNOWN", "FAIL").alias("sequence_integrity"),
        pick(number % 2, "PASS", "UNKNOWN").alias("rebuild_integrity"),
        "actual_seconds", F.lit(20 * 86_400).cast("bigint").alias("configured_seconds"),
        (number % 5 != 0).alias("ended"), (number % 7 != 0).alias("completed"),
    )


def v_monitor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed monitor records, one per order, twenty-five runs."""
    k = F.col("o_orderkey")
    kind = pick(
        k % 7, "offline_complement_research_candidate", "complement_risk_decision_v2", "paper_ledger_state",
        "open_order", "paper_complement_order_proposal", "live_market_data_event", "offline_taker_fill_simulation",
    )
    on = lambda n, c: F.when(k % 7 == n, c)
    total = "decimal(38,18)"
    return table(spark, sf_dir, "orders").select(
        k.alias("ord"),
        F.concat(F.lit("run-"), (F.col("o_custkey") % 25).cast("string")).alias("run_id"),
        kind.alias("record_type"),
        F.lit("kalshi_demo").alias("venue"),
        F.concat(F.lit("M-"), (k % 40).cast("string")).alias("market_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.when(k % 7 == 5, "book").alias("event_type"),
        F.when(k % 30 == 0, F.array(F.lit("stale_book"))).when(k % 21 == 5, F.array(F.lit("sequence_gap"))).alias(
            "data_quality_flags"
        ),
        on(0, F.when(k % 2 == 0, F.lit("0.02")).otherwise("0").cast(total)).alias("gross_edge_per_contract"),
        on(0, F.lit("0.03").cast(total)).alias("gross_edge"),
        on(0, (k % 9).cast(total)).alias("candidate_size"),
        F.when(k % 7 == 1, F.when(F.col("o_orderstatus") == "F", "reject").otherwise("manual_review_required")).when(
            k % 7 == 0, "audit_only"
        ).alias("decision"),
        on(1, F.when(k % 4 == 0, F.array(F.lit("manual_approval_required"), F.lit("stale_data"))).otherwise(
            F.array(F.lit("manual_approval_required"))
        )).alias("reasons"),
        on(2, (k % 50 == 2).cast("bigint")).alias("reconciliation_mismatch_count"),
        F.when((k % 7 == 3) & (k % 5 != 0), F.concat(F.lit("O-"), F.floor(k / 70).cast("string"))).alias("order_id"),
        on(4, F.concat(F.lit("P-"), F.floor(k / 35).cast("string"))).alias("proposal_id"),
        F.when((k % 7).isin(3, 4), ((k % 99 + 1) * F.lit("0.01").cast("decimal(3,2)")).cast(total)).alias("price"),
        F.when((k % 7).isin(3, 4), (k % 8).cast(total)).alias("quantity"),
    )


def v_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order of every run as its venue row."""
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("r")).agg(
        F.max("o_orderdate").cast("timestamp").alias("last_event_ts"), F.count(F.lit(1)).alias("gap_count")
    ).select(
        F.concat(F.lit("run-"), F.col("r").cast("string")).alias("run_id"),
        F.lit("kalshi_demo").alias("venue"),
        F.lit("").alias("mode"), F.lit(None).cast("string").alias("connectivity"), "last_event_ts",
        F.when(F.col("r") % 3 == 0, F.lit(30)).cast("bigint").alias("data_staleness_seconds"),
        "gap_count", F.lit(None).cast("bigint").alias("warning_count"),
    )


def v_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes per user and side; sizes change now and then."""
    e = F.col("event_id")
    return v_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.when(e % 2 == 0, "buy").otherwise("sell").alias("side"),
        e.alias("ord"),
        (F.lit("0.40").cast("decimal(4,2)") + (F.floor("value") % 8).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast(PRICE)
        .alias("price"),
        F.when(e % 50 < 5, 2).otherwise(1).cast(QTY).alias("quantity"),
    )


def v_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical evidence lines, a thousand per segment, with a few flaws."""
    e = F.col("event_id")
    index = e % 1000 + F.when(e % 2501 == 2500, 2).otherwise(1)
    gap = F.when(e % 3407 == 3406, " ").otherwise("")
    line = F.concat(
        F.lit('{"event_id":'), gap, e.cast("string"), F.lit(',"kind":"'), F.col("event_type"),
        F.lit('","local_row_index":'), index.cast("string"), F.lit("}"),
    )
    return v_events(spark, sf_dir).select(
        F.concat(F.lit("segment-"), F.floor(e / 1000).cast("string")).alias("segment_id"), e.alias("ord"),
        line.alias("record"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "k": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")}
    )
