"""Worked numbers of candidates, stress, risk, quotes and selection screens."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from paritymill.operators import controls, parity, quotes
from paritymill.plans.queries import queries

BOOK = (
    "venue string, market_id string, best_yes_bid decimal(20,18), best_no_bid decimal(20,18), "
    "yes_bid_size decimal(17,8), no_bid_size decimal(17,8), fee_status string, fee_per_contract decimal(20,18), "
    "stale_book boolean, minimum_net_edge_per_contract decimal(20,18)"
)


def candidate(spark, yes, no, ys="10", ns="8", status="supplied", fee="0.01", stale=False, least="0"):
    row = ("v", "m", D(yes), D(no), D(ys), D(ns), status, None if fee is None else D(fee), stale, D(least))
    return parity.complement_candidates(spark.createDataFrame([row], BOOK)).first()


def test_candidate_edges_and_decision(spark):
    r = candidate(spark, "0.52", "0.51")
    assert (r.yes_ask, r.no_ask) == (D("0.49"), D("0.48"))
    assert r.gross_edge_per_contract == D("0.03") and r.net_edge_per_contract == D("0.02")
    assert r.candidate_size == 8 and r.total_estimated_net_edge == D("0.16")
    assert r.decision == "paper_candidate" and r.rejection_reasons == []
    assert r.flags == ["manual_review_required", "crossed_book"]


def test_candidate_boundaries(spark):
    assert candidate(spark, "0.50", "0.50").flags[-1] == "locked_book"
    assert candidate(spark, "0.50", "0.50").decision == "reject"
    assert candidate(spark, "0.52", "0.51", least="0.02").decision == "reject"  # not strictly greater
    assert candidate(spark, "0.52", "0.51", stale=True).decision == "audit_only"
    missing = candidate(spark, "0.52", "0.51", status="missing", fee=None)
    assert missing.decision == "audit_only" and "missing_fee_model" in missing.rejection_reasons
    assert candidate(spark, "0.52", "0.51", ns="0").rejection_reasons == ["fee_adjustment", "insufficient_depth"]
    broken = candidate(spark, "1.20", "0.51", fee=None)
    assert broken.decision is None
    assert broken.errors == ["best_yes_bid_out_of_range", "supplied_fee_without_value"]


def test_eighteen_decimals_stay_exact(spark):
    r = candidate(spark, "0.500000000000000003", "0.500000000000000000", ys="2", ns="2", fee="0")
    assert r.total_estimated_net_edge == D("0.000000000000000006")


def test_fill_or_kill_and_partial(spark):
    row = ("v", "m", D("0.52"), D("0.51"), D("10"), D("8"), "supplied", D("0.01"), False, D("0"))
    cand = parity.complement_candidates(spark.createDataFrame([row], BOOK))
    out = {
        r.scenario: r
        for r in parity.fill_stress(
            cand,
            [
                {"name": "kill", "policy": "fok", "target_size": "9"},
                {"name": "part", "policy": "ioc", "target_size": "9", "failed_leg_reserve_per_contract": "0.005"},
            ],
        ).collect()
    }
    assert out["kill"].completed_pair_size == 0 and "blocked_by_fok_depth" in out["kill"].fill_flags
    assert (out["part"].completed_pair_size, out["part"].failed_leg_quantity) == (8, 1)
    assert out["part"].failed_leg_reserve_total == D("0.005")
    assert "partial_fill" in out["part"].fill_flags


def test_risk_reasons_are_ordered(spark):
    df = spark.createDataFrame(
        [("p", "h", ["stale_book", "sequence_gap"], "unknown", D("0"), D("0.1"), D("5"), D("4"), 3, 2, D("1"), D("1"), 0, True)],
        "proposal_id string, candidate_hash string, data_quality_flags array<string>, fee_status string, "
        "net_edge_per_contract decimal(20,18), minimum_net_edge_per_contract decimal(20,18), "
        "projected_exposure decimal(17,8), max_exposure decimal(17,8), open_order_count bigint, max_open_orders bigint, "
        "daily_loss decimal(17,8), max_daily_loss decimal(17,8), reconciliation_mismatch_count bigint, kill_switch_active boolean",
    )
    r = controls.risk_decisions(df).first()
    assert r.decision == "reject"
    assert r.reasons == [
        "manual_approval_required", "stale_data", "data_gap", "unknown_fee_model", "insufficient_net_edge",
        "exposure_limit_breach", "open_order_limit_breach", "kill_switch_active",
    ]


def test_fair_value_one_sided_and_empty(spark):
    df = spark.createDataFrame(
        [(D("0.4"), D("0.5")), (D("0.995"), None), (None, D("0.005")), (None, None)],
        "best_bid decimal(20,18), best_ask decimal(20,18)",
    )
    got = [r.fair_value for r in quotes.fair_value(df).collect()]
    assert got == [D("0.45"), D("1"), D("0"), None]


def test_quote_bands_never_round_across_a_tick(spark):
    df = spark.createDataFrame(
        [(D("0.123499999999999999"), D("0.143499999999999999"), D("0"))],
        "best_bid decimal(20,18), best_ask decimal(20,18), inventory decimal(17,8)",
    )
    r = quotes.quote_bands(df).first()
    assert (r.bid_price, r.ask_price) == (D("0.1234"), D("0.1435"))


def test_hysteresis_matches_loop(spark):
    import random

    rng = random.Random(5)
    data, ordinal = [], 0
    for _ in range(400):
        ordinal += 1
        data.append((rng.choice(["a", "hot", "hot"]), rng.choice(["buy", "sell"]), ordinal,
                     D(rng.randint(40, 47)) / 100, D(1 if rng.random() < 0.9 else 2)))
    df = spark.createDataFrame(data, "instrument_id string, side string, ord bigint, price decimal(20,18), quantity decimal(17,8)")
    out = quotes.quote_hysteresis(df, "0.02", F.floor(F.col("ord") / 16).cast("bigint"))
    got = {r.ord: (r.action, r.accepted_price) for r in out.collect()}
    held = {}
    for inst, side, o, price, qty in data:
        old = held.get((inst, side))
        action = "place" if old is None else "replace" if old[1] != qty or abs(old[0] - price) >= D("0.02") else "hold"
        if action != "hold":
            held[(inst, side)] = (price, qty)
        assert got[o] == (action, held[(inst, side)][0]), o


def test_single_open_slot_blocks_the_second_side(spark):
    df = spark.createDataFrame(
        [("a", "buy", 1, D("0.4"), D("1")), ("a", "sell", 2, D("0.6"), D("1")), ("a", "sell", 3, D("0.7"), D("1"))],
        "instrument_id string, side string, ord bigint, price decimal(20,18), quantity decimal(17,8)",
    )
    out = quotes.quote_hysteresis(df, "0.01", F.lit(0), max_open=1)
    got = {r.ord: (r.action, r.result_status) for r in out.collect()}
    assert got == {1: ("place", "accepted"), 2: ("place", "skipped"), 3: ("place", "skipped")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenarios_multiply_candidates_behind_their_shuffle(spark):
    plan = plan_of(queries()["fill_stress"](spark, "/root/testdata/sf0.001"))
    below = plan[plan.index("Generate explode"):]
    assert "Exchange hashpartitioning(market_id" in below
