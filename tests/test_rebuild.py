"""Book rebuild against a row-by-row ladder, in small chunks."""

from __future__ import annotations

import json
import random
from decimal import Decimal as D


from paritymill.operators import rebuild as R

SCHEMA = (
    "row_index bigint, market_ticker string, connection_id string, segment_id string, native_type string, payload string"
)


def messages(seed, n=220):
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        market = "hot" if rng.random() < 0.7 else "cold"
        roll = rng.random()
        if roll < 0.12:
            msg = {}
            for side in ("yes", "no"):
                if rng.random() < 0.85:
                    prices = rng.sample(range(1, 8), 3)
                    if rng.random() < 0.08:
                        prices[1] = prices[0]
                    msg[f"{side}_dollars_fp"] = [[f"0.{p}", str(rng.randint(0, 6))] for p in prices]
            kind = "orderbook_snapshot"
        else:
            kind = "orderbook_delta"
            msg = {"side": rng.choice(["yes", "no"]), "price_dollars": f"0.{rng.randint(1, 7)}",
                   "delta_fp": str(rng.choice([3, 2, 1, 1, -1, -2]))}
            if rng.random() < 0.02:
                msg["price_dollars"] = rng.choice(["1.5", "abc"])
            if rng.random() < 0.02:
                msg["delta_fp"] = 0.5
        out.append((i, market, "c", "s", kind, json.dumps({"type": kind, "msg": msg})))
    return out


def replay(rows):
    state, out = {}, {}
    for i, market, _, _, kind, text in rows:
        msg = json.loads(text)["msg"]
        s = state.setdefault(market, {"yes": None, "bad": False, "n": 0, "seen": False})
        verdict, why = "FRAME_EMITTED", None
        if kind == "orderbook_snapshot":
            sides = {}
            for side in ("yes", "no"):
                levels = msg.get(f"{side}_dollars_fp", [])
                if len({p for p, _ in levels}) != len(levels):
                    why = "DUPLICATE_SNAPSHOT_PRICE"
                sides[side] = {D(p): D(q) for p, q in levels if D(q)}
            if not msg:
                why = "SNAPSHOT_BOTH_SIDES_OMITTED"
            if why:
                verdict, s["bad"] = "QUARANTINED", True
            else:
                s.update(sides, bad=False, seen=True)
        elif s["bad"]:
            verdict, why = "EXCLUDED", "SEGMENT_INVALID"
        else:
            try:
                price = D(msg["price_dollars"])
                typed = isinstance(msg["delta_fp"], str)
            except ArithmeticError:
                price, typed = D(0), False
            if not s["seen"]:
                why = "DELTA_BEFORE_SNAPSHOT"
            elif not typed:
                why = "MALFORMED_DELTA"
            elif price > 1:
                why = "IMPOSSIBLE_PRICE"
            else:
                book = s[msg["side"]]
                left = book.get(price, D(0)) + D(msg["delta_fp"])
                if left < 0:
                    why = "NEGATIVE_RESULTING_QUANTITY"
                elif left:
                    book[price] = left
                else:
                    book.pop(price, None)
            if why:
                verdict, s["bad"] = "QUARANTINED", True
        if verdict == "FRAME_EMITTED":
            s["n"] += 1
            bid = max(s["yes"], default=None)
            ask = 1 - max(s["no"]) if s["no"] else None
            out[i] = (verdict, why, s["n"], bid, ask, len(s["yes"]), len(s["no"]))
        else:
            out[i] = (verdict, why, s["n"], None, None, None, None)
    return out


def test_rebuild_matches_ladder_replay(spark):
    for seed in (1, 2):
        rows = messages(seed)
        want = replay(rows)
        parsed = R.parse_book_messages(spark.createDataFrame(rows, SCHEMA))
        rebuilt = R.rebuild_books(parsed, chunk_rows=8)
        verdicts = {r.row_index: (r.disposition, r.reason, r.frame_count) for r in rebuilt.collect()}
        assert verdicts == {i: w[:3] for i, w in want.items()}
        frames = R.book_frames(rebuilt, chunk_rows=8).collect()
        assert {f.row_index for f in frames} == {i for i, w in want.items() if w[0] == "FRAME_EMITTED"}
        for f in frames:
            got = (f.best_bid, f.best_ask, f.bid_level_count, f.ask_level_count)
            assert got == want[f.row_index][3:], (seed, f.row_index)
            assert len(f.bids) == f.bid_level_count and [x.price for x in f.asks] == sorted(x.price for x in f.asks)


def test_unified_books_need_no_complement(spark):
    rows = [(1, "m", "c", "s", "orderbook_snapshot",
             json.dumps({"yes_dollars_fp": [["0.41", "5.75"]], "no_dollars_fp": [["0.44", "4.5"]]}))]
    rebuilt = R.rebuild_books(R.parse_book_messages(spark.createDataFrame(rows, SCHEMA)))
    assert R.top_of_book(rebuilt, unified=True).first().best_ask == D("0.44")
    assert R.top_of_book(rebuilt).first().best_ask == D("0.56")


def test_contradiction_poisons_the_rest_of_a_segment(spark):
    rows = [("c", "s", i, "ob", "m", "1" if i != 3 else "2", "id", ["m"], None) for i in range(1, 6)]
    df = spark.createDataFrame(
        rows, "connection_id string, segment_id string, row_index bigint, channel string, market_ticker string, "
        "sid string, market_id string, requested_market_tickers array<string>, use_yes_price array<string>",
    )
    got = {r.row_index: r.segment_error for r in R.segment_contradictions(df, ["sid"]).collect()}
    assert got == {1: None, 2: None, 3: "IDENTITY_MISMATCH", 4: "IDENTITY_MISMATCH", 5: "IDENTITY_MISMATCH"}


def test_events_are_dealt_before_they_become_messages(spark):
    """The events file is small for its rows: few tasks read it, all tasks parse."""
    from paritymill.plans import views

    plan = views.v_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("payload") < plan.index("Exchange hashpartitioning(event_id")


def test_messages_are_parsed_once(spark):
    df = R.parse_book_messages(spark.createDataFrame(messages(5), SCHEMA))
    plan = R._with_epoch(df, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan.lower()
