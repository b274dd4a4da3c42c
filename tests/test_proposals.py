"""Proposals: one row per candidate, latest simulation of its market."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from paritymill.functions.ordered import near_last
from paritymill.operators import proposals
from paritymill.plans.queries import queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sides(spark):
    cand = spark.createDataFrame(
        [("v", "A", digest("a")), ("v", "A", "not a hash"), ("v", "B", "F" * 64), ("v", "C", digest("c"))],
        "venue string, market_id string, candidate_hash string",
    ).withColumn("decision", F.lit("paper_candidate"))
    sims = spark.createDataFrame(
        [("v", "A", "1", digest("old")), ("v", "A", "2", digest("new")), ("v", "B", "1", "short")],
        "venue string, market_id string, ord string, simulation_hash string",
    )
    amounts = ("completed_pair_size", "failed_leg_quantity", "simulated_net_edge_per_pair", "yes_fill_price", "no_fill_price")
    return cand, sims.withColumns({c: F.lit("0.5").cast("decimal(20,18)") for c in amounts})


def test_hashes_travel_and_arrive_as_they_were(spark):
    out = proposals.propose_all(*sides(spark), "ord").collect()
    got = {(r.market_id, r.candidate_hash): r for r in out}
    assert set(got) == {("A", digest("a")), ("A", "not a hash"), ("B", "F" * 64), ("C", digest("c"))}
    assert {k[0]: r.simulation_hash for k, r in got.items()} == {"A": digest("new"), "B": "short", "C": None}
    text = '{"candidate_hash":"%s","market_id":"A","simulation_hash":"%s","venue":"v"}' % (digest("a"), digest("new"))
    assert got["A", digest("a")].proposal_id == digest(text)


def test_candidates_without_a_simulation_are_told_apart(spark):
    made, missing = proposals.propose(*sides(spark), "ord")
    assert sorted(r.market_id for r in made.collect()) == ["A", "A", "B"]
    assert [(r.market_id, r.candidate_hash) for r in missing.collect()] == [("C", digest("c"))]
    alone = proposals.propose_all(*sides(spark), "ord").where("market_id = 'C'").first()
    assert (alone.simulated, alone.proposal_id, alone.legs) == (False, None, [])


def test_simulations_are_not_sorted_before_they_travel(spark):
    for name in ("proposal_join", "order_preview_screen"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        # the innermost aggregate of the simulations finds them partitioned by market
        last = max(i for i, x in enumerate(lines) if "partial_max_by" in x)
        assert any("Exchange hashpartitioning(venue" in x for x in lines[last:])


def test_only_rows_that_may_be_the_last_are_kept(spark):
    rows = [(f"m{i % 7}" if i % 50 else None, t, i) for i in range(700) for t in (f"{i:05d}:x", f"\u00e9{i % 3}" if i % 97 == 0 else None, "")]
    df = spark.createDataFrame(rows, "market string, ord string, n bigint")
    kept = near_last(df, ["market"], "ord")
    last = {m: max(o.encode() for k, o, _ in rows if k == m and o is not None) for m in {r[0] for r in rows}}
    got = [tuple(r) for r in kept.collect()]
    assert {r for r in rows if r[1] is not None and r[1].encode() == last[r[0]]} <= set(got) <= set(rows) and len(got) < 20
    assert {(r.market, r.n) for r in near_last(df, ["market"], "n").collect()} >= {(m, max(n for k, _, n in rows if k == m)) for m in last}
    same = spark.createDataFrame([("a", f"common head {i}") for i in range(9)] + [("b", None)], "market string, ord string")
    assert near_last(same, ["market"], "ord").count() == 9


def test_candidates_are_not_sorted_and_old_simulations_do_not_travel_wide(spark):
    plan = queries()["proposal_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "partial_max(_head" in plan
