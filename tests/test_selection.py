"""Probing in rank order against a plain walk."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paritymill.operators.selection import eligible_candidates, near_misses

SCHEMA = (
    "ord bigint, activity decimal(38,18), closes_early boolean, seconds_to_deadline bigint, "
    "current_quote boolean, ticker string, market_ticker string, levels bigint"
)


def markets(n=400, seed=5):
    rng = random.Random(seed)
    return [
        (i, rng.choice([None, Decimal(1), Decimal(1), Decimal(7)]), rng.choice([None, True, False]), rng.choice([None, 60, 900]), rng.random() < 0.5,
         f"T{i:05d}", None, rng.choice([None, 0, 1, 5]))
        for i in range(n)
    ]


def walk(rows, max_probes, limit):
    """(ord, rank, eligible) of the probes, one candidate at a time."""
    ranked = sorted(rows, key=lambda r: (-(r[1] or 0), r[2] or False, -(r[3] or 0), not r[4], r[5]))
    out, passed = [], 0
    for rank, r in enumerate(ranked[:max_probes], 1):
        if limit is not None and passed >= limit:
            break
        ok = None if r[7] is None else r[7] > 2
        out.append((r[0], rank, ok))
        passed += bool(ok)
    return out


@pytest.mark.parametrize("max_probes,limit", [(None, None), (None, 12), (100, 12), (9, None), (None, 10_000), (0, 5)])
def test_probes_equal_a_plain_walk(spark, max_probes, limit):
    rows = markets()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = eligible_candidates(df, F.col("levels") > 2, max_probes, limit).select("ord", "candidate_rank", "eligible")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == walk(rows, max_probes, limit)


def test_probes_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert eligible_candidates(df, F.col("levels") > 2, None, 3).count() == 0


def test_no_window_over_all_candidates(spark, capsys):
    """Only the counts per range are ordered without a partition; candidates never are."""
    df = spark.createDataFrame(markets(50), SCHEMA)
    eligible_candidates(df, F.col("levels") > 2, None, 3).explain()
    plan = capsys.readouterr().out
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("_range" in line for line in windows)


def test_near_misses_at_the_cut_do_not_depend_on_the_rows_places(spark):
    rows = [("EV", None, "r", "close_time", 0, 0, None if i % 2 else i, "MISSING", None, False, i % 3 == 0, False, i % 2 == 0, i % 5 == 0) for i in range(40)]
    schema = (
        "event_ticker string, market_identity string, primary_rejection_reason string, lifecycle_deadline_source string, "
        "lifecycle_margin_seconds bigint, close_margin_seconds bigint, expiration_margin_seconds bigint, occurrence_class string, "
        "occurrence_margin_seconds bigint, dual_interpretation_pass boolean, closes_early boolean, sports boolean, "
        "match_like boolean, current_quote boolean"
    )
    cut = lambda r: [tuple(x) for x in near_misses(spark.createDataFrame(r, schema).coalesce(1), 7).collect()]
    assert cut(rows) == cut(rows[::-1])


def test_markets_are_selected_once_for_both_rankings(spark, monkeypatch):
    """Ranges are sampled first, so what a ranking reads must be written already."""
    from paritymill.operators import selection
    from paritymill.plans.queries import queries

    plans = []
    real = selection.stage

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(selection, "stage", watched)
    queries()["candidate_rank"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and all("Join" not in p and "part.parquet" not in p for p in plans)
