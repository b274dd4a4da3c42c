"""Chunked sequence states against one walk over all rows of a key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paritymill.functions.ordered import chunk_of
from paritymill.operators import sequences

MARKETS = ("M0", "M1", "M2")


def make(rng: random.Random, size: int, calm: float) -> list[tuple]:
    """Rows (ord, type, market, seq, present, known, requested, static) with faults of every kind."""
    rows, seq, at = [], 0, 0
    for _ in range(size):
        at += rng.choice([1, 1, 2, 5])
        kind = rng.choices(["orderbook_delta", "orderbook_snapshot", "trade"], [6, 2, 1])[0]
        seq = max(0, seq + (1 if rng.random() < calm else rng.choice([0, 0, 2, -1, -3, 1])))
        market = rng.choice([*MARKETS, "other", None])
        book, requested = kind != "trade", market in MARKETS
        present = rng.random() < 0.9
        known = book and requested and present and rng.random() < 0.9
        static = rng.choice(["SUBSCRIPTION_IDENTITY_MISMATCH", "CHANNEL_TYPE_MISMATCH"]) if rng.random() < 0.2 else None
        rows.append((at, kind, market, seq if present else 0, present, known, requested, static))
    return rows


def one_walk(rows: list[tuple], contiguous: bool) -> list[tuple]:
    automaton = sequences.Automaton(contiguous, None, set(), 0)
    return [automaton.take(r) for r in rows]


def in_chunks(rows: list[tuple], contiguous: bool, width: int) -> list[tuple]:
    chunks: dict[int, list[tuple]] = {}
    for r in rows:
        chunks.setdefault(r[0] // width, []).append(r)
    latest: dict[str, int] = {}
    held, summaries = [], []
    for part in chunks.values():
        held.append(dict(latest))
        summaries.append(sequences.summarize(part, latest, contiguous))
        latest |= {r[2]: r[0] for r in part if r[1] == "orderbook_snapshot" and r[6] and r[7] is None}
    out = []
    for part, own, (p, failures, last) in zip(
        chunks.values(), held, sequences.entries(summaries, contiguous), strict=True
    ):
        markets = {m for m, at in own.items() if at > p}
        automaton = sequences.Automaton(contiguous, last, markets, failures)
        out += [automaton.take(r) for r in part]
    return out


@pytest.mark.parametrize("contiguous", [False, True])
@pytest.mark.parametrize("calm", [0.2, 0.7, 0.97])
def test_chunks_of_any_size_equal_one_walk(contiguous, calm):
    for seed in range(150):
        rng = random.Random(seed)
        rows = make(rng, rng.choice([3, 40, 200]), calm)
        want = one_walk(rows, contiguous)
        for width in (1, 3, 10, 64):
            assert in_chunks(rows, contiguous, width) == want, (seed, width)


def test_a_chunk_of_many_failures_has_few_pieces():
    """Borders of a chunk's map are failures it can tell apart, not its rows."""
    rng = random.Random(3)
    rows = [r for r in make(rng, 4000, 0.5) if r[0] >= 2000]
    found = sequences.summarize(rows, {}, True)
    assert len(found["starts"]) < 50 and found["head_failures"] > 100


def test_a_hot_subscription_is_cut(spark):
    rng = random.Random(5)
    hot, rest = make(rng, 4500, 0.8), make(rng, 500, 0.8)
    names = "ord bigint, native_type string, market_ticker string, seq bigint, seq_present boolean, known boolean, requested boolean, static_exclusion string"
    rows = [("hot", *r) for r in hot] + [("rest", *r) for r in rest]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"k string, {names}")
    chunk = chunk_of(F.col("ord"), 256)
    assert df.groupBy("k", chunk.alias("c")).count().agg(F.max("count")).first()[0] <= 256
    out = sequences.sequence_verdicts(df, ["k"], chunk, contiguous=True)
    got = {(r.k, r.ord): tuple(r)[1:] for r in out.collect()}
    want = {("hot", v[0]): v for v in one_walk(hot, True)} | {("rest", v[0]): v for v in one_walk(rest, True)}
    assert got == want
    # no stage of the plan may order or group rows by the key alone; only summaries are
    assert sequences.sequence_verdicts(df.limit(0), ["k"], chunk).count() == 0
