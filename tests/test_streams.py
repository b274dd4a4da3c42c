"""Keyed streams over several micro-batches, in and out of order, against plain walks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
import pytest

import test_rebuild
import test_sequences
from paritymill.operators import rebuild as R
from paritymill.operators import reconcile
from paritymill.functions.ordered import chunk_of
from paritymill.streaming import stateful, streams
from pyspark.sql import functions as F

PREPARED = (
    "campaign_id string, connection_epoch bigint, subscription bigint, ord bigint, native_type string, market_ticker string, "
    "seq bigint, seq_present boolean, known boolean, requested boolean, static_exclusion string"
)


def arrivals(spark, folder, batches, schema):
    """A stream that reads each list of rows in a micro-batch of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_sequence_stream_over_batches_equals_one_walk(spark, tmp_path):
    rng = random.Random(2)
    keys = [("c", 1, s) for s in range(4)]
    rows = {k: test_sequences.make(rng, 60, 0.8) for k in keys}
    flat = sorted(((*k, *r) for k in keys for r in rows[k]), key=lambda r: r[3])
    live = arrivals(spark, tmp_path / "in", [flat[:70], flat[70:75], flat[75:]], PREPARED)
    out = streams.run_available(stateful.sequence_stream(live, contiguous=True, ttl_seconds=3600), "t-seq", closing_batch=False)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in out.collect()}
    want = {(*k, v[0]): v[1:] for k in keys for v in test_sequences.one_walk(rows[k], True)}
    assert got == want


def test_a_late_sequence_row_is_marked_and_changes_nothing(spark, tmp_path):
    row = lambda i, kind, seq: ("c", 1, 0, i, kind, "M0", seq, True, True, True, None)
    live = arrivals(
        spark, tmp_path / "in",
        [[row(1, "orderbook_snapshot", 1), row(3, "orderbook_delta", 2)], [row(2, "orderbook_delta", 9), row(4, "orderbook_delta", 3)]],
        PREPARED,
    )
    out = streams.run_available(stateful.sequence_stream(live, contiguous=True), "t-late")
    got = {r.ord: (r.sequence_state, r.admission_status, r.exclusion_reason) for r in out.collect()}
    assert got[2] == (None, "EXCLUDED", stateful.LATE)
    assert got[4] == ("SEQUENCE_CONTIGUITY_VERIFIED", "ADMITTED", None)


def test_subscriptions_share_calls_and_keep_their_own_state(spark, tmp_path):
    rng = random.Random(5)
    keys = [("c", None if s % 7 == 0 else 2**60 + s, s if s % 5 else None) for s in range(40)]
    keys = list(dict.fromkeys(keys))
    rows = {k: test_sequences.make(rng, 12, 0.8) for k in keys}
    flat = [(*k, *r) for k in keys for r in rows[k]]
    flat.sort(key=lambda r: r[3])
    live = arrivals(spark, tmp_path / "in", [flat[:200], flat[200:]], PREPARED)
    stream = stateful.sequence_stream(live, contiguous=True)
    assert "_bucket" in stream._jdf.queryExecution().analyzed().toString()
    out = streams.run_available(stream, "t-shared")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in out.collect()}
    assert got == {(*k, v[0]): v[1:] for k in keys for v in test_sequences.one_walk(rows[k], True)}


def test_rebuild_stream_over_batches_equals_the_replay(spark, tmp_path):
    rows = test_rebuild.messages(3)
    live = arrivals(spark, tmp_path / "in", [rows[:90], rows[90:91], rows[91:]], test_rebuild.SCHEMA)
    out = streams.run_available(stateful.rebuild_stream(R.parse_book_messages(live)), "t-book")
    got = {r.row_index: (r.disposition, r.reason, r.frame_count, r.best_bid, r.best_ask) for r in out.collect()}
    assert got == {i: w[:5] for i, w in test_rebuild.replay(rows).items()}


def test_late_book_and_feed_rows_are_marked(spark, tmp_path):
    rows = [r for r in test_rebuild.messages(4) if r[1] == "hot"]
    early, late = rows[:20] + rows[21:40], [rows[20], *rows[40:60]]
    live = arrivals(spark, tmp_path / "book", [early, late], test_rebuild.SCHEMA)
    out = streams.run_available(stateful.rebuild_stream(R.parse_book_messages(live)), "t-book-late")
    got = {r.row_index: (r.disposition, r.reason) for r in out.collect()}
    want = test_rebuild.replay(early + late[1:])
    assert got.pop(rows[20][0]) == ("EXCLUDED", stateful.LATE)
    assert got == {i: w[:2] for i, w in want.items()}
    at = lambda s: datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    schema = "venue string, channel string, market_id string, i bigint, sequence bigint, observed_at timestamp, received_at timestamp"
    feed = lambda i, seq: ("v", "c", "m", i, seq, at(i), at(i))
    live = arrivals(spark, tmp_path / "feed", [[feed(1, 1), feed(4, 2)], [feed(3, 7), feed(5, 4)]], schema)
    out = streams.run_available(stateful.feed_consistency_stream(live, "i"), "t-feed").collect()
    assert {r.arrival: r.flags for r in out} == {1: "", 4: "", 3: "late_row", 5: "sequence_gap"}


def test_conflicting_duplicates_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = (
        "audit_id string, ord bigint, event_id string, event_hash string, event_type string, resolved_event_type string, "
        "proposal_id string, candidate_hash string, approval_id string, client_order_id string, price decimal(18,8), quantity decimal(18,8)"
    )
    rows = [
        (f"A{i % 2}", i, f"E{rng.randrange(25)}", f"h{rng.randrange(2)}", "accepted", None, "P", "c", "a", "O", None, None)
        for i in range(120)
    ]
    live = arrivals(spark, tmp_path / "in", [rows[:50], rows[50:]], schema)
    found = stateful.event_identity_stream(live, ["audit_id", "event_id"], "ord", "event_hash")
    got = streams.run_available(found, "t-identity").where("outcome = 'conflicting_duplicate_event'")
    audits = spark.createDataFrame(
        [(a, "P", "c", "a", "submitted", "O", "yes", 1) for a in ("A0", "A1")],
        "audit_id string, proposal_id string, candidate_hash string, approval_id string, status string, "
        "client_order_id string, side string, submitted_quantity int",
    )
    events = spark.createDataFrame(rows, schema)
    batch = reconcile.reconcile(audits, events, chunk_of(F.col("ord"), 64))["mismatches"]
    want = {(r.audit_id, r.event_id, r.ord) for r in batch.where("reason = 'conflicting_duplicate_event'").collect()}
    assert want and {(r.audit_id, r.event_id, r.ord) for r in got.collect()} == want


def test_rows_of_a_key_become_python_rows_by_slices(monkeypatch):
    monkeypatch.setattr(stateful, "SLICE_ROWS", 10)
    sizes = []

    class Tail(stateful._Keyed):
        order, columns = "at", ["k", "at", "seen"]
        schema = pa.schema([("at", pa.int64()), ("n", pa.int64()), ("t", pa.list_(pa.string()))])

        def init(self, handle):
            pass

        def apply(self, key, rows):
            sizes.append(len(rows))
            return [(*key, r["at"], (r["n"], r["t"])) for r in rows]

    rows = [(i * 7 % 45, None if i % 4 else 2**60 + i, None if i % 3 else [str(i)]) for i in range(45)]
    frame = pd.DataFrame({"at": [r[0] for r in rows], "n": pd.Series([r[1] for r in rows], dtype=object), "t": [r[2] for r in rows]})
    batches = [frame[a : a + 20] for a in (0, 20, 40)]
    out = list(Tail(None).handleInputRows(("k",), iter(batches), None))
    assert sizes == [10, 10, 10, 10, 5]
    got = [tuple(r) for r in pd.concat(out).itertuples(index=False)]
    assert got == [("k", a, (n, t)) for a, n, t in sorted(rows, key=lambda r: r[0])]


@pytest.mark.parametrize("ttl", [None, 3600])
def test_ids_share_map_states(spark, tmp_path, ttl):
    rows = [(None if i % 7 == 0 else i % 90 + 2**60, f"n{i % 4}", i, f"h{i % 5 == 4}") for i in range(400)]
    schema = "account bigint, name string, ord bigint, payload_hash string"
    live = arrivals(spark, tmp_path / "in", [rows[:150], rows[150:160], rows[160:]], schema)
    found = stateful.event_identity_stream(live, ["account", "name"], "ord", "payload_hash", ttl)
    assert found.schema["account"].dataType.simpleString() == "bigint"
    assert "_bucket" in found._jdf.queryExecution().analyzed().toString()
    got = {r.ord: (r.account, r.name, r.outcome) for r in streams.run_available(found, "t-ids", closing_batch=False).collect()}
    first, want = {}, {}
    for account, name, at, payload in rows:
        same = first.setdefault((account, name), (at, payload))
        outcome = "duplicate" if same[1] == payload else "conflicting_duplicate_event"
        want[at] = (account, name, "first" if same[0] == at else outcome)
    assert got == want


@pytest.mark.parametrize("delay", [0, 30])
def test_kept_and_late_rows_are_the_input(spark, tmp_path, delay):
    at = lambda s: datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    batches = [[(1, at(100)), (2, at(10))], [(3, at(80)), (4, at(150)), (5, None)], [(6, at(60)), (7, at(121)), (8, at(149))]]
    live = arrivals(spark, tmp_path / "in", batches, "k bigint, ts timestamp")
    kept, late = streams.run_late_split(live, "ts", delay, "t-late-split")
    ids = lambda df: sorted(r.k for r in df.collect())
    assert ids(late) == ([3, 6, 7, 8] if not delay else [6])
    assert sorted(ids(kept) + ids(late)) == list(range(1, 9))


def test_updated_windows_read_their_last_state(spark, tmp_path):
    at = lambda h: datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    batches = [[("m", at(1), 2), ("m", at(30), 3)], [("m", at(31), 4), ("n", at(40), 5)]]
    live = arrivals(spark, tmp_path / "in", batches, "market string, ts timestamp, quantity int")
    daily = streams.daily_counters_stream(live, "ts", "2 days", ["market"])
    out = streams.run_available(daily, "t-daily", "update", ["day", "market"]).collect()
    assert sorted((r.market, r.day.day, r.row_count, r.quantity) for r in out) == [("m", 1, 1, 2), ("m", 2, 2, 7), ("n", 2, 1, 5)]
