"""Admission against a small row-by-row model, on random message sequences."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paritymill.functions.ordered import chunk_of
from paritymill.operators.admission import admit_rows

MARKETS = ("M0", "M1")
ROWS = (
    "campaign_id string, connection_epoch bigint, ord bigint, native_type string, channel string, "
    "request_id string, request_id_is_int boolean, sid string, envelope_rejection string, "
    "market_ticker string, seq string, seq_is_int boolean"
)


def make(seed: int):
    rng = random.Random(seed)
    rows, requests, connections, plan = [], [], [], []
    ordinal, command = 0, 1
    for epoch in range(1, 4):
        connections.append(("c", epoch))
        plan.append(("connect", epoch))
        current = {}
        seq = rng.randint(1, 5)
        for _ in range(rng.randint(15, 40)):
            ordinal += 1
            what = rng.random()
            if what < 0.12:
                channel = rng.choice(["orderbook_delta", "trade"])
                requests.append(("c", epoch, ordinal, channel, command))
                current[channel] = command
                plan.append(("bind", epoch, ordinal, channel, command))
                command += 1
                continue
            if what < 0.3:
                channel = rng.choice(["orderbook_delta", "trade"])
                kind = rng.choice(["ack", "ack", "ack", "error"])
                named = str(current.get(channel, 77) if rng.random() < 0.8 else 999)
                lost = kind == "error" and rng.random() < 0.3
                row = ("c", epoch, ordinal, kind, "error" if lost else channel, named, True,
                       rng.choice(["7", "7", "7", "8"]), None, None, None, False)
            else:
                kind = rng.choice(["orderbook_snapshot", "orderbook_delta", "orderbook_delta", "trade", "heartbeat"])
                seq += rng.choice([1, 1, 1, 1, 0, 2, -1])
                channel = {"trade": "trade", "heartbeat": "heartbeat"}.get(kind, "orderbook_delta")
                if rng.random() < 0.05:
                    channel = "trade" if channel == "orderbook_delta" else "orderbook_delta"
                row = ("c", epoch, ordinal, kind, channel, None, False, rng.choice(["7"] * 9 + ["8"]),
                       "MISSING_DATA_SID" if rng.random() < 0.04 else None,
                       rng.choice(["M0", "M1", "M2", None]), str(seq) if rng.random() < 0.95 else None, True)
                if row[10] is None:
                    row = row[:11] + (False,)
            rows.append(row)
            plan.append(("row", row))
    return rows, requests, connections, plan


def model(plan, contiguous):
    """Plain state machine of the admission rules."""
    out, gens, seg = {}, {}, 0
    for item in plan:
        if item[0] == "connect":
            seg, why = seg + 1, "INITIAL_CONNECTION" if item[1] == 1 else "RECONNECTION"
            live, seen, last = {}, set(), None
        elif item[0] == "bind":
            _, _, _, channel, command = item
            gens[channel] = gens.get(channel, 0) + 1
            live[channel] = {"cmd": command, "gen": gens[channel], "state": "REQUESTED", "sid": None}
            if channel == "orderbook_delta":
                seg, why = seg + 1, "RESUBSCRIPTION" if gens[channel] > 1 else "NEW_SUBSCRIPTION"
                seen, last = set(), None
        else:
            (_, _, o, kind, channel, rid, rint, sid, bad, market, seq, is_int) = item[1]
            b = live.get(channel)
            if b is None and kind == "error" and rid is not None:
                hits = [x for x in live.values() if str(x["cmd"]) == rid]
                b = hits[0] if len(hits) == 1 else None
            shown = note = None
            if bad is None and b is not None and kind in ("ack", "error"):
                hit = rint and rid == str(b["cmd"])
                if not hit:
                    shown, note = "REQUEST_MISMATCH", "STALE_ACK" if kind == "ack" else "REJECTED"
                elif kind == "ack":
                    if b["state"] == "REQUESTED":
                        b.update(state="ACKNOWLEDGED", sid=sid)
                        note = "ACKNOWLEDGED"
                    elif b["state"] == "ACKNOWLEDGED" and b["sid"] == sid:
                        note = "DUPLICATE_ACK"
                    else:
                        b["state"], note = "CONFLICTED", "CONFLICTING_ACK"
                elif b["state"] == "REQUESTED":
                    b["state"], note = "REJECTED", "REJECTED"
                elif b["state"] == "REJECTED":
                    note = "DUPLICATE_REJECTION"
                else:
                    b["state"], note = "CONFLICTED", "CONFLICTING_REJECTION"
            book = kind.startswith("orderbook_")
            data = book or kind == "trade"
            wanted, acked = market in MARKETS, b is not None and b["state"] == "ACKNOWLEDGED"
            if kind == "orderbook_snapshot" and wanted and not seen:
                last = None
            verdict = "SEQUENCE_PRESENT_SEMANTICS_UNKNOWN"
            if seq is None:
                verdict = "SEQUENCE_NOT_OBSERVED"
            elif book and wanted and bad is None and acked and is_int:
                n = int(seq)
                if last is None:
                    last = n
                elif n == last:
                    verdict = "SEQUENCE_DUPLICATE"
                elif n < last:
                    verdict = "SEQUENCE_OUT_OF_ORDER"
                else:
                    step, last = n - last, n
                    verdict = "SEQUENCE_OBSERVED_MONOTONIC"
                    if contiguous:
                        verdict = "SEQUENCE_CONTIGUITY_VERIFIED" if step == 1 else "SEQUENCE_GAP_DETECTED"
            faults = {"SEQUENCE_DUPLICATE": "SEQUENCE_DUPLICATE", "SEQUENCE_OUT_OF_ORDER": "SEQUENCE_OUT_OF_ORDER",
                      "SEQUENCE_GAP_DETECTED": "SEQUENCE_GAP"}
            fault = broken = faults.get(verdict)
            if bad:
                fault = "NATIVE_ENVELOPE_REJECTED"
            due = "orderbook_delta" if book else "trade" if kind == "trade" else channel
            if channel != due:
                fault = "CHANNEL_TYPE_MISMATCH"
            elif data and not bad and not acked:
                conflicted = b is not None and b["state"] == "CONFLICTED"
                fault = "SUBSCRIPTION_BINDING_CONFLICTED" if conflicted else "PRE_ACKNOWLEDGMENT_DATA"
            if data and acked and sid != b["sid"]:
                fault = "SUBSCRIPTION_IDENTITY_MISMATCH"
            hard = fault is not None
            status = "EXCLUDED" if hard else "NOT_APPLICABLE"
            if not hard and book:
                if market is None:
                    status, fault = "EXCLUDED", "MISSING_MARKET_TICKER"
                elif not wanted:
                    status, fault = "EXCLUDED", "UNREQUESTED_MARKET_TICKER"
                elif kind == "orderbook_snapshot":
                    seen.add(market)
                    status = "ADMITTED"
                elif market in seen:
                    status = "ADMITTED"
                else:
                    status, fault, last = "EXCLUDED", "DELTA_BEFORE_SNAPSHOT", None
            out[o] = (verdict, status, fault, shown or (b["state"] if b else "UNKNOWN"), note,
                      seg, why, b["gen"] if b else None)
            if broken and fault == broken and book:
                seg, why, seen, last = seg + 1, "INTEGRITY_FAILURE", set(), None
    return out


def test_admission_matches_row_by_row_model(spark):
    for seed, contiguous in ((1, False), (2, True), (3, True)):
        rows, requests, connections, plan = make(seed)
        df = admit_rows(
            spark.createDataFrame(rows, ROWS),
            spark.createDataFrame(
                requests, "campaign_id string, connection_epoch bigint, ord bigint, channel string, command_id bigint"
            ),
            spark.createDataFrame(connections, "campaign_id string, connection_epoch bigint"),
            MARKETS, chunk_of(F.col("ord"), 16), contiguous,
        )
        got = {
            r.ord: (r.sequence_state, r.admission_status, r.exclusion_reason, r.binding_state,
                    r.binding_observation, r.segment_number, r.segment_boundary_reason, r.generation)
            for r in df.collect()
        }
        want = model(plan, contiguous)
        assert got.keys() == want.keys()
        bad = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
        assert not bad, (seed, next(iter(bad.items())), len(bad))


def test_envelopes_are_parsed_once_and_dealt_first(spark, monkeypatch):
    """A file of few bytes is read by few tasks; its messages are dealt before they are parsed."""
    from paritymill.operators import admission
    from paritymill.plans.queries import queries

    plans = {}
    real = admission.stage

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(admission, "stage", watched)
    queries()["binding_state"](spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning(event_id" in plans["binding-rows"]
    assert "from_json" not in plans["bound-rows"] and "parse_json" not in plans["bound-rows"]
