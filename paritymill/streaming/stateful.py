"""Keyed streams over ``transformWithState``: value, map and time-to-live state.

Rows of a key that arrive in one micro-batch are put in recorded order in memory, as Arrow
columns; the source's limits per batch bound them.  A row that arrives behind the last row applied to
its key cannot be applied any more: it is marked late and leaves the state as it is.  So a
stream gives the batch operator's rows for every key whose rows arrive in order, however
they are cut into micro-batches, and says which rows it could not place.

``ttl_seconds`` lets the state of a key expire that long after its last change.  The state
store must be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paritymill.fixed import DEFAULT_MAX_STALENESS_SECONDS, PRICE
from paritymill.operators.feed import BOOK_KEYS
from paritymill.operators.rebuild import BOOK
from paritymill.operators.sequences import Automaton

LATE = "LATE_ROW"
SLICE_ROWS = 8_192


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from here on keep their state in RocksDB."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


ID_BUCKETS, ID_PARTS = 1024, 16


def _entries(parts, part: int, ttl: int | None, now: int) -> dict[str, list]:
    """What a part of a bucket holds by identity; the last field of a value is when it last came."""
    found = parts.getValue((part,))
    held = json.loads(found[0]) if found else {}
    return {k: v for k, v in held.items() if v[-1] + ttl > now} if ttl else held


class _Keyed(StatefulProcessor):
    """Applies the rows of a key in order; ``order`` is the position a row is applied at.

    The rows of a batch are held as Arrow columns; ``SLICE_ROWS`` of them at a time are Python rows.
    """

    order: str
    columns: Sequence[str]
    schema: pa.Schema

    def __init__(self, ttl_seconds: int | None) -> None:
        self.ttl = ttl_seconds * 1000 if ttl_seconds else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = [pa.Table.from_pandas(f[names], schema=self.schema, preserve_index=False) for f in rows]
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        position = table[self.order].to_numpy()
        places = None if (position[1:] >= position[:-1]).all() else np.argsort(position, kind="stable")
        for at in range(0, table.num_rows, SLICE_ROWS):
            part = table.slice(at, SLICE_ROWS) if places is None else table.take(places[at : at + SLICE_ROWS])
            yield pd.DataFrame(self.apply(key, part.to_pylist()), columns=[*self.columns])

    def apply(self, key: tuple, rows: list[dict]) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: Sequence[str], processor: _Keyed, schema: str) -> DataFrame:
    mode = "processingTime" if processor.ttl else "none"
    processor.schema = to_arrow_schema(df.drop(*keys).schema)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode)


# -- feed consistency ----------------------------------------------------------------------


class _Feed(_Keyed):
    order, columns = "arrival", [*BOOK_KEYS, "arrival", "sequence", "flags"]

    def __init__(self, limit_us: int, ttl_seconds: int | None) -> None:
        super().__init__(ttl_seconds)
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "arrival bigint, sequence bigint, observed_us bigint", self.ttl)

    def apply(self, key, rows):
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in rows:
            found = []
            late = last is not None and r["arrival"] <= last[0]
            if late:
                found.append("late_row")
            elif last is not None:
                if r["sequence"] != last[1] + 1:
                    found.append("sequence_gap")
                if r["observed_us"] < last[2]:
                    found.append("out_of_order")
            if r["received_us"] - r["observed_us"] > self.limit:
                found.append("stale_event")
            if not late:
                last = (int(r["arrival"]), int(r["sequence"]), int(r["observed_us"]))
            out.append((*key, r["arrival"], r["sequence"], "|".join(found)))
        self.last.update(last)
        return out


def feed_consistency_stream(
    df: DataFrame, order: str, max_staleness_seconds: int = DEFAULT_MAX_STALENESS_SECONDS, ttl_seconds: int | None = None
) -> DataFrame:
    """Gap, order, staleness and late flags; state is the last row applied to each book."""
    src = df.select(
        *BOOK_KEYS, F.col(order).cast("bigint").alias("arrival"), "sequence",
        F.unix_micros("observed_at").alias("observed_us"), F.unix_micros("received_at").alias("received_us"),
    )
    schema = "venue string, channel string, market_id string, arrival bigint, sequence bigint, flags string"
    return _run(src, BOOK_KEYS, _Feed(max_staleness_seconds * 1_000_000, ttl_seconds), schema)


# -- sequence states -------------------------------------------------------------------------

SUBSCRIPTION = ("campaign_id", "connection_epoch", "subscription")
_TAKEN = ("ord", "native_type", "market_ticker", "seq", "seq_present", "known", "requested", "static_exclusion")
_VERDICT = ("sequence_state", "admission_status", "exclusion_reason", "resync_state", "failures")


class _Sequence(_Keyed):
    """Subscriptions of a bucket; one call takes a bucket's rows of a batch.

    They are many and short, so they share entries of the state as the ids of ``_Identity`` do: a
    subscription has the last row applied to it, its last sequence, its failures and its markets.
    """

    order, columns = "ord", [*SUBSCRIPTION, "ord", *_VERDICT]

    def __init__(self, contiguous: bool, ttl_seconds: int | None) -> None:
        super().__init__(ttl_seconds)
        self.contiguous = contiguous

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int", "subscriptions string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        self.known, self.held = self.parts.exists(), {}
        self.met: dict[tuple, list] = {}
        yield from super().handleInputRows(key, rows, timerValues)
        for ident, part, applied, automaton in self.met.values():
            last = None if automaton.last is None else int(automaton.last)
            self.held[part][ident] = [applied, last, automaton.failures, sorted(automaton.markets), self.now]
        for part, held in self.held.items():
            self.parts.updateValue((part,), (json.dumps(held),))

    def _enter(self, key: tuple) -> list:
        """Identity, part, last row applied and automaton of a subscription."""
        ident = json.dumps(key)
        part = zlib.crc32(ident.encode()) % ID_PARTS
        if part not in self.held:
            self.held[part] = _entries(self.parts, part, self.ttl, self.now) if self.known else {}
        applied, last, failures, markets, _ = self.held[part].get(ident, (None, None, 0, (), 0))
        return [ident, part, applied, Automaton(self.contiguous, last, set(markets), failures)]

    def apply(self, key, rows):
        out = []
        for r in rows:
            name = tuple(r[c] for c in SUBSCRIPTION)
            met = self.met.get(name)
            if met is None:
                met = self.met[name] = self._enter(name)
            applied, automaton = met[2:]
            if applied is not None and r["ord"] <= applied:
                out.append((*name, r["ord"], None, "EXCLUDED", LATE, "RESYNC_REQUIRED", automaton.failures))
                continue
            met[2] = int(r["ord"])
            out.append((*name, *automaton.take(tuple(r[f] for f in _TAKEN))))
        return out


def sequence_stream(prepared: DataFrame, contiguous: bool = False, ttl_seconds: int | None = None) -> DataFrame:
    """Admission verdicts of bound rows; state is the last sequence and the markets with a snapshot.

    ``prepared`` are the rows of ``admission.prepare_rows``.  Subscriptions share ``ID_BUCKETS`` map
    states of ``ID_PARTS`` entries; a running stream must keep these numbers.
    """
    schema = (
        "campaign_id string, connection_epoch string, subscription string, ord bigint, sequence_state string, "
        "admission_status string, exclusion_reason string, resync_state string, failures bigint"
    )
    # as text, since pandas makes whole numbers beside nulls floating ones
    names = [F.col(c).cast("string").alias(c) for c in SUBSCRIPTION]
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in SUBSCRIPTION]), F.lit(ID_BUCKETS)).cast("int")
    src = prepared.select(bucket.alias("_bucket"), *names, *_TAKEN)
    found = _run(src, ["_bucket"], _Sequence(contiguous, ttl_seconds), schema)
    return found.withColumns({c: F.col(c).cast("bigint") for c in SUBSCRIPTION[1:]})


# -- books ---------------------------------------------------------------------------------------


class _Book(_Keyed):
    order = "row_index"
    columns = [*BOOK, "row_index", "disposition", "reason", "frame_count", "best_bid", "best_ask"]

    def __init__(self, unified: bool, ttl_seconds: int | None) -> None:
        super().__init__(ttl_seconds)
        self.unified = unified

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(
            "last", "row_index bigint, started boolean, invalid boolean, frames bigint", self.ttl
        )
        self.levels = handle.getMapState("levels", "side string, price string", "quantity string", self.ttl)

    @staticmethod
    def _judge(row: dict, ladder: dict, started: bool, invalid: bool) -> tuple[str, str | None]:
        """(disposition, reason) of a row; applies a good one to ``ladder``."""
        if row["native_type"] == "orderbook_snapshot":
            if row["parse_error"] is not None:
                return "QUARANTINED", row["parse_error"]
            ladder.clear()
            for side in ("yes", "no"):
                ladder.update(((side, Decimal(p)), Decimal(q)) for p, q in json.loads(row[side]))
            return "FRAME_EMITTED", None
        if invalid:
            return "EXCLUDED", "SEGMENT_INVALID"
        if not started:
            return "QUARANTINED", "DELTA_BEFORE_SNAPSHOT"
        if row["parse_error"] is not None:
            return "QUARANTINED", row["parse_error"]
        level = (row["side"], Decimal(row["price"]))
        left = ladder.get(level, Decimal(0)) + Decimal(row["delta"])
        if left < 0:
            return "QUARANTINED", "NEGATIVE_RESULTING_QUANTITY"
        ladder[level] = left
        if not left:
            del ladder[level]
        return "FRAME_EMITTED", None

    def apply(self, key, rows):
        applied, started, invalid, frames = self.last.get() if self.last.exists() else (None, False, False, 0)
        before = {(s, Decimal(p)): Decimal(q) for (s, p), (q,) in self.levels.iterator()}
        ladder = dict(before)
        out = []
        for r in rows:
            if applied is not None and r["row_index"] <= applied:
                out.append((*key, r["row_index"], "EXCLUDED", LATE, frames, None, None))
                continue
            applied = int(r["row_index"])
            verdict, reason = self._judge(r, ladder, started, invalid)
            bid = ask = None
            if verdict == "FRAME_EMITTED":
                started, invalid, frames = True, False, frames + 1
                bid = max((p for s, p in ladder if s == "yes"), default=None)
                no = [p for s, p in ladder if s == "no"]
                ask = (min(no) if self.unified else 1 - max(no)) if no else None
            else:
                invalid = True
            out.append((*key, applied, verdict, reason, frames, bid, ask))
        for side, price in before.keys() - ladder.keys():
            self.levels.removeKey((side, str(price)))
        for (side, price), quantity in ladder.items():
            if before.get((side, price)) != quantity:
                self.levels.updateValue((side, str(price)), (str(quantity),))
        self.last.update((applied, bool(started), bool(invalid), frames))
        return out


def rebuild_stream(df: DataFrame, unified: bool = False, ttl_seconds: int | None = None) -> DataFrame:
    """Disposition and top of book of parsed book messages; state is a map of each book's levels."""

    def pairs(levels: str):
        return F.to_json(F.transform(levels, lambda x: F.array(x["price"].cast("string"), x["quantity"].cast("string"))))

    src = df.select(
        *BOOK, F.col("row_index").cast("bigint").alias("row_index"), "native_type", "parse_error", "side",
        F.col("price").cast("string").alias("price"), F.col("delta").cast("string").alias("delta"),
        pairs("yes_levels").alias("yes"), pairs("no_levels").alias("no"),
    )
    schema = (
        "market_ticker string, connection_id string, segment_id string, row_index bigint, disposition string, "
        f"reason string, frame_count bigint, best_bid {PRICE}, best_ask {PRICE}"
    )
    return _run(src, BOOK, _Book(unified, ttl_seconds), schema)


# -- event identity ------------------------------------------------------------------------------


class _Identity(StatefulProcessor):
    """First payload hash of every id of a bucket of ids; one call takes a bucket's rows of a batch.

    Every call to the state store costs as much as hundreds of rows, so a part of a bucket is one
    entry: the ids in it as JSON, each with its hash and, with a time to live, when it last came.
    """

    def __init__(self, keys: Sequence[str], ttl_seconds: int | None) -> None:
        self.keys, self.ttl = list(keys), ttl_seconds * 1000 if ttl_seconds else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int", "ids string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ord", kind="stable", ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        known = self.parts.exists()
        held: dict[int, dict[str, list]] = {}
        changed, outcomes = set(), []
        for *name, payload_hash in zip(*[frame[c] for c in [*self.keys, "payload_hash"]], strict=True):
            ident = json.dumps([None if pd.isna(n) else n for n in name])
            part = zlib.crc32(ident.encode()) % ID_PARTS
            if part not in held:
                held[part] = _entries(self.parts, part, self.ttl, now) if known else {}
            first = held[part].get(ident)
            if first is None:
                held[part][ident] = [payload_hash, now]
                outcomes.append("first")
            else:
                outcomes.append("duplicate" if first[0] == payload_hash else "conflicting_duplicate_event")
                first[1] = now
            if first is None or self.ttl:
                changed.add(part)
        for part in changed:
            self.parts.updateValue((part,), (json.dumps(held[part]),))
        yield frame[[*self.keys, "ord"]].assign(outcome=outcomes)

    def close(self) -> None:
        pass


def event_identity_stream(
    df: DataFrame, keys: Sequence[str], order: str, payload_hash: str, ttl_seconds: int | None = None
) -> DataFrame:
    """Whether each event is the first of its id, repeats it, or contradicts it.

    State is the payload hash that the first arrival of an id brought; hashes are not null.
    Ids are many and small, so they share ``ID_BUCKETS`` map states of ``ID_PARTS`` entries; a
    running stream must keep these numbers.  Ids are of types that a cast to text and back leaves as they are.
    """
    text = [F.col(c).cast("string").alias(c) for c in keys]
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in keys]), F.lit(ID_BUCKETS)).cast("int")
    src = df.select(
        bucket.alias("_bucket"), *text, F.col(order).cast("bigint").alias("ord"), F.col(payload_hash).alias("payload_hash")
    )
    fields = ", ".join(f"`{c}` string" for c in keys)
    processor, mode = _Identity(keys, ttl_seconds), "processingTime" if ttl_seconds else "none"
    found = src.groupBy("_bucket").transformWithStateInPandas(
        processor, f"{fields}, ord bigint, outcome string", "Append", mode
    )
    return found.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in keys], "ord", "outcome")
