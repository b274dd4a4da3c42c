"""Sequence states of order-book rows, in chunks that do not wait for each other.

A failure restarts the automaton from one state, so whatever came before it is forgotten.
All that a row needs of its past is therefore the position ``p`` of the last failure:

* a market has its snapshot when the market's latest clean snapshot lies behind ``p``;
* a clean delta of a market without one forgets the last sequence after its row, and a
  requested snapshot does so before its row when no market has one;
* a sequence is remembered while ``p`` lies before its *until*: its own row if that may
  fail, and every latest snapshot whose absence would have made a row forget it.

A row fails when ``p`` lies in an interval that rows before it fix.  So a chunk is a map of
``p``, constant between few borders, from the failure it is entered with to the one it is
left with.  These maps compose along a key, a row per chunk, and every chunk is then walked
from the state it is entered with.  Nothing but the chunks' summaries is ordered per key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.functions.folds import map_groups
from paritymill.session import stage

_LOW, _HIGH = -(1 << 62), 1 << 62
SEQUENCE_FAULTS = {
    "SEQUENCE_DUPLICATE": "SEQUENCE_DUPLICATE",
    "SEQUENCE_OUT_OF_ORDER": "SEQUENCE_OUT_OF_ORDER",
    "SEQUENCE_GAP_DETECTED": "SEQUENCE_GAP",
}
_FACTS = ["ord", "native_type", "market_ticker", "seq", "seq_present", "known", "requested", "static_exclusion"]

Memory = list[tuple[int, int]]  # (sequence, until)
Bounds = tuple[int, int, int]


# -- what a chunk does to the last failure ---------------------------------------------------


def _narrow(memory: Memory, gate: int) -> Memory:
    return [(s, min(until, gate)) for s, until in memory] if gate < _HIGH else memory


def _remember(memory: Memory, seq: int, until: int) -> Memory:
    """Without entries that a greater sequence outlives."""
    return [(s, u) for s, u in memory if s > seq or u > until] + [(seq, until)]


def _bounds(memory: Memory, seq: int, contiguous: bool) -> Bounds:
    """A row with ``seq`` fails when p < first, or second <= p < third."""
    more = max((u for s, u in memory if s >= seq), default=_LOW)
    if not contiguous:
        return more, _LOW, _LOW
    known = max((u for _, u in memory), default=_LOW)
    level = max((u for s, u in memory if s >= seq - 1), default=_LOW)
    return (known, _LOW, _LOW) if level <= more else (more, level, known)


def _fails(p: int, bounds: Bounds) -> bool:
    return p < bounds[0] or bounds[1] <= p < bounds[2]


class _Map:
    """First failure behind any ``p`` among a chunk's rows, and where its failures end."""

    def __init__(self, marks: list[tuple[int, Bounds]]) -> None:
        # rows from the right; the nearest row that fails for p < first is found by bisection
        self.keys: list[int] = []
        self.nearest: list[int] = []
        self.odd: list[int] = []
        self.marks = marks
        self.ends: dict[int, tuple[int, int]] = {}
        for i in range(len(marks) - 1, -1, -1):
            self.ends[i] = self.after(marks[i][0], 1)
            first, level, known = marks[i][1]
            if level < known:
                self.odd.append(i)
            while self.keys and -self.keys[-1] <= first:
                self.keys.pop()
                self.nearest.pop()
            self.keys.append(-first)
            self.nearest.append(i)

    def after(self, p: int, count: int) -> tuple[int, int]:
        """(last failure, failures) when the rows seen so far are entered with ``p``."""
        at = bisect_left(self.keys, -p) - 1
        found = [self.nearest[at]] if at >= 0 else []
        found += [i for i in self.odd if self.marks[i][1][1] <= p < self.marks[i][1][2]]
        if not found:
            return p, count
        end, more = self.ends[min(found)]
        return end, count + more

    def pieces(self, low: int) -> list[int]:
        """Least ``p`` of each stretch below ``low`` on which the map is constant."""
        borders = {-k for k in self.keys} | {b for i in self.odd for b in self.marks[i][1]}
        return sorted({_LOW} | {b for b in borders if _LOW < b < low})


_SUMMARY = (
    "head_ord bigint, head_seq bigint, reach bigint, head_end bigint, head_failures bigint, "
    "own_seqs array<bigint>, own_untils array<bigint>, starts array<bigint>, ends array<bigint>, failures array<bigint>, "
    "tail_seqs array<bigint>, tail_untils array<bigint>"
)
_HELD = "markets array<string>, latest array<bigint>"


def summarize(rows: Iterable[tuple], latest: dict[str, int], contiguous: bool) -> dict:
    """What a chunk does, for any state it may be entered in.

    The first row that may fail (the head) also depends on sequences remembered from earlier
    chunks; ``reach`` is what those are narrowed to before it.
    """
    latest = dict(latest)
    any_snapshot = max(latest.values(), default=_LOW)
    memory: Memory = []
    head, marks, reach, after, low = None, [], _HIGH, _HIGH, None
    for at, kind, market, seq, _, known, requested, static in rows:
        low = at if low is None else low
        gate = min(after, any_snapshot) if kind == "orderbook_snapshot" and requested else after
        memory = _narrow(memory, gate)
        reach = reach if head else min(reach, gate)
        if known and static is None:
            if head is None:
                head = (at, seq, memory)
            else:
                bounds = _bounds(memory, seq, contiguous)
                if bounds[0] > _LOW or bounds[1] < bounds[2]:
                    marks.append((at, bounds))
            memory = [(seq, at)]
        elif known:
            memory = _remember(memory, seq, _HIGH)
        after = _HIGH
        if static is None and requested:
            if kind == "orderbook_snapshot":
                latest[market] = any_snapshot = at
            elif kind == "orderbook_delta":
                after = latest.get(market, _LOW)
    memory = _narrow(memory, after)
    reach = reach if head else min(reach, after)
    chunk = _Map(marks)
    starts = chunk.pieces(low)
    ends = [chunk.after(p, 0) for p in starts]
    own = head[2] if head else []
    head_end = chunk.after(head[0], 1) if head else (None, None)
    return {
        "head_ord": head and head[0], "head_seq": head and head[1], "reach": reach,
        "head_end": head_end[0], "head_failures": head_end[1],
        "own_seqs": [s for s, _ in own], "own_untils": [u for _, u in own],
        "starts": starts, "ends": [e for e, _ in ends], "failures": [n for _, n in ends],
        "tail_seqs": [s for s, _ in memory], "tail_untils": [u for _, u in memory],
    }


def entries(summaries: Iterable[dict], contiguous: bool) -> list[tuple[int, int, int | None]]:
    """(last failure, failures, last sequence) that each chunk of a key is entered with."""
    p, failures, memory = _LOW, 0, []
    found = []
    for c in summaries:
        found.append((p, failures, max((s for s, until in memory if p < until), default=None)))
        carried = _narrow(memory, c["reach"])
        tail = list(zip(c["tail_seqs"], c["tail_untils"], strict=True))
        if c["head_ord"] is None:
            for seq, until in tail:
                carried = _remember(carried, seq, until)
            memory = carried
            continue
        own = list(zip(c["own_seqs"], c["own_untils"], strict=True))
        if _fails(p, _bounds(carried + own, c["head_seq"], contiguous)):
            p, failures = c["head_end"], failures + c["head_failures"]
        else:
            piece = bisect_right(c["starts"], p) - 1
            # below the first failure of the piece nothing changes
            if c["failures"][piece]:
                p, failures = c["ends"][piece], failures + c["failures"][piece]
        memory = tail
    return found


# -- the automaton itself ----------------------------------------------------------------------


class Automaton:
    """Verdicts of rows in order, from the state a chunk is entered with."""

    def __init__(self, contiguous: bool, last: int | None, markets: set[str], failures: int) -> None:
        self.contiguous, self.last, self.markets, self.failures = contiguous, last, markets, failures

    def _judge(self, seq: int, present: bool, known: bool) -> str:
        if not present:
            return "SEQUENCE_NOT_OBSERVED"
        last = self.last
        if not known:
            return "SEQUENCE_PRESENT_SEMANTICS_UNKNOWN"
        if last is not None and seq <= last:
            return "SEQUENCE_DUPLICATE" if seq == last else "SEQUENCE_OUT_OF_ORDER"
        self.last = seq
        if last is None:
            return "SEQUENCE_PRESENT_SEMANTICS_UNKNOWN"
        if not self.contiguous:
            return "SEQUENCE_OBSERVED_MONOTONIC"
        return "SEQUENCE_CONTIGUITY_VERIFIED" if seq == last + 1 else "SEQUENCE_GAP_DETECTED"

    def take(self, row: tuple) -> tuple:
        """(ord, sequence state, status, reason, resync state, failures before the row)."""
        at, kind, market, seq, present, known, requested, static = row
        snapshot, delta = kind == "orderbook_snapshot", kind == "orderbook_delta"
        if snapshot and requested and not self.markets:
            self.last = None
        verdict = self._judge(seq, present, known)
        # a static fault outranks a sequence fault; only the latter restarts the segment
        fault = static or SEQUENCE_FAULTS.get(verdict)
        status, resync, failures = "NOT_APPLICABLE", "RESYNC_REQUIRED", self.failures
        if fault:
            status = "EXCLUDED"
        elif (snapshot or delta) and not requested:
            status = "EXCLUDED"
            fault = "MISSING_MARKET_TICKER" if market is None else "UNREQUESTED_MARKET_TICKER"
        elif snapshot or (delta and market in self.markets):
            if snapshot:
                self.markets.add(market)
            status, resync = "ADMITTED", "RESYNCED_WITH_SNAPSHOT"
        elif delta:
            status, fault, self.last = "EXCLUDED", "DELTA_BEFORE_SNAPSHOT", None
        if (snapshot or delta) and static is None and verdict in SEQUENCE_FAULTS:
            self.failures += 1
            self.markets, self.last = set(), None
        return at, verdict, status, fault, resync, failures


# -- Spark -------------------------------------------------------------------------------------

_VERDICT = (
    "ord bigint, sequence_state string, admission_status string, exclusion_reason string, resync_state string, "
    "failures bigint"
)


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _snapshots_before(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest clean snapshot of each market before each chunk: at most one entry per requested market."""
    clean = (F.col("native_type") == "orderbook_snapshot") & F.col("requested") & F.col("static_exclusion").isNull()
    latest = rows.groupBy(*keys, "_chunk", F.when(clean, F.col("market_ticker")).alias("_market")).agg(
        F.max("ord").alias("_at")
    )
    own = latest.groupBy(*keys, "_chunk").agg(
        F.collect_list(F.when(F.col("_market").isNotNull(), F.struct("_market", "_at"))).alias("_own")
    )

    def run(key: tuple, chunks: list[tuple]) -> Iterable[tuple]:
        held: dict[str, int] = {}
        for chunk, own in chunks:
            yield *key, chunk, sorted(held), [held[m] for m in sorted(held)]
            held.update((e["_market"], e["_at"]) for e in own)

    return map_groups(own, keys, ["_chunk"], ["_chunk", "_own"], run, f"{_ddl(own, [*keys, '_chunk'])}, {_HELD}")


def sequence_verdicts(rows: DataFrame, keys: Sequence[str], chunk: Column, contiguous: bool = False) -> DataFrame:
    """Sequence state and admission of every row.

    ``rows``: key columns, ord (unique per key), native_type, market_ticker, seq, seq_present,
    known (an eligible row with an integer sequence), requested (of a requested market),
    static_exclusion.  ``chunk`` must not decrease along ``ord`` and bounds what one task walks.
    Adds sequence_state, admission_status, exclusion_reason, resync_state and failures, the
    number of failures before the row.
    """
    keys = list(keys)
    place = [*keys, "_chunk"]
    narrow = stage(rows.select(*keys, chunk.alias("_chunk"), *_FACTS), "sequence-rows")
    at = _ddl(narrow, place)

    def summary(key: tuple, group: list[tuple]) -> Iterable[tuple]:
        markets, latest = group[0][-2:]
        facts = [r[: len(_FACTS)] for r in group[1:]]
        found = summarize(facts, dict(zip(markets, latest, strict=True)), contiguous)
        yield *key, *found.values(), markets, latest

    def enter(key: tuple, chunks: list[tuple]) -> Iterable[tuple]:
        names = [f.split()[0] for f in _SUMMARY.split(", ")]
        found = entries([dict(zip(names, c[1:], strict=False)) for c in chunks], contiguous)
        for c, (p, failures, last) in zip(chunks, found, strict=True):
            markets = [m for m, since in zip(c[-2], c[-1], strict=True) if since > p]
            yield *key, c[0], markets, failures, last

    def walk(key: tuple, group: list[tuple]) -> Iterable[tuple]:
        markets, failures, last = group[0][-3:]
        automaton = Automaton(contiguous, last, set(markets), failures)
        for r in group[1:]:
            yield *key[:-1], *automaton.take(r[: len(_FACTS)])

    def entered_rows(entry: DataFrame, extra: list[str], run, schema: str) -> DataFrame:
        # the row a chunk is entered with has no position and sorts before its rows
        both = narrow.unionByName(entry, allowMissingColumns=True)
        return map_groups(both, place, ["ord"], [*_FACTS, *extra], run, schema)

    before = _snapshots_before(narrow, keys)
    summaries = entered_rows(before, ["markets", "latest"], summary, f"{at}, {_SUMMARY}, {_HELD}")
    columns = summaries.columns[len(keys) :]
    entry = map_groups(
        summaries, keys, ["_chunk"], columns, enter, f"{at}, entered array<string>, before bigint, last bigint"
    )
    return entered_rows(entry, ["entered", "before", "last"], walk, f"{_ddl(narrow, keys)}, {_VERDICT}")
