"""Event-sourced paper ledger: fills, settlements and average cost."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritymill.fixed import (
    PAPER_FILL_RECORD,
    PAPER_SETTLEMENT_RECORD,
    PRICE,
    PROPOSAL_RECORD,
    TOTAL,
)
from paritymill.functions.columns import digest
from paritymill.functions.folds import sorted_fold
from paritymill.functions.ordered import CHUNK_ROWS, SLOTS, chunk_of, scan, scan_net
from paritymill.session import stage

_QTY = "decimal(28,8)"
_SIDE = ["proposal_id", "side"]
_FINE = Decimal(1).scaleb(-18)
_HASHES = ("candidate_hash", "simulation_hash")
STRETCH_RUNS = 16_384
TASK_ROWS = 1 << 20
HOT_STRETCHES = 32  # proposals of a hash slot with more than so many times STRETCH_RUNS rows are cut into chunks


def classify_events(events: DataFrame, order: Sequence[str], chunk: Column) -> DataFrame:
    """Ledger rows with the mismatch of their proposal link, if any.

    Each row is linked to the latest earlier proposal row of its id: a later proposal
    row replaces an earlier one from there on.
    """
    linked = scan(events, ["proposal_id"], order, chunk, running={"_link": ("last", _link())})
    return linked.withColumn("mismatch", _mismatch()).drop("_link")


def _link() -> Column:
    return F.when(F.col("record_type") == PROPOSAL_RECORD, F.struct("candidate_hash", "simulation_hash"))


def _mismatch() -> Column:
    """What is wrong with the link of a row to its proposal, ``_link``, if anything."""
    is_proposal = F.col("record_type") == PROPOSAL_RECORD
    fill = F.col("record_type") == PAPER_FILL_RECORD
    settle = F.col("record_type") == PAPER_SETTLEMENT_RECORD
    return (
        F.when(~is_proposal & ~fill & ~settle, "unsupported_record_type")
        .when((fill | settle) & F.col("_link").isNull(), "unknown_proposal")
        .when(fill & ~F.col("candidate_hash").eqNullSafe(F.col("_link.candidate_hash")), "candidate_hash_mismatch")
        .when(fill & ~F.col("simulation_hash").eqNullSafe(F.col("_link.simulation_hash")), "simulation_hash_mismatch")
    )


def _linked_rows(rows: DataFrame, order: Sequence[str], total: int) -> DataFrame:
    """Fills, settlements and mismatches in order, all rows of a proposal in one partition.

    The only shuffle of the rows, ``total`` of them, into as many tasks as can sort them in
    memory.  Proposals stop here, and so do the digests.
    """
    tasks = -(-total // TASK_ROWS)
    more = [tasks] if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    upto = Window.partitionBy("proposal_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the type of a record travels as a letter
    letters = {PROPOSAL_RECORD: "p", PAPER_FILL_RECORD: "f", PAPER_SETTLEMENT_RECORD: "s"}
    kind, back = F.when(F.col("record_type").isNotNull(), "?"), F.when(F.col("_kind") == "?", "?")
    for name, letter in letters.items():
        kind = F.when(F.col("record_type") == name, letter).otherwise(kind)
        back = F.when(F.col("_kind") == letter, name).otherwise(back)
    light = rows.withColumn("_kind", kind).drop("record_type").repartition(*more, "proposal_id").withColumn("record_type", back)
    linked = light.withColumn("_link", F.last(_link(), ignorenulls=True).over(upto)).withColumn("mismatch", _mismatch())
    fill = F.col("record_type") == PAPER_FILL_RECORD
    settle = F.col("record_type") == PAPER_SETTLEMENT_RECORD
    return linked.where(F.col("mismatch").isNotNull() | fill | settle).select(
        "proposal_id", "side", "event_key", F.col("mismatch").alias("reason"), fill.alias("fill"),
        F.col("quantity").cast(_QTY).alias("quantity"),
        F.when(fill, (F.col("price") * F.col("quantity")).cast(TOTAL)).alias("cost"),
        F.when(fill, F.col("fee").cast(TOTAL)).alias("fee"),
        F.when(settle, F.col("payout_per_contract")).alias("payout"),
        *[c for c in order if c != "event_key"],
    )


def _fold_inputs(usable: DataFrame, order: Sequence[str], chunk: Column) -> DataFrame:
    """Fills summed up between settlements, and independent stretches of a position.

    Average cost only matters at a settlement, so the fills before one are added first,
    on the map side.  A position that never runs short resets whenever it reaches zero;
    those resets cut a position of more than ``STRETCH_RUNS`` settlements into stretches that
    fold separately.
    """
    settle = F.col("record_type") == PAPER_SETTLEMENT_RECORD
    change = F.when(settle, -F.col("quantity")).otherwise(F.col("quantity")).cast(_QTY)
    netted = scan_net(
        usable.withColumn("_change", change), _SIDE, order, chunk, F.col("_change"), "min", "_net", "_low",
        sums={"_settled": settle.cast("bigint")},
    )
    fill = ~settle
    runs = stage(
        netted.groupBy(*_SIDE, (F.col("_settled") - settle.cast("bigint")).alias("run")).agg(
            F.count_if(fill).alias("fills"),
            F.sum(F.when(fill, F.col("quantity").cast(_QTY))).cast(_QTY).alias("fill_quantity"),
            F.sum(F.when(fill, (F.col("price") * F.col("quantity")).cast(TOTAL))).cast(TOTAL).alias("fill_cost"),
            F.sum(F.when(fill, F.col("fee"))).cast(TOTAL).alias("fill_fee"),
            F.max(F.when(settle, F.col("event_key"))).alias("settle_key"),
            F.max(F.when(settle, F.col("quantity").cast(_QTY))).alias("settle_quantity"),
            F.max(F.when(settle, F.col("payout_per_contract"))).alias("payout"),
            F.min("_net").alias("_least"),
            F.max(F.when(settle, (F.col("_net") == 0) & (F.col("quantity") > 0))).alias("_emptied"),
        ),
        "ledger-runs",
    )
    # at most one side in STRETCH_RUNS runs is cut, so the table of them is small
    sides = runs.groupBy(*_SIDE).agg(F.count(F.lit(1)).alias("_runs"), F.min("_least").alias("_least"))
    cut = F.broadcast(sides.where((F.col("_runs") > STRETCH_RUNS) & (F.col("_least") >= 0)).select(*_SIDE))
    stretch = F.coalesce("_zero", F.lit(0)).cast("bigint").alias("stretch")
    columns = [c for c in runs.columns if c not in ("_least", "_emptied")]
    long = scan(
        runs.join(cut, _SIDE, "left_semi"), _SIDE, ["run"], chunk_of(F.col("run"), CHUNK_ROWS),
        exclusive={"_zero": ("sum", F.coalesce("_emptied", F.lit(False)).cast("bigint"))},
    ).select(*columns, stretch)
    whole = runs.join(cut, _SIDE, "left_anti").select(*columns, F.lit(0).cast("bigint").alias("stretch"))
    return whole.unionByName(long)


_OUT = (
    f"kind string, proposal_id string, side string, stretch bigint, event_key string, accepted boolean, "
    f"quantity {_QTY}, average_price {PRICE}, amount {TOTAL}, reason string"
)


def _start(key):
    # a stretch after the first begins with a position that exists and is empty
    exists = key[2] is not None and key[2] > 0
    return {"key": key, "quantity": Decimal(0), "cost": Decimal(0), "fees": Decimal(0), "exists": exists}


def _step(state, row):
    if row.fills:
        _add(state, row.fill_quantity, row.fill_cost, row.fill_fee)
    return None if row.settle_key is None else _settle(state, row.settle_key, row.settle_quantity, row.payout)


def _add(state, quantity, cost, fee):
    state["exists"] = True
    state["quantity"] += quantity
    state["cost"] += cost
    state["fees"] += fee


def _settle(state, event_key, size, payout):
    if not state["exists"] or state["quantity"] < size:
        return ("settlement", *state["key"], event_key, False, size, None, None, None)
    average = state["cost"] / state["quantity"] if state["quantity"] > 0 else Decimal(0)
    state["quantity"] -= size
    state["cost"] = state["cost"] - average * size if state["quantity"] else Decimal(0)
    pnl = (payout - average) * size
    return ("settlement", *state["key"], event_key, True, size, average.quantize(_FINE), pnl.quantize(_FINE), None)


def _finish(state):
    if not state["exists"]:
        return None
    average = state["cost"] / state["quantity"] if state["quantity"] > 0 else Decimal(0)
    return (
        "position", *state["key"], None, None, state["quantity"],
        average.quantize(_FINE), state["fees"].quantize(_FINE), None,
    )


def _start_whole(key):
    return {"proposal": key[0], "sides": {}}


def _step_whole(state, row):
    """A row of a proposal that is walked whole: its sides have states of their own, and no stretch."""
    key = (state["proposal"], row.side, None)
    if row.reason is not None:
        return ("mismatch", *key, row.event_key, None, None, None, None, row.reason)
    side = state["sides"].get(row.side)
    if side is None:
        side = state["sides"][row.side] = _start(key)
    if not row.fill:
        return _settle(side, row.event_key, row.quantity, row.payout)
    _add(side, *[Decimal(0) if x is None else x for x in (row.quantity, row.cost, row.fee)])
    return None


def _finish_whole(state):
    return [made for made in map(_finish, state["sides"].values()) if made is not None]


def _hot_fold(rows: DataFrame, order: Sequence[str], chunk: Column) -> DataFrame:
    """What ``replay_ledger`` folds, for proposals of more rows than a task should walk."""
    classified = stage(classify_events(rows, order, chunk).drop(*_HASHES), "ledger-events")
    usable = classified.where(
        F.col("mismatch").isNull() & (F.col("record_type") != PROPOSAL_RECORD)
    ).select(
        "record_type", *_SIDE, "price", "quantity", "fee", "payout_per_contract", "event_key",
        *[c for c in order if c != "event_key"],
    )
    made = sorted_fold(
        _fold_inputs(usable, order, chunk), [*_SIDE, "stretch"], ["run"], _start, _step, _OUT, _finish
    )
    lost = classified.where(F.col("mismatch").isNotNull()).select(
        F.lit("mismatch").alias("kind"), *_SIDE, "event_key", F.col("mismatch").alias("reason")
    )
    return made.unionByName(lost, allowMissingColumns=True)


def replay_ledger(events: DataFrame, order: Sequence[str], chunk: Column) -> dict[str, DataFrame]:
    """Replay proposals, fills and settlements.

    ``events``: record_type, proposal_id, candidate_hash, simulation_hash, side, price,
    quantity, fee, payout_per_contract, event_key (unique text) and the ``order`` columns.
    Returns tables: ``events`` (classified), ``settlements``, ``positions`` (emptied ones
    included), ``mismatches`` and ``state`` (one row of totals).  The rows travel once, to the
    task of their proposal; only proposals of very many rows are cut into chunks.
    """
    # the hashes are only compared: digests travel in their place, and no further than that
    digests = {c: digest(F.col(c)) for c in _HASHES}
    needed = ["record_type", *_SIDE, "price", "quantity", "fee", "payout_per_contract", "event_key", *_HASHES]
    rows = events.withColumns(digests).select(*needed, *[c for c in order if c not in needed])
    slot = F.pmod(F.xxhash64("proposal_id"), F.lit(SLOTS)).cast("int")
    counts = events.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
    many = F.when(F.col("rows") > HOT_STRETCHES * STRETCH_RUNS, F.col("slot"))
    total, hot = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.collect_list(many)).first()
    # no more than a task can walk: they are linked, ordered and folded where they are
    whole = rows.where(~slot.isin(hot)) if hot else rows
    made = sorted_fold(
        _linked_rows(whole, order, total), ["proposal_id"], order, _start_whole, _step_whole, _OUT, _finish_whole,
        placed=True,
    )
    if hot:
        made = made.unionByName(_hot_fold(events.withColumns(digests).where(slot.isin(hot)), order, chunk))
    folded = stage(made, "ledger-fold")
    settlements = folded.where(F.col("kind") == "settlement").select(
        "event_key", *_SIDE, "accepted", "quantity", "average_price", F.col("amount").alias("realized_pnl")
    )
    parts = folded.where(F.col("kind") == "position")
    cut = parts.where(F.col("stretch").isNotNull()).groupBy(*_SIDE).agg(
        F.max_by(F.struct("quantity", "average_price"), "stretch").alias("_last"),
        F.sum("amount").cast(TOTAL).alias("fees_paid"),
    ).select(*_SIDE, "_last.*", "fees_paid")
    positions = parts.where(F.col("stretch").isNull()).select(
        *_SIDE, "quantity", "average_price", F.col("amount").alias("fees_paid")
    )
    if hot:
        positions = positions.unionByName(cut)
    rejected = settlements.where(~F.col("accepted")).select(
        "event_key", "proposal_id", F.lit("settlement_exceeds_position").alias("reason")
    )
    mismatches = folded.where(F.col("kind") == "mismatch").select(
        "event_key", "proposal_id", "reason"
    ).unionByName(rejected)
    kind = F.col("record_type")
    zero = F.lit(0).cast(TOTAL)
    counts = events.agg(
        F.count_if(kind == PROPOSAL_RECORD).alias("paper_order_count"),
        F.count_if(kind == PAPER_FILL_RECORD).alias("paper_fill_count"),
        F.count_if(kind == PAPER_SETTLEMENT_RECORD).alias("settlement_count"),
    )
    made = F.col("kind")
    results = folded.agg(
        F.coalesce(F.sum(F.when(made == "position", F.col("amount"))).cast(TOTAL), zero).alias("total_fees"),
        F.coalesce(F.sum(F.when(made == "settlement", F.col("amount"))).cast(TOTAL), zero).alias("realized_gross_pnl"),
        F.count_if(made == "mismatch").alias("_unlinked"),
        F.count_if((made == "settlement") & ~F.col("accepted")).alias("_rejected"),
    )
    # both sides are ungrouped aggregates: exactly one row each, whatever the data
    state = counts.join(results, F.lit(True)).select(
        "paper_order_count", "paper_fill_count", "settlement_count", "total_fees", "realized_gross_pnl",
        (F.col("realized_gross_pnl") - F.col("total_fees")).cast(TOTAL).alias("realized_net_pnl"),
        (F.col("_unlinked") + F.col("_rejected")).alias("reconciliation_mismatch_count"),
    )
    return {
        "events": classify_events(events, order, chunk),
        "settlements": settlements,
        "positions": positions,
        "mismatches": mismatches,
        "state": state,
    }
