"""Incremental book rebuild from native snapshot and delta rows.

The state of a book at a row is a sum: the latest good snapshot plus every delta since.
So instead of replaying rows one by one, rows get an *epoch* (count of good snapshots),
levels get running sums inside (book, epoch, side, price), and the first bad row of an
epoch decides which later rows are excluded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritymill.fixed import ORDERBOOK_TYPES, PRICE, QTY
from paritymill.functions.columns import canonical_json, dec, decimal_from_text, decimal_text
from paritymill.functions.folds import sorted_fold
from paritymill.functions.ordered import CHUNK_ROWS, chunk_of, scan
from paritymill.operators.books import LEVELS, level
from paritymill.session import stage

BOOK = ("market_ticker", "connection_id", "segment_id")
_LEVEL_TEXT = "array<array<string>>"


_FIELDS = (
    "side: string, price_dollars: string, delta_fp: string, "
    "yes_dollars_fp: string, no_dollars_fp: string"
)
_MESSAGE = f"struct<{_FIELDS}, msg: struct<{_FIELDS}>>"
_TYPED = f"array<struct<price: {PRICE}, quantity: {QTY}, paired: boolean>>"


def _typed_levels(levels: Column) -> Column:
    return F.transform(
        levels,
        lambda x: F.struct(
            decimal_from_text(F.try_element_at(x, F.lit(1)), PRICE).alias("price"),
            decimal_from_text(F.try_element_at(x, F.lit(2)), QTY).alias("quantity"),
            (F.size(x) == 2).alias("paired"),
        ),
    )


def _ladder_error(present: Column, text: Column, typed: Column) -> Column:
    prices = F.transform(typed, lambda x: x["price"])
    broken = F.exists(
        typed,
        lambda x: ~x["paired"] | x["price"].isNull() | x["quantity"].isNull() | (x["quantity"] < 0),
    )
    return (
        F.when(~present, F.lit(None).cast("string"))
        .when(text.isNull(), "SNAPSHOT_NULL_SIDE")
        .when(~text.startswith("["), "SNAPSHOT_WRONG_SIDE_TYPE")
        .when(typed.isNull() | broken, "MALFORMED_SNAPSHOT")
        .when(F.exists(typed, lambda x: ~x["price"].between(dec("0"), dec("1"))), "IMPOSSIBLE_PRICE")
        .when(F.size(F.array_distinct(prices)) != F.size(prices), "DUPLICATE_SNAPSHOT_PRICE")
    )


def parse_book_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed columns of native order-book messages, fields taken from the top or ``msg``.

    Adds side, price, delta, yes_levels, no_levels, yes_presence, no_presence and
    parse_error (null when the message is well formed).  The payload is parsed once; each
    step names what the next one reuses, so nothing is parsed twice.
    """
    raw = F.col(payload)
    snapshot = F.col("native_type") == "orderbook_snapshot"
    names = ("side", "price_dollars", "delta_fp", "yes_dollars_fp", "no_dollars_fp")
    parsed = df.withColumn("_m", F.from_json(raw, _MESSAGE)).withColumn("_v", F.try_parse_json(raw))

    def given(name: str) -> Column:
        """The value at the top or in ``msg``; nowhere else does a key count."""
        return F.coalesce(*[F.try_variant_get("_v", f"$.{p}{name}", "variant") for p in ("", "msg.")])

    # a bare JSON float or boolean is refused where exact decimal text is due
    loose = [F.schema_of_variant(given(n)).rlike("^(DECIMAL|DOUBLE|FLOAT|BOOLEAN)") for n in ("price_dollars", "delta_fp")]
    inexact = F.coalesce(loose[0], F.lit(False)) | F.coalesce(loose[1], F.lit(False))
    flat = parsed.select(
        *df.columns,
        *[F.coalesce(F.col(f"_m.{n}"), F.col(f"_m.msg.{n}")).alias(f"_{n}") for n in names],
        (snapshot & given("yes_dollars_fp").isNotNull()).alias("_has_yes"),
        (snapshot & given("no_dollars_fp").isNotNull()).alias("_has_no"),
        (~snapshot & inexact).alias("_inexact"),
    )
    typed = flat.withColumns(
        {
            "_yes": F.when(snapshot, F.from_json("_yes_dollars_fp", _LEVEL_TEXT)),
            "_no": F.when(snapshot, F.from_json("_no_dollars_fp", _LEVEL_TEXT)),
        }
    ).withColumns(
        {
            "_yes": _typed_levels(F.col("_yes")),
            "_no": _typed_levels(F.col("_no")),
            "_price": F.when(~snapshot & ~F.col("_inexact"), decimal_from_text(F.col("_price_dollars"), PRICE)),
            "_wide": F.when(~snapshot & ~F.col("_inexact"), F.col("_price_dollars").try_cast("decimal(38,18)")),
            "_delta": F.when(~snapshot & ~F.col("_inexact"), decimal_from_text(F.col("_delta_fp"), QTY)),
        }
    )
    delta_error = (
        F.when(~F.coalesce(F.col("_side").isin("yes", "no"), F.lit(False)), "MALFORMED_DELTA")
        .when(F.col("_wide").isNull() | F.col("_delta").isNull(), "MALFORMED_DELTA")
        .when(~F.col("_wide").between(0, 1), "IMPOSSIBLE_PRICE")
        .when(F.col("_price").isNull(), "MALFORMED_DELTA")
    )
    snapshot_error = F.when(~F.col("_has_yes") & ~F.col("_has_no"), "SNAPSHOT_BOTH_SIDES_OMITTED").otherwise(
        F.coalesce(
            _ladder_error(F.col("_has_yes"), F.col("_yes_dollars_fp"), F.col("_yes")),
            _ladder_error(F.col("_has_no"), F.col("_no_dollars_fp"), F.col("_no")),
        )
    )

    def kept(name: str) -> Column:
        filled = F.filter(F.coalesce(name, F.array().cast(_TYPED)), lambda x: x["quantity"] != 0)
        return F.when(snapshot, F.transform(filled, lambda x: level(x["price"], x["quantity"])))

    def presence(has: str, name: str) -> Column:
        return F.when(
            snapshot,
            F.when(~F.col(has), "OMITTED_CONFIRMED_EMPTY")
            .when(F.size(name) > 0, "PRESENT_NONEMPTY")
            .otherwise("PRESENT_EMPTY"),
        )

    return typed.select(
        *df.columns,
        F.when(snapshot, snapshot_error).otherwise(delta_error).alias("parse_error"),
        F.when(~snapshot, F.col("_side")).alias("side"),
        F.col("_price").alias("price"),
        F.col("_delta").alias("delta"),
        kept("_yes").alias("yes_levels"),
        kept("_no").alias("no_levels"),
        presence("_has_yes", "_yes").alias("yes_presence"),
        presence("_has_no", "_no").alias("no_presence"),
    )


def segment_contradictions(
    df: DataFrame, identity: Sequence[str], explicit_unified: bool | None = None
) -> DataFrame:
    """Mark rows of a segment from its first identity or pricing contradiction on.

    ``identity`` columns must keep their first non-null value per (connection, segment,
    channel), market_id per market, and use_yes_price (array of observed JSON values as
    text) per segment.  A later snapshot does not recover.  First values come from one
    combining aggregate, so no segment is ever ordered in one task.
    """
    seg = ["connection_id", "segment_id"]

    def first_of(keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
        aggs = [
            F.min_by(c, F.when(c.isNotNull(), F.col("row_index"))).alias(f"_first_{n}")
            for n, c in columns.items()
        ]
        return df.groupBy(*keys).agg(*aggs)

    observed = F.array_distinct(F.coalesce("use_yes_price", F.array().cast("array<string>")))
    mode = F.when(
        (F.size(observed) == 1) & F.try_element_at(observed, F.lit(1)).isin("true", "false"),
        F.try_element_at(observed, F.lit(1)),
    )
    by_channel = first_of([*seg, "channel"], {c: F.col(c) for c in identity})
    by_market = first_of([*seg, "market_ticker"], {"market_id": F.col("market_id")})
    by_segment = first_of(seg, {"mode": mode})
    rows = (
        df.withColumns({"_observed": observed, "_mode": mode})
        .join(by_channel, [*seg, "channel"], "left")
        .join(
            by_market.where(F.col("market_ticker").isNotNull()), [*seg, "market_ticker"], "left"
        )
        .join(by_segment, seg, "left")
    )
    changed = F.lit(False)
    for c in identity:
        changed = changed | F.coalesce(F.col(c) != F.col(f"_first_{c}"), F.lit(False))
    unrequested = F.coalesce(
        ~F.array_contains("requested_market_tickers", F.col("market_ticker")), F.lit(False)
    )
    other_id = F.coalesce(F.col("market_id") != F.col("_first_market_id"), F.lit(False))
    start = F.lit(None).cast("string") if explicit_unified is None else F.lit(str(explicit_unified).lower())
    known = F.coalesce(start, F.col("_first_mode"))
    strange = F.exists("_observed", lambda x: ~F.coalesce(x.isin("true", "false"), F.lit(False)))
    reason = (
        F.when(changed | unrequested | other_id, "IDENTITY_MISMATCH")
        .when(strange, "UNKNOWN_PRICING_MODE")
        .when(F.size("_observed") > 1, "CONTRADICTORY_PRICING_MODE")
        .when(F.coalesce(F.col("_mode") != known, F.lit(False)), "CONTRADICTORY_PRICING_MODE")
    )
    judged = rows.withColumn("_reason", reason)
    first_bad = judged.where(F.col("_reason").isNotNull()).groupBy(*seg).agg(
        F.min("row_index").alias("_bad_from"),
        F.min_by("_reason", "row_index").alias("_bad_reason"),
    )
    out = judged.join(first_bad, seg, "left")
    return out.select(
        *df.columns,
        F.when(F.col("row_index") >= F.col("_bad_from"), F.col("_bad_reason")).alias("segment_error"),
    )


def _with_epoch(df: DataFrame, chunk_rows: int) -> DataFrame:
    """Epoch and position of every row in its book.

    The scan reads its rows twice, so they are written parsed: the messages are parsed once.
    """
    df = stage(df, "book-messages")
    good = (F.col("native_type") == "orderbook_snapshot") & F.col("parse_error").isNull()
    return scan(
        df.withColumn("_good", good),
        BOOK,
        ["row_index"],
        chunk_of(F.col("row_index"), chunk_rows),
        running={
            "epoch": ("sum", F.col("_good").cast("bigint")),
            "_n": ("sum", F.lit(1).cast("bigint")),
        },
    )


_CHANGES = f"array<struct<side: string, price: {PRICE}, change: {QTY}>>"


def _changes() -> Column:
    """Level changes a message makes: every snapshot level, or the one delta."""

    def tagged(levels: str, side: str) -> Column:
        return F.transform(
            F.coalesce(levels, F.array().cast(LEVELS)),
            lambda x: F.struct(
                F.lit(side).alias("side"), x["price"].alias("price"), x["quantity"].alias("change")
            ),
        )

    one = F.array(F.struct("side", "price", F.col("delta").alias("change")))
    ladders = F.concat(tagged("yes_levels", "yes"), tagged("no_levels", "no"))
    return F.when(F.col("native_type") == "orderbook_snapshot", ladders).otherwise(one).cast(_CHANGES)


def _level_changes(rows: DataFrame) -> DataFrame:
    """One row per changed level of the well-formed messages."""
    changes = _changes()
    usable = rows.where(F.col("parse_error").isNull() & (F.col("epoch") > 0))
    kept = [*BOOK, "epoch", "row_index", *(["_n"] if "_n" in rows.columns else [])]
    return usable.select(*kept, F.explode(changes).alias("_c")).select(*kept, "_c.*")


def _levels(rows: DataFrame, chunk_rows: int) -> DataFrame:
    return scan(
        _level_changes(rows),
        [*BOOK, "epoch", "side", "price"],
        ["row_index"],
        chunk_of(F.col("row_index"), chunk_rows),
        running={"quantity": ("sum", F.col("change").cast("decimal(28,8)"))},
    )


def _epochs(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """One row per (book, epoch): where it starts, where it breaks, frames before it."""
    label = F.when(
        (F.col("epoch") == 0) & (F.col("native_type") == "orderbook_delta"), "DELTA_BEFORE_SNAPSHOT"
    ).otherwise(F.col("parse_error"))
    shaped = rows.select(
        *BOOK, "epoch", "row_index", "_n", F.lit(1).cast("bigint").alias("_row"),
        F.when((F.col("epoch") == 0) | F.col("parse_error").isNotNull(), label).alias("_bad"),
    )
    negative = _levels(rows, chunk_rows).where(F.col("quantity") < 0).select(
        *BOOK, "epoch", "row_index", "_n", F.lit(0).cast("bigint").alias("_row"),
        F.lit("NEGATIVE_RESULTING_QUANTITY").alias("_bad"),
    )
    when_bad = F.when(F.col("_bad").isNotNull(), F.col("row_index"))
    epochs = shaped.unionByName(negative).groupBy(*BOOK, "epoch").agg(
        F.min("_n").alias("start_n"),
        F.sum("_row").alias("rows"),
        F.min(when_bad).alias("bad_from"),
        F.min_by(F.struct("_n", "_bad"), when_bad).alias("_at"),
    )
    good_rows = F.when(F.col("bad_from").isNull(), F.col("rows")).otherwise(
        F.col("_at._n") - F.col("start_n")
    )
    table = stage(
        epochs.select(
            *BOOK, "epoch", "start_n", "bad_from", F.col("_at._bad").alias("bad_reason"),
            good_rows.alias("frames"),
        ),
        "book-epochs",
    )
    return scan(
        table, BOOK, ["epoch"], chunk_of(F.col("epoch"), chunk_rows),
        prior={"_bad_before": F.col("bad_from").isNotNull()},
        exclusive={"frames_before": ("sum", F.col("frames"))},
    )


def rebuild_books(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Disposition of every admitted order-book row.

    Input: BOOK columns, row_index (unique per book), native_type and the columns of
    ``parse_book_messages``.  Adds epoch, disposition, reason, reset_reason, frame_count.
    The rows are staged before and after the epoch scan.  Rows meet their epoch facts in one
    join on (book, epoch); the facts are one row per snapshot, so a hot epoch is a skewed
    probe side only, which adaptive execution splits or broadcasts past.
    """
    rows = stage(_with_epoch(df, chunk_rows), "book-rows")
    placed = rows.join(_epochs(rows, chunk_rows), [*BOOK, "epoch"])
    at_bad = F.coalesce(F.col("row_index") == F.col("bad_from"), F.lit(False))
    bad_snapshot = (F.col("native_type") == "orderbook_snapshot") & F.col("parse_error").isNotNull()
    framed = F.col("bad_from").isNull() | (F.col("row_index") < F.col("bad_from"))
    disposition = (
        F.when(bad_snapshot | at_bad, "QUARANTINED").when(framed, "FRAME_EMITTED").otherwise("EXCLUDED")
    )
    reason = (
        F.when(bad_snapshot, F.col("parse_error"))
        .when(at_bad, F.col("bad_reason"))
        .when(~framed, "SEGMENT_INVALID")
    )
    reset = F.when(
        F.col("_good"),
        F.when(F.coalesce("_bad_before", F.lit(False)), "RECOVERY_AFTER_INVALIDATION")
        .when(F.col("epoch") == 1, "INITIAL_SNAPSHOT")
        .otherwise("RESNAPSHOT_SAME_SEGMENT"),
    )
    in_epoch = F.least(F.col("_n") - F.col("start_n") + 1, F.col("frames"))
    return placed.select(
        *df.columns,
        "epoch",
        disposition.alias("disposition"),
        reason.alias("reason"),
        reset.alias("reset_reason"),
        (F.coalesce("frames_before", F.lit(0)) + in_epoch).cast("bigint").alias("frame_count"),
    )


def _entering_ladders(frames: DataFrame, chunk_rows: int) -> DataFrame:
    """Ladder each (book, epoch, chunk) starts from, one row of changes per chunk.

    Changes are summed per level and chunk first, so only chunk totals are ordered; a
    level is repeated once per later chunk of its book that has rows, never per row.
    """
    changes = _level_changes(frames)
    per_chunk = changes.groupBy(
        *BOOK, "epoch", "side", "price", chunk_of(F.col("row_index"), chunk_rows).alias("chunk")
    ).agg(F.sum("change").cast("decimal(28,8)").alias("change"))
    # the book's own chunks, numbered without gaps: quiet stretches of the index cost nothing
    own = frames.select(*BOOK, "epoch", chunk_of(F.col("row_index"), chunk_rows).alias("chunk")).distinct()
    book = Window.partitionBy(*BOOK, "epoch")
    own = own.withColumns({"step": F.row_number().over(book.orderBy("chunk")), "steps": F.count(F.lit(1)).over(book)})
    # rows of this window are the chunks of one level: at most rows / chunk_rows of them
    w = Window.partitionBy(*BOOK, "epoch", "side", "price").orderBy("step")
    held = per_chunk.join(own, [*BOOK, "epoch", "chunk"]).select(
        *BOOK, "epoch", "side", "price", "step", "steps",
        F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(QTY).alias("change"),
        F.lead("step").over(w).alias("next_step"),
    )
    upto = F.coalesce("next_step", "steps")
    spread = held.where((F.col("change") > 0) & (upto > F.col("step"))).select(
        *BOOK, "epoch", F.explode(F.sequence(F.col("step") + 1, upto)).alias("step"), "side", "price", "change",
    ).join(own.select(*BOOK, "epoch", "step", "chunk"), [*BOOK, "epoch", "step"])
    return spread.groupBy(*BOOK, "epoch", "chunk").agg(
        F.collect_list(F.struct("side", "price", "change")).alias("changes")
    )


def book_frames(
    rebuilt: DataFrame, unified: bool = False, chunk_rows: int = CHUNK_ROWS, ladders: bool = True
) -> DataFrame:
    """Canonical frame of every emitted row.

    Each (book, epoch, chunk) is folded on its own from the ladder it starts with, so the
    longest sequential piece is ``chunk_rows`` rows whatever the size of the book.
    ``unified`` books quote the NO side as YES prices already.
    """
    frames = rebuilt.where(F.col("disposition") == "FRAME_EMITTED")
    messages = frames.select(
        *BOOK, "epoch",
        chunk_of(F.col("row_index"), chunk_rows).alias("chunk"),
        F.col("row_index").cast("bigint").alias("row_index"),
        _changes().alias("changes"),
    )
    carried = _entering_ladders(frames, chunk_rows).select(
        *BOOK, "epoch", "chunk", F.lit(-1).cast("bigint").alias("row_index"), F.col("changes").cast(_CHANGES)
    )

    def start(_key):
        return {"yes": {}, "no": {}}

    def ask_of(price):
        return price if unified else 1 - price

    def step(state, row):
        for c in row.changes:
            side = state[c["side"]]
            left = side.get(c["price"], 0) + c["change"]
            if left == 0:
                side.pop(c["price"], None)
            else:
                side[c["price"]] = left
        if row.row_index < 0:
            return None
        yes, no = state["yes"], state["no"]
        bid = max(yes) if yes else None
        worst = (min(no) if unified else max(no)) if no else None
        ask = None if worst is None else ask_of(worst)
        if bid is None and ask is None:
            shape = "EMPTY"
        elif ask is None:
            shape = "YES_BIDS_ONLY"
        elif bid is None:
            shape = "YES_ASKS_ONLY"
        else:
            shape = "CROSSED" if bid > ask else "LOCKED" if bid == ask else "TWO_SIDED"
        head = (
            row.market_ticker, row.connection_id, row.segment_id, row.epoch, row.row_index,
            bid, yes.get(bid), ask, no.get(worst), len(yes), len(no), shape,
        )
        if not ladders:
            return head
        bids = [{"price": p, "quantity": yes[p]} for p in sorted(yes, reverse=True)]
        asks = sorted(({"price": ask_of(p), "quantity": q} for p, q in no.items()), key=lambda x: x["price"])
        return (*head, bids, asks)

    schema = (
        "market_ticker string, connection_id string, segment_id string, epoch bigint, row_index bigint, "
        f"best_bid {PRICE}, best_bid_size {QTY}, best_ask {PRICE}, best_ask_size {QTY}, "
        "bid_level_count bigint, ask_level_count bigint, book_state string"
    )
    if ladders:
        schema += f", bids {LEVELS}, asks {LEVELS}"
    return sorted_fold(
        messages.unionByName(carried), [*BOOK, "epoch", "chunk"], ["row_index"], start, step, schema
    )


def top_of_book(rebuilt: DataFrame, unified: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Best prices and book state of every emitted row, without the ladders."""
    return book_frames(rebuilt, unified, chunk_rows, ladders=False)


def with_frame_hash(frames: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """SHA-256 of each frame's canonical record."""

    def side(name: str) -> Column:
        return F.transform(
            name,
            lambda x: F.struct(
                decimal_text(x["price"]).alias("price"), decimal_text(x["quantity"]).alias("quantity")
            ),
        )

    fields = {
        **{c: F.col(c) for c in (*BOOK, "row_index", "book_state", *extra)},
        "canonical_yes_bids": side("bids"),
        "canonical_yes_asks": side("asks"),
    }
    return frames.withColumn("frame_hash", F.sha2(canonical_json(fields), 256))


def native_book_rows(df: DataFrame) -> DataFrame:
    """Admitted order-book rows of a named market: other rows never touch a book."""
    return df.where(
        F.col("native_type").isin(*ORDERBOOK_TYPES)
        & F.col("market_ticker").isNotNull()
        & (F.col("admission_status") == "ADMITTED")
        & F.col("exclusion_reason").isNull()
    )
