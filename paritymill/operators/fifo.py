"""First-in-first-out attribution of fills without a per-instrument loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, QTY, TOTAL
from paritymill.functions.ordered import scan, scan_net
from paritymill.session import stage

_CUM = "decimal(28,8)"


def fifo_matches(fills: DataFrame, chunk: Column, quantity_chunk: int = 1_000_000) -> DataFrame:
    """Matched pieces (instrument_id, quantity, buy_price, sell_price).

    On the axis of cumulative matched quantity every buy covers one interval and every
    sell covers another.  Sorting the interval ends and filling prices backwards pairs
    them piece by piece: no lot queue, and no join of buys with sells.  A sell beyond the
    inventory is unmatched and not carried short; ``net`` and its running minimum give
    exactly the part that is.
    ``chunk`` bounds rows per key along ``ord``; ``quantity_chunk`` does along the axis.
    """
    buy = F.col("side") == "buy"
    quantity = F.col("quantity").cast(_CUM)
    signed = F.when(buy, quantity).otherwise(-quantity)
    src = fills.select("instrument_id", "side", "price", "quantity", "ord")
    bought = scan_net(
        src.withColumns(
            {"_signed": signed, "_buys": F.when(buy, quantity).otherwise(F.lit(0).cast(_CUM))}
        ),
        ["instrument_id"], ["ord"], chunk, F.col("_signed"), "min", "_net", "_low",
        sums={"_bought": F.col("_buys")},
    )
    net_before = F.col("_net") - F.col("_signed")
    short_before = -F.col("_low")
    short_after = F.greatest(short_before, -F.col("_net"))
    matched_before = F.col("_bought") - F.col("_buys") - net_before - short_before
    matched_after = F.col("_bought") - F.col("_net") - short_after
    end = F.when(buy, F.col("_bought")).otherwise(matched_after).cast(_CUM)
    length = F.when(buy, F.col("_buys")).otherwise(matched_after - matched_before)
    ends = bought.where(length > 0).select(
        "instrument_id",
        (-end).cast(_CUM).alias("back"),
        F.when(buy, F.col("price")).alias("buy_price"),
        F.when(~buy, F.col("price")).alias("sell_price"),
        F.when(buy, 0).otherwise(1).alias("kind"),
    )
    origin = src.groupBy("instrument_id").agg(
        F.lit(0).cast(_CUM).alias("back"),
        F.lit(None).cast(PRICE).alias("buy_price"),
        F.lit(None).cast(PRICE).alias("sell_price"),
        F.lit(2).alias("kind"),
    )
    points = stage(ends.unionByName(origin), "fifo-points")
    # walking back from the far end, the piece before a point takes the nearest later prices
    walked = scan(
        points, ["instrument_id"], ["back", "kind"],
        F.floor(F.col("back") / F.lit(quantity_chunk)).cast("bigint"),
        prior={"_next": F.col("back")},
        exclusive={"_buy": ("last", F.col("buy_price")), "_sell": ("last", F.col("sell_price"))},
    )
    piece = (F.col("back") - F.col("_next")).cast(QTY)
    return walked.where((piece > 0) & F.col("_buy").isNotNull() & F.col("_sell").isNotNull()).select(
        "instrument_id", piece.alias("quantity"), F.col("_buy").alias("buy_price"),
        F.col("_sell").alias("sell_price"),
    )


def fifo_attribution(fills: DataFrame, chunk: Column, quantity_chunk: int = 1_000_000) -> DataFrame:
    """Realized gross and net PnL, fees and ending inventory per instrument."""
    gain = (F.col("sell_price") - F.col("buy_price")).cast(PRICE) * F.col("quantity")
    realized = (
        fifo_matches(fills, chunk, quantity_chunk)
        .groupBy("instrument_id")
        .agg(F.sum(gain.cast(TOTAL)).cast(TOTAL).alias("gross"))
    )
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    totals = fills.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("supplied_fills"),
        F.sum("fee").cast(TOTAL).alias("total_fees"),
        F.sum(signed).alias("ending_inventory"),
    )
    gross = F.coalesce("gross", F.lit(0).cast(TOTAL))
    return totals.join(realized, "instrument_id", "left").select(
        "instrument_id", "supplied_fills", "total_fees",
        gross.alias("realized_gross_pnl"),
        (gross - F.col("total_fees")).cast(TOTAL).alias("realized_net_pnl"),
        "ending_inventory",
    )


def attribution_total(per_instrument: DataFrame) -> DataFrame:
    """The one-row report over all instruments."""
    columns = ("supplied_fills", "total_fees", "realized_gross_pnl", "realized_net_pnl", "ending_inventory")
    return per_instrument.agg(*[F.sum(c).alias(c) for c in columns])
