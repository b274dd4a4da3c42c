"""Fair value, quote bands and quote hysteresis."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, QTY
from paritymill.functions.columns import clamp, dec
from paritymill.functions.folds import sorted_fold
from paritymill.functions.ordered import scan

PRICE_WIDE = "decimal(30,18)"


def midpoint(offset: str = "0.01") -> Callable[[Column, Column], Column]:
    """Midpoint, else the one side shifted by ``offset`` and kept inside [0, 1]."""

    def estimate(bid: Column, ask: Column) -> Column:
        step = dec(offset)
        return (
            F.when(bid.isNotNull() & ask.isNotNull(), ((bid + ask) * dec("0.5", "decimal(2,1)")).cast(PRICE))
            .when(bid.isNotNull(), F.least((bid + step).cast(PRICE), dec("1")))
            .when(ask.isNotNull(), F.greatest((ask - step).cast(PRICE), dec("0")))
        )

    return estimate


def fair_value(df: DataFrame, model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Fair value from best_bid / best_ask; null, with an error, when the book is empty."""
    estimate = (model or midpoint())(F.col("best_bid"), F.col("best_ask"))
    empty = F.col("best_bid").isNull() & F.col("best_ask").isNull()
    return df.withColumns(
        {
            "fair_value": F.when(~empty, estimate),
            "fair_value_error": F.when(empty, F.lit("empty_orderbook")),
        }
    )


QUOTE_CONFIG = {
    "tick_size": "0.0001",
    "default_spread": "0.0200",
    "min_spread": "0.0001",
    "order_quantity": "1.00",
    "inventory_skew_per_unit": "0.0010",
    "max_inventory_skew": "0.0500",
    "min_price": "0",
    "max_price": "1",
}


def quote_bands(
    df: DataFrame,
    inventory: Column | str = "inventory",
    config: dict | None = None,
    model: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Two-sided dry-run quote around an inventory-skewed fair value, on the tick grid."""
    settings = {**QUOTE_CONFIG, **(config or {})}
    _check_config(settings)
    c = {k: dec(str(v)) for k, v in settings.items() if k != "order_quantity"}
    inv = F.col(inventory) if isinstance(inventory, str) else inventory
    low, high = c["min_price"], c["max_price"]

    def inside(name: str) -> Column:
        """A named column kept within the price bounds; null stays null."""
        return clamp(F.col(name), low, high)

    base = fair_value(df, model)
    cap = c["max_inventory_skew"]
    raw_skew = (inv.cast(QTY) * c["inventory_skew_per_unit"].cast("decimal(10,8)")).cast(PRICE_WIDE)
    # every step is a named column, so that nothing is evaluated twice
    q = base.withColumn("_skew", raw_skew)
    q = q.withColumn("inventory_skew", clamp(F.col("_skew"), -cap, cap).cast(PRICE))
    q = q.withColumns(
        {
            "_fair": (F.col("fair_value") - F.col("inventory_skew")).cast(PRICE),
            "_observed": F.coalesce((F.col("best_ask") - F.col("best_bid")).cast(PRICE), c["default_spread"]),
        }
    )
    q = q.withColumns(
        {
            "adjusted_fair_value": inside("_fair"),
            "_half": (
                F.greatest("_observed", c["default_spread"], c["min_spread"]) * dec("0.5", "decimal(2,1)")
            ).cast(PRICE),
        }
    )
    q = q.withColumns(
        {
            "_low": (F.col("adjusted_fair_value") - F.col("_half")).cast(PRICE),
            "_high": (F.col("adjusted_fair_value") + F.col("_half")).cast(PRICE),
        }
    ).withColumns({"_low": inside("_low"), "_high": inside("_high")})
    # exact grid points: remainders of the tick, never a rounded quotient
    tick = c["tick_size"]
    q = q.withColumns({"_low_rest": F.col("_low") % tick, "_high_rest": F.col("_high") % tick})
    q = q.withColumns(
        {
            "_bid": (F.col("_low") - F.col("_low_rest")).cast(PRICE),
            "_ask": (
                F.col("_high") - F.col("_high_rest") + F.when(F.col("_high_rest") > 0, tick).otherwise(dec("0"))
            ).cast(PRICE),
        }
    ).withColumns({"_bid": inside("_bid"), "_ask": inside("_ask")})
    bid, ask = F.col("_bid"), F.col("_ask")
    apart = bid < ask
    up = (ask + tick) <= high
    down = (bid - tick) >= low
    return q.withColumns(
        {
            "bid_price": F.when(apart | up, bid).when(down, (bid - tick).cast(PRICE)),
            "ask_price": F.when(apart, ask).when(up, (ask + tick).cast(PRICE)).when(down, ask),
            "quantity": dec(settings["order_quantity"], QTY),
            "execution_policy": F.lit("dry_run_only"),
        }
    ).withColumn("target_spread", (F.col("ask_price") - F.col("bid_price")).cast(PRICE)).drop(
        "_skew", "_fair", "_observed", "_half", "_low", "_high", "_low_rest", "_high_rest", "_bid", "_ask"
    )


def _check_config(settings: dict) -> None:
    v = {k: Decimal(str(x)) for k, x in settings.items()}
    for name in ("tick_size", "default_spread", "min_spread", "order_quantity"):
        if v[name] <= 0:
            raise ValueError(f"{name} must be positive")
    for name in ("inventory_skew_per_unit", "max_inventory_skew"):
        if v[name] < 0:
            raise ValueError(f"{name} must be non-negative")
    if not 0 <= v["min_price"] < v["max_price"] <= 1:
        raise ValueError("price boundaries must lie within [0, 1] in order")
    if v["min_spread"] < v["tick_size"]:
        raise ValueError("min_spread must be at least one tick")


def quote_hysteresis(
    quotes: DataFrame,
    min_change: str,
    chunk: Column,
    max_open: int = 2,
    kill_switch: bool = False,
) -> DataFrame:
    """Place, replace or hold each quote against the last *accepted* one.

    Columns: instrument_id, side, ord, price, quantity.  A hold keeps the old price, so
    the accepted price is not the previous row's.  Two facts keep a hot instrument
    parallel: a quote that differs in size from the previous row, or moves by twice the
    threshold or more, is always accepted.  Those rows cut the series into segments
    whose starting state is known, and each segment is folded on its own.
    """
    threshold = dec(min_change)
    if kill_switch:
        return quotes.withColumns(
            {"action": F.lit("place"), "result_status": F.lit("skipped"), "accepted_price": F.lit(None).cast(PRICE)}
        )
    keys = ["instrument_id", "side"]
    seen = scan(
        quotes, keys, ["ord"], chunk,
        prior={"_prev_price": F.col("price"), "_prev_quantity": F.col("quantity")},
    )
    sure = (
        F.col("_prev_price").isNull()
        | (F.col("_prev_quantity") != F.col("quantity"))
        | (F.abs(F.col("price") - F.col("_prev_price")) >= threshold * 2)
    )
    cut = scan(
        seen.withColumn("sure", sure), keys, ["ord"], chunk,
        running={"segment": ("sum", F.col("sure").cast("bigint"))},
    ).drop("_prev_price", "_prev_quantity")
    # an open quote is never withdrawn here, so a side is capped out for good when
    # enough other sides of its instrument were placed before its first row
    first = quotes.groupBy(*keys).agg(F.min("ord").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("instrument_id").orderBy("_first", "side"))
    cut = cut.join(first.withColumn("capped", rank > max_open).select(*keys, "capped"), keys)
    limit = Decimal(str(min_change))

    def start(_key):
        return {"price": None, "quantity": None}

    def step(state, row):
        if row.capped:
            action, status = "place", "skipped"
        elif row.sure:
            action, status = ("place" if row.segment == 1 else "replace"), "accepted"
        elif row.quantity != state["quantity"] or abs(row.price - state["price"]) >= limit:
            action, status = "replace", "accepted"
        else:
            action, status = "hold", "skipped"
        if status == "accepted":
            state["price"], state["quantity"] = row.price, row.quantity
        return (row.instrument_id, row.side, row.ord, row.price, row.quantity, action, status, state["price"])

    kind = quotes.schema["instrument_id"].dataType.simpleString()
    return sorted_fold(
        cut,
        [*keys, "segment"],
        ["ord"],
        start,
        step,
        f"instrument_id {kind}, side string, ord bigint, price {PRICE}, quantity {QTY}, "
        f"action string, result_status string, accepted_price {PRICE}",
    )
