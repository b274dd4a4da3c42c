"""Venue payloads to canonical YES books, their validity and their metrics.

A book is one row with ``bids`` and ``asks`` arrays, as large as the message that
carried it.  Every function here is a projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, QTY
from paritymill.functions.columns import dec, decimal_from_text, decimal_text, first_filled, flags

LEVELS = f"array<struct<price: {PRICE}, quantity: {QTY}>>"

_YES_NO = (
    "struct<instrument_id: string, market_ticker: string, ticker: string, orderbook_fp: "
    "struct<instrument_id: string, market_ticker: string, ticker: string, "
    "yes_dollars: array<array<string>>, no_dollars: array<array<string>>>>"
)
_BID_OFFER = (
    "struct<marketData: struct<marketSlug: string, slug: string, id: string, state: string, "
    "bids: array<struct<px: string, qty: string>>, offers: array<struct<px: string, qty: string>>>>"
)


def level(price: Column, quantity: Column) -> Column:
    return F.struct(price.cast(PRICE).alias("price"), quantity.cast(QTY).alias("quantity"))


def sort_levels(levels: Column, descending: bool) -> Column:
    """Ladder by price; levels of one price keep their input order."""
    keyed = F.transform(
        levels,
        lambda x, i: F.struct(
            (-x["price"] if descending else x["price"]).alias("k"), i.alias("i"), x.alias("x")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda y: y["x"])


def _not_list(payload: Column, path: str) -> Column:
    raw = F.get_json_object(payload, path)
    return F.coalesce(~raw.startswith("["), F.lit(False))


def _bad_levels(levels: Column, upper: bool = True) -> Column:
    bad = F.exists(
        levels,
        lambda x: x["price"].isNull()
        | x["quantity"].isNull()
        | (x["price"] < 0)
        | ((x["price"] > 1) if upper else F.lit(False))
        | (x["quantity"] <= 0),
    )
    return F.coalesce(bad, F.lit(False))


def book_errors(bids: Column, asks: Column) -> Column:
    """Errors of a canonical book: bad levels, locked or crossed best prices."""
    best_bid = F.array_max(F.transform(bids, lambda x: x["price"]))
    best_ask = F.array_min(F.transform(asks, lambda x: x["price"]))
    return flags(
        (_bad_levels(bids), "bad_bid_level"),
        (_bad_levels(asks), "bad_ask_level"),
        (F.coalesce(best_bid >= best_ask, F.lit(False)), "locked_or_crossed"),
    )


def _pair(x: Column, complement: bool) -> Column:
    price = decimal_from_text(F.try_element_at(x, F.lit(1)), PRICE)
    good = F.size(x) == 2
    if complement:
        price = (dec("1") - price).cast(PRICE)
    return level(F.when(good, price), decimal_from_text(F.try_element_at(x, F.lit(2)), QTY))


def normalize_yes_no(df: DataFrame, payload: str = "payload") -> DataFrame:
    """YES bids pass through; a NO bid at ``p`` is a YES ask at ``1 - p`` of the same size."""
    parsed = df.withColumn("_p", F.from_json(payload, _YES_NO))
    p, book = F.col("_p"), F.col("_p.orderbook_fp")
    bids = F.transform(F.coalesce(book["yes_dollars"], _no_pairs()), lambda x: _pair(x, False))
    asks = F.transform(F.coalesce(book["no_dollars"], _no_pairs()), lambda x: _pair(x, True))
    names = ("instrument_id", "market_ticker", "ticker")
    ident = F.coalesce(
        first_filled(*[p[n] for n in names], *[book[n] for n in names]), F.lit("UNKNOWN")
    )
    return _finish(
        parsed, bids, asks, ident, "kalshi_orderbook_fp",
        [
            (book.isNull(), "orderbook_fp_missing"),
            (_not_list(F.col(payload), "$.orderbook_fp.yes_dollars"), "yes_dollars_not_list"),
            (_not_list(F.col(payload), "$.orderbook_fp.no_dollars"), "no_dollars_not_list"),
        ],
    )


def _no_pairs() -> Column:
    return F.array().cast("array<array<string>>")


def _amount(text: Column) -> Column:
    """A scalar amount, or the ``value`` of an amount object."""
    return F.when(text.startswith("{"), F.get_json_object(text, "$.value")).otherwise(text)


def normalize_bid_offer(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bids and offers as given; a book with neither is an error."""
    parsed = df.withColumn("_p", F.from_json(payload, _BID_OFFER)["marketData"])
    p = F.col("_p")
    empty = F.array().cast("array<struct<px: string, qty: string>>")

    def side(c: Column) -> Column:
        return F.transform(
            F.coalesce(c, empty),
            lambda x: level(
                decimal_from_text(_amount(x["px"]), PRICE), decimal_from_text(_amount(x["qty"]), QTY)
            ),
        )

    bids, asks = side(p["bids"]), side(p["offers"])
    ident = F.coalesce(first_filled(p["marketSlug"], p["slug"], p["id"]), F.lit("UNKNOWN"))
    return _finish(
        parsed, bids, asks, ident, "polymarket_us_market_book",
        [
            (p.isNull(), "market_data_missing"),
            (_not_list(F.col(payload), "$.marketData.bids"), "bids_not_list"),
            (_not_list(F.col(payload), "$.marketData.offers"), "offers_not_list"),
            ((F.size("_bids") == 0) & (F.size("_asks") == 0), "empty_orderbook"),
        ],
    )


def _finish(df: DataFrame, bids: Column, asks: Column, ident: Column, source: str, extra) -> DataFrame:
    out = df.withColumns({"_bids": bids, "_asks": asks, "instrument_id": ident})
    return out.withColumns(
        {
            "bids": sort_levels(F.col("_bids"), True),
            "asks": sort_levels(F.col("_asks"), False),
            "source": F.lit(source),
            "errors": F.concat(flags(*extra), book_errors(F.col("_bids"), F.col("_asks"))),
        }
    ).drop("_p", "_bids", "_asks")


def mark_books(df: DataFrame) -> DataFrame:
    """Books with the ``errors`` that make them invalid, in one pass."""
    return df.withColumn("errors", book_errors(F.col("bids"), F.col("asks")))


def validate_books(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) canonical books."""
    checked = mark_books(df)
    return checked.where(F.size("errors") == 0), checked.where(F.size("errors") > 0)


def book_metrics(df: DataFrame) -> DataFrame:
    """Best prices, spread, mid, depths and level counts; null when a side is missing."""
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))

    def depth(side: str) -> Column:
        return F.aggregate(
            side, F.lit(0).cast("decimal(38,8)"),
            lambda a, x: (a + x["quantity"]).cast("decimal(38,8)"),
        )

    best_bid, best_ask = bid["price"], ask["price"]
    return df.withColumns(
        {
            "best_bid": best_bid,
            "best_ask": best_ask,
            "best_bid_size": bid["quantity"],
            "best_ask_size": ask["quantity"],
            "spread": (best_ask - best_bid).cast(PRICE),
            "mid": ((best_bid + best_ask) * dec("0.5", "decimal(2,1)")).cast(PRICE),
            "bid_depth": depth("bids"),
            "ask_depth": depth("asks"),
            "bid_level_count": F.size("bids").cast("bigint"),
            "ask_level_count": F.size("asks").cast("bigint"),
        }
    )


def quality_flags(market_state: Column | None = None) -> Column:
    """``one_sided_book`` and, given a market state, ``non_open_market`` unless it is OPEN."""
    pairs = [((F.size("bids") == 0) | (F.size("asks") == 0), "one_sided_book")]
    if market_state is not None:
        pairs.append((~market_state.eqNullSafe("OPEN"), "non_open_market"))
    return flags(*pairs)


def book_hash() -> Column:
    """SHA-256 of the canonical book record."""

    def side(name: str) -> Column:
        return F.transform(
            name,
            lambda x: F.struct(
                decimal_text(x["price"]).alias("price"), decimal_text(x["quantity"]).alias("quantity")
            ),
        )

    record = F.struct(
        side("asks").alias("asks"), side("bids").alias("bids"),
        F.col("instrument_id"), F.col("source"),
    )
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)
