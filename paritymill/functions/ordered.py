"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task.  Here a
key is cut into *chunks* along its ordering column, rows are scanned inside
(key, chunk), and only one summary row per chunk is ordered by key alone.  The
carry-in of each chunk then joins back on (key, chunk), which is already the
partitioning of the scanned rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK_ROWS = 65_536
_CHUNK = "_chunk"
SLOTS = 65_536
HOT_ROWS = 1_000_000
_HEAD_BYTES = 7
_TOP_BITS = 26


def chunk_of(order: Column, width: int) -> Column:
    """Chunk number of an integer ordering column."""
    return F.floor(order / F.lit(width)).cast("bigint")


def time_chunk(ts: Column, seconds: int = 3_600) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("bigint")


def _position(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _same(columns: Sequence[str]) -> Column:
    """Equality with the renamed key columns of a carry table."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)])


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    prior: Mapping[str, Column] | None = None,
    running: Mapping[str, tuple[str, Column]] | None = None,
    exclusive: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add previous-row values and running aggregates per key in ``order``.

    ``prior``      name -> expression, value of the previous row (null on the first)
    ``running``    name -> (sum|max|min|last, expression), up to and with the row
    ``exclusive``  the same, up to but without the row
    ``chunk`` must not decrease along ``order`` and must bound the rows of a key in it.
    ``last`` is the latest non-null value.  Key, chunk and order columns hold no nulls, so
    the carry joins on plain equality and finds the rows partitioned and sorted for it.
    """
    prior, running, exclusive = dict(prior or {}), dict(running or {}), dict(exclusive or {})
    keys, order = list(keys), list(order)
    src = df.withColumn(_CHUNK, chunk)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def windowed(kind: str, expr: Column, frame) -> Column:
        if kind == "last":
            return F.last(expr, ignorenulls=True).over(frame)
        return _AGG[kind](expr).over(frame)

    adds: dict[str, Column] = {}
    if prior:
        adds["_prior"] = F.lag(F.struct(*[e.alias(n) for n, e in prior.items()])).over(inside)
    for name, (kind, expr) in running.items():
        adds[name] = windowed(kind, expr, upto)
    for name, (kind, expr) in exclusive.items():
        adds[name] = windowed(kind, expr, before)
    rows = src.withColumns(adds)

    position = _position(order)
    # one max_by per column keeps primitive values in a hash aggregate
    totals = [F.max_by(e, position).alias(f"_p_{n}") for n, e in prior.items()]
    for name, (kind, expr) in {**running, **exclusive}.items():
        if kind == "last":
            agg = F.max_by(expr, F.when(expr.isNotNull(), position))
        else:
            agg = _AGG[kind](expr)
        totals.append(agg.alias(name))
    summary = src.groupBy(*keys, _CHUNK).agg(*totals)
    chunks = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, _CHUNK])]
    carried += [F.lag(f"_p_{n}").over(chunks).alias(f"_c_{n}") for n in prior]
    for name, (kind, _) in {**running, **exclusive}.items():
        carried.append(windowed(kind, F.col(name), earlier).alias(f"_c_{name}"))
    carry = summary.select(*carried)

    joined = rows.join(carry, _same([*keys, _CHUNK]), "left")
    out = [F.col(c) for c in df.columns]
    for name in prior:
        out.append(
            F.when(F.col("_prior").isNotNull(), F.col(f"_prior.{name}"))
            .otherwise(F.col(f"_c_{name}"))
            .alias(name)
        )
    for name, (kind, _) in {**running, **exclusive}.items():
        out.append(_COMBINE[kind](F.col(name), F.col(f"_c_{name}")).alias(name))
    return joined.select(*out)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    row: Sequence[str],
    salt: str = "_salt",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Rows of a key brought together before they are multiplied, sorted or widened.

    A combine before the shuffle helps only where a task holds many rows of a key; where keys
    lie scattered it sorts or hashes every row and sends them all.  Keys whose hash slot has more
    than ``hot_rows`` rows are dealt by a hash of the ``row`` columns over as many tasks as
    they need.  Aggregate by ``keys`` and ``salt`` first, then by ``keys``.  ``counted`` holds the
    rows of ``df`` and others, where those are cheaper to count.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    source = df if counted is None else counted
    hot = source.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = hot.select("_slot", F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("bigint").alias("_ways"))
    way = F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64(*row), F.col("_ways"))).otherwise(0)
    dealt = df.withColumn("_at", slot).join(F.broadcast(hot), F.col("_at") == F.col("_slot"), "left")
    return dealt.select(*df.columns, way.cast("int").alias(salt)).repartition(*keys, salt)


def near_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows that may be the last of their key by ``order``: the last ones, and a few others.

    Only keys and the head of ``order`` (of a text its first seven bytes, as a number) travel to
    find the greatest head of every key.  A broadcast bitmap of those, 2^20 rows of 64 bits at
    most, then leaves out the other rows where they are.  Rows of a null ``order`` go: they are
    never the last.
    """
    head = F.col(order)
    if df.schema[order].dataType == StringType():
        first = F.hex(F.substring(F.encode(head, "UTF-8"), 1, _HEAD_BYTES))
        head = F.conv(F.rpad(first, 2 * _HEAD_BYTES, "0"), 16, 10).cast("bigint")
    at, bit = F.pmod(F.xxhash64(*keys, "_head"), F.lit(1 << _TOP_BITS)), "shiftleft(1L, CAST(_at % 64 AS INT))"
    tops = df.select(*keys, head.alias("_head")).groupBy(*keys).agg(F.max("_head").alias("_head"))
    words = tops.where("_head IS NOT NULL").select(at.alias("_at"))
    words = words.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr(bit)).alias("_bits"))
    held = df.withColumn("_head", head).where("_head IS NOT NULL").withColumn("_at", at)
    met = held.withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(F.expr(bit)) != 0).select(*df.columns)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row of every key by ``order``; combines before the shuffle."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    ).select(*keys, "_first.*")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last row of every key by ``order``; combines before the shuffle."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    ).select(*keys, "_last.*")


def scan_net(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    change: Column,
    extreme: str = "min",
    net: str = "net",
    before: str = "extreme_before",
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running total of ``change`` and the extreme of zero and all *earlier* totals.

    A chunk is summed up by its total and its extreme prefix, which compose along chunks.
    ``sums`` adds plain running sums in the same pass.
    """
    keys, order, sums = list(keys), list(order), dict(sums or {})
    upto = (Window.unboundedPreceding, 0)
    pick = F.least if extreme == "min" else F.greatest
    agg = F.min if extreme == "min" else F.max
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = (
        df.withColumn(_CHUNK, chunk)
        .withColumns(
            {
                "_in": F.sum(change).over(inside.rowsBetween(*upto)),
                **{n: F.sum(e).over(inside.rowsBetween(*upto)) for n, e in sums.items()},
            }
        )
        .withColumn("_ext", agg("_in").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    )
    summary = rows.groupBy(*keys, _CHUNK).agg(
        F.max_by("_in", _position(order)).alias("_total"),
        agg("_in").alias("_prefix"),
        *[F.max_by(n, _position(order)).alias(f"_s_{n}") for n in sums],
    )
    chunks = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_base", F.sum("_total").over(earlier)).withColumn(
        "_reach", F.coalesce("_base", F.col("_total") * 0) + F.col("_prefix")
    )
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, _CHUNK])]
    carry = carried.select(
        *named, "_base", agg("_reach").over(earlier).alias("_ext_base"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
    )
    match = _same([*keys, _CHUNK])
    zero = F.col("_in") * 0
    base = F.coalesce("_base", zero)
    return rows.join(carry, match, "left").select(
        *df.columns,
        (base + F.col("_in")).alias(net),
        pick(zero, F.col("_ext_base"), base + F.col("_ext")).alias(before),
        *[_COMBINE["sum"](F.col(n), F.col(f"_c_{n}")).alias(n) for n in sums],
    )
