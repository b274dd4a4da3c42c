"""Jump consistent hashing: stable keys to shards without a ring table.

The jump sequence of a key is driven by a 64-bit linear congruential generator.  Products
modulo 2^64 are put together from 16-bit limbs, so they are right under ANSI arithmetic,
where a plain BIGINT product would overflow with an error.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: multiplier of the generator, as published with the algorithm
MULTIPLIER = 2862933555777941757
_STEPS = 16
SLOT_BUCKETS = 4096


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, as a BIGINT bit pattern."""
    mask = F.lit(0xFFFF).cast("bigint")
    limbs = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(mask) for i in range(4)]
    factor = [F.lit((MULTIPLIER >> (16 * i)) & 0xFFFF).cast("bigint") for i in range(4)]
    carry, out = F.lit(1).cast("bigint"), None
    for place in range(4):
        column = carry
        for i in range(place + 1):
            column = column + limbs[i] * factor[place - i]
        digit = F.shiftleft(column.bitwiseAND(mask), 16 * place)
        out = digit if out is None else out.bitwiseOR(digit)
        carry = F.shiftrightunsigned(column, 16)
    return out


def _advance(state: Column, shards: int) -> Column:
    """One jump of a (bucket, next bucket, generator) state; a finished state stays."""
    key = _next_state(state["key"])
    # doubles as in the algorithm: 2^31 over the top 31 bits plus one
    draw = F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + F.lit(1)).cast("double")
    jump = F.floor((state["next"] + F.lit(1)).cast("double") * draw).cast("bigint")
    moved = F.struct(state["next"].alias("bucket"), jump.alias("next"), key.alias("key"))
    return F.when(state["next"] < F.lit(shards), moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of an integer key, 0 to ``shards`` - 1; null for a null key.

    A key needs about ln(shards) jumps.  The first fold covers nearly every key, the second
    all that is left: each jump goes up at least one shard, so ``shards`` jumps always end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(
        F.lit(-1).cast("bigint").alias("bucket"),
        F.lit(0).cast("bigint").alias("next"),
        key.cast("bigint").alias("key"),
    )

    def fold(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _advance(s, shards))

    first = fold(start, min(_STEPS, shards))
    if shards <= _STEPS:
        done = first
    else:
        # a one-element array binds the first fold, so it is evaluated once
        done = F.transform(
            F.array(first),
            lambda s: F.when(s["next"] >= F.lit(shards), s).otherwise(fold(s, shards)),
        )[0]
    return F.when(key.isNotNull(), done["bucket"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard") -> DataFrame:
    """``df`` with the shard of every row and its shard once one more is appended.

    Columns named ``shard`` or ``grown_<shard>`` are replaced.  A null key has no stable
    place: it goes to shard 0 in both cases.  Equal keys, repeated rows included, share a
    shard.  An empty table stays empty.  No shuffle.
    """
    home = F.coalesce(jump_shard(F.col(key), shards), F.lit(0))
    grown = F.coalesce(jump_shard(F.col(key), shards + 1), F.lit(0))
    return df.withColumns({shard: home, f"grown_{shard}": grown})


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless position of every row in its shard, from 0.

    Rows are numbered inside (shard, hash bucket of ``order``), and the bucket sizes of a
    shard are summed up before it, so no shard is ever ordered in one task.  Rows equal in
    all of ``order`` are interchangeable and get different slots.
    """
    names = {"bucket": "_slot_bucket", "rank": "_slot_rank", "base": "_slot_base"}
    placed = df.withColumn(names["bucket"], F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int"))
    keys = [shard, names["bucket"]]
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = placed.withColumn(names["rank"], F.row_number().over(inside).cast("bigint") - 1)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slot_rows"))
    before = Window.partitionBy(shard).orderBy(names["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        *keys, F.coalesce(F.sum("_slot_rows").over(before), F.lit(0).cast("bigint")).alias(names["base"])
    )
    out = ranked.join(bases, keys)
    return out.select(
        *[F.col(c) for c in df.columns if c != slot],
        (F.col(names["rank"]) + F.col(names["base"])).alias(slot),
    )


def write_shards(df: DataFrame, shard: str, path: str) -> None:
    """Write one folder per shard.  A shard's rows stay in as many files as tasks hold them."""
    df.write.partitionBy(shard).parquet(path)
