import random

import pytest
from pyspark.sql import functions as F

from paritymill.llm import sharding


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 7, 16, 40, 1000])
def test_jump_equals_the_plain_loop(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[rng.randrange(-(2**63), 2**63) for _ in range(300)]]
    df = spark.createDataFrame([(k, 9) for k in keys], "k bigint, shard int")
    for r in sharding.assign_shards(df, "k", shards).collect():
        assert (r.shard, r.grown_shard) == (jump(r.k, shards), jump(r.k, shards + 1))
        assert r.grown_shard in (r.shard, shards)


def test_null_key_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x"), (5, "y"), (5, "y")], "k bigint, v string")
    out = sharding.assign_shards(df, "k", 8)
    rows = out.collect()
    assert rows[0].shard == rows[0].grown_shard == 0 and rows[1].shard == rows[2].shard
    slots = sharding.with_slots(out, "shard", ["k", "v"])
    for r in slots.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect():
        assert sorted(r.s) == list(range(len(r.s)))
    assert sharding.with_slots(sharding.assign_shards(df.limit(0), "k", 8), "shard", ["k"]).count() == 0


def test_slots_are_gapless_and_few_rows_move(spark):
    df = sharding.assign_shards(spark.range(20_000), "id", 40)
    moved = df.where("shard != grown_shard").count()
    assert 300 < moved < 700
    bad = sharding.with_slots(df, "shard", ["id"]).groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("z")
    ).where("n != d or m != n - 1 or z != 0")
    assert bad.count() == 0


def test_written_shards_read_back(spark, tmp_path):
    df = sharding.assign_shards(spark.range(500), "id", 4)
    sharding.write_shards(df, "shard", str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("id", "shard").count().count() == 500
