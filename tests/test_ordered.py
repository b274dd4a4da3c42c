"""Chunked scans against plain windows, with one key that holds most rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from paritymill.functions.ordered import chunk_of, scan, scan_net, spread


def rows(seed=7, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((key, i, rng.randint(-9, 9), rng.choice([None, "x", "y", "z"])))
    return out


def test_scan_equals_windows(spark):
    df = spark.createDataFrame(rows(), "k string, i bigint, v bigint, s string")
    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "k", "i", F.lag("v").over(w).alias("pv"), F.sum("v").over(upto).alias("total"),
        F.max("v").over(before).alias("high"), F.last("s", ignorenulls=True).over(upto).alias("last_s"),
    )
    got = scan(
        df, ["k"], ["i"], chunk_of(F.col("i"), 16), prior={"pv": F.col("v")},
        running={"total": ("sum", F.col("v")), "last_s": ("last", F.col("s"))},
        exclusive={"high": ("max", F.col("v"))},
    ).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scan_without_keys(spark):
    df = spark.createDataFrame(rows(), "k string, i bigint, v bigint, s string")
    got = scan(df, [], ["i"], chunk_of(F.col("i"), 50), running={"n": ("sum", F.lit(1))})
    assert all(r.n == r.i + 1 for r in got.collect())


def test_scan_net_carries_extremes(spark):
    data = rows(11)
    df = spark.createDataFrame(data, "k string, i bigint, v bigint, s string")
    got = {
        (r.k, r.i): (r.net, r.extreme_before, r.ups)
        for r in scan_net(
            df, ["k"], ["i"], chunk_of(F.col("i"), 8), F.col("v"), "min",
            sums={"ups": F.greatest(F.col("v"), F.lit(0).cast("bigint"))},
        ).collect()
    }
    for key in {r[0] for r in data}:
        net = low = ups = 0
        for k, i, v, _ in data:
            if k == key:
                earlier, net, ups = low, net + v, ups + max(v, 0)
                assert got[(k, i)] == (net, earlier, ups)
                low = min(low, net)


def test_spread_deals_only_hot_keys(spark):
    rows = spark.range(4000).selectExpr("IF(id % 4 < 3, 'hot', CONCAT('k', id % 97)) AS k", "id")
    out = spread(rows, ["k"], ["id"], hot_rows=500)
    per = {r.k: r for r in out.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("_salt").alias("ways")).collect()}
    assert per["hot"].n == 3000 and per["hot"].ways >= 6
    assert sum(r.n for r in per.values()) == 4000
    assert all(r.ways == 1 for k, r in per.items() if k != "hot")
