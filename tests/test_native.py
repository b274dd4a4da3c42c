"""Pricing values at any depth."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paritymill.operators.native import pricing_values


def walk(node):
    """Values by level, outer ones first."""
    found, level = [], [node]
    while level:
        found += [json.dumps(n["use_yes_price"]) for n in level if isinstance(n, dict) and "use_yes_price" in n]
        level = [n[k] for n in level if isinstance(n, dict) for k in ("msg", "params") if k in n]
    return found


def test_every_level_is_searched(spark):
    deep = {"use_yes_price": 5}
    for n in range(6):
        deep = {"params" if n % 2 else "msg": deep, "use_yes_price": n % 2 == 0, "other": {"use_yes_price": "no"}}
    both = {"msg": {"use_yes_price": True, "params": {"use_yes_price": "x{"}}, "params": {"msg": {"use_yes_price": False}}}
    cases = [deep, both, {"use_yes_price": True}, {"msg": 1, "params": []}, {}, [{"use_yes_price": True}]]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(90, None), (91, ""), (92, "{broken")]
    df = spark.createDataFrame(rows, "i int, payload string")
    got = {r.i: r.v for r in df.select("i", pricing_values(F.col("payload")).alias("v")).collect()}
    assert got == {i: walk(c) for i, c in enumerate(cases)} | {90: [], 91: [], 92: []}
