"""Connected components by distributed union-find, DataFrame operations only.

Each round joins every node to its neighbour of least random rank and contracts the graph
to the nodes joined to; a constant share of the nodes goes in each round whatever the
shape of the graph, so the rounds grow with the logarithm of the longest group.  Rounds are
stage tables; the driver learns only whether links are left.  A hub's links are combined
before the shuffle, and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritymill.llm.shared import discard, stage


def _links(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links between different nodes, smaller node first."""
    return (
        df.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``links``; ``component`` is its smallest node.

    ``a`` and ``b`` are BIGINT.  Links of a node to itself and links with a null end are left
    out, repeated links count once, and an empty table gives an empty result.
    """
    left = stage(_links(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(steps))
        both = left.select("u", "v").union(left.select("v", "u")).toDF("node", "other")
        best = both.groupBy("node").agg(
            F.min(F.struct(F.xxhash64(seed, "other").alias("rank"), F.col("other").alias("to"))).alias("best")
        )
        own = F.struct(F.xxhash64(seed, "node").alias("rank"), F.col("node").alias("to"))
        step = stage(best.select("node", F.least(own, F.col("best"))["to"].alias("to")), "parents")
        at_u = step.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        at_v = step.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        after = stage(_links(left.join(at_u, "u").join(at_v, "v"), "pu", "pv"), "links")
        discard(left)
        left = after
        steps.append(step)
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots = step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    roots = stage(roots, "roots")
    discard(left, *steps)
    least = roots.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    # the root is a node too: it is in ``roots`` under its own name
    return roots.join(least, "root").select("node", "component")
