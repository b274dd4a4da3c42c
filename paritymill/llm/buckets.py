"""Links between members of shared buckets, without making all pairs of a bucket.

In each bucket every member is compared with two leaders first and the links found are grouped.
A round or two of this leave few buckets with members of different groups.  Only pairs that no
links join yet are then compared, all of them: the groups are those of all pairs in all
buckets.  Leaders are chosen by a hash that changes each round.

The rest is compared pair by pair, or, where a family of texts lies about the threshold and
its pairs would be too many rows, in blocks: members of a bucket are dealt into chunks of about
``CHUNK``, and each two chunks meet in one group that returns links only; chunks of one label do not meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.llm.components import components
from paritymill.llm.shared import Scratch

CHUNK = 256


def live_members(exploded: DataFrame, bucket: str, rep: str) -> DataFrame:
    """Rows of the buckets that hold at least two members."""
    ends = exploded.groupBy(bucket).agg(F.min(rep).alias("low"), F.max(rep).alias("high"))
    return exploded.join(ends.where("low < high").select(bucket), bucket)


def _pairs(met: DataFrame, close: Column) -> DataFrame:
    """Distinct pairs of rows that ``close`` does not rule out."""
    return met.where(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def blocks(rest: DataFrame, *extra: str, width: int = 1) -> DataFrame:
    """(bucket, low, high, chunk, rep, label, extra): every member once for each two chunks it meets in.

    A chunk holds about ``width`` times ``CHUNK`` members.
    Where more than a chunk of members have one label, they get chunks of their own, which meet
    those of the others only: the rows grow with the members that are not joined yet, not with the
    square of a family that is.
    """
    sizes = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("same"))
    most = sizes.groupBy("bucket").agg(F.sum("same").alias("members"), F.max(F.struct("same", "label")).alias("most"))
    chunk = width * CHUNK
    chunks = lambda n: F.ceil(n / F.lit(chunk)).cast("int")
    same = F.col("most.same")
    counts = most.select(
        "bucket", F.when(same > chunk, F.col("most.label")).alias("joined"),
        F.when(same > chunk, chunks(same)).otherwise(0).alias("first"),
        chunks(F.when(same > chunk, F.col("members") - same).otherwise(F.col("members"))).alias("chunks"),
    )
    inside = F.coalesce(F.col("label") == F.col("joined"), F.lit(False))
    deal = lambda n: F.pmod(F.xxhash64(F.lit(7), "rep"), F.nullif(n, F.lit(0))).cast("int")
    first, last = F.col("first"), F.col("first") + F.col("chunks") - 1
    dealt = rest.join(counts, "bucket").withColumns({
        "chunk": F.when(inside, deal(first)).otherwise(first + deal(F.col("chunks"))),
        "meets": F.when(F.col("chunks") == 0, F.array().cast("array<int>"))
        .when(inside, F.sequence(first, last)).otherwise(F.sequence(F.lit(0), last)),
    })
    met = dealt.select("bucket", "rep", "label", *extra, "chunk", F.explode("meets").alias("other"))
    return met.select(
        "bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "label", *extra
    )


def bucket_links(
    members: DataFrame,
    percent: int,
    confirm: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    rounds: int = 2,
    compare_blocks: Callable[[DataFrame], DataFrame] | None = None,
    close: Column | None = None,
    width: int = 1,
) -> DataFrame:
    """Confirmed links (a, b) whose closure is that of all links inside buckets.

    ``members`` is a stage table (bucket, rep, size).  ``confirm`` keeps the linked pairs of a
    table (a, b); pairs whose sizes differ too much to link are not put to it.  ``compare_blocks``
    takes the rest as ``blocks`` instead of pairs and returns links that join the same groups.
    ``close`` tells from the members' sizes, ``na`` and ``nb``, which pairs may link at all;
    blocks then show the sizes too.  ``width`` is that of ``blocks``.
    The links read tables of ``scratch``.
    """
    by_size = close is not None
    if close is None:  # the smaller needs ``percent`` of the larger
        close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    links = tested = None
    for turn in range(rounds + 1):
        if links is None:
            rest = members.withColumn("label", F.col("rep"))
        else:
            groups = components(links, "a", "b").toDF("rep", "component")
            labelled = members.join(groups, "rep", "left").select(
                "bucket", "rep", "size", F.coalesce("component", "rep").alias("label")
            )
            labelled = scratch.stage(labelled, "labelled")
            mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            rest = labelled.join(mixed.where("low < high").select("bucket"), "bucket", "left_semi")
        if turn == rounds and compare_blocks is not None:
            extra = ["size"] if by_size else []
            return links.union(scratch.stage(compare_blocks(blocks(rest, *extra, width=width)), "confirmed"))
        if turn < rounds:
            entry = F.struct("rep", "label", "size")
            ranked = [F.struct(F.xxhash64(F.lit(2 * turn + k), "rep").alias("h"), entry.alias("e")) for k in (0, 1)]
            leaders = rest.groupBy("bucket").agg(*[F.min(r).alias(f"first{k}") for k, r in enumerate(ranked)])
            leaders = leaders.select("bucket", F.explode(F.array_distinct(F.array("first0.e", "first1.e"))).alias("lead"))
            met = rest.join(leaders, "bucket").where(F.col("label") != F.col("lead.label"))
            met = met.select("rep", "lead.rep", "size", "lead.size").toDF("x", "y", "na", "nb")
        else:
            met = rest.toDF("bucket", "x", "na", "label_x").join(rest.toDF("bucket", "y", "nb", "label_y"), "bucket")
            met = met.where(F.col("label_x") < F.col("label_y"))
        pairs = _pairs(met, close)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.stage(pairs, "pairs")
        found = scratch.stage(confirm(pairs), "confirmed")
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
    return links
