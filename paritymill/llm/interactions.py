"""Filter interaction audit: what each filter removes, in every order of the filters.

A document is the mask of the filters that it fails.  The rest needs only how many
documents of a part have each mask.  Removal is a product over (min, +): masks are a matrix
with 0 where a filter fails and infinity elsewhere, an order is the positions of the
filters in it (its inverse permutation), and the least sum over the filters is the step
that removes a document with that mask in that order; infinity keeps it.

Counting is done by Spark and combines before its shuffles; what reaches Python is one row
of 3 x 2^filters numbers per part.

Words are runs outside 0x20 and 0x09-0x0D.  A null or empty text has no words: it fails A,
is no failure of B (0 < 0) or C, and counts as a text for E, equal to every other empty
one.  A row without an id has no smaller id than any, so it neither fails E nor makes
others fail it.  Rows that share an id are counted one by one; equal rows of one id are no
smaller than each other.  Several label rows of one id count as one that says 1 when any
does.  An empty table has no parts and gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
_GAP = r"[\x20\x09-\x0D]+"
_NEVER = np.int64(1 << 20)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# -- which filters a document fails ----------------------------------------------------------


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at the text alone."""
    words = F.array_remove(F.split(text, _GAP), "")
    n_words, n_distinct = (F.size(w).cast("bigint") for w in (words, F.array_distinct(words)))
    n_points = F.length(text).cast("bigint")
    n_upper = n_points - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct < DISTINCT_PERCENT * n_words,
        "C": 100 * n_upper > UPPER_PERCENT * n_points,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(failures: Sequence[Column]) -> Column:
    mask = F.lit(0)
    for place, fails in enumerate(failures):
        mask = mask + F.when(fails, 1 << place).otherwise(0)
    return mask.cast("int")


def document_masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask, n): documents of one id, part and text with the filters they fail as bits.

    Equal texts are found by their SHA-256.  Every text's least id meets the rows by (text,
    id), so no text, however often it repeats, is one group of rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        _bits(list(text_failures(body).values())).alias("mask"),
    )
    rows = facts.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("_id")).where("_id IS NOT NULL")
    met = rows.join(least, (F.col("digest") == F.col("_digest")) & (F.col("id") == F.col("_id")), "left")
    copy = F.col("id").isNotNull() & F.col("_id").isNull()
    last = 1 << (len(FILTERS) - 1)
    return met.select("id", "digest", "part", (F.col("mask") + F.when(copy, last).otherwise(0)).alias("mask"), "n")


# -- documents of each part by mask ----------------------------------------------------------


def mask_weights(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, all, good, toxic): documents by mask, an array of 2^filters counts each."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    # rows without an id meet nothing; their digest spreads them over the tasks
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))
    marked = masks.withColumn("_spread", spread).join(
        marks.withColumn("_none", F.lit(0).cast("bigint")),
        (F.col("id") == F.col("_id")) & (F.col("_spread") == F.col("_none")),
        "left",
    )
    counted = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("_rows"))

    def by_mask(name: str) -> Column:
        rows = F.map_from_entries(F.transform("_rows", lambda r: F.struct(r["mask"], r[name])))
        every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
        return F.transform(every, lambda m: F.coalesce(F.try_element_at(rows, m), F.lit(0).cast("bigint"))).alias(name)

    return held.select("part", by_mask("all"), by_mask("good"), by_mask("toxic"))


# -- removal steps -----------------------------------------------------------------------------


def mask_matrix(filters: int) -> np.ndarray:
    """0 where the mask fails the filter, else never; masks by filters."""
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    return np.where(fails, 0, _NEVER)


def position_matrix(orders: np.ndarray) -> np.ndarray:
    """Step, from 1, at which each filter comes in each order: the inverse permutations."""
    return np.argsort(orders, axis=1) + 1


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least left[i, k] + right[j, k] over k."""
    return (left[:, None, :] + right[None, :, :]).min(axis=2)


def audit_orders(weights: dict[str, np.ndarray], filters: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(orders, measures by order and step) of one part, from its documents by mask."""
    orders = np.array(list(itertools.permutations(range(filters))))
    masks, place = mask_matrix(filters), position_matrix(orders)
    step = np.minimum(min_plus(masks, place), filters + 1)  # masks by orders; the last is kept
    cell = step - 1 + np.arange(len(orders)) * (filters + 1)

    def scatter(weight: np.ndarray) -> np.ndarray:
        flat = np.zeros(len(orders) * (filters + 1), dtype=np.int64)
        np.add.at(flat, cell, weight[:, None])
        return flat.reshape(len(orders), -1)[:, :filters]

    count = weights["all"]
    removed = scatter(count)
    fails = masks == 0
    # failing documents that are gone before the filter comes, by order and filter
    early = np.einsum("m,mf,mof->of", count, fails.astype(np.int64), (step[:, :, None] < place[None]).astype(np.int64))
    own = count[1 << np.arange(filters)]
    share = np.zeros(filters, dtype=np.int64)
    np.add.at(share, orders, removed)
    return orders, {
        "kept": count.sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": np.take_along_axis(early, orders, axis=1),
        "unique_fails": own[orders],
        "good_lost": scatter(weights["good"]),
        "toxic_lost": scatter(weights["toxic"]),
        "shapley": share[orders],
    }


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = len(FILTERS)
    for batch in batches:
        for row in batch.to_pylist():
            weights = {n: np.array(row[n], dtype=np.int64) for n in ("all", "good", "toxic")}
            orders, found = audit_orders(weights, filters)
            names = np.array(["".join(FILTERS[f] for f in order) for order in orders])
            columns = [
                pa.array([row["part"]] * orders.size, pa.string()),
                pa.array(np.repeat(names, filters).tolist(), pa.string()),
                pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), len(orders))),
                *[pa.array(found[m].ravel()) for m in MEASURES],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and ``MEASURES``.

    ``redundant`` documents fail the step's filter but went earlier, ``unique_fails`` fail no
    other filter, ``shapley`` is what the filter removes summed over all orders.
    """
    weights = mask_weights(document_masks(docs, id_col, text, part), labels, id_col)
    measures = ", ".join(f"{m} bigint" for m in MEASURES)
    return weights.mapInArrow(_audit, f"part string, filter_order string, step int, {measures}")
