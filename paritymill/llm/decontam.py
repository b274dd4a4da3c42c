"""Benchmark decontamination: three-word seeds find candidates, Smith-Waterman alignment scores them.

1. The rarest three-word grams of each test item are its seeds.  Of n different grams, absent ones counted
   as none, all but the ``ceil(SHARED * n) - 2`` most frequent are taken: a passage that shares a fifth
   of an item's grams has two seeds of it at least, whatever the number of its copies, while phrases that
   many items and documents share are the first to go.  Rarity is judged inside an item only.
2. Documents with two different seeds near each other are joined to the items by equality of seeds.
3. Hits of one item on nearby diagonals (place in the document less place in the item), of two different
   seeds or more, make a candidate passage.
4. The passage and the item are aligned locally word by word (match 2, mismatch and gap -1).  A score
   of half the item's own or more, over eight matched words or more, is a leak: copies, edited and
   paraphrased ones alike.  Edits that leave fewer than two runs of three words hide a leak (every third
   word changed scores one half), and so do edits that leave less than a fifth of the item's grams.  An item under eight words cannot be told from ordinary text and never leaks.
5. A leak must rest on more than ordinary phrases.  It holds two grams of the rarest half of its item's, or two
   of the rarest half of an eight-word stretch, counts being compared with the item's own only; or it holds
   a gram that stands mostly in leaks of that item, as those of a copy do however often it is repeated.

The document scan knows items only through a bitmap of fixed size; what passes it is joined exactly.
Words are compared in lower case, as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritymill.llm import units
from paritymill.llm.shared import stage

GRAM = 3
BITMAP_BITS = 26
STRETCH = 8
DIAGONAL = 64
SLACK = 16
MIN_MATCHED = 8
MIN_SHARE = 0.5
SHARED = 0.2
MATCH, MISS, GAP = 2, -1, -1

_ITEM = "item bigint, words binary, n_words int"
_GRAM_ROWS = "item bigint, n_words int, at int, gram bigint"
_COUNT_ROWS = "gram bigint, found bigint"
_HIT_ROWS = "row bigint, doc bigint, words binary, grams array<bigint>, places array<int>"
LEAKS = "row bigint, doc bigint, item bigint, rare boolean, score double, start_word int, end_word int"


def _grams(w: units.Words, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, word place in its text, hash) of every gram inside a text."""
    all_grams = units.ngram_hashes(w.hashes, n)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    fits = row[: len(all_grams)] == row[n - 1 : n - 1 + len(all_grams)]
    at = np.flatnonzero(fits)
    return row[at], at - w.bounds[row[at]], all_grams[at]


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in units.slices(batch.column("text")):
            w = units.words(part)
            blob, at = w.hashes.tobytes(), (w.bounds * 8).tolist()
            words = [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").slice(part.first, part.rows), pa.array(words, pa.binary()), pa.array(w.counts.astype(np.int32))],
                names=["item", "words", "n_words"],
            )


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, blob, n in zip(*[batch.column(c) for c in ("item", "words", "n_words")], strict=True):
            grams = units.ngram_hashes(np.frombuffer(blob.as_buffer(), dtype=np.uint64), GRAM)
            k = len(grams)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item.as_py()] * k, pa.int64()),
                    pa.array([n.as_py()] * k, pa.int32()),
                    pa.array(np.arange(k, dtype=np.int32)),
                    pa.array(grams.view(np.int64)),
                ],
                names=["item", "n_words", "at", "gram"],
            )


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' leading ``BITMAP_BITS`` bits, in a table of fixed size."""
    place = F.shiftrightunsigned("gram", 64 - BITMAP_BITS)
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    words = grams.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), bit.alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def _known(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = (grams >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (table[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _count(bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in units.slices(batch.column("text")):
                grams = _grams(units.words(part))[2]
                found.append(grams[_known(bitmap.value, grams)])
            gram, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], names=["gram", "found"])

    return run


def _hits(bitmap, reach: int) -> Callable:
    """Documents with two different seeds at most ``reach`` words apart: all their word hashes, and grams and places of the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for part in units.slices(batch.column("text")):
                w = units.words(part)
                row, at, gram = _grams(w)
                hit = np.flatnonzero(_known(bitmap.value, gram))
                row, at, gram = row[hit], at[hit], gram[hit]
                out: list[tuple] = []
                cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if ((np.diff(at[a:b]) <= reach) & (gram[a + 1 : b] != gram[a : b - 1])).any():
                        r = row[a]
                        words = w.hashes[w.bounds[r] : w.bounds[r + 1]].tobytes()
                        out.append((number, docs[part.first + r], words, gram[a:b].view(np.int64), at[a:b].astype(np.int32)))
                        number += 1
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["row", "doc", "words", "grams", "places"],
                )

    return run


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage: (score, start, end) in passage words.

    All pairs advance together, one item word a step.  A cell holds its score above bit 32 and
    the start of its alignment below, so the best cell carries its span along.
    """
    n, wide, long = len(items), max(map(len, passages)), max(map(len, items))
    a, b = np.zeros((n, long), np.uint64), np.zeros((n, wide), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    inside = np.arange(wide)[None, :] < np.array([len(p) for p in passages])[:, None]
    unit = np.int64(1) << 32
    column = np.arange(wide, dtype=np.int64)
    slope = column * (-GAP) * unit
    last = np.zeros((n, wide), dtype=np.int64)
    best, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lengths = np.array([len(x) for x in items])
    for k in range(long):
        before = np.zeros_like(last)
        before[:, 1:] = last[:, :-1]
        before = np.where(before < unit, column, before)  # a new alignment starts here
        step = np.where((a[:, k, None] == b) & inside & (k < lengths)[:, None], MATCH, MISS) * unit
        cell = np.maximum(before + step, last + GAP * unit)
        cell = np.maximum.accumulate(np.where(cell < unit, 0, cell) + slope, axis=1) - slope
        last = np.where((cell < unit) | ~inside, 0, cell)
        at = last.argmax(axis=1)
        top = last[np.arange(n), at]
        more = (top >> 32) > (best >> 32)
        best, end = np.where(more, top, best), np.where(more, at + 1, end)
    return best >> 32, best & (unit - 1), end


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaks among candidates (row, doc, item, rare, start, item_words, passage)."""
    for batch in batches:
        start = batch.column("start").to_numpy()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("item_words")]
        passages = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("passage")]
        size = np.array([len(i) for i in items], dtype=np.int64)
        order = np.argsort([len(p) for p in passages], kind="stable")
        score, begin, end = (np.zeros(len(items), dtype=np.int64) for _ in range(3))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, min(512, 1_000_000 // max(1, len(passages[order[min(at + 511, len(order) - 1)]]))))]
            score[group], begin[group], end[group] = smith_waterman([items[g] for g in group], [passages[g] for g in group])
            at += len(group)
        leak = (score >= MIN_SHARE * MATCH * size) & (score >= MATCH * MIN_MATCHED)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("row", "doc", "item", "rare")],
                pa.array(score / np.maximum(1, MATCH * size)),
                pa.array((begin + start).astype(np.int32)),
                pa.array((end + start).astype(np.int32)),
            ],
            names=["row", "doc", "item", "rare", "score", "start_word", "end_word"],
        ).filter(pa.array(leak))


def _seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, at, gram, found, rare, rare_here) of the rarest grams that occur: rare in its item, rare in its stretch of it."""
    counted = grams.join(counts, "gram", "left")
    ranked = counted.groupBy("item", "gram").agg(F.coalesce(F.max("found"), F.lit(0)).alias("f"))
    order = Window.partitionBy("item").orderBy("f", "gram")
    ranked = ranked.withColumns({"place": F.row_number().over(order), "kinds": F.count(F.lit(1)).over(Window.partitionBy("item"))})
    chosen = ranked.where(F.col("place") <= F.col("kinds") - F.ceil(F.lit(SHARED) * F.col("kinds")) + 2).select("item", "gram")
    item, stretch = Window.partitionBy("item"), Window.partitionBy("item", F.floor(F.col("at") / STRETCH))
    placed = counted.withColumn("n", F.count(F.lit(1)).over(item)).where("found > 0").withColumns(
        {
            "rank": F.rank().over(item.orderBy("found")),
            "n_here": F.count(F.lit(1)).over(stretch),
            "rank_here": F.rank().over(stretch.orderBy("found")),
        }
    )
    rare, rare_here = F.expr("2 * rank <= n + 1"), F.expr("2 * rank_here <= n_here + 1")
    placed = placed.select("item", "at", "gram", "found", rare.alias("rare"), rare_here.alias("rare_here"))
    return placed.join(chosen, ["item", "gram"], "left_semi")


def _grounded(leaks: DataFrame, met: DataFrame) -> DataFrame:
    """Leaks that rest on more than ordinary phrases; ``met`` are the hits of seeds."""
    key = ["row", "item", "start_word", "end_word"]
    inside = met.join(leaks.select(*key).distinct(), ["row", "item"]).where((F.col("place") >= F.col("start_word")) & (F.col("place") + GRAM <= F.col("end_word")))
    shared = inside.groupBy(*key, "gram", "place").agg(F.max("found").alias("found"), F.max("rare_here").alias("rare_here"))
    held = shared.groupBy("item", "gram").agg(F.count_distinct("row", "place").alias("held"))
    rests = shared.join(held, ["item", "gram"]).groupBy(*key).agg(
        F.count_distinct(F.when(F.col("rare_here"), F.col("gram"))).alias("n_here"), F.max(F.expr("2 * held >= found")).alias("own")
    )
    return leaks.join(rests, key, "left").where("rare OR n_here > 1 OR own")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(``doc_id``, ``item_id``, score, start_word, end_word) of every leaked item, best passage each.

    ``score`` is the alignment score over the item's own, 1.0 for a copy.  Null and empty
    texts and items leak nothing; null ids are carried like any others; rows that repeat an id give
    one result.  Equal items are all reported.  An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.lower(text).alias("text"))
    texts = benchmark.select(F.col(item_id).cast("bigint").alias("item"), F.lower(item_text).alias("text"))
    items = stage(texts.mapInArrow(_read_items, _ITEM).where(F.col("n_words") >= MIN_MATCHED), "items")
    grams = stage(items.mapInArrow(_item_grams, _GRAM_ROWS), "item-grams")
    every = spark.sparkContext.broadcast(_bitmap(grams))
    counts = source.select("text").mapInArrow(_count(every), _COUNT_ROWS).groupBy("gram").agg(F.sum("found").alias("found"))
    seeds = stage(_seeds(grams, counts), "seeds")
    # seeds in one band of diagonals are no further apart than this
    reach = items.agg(F.coalesce(F.max("n_words"), F.lit(0)).alias("n")).head().n + DIAGONAL
    hits = stage(source.mapInArrow(_hits(every, reach), _HIT_ROWS), "hits")

    places = hits.select("row", F.explode(F.arrays_zip("grams", "places")).alias("p")).select(
        "row", F.col("p.grams").alias("gram"), F.col("p.places").alias("place")
    )
    met = places.join(seeds, "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    # two ways to cut the diagonals, so that neighbours share one of them
    bands = F.array(F.floor(F.col("diagonal") / DIAGONAL) * 2, F.floor((F.col("diagonal") + DIAGONAL // 2) / DIAGONAL) * 2 + 1)
    found = (
        met.select("row", "item", "gram", "rare", "diagonal", F.explode(bands).alias("band"))
        .groupBy("row", "item", "band")
        .agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.min("gram").alias("g0"),
            F.max("gram").alias("g1"),
            F.min(F.when(F.col("rare"), F.col("gram"))).alias("r0"),
            F.max(F.when(F.col("rare"), F.col("gram"))).alias("r1"),
        )
        .where("g0 < g1")
        .groupBy("row", "item", "low", "high")
        .agg(F.max(F.coalesce(F.expr("r0 < r1"), F.lit(False))).alias("rare"))
    )
    texts = items.select("item", "n_words", F.col("words").alias("item_words")).distinct()
    candidates = found.join(texts, "item").join(hits.select("row", "doc", "words"), "row")
    start = F.greatest(F.col("low") - SLACK, F.lit(0))
    span = F.col("high") + F.col("n_words") + SLACK - start
    passage = F.substring("words", (8 * start + 1).cast("int"), (8 * F.greatest(span, F.lit(0))).cast("int"))
    cut = candidates.select("row", "doc", "item", "rare", start.alias("start"), "item_words", passage.alias("passage"))
    aligned = cut.mapInArrow(_align, LEAKS)
    leaks = _grounded(stage(aligned, "aligned"), met.select("row", "item", "gram", "place", "found", "rare_here"))
    best = leaks.groupBy("doc", "item").agg(
        F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word")).alias("best")
    )
    return best.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("best.score").alias("score"),
        (-F.col("best.back")).alias("start_word"),
        F.col("best.end_word").alias("end_word"),
    )
