"""Fuzzy line deduplication: one line of each group of near-equal lines stays.

Lines are compared in lower case without outer white space; lines under ``MIN_CHARS``
characters are left alone, exact copies included.  Two lines are linked when their sets of
five-character shingles have a Jaccard similarity of 0.75 or more.

1. Equal lines become one class, by a 64-bit hash.
2. Signature: MinHash of the set in ``BANDS * ROWS`` slots (``neardup.super_minhash``).
3. Banding: ``ROWS`` slots are a bucket.  A pair at similarity 0.75 shares none of the 19 with a
   chance of 0.07%, and lines that only use the same language share few: two minima of one
   hash, tried before, put four of five lines of the check tables in a bucket with others.
   Buckets with one line are dropped, and small ones paired, as the sorted rows stream by.
4. Candidates are compared by their marks, four bits of each of 64 slots, which lines of a
   similarity below 0.4 seldom pass.  Only the texts of those that do travel.
5. What passes is confirmed on its full sets, in large buckets leaders first and then in
   blocks (``buckets``), and links grouped by union-find (``components``).
6. The first line of a group, by document and place, stays; the others go.

Shingles are hashed and sorted as numpy arrays over Arrow batches of lines.  The same by
DataFrame expressions, a regular expression and a lambda per character, takes three times
the CPU limit (README).  Everything else is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.llm import units
from paritymill.llm.buckets import bucket_links
from paritymill.llm.components import components
from paritymill.llm.neardup import compare_sets, super_minhash
from paritymill.llm.pii import let
from paritymill.llm.shared import Scratch, found_in, parted, stage

MIN_CHARS = 20
PERCENT = 75
SHINGLE = 5
BANDS, ROWS = 19, 4
SMALL = 64
MAX_APART = 20  # of 64 bits; at similarity 0.75 a bit differs with a chance of 1/8, 21 do with one of 0.002%
MARK_APART = 31  # of 64 slots; at similarity 0.75 one differs with a chance of 15/64, 32 do with one of 0.0003%
MARKS = ["m0", "m1", "m2", "m3"]
BLOCK_WIDTH = 4  # chunks of a block are so many times those of ``buckets``: most rows of a block go by their marks
_SLAB = 256
_SIGN_BYTES = 1 << 18
_ROW_BITS = 16
_SPACE = r"\x20\x09-\x0D"
_SPACE_CHARS = " \t\n\x0b\f\r"


# -- shingles ----------------------------------------------------------------------------------


def shingles(part: units.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of each line of a slice, repeated ones included."""
    starts = np.flatnonzero((part.data & 0xC0) != 0x80)  # of characters
    bounds = np.searchsorted(starts, part.bounds)
    count = np.maximum(np.diff(bounds) - SHINGLE + 1, 0)
    row = np.repeat(np.arange(part.rows), count)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    first = np.arange(len(row)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    edges = np.append(starts, len(part.data))
    return row, units.span_hashes(units.byte_values(part.data), starts[first], edges[first + SHINGLE])


def shingle_sets(part: units.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each line of a slice, by row and hash.

    Hashes have 48 bits here, so row and hash are one number and sorted as one.  Two shingles of a
    pair of lines share a hash with a chance of about (shingles)^2 / 2^49.
    """
    row, value = shingles(part)
    value = value >> np.uint64(_ROW_BITS)
    if part.rows > 1 << _ROW_BITS:  # lines of a few characters
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        return row[new], value[new]
    both = np.sort((row.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | value)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(64 - _ROW_BITS)).astype(np.int64), both & np.uint64((1 << 64 - _ROW_BITS) - 1)


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Sorted shingle hashes of each line; a line that a batch repeats is hashed once."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    out: list[np.ndarray] = []
    for part in units.slices(coded.dictionary):
        row, value = shingle_sets(part)
        out += np.split(value, np.searchsorted(row, np.arange(1, part.rows)))
    return [out[i] for i in coded.indices.to_pylist()]


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    both = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)) if len(q) else 0
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


# -- lines ---------------------------------------------------------------------------------------


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, version, line, key, body) of the lines that take part, from (doc, text)."""
    placed = docs.select(
        "doc", F.xxhash64("text").alias("version"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"),
    )
    bare = F.lower(F.btrim("raw", F.lit(_SPACE_CHARS)))
    lines = placed.select("doc", "version", "line", bare.alias("body")).where(F.length("body") >= MIN_CHARS)
    return lines.select("doc", "version", "line", F.xxhash64("body").alias("key"), "body")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, signatures) of the line classes met in a batch; repeated lines of a batch are signed once."""
    for batch in batches:
        key = batch.column("key").to_numpy()
        _, first = np.unique(key, return_index=True)
        key, bodies = key[first], batch.column("body").take(pa.array(first))
        for part in units.slices(bodies, _SIGN_BYTES):
            yield key[part.first : part.first + part.rows], super_minhash(*shingles(part), part.rows, BANDS * ROWS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rep, size) of every line class met in a batch.

    ``size`` is a sketch: a bit of each of 64 slots, to tell unlike lines of a bucket apart.
    """
    for key, signature in _signed(batches):
        bands = [
            units.mix(units.ngram_hashes(signature[:, b * ROWS : (b + 1) * ROWS].reshape(-1), ROWS)[::ROWS], b)
            for b in range(BANDS)
        ]
        bucket = np.stack(bands, axis=1).reshape(-1).view(np.int64)
        rep = np.repeat(key, BANDS)
        bits = (units.mix(signature[:, :64], 5) & np.uint64(1)) << np.arange(64, dtype=np.uint64)
        sketch = np.repeat(np.bitwise_or.reduce(bits, axis=1).view(np.int64), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rep), pa.array(sketch)], _MEMBER)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, marks) of every line class met in a batch: four bits of each of 64 slots."""
    place = 4 * np.arange(16, dtype=np.uint64)
    for key, signature in _signed(batches):
        bits = units.mix(signature[:, :64], 6) & np.uint64(15)
        words = [np.bitwise_or.reduce(bits[:, 16 * k : 16 * k + 16] << place, axis=1) for k in range(len(MARKS))]
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(w.view(np.int64)) for w in words]], ["key", *MARKS])


_LOW_BITS = 0x1111111111111111


def _marks_apart(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Slots in which the marks differ."""
    total = 0
    for p, q in zip(left, right, strict=True):
        x = (p ^ q).view(np.uint64)
        x = x | (x >> np.uint64(1))
        total = total + np.bitwise_count((x | (x >> np.uint64(2))) & np.uint64(_LOW_BITS)).astype(np.int16)
    return total


def _slots_apart(left: list[str], right: list[str]) -> Column:
    """The same of columns."""
    total = F.lit(0)
    for p, q in zip(left, right, strict=True):
        x = F.col(p).bitwiseXOR(F.col(q))
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftright(x, step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(_LOW_BITS)))
    return total


def _near(table: pa.Table) -> np.ndarray:
    """Rows of a block whose sketch and marks are close to those of a row of another label."""
    sketch, label = (table.column(c).to_numpy() for c in ("size", "label"))
    marks = [table.column(c).to_numpy() for c in MARKS]
    keep = np.zeros(len(label), dtype=bool)
    for low in range(0, len(label), _SLAB):
        some = slice(low, low + _SLAB)
        close = np.bitwise_count((sketch[some, None] ^ sketch[None, low:]).view(np.uint64)) <= MAX_APART
        i, j = np.nonzero(close & (label[some, None] != label[None, low:]))
        i, j = i + low, j + low
        near = _marks_apart([m[i] for m in marks], [m[j] for m in marks]) <= MARK_APART if len(i) else np.zeros(0, bool)
        keep[i[near]] = keep[j[near]] = True
    return keep


_MEMBER = ["bucket", "rep", "size"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What rows sorted by bucket and rep meet in their buckets: (bucket, rep, size, other).

    A bucket of at most ``SMALL`` lines gives its pairs with close sketches, ``rep`` and
    ``other``; a larger one gives its lines, with no ``other``.  Lines alone in their bucket,
    nearly all, give nothing.  No more than ``SMALL`` rows are held from batch to batch.
    """
    held = [np.zeros(0, np.int64)] * len(_MEMBER)
    large = None  # bucket known to be large, whose rows go out as they come

    def out(rows: list[np.ndarray], other: np.ndarray | None = None) -> pa.RecordBatch:
        last = pa.nulls(len(rows[0]), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([*[pa.array(r) for r in rows], last], [*_MEMBER, "other"])

    def groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket = rows[0]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        members = np.repeat(np.diff(np.append(edges, len(bucket))), np.diff(np.append(edges, len(bucket))))
        many = members > SMALL
        if many.any():
            yield out([r[many] for r in rows])
        bucket, rep, sketch = (r[(members > 1) & ~many] for r in rows)
        for step in range(1, SMALL):
            met = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(met):
                break
            met = met[np.bitwise_count((sketch[met] ^ sketch[met + step]).view(np.uint64)) <= MAX_APART]
            yield out([bucket[met], rep[met], sketch[met]], rep[met + step])

    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, _MEMBER, strict=True)]
        bucket, rep = held[:2]
        if not len(rep):
            continue
        new = np.ones(len(rep), dtype=bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (rep[1:] != rep[:-1])
        held = [h[new] for h in held]
        if large is not None:
            stop = int(np.searchsorted(held[0], large, side="right"))
            yield out([h[1:stop] for h in held])  # the first row went out before and only tells repeats
            if stop == len(held[0]):
                held = [h[-1:] for h in held]
            else:
                held, large = [h[stop:] for h in held], None
        if large is None:
            begin = int(np.searchsorted(held[0], held[0][-1]))
            yield from groups([h[:begin] for h in held])
            held = [h[begin:] for h in held]
            if len(held[0]) > SMALL:
                large = held[0][-1]
                yield out(held)
                held = [h[-1:] for h in held]
    if large is None:
        yield from groups(held)


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, version, line from 0, first_doc, first_line) of every line that goes.

    ``version`` is ``xxhash64`` of the whole text: rows that repeat an id with other texts are
    documents of their own.  ``first_doc`` and ``first_line`` name the line that stays: the
    least of its group.  Null and empty texts have no lines; rows with a null id take no part.
    Rows equal in id and text count as one document: their lines stay or go together.  An
    empty table gives an empty result; other columns are not looked at.
    """
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    lines = stage(_lines(source), "lines")
    scratch = Scratch()
    placed = lines.select("key", "body").mapInArrow(_buckets, "bucket bigint, rep bigint, size bigint")
    placed = placed.repartition("bucket").sortWithinPartitions("bucket", "rep")
    met = scratch.stage(placed.mapInArrow(_meet, "bucket bigint, rep bigint, size bigint, other bigint"), "line-met")
    close = met.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    close = scratch.stage(close, "line-pairs")
    members = met.where("other IS NULL").drop("other")
    reps = close.select(F.explode(F.array("a", "b")).alias("key")).union(members.select("rep"))
    texts = lines.select("key", "body")
    held = found_in(texts, "key", scratch.stage(reps.distinct(), "line-wanted"), exact=False)
    marks = held.mapInArrow(_mark, ", ".join(f"{c} bigint" for c in ("key", *MARKS))).dropDuplicates(["key"])
    marks = scratch.stage(marks, "line-marks")

    def bodies_of(keys: DataFrame) -> DataFrame:
        found = found_in(texts, "key", scratch.stage(keys.distinct(), "line-texts"))
        return scratch.stage(found.groupBy("key").agg(F.min("body").alias("body")), "line-bodies")

    def confirm(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = [_sets(batch.column(c)) for c in ("body_a", "body_b")]
                keep = [alike(p, q) for p, q in zip(*sides, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        at_a, at_b = ([f"{side}_{c}" for c in MARKS] for side in "ab")
        marked = pairs.join(marks.toDF("b", *at_b), "b").join(marks.toDF("a", *at_a), "a")
        likely = scratch.stage(marked.where(_slots_apart(at_a, at_b) <= MARK_APART).select("a", "b"), "line-likely")
        bodies = bodies_of(likely.select(F.explode(F.array("a", "b")).alias("key")))
        full = likely.join(bodies.toDF("b", "body_b"), "b").join(bodies.toDF("a", "body_a"), "a")
        return full.select("a", "b", "body_a", "body_b").mapInArrow(run, "a bigint, b bigint")

    def compare_blocks(blocks: DataFrame) -> DataFrame:
        columns = blocks.columns

        def near(key: tuple, table: pa.Table) -> pa.Table:
            return table.filter(pa.array(_near(table))).select(columns)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            return compare_sets(key, table, _sets(table.column("body")), PERCENT)

        group = ["bucket", "low", "high"]
        marked = blocks.join(marks.toDF("rep", *MARKS), "rep").select(*columns, *MARKS)
        rows = scratch.stage(marked.groupBy(*group).applyInArrow(near, blocks.schema), "line-near")
        full = rows.join(bodies_of(rows.select("rep").toDF("key")).toDF("rep", "body"), "rep")
        return full.groupBy(*group).applyInArrow(run, "a bigint, b bigint")

    apart = F.bit_count(F.col("na").bitwiseXOR(F.col("nb")))
    found = scratch.stage(confirm(close), "line-links")
    links = bucket_links(
        members, PERCENT, confirm, scratch, rounds=2, compare_blocks=compare_blocks, close=apart <= MAX_APART,
        width=BLOCK_WIDTH,
    )
    links = links.union(found)
    groups = components(links, "a", "b").toDF("key", "component")
    scratch.clear()
    place = F.struct("doc", "line", "version")
    first = lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"))
    grouped = first.join(groups, "key", "left").where("rows > 1 OR component IS NOT NULL")
    grouped = stage(grouped.select("key", F.coalesce("component", "key").alias("component"), "first"), "line-groups")
    stays = grouped.groupBy("component").agg(F.min("first").alias("first"))
    keep = grouped.select("key", "component").join(stays, "component").select("key", "first")
    gone = lines.select("key", "doc", "version", "line").join(keep, "key").where(place != F.col("first"))
    return gone.select(
        F.col("doc").alias(doc_id), "version", "line", F.col("first.doc").alias("first_doc"),
        F.col("first.line").alias("first_line"),
    ).distinct()


def dropped_by_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, dropped): ascending line numbers that go, for documents that lose any."""
    gone = duplicate_lines(docs, doc_id, text)
    return gone.groupBy(F.col(doc_id).alias("doc"), "version").agg(F.sort_array(F.collect_list("line")).alias("dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """``text`` without the lines numbered in ``dropped``; unchanged when that is null."""

    def rest(s: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["dropped"])
        return let(
            F.struct(s["lines"].alias("lines"), keep.alias("keep")),
            lambda t: F.array_join(F.transform(t["keep"], lambda i: t["lines"][i]), "\n"),
        )

    return F.when(dropped.isNull(), text).otherwise(
        let(F.struct(F.split(text, "\n").alias("lines"), dropped.alias("dropped")), rest)
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text``; all columns stay.

    A document that is left without a word keeps its row, or goes with ``drop_emptied``;
    documents that lose no line always stay, and most of them do not travel.
    """
    gone = dropped_by_document(docs, doc_id, text).toDF("_gone_doc", "_gone_version", "_gone_lines")
    gone = stage(gone, "line-gone")
    keyed = docs.withColumn("_gone_doc", F.col(doc_id).cast("bigint"))
    touched, rest = (part.select(*docs.columns) for part in parted(keyed, "_gone_doc", gone))
    same = (F.col(doc_id) == F.col("_gone_doc")) & (F.xxhash64(text) == F.col("_gone_version"))
    joined = touched.join(gone, same, "left")
    if drop_emptied:
        left = without_lines(F.col(text), F.col("_gone_lines"))
        joined = joined.where(F.col("_gone_lines").isNull() | left.rlike(f"[^{_SPACE}]"))
    changed = joined.select(
        *[without_lines(F.col(c), F.col("_gone_lines")).alias(c) if c == text else F.col(c) for c in docs.columns]
    )
    return changed.union(rest)
