"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A document's set is its distinct five-word shingles (the whole word sequence when it has
fewer words).  Two documents are linked when their sets have a Jaccard similarity of 0.75
or more, and each link is confirmed on the full sets.

1. Signatures.  For element d and level j = 0, 1, ... SuperMinHash draws r in [0, 1) and one
   place of a Fisher-Yates permutation of d's own; slot ``place`` keeps the least j + r.
   A document stops at the first level that can lower no slot.  Levels are done for
   all shingles of a slice of texts at once, which gives the same signature as element
   by element.
2. Equal sets become one class before anything else, however many copies there are.  Classes have
   numbers of their own, so rows that repeat an id with different texts are compared each.
3. Banding.  20 bands of 3 slots: a pair at similarity 0.75 shares a band with a chance of
   0.99998.
4. Verification on full sets, leaders first (``buckets``), and union-find (``components``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritymill.llm import units
from paritymill.llm.buckets import bucket_links, live_members
from paritymill.llm.components import components
from paritymill.llm.shared import Scratch, found_in, stage

SHINGLE = 5
BANDS, ROWS = 20, 3
PERCENT = 75


def shingle_sets(part: units.Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text of a slice, by row and hash."""
    w = units.words(part)
    row_of = np.repeat(np.arange(part.rows), w.counts)
    whole = units.ngram_hashes(w.hashes, size)
    fits = row_of[: len(whole)] == row_of[len(w.hashes) - len(whole) :] if len(whole) else np.zeros(0, bool)
    rows, hashes = [row_of[: len(whole)][fits]], [whole[fits]]
    for short in range(1, size):
        at = np.flatnonzero(w.counts == short)
        if len(at):
            rows.append(at)
            hashes.append(units.ngram_hashes(w.hashes, short)[w.bounds[at]])
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(value)
    row = row[order]
    by_row = np.argsort(row.astype(np.uint16) if part.rows < 65_536 else row, kind="stable")
    row, value = row[by_row], value[order][by_row]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def super_minhash(row: np.ndarray, value: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures (rows x slots) as level and 32-bit draw; rows without elements keep all ones."""
    low = np.uint64(0xFFFFFFFF)
    signature = np.full((rows, slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = signature.reshape(-1)
    places = first = np.zeros(0, dtype=np.int64)
    for level in range(slots):
        alive = (signature.max(axis=1) >= np.uint64(level << 32))[row]
        if not alive.any():
            break
        row, value = row[alive], value[alive]
        draw = units.mix(value, level + 1)
        pick = level + (((draw >> np.uint64(32)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = first = pick
        else:
            each = np.arange(len(row))
            if level == 1:  # the first swap of each permutation was with place 0
                places = np.tile(np.arange(slots, dtype=np.uint16), (len(row), 1))
                places[each, first[alive]] = 0
                places[:, 0] = first[alive]
            else:
                places = places[alive]
            slot = places[each, pick].astype(np.int64)
            places[each, pick] = places[:, level]
            places[:, level] = slot
        np.minimum.at(flat, row * slots + slot, (draw & low) | np.uint64(level << 32))
    return signature


_SIGNATURE = "id bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>"
_SET = "id bigint, n_shingles bigint, key1 bigint, key2 bigint, shingles binary"
_CLASS = ["key1", "key2", "n_shingles"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, units.Slice, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in units.slices(batch.column("text")):
            yield batch.column("id").slice(part.first, part.rows), part, *shingle_sets(part)


def _set_keys(value: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """128 bits of each set that do not depend on its order."""
    keys = []
    for salt in (71, 72):
        total = np.concatenate([[np.uint64(0)], np.cumsum(units.mix(value, salt), dtype=np.uint64)])
        keys.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, part, row, value in _read(batches):
        bounds = np.searchsorted(row, np.arange(part.rows + 1))
        size = np.diff(bounds)
        signature = super_minhash(row, value, part.rows, BANDS * ROWS)
        bands = np.stack(
            [
                units.mix(units.ngram_hashes(signature[:, b * ROWS : (b + 1) * ROWS].reshape(-1), ROWS)[::ROWS], b)
                for b in range(BANDS)
            ],
            axis=1,
        )
        filled = size > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(size.astype(np.int64)),
                *_set_keys(value, bounds),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[filled].reshape(-1).view(np.int64))),
            ],
            names=["id", "n_shingles", "key1", "key2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, part, row, value in _read(batches):
        bounds = np.searchsorted(row, np.arange(part.rows + 1))
        blob, at = value.tobytes(), bounds * 8
        sets = [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(bounds).astype(np.int64)), *_set_keys(value, bounds), pa.array(sets, pa.binary())],
            names=["id", "n_shingles", "key1", "key2", "shingles"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p))
            keep[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _overlaps(row: np.ndarray, value: np.ndarray, rows: int, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shared shingles."""
    known, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((rows, rows), dtype=np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((rows, width), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return both


def compare_sets(key: tuple, table: pa.Table, sets: list[np.ndarray], percent: int) -> pa.Table:
    """Links that join the groups of two chunks of a bucket: at most one for each member."""
    rep, label, chunk = (table.column(n).to_numpy() for n in ("rep", "label", "chunk"))
    size = np.array([len(s) for s in sets])
    both = _overlaps(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= label[:, None] != label[None, :]
    if key[1].as_py() != key[2].as_py():
        linked &= chunk[:, None] != chunk[None, :]
    parent = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            parent[x] = y
            out.append((int(rep[i]), int(rep[j])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("shingles")]
    return compare_sets(key, table, sets, PERCENT)


def _links_of(classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between classes; their transitive closure is that of all links."""
    exploded = scratch.stage(classes.select(F.explode("bands").alias("bucket"), F.col("class").alias("rep"), F.col("n_shingles").alias("size")), "buckets")
    members = scratch.stage(live_members(exploded, "bucket", "rep"), "members")
    wanted = classes.join(members.select(F.col("rep").alias("class")).distinct(), "class").select("class", F.col("rep").alias("id"), *_CLASS)
    wanted = scratch.stage(wanted, "wanted")
    # texts that no pair needs stay where they are; only the others travel
    of_ids = found_in(docs, "id", wanted).mapInArrow(_sets, _SET)
    # a class of a repeated id has its set among those of the id's texts, once or more
    chosen = of_ids.dropDuplicates(["id", *_CLASS]).join(wanted, ["id", *_CLASS])
    sets = scratch.stage(chosen.select(F.col("class").alias("id"), "shingles"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        # a member's set moves twice, a leader's not at all
        full = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
        return full.select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a bigint, b bigint")

    def compare_blocks(blocks: DataFrame) -> DataFrame:
        full = blocks.join(sets.toDF("rep", "shingles"), "rep")
        return full.groupBy("bucket", "low", "high").applyInArrow(_compare, "a bigint, b bigint")

    return bucket_links(members, PERCENT, confirm, scratch, rounds=1, compare_blocks=compare_blocks)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, n_shingles, component_id (smallest linked id), kept.

    Null, empty and blank texts have no set: they link with nothing and stay.  A row with a
    null id cannot be linked: it has no component and stays.  Rows that repeat an id are
    returned as often, share one component and are kept or dropped together; what is like
    the text of one of them is linked to all.  An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = stage(source.mapInArrow(_signatures, _SIGNATURE), "signatures")
    real = signed.where("n_shingles > 0 AND id IS NOT NULL")
    scratch = Scratch()
    grouped = real.groupBy(*_CLASS).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.stage(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    linked = _links_of(classes, source.where("id IS NOT NULL"), scratch)
    a, b = (classes.select(F.col("class").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    near = linked.join(a, "a").join(b, "b").where("rep_a <> rep_b").select("rep_a", "rep_b").toDF("a", "b")
    copies = (
        real.select("id", *_CLASS).join(classes.select(*_CLASS, "rep"), _CLASS).where("id <> rep").select("rep", "id")
    )
    groups = components(near.union(copies), "a", "b").toDF("id", "component")
    scratch.clear()
    return signed.select("id", "n_shingles").join(groups, "id", "left").select(
        F.col("id").alias(doc_id),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        (F.col("component").isNull() | (F.col("component") == F.col("id"))).alias("kept"),
    )
