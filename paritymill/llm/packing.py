"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of 4096 tokens takes from each source its share of the target proportions; the
fraction a source is owed beyond whole tokens, its deficit, is carried to the next window.
A shared counter that walks the windows would be one task, so the deficits are kept in
closed form.  The sources are the leaves of a binary tree.  Of the first x tokens that a node
lets through, its left side sends

    left(x) = clamp(floor(x * w_left / (w_left + w_right)), x - right tokens, left tokens)

and its right side the rest.  Both counts grow by 0 or 1 a token, so each source's queue
position at any window is exact integer arithmetic over the path to its leaf; its deficit stays
below one token a level; a queue that runs dry leaves its share to its siblings; and any
partition knows the deficits of any window without seeing the others.

Queues are ordered by input partition and position in it.  Token prefix sums are made inside
each partition and over one row per (source, partition), never over a source in one task.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritymill.llm import bpe, units
from paritymill.llm.shared import stage

WINDOW = 4096
MAX_QUEUES = 65_536

_TOKENS = "id bigint, source string, chunk bigint, before bigint, n_tokens bigint, ids binary"
PIECES = (
    "doc_id bigint, source string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


def tokenize(path: str, keep_space: bool, end: int) -> Callable:
    """Arrow mapper: ids of each text, and the tokens of its source before it in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path, keep_space)
        chunk = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            for part in units.slices(batch.column("text")):
                ids, bounds = encoder.encode(part, end)
                blob, size = ids.astype("<u4").tobytes(), np.diff(bounds).tolist()
                before = []
                for source, n in zip(sources[part.first : part.first + part.rows], size, strict=True):
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + n
                at = (bounds * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(part.first, part.rows),
                        batch.column("source").slice(part.first, part.rows),
                        pa.array([chunk] * part.rows, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    names=["id", "source", "chunk", "before", "n_tokens", "ids"],
                )

    return run


class Schedule:
    """Queue positions of every source at every window."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, float], window: int = WINDOW) -> None:
        self.window, self.total = window, sum(totals.values())
        self.windows = -(-self.total // window)
        self.paths: dict[str, list[tuple]] = {}
        scaled = {s: round(weights[s] * 1_000_000) if s in weights else totals[s] for s in totals}
        self._split(sorted(totals), totals, scaled, [])

    def _split(self, names: list[str], totals: Mapping[str, int], weights: Mapping[str, int], path: list) -> None:
        if len(names) == 1:
            self.paths[names[0]] = path
            return
        sides = names[: len(names) // 2], names[len(names) // 2 :]
        node = tuple(sum(m[s] for s in side) for m in (totals, weights) for side in sides)
        for turn, side in enumerate(sides):
            self._split(side, totals, weights, [*path, (turn, *node)])

    @functools.lru_cache(maxsize=1 << 14)  # noqa: B019 - lives as long as the task
    def position(self, source: str, w: int) -> tuple[int, int]:
        """(tokens of ``source``, tokens of the sources left of it) in the first ``w`` windows."""
        x, left_of = min(w * self.window, self.total), 0
        for turn, left_total, right_total, left_weight, right_weight in self.paths[source]:
            left = min(left_total, max(x - right_total, x * left_weight // (left_weight + right_weight)))
            if turn:
                x, left_of = x - left, left_of + left
            else:
                x = left
        return x, left_of

    def window_of(self, source: str, token: int) -> int:
        """The window that takes queue position ``token`` of ``source``."""
        low, high = 0, self.windows
        while high - low > 1:
            middle = (low + high) // 2
            if self.position(source, middle)[0] <= token:
                low = middle
            else:
                high = middle
        return low

    def pieces(self, source: str, start: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset in the window) of queue positions from ``start``."""
        w, done = self.window_of(source, start), 0
        while done < size:
            (begin, left), (stop, left_after) = self.position(source, w), self.position(source, w + 1)
            take = min(stop - start - done, size - done)
            if take > 0:
                yield done, take, w, left_after - left + start + done - begin
                done += take
            w += 1


def _cut(schedule: Schedule) -> Callable:
    """Arrow mapper: pieces of documents, about ``units.SLICE_BYTES`` of ids at a time.

    The pieces of a batch follow each other as their ids do, so a run of them shares the batch's bytes.
    """

    def made(batch: pa.RecordBatch, flat: array) -> pa.RecordBatch:
        row, start, size, window, offset = np.frombuffer(flat, np.int64).reshape(-1, 5).T
        ids, source, doc, total = (batch.column(n) for n in ("ids", "source", "id", "n_tokens"))
        bounds = np.concatenate([[0], np.cumsum(4 * size)])
        first = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset + row[0]] + 4 * start[0]
        shared = [None, pa.py_buffer(bounds.astype(np.int32)), ids.buffers()[2].slice(int(first), int(bounds[-1]))]
        row = pa.array(row)
        columns = [
            doc.take(row), source.take(row), *map(pa.array, (start, size)), total.take(row), *map(pa.array, (window, offset)),
            pa.Array.from_buffers(pa.binary(), len(row), shared),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, held = array("q"), 0
            rows = zip(*[batch.column(n).to_pylist() for n in ("source", "base", "n_tokens")], strict=True)
            for row, (source, base, size) in enumerate(rows):
                for piece in schedule.pieces(source, base, size):
                    flat.extend((row, *piece))
                    held += 4 * piece[1]
                    if held >= units.SLICE_BYTES:
                        yield made(batch, flat)
                        flat, held = array("q"), 0
            if flat:
                yield made(batch, flat)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    keep_space: bool,
    end: int,
    targets: Mapping[str, float] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens; only the last window can be shorter.

    ``targets`` gives the sources' token proportions, of all sources or of none; without it
    they are the corpus's own, so all queues end together.  Each id, each document's end id
    included, is in exactly one piece.  A null source is the queue named ''.  A null or empty
    text is its end id.  Null and repeated document ids are packed like any others.  An empty table
    has no pieces.  More than ``MAX_QUEUES`` sources raise: a mixture is a bounded list.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(text).alias("text"),
    )
    tokens = stage(read.mapInArrow(tokenize(tokenizer, keep_space, end), _TOKENS), "packing-ids")
    chunks = stage(tokens.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("size")), "packing-chunks")
    listed = chunks.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_QUEUES + 1).toPandas()
    if len(listed) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources: give coarser ones")
    if listed.empty:
        return spark.createDataFrame([], PIECES)
    totals = dict(zip(listed["source"], map(int, listed["size"]), strict=True))
    weights = dict(targets or {})
    if weights and (totals.keys() - weights.keys() or min(weights.values()) <= 0):
        raise ValueError("targets need a positive proportion for every source")
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(
        chunks.select("source", "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("queued")), "packing-bases"
    )
    placed = tokens.join(bases, ["source", "chunk"]).select(
        "id", "source", (F.col("queued") + F.col("before")).alias("base"), "n_tokens", "ids"
    )
    return placed.mapInArrow(_cut(Schedule(totals, weights)), PIECES)


