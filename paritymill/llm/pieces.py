"""SentencePiece ids of whole texts, and texts of ids, through a table of distinct chunks.

White space is a marker before a word, and a marker stands before every text.  Two
characters that stand side by side in no piece of a BPE model are never merged, so texts
are cut there: before a marker behind anything else, and mostly between a marked word and
its punctuation.  The ids of a text are the ids of its chunks in order.

Each worker keeps a table of the distinct chunks it has met, filled by the library once per
chunk, with the ids and the text that they decode to.  A slice of texts becomes the table's
row number at each position, and ids and decoded texts join back by position, as array
operations.  Nothing is shuffled.  The table is emptied when it reaches its bound, which
costs time and changes no result.

A null or empty text has no chunk: its ids are the end id alone, its decoded text is empty.
Repeated rows each keep their own result.  An empty table gives no rows.  Columns that are carried along come back inside the
struct ``row``, so no name can clash.  Tests hold ids and texts against the library's own
encoding and decoding of whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritymill.llm import units

MARKER = "▁"
TABLE_CHUNKS = 1 << 20
_LONGEST_KEPT = 64


# -- model -------------------------------------------------------------------------------------


@functools.cache
def _spec(path: str):
    """The model file; raises for a model that does more to a text than mark its white space."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        spec = proto.ModelProto.FromString(file.read())
    normal, trainer = spec.normalizer_spec, spec.trainer_spec
    plain = normal.name == "identity" and not normal.precompiled_charsmap
    if not plain or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("the model must leave texts as they are but for a leading marker")
    own = proto.ModelProto.SentencePiece.USER_DEFINED
    if trainer.model_type != proto.TrainerSpec.BPE or any(p.type == own for p in spec.pieces):
        raise ValueError("the model must be a BPE model without pieces of the user's own")
    return spec


@functools.cache
def processor(path: str, marked: bool = True):
    """The library's processor; ``marked`` false leaves out the marker before the text."""
    import sentencepiece

    spec = type(_spec(path))()
    spec.CopyFrom(_spec(path))
    spec.normalizer_spec.add_dummy_prefix = marked
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


@functools.cache
def joints(path: str) -> np.ndarray:
    """Which ASCII characters may be merged with which next one; 128 is any other character."""
    may = np.zeros((129, 129), dtype=bool)
    may[128, 128] = True
    for piece in _spec(path).pieces:
        places = [min(ord(c), 128) for c in piece.piece.replace(MARKER, " ")]
        may[places[:-1], places[1:]] = True
    return may


# -- chunks --------------------------------------------------------------------------------------


def marked_texts(column: pa.Array) -> pa.Array:
    """Texts with the marker before each that is not empty; markers are spaces."""
    plain = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARKER, " ")
    space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.if_else(pc.equal(plain, none), plain, pc.binary_join_element_wise(space, plain, none))


def chunk_starts(part: units.Slice, may: np.ndarray) -> np.ndarray:
    """Byte positions at which the chunks of a slice of marked texts start."""
    kind = np.minimum(part.data, 128)
    cut = np.zeros(len(kind), dtype=bool)
    cut[1:] = ~may[kind[:-1], kind[1:]]
    cut[part.bounds[:-1][part.bounds[:-1] < part.bounds[1:]]] = True
    return np.flatnonzero(cut)


class ChunkTable:
    """Distinct chunks met so far: row number by hash, ids and decoded text by row number."""

    def __init__(self, path: str) -> None:
        self.model, self.may = processor(path, marked=False), joints(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pieces: list[str] = []
        self.sizes, self.firsts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.filled = np.zeros(1 << 14, np.int32), 0

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Rows of new chunks, each encoded and decoded once."""
        ids = self.model.encode(chunks, num_threads=1)
        rows = np.arange(len(self.pieces), len(self.pieces) + len(chunks))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        stop = self.filled + int(sizes.sum())
        self.pieces.extend(self.model.decode(ids, num_threads=1))
        while len(self.pieces) > len(self.sizes):
            self.sizes, self.firsts = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.firsts, 2 * len(self.firsts))
        while stop > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[rows], self.firsts[rows] = sizes, self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : stop] = np.fromiter((i for found in ids for i in found), np.int32, stop - self.filled)
        self.filled = stop
        return rows

    def rows(self, part: units.Slice, starts: np.ndarray) -> np.ndarray:
        """Table row of each chunk of a slice."""
        if len(self.pieces) > TABLE_CHUNKS:
            self._clear()
        ends = np.append(starts[1:], len(part.data))
        hashes = units.span_hashes(units.byte_values(part.data), starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        rows = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            blob, at = part.data.tobytes(), first[missing]
            spans = zip(starts[at].tolist(), ends[at].tolist(), strict=True)
            rows[missing] = self._add([blob[a:b].decode("utf-8", "replace") for a, b in spans])
            short = missing[ends[at] - starts[at] <= _LONGEST_KEPT]
            self.known.update(zip([keys[m] for m in short.tolist()], rows[short].tolist(), strict=True))
        return rows[which]

    def encode(self, part: units.Slice, end: int | None) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded texts) of the texts of a slice of marked texts."""
        starts = chunk_starts(part, self.may)
        rows = self.rows(part, starts) if len(starts) else np.zeros(0, np.int64)
        stops = np.searchsorted(starts, part.bounds)
        size = self.sizes[rows]
        done = np.cumsum(size)
        bounds = np.concatenate([[0], done])[stops]
        ids = self.flat[np.repeat(self.firsts[rows] - (done - size), size) + np.arange(bounds[-1])]
        if end is not None:
            each = np.arange(part.rows + 1)
            closed = np.full(len(ids) + part.rows, end, dtype=np.int32)
            closed[np.arange(len(ids)) + np.repeat(each[:-1], np.diff(bounds))] = ids
            ids, bounds = closed, bounds + each
        words = list(map(self.pieces.__getitem__, rows.tolist()))
        # the marker before a text is the library's own
        texts = ["".join(words[a:b])[1:] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(texts, pa.string())


@functools.cache
def chunk_table(path: str) -> ChunkTable:
    """One table per worker and model file."""
    return ChunkTable(path)


def encode(docs: DataFrame, path: str, carry: Sequence[str], text: str = "text", end: bool = True) -> DataFrame:
    """Ids of every whole text, and the text they decode to: row (the columns ``carry``), ids, decoded.

    ``path`` names the model file, the same on all machines; ``end`` closes each text with the
    model's end id.
    """
    last = processor(path).eos_id() if end else None
    given = docs.select(F.struct(*carry).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path)
        for batch in batches:
            rows = batch.column("row")
            for part in units.slices(marked_texts(batch.column("text"))):
                found = table.encode(part, last)
                yield pa.RecordBatch.from_arrays([rows.slice(part.first, part.rows), *found], ["row", "ids", "decoded"])

    schema = T.StructType(
        [
            T.StructField("row", given.schema["row"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return given.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of any ids, by the library's decoding; null ids give an empty text.

    A column named ``into`` is replaced.
    """
    kept = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in kept]).add(into, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        for batch in batches:
            texts = model.decode([i or [] for i in batch.column(ids).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, into]
            )

    return df.select(*kept).mapInArrow(run, schema)
