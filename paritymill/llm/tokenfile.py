"""Token-id files: concatenated ids with Elias-Fano encoded document bounds.

A file is a table of blocks, in ascending order of document id.  A block holds whole
documents and stands on its own, little-endian:

    magic "TKB1" | ids width in bytes | documents | ids | rows with a null document id |
    least document id | length of each of the two codes   (all 64-bit, after the magic's 8 bytes)
    Elias-Fano code of the document ids above the least | Elias-Fano code of the ids' bounds | ids

An Elias-Fano code of n ascending values below u takes about n * (2 + log2(u / n)) bits: the low
bits packed side by side, the high bits in unary, and the position of every 256th one bit, by
which ``select`` finds a value without decoding the rest.  Ids take two bytes where the
vocabulary allows.  Blocks are rows of a Parquet table, so any store Spark reads can hold them,
and its commit makes a retried or lost task harmless.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritymill.llm import bpe, units
from paritymill.llm.shared import stage

BLOCK_IDS = 1 << 22
_SAMPLE = 256
_RUN = 1024
_MAGIC = b"TKB1\0\0\0\0"
_HEAD = struct.Struct("<8s7q")
_CODE = struct.Struct("<4q")
_BLOCKS = "part bigint, seq bigint, n_docs bigint, n_ids bigint, block binary"
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode_ascending(values: np.ndarray) -> bytes:
    """Elias-Fano code of ascending values from 0."""
    n = len(values)
    values = values.astype(np.uint64)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    ones = high + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[ones] = 1
    low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    low_blob = np.packbits(low.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
    high_blob = np.packbits(unary, bitorder="little").tobytes()
    samples = ones[::_SAMPLE].astype("<u4" if not n or ones[-1] < 1 << 32 else "<u8")
    return _CODE.pack(n, low_bits, len(high_blob), samples.itemsize) + low_blob + high_blob + samples.tobytes()


class Ascending:
    """Reader of an Elias-Fano code."""

    def __init__(self, blob: bytes) -> None:
        self.n, self.low_bits, high_size, width = _CODE.unpack_from(blob)
        low_size = (self.n * self.low_bits + 7) // 8
        at = _CODE.size
        self.low = np.frombuffer(blob, np.uint8, low_size, at)
        self.high = np.frombuffer(blob, np.uint8, high_size, at + low_size)
        self.samples = np.frombuffer(blob, f"<u{width}", -(-self.n // _SAMPLE), at + low_size + high_size)

    def select(self, i: int) -> int:
        """Value ``i``: the next sampled one bit before it, then whole bytes by popcount."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at // 8
        left += int(_POPCOUNT[self.high[byte] & ((1 << (at % 8)) - 1)])
        while left >= (ones := int(_POPCOUNT[self.high[byte]])):
            left -= ones
            byte += 1
        bits = [b for b in range(8) if self.high[byte] >> b & 1]
        value = 8 * byte + bits[left] - i
        for k in range(self.low_bits - 1, -1, -1):
            bit = i * self.low_bits + k
            value = value << 1 | int(self.low[bit // 8] >> (bit % 8) & 1)
        return value

    def select_run(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` to ``stop - 1``: only the bits between the sampled ones about them are read."""
        if first >= stop:
            return np.zeros(0, dtype=np.uint64)
        before, after = first // _SAMPLE, (stop - 1) // _SAMPLE + 1
        at = int(self.samples[before])
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at // 8 : end], bitorder="little")
        bits[: at % 8] = 0
        ones = np.flatnonzero(bits)[first - before * _SAMPLE : stop - before * _SAMPLE] + at // 8 * 8
        high = (ones - np.arange(first, stop)).astype(np.uint64)
        if not self.low_bits:
            return high
        low_at, low_end = first * self.low_bits, stop * self.low_bits
        packed = np.unpackbits(self.low[low_at // 8 : -(-low_end // 8)], bitorder="little")
        lows = packed[low_at % 8 :][: low_end - low_at].reshape(stop - first, self.low_bits)
        low = (lows.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high << np.uint64(self.low_bits) | low

    def all(self) -> np.ndarray:
        return self.select_run(0, self.n)


def pack_block(doc_ids: np.ndarray, nulls: int, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A block of ``nulls`` documents without an id and then those of ``doc_ids``, ascending."""
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
    least = int(doc_ids[0]) if len(doc_ids) else 0
    above = (doc_ids.view(np.uint64) - np.array(least, np.int64).view(np.uint64)) if len(doc_ids) else doc_ids
    index = encode_ascending(above)
    bounds = encode_ascending(np.concatenate([[0], np.cumsum(sizes)]))
    head = _HEAD.pack(_MAGIC, width, len(sizes), len(ids), nulls, least, len(index), len(bounds))
    return head + index + bounds + ids.astype(f"<u{width}").tobytes()


class Block:
    """Random access to a block."""

    def __init__(self, blob: bytes) -> None:
        magic, self.width, self.n_docs, self.n_ids, self.nulls, self.least, index, bounds = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = _HEAD.size
        self.index = Ascending(blob[at : at + index])
        self.bounds = Ascending(blob[at + index : at + index + bounds])
        self.ids = np.frombuffer(blob, f"<u{self.width}", self.n_ids, at + index + bounds)

    def doc_ids(self) -> list[int | None]:
        above = self.index.all() + np.array(self.least, np.int64).view(np.uint64)
        return [None] * self.nulls + above.view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the block."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _write(path: str, keep_space: bool, end: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_no, seq = bpe.encoder(path, keep_space), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            column = pa.concat_arrays(docs)
            known = column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            size, flat = np.concatenate(sizes), np.concatenate(ids)
            blob = pack_block(known, column.null_count, size, flat, width)
            values = [part_no, seq, len(size), len(flat), blob]
            names = ["part", "seq", "n_docs", "n_ids", "block"]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        held = 0
        for batch in batches:
            for part in units.slices(batch.column("text")):
                flat, bounds = encoder.encode(part, end)
                docs.append(batch.column("id").slice(part.first, part.rows))
                sizes.append(np.diff(bounds))
                ids.append(flat)
                held += len(flat)
                if held >= BLOCK_IDS:
                    yield block()
                    docs, sizes, ids, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield block()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    keep_space: bool,
    end: int,
    width: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all texts and write the blocks below ``path`` in ascending order of document id.

    ``width`` is 2 for vocabularies of at most 65,536 ids, else 4; an id that does not fit is refused.  Null texts are empty: just
    the end id.  Rows with a null id come first; rows that repeat an id keep a place each.
    One shuffle of the texts, by ranges of ids.
    """
    read = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    placed = read.repartitionByRange("id").sortWithinPartitions("id")
    blocks = placed.mapInArrow(_write(tokenizer, keep_space, end, width), _BLOCKS)
    blocks.write.option("compression", "zstd").parquet(path)


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, blob in zip(batch.column("base").to_pylist(), batch.column("block"), strict=True):
            b = Block(blob.as_buffer().to_pybytes())
            doc_ids = pa.array(b.doc_ids(), pa.int64())
            for first in range(0, b.n_docs, _RUN):
                stop = min(first + _RUN, b.n_docs)
                bounds = b.bounds.select_run(first, stop + 1).astype(np.int64)
                ids = b.ids[bounds[0] : bounds[-1]].astype("<u4").tobytes()
                at = ((bounds - bounds[0]) * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(first, stop - first),
                        pa.array(bounds[:-1] + base),
                        pa.array(np.diff(bounds)),
                        pa.array([ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian 32-bit) of every document of the files.

    Block positions are summed up over one row per block, parts first, then blocks of a part.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sizes = blocks.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    bases = stage(
        ranked.join(starts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("base")), "token-bases"
    )
    return blocks.join(bases, ["part", "seq"]).select("base", "block").mapInArrow(_read_docs, _DOCS)


