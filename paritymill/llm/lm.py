"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

1. Chunks.  Texts become chunks of about two million tokens: the chunk's distinct words by hash, and
   its tokens as places in that list.  One staged table; everything below reads it.
2. Exact word counts.  Each chunk sends its words and training counts to groups cut along the hash, and
   each group sends the corpus counts back to the chunks that asked, so no table of all words is
   ever in one place.
3. The filter.  Training bigrams are counted in groups in the same way.  A bigram of count c is quantised
   to level 1 + floor(log_B c) and entered once for each level up to its own, K bits each;
   a look-up probes level after level until one is missing.  The filter has as many blocks of fixed
   size as hold all entries at half filling, so no bigram is dropped at any corpus size.  Up to 2^28 bits it is
   broadcast; a larger one is never in one place: it has a block for each group, and chunks send all
   their bigrams there once, which are counted, entered, probed and answered in the same task.
4. Scores.  With c(v) exact, C(v, w) from the filter and P(w) the smoothed word probability,
   P(w | v) = L(v) C(v, w) / c(v) + (1 - L(v)) P(w),  L(v) = L c(v) / (c(v) + M).
   A text starts after, and closes with, the end token.

Words are hashed to 64 bits, bigrams to at least 50.  A hot word has one entry per chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.llm import units
from paritymill.llm.shared import stage

CHUNK_TOKENS = 1 << 21
GROUP_TOKENS = 1 << 18  # fewer entries than a block holds
FILTER_BITS, BLOCK_BITS, PROBES = 28, 22, 8
BROADCAST_BITS = 28
BASE = 1.5
SHARE, STRENGTH = 0.5, 20.0
ALPHA = 0.1
_KEY_BYTES = 5
_END = np.uint64(0x5EED0E4D5EED0E4D)

_CHUNKS = (
    "chunk bigint, docs array<bigint>, train array<boolean>, sizes array<bigint>, train_tokens bigint, "
    "tokens binary, words binary, uses binary"
)
_WORDS = "grp int, chunk bigint, words binary, uses binary"
_WORD_COUNTS = "chunk bigint, grp int, counts binary, known bigint"
_PAIRS = "grp int, keys binary, counts binary"
_ENTRIES = "grp int, entries bigint, keys binary, counts binary"
_ASKED = "grp int, chunk bigint, keys binary, counts binary"
_FOUND = "chunk bigint, grp int, levels binary"
_BITS = "block int, bits binary"
SCORES = "doc bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _by_use(uses: np.ndarray) -> np.ndarray:
    """Places of a chunk's words, the most used first."""
    return np.argsort(-uses.astype(np.int64), kind="stable")


def _pack_tokens(place: np.ndarray, uses: np.ndarray) -> bytes:
    """Ranks of the tokens by use, whose high bytes are mostly zero, byte by byte."""
    rank = np.empty(len(uses), dtype="<u4")
    rank[_by_use(uses)] = np.arange(len(uses), dtype="<u4")
    return pa.compress(rank[place].view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict[str, pa.Scalar]]:
    """Chunks of a batch."""
    for values in zip(*batch.columns, strict=True):
        yield dict(zip(batch.schema.names, values, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, seq = TaskContext.get().partitionId() << 32, 0
    docs: list = []
    train: list = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def chunk() -> pa.RecordBatch:
        size = np.concatenate([s for _, s in held])
        learn = np.repeat(np.array(train, dtype=bool), size)
        words, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        uses = np.bincount(place[learn], minlength=len(words)).astype("<u4")
        values = [
            first + seq, docs, train, size.tolist(), int(learn.sum()),
            _pack_tokens(place, uses), words.tobytes(), uses.tobytes(),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
        names = [c.split(" ")[0] for c in _CHUNKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    total = 0
    for batch in batches:
        for part in units.slices(batch.column("text")):
            w = units.words(part)
            flat = np.full(len(w.hashes) + part.rows, _END, dtype=np.uint64)
            flat[np.arange(len(w.hashes)) + np.repeat(np.arange(part.rows), w.counts)] = w.hashes
            held.append((flat, w.counts + 1))
            docs += batch.column("doc").slice(part.first, part.rows).to_pylist()
            train += batch.column("train").slice(part.first, part.rows).to_pylist()
            total += len(flat)
            if total >= CHUNK_TOKENS:
                yield chunk()
                docs, train, held, total, seq = [], [], [], 0, seq + 1
    if held:
        yield chunk()


def _cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2^bits groups in ascending hashes."""
    groups = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(hashes, groups), [len(hashes)]])


def _send_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, w, u in zip(*[batch.column(c) for c in ("chunk", "words", "uses")], strict=True):
                words, uses = w.as_buffer().to_pybytes(), u.as_buffer().to_pybytes()
                at = _cuts(np.frombuffer(words, np.uint64), bits)
                full = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([number.as_py()] * len(full), pa.int64()),
                        pa.array([words[8 * at[g] : 8 * at[g + 1]] for g in full], pa.binary()),
                        pa.array([uses[4 * at[g] : 4 * at[g + 1]] for g in full], pa.binary()),
                    ],
                    names=["grp", "chunk", "words", "uses"],
                )

    return run


def _blobs(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _sum_words(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts of the words of one group, for every chunk in its own order, and a row of their number."""
    words, uses = _blobs(table.column("words"), "<u8"), _blobs(table.column("uses"), "<u4")
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate(uses), len(distinct)).astype("<u8")
    back, at = total[place], np.cumsum([0, *map(len, words)])
    counts = [back[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    chunks = [*table.column("chunk").to_pylist(), -1]
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "grp": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
            "counts": pa.array([*counts, b""], pa.binary()),
            "known": pa.array([0] * len(counts) + [int((total > 0).sum())], pa.int64()),
        }
    )


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return units.mix(units.mix(before, 11) + word, 12)


def _tokens(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens as places in the words, words, tokens of each text) of a chunk."""
    words, uses = (np.frombuffer(row[c].as_buffer(), kind) for c, kind in (("words", np.uint64), ("uses", "<u4")))
    sizes = np.array(row["sizes"].as_py())
    number = int(sizes.sum())
    planes = np.frombuffer(pa.decompress(row["tokens"].as_buffer(), 4 * number, "zstd"), np.uint8).reshape(4, number)
    return _by_use(uses)[planes.T.copy().view("<u4").reshape(-1)], words, sizes


def _before(place: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; a text starts after the end token."""
    out = np.empty_like(place)
    out[1:] = place[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = end
    return out


def _distinct_pairs(before: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as before << 32 | place, place of each in them, counts)."""
    return np.unique(before.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64), return_inverse=True, return_counts=True)


def _send_pairs(bits: int) -> Callable:
    """Training bigrams of each chunk by group: the hash below the group's bits, cut to five bytes, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                place, words, sizes = _tokens(row)
                before = _before(place, sizes, int(np.searchsorted(words, _END)))
                mask = np.repeat(np.array(row["train"].as_py(), dtype=bool), sizes)
                pairs, _, counts = _distinct_pairs(before[mask], place[mask])
                hashes = pair_hash(words[(pairs >> np.uint64(32)).astype(np.int64)], words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order].astype("<u4")
                at = _cuts(hashes, bits)
                keys = _pack(hashes, bits)
                full = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([keys[at[g] : at[g + 1]].tobytes() for g in full], pa.binary()),
                        pa.array([counts[at[g] : at[g + 1]].tobytes() for g in full], pa.binary()),
                    ],
                    names=["grp", "keys", "counts"],
                )

    return run


def _pack(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the first ``bits``, as rows of five bytes."""
    low = (hashes << np.uint64(bits)) >> np.uint64(24)
    return low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].copy()


def _unpack(blob: bytes | pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, _KEY_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, 3:] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64)


def levels(counts: np.ndarray, least: float) -> np.ndarray:
    """Quantised log counts from 1; counts below ``least`` have level 0."""
    with np.errstate(divide="ignore"):
        return np.maximum(0, 1 + np.floor(np.log(counts / least) / np.log(BASE) + 1e-9)).astype(np.int64)


def level_count(level: np.ndarray, least: float) -> np.ndarray:
    """The count that a level stands for: the middle of its range, never below the range's least whole count."""
    low = np.ceil(least * BASE ** (level - 1.0))
    high = np.maximum(low, np.ceil(least * BASE ** (level * 1.0)) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _sum_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of one group's bigrams, and the number of entries they make."""
    keys = np.concatenate([_unpack(x.as_buffer()) for x in table.column("keys")])
    distinct, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, np.concatenate(_blobs(table.column("counts"), "<u4")), len(distinct))
    head = distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return pa.table(
        {
            "grp": pa.array([key[0].as_py()], pa.int32()),
            "entries": pa.array([int(levels(counts, 1.0).sum())], pa.int64()),
            "keys": pa.array([head.tobytes()], pa.binary()),
            "counts": pa.array([counts.astype("<f8").tobytes()], pa.binary()),
        }
    )


def _block_bits(entries: int) -> int:
    """Leading hash bits that number the filter's blocks: the fewest that hold the entries at half filling."""
    capacity = int((1 << BLOCK_BITS) * np.log(2) / PROBES)
    return max(FILTER_BITS - BLOCK_BITS, (max(0, entries - 1) // capacity).bit_length())


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hash as the filter knows it: group bits and 40 more."""
    cut = max(0, 64 - bits - 8 * _KEY_BYTES)
    return hashes >> np.uint64(cut) << np.uint64(cut)


def _whole(group: int, low: np.ndarray, bits: int) -> np.ndarray:
    """Hash as the filter knows it, from its group and the 40 bits after the group's."""
    return _short(np.uint64(group << (64 - bits)) | (low << np.uint64(24) >> np.uint64(bits)), bits)


def _places(hashes: np.ndarray, level: int, probe: int) -> np.ndarray:
    return (units.mix(hashes, 100 + level * PROBES + probe) >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


def _fill(bits: int, least: float) -> Callable:
    """Bits of one block of the filter."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        for group, k, c in zip(table.column("grp").to_pylist(), table.column("keys"), table.column("counts"), strict=True):
            hashes = _whole(group, _unpack(k.as_buffer()), bits)
            level = levels(np.frombuffer(c.as_buffer(), "<f8"), least)
            for j in range(1, int(level.max(initial=0)) + 1):
                at = hashes[level >= j]
                for probe in range(PROBES):
                    block[_places(at, j, probe)] = 1
        packed = np.packbits(block, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    return run


def _probe(data: np.ndarray, start: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Levels of bigrams in the bits ``data``, each in the block that begins at bit ``start``."""
    level = np.zeros(len(known), dtype=np.int64)
    left, step = np.arange(len(known)), 1
    while len(left):
        for probe in range(PROBES):
            at = start[left] + _places(known[left], step, probe)
            left = left[(data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        level[left] = step
        step += 1
    return level


class LogFrequencyFilter:
    """Broadcast side: probes for the count of bigram hashes."""

    def __init__(self, blocks: dict[int, bytes], bits: int, least: float) -> None:
        self.bits, self.least = bits, least
        self.data = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        width = 1 << (BLOCK_BITS - 3)
        for number, blob in blocks.items():
            self.data[number * width : (number + 1) * width] = np.frombuffer(blob, np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        block = (hashes >> np.uint64(64 - (FILTER_BITS - BLOCK_BITS))).astype(np.int64)
        return level_count(_probe(self.data, block << BLOCK_BITS, _short(hashes, self.bits)), self.least)


def _chunk_pairs(place: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, place of each token's pair in them, their hashes, ascending order of the hashes) of one chunk."""
    pairs, which, _ = _distinct_pairs(_before(place, sizes, int(np.searchsorted(words, _END))), place)
    hashes = pair_hash(words[(pairs >> np.uint64(32)).astype(np.int64)], words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    return pairs, which, hashes, np.argsort(hashes, kind="stable")


def _ask(bits: int) -> Callable:
    """Bigrams of each chunk by group, in ascending hashes, with their uses in training texts, maybe none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                place, words, sizes = _tokens(row)
                pairs, which, hashes, order = _chunk_pairs(place, words, sizes)
                mask = np.repeat(np.array(row["train"].as_py(), dtype=bool), sizes)
                counts = np.bincount(which[mask], minlength=len(pairs))[order].astype("<u4")
                hashes = hashes[order]
                at, keys = _cuts(hashes, bits), _pack(hashes, bits)
                full = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([row["chunk"].as_py()] * len(full), pa.int64()),
                        pa.array([keys[at[g] : at[g + 1]].tobytes() for g in full], pa.binary()),
                        pa.array([counts[at[g] : at[g + 1]].tobytes() for g in full], pa.binary()),
                    ],
                    names=["grp", "chunk", "keys", "counts"],
                )

    return run


def _answer(bits: int) -> Callable:
    """Levels of the bigrams that chunks ask of one group, in the order asked, by the group's block of the filter."""
    fill = _fill(bits, 1.0)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        learnt = _sum_pairs(key, table)
        data = np.frombuffer(fill(key, learnt).column("bits")[0].as_buffer(), np.uint8)
        distinct = _unpack(learnt.column("keys")[0].as_buffer())
        level = _probe(data, np.zeros(len(distinct), dtype=np.int64), _whole(key[0].as_py(), distinct, bits)).astype(np.uint8)
        out = [level[np.searchsorted(distinct, _unpack(x.as_buffer()))].tobytes() for x in table.column("keys")]
        return pa.table({"chunk": table.column("chunk"), "grp": table.column("grp"), "levels": pa.array(out, pa.binary())})

    return run


def _score(model, total: int, known: int) -> Callable:
    norm = total + ALPHA * (known + 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("grp")
        level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in right.column("levels") if x.is_valid)])
        counts = np.concatenate([np.zeros(0), *(np.frombuffer(x.as_buffer(), "<u8") for x in right.column("counts") if x.is_valid)])
        for row in _rows(left):
            place, words, sizes = _tokens(row)
            plain = (counts + ALPHA) / norm
            pairs, which, hashes, order = _chunk_pairs(place, words, sizes)
            first, second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            seen = counts[first]
            if model is None:
                found = np.zeros(len(pairs))
                found[order] = level_count(level.astype(np.int64), 1.0)
            else:
                found = model.value.counts(hashes)
            found = np.minimum(found, seen)
            share = SHARE * seen / (seen + STRENGTH)
            chance = share * found / np.maximum(seen, 1) + (1 - share) * plain[second]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            out.append(
                (
                    sizes,
                    np.add.reduceat((counts > 0)[place].astype(np.int64), at),
                    np.add.reduceat(np.log10(plain)[place], at),
                    np.add.reduceat(np.log10(chance)[which], at),
                )
            )
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        docs = [d for row in left.column("docs").to_pylist() for d in row]
        return pa.table([pa.array(docs, pa.int64()), *map(pa.array, columns)], names=["doc", "n_tokens", "n_known", "base_score", "score"])

    return run


def _bits_for(tokens: int) -> int:
    """Leading hash bits that number the groups."""
    return max(FILTER_BITS - BLOCK_BITS, (tokens // GROUP_TOKENS).bit_length())


def score_documents(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id``, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows for which ``learns`` holds are the training texts; null counts as true.  A null or empty text is
    its end token.  Null and repeated ids are scored row by row.  Without training texts every word has the
    same probability.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"), F.coalesce(learns, F.lit(True)).alias("train")
    )
    chunks = stage(source.mapInArrow(_chunks, _CHUNKS), "lm-chunks")
    total = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n")).head().n
    bits = _bits_for(total)
    sent = chunks.select("chunk", "words", "uses").mapInArrow(_send_words(bits), _WORDS)
    counted = stage(sent.groupBy("grp").applyInArrow(_sum_words, _WORD_COUNTS), "lm-words")
    known = counted.where("chunk = -1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n")).head().n

    left = chunks.select("chunk", "docs", "sizes", "tokens", "words", "uses").groupBy("chunk")
    right = counted.where("chunk >= 0").select("chunk", "grp", "counts", F.lit(None).cast("binary").alias("levels"))
    bigrams = chunks.select("chunk", "tokens", "words", "uses", "sizes", "train")
    # a count makes no more entries than it has tokens
    over = _block_bits(total)
    if over + BLOCK_BITS <= BROADCAST_BITS:
        pairs = bigrams.mapInArrow(_send_pairs(bits), _PAIRS)
        entries = pairs.groupBy("grp").applyInArrow(_sum_pairs, _ENTRIES)
        blocks = entries.select(F.shiftright("grp", bits - over).alias("block"), "grp", "keys", "counts").groupBy("block")
        held = blocks.applyInArrow(_fill(bits, 1.0), _BITS).toPandas()
        bloom = LogFrequencyFilter(dict(zip(held["block"], map(bytes, held["bits"]), strict=True)), bits, 1.0)
        model = spark.sparkContext.broadcast(bloom)
    else:
        asked = bigrams.mapInArrow(_ask(bits), _ASKED)
        answers = asked.groupBy("grp").applyInArrow(_answer(bits), _FOUND)
        right = right.union(answers.select("chunk", "grp", F.lit(None).cast("binary"), "levels"))
        model = None
    right, run = right.groupBy("chunk"), _score(model, total, known)
    scored = left.cogroup(right).applyInArrow(run, SCORES)
    return scored.select(
        F.col("doc").alias(doc_id), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
