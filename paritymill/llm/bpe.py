"""Token ids of whole texts by a tokenizer file, each distinct unit encoded once per worker.

A text is cut into units at places where the tokenizer's own pre-splitting always cuts:
before ASCII white space that follows something else, and between an ASCII letter or digit
and ASCII punctuation.  The ids of a text are the ids of its units in order, so a worker
encodes a unit once and finds it by hash from then on.  A text with white space outside
ASCII, whose runs these cuts could split, is one unit when white space is part of the ids.
Special tokens of the file that stand in a text are units of their own, as the tokenizer finds them
before anything else: leftmost, the longest of those that start together.

Tests hold the result against encoding whole texts at once.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from paritymill.llm import units

CACHE_UNITS = 1 << 20
_LONGEST_CACHED = 64
_AT_ONCE = 4096
_WORD = np.zeros(256, dtype=bool)
for _low, _high in ("09", "AZ", "az"):
    _WORD[ord(_low) : ord(_high) + 1] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[0x21:0x7F] = ~_WORD[0x21:0x7F]
# fixed values: white space outside ASCII
_WIDE_SPACE = "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


class Encoder:
    """``keep_space``: white space reaches the ids (byte-level files); else it only separates words."""

    def __init__(self, path: str, keep_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens must be matched as they stand")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.keep_space = keep_space
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = self.filled = 0

    def _store(self, encoded: list[list[int]]) -> np.ndarray:
        """Slots of newly encoded units."""
        count, size = len(encoded), sum(map(len, encoded))
        while self.used + count > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.filled + size > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        length = np.fromiter(map(len, encoded), np.int64, count)
        made = np.arange(self.used, self.used + count)
        self.lengths[made] = length
        self.starts[made] = self.filled + np.cumsum(length) - length
        self.flat[self.filled : self.filled + size] = np.fromiter((i for e in encoded for i in e), np.uint32, size)
        self.used, self.filled = self.used + count, self.filled + size
        return made

    def _specials(self, part: units.Slice) -> list[tuple[int, int]]:
        """Places of special tokens, each inside one text."""
        found: list[tuple[int, int]] = []
        blob, at = part.data.tobytes(), 0
        while self.special and (hit := self.special.search(blob, at)):
            stop = int(part.bounds[np.searchsorted(part.bounds, hit.start(), side="right")])
            if hit.end() > stop:  # the bytes of two texts
                hit = self.special.search(blob[:stop], at)
            if hit is None:
                at = stop
                continue
            found.append(hit.span())
            at = hit.end()
        return found

    def _units(self, part: units.Slice, special: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = part.data, part.bounds
        space = units.IS_SPACE[data]
        for a, b in special:
            space[a:b] = False
        filled = bounds[:-1][bounds[:-1] < bounds[1:]]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = _WORD[data[:-1]] & _PUNCTUATION[data[1:]]
        if self.keep_space:
            cut[1:] |= space[1:] & ~space[:-1]
            cut[filled] = True
            for row in self._wide_rows(part):
                cut[bounds[row] + 1 : bounds[row + 1]] = False
            self._cut_out(cut, special)
            starts = np.flatnonzero(cut)
            return starts, np.append(starts[1:], len(data))
        cut[1:] |= space[:-1]
        cut[filled] = True
        self._cut_out(cut, special)
        starts = np.flatnonzero(cut & ~space)
        stop = np.flatnonzero(cut | space)
        ends = np.append(stop, len(data))[np.searchsorted(stop, starts, side="right")]
        return starts, ends

    @staticmethod
    def _cut_out(cut: np.ndarray, special: list[tuple[int, int]]) -> None:
        for a, b in special:
            cut[a + 1 : b] = False
            cut[a : b + 1 : b - a] = True

    @staticmethod
    def _wide_rows(part: units.Slice) -> list[int]:
        maybe = np.flatnonzero(np.isin(part.data, [0xC2, 0xE1, 0xE2, 0xE3]))
        nearby = maybe[maybe + 1 < len(part.data)]
        pair = part.data[nearby].astype(np.int64) << 8 | part.data[nearby + 1]
        pairs = {int.from_bytes(c.encode()[:2], "big") for c in _WIDE_SPACE}
        rows = np.unique(np.searchsorted(part.bounds, nearby[np.isin(pair, list(pairs))], side="right") - 1)
        texts = [(r, part.data[part.bounds[r] : part.bounds[r + 1]].tobytes().decode("utf-8", "replace")) for r in rows.tolist()]
        return [r for r, t in texts if any(c in t for c in _WIDE_SPACE)]

    def encode(self, part: units.Slice, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of the texts); ``end`` closes each text."""
        special = self._specials(part) if len(part.data) else []
        if len(part.data):
            starts, ends = self._units(part, special)
        else:
            starts = ends = np.zeros(0, dtype=np.int64)
        if len(starts):
            ids, bounds = self._gather(part, starts, ends, special)
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(part.rows + 1, np.int64)
        if end is None:
            return ids, bounds
        each = np.arange(part.rows + 1)
        out = np.full(len(ids) + part.rows, end, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(each[:-1], np.diff(bounds))] = ids
        return out, bounds + each

    def _gather(
        self, part: units.Slice, starts: np.ndarray, ends: np.ndarray, special: list[tuple[int, int]]
    ) -> tuple[np.ndarray, np.ndarray]:
        data = part.data if self.keep_space else units.LOWER[part.data]
        hashes = units.span_hashes(units.byte_values(data), starts, ends)
        if special:  # told from equal letters in other cases
            at = np.searchsorted(starts, [a for a, _ in special])
            hashes[at] = units.span_hashes(units.byte_values(part.data), starts[at], ends[at]) ^ np.uint64(1)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        which = np.empty(len(ranked), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        keys = ranked[new].tolist()
        slots = np.fromiter((self.slots.get(k, -1) for k in keys), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            blob = part.data.tobytes()
            at = first[missing]
            texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            encoded = []
            for some in range(0, len(texts), _AT_ONCE):  # an encoding takes many times the memory of its ids
                found = self.tokenizer.encode_batch_fast(texts[some : some + _AT_ONCE], add_special_tokens=False)
                encoded += [e.ids for e in found]
            made = self._store(encoded)
            slots[missing] = made
            short = np.flatnonzero(ends[at] - starts[at] <= _LONGEST_CACHED)
            self.slots.update(zip([keys[m] for m in missing[short].tolist()], made[short].tolist(), strict=True))
        length = self.lengths[slots][which]
        done = np.cumsum(length)
        ids = self.flat[np.repeat(self.starts[slots][which] - (done - length), length) + np.arange(done[-1])]
        bounds = np.concatenate([[0], done])[np.searchsorted(starts, part.bounds)]
        if self.used > CACHE_UNITS:
            self._clear()
        return ids, bounds


@functools.cache
def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, keep_space)
