"""Hash chains over recorded segments and frames.

A chain is sequential by definition, so it is walked per segment.  Segments are bounded by
the recorder's rotation (64 MiB or an hour); the walk streams rows and keeps one digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

from paritymill.functions.folds import sorted_fold


def genesis(segment_id: str, version: str) -> bytes:
    return hashlib.sha256(f"{version}:{segment_id}".encode()).digest()


def _flaw(text: str, expected: int) -> str | None:
    """Why a serialized record is not the canonical record with the expected index."""
    try:
        record = json.loads(text)
    except ValueError:
        return "not_json"
    if not isinstance(record, dict):
        return "not_an_object"
    index = record.get("local_row_index")
    if isinstance(index, bool) or not isinstance(index, int) or index != expected:
        return "row_index_not_contiguous"
    if json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")) != text:
        return "not_canonical"
    return None


def segment_chain_audit(lines: DataFrame, version: str) -> DataFrame:
    """Chain hash, record count, bytes and first flaw of every segment.

    ``lines``: segment_id, ord, record (the line without its newline).  Each link is
    SHA-256 over previous digest, 8-byte big-endian length and record bytes.
    """

    def start(key):
        return {"id": key[0], "hash": genesis(key[0], version), "n": 0, "bytes": 0, "bad": None, "why": None}

    def step(state, row):
        raw = (row.record + "\n").encode()
        state["n"] += 1
        if state["bad"] is None:
            why = _flaw(row.record, state["n"])
            if why:
                state["bad"], state["why"] = state["n"], why
        state["hash"] = hashlib.sha256(state["hash"] + len(raw).to_bytes(8, "big") + raw).digest()
        state["bytes"] += len(raw)

    def finish(state):
        return (state["id"], state["n"], state["bytes"], state["hash"].hex(), str(state["bad"] or ""), state["why"])

    return sorted_fold(
        lines.select("segment_id", "ord", "record"), ["segment_id"], ["ord"], start, step,
        "segment_id string, record_count bigint, byte_count bigint, chain_hash string, "
        "first_flaw_index string, first_flaw string",
        finish,
    )


def frame_hash_chain(frames: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """SHA-256 chain over ``frame_hash`` per book: the first link has no predecessor."""
    names = list(keys)

    def start(key):
        return {"key": key, "hash": b"", "n": 0, "last": None}

    def step(state, row):
        state["hash"] = hashlib.sha256(state["hash"] + bytes.fromhex(row.frame_hash)).digest()
        state["n"] += 1
        state["last"] = row.frame_hash

    def finish(state):
        return (*state["key"], state["n"], state["hash"].hex(), state["last"])

    fields = ", ".join(f"{k} string" for k in names)
    return sorted_fold(
        frames.select(*names, order, "frame_hash"), names, [order], start, step,
        f"{fields}, frame_count bigint, frame_hash_chain string, latest_frame_hash string",
        finish,
    )
