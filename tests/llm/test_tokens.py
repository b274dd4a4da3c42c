import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paritymill.llm import bpe, packing, tokenfile, units
from paritymill.llm.queries import op5_mixture_packing, op8_token_files

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = ["don't", "'s", "\xa0", " ", "\n", "\t", "a", "é", "é,", "…", ".", ",", "  ", "x　 y", "​", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end", "oftext|>", "12",
       "3.5", "ΑΣ'", "́", "\r\n", "_", "😀", "!!", "\x1c", "\x85", "İ", "ß", "ﬁ", " 're", " "]


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name,keep_space", FILES)
def test_units_give_the_ids_of_whole_texts(name, keep_space):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", None, "a" * 5000, "é\xa0 " * 900]
    plain, encoder, row = tokenizer(name), bpe.Encoder(public_tokenizers.path(name), keep_space), 0
    for part in units.slices(pa.array(texts), 10_000):
        ids, bounds = encoder.encode(part, end=2)
        for i in range(part.rows):
            want = plain.encode(texts[row] or "", add_special_tokens=False).ids + [2]
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want
            row += 1
    assert row == len(texts)


@pytest.mark.parametrize("name,keep_space", FILES)
def test_special_tokens_are_found_as_the_library_finds_them(name, keep_space):
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "<|endof", "text|>", "<|end\u2003oftext|>",
             "\u2003<|endoftext|>\u2003 z", "<|startoftext|>'s", "<|EndOfText|>", "<|endoftext|>", ""]
    plain, encoder = tokenizer(name), bpe.Encoder(public_tokenizers.path(name), keep_space)
    for part in units.slices(pa.array(texts), 10_000):
        ids, bounds = encoder.encode(part)
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_query_holds_every_id_once(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op5_mixture_packing(spark, tiny).collect()
    plain, by_doc, by_window = tokenizer("word_bpe_49k.json"), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc, pieces in by_doc.items():
        ids, at = plain.encode(docs[doc] or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    share = {s: sum(r.length for r in rows if r.source == s) / total for s in {r.source for r in rows}}
    for w, pieces in by_window.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (4096 if w < max(by_window) else total - 4096 * w)
        for s, part in share.items():
            taken = sum(p.length for p in pieces if p.source == s)
            assert abs(taken - at * part) < 12


def test_schedule_is_gapless_for_any_targets():
    rng = random.Random(4)
    for case in range(60):
        names = [f"s{i}" for i in range(rng.randrange(1, 12))]
        totals = {s: rng.choice([1, 3, 50, 1000, 40_000]) for s in names}
        weights = {} if case % 2 else {s: rng.choice([0.01, 1, 2, 30]) for s in names}
        plan = packing.Schedule(totals, weights, window=64)
        last = dict.fromkeys(names, 0)
        for w in range(plan.windows + 1):
            now = {s: plan.position(s, w)[0] for s in names}
            assert sum(now.values()) == min(64 * w, plan.total)
            assert all(now[s] >= last[s] for s in names)
            last = now
        assert last == totals
        for s in names:
            assert [(d, n) for d, n, _, _ in plan.pieces(s, 0, totals[s])][0][0] == 0
            assert sum(n for _, n, _, _ in plan.pieces(s, 0, totals[s])) == totals[s]


def test_targets_hold_while_queues_last():
    plan = packing.Schedule({"a": 100_000, "b": 100_000, "c": 100_000}, {"a": 0.7, "b": 0.2, "c": 0.1}, window=1000)
    for w in range(100):
        got = [plan.position(s, w + 1)[0] - plan.position(s, w)[0] for s in "abc"]
        assert max(abs(g - x) for g, x in zip(got, [700, 200, 100], strict=True)) <= 2


def test_packing_of_odd_rows(spark):
    rows = [(1, "a b", None, 1), (1, "a b", None, 1), (None, "c", "s", 1), (2, None, "s", 1), (3, "", "t", 1), (4, "w " * 9000, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, offset int")
    args = dict(tokenizer=public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end=2)
    out = packing.pack(df, **args).collect()
    assert sum(r.length for r in out) == 3 + 3 + 2 + 1 + 1 + 9001
    assert packing.pack(df.limit(0), **args).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, targets={"s": 1.0}, **args)
    even = packing.pack(df, targets={"s": 1, "t": 1, "": 1}, **args).collect()
    assert sum(len(r.ids) for r in even) == 4 * sum(r.length for r in out)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    cases = [[], [0], [5], [0, 0, 0], [2**62], list(range(1000)), [7] * 700, np.sort(rng.integers(0, 2**50, 2000)).tolist(),
             np.cumsum(rng.integers(0, 4000, 5000)).tolist()]
    for values in cases:
        code = tokenfile.encode_ascending(np.array(values, dtype=np.int64))
        back = tokenfile.Ascending(code)
        assert back.all().tolist() == values
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(values) + 1, 2).tolist())
            assert back.select_run(a, b).tolist() == values[a:b]
        for i in {0, 1, 255, 256, 257, len(values) - 1, len(values) // 2}:
            if 0 <= i < len(values):
                assert back.select(i) == values[i]
        if len(values) > 1000:
            assert len(code) * 8 < len(values) * (4 + max(0, np.log2(max(values) / len(values))))


def test_token_file_query_round_trip(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    got, plain, start = {r.doc_id: r for r in op8_token_files(spark, tiny).collect()}, tokenizer("byte_bpe_50k.json"), 0
    for d in docs:
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path):
    rows = [(5, "b", 1), (None, "x", 1), (-9, None, 1), (5, "c", 1), (2**62, "", 1), (-(2**62), "d e", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    args = dict(tokenizer=public_tokenizers.path("byte_bpe_50k.json"), keep_space=True, end=2)
    tokenfile.write_token_files(df, str(tmp_path / "a"), **args)
    out = sorted(tokenfile.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, -(2**62), -9, 5, 5, 2**62]
    assert [r.n_tokens for r in out] == [2, 3, 1, 2, 2, 1]
    tokenfile.write_token_files(df.limit(0), str(tmp_path / "b"), **args)
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_block_random_access():
    ids = np.arange(3000, dtype=np.uint32)
    block = tokenfile.Block(tokenfile.pack_block(np.array([3, 3, 9]), 1, np.array([1000, 0, 500, 1500]), ids, 2))
    assert block.doc_ids() == [None, 3, 3, 9]
    with pytest.raises(ValueError):
        tokenfile.pack_block(np.array([1]), 0, np.array([1]), np.array([70_000], np.uint32), 2)
    assert block.document(2).tolist() == ids[1000:1500].tolist() and len(block.document(1)) == 0


def test_pieces_are_cut_in_bounded_runs():
    """A batch of documents is several times the ids that go out at once; a slice of a batch is cut like a batch."""
    sizes = [70_000, 1, 300_000, 4096, 500_000, 90_000]
    names = ["a", "b", "a", "", "b", "a"]
    ids = [np.random.default_rng(n).integers(0, 49_000, n).astype("<u4").tobytes() for n in sizes]
    base = [0, 0, 70_000, 0, 1, 370_000]
    columns = [pa.array(range(6)), pa.array(names), pa.array(base), pa.array(sizes), pa.array(ids, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "source", "base", "n_tokens", "ids"])
    cut = packing._cut(packing.Schedule({"a": 460_000, "b": 500_001, "": 4096}, {}))
    for first in (0, 2):
        out = list(cut(iter([batch.slice(first)])))
        assert len(out) > 3 and max(r.column("ids").nbytes for r in out) <= 2 * units.SLICE_BYTES
        rows = [r for part in out for r in part.to_pylist()]
        for doc in range(first, 6):
            own = [r for r in rows if r["doc_id"] == doc]
            assert b"".join(r["ids"] for r in own) == ids[doc]
            assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            assert all(r["doc_tokens"] == sizes[doc] and len(r["ids"]) == 4 * r["length"] and r["source"] == names[doc] for r in own)
