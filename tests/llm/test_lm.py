import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from paritymill.llm import lm
from paritymill.llm.queries import op1_bloom_lm


def tokens_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def test_base_equals_a_plain_count_and_model_is_better(spark, tiny):
    docs = {r.doc_id: tokens_of(r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = collections.Counter(w for i, t in docs.items() if not held[i] for w in t)
    total, known = sum(count.values()), len(count)
    got = {r.doc_id: r for r in op1_bloom_lm(spark, tiny).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (known + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), total)
        assert abs(r.base_score - base) < 1e-9 * abs(base) + 1e-9
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_equal_exact_bigrams_where_counts_fit(spark):
    rows = [(1, "a b a b c"), (2, "a b"), (3, None), (4, "x " * 30_000), (5, "A  b\nq"), (None, "c"), (5, "c")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    got = lm.score_documents(df, F.col("doc_id") != 5).collect()
    assert len(got) == len(rows)
    train = [tokens_of(t) for i, t in rows if i != 5]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip([None, *t], t))
    total, known = sum(one.values()), len(one)

    def plain(t):
        s = 0.0
        for v, w in zip([None, *t], t):
            share = lm.SHARE * one[v] / (one[v] + lm.STRENGTH)
            q = lm.level_count(lm.levels(np.array([two[v, w]]), 1.0), 1.0)[0] if two[v, w] else 0.0
            s += math.log10(share * min(q, one[v]) / max(one[v], 1) + (1 - share) * (one[w] + 0.1) / (total + 0.1 * (known + 1)))
        return s

    want = sorted((len(tokens_of(t)), round(plain(tokens_of(t)), 6)) for _, t in rows)
    assert sorted((r.n_tokens, round(r.score, 6)) for r in got) == want


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id bigint, text string")
    got = lm.score_documents(df, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 for r in got) and len(got) == 2
    assert lm.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_levels_are_monotone_and_near_their_counts():
    counts = np.arange(1, 5000)
    for least in (1.0, 2.0, 7.0):
        level = lm.levels(counts, least)
        assert (np.diff(level) >= 0).all() and (level[counts < least] == 0).all()
        back = lm.level_count(level, least)[counts >= least]
        assert (np.abs(np.log(back / counts[counts >= least])) <= np.log(lm.BASE) + 1e-9).all()


def test_filter_holds_its_entries_and_few_others():
    rng = np.random.default_rng(0)
    bits, hashes = 6, np.sort(rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 300, len(hashes)).astype(float)
    import pyarrow as pa

    blocks, at = {}, lm._cuts(hashes, bits)
    for g in range(1 << bits):
        part = slice(at[g], at[g + 1])
        table = pa.table({"grp": [g], "keys": pa.array([lm._pack(hashes[part], bits).tobytes()], pa.binary()),
                          "counts": pa.array([counts[part].astype("<f8").tobytes()], pa.binary())})
        out = lm._fill(bits, 1.0)((pa.scalar(g),), table)
        blocks[g] = out.column("bits")[0].as_py()
    bloom = lm.LogFrequencyFilter(blocks, bits, 1.0)
    assert (bloom.counts(hashes) >= lm.level_count(lm.levels(counts, 1.0), 1.0)).all()
    assert (bloom.counts(rng.integers(0, 2**63, 40_000, dtype=np.uint64)) > 0).mean() < 0.002


def test_a_filter_in_more_blocks_keeps_every_bigram(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(d, " ".join(f"w{k}" for k in rng.integers(0, 300, 400))) for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r.score for r in lm.score_documents(df, F.lit(True)).collect()}
    monkeypatch.setattr(lm, "BROADCAST_BITS", 0)
    got = {r.doc_id: r.score for r in lm.score_documents(df, F.lit(True)).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 * abs(want[d]) for d in want)
    for entries in (0, 11_000_000, 50_000_000, 3_000_000_000):
        assert entries * lm.PROBES / np.log(2) <= 1.001 * 2.0 ** (lm._block_bits(entries) + lm.BLOCK_BITS)
    import pyarrow as pa

    hashes = np.sort(rng.integers(0, 2**40, 400_000, dtype=np.uint64))
    keys = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    table = pa.table({"keys": pa.array([keys], pa.binary()), "counts": pa.array([np.ones(400_000, "<u4").tobytes()], pa.binary())})
    assert lm._sum_pairs((pa.scalar(0),), table).column("entries")[0].as_py() == len(np.unique(hashes))


def test_bigrams_travel_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(d, " ".join(f"w{k}" for k in rng.integers(0, 3000, 2000))) for d in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(lm, "BROADCAST_BITS", 0)
    sent = []
    for name in ("_send_pairs", "_ask"):
        made = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda bits, name=name, made=made: sent.append(name) or made(bits))
    assert lm.score_documents(df, F.col("doc_id") % 10 != 0).count() == 100
    assert sent == ["_ask"]
    place, uses = rng.integers(0, 70_000, 5000), rng.integers(0, 9, 70_000).astype("<u4")
    words, sizes = np.arange(70_000, dtype=np.uint64), [2000, 3000]
    row = {"tokens": lm._pack_tokens(place, uses), "words": words.tobytes(), "uses": uses.tobytes(), "sizes": sizes}
    import pyarrow as pa

    back = lm._tokens({k: pa.scalar(v) for k, v in row.items()})
    assert (back[0] == place).all() and (back[1] == words).all() and back[2].tolist() == sizes
