import re

import pytest
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_groups
from test_quality import facts_of
from test_tokens import tokenizer

import corpus_pipeline
from paritymill.llm import linededup, quality


@pytest.fixture(scope="module")
def steps(spark, tiny, tmp_path_factory):
    """Rows of the input and of each stage, each written and read again."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        step(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(spark, tiny, steps):
    names = spark.read.parquet(f"{tiny}/documents.parquet").columns
    assert all(list(rows[0].asDict()) == names for rows in steps[:5])


def test_quality_drops_failures_only(steps):
    before, after = texts(steps[0]), texts(steps[1])
    for doc, text in before.items():
        words, chars, symbols, dup, repeat = facts_of(text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = words < quality.MIN_WORDS or 100 * repeat > 30 * words or 100 * symbols > 5 * chars
        failed = failed or 100 * text.count("!") > 5 * chars or 100 * dup > 40 * len(lines)
        assert failed == (doc not in after)


def test_lines_equal_all_pairs_but_for_few(steps):
    before, after = texts(steps[1]), texts(steps[2])
    want = brute_lines(list(before.items()))
    got = 0
    for doc, text in before.items():
        lines = text.split("\n")
        left = after.get(doc, "").split("\n") if doc in after else []
        got += len(lines) - len(left) if doc in after else sum(len(x.strip()) >= linededup.MIN_CHARS for x in lines)
        kept = [x for n, x in enumerate(lines) if (doc, n) not in want]
        assert set(kept) <= set(left) or doc not in after
    assert abs(got - len(want)) <= 0.02 * len(want) + 2
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_one_document_of_each_group_stays(steps):
    rows = list(texts(steps[2]).items())
    assert texts(steps[3]).keys() == {i for i, (_, group) in brute_groups(rows).items() if i == group}


def test_documents_with_items_go(spark, tiny, steps):
    squeeze = lambda t: " " + " ".join(t.lower().split()) + " "
    items = [squeeze(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect() if len(r.text.split()) >= 8]
    before, after = texts(steps[3]), texts(steps[4])
    held = {i for i, t in before.items() if any(x in squeeze(t) for x in items)}
    assert held.isdisjoint(after) and len(before) - len(after) <= 1.2 * len(held) + 2


def test_packing_holds_every_token(steps):
    plain, ids = tokenizer("word_bpe_49k.json"), {}
    for r in sorted(steps[5], key=lambda r: r.start):
        ids.setdefault(r.doc_id, b"")
        assert len(ids[r.doc_id]) == 4 * r.start
        ids[r.doc_id] += bytes(r.ids)
    import numpy as np

    for doc, text in texts(steps[4]).items():
        assert np.frombuffer(ids.pop(doc), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [2]
    assert not ids


def test_run_gives_the_same_documents(spark, tiny, steps):
    out = corpus_pipeline.run(spark, tiny)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in steps[5]}


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, tiny) if "start" not in docs.columns else docs
        assert docs.count() == 0
