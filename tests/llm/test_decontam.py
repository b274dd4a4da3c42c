import random

import numpy as np
import pytest

from paritymill.llm import decontam
from paritymill.llm.queries import op3_benchmark_leaks


def plain_alignment(a, b):
    """Best local score by the full table."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 6, rng.integers(1, 20), dtype=np.uint64) for _ in range(200)]
    passages = [rng.integers(0, 6, rng.integers(1, 40), dtype=np.uint64) for _ in range(200)]
    score, start, end = decontam.smith_waterman(items, passages)
    for i in range(200):
        want = plain_alignment(items[i].tolist(), passages[i].tolist())
        assert score[i] == want
        if want:
            assert plain_alignment(items[i].tolist(), passages[i][start[i] : end[i]].tolist()) == want


def make(rng):
    words = [f"w{k}" for k in range(3000)]
    common = ["the", "of", "and", "to"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [prose(rng.randrange(12, 60)) for _ in range(30)]
    docs, leaks = [], set()
    for d in range(400):
        text = prose(rng.randrange(50, 300))
        if d % 4 == 0:
            i = rng.randrange(30) if d % 8 else 0
            copy = [rng.choice(words) if rng.random() < 0.12 else w for w in items[i]]
            if rng.random() < 0.5:
                del copy[len(copy) // 2]
            at = rng.randrange(len(text))
            text[at:at] = copy
            leaks.add((d, i))
        docs.append((d, " ".join(text).replace("the", "The")))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], leaks


def test_edited_copies_are_found_and_clean_documents_left(spark):
    docs, items, leaks = make(random.Random(6))
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, b).collect()}
    assert got <= leaks and len(leaks - got) <= 2


def test_documents_that_hold_an_item(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
    squeeze = lambda t: " " + " ".join((t or "").lower().split()) + " "
    want = {(d.doc_id, i.item_id) for i in items if len(i.text.split()) >= 8 for d in docs if squeeze(i.text) in squeeze(d.text)}
    got = {(r.doc_id, r.item_id): r.score for r in op3_benchmark_leaks(spark, tiny).collect()}
    assert want and all(got[w] == 1.0 for w in want)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, item), (1, item), (None, item.upper()), (2, None), (3, ""), (4, item + " x" * 50_000)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item), (2, item), (3, "one two three"), (4, None), (None, "")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontam.find_leaks(d, b).collect()), key=str)
    assert got == [(d, i, 1.0) for d in (1, 4, None) for i in (1, 2)]
    assert decontam.find_leaks(d.limit(0), b).count() == decontam.find_leaks(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [300])
def test_an_item_in_most_documents_keeps_its_seeds(spark, copies):
    item = " ".join(f"q{k}" for k in range(25))
    rows = [(k, f"start {k} {item} end {k}") for k in range(copies)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert decontam.find_leaks(d, b).count() == copies


def test_repeated_edited_copies_and_excerpts_are_found(spark):
    item = {name: [f"{name}{k}" for k in range(40)] for name in "abcd"}
    rows = []

    def hold(times, words):
        for _ in range(times):
            rows.append((len(rows), f"start s{len(rows)} {' '.join(words)} end e{len(rows)}"))

    edited = [w if k not in (6, 14, 22, 30) else "changed" for k, w in enumerate(item["a"])]
    hold(100, edited)
    hold(100, item["b"][:24])  # an excerpt of 60%
    hold(3, item["c"])
    hold(1, item["c"][:20])  # its first half, and the whole in few documents
    hold(1, item["d"])
    hold(100, [w if k not in (6, 14, 22, 30) else "changed" for k, w in enumerate(item["d"])])
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item.values())], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(d, b).collect()}
    holders = [100, 100, 4, 101]
    assert [sum(i == n for _, i in got) for n in range(4)] == holders
    assert got[0, 0] == 0.85 and got[100, 1] == 0.6 and got[203, 2] == 0.5


def seed_meetings(spark, docs, items):
    """Rows at which seeds of items meet places of documents that share nothing but a phrase."""
    phrase = "as we have said before in this very place"
    rows = [(k, " ".join([f"d{k}x{j}" for j in range(20)]) + f" {phrase} " + f"e{k}") for k in range(docs)]
    tests = [(k, " ".join(f"i{k}x{j}" for j in range(40)) + f" {phrase}") for k in range(items)]
    source = spark.createDataFrame(rows, "doc bigint, text string")
    grams = spark.createDataFrame(tests, "item bigint, text string").mapInArrow(decontam._read_items, decontam._ITEM)
    grams = grams.mapInArrow(decontam._item_grams, decontam._GRAM_ROWS)
    every = spark.sparkContext.broadcast(decontam._bitmap(grams))
    counts = source.select("text").mapInArrow(decontam._count(every), decontam._COUNT_ROWS).groupBy("gram").sum("found").toDF("gram", "found")
    return decontam._seeds(grams, counts).where(f"found >= {docs}").count() * docs


def test_a_phrase_of_many_items_and_documents_is_no_seed(spark):
    # 7 grams of the phrase among 47: 47 - 10 + 2 seeds leave none of the phrase but the rarest ties
    assert seed_meetings(spark, 60, 10) == 0
    assert seed_meetings(spark, 120, 20) == 0


def test_recall_by_edit_rate(spark):
    rng = random.Random(12)
    items = [[f"t{rng.randrange(4000)}" for _ in range(40)] for _ in range(40)]
    found = {}
    for every in (10, 6, 4):
        rows = []
        for i, words in enumerate(items):
            copy = [f"z{rng.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(words)]
            rows.append((i, " ".join([f"p{rng.randrange(4000)}" for _ in range(80)] + copy)))
        d = spark.createDataFrame(rows, "doc_id bigint, text string")
        b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
        got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, b).collect()}
        assert all(x == y for x, y in got)
        found[every] = len(got)
    assert found == {10: 40, 6: 40, 4: 40}
