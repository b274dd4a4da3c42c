import random
import re

import numpy as np

from paritymill.llm import neardup, shared, units
from paritymill.llm.components import components
from paritymill.llm.queries import op4_near_duplicates


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {i: set_of(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for sh in s:
            holders.setdefault(sh, []).append(i)
    for pair in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted(map(find, pair))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i, _ in rows}


def check(df_rows, got):
    want = brute(df_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (n, c, i == c) for i, (n, c) in want.items()
    }


def test_documents_equal_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], op4_near_duplicates(spark, tiny).collect())


def test_groups_of_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, "A b"), (2001, "a  B\n"), (2002, "a b c"), (2003, None), (2004, ""), (2005, " \n\t"), (2006, "é " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, label string, component int")
    check(rows, neardup.near_duplicates(df).collect())


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "A B C")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_every_text_of_a_repeated_id_is_compared(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(1, a), (1, b), (2, [*a[:59], "x"]), (3, [*b[:59], "y"]), (4, [f"c{k}" for k in range(60)])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id bigint, text string")
        got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_three_quarters_exactly_is_a_link(spark):
    # 8 and 6 shingles, 6 of them shared; then 7 and 5, 5 shared
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j"), (3, "p q r s t u v w x y z"), (4, "p q r s t u v w x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(rows, neardup.near_duplicates(df).collect())
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def plain_super_minhash(values, slots):
    sig = [float("inf")] * slots
    for v in values:
        p = list(range(slots))
        for j in range(slots):
            if j > max(sig):
                break
            d = int(units.mix(np.array([v], dtype=np.uint64), j + 1)[0])
            k = j + (((d >> 32) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], j + (d & 0xFFFFFFFF) / 2**32)
    return sig


def test_signature_equals_element_by_element():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 5, 40, 300]
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = rng.integers(0, 2**63, len(row), dtype=np.uint64)
    got = neardup.super_minhash(row, value, len(sizes), 16)
    for i, n in enumerate(sizes):
        if n:
            want = plain_super_minhash(value[row == i], 16)
            assert np.allclose(got[i] / 2.0**32, want)


def test_similarity_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
        value = np.concatenate([common, own[:50], common, own[50:]])
        sig = neardup.super_minhash(np.repeat([0, 1], 350), value, 2, 60)
        errors.append((sig[0] == sig[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02


def test_components_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    cycle = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    df = spark.createDataFrame(path + star + cycle + [(5, 5), (None, 3), (9999, 9999)] + path[:9], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, **{2000 + i: 2000 for i in range(50)}}
    assert components(df.limit(0), "a", "b").count() == 0


def test_texts_that_no_pair_needs_do_not_travel(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(7, "again"), (None, "none")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    wanted = spark.createDataFrame([(7,), (7,), (250,), (-1,)], "id bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = shared.found_in(docs, "id", wanted)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(7, "again"), (7, "t7"), (250, "t250")]
        assert "LeftSemi" not in plan and plan.index("SortMergeJoin") < plan.index("_bits")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
