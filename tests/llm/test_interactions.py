import itertools
import random
import re

import numpy as np
import pytest

from paritymill.llm import interactions, oracle, queries

DOCS = "doc_id bigint, text string, source string"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    return out + "D" * bool(re.search("[#$%&*|]", text))


def expected(docs, labels):
    """Every order applied to every document, one by one."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(i, t or "", s or "") for i, t, s in docs]
    masks = []
    for i, t, s in docs:
        later = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        masks.append((i, s, fails(t) + "E" * later))
    out = {}
    for part in {s for _, s, _ in masks}:
        mine = [(i, m) for i, s, m in masks if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                shapley[letter] += len(gone)
                failing = sum(letter in m for _, m in mine)
                rows["".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(m == letter for _, m in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ]
        for key, row in rows.items():
            out[part, *key] = (*row[:-1], shapley[row[-1]])
    return out


def found(spark, docs, labels, docs_schema=DOCS):
    rows = interactions.audit(spark.createDataFrame(docs, docs_schema), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in interactions.MEASURES) for r in rows}
    assert len(got) == len(rows)
    return got


def text_of(rng):
    words = [rng.choice(["a", "b", "Cc", "dd"]) if rng.random() < 0.5 else f"w{rng.random()}" for _ in range(rng.choice([3, 199, 200, 220]))]
    return rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", " #", " AAAAAAAAAA", " \u3000\u00c9|"])


def test_random_documents_equal_all_orders_applied(spark):
    rng = random.Random(3)
    texts = [text_of(rng) for _ in range(40)] + [None, "", " "]
    docs = [(rng.choice([*range(120), None]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(160)]
    docs += docs[:5]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(90), *range(10), None, 500]]
    assert found(spark, docs, labels) == expected(docs, labels)


def test_exact_borders(spark):
    half = " ".join(["x"] * 101 + [f"y{i}" for i in range(99)])  # 200 words, 100 distinct: not below half
    upper = "AB" + "c" * 98  # 2 of 100
    docs = [(1, half, "s"), (2, half + " x", "s"), (3, upper, "s"), (4, upper[:-1], "s")]
    assert [fails(t) for _, t, _ in docs] == ["", "B", "A", "AC"]
    assert found(spark, docs, []) == expected(docs, [])


def test_long_text_clashing_columns_and_empty_tables(spark):
    wide = DOCS + ", part string, mask int, digest string, n int, id int"
    docs = [(1, "Word# " * 300_000, "s", "p", 1, "d", 5, 9), (2, "Word# " * 300_000, "s", "p", 1, "d", 5, 9)]
    assert found(spark, docs, [(2, 1, 1)], wide) == expected([d[:3] for d in docs], [(2, 1, 1)])
    assert found(spark, [], []) == {}


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_min_plus_is_the_first_failing_step(filters):
    orders = np.array(list(itertools.permutations(range(filters))))
    steps = interactions.min_plus(interactions.mask_matrix(filters), interactions.position_matrix(orders))
    for mask in range(1 << filters):
        for o, order in enumerate(orders):
            first = next((p for p, f in enumerate(order, 1) if mask >> f & 1), None)
            assert steps[mask, o] == first if first else steps[mask, o] > filters


def test_query_equals_sql(spark, tiny):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    rel = con.sql(oracle.sql()["op12_filter_interactions"])
    got = queries.op12_filter_interactions(spark, tiny).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
