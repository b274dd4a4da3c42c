import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paritymill.llm import toxicity, units


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 4]
    unary, mask = rng.normal(size=(4, 5)), np.arange(5)[None, :] < np.array(sizes)[:, None]
    trans = rng.normal(size=(2, 2))
    got, pairs, total = toxicity.forward_backward(np.where(mask, unary, 0.0), mask, trans)
    seen = np.zeros((2, 2))
    for i, n in enumerate(sizes):
        weight, share = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            s = sum(unary[i, k] for k in range(n) if states[k]) + sum(trans[a, b] for a, b in itertools.pairwise(states))
            weight += np.exp(s)
            share += np.exp(s) * np.array(states)
            for a, b in itertools.pairwise(states):
                both[a, b] += np.exp(s)
        assert np.allclose(got[i, :n], share / weight) and np.isclose(total[i], np.log(weight))
        seen += both / weight
    assert np.allclose(pairs, seen)


def corpus(rng, n):
    bad, words = ["idiot", "scumbag", "réeuxpa", "réeuxon"], [f"w{k}x" for k in range(400)]
    rows = []
    for d in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic = d % 5 == 0
        for _ in range(3 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad).capitalize() + rng.choice(["", ",", "!!"])
        rows.append((d, "\n".join([" ".join(text[:20]), " ".join(text[20:])]), int(toxic)))
    return rows


def test_held_out_accuracy_and_spans(spark):
    rows = corpus(random.Random(2), 600)
    df = spark.createDataFrame(rows, "id bigint, text string, toxic int")
    model = toxicity.fit(df.where("id % 3 > 0"))
    held = df.where("id % 3 = 0").withColumn("score", F.lit("x"))
    out = {r.id: r for r in toxicity.score(held, model, "id").collect()}
    truth = {i: (t, y) for i, t, y in rows}
    right = sum((r.score >= 0.5) == bool(truth[i][1]) for i, r in out.items())
    assert right >= 0.97 * len(out)
    for i, r in out.items():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert truth[i][0][a:b].lower().startswith(("idiot", "scumbag", "réeux"))


def test_odd_rows_and_models_without_labels(spark):
    df = spark.createDataFrame([(1, None, None), (None, "", 1), (2, " \n", 0), (3, "a " * 60_000, 0), (3, "É a", 1)], "id bigint, text string, toxic int")
    model = toxicity.fit(df)
    out = toxicity.score(df, model, "id").collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0)), "id").count() == 0


def test_tokens_do_not_cross_texts_and_lower_without_moving():
    part = next(units.slices(pa.array(["ÉCOLE ab", "école,AB!x", None, "Ab"])))
    t = toxicity.tokens_of(part)
    assert np.diff(t.bounds).tolist() == [2, 3, 0, 1]
    assert t.features[0, 0] == t.features[2, 0] and t.features[1, 0] == t.features[3, 0] == t.features[5, 0]
    assert len(set(t.line.tolist())) == 3
