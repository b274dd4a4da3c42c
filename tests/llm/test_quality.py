import random
import re

import pytest
from pyspark.sql import functions as F

from paritymill.llm import quality


def facts_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_facts_equal_a_plain_count(spark):
    rng = random.Random(2)
    bits = ["a", "b", "é", "😀", "#", "*|", "word", "\n", "\n\n", " ", "  ", "\t", "\x0b", "\r", "\xa0", "!", "<x>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", " \n", "x " * 20_000, " ".join(map(str, range(20_000))), "a b c d e f g h " * 2, "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in df.select("doc_id", quality.text_facts(F.col("text")).alias("f")).collect():
        assert tuple(r.f[n] for n in quality.FACTS) == facts_of(texts[r.doc_id]), texts[r.doc_id]


def test_hosts_are_shrunk_and_judged(spark):
    good, junk = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}###" for i in range(40))
    rows = []
    for host, n, bad in (("clean", 400, 0), ("bad", 100, 90), ("mixed", 100, 20), ("tiny", 1, 1), (None, 10, 0)):
        rows += [(len(rows) + i, junk if i < bad else good, host, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, facts int")
    out = quality.judge(df, ["doc_id", "source", "facts"])
    got = {(r.source, r.host_verdict, r.kept): r.n for r in out.groupBy("row.source", "host_verdict", "kept").agg(F.count("*").alias("n")).collect()}
    assert got[("clean", "trusted", True)] == 400
    assert got[("bad", "blocked", False)] == 100
    assert (got[("mixed", "mixed", True)], got[("mixed", "mixed", False)]) == (80, 20)
    rates = {r.host: r.rate for r in quality.host_verdicts(
        df.select(F.coalesce("source", F.lit("")).alias("host"), F.col("text").contains("#").alias("failed")), "host", "failed").collect()}
    assert rates["tiny"] < 0.9 and abs(rates["mixed"] - 0.2) < 0.02
    assert out.where("row.facts <> 7").count() == 0


def test_null_texts_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "h"), (1, None, "h"), (None, "", None)], "doc_id bigint, text string, source string")
    assert [r.kept for r in quality.judge(df, ["doc_id"]).collect()] == [False] * 3
    assert quality.judge(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["op2_host_quality"])
def test_sql(spark, tiny, name):
    import duckdb

    from paritymill.llm import oracle, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    got = queries.queries()[name](spark, tiny)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.sql()[name]}) ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, got.collect())) == want
