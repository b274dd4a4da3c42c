import hashlib
import random
import re

from pyspark.sql import functions as F

from paritymill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def base_of(text):
    found = [
        (m.start(), i, m.end(), kind)
        for i, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def results(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find_pii(df)
    rows = found.select("doc_id", pii.span_text(pii.base_spans(F.col("pii"))).alias("base"), pii.span_text(F.col("pii")).alias("all")).collect()
    return {r.doc_id: r for r in rows}


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(5)
    bits = ["a@b.com", "_x@y.zz", "é", "😀", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "1.2.3.4",
            "1.2.3.4.5", "999.1.1.1", "007.1.1.1", " ", "\n", "-", ".", "+", "@", "12", "0" * 12, "79927398713", "x%y@q", "+44 20", "7" * 25]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1 " * 30_000, "5" * 40_000, "a@b.c " * 3_000, "1." * 20_000]
    got = results(spark, texts)
    for i, t in enumerate(texts):
        assert got[i].base == base_of(t), t


def test_documents_base_hash(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    from paritymill.llm.queries import op9_personal_data

    got = {r.doc_id: r for r in op9_personal_data(spark, tiny).collect()}
    for r in docs.collect():
        base = base_of(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[r.doc_id].n_email == base.count("email")
        assert got[r.doc_id].n_card == base.count("card")


def test_added_kinds_and_scores(spark):
    got = results(spark, ["iban GB82WEST12345698765432 x", "iban GB82WEST12345698765431 x", "my ssn 123-45-6789", "part 123-45-6789", "ssn 666-45-6789"])
    assert [got[i].all for i in range(5)] == ["iban:5:27", "", "ssn:7:18", "", ""]
    df = spark.createDataFrame([("credit card 79927398713000000 or 4111111111111111", 1)], "text string, pii int")
    spans = pii.find_pii(df).head().pii
    assert spans[-1].value == "4111111111111111" and spans[-1].score >= 0.8


def test_redaction_replaces_spans_only(spark):
    df = spark.createDataFrame([("é a@b.com und 1.2.3.4!",), (None,), ("",)], "text string")
    rows = [r.redacted for r in pii.redact(pii.find_pii(df)).collect()]
    assert rows == ["é [EMAIL] und [IP]!", "", ""]


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "text string")
    assert pii.find_pii(df).count() == 0
    two = spark.createDataFrame([("a@b.com",)] * 2, "text string")
    assert [len(r.pii) for r in pii.find_pii(two).collect()] == [1, 1]
