"""Sources, sinks, payload safety and hash chains."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from paritymill.functions.columns import decimal_from_text, decimal_text, identifier_ok, record_hash, rfc3339
from paritymill.functions.safety import payload_safety, redact_payload
from paritymill.operators import connections, integrity, native, reports
from paritymill.sources import jsonl, records


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")


def test_decimal_text_is_exact_or_refused(spark):
    df = texts(spark, "0.4200", "1e-3", "abc", "0.0000000000000000001", "0.1000000000000000000", "-0.5")
    got = [r[0] for r in df.select(decimal_from_text(F.col("t"))).collect()]
    assert got == [D("0.42"), None, None, None, D("0.1"), D("-0.5")]
    shown = [r[0] for r in df.select(decimal_text(decimal_from_text(F.col("t")))).collect()]
    assert shown == ["0.42", None, None, None, "0.1", "-0.5"]


def test_times_and_identifiers(spark):
    df = texts(spark, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00", "2026-01-01T00:00:00-00:00", "2026-13-01T00:00:00Z")
    assert [r[0] is not None for r in df.select(rfc3339(F.col("t"))).collect()] == [True, False, False, False]
    df = texts(spark, "KX-1", "KX 1", "", "KX 1", "KX​1")
    assert [r[0] for r in df.select(identifier_ok(F.col("t"))).collect()] == [True, False, False, False, False]


def test_record_hash_is_canonical_json(spark):
    df = texts(spark, "x")
    got = df.select(record_hash({"b": F.col("t"), "a": F.lit(None).cast("string")})).first()[0]
    assert got == hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()


def test_strict_and_quarantine_reads(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"a":1}\n\n{"a":2}\n{"a":\n[1]\n')
    with pytest.raises(Exception, match="malformed JSON line"):
        jsonl.read_jsonl(spark, str(path), "a int")[0].collect()
    with pytest.raises(Exception, match="malformed JSON line"):
        jsonl.read_jsonl(spark, str(path), "a int")[0].select("source_path").count()
    good, bad = jsonl.read_jsonl(spark, str(path), "a int", "quarantine")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert sorted((r.source_path.rsplit("/")[-1], r.line_number) for r in bad.collect()) == [("in.jsonl", 4), ("in.jsonl", 5)]


def test_line_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    lines = ['{"a":1}'] * 3_000
    for n in (1, 777, 2_999, 3_000):
        lines[n - 1] = "{"
    path.write_text("\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        bad = jsonl.read_jsonl(spark, str(path), "a int", "quarantine")[1]
        assert sorted(r.line_number for r in bad.collect()) == [1, 777, 2_999, 3_000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_redaction_of_broken_lines_leaks_nothing(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"token":"abcSECRET\n{"api_key":{"a":\n{"api_key":{"a":"SECRET"},"n":1}\n')
    good, bad = jsonl.read_jsonl(spark, str(path), "n int, api_key string", "quarantine", redact=True)
    assert [(r.n, r.api_key) for r in good.collect()] == [(1, "[REDACTED]")]
    assert bad.count() == 2 and "SECRET" not in str(bad.collect())


def test_redaction_keeps_all_other_bytes(spark):
    big = '{"a" : 12345678901234567890.123456789, "b":1.10,"é":"\\u00e9","api_key": {"x":[1,{"y":"}"}]} , "c":[ ]}'
    escaped = '{"\\u0061pi_key":"x","n": 1.0}'
    got = [r.t for r in redact_payload(texts(spark, big, escaped, '{"n":1.50}', None), "t").orderBy("i").collect()]
    assert got == [
        '{"a" : 12345678901234567890.123456789, "b":1.10,"é":"\\u00e9","api_key": "[REDACTED]" , "c":[ ]}',
        '{"\\u0061pi_key":"[REDACTED]","n": 1.0}', '{"n":1.50}', None,
    ]
    assert [r.payload_safe for r in payload_safety(texts(spark, escaped, '{"n":1}'), "t").orderBy("i").collect()] == [False, True]


@pytest.mark.parametrize("document", ['{"markets":3}', '{"cursor":""}', "[1]", "{"])
def test_pages_without_a_list_fail(spark, document):
    good = '{"markets":[{"t":1}]}'
    pages = spark.createDataFrame([(good,), (document,)], "document string")
    with pytest.raises(Exception, match="page without a list"):
        records.explode_pages(pages, "document", "markets").collect()


@pytest.mark.parametrize("document", ['{"source":"s"}', "{", "3"])
def test_book_documents_without_books_fail(spark, document):
    with pytest.raises(Exception, match="without markets or books"):
        records.books_from_documents(spark.createDataFrame([(document,)], "document string")).count()


def test_canonical_write_appends(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(D("0.4200"), "x", None)], "b decimal(20,18), a string, c string")
    jsonl.write_jsonl(df, out)
    jsonl.write_jsonl(df, out, "append")
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":"x","b":"0.42","c":null}'] * 2


def test_books_fixture_defaults(spark, tmp_path):
    path = tmp_path / "books.json"
    book = {"venue": "v", "market_id": "m", "best_yes_bid": "0.5", "best_no_bid": "0.52", "yes_bid_size": "1", "no_bid_size": "2"}
    path.write_text(json.dumps({"source": "s", "fee_status": "supplied", "fee_per_contract": "0.01",
                                "markets": [book, {**book, "fee_status": "missing"}]}, indent=1))
    rows = records.read_books_fixture(spark, str(path)).orderBy("sequence").collect()
    assert [(r.source, r.sequence, r.fee_status, r.fee_per_contract) for r in rows] == [
        ("s", 1, "supplied", D("0.01")), ("s", 2, "missing", D("0.01"))
    ]


def test_company_facts(spark):
    fact = {"val": 3, "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-01-01", "end": "2022-12-31", "accn": "a"}
    doc = {"cik": 320193, "entityName": "E", "facts": {"skip": 1, "us-gaap": {"Revenue": {"units": {"USD": [fact, fact]}}}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "document string")
    rows = records.flatten_company_facts(df).collect()
    assert len(rows) == 2
    assert (rows[0].cik, rows[0].label, rows[0].value, rows[0].fiscal_year) == ("0000320193", "Revenue", 3, 2022)
    bad = {"cik": 1, "entityName": "E", "facts": {"t": {"C": {"label": "l"}}}}
    with pytest.raises(Exception, match="concept without units"):
        records.flatten_company_facts(spark.createDataFrame([(json.dumps(bad),)], "document string")).collect()


def test_company_facts_lose_nothing(spark):
    def flat(body):
        fact = f'{{"val":{body},"fy":2022}}'
        doc = f'{{"cik":1,"entityName":"E","facts":{{"t":{{"C":{{"units":{{"u":[{fact}]}}}}}}}}}}'
        return records.flatten_company_facts(spark.createDataFrame([(doc,)], "document string")).collect()

    assert flat("0.12345678")[0].value == D("0.12345678")
    for bad in ("0.1234567890123", "1e99", '"x"'):
        with pytest.raises(Exception, match="out of range"):
            flat(bad)
    with pytest.raises(Exception, match="without facts"):
        records.flatten_company_facts(spark.createDataFrame([("{",)], "document string")).collect()


def test_safety_of_long_texts_and_nested_secrets(spark):
    long = 'say "password": 1 \\ ' * 20_000
    payloads = [
        json.dumps({"body": long, "n": 1}), json.dumps({"a": [{"My_Token": {"x": [1]}}], "order_id": 2}), json.dumps({"Password": "p"}),
    ]
    df = texts(spark, *payloads)
    got = [(r.secret_keys, r.private_keys) for r in payload_safety(df, "t").orderBy("i").collect()]
    assert got == [([], []), (["my_token"], ["order_id"]), (["password"], [])]
    clean = [json.loads(r.t) for r in redact_payload(df, "t").orderBy("i").collect()]
    assert clean == [
        {"body": long, "n": 1}, {"a": [{"My_Token": "[REDACTED]"}], "order_id": 2}, {"Password": "[REDACTED]"}
    ]


def test_envelope_conflicts(spark):
    df = texts(
        spark,
        '{"type":"trade","sid":1,"msg":{"sid":"1"}}', '{"type":"trade","sid":true}', '{"sid":1}',
        '{"type":"subscribed","id":1,"msg":{"channel":"trade","sid":2}}', '{"type":"trade","msg":{"type":"trade","sid":3}}',
    )
    rows = native.native_envelope(df, "t").orderBy("i").collect()
    assert [r.envelope_rejection for r in rows] == [
        "CONFLICTING_NATIVE_SID", "INVALID_NATIVE_SID", "MISSING_NATIVE_TYPE", None, None
    ]
    assert (rows[3].channel, rows[3].request_id, rows[3].sid) == ("trade", "1", "2")
    assert (rows[4].provenance.type, rows[4].provenance.sid, rows[4].channel) == ("duplicate_equal", "nested_msg", "trade")


def test_segment_chain_equals_hashlib(spark):
    lines = [json.dumps({"local_row_index": i, "v": i}, sort_keys=True, separators=(",", ":")) for i in range(1, 6)]
    lines[3] = lines[3].replace(":", ": ", 1)
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "segment_id string, ord bigint, record string")
    r = integrity.segment_chain_audit(df, "v9").first()
    digest = hashlib.sha256(b"v9:s").digest()
    for t in lines:
        raw = (t + "\n").encode()
        digest = hashlib.sha256(digest + len(raw).to_bytes(8, "big") + raw).digest()
    assert (r.chain_hash, r.record_count, r.first_flaw_index, r.first_flaw) == (digest.hex(), 5, "4", "not_canonical")


def test_drawdown_places_undated_points_first(spark):
    df = spark.createDataFrame(
        [(1, "2026-01-05", D("5")), (2, "2026-01-06", D("-3")), (3, None, D("-2")), (4, "2026-01-06", D("-1")), (5, "2025-01-01", D("-99"))],
        "ord bigint, report_date string, paper_pnl decimal(38,18)",
    )
    got = {r.window_days: r.max_drawdown for r in reports.max_drawdown(df, date(2026, 1, 7), "ord", (2, 7)).collect()}
    assert got == {2: D(6), 7: D(4)}


def test_quiet_gap_rounds_up_and_counts_both_ends(spark):
    t = lambda s: datetime(2026, 1, 1, 0, 0, s, 500, tzinfo=timezone.utc)
    obs = spark.createDataFrame([("r", "k", t(2)), ("r", "k", t(9))], "run_id string, kind string, observed_at timestamp")
    runs = spark.createDataFrame(
        [("r", datetime(2026, 1, 1, tzinfo=timezone.utc), t(10))], "run_id string, started_at timestamp, ended_at timestamp"
    )
    r = connections.max_quiet_gap(obs, runs, 1).first()
    assert (r.max_gap_seconds, r.last_age_seconds) == (7, 1)
