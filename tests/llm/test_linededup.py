import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paritymill.llm import linededup
from paritymill.llm.queries import op10_fuzzy_lines


def plain(line):
    out = line.strip(" \t\n\x0b\f\r")
    return out.lower()


def shingles(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def brute(rows):
    """(doc, line) -> place that stays, over all pairs of lines."""
    places = {}
    for doc, text in rows:
        for n, raw in enumerate((text or "").split("\n")):
            if len(plain(raw)) >= linededup.MIN_CHARS:
                places.setdefault(plain(raw), []).append((doc, n))
    bodies = list(places)
    sets = [shingles(b) for b in bodies]
    parent = list(range(len(bodies)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(bodies)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, b in enumerate(bodies):
        least[find(i)] = min(least.get(find(i), (1 << 62, 0)), min(places[b]))
    return {p: least[find(i)] for i, b in enumerate(bodies) for p in places[b] if p != least[find(i)]}


def test_edited_lines_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 10))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(rng.choice(["", " "]) + " ".join(w).capitalize())
        rows.append((doc, "\n".join([*lines, "short", "", " \t"])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in linededup.duplicate_lines(df).collect()}
    want = brute(rows)
    lost = {k for k in want.keys() | got.keys() if want.get(k) != got.get(k)}
    assert len(lost) <= 0.01 * len(want)


def test_documents_nearly_equal_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line) for r in linededup.duplicate_lines(df).collect()}
    want = brute(rows).keys()
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_rest_of_the_text_stays(spark):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [(3, f"{line}\nx\n{line.upper()} \nown text of this document here", 1), (4, f" {line}", 2), (5, None, 3), (6, "", 4), (None, line, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, dropped int")
    out = {r.doc_id: (r.text, r.dropped) for r in linededup.dedup_lines(df).collect()}
    assert out == {3: (f"{line}\nx\nown text of this document here", 1), 4: ("", 2), 5: (None, 3), 6: ("", 4), None: (line, 5)}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def similar(a, b):
    return linededup.alike(*linededup._sets(pa.array([plain(a), plain(b)])))


def test_shingles_are_those_of_the_characters():
    lines = ["a b c d e f g h i j k l", "abcdefghijklm" * 3, "h\u00e9llo w\u00f6rld \u4f60\u597d\U0001f600 and more", "----", "", "-" * 40]
    for line, found in zip(lines, linededup._sets(pa.array(lines)), strict=True):
        assert len(found) == len(shingles(line)) and (np.diff(found.astype(object)) > 0).all()


def test_similarity_and_long_lines(spark):
    assert similar("abcdefghij" * 3_000, "abcdefghij" * 2_000) and not similar("a" * 30, "b" * 30)
    rows = [(d, x) for x in ("word " * 40_000, "x" * 100_000) for d in (1, 2)]
    long = spark.createDataFrame([(2 * i + d, x) for i, (d, x) in enumerate(rows)], "doc_id bigint, text string")
    assert linededup.duplicate_lines(long).count() == 2


def test_exactly_75_percent_is_linked_and_less_is_not(spark):
    base = "".join(chr(0x4E00 + i) for i in range(34))  # 30 shingles, all different
    tie = base[:28] + "ABCD"  # 24 shared of 30 + 28 - 24 = 34: below
    exact = base + "".join(chr(0x5E00 + i) for i in range(10))  # 30 shared of 40
    rows = [(1, base), (2, tie), (3, exact)]
    assert similar(base, exact) and not similar(base, tie)
    found = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [(r.doc_id, r.first_doc) for r in found.collect()] == [(3, 1)]


def test_repetitive_lines_of_unlike_lengths_are_linked(spark):
    rows = [(1, "-" * 25), (2, "-" * 80), (3, "abc " * 8 + "."), (4, "abc " * 20 + ".")]
    found = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.first_doc) for r in found.collect()} == {(2, 1), (4, 3)}


def test_a_repeated_id_keeps_its_unique_text(spark):
    line, own = "this line is repeated in documents", "this sentence stands in one text only"
    df = spark.createDataFrame([(4, line), (5, line), (5, own), (5, own)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == [(4, line), (5, ""), (5, own), (5, own)]


def test_a_family_about_the_threshold_is_whole(spark, monkeypatch):
    """More members than a block holds, each near its neighbours only."""
    from paritymill.llm import buckets

    monkeypatch.setattr(buckets, "CHUNK", 16)
    rng = random.Random(9)
    text = [rng.choice("abcdefghij") for _ in range(120)]
    rows = []
    for doc in range(150):
        text[rng.randrange(len(text))] = rng.choice("abcdefghij")
        rows.append((doc, "".join(text)))
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in linededup.duplicate_lines(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute(rows)
    assert len({k for k in want.keys() | got.keys() if want.get(k) != got.get(k)}) <= 0.01 * len(want)


def test_lines_that_differ_in_case_or_one_word_are_linked(spark):
    rng = random.Random(4)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(15))
    edited = line.split()
    edited[7] = "zzzzzzz"
    rows = [(1, line), (2, line.upper()), (3, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(similar(line, t) for _, t in rows)
    assert {(r.doc_id, r.first_doc) for r in linededup.duplicate_lines(df).collect()} >= {(2, 1)}


def test_long_words_keep_their_kind_of_set(spark):
    rng = random.Random(5)
    line = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(10)) for _ in range(40))
    df = spark.createDataFrame([(1, line), (2, line + "mn")], "doc_id bigint, text string")
    assert [(r.doc_id, r.first_doc) for r in linededup.duplicate_lines(df).collect()] == [(2, 1)]


def test_pairs_at_the_threshold_share_a_bucket():
    rng, pairs = random.Random(6), 4_000
    texts = []
    for _ in range(pairs):  # 48 of 64 shingles shared: a similarity of 0.75
        shared, left, right = ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (52, 8, 8))
        texts += [shared + left, right + shared]
    assert sum(similar(*texts[2 * p : 2 * p + 2]) for p in range(100)) == 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * pairs)), pa.array(texts)], ["key", "body"])
    seen, met = {}, set()
    for part in linededup._buckets(iter([batch])):
        for bucket, rep in zip(part.column("bucket").to_pylist(), part.column("rep").to_pylist(), strict=True):
            if seen.setdefault((bucket, rep // 2), rep) != rep:
                met.add(rep // 2)
    assert pairs - len(met) <= 0.002 * pairs


def test_rows_of_shared_buckets_meet_as_they_stream_by(monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 3)
    rng = random.Random(2)
    for _ in range(30):
        rows = sorted((b, rng.randrange(1, 9)) for b in range(6) for _ in range(rng.choice([0, 1, 1, 3, 6])))
        held = {b: sorted({r for x, r in rows if x == b}) for b, _ in rows}
        pairs = {(b, x, y) for b, r in held.items() if len(r) <= 3 for x in r for y in r if x < y}
        lines = {(b, x, None) for b, r in held.items() if len(r) > 3 for x in r}
        for width in range(1, len(rows) + 1):
            parts = [rows[i : i + width] for i in range(0, len(rows), width)]
            made = [
                pa.RecordBatch.from_arrays([*[pa.array(c) for c in zip(*p, strict=True)], pa.array([7] * len(p))], linededup._MEMBER)
                for p in parts
            ]
            out = [(r["bucket"], r["rep"], r["other"]) for part in linededup._meet(iter(made)) for r in part.to_pylist()]
            assert len(out) == len(set(out)) and set(out) == pairs | lines, (width, rows)


def test_query_covers_all_documents(spark, tiny):
    out = op10_fuzzy_lines(spark, tiny)
    assert out.count() == spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert out.where("n_dropped > n_lines").count() == 0 and out.where("n_dropped > 0").count() > 0


def test_repeated_lines_of_a_batch_are_hashed_once(monkeypatch):
    lines = ["the same long line of text", "another line of the text", "the same long line of text", "", "äöü" * 9]
    seen, plain = [], linededup.shingle_sets
    monkeypatch.setattr(linededup, "shingle_sets", lambda part: seen.append(part.rows) or plain(part))
    column = pa.chunked_array([pa.array(lines[:2]), pa.array(lines[2:])])
    got = linededup._sets(column)
    assert sum(seen) == 4 and [len(s) for s in got] == [len({x[i : i + 5] for i in range(len(x) - 4)}) for x in lines]
    assert (got[0] == got[2]).all() and linededup._sets(pa.array([], pa.string())) == []


def test_rows_in_blocks_grow_with_what_is_not_joined(spark, monkeypatch):
    """A large joined family meets the others of its bucket, not itself; every pair of labels meets."""
    from paritymill.llm import buckets

    monkeypatch.setattr(buckets, "CHUNK", 8)
    family = [(1, rep, 0) for rep in range(400)] + [(1, rep, rep) for rep in range(400, 406)]
    mixed = [(2, rep, rep // 5) for rep in range(40)]
    rest = spark.createDataFrame([*family, *mixed, *[(3, rep, 9) for rep in range(20)]], "bucket bigint, rep bigint, label bigint")
    rows = buckets.blocks(rest).collect()
    assert sum(r.bucket == 1 for r in rows) <= 400 + 6 * 51 and not [r for r in rows if r.bucket == 3]
    met = set()
    for bucket, low, high in {(r.bucket, r.low, r.high) for r in rows}:
        own = [r for r in rows if (r.bucket, r.low, r.high) == (bucket, low, high)]
        met |= {(x.rep, y.rep) for x in own for y in own if x.rep < y.rep and x.label != y.label and (low == high or x.chunk != y.chunk)}
    want = {(x[1], y[1]) for part in (family, mixed) for x in part for y in part if x[1] < y[1] and x[2] != y[2]}
    assert met >= want


def test_many_short_lines_have_the_sets_of_few():
    lines = [f"line {i % 7} é" for i in range(70_000)]
    few = [list(s) for s in linededup._sets(pa.array(lines[:7]))]
    part = next(linededup.units.slices(pa.array(lines), 1 << 22))
    row, value = linededup.shingle_sets(part)
    assert part.rows == 70_000 and [list(value[row == i]) for i in (0, 6, 69_999)] == [few[0], few[6], few[69_999 % 7]]


def test_marks_pass_lines_at_the_threshold_and_few_others(spark):
    rng = random.Random(11)
    rows = []
    for share in (48, 14):  # of 64 shingles each: similarities of 0.6 x 5/4 = 0.75 and below 0.13
        for _ in range(300):
            shared, left, right = ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (share + 4, 56 - share, 56 - share))
            rows += [shared + left, right + shared]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["key", "body"])
    table = pa.Table.from_batches(linededup._mark(iter([batch])))
    marks = [table.column(c).to_numpy() for c in linededup.MARKS]
    apart = linededup._marks_apart([m[::2] for m in marks], [m[1::2] for m in marks])
    assert (apart[:300] <= linededup.MARK_APART).all() and (apart[300:] > linededup.MARK_APART).all()
    names = [[f"{side}{c}" for c in linededup.MARKS] for side in "ab"]
    pairs = [[int(m[i + k]) for k in (0, 1) for m in marks] for i in range(0, 100, 2)]
    df = spark.createDataFrame(pairs, ", ".join(f"{c} bigint" for c in names[0] + names[1]))
    assert [r[0] for r in df.select(linededup._slots_apart(*names)).collect()] == apart[:50].tolist()


def test_texts_of_unlike_lines_do_not_travel(spark, monkeypatch):
    """Lines that share a bucket and a sketch but are unlike are told apart before their texts are sent."""
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(40)]
    lines += [lines[0] + "x", lines[1] + "y"]
    plain, sent = linededup._buckets, []

    def one_bucket(batches):
        for part in plain(batches):
            rep = pa.array(sorted(set(part.column("rep").to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(rep)), rep, pa.array([0] * len(rep))], linededup._MEMBER)

    class Watched(linededup.Scratch):
        def stage(self, df, label, options=None):
            out = super().stage(df, label, options)
            if label == "line-bodies":
                sent.append({r.body for r in out.collect()})
            return out

    monkeypatch.setattr(linededup, "_buckets", one_bucket)
    monkeypatch.setattr(linededup, "Scratch", Watched)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    for small in (64, 3):  # as pairs, and as a large bucket
        sent.clear()
        monkeypatch.setattr(linededup, "SMALL", small)
        got = {(r.doc_id, r.first_doc) for r in linededup.duplicate_lines(df).collect()}
        assert got == {(40, 0), (41, 1)} and set().union(*sent) == {lines[0], lines[1], lines[40], lines[41]}


def test_rows_that_need_no_join_stay_where_they_are(spark):
    from paritymill.llm import shared

    df = spark.createDataFrame([(k, f"t{k}") for k in [*range(-50, 50), 7, None]], "id bigint, text string")
    wanted = spark.createDataFrame([(7,), (-3,), ((1 << 40) + 99,)], "id bigint")
    maybe, rest = shared.parted(df, "id", wanted)
    assert sorted(r.id for r in maybe.collect()) == [-3, 7, 7]
    assert rest.count() == 99 and rest.where("id IS NULL").count() == 1
    assert "hashpartitioning(id" not in rest._jdf.queryExecution().executedPlan().toString()
