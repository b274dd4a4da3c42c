import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paritymill.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """Least (cost, audit) by trying all edits, whole audits compared; inserts end after three in a row."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for made in "ua":
            if inserts < 3 and (state, made) in move:
                c, a, r = best(i, move[state, made], inserts + 1)
                options.append((c + 3, "I" + a, ((made, None), *r)))
        if i < len(rows):
            c, a, r = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, r))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 * (kinds[i] == "truncated")
                first = rows[i][2][:1]
                if (state, first) in move:
                    c, a, r = best(i + 1, move[state, first], 0)
                    options.append((c + extra, "K" + a, ((None, i), *r)))
                for made in "ua":
                    if (state, made) in move:
                        c, a, r = best(i + 1, move[state, made], 0)
                        options.append((c + extra + 3, "R" + a, ((made, i), *r)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def expected(rows):
    """Every original conversation of the contract, by plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        kinds = faults(mine)
        cost, audit, made = cheapest(mine, tuple(kinds)) if mine else (0, "", ())
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[r] if r else mine[i][2]}:{'' if i is None else mine[i][3]}" for r, i in made]
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(rng, conv, turns, texts=("One.", "Two!", "Three", " \n", "", "Four?\n", None)):
    roles = ("system", "user", "assistant", "user", "assistant", "tool", "", None)
    return [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]


def table(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/conversations.parquet")
    found = queries.op13_conversation_repair(spark, str(folder)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[n] for n in names) for r in found}
    assert len(got) == len(found)
    return got


def test_random_conversations_equal_all_edits_tried(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for conv in range(150):
        turns = rng.sample(range(-3, 30), rng.randrange(1, 9))
        rows += rows_of(rng, conv, turns)
        if not conv % 5:
            rows += rows_of(rng, conv, [None])
        if not conv % 7:
            rows += rows[-2:]
    rows += rows_of(rng, None, range(6))
    rng.shuffle(rows)
    assert table(spark, tmp_path, rows) == expected(rows)


def test_conversations_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_TURNS", 4)
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        rows += rows_of(rng, conv, rng.sample(range(60), rng.randrange(1, 40)), ("One.", "Two", "Three!", "Four.", ""))
    assert table(spark, tmp_path, rows) == expected(rows)


def test_long_texts_ties_repeats_and_a_dropped_conversation(spark, tmp_path):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "A."), (2, 0, "user", "A."), (2, 0, "assistant", "B.")]
    gone = next(c for c in range(3, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "A."), (5000, None, None, None)]
    got = table(spark, tmp_path, rows)
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_clashing_columns(spark, tmp_path):
    wide = SCHEMA + ", conv string, block int, digest string, audit string, repaired string"
    assert table(spark, tmp_path / "none", [], wide) == {}
    rows = [(1, 0, "user", "Hi.", "x", 1, "x", "x", "x"), (1, 1, "user", "So.", "x", 1, "x", "x", "x")]
    assert table(spark, tmp_path / "some", rows, wide) == expected([r[:4] for r in rows])


def test_repaired_rows_follow_the_grammar(spark, tiny):
    rows = queries.damaged(spark.read.parquet(f"{tiny}/conversations.parquet"))
    made = repair.repair(rows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", F.substring("role", 1, 1).alias("i")))).alias("r")
    )
    for row in made.collect():
        initials = "".join(r.i for r in row.r).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)


@pytest.mark.parametrize("signature", ["", "u", "ua", "sUaobd", "aaa", "dbd"])
def test_nodes_are_shared_by_suffix(signature):
    automaton = repair.Automaton()
    whole = automaton.path("ua" + signature, None)
    size = len(automaton.nodes)
    assert automaton.path(signature, None) == whole[2:] and len(automaton.nodes) == size
