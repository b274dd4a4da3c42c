"""Conversation structure repair over a suffix-shared automaton.

A row of a conversation is one symbol, its role and first fault; a run of rows is a
signature.  Signatures are read from the end: a node of the automaton stands for a suffix,
equal suffixes of all conversations are one node, and a node knows for each grammar state
the least cost to the end and the edit that comes first.  Edits that are equally cheap
differ in their letter, so the least letter is the least audit, and no audits are compared.

Grammar states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an
assistant row.  A conversation may end in 0 or 3.

A conversation is cut into blocks along its turns.  A block knows what follows it only by
the four costs to go of the next block's start, so blocks are analysed in any order: cost
matrices per block compose from the end, and the states entered compose from the start.
Only those, a few numbers a block, are ever ordered per conversation.

Rows are read as: null role or text is one space, null turns come first.  Rows of one turn
are ordered by role, then by the SHA-256 of their text; equal rows are interchangeable.
An empty role has no initial and fits no place of the grammar.  A null conversation id is a
conversation of its own.  Columns besides the four named are not looked at, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.llm.shared import Scratch

BLOCK_TURNS = 512
MAX_NODES = 1 << 20
SHARED_SUFFIX = 8
_NEVER = 1 << 40
# fixed values: costs of the edits, grammar
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MAKES = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
LEGAL = frozenset({"su", "ua", "au"})
BLANK, DUPLICATE = "b", "d"
_VISIBLE = r"[^\x20\x09-\x0D]"


# -- automaton -----------------------------------------------------------------------------


class Automaton:
    """Nodes by (symbol, node of the rest); roots are what follows the run.

    A symbol is ``b`` or ``d`` (must go), a role initial, or the initial in upper case for a
    truncated row; ``o`` is any other role.
    """

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.nodes: dict[tuple, int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.choices: list[str] = []

    def _add(self, key: tuple, base: list[tuple[int, str]]) -> int:
        """A node from its best edit without an insert, per state."""
        out = list(base)
        for state in (2, 3, 0, 1):  # inserts lead to 2 or 3 only, so these settle first
            step = MAKES[state][1]
            then = base[step][0] if state > 1 else out[step][0]
            out[state] = min(base[state], (INSERT + then, "I"))
        self.nodes[key] = node = len(self.costs)
        self.costs.append(tuple(c for c, _ in out))
        self.choices.append("".join(e for _, e in out))
        return node

    def root(self, after: tuple[int, ...] | None) -> int:
        """What follows: None is the end, else the costs to go by state."""
        node = self.nodes.get((None, after))
        if node is not None:
            return node
        if after is None:
            return self._add((None, None), [(0, "."), (_NEVER, "."), (_NEVER, "."), (0, ".")])
        self.nodes[None, after] = node = len(self.costs)
        self.costs.append(after)
        self.choices.append("....")
        return node

    def path(self, signature: str, after: tuple[int, ...] | None) -> list[int]:
        """Nodes of all suffixes, the whole signature first."""
        if len(self.nodes) > MAX_NODES:
            self._clear()
        path = [self.root(after)]
        for symbol in reversed(signature):
            below = path[-1]
            node = self.nodes.get((symbol, below))
            if node is None:
                go, base = self.costs[below], []
                role, extra = symbol.lower(), TRUNCATED * symbol.isupper()
                for state in range(4):
                    best = (DELETE + go[state], "D")
                    if symbol not in (BLANK, DUPLICATE):
                        if role in KEEPS[state]:
                            best = min(best, (extra + go[KEEPS[state][role]], "K"))
                        best = min(best, (REROLE + extra + go[MAKES[state][1]], "R"))
                    base.append(best)
                node = self._add((symbol, below), base)
            path.append(node)
        return path[::-1]

    def matrix(self, signature: str) -> list[int]:
        """Least cost through the run, entered state by state left."""
        ends = [tuple(0 if i == out else _NEVER for i in range(4)) for out in range(4)]
        rows = zip(*[self.costs[self.path(signature, e)[0]] for e in ends], strict=True)
        return [min(c, _NEVER) for row in rows for c in row]

    def walk(self, signature: str, after: tuple[int, ...] | None, state: int) -> tuple[str, list[tuple], int]:
        """(edits, rows that stay or come as (position or -1, role or None), state left)."""
        path, place = self.path(signature, after), 0
        edits, made = [], []
        while (edit := self.choices[path[place]][state]) != ".":
            edits.append(edit)
            role, step = MAKES[state]
            if edit == "I":
                made.append((-1, role))
            elif edit == "R":
                made.append((place, role))
            elif edit == "K":
                made.append((place, None))
                step = KEEPS[state][signature[place].lower()]
            state = state if edit == "D" else step
            place += edit != "I"
        return "".join(edits), made, state


# -- blocks of rows ------------------------------------------------------------------------


def _visible_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows by internal names: ``conv`` is a struct, so a null id is a key like any other."""
    at = F.col(turn).cast("bigint")
    read = rows.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),
        F.coalesce(F.floor(at / F.lit(BLOCK_TURNS)).cast("bigint"), F.lit(-(1 << 62))).alias("block"),
        at.alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return read.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbol() -> Column:
    first = F.substring("role", 1, 1)
    role = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~F.col("text").rlike(_VISIBLE), BLANK).when(ended, role).otherwise(F.upper(role))


def _narrow_blocks(rows: DataFrame) -> DataFrame:
    """One row per (conversation, block): its rows in order, texts as digests."""
    row = F.struct("turn", "role", "digest", _symbol().alias("symbol"))
    return rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _seen_before(blocks: DataFrame) -> DataFrame:
    """Keys of rows that an earlier block of the same conversation holds, per later block.

    Only conversations of several blocks take part.
    """
    several = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv")
    keys = blocks.join(several, "conv").select("conv", "block", F.explode(F.expr(
        "array_distinct(transform(rows, r -> concat(CAST(r.role AS BINARY), r.digest)))"
    )).alias("key"))
    first = keys.groupBy("conv", "key").agg(F.min("block").alias("_first"), F.max("block").alias("_last"))
    again = keys.join(first.where("_first < _last"), ["conv", "key"]).where("block > _first")
    return again.groupBy("conv", "block").agg(F.collect_list("key").alias("seen"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and counts of each block."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _MARKED}
        for row in batch.select(["rows", "seen"]).to_pylist():
            seen, signature, initials, turns = set(row["seen"] or ()), [], [], set()
            for r in row["rows"]:
                key = r["role"].encode() + r["digest"]
                signature.append(DUPLICATE if r["symbol"] != BLANK and key in seen else r["symbol"])
                seen.add(key)
                initials.append(r["role"][:1])
                turns.add(r["turn"])
            turns.discard(None)
            pairs = zip(initials, initials[1:], strict=False)
            out["signature"].append("".join(signature))
            out["blank"].append(signature.count(BLANK))
            out["duplicate"].append(signature.count(DUPLICATE))
            out["truncated"].append(sum(s.isupper() for s in signature))
            out["illegal"].append(sum(a + b not in LEGAL for a, b in pairs))
            out["opens"].append(initials[0])
            out["closes"].append(initials[-1])
            out["low"].append(min(turns, default=None))
            out["high"].append(max(turns, default=None))
            out["turns"].append(len(turns))
        made = [pa.array(out[f.name], f.type) for f in _MARKED]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), *made], ["conv", "block", *out]
        )


_MARKED = [
    pa.field("signature", pa.string()), *[pa.field(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
    pa.field("opens", pa.string()), pa.field("closes", pa.string()),
    *[pa.field(c, pa.int64()) for c in ("low", "high", "turns")],
]
_MARKED_DDL = (
    "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, opens string, closes string, "
    "low bigint, high bigint, turns bigint"
)


# -- what follows a block, and the state it is entered in ------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.matrix(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "matrix"])


def _relative(costs: list[int]) -> tuple[int, ...]:
    """Costs to go less their least: equal decisions share a node whatever the length behind."""
    return tuple(c - min(costs) for c in costs)


def _follow(table: pa.Table) -> pa.Table:
    """Costs to go after each block of one conversation, from its last block backwards."""
    table = table.sort_by("block")
    automaton = Automaton()
    go = list(automaton.costs[automaton.root(None)])
    after: list[tuple[int, ...] | None] = [None]
    for m in reversed(table.column("matrix").to_pylist()):
        go = [min(m[4 * i + j] + go[j] for j in range(4)) for i in range(4)]
        after.append(_relative(go))
    return table.drop(["matrix"]).append_column("after", pa.array(after[:-1][::-1], pa.list_(pa.int64())))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        exits = [
            [automaton.walk(s, None if a is None else tuple(a), state)[2] for state in range(4)]
            for s, a in zip(batch.column("signature").to_pylist(), batch.column("after").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv", "block", "after")], pa.array(exits, pa.list_(pa.int64()))],
            ["conv", "block", "after", "exits"],
        )


def _enter(table: pa.Table) -> pa.Table:
    """State in which each block of one conversation is entered."""
    table = table.sort_by("block")
    state, entered = 0, []
    for exits in table.column("exits").to_pylist():
        entered.append(state)
        state = exits[state]
    return table.drop(["exits"]).append_column("entry", pa.array(entered, pa.int64()))


def _contexts(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, block, after, entry) of the blocks of conversations that have several."""
    conv = marked.schema["conv"].dataType.simpleString()
    several = marked.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv")
    blocks = marked.select("conv", "block", "signature").join(several, "conv")
    key = f"conv {conv}, block bigint"
    matrices = blocks.mapInArrow(_matrices, f"{key}, signature string, matrix array<bigint>")
    followed = scratch.stage(
        matrices.groupBy("conv").applyInArrow(_follow, f"{key}, signature string, after array<bigint>"), "repair-after"
    )
    exits = followed.mapInArrow(_exits, f"{key}, after array<bigint>, exits array<bigint>")
    return exits.groupBy("conv").applyInArrow(_enter, f"{key}, after array<bigint>, entry bigint")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each distinct (signature, what follows, state entered)."""
    automaton = Automaton()
    for batch in batches:
        audits, costs, places, roles = [], [], [], []
        for row in batch.to_pylist():
            after = None if row["after"] is None else tuple(row["after"])
            edits, made, left = automaton.walk(row["signature"], after, row["entry"])
            start = automaton.costs[automaton.path(row["signature"], after)[0]][row["entry"]]
            audits.append(edits)
            costs.append(start - (0 if after is None else after[left]))
            places.append([p for p, _ in made])
            roles.append([r for _, r in made])
        made = [pa.array(audits), pa.array(costs), pa.array(places, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "audit", "cost", "places", "roles"])


# -- operator --------------------------------------------------------------------------------


def plan_repairs(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Cheapest edits of every block: conv, block, audit, cost, places, roles and the counts of ``_mark``.

    ``places`` and ``roles`` are the rows that result: position in the block (-1 inserted) and
    the role it is given (null: its own).
    """
    scratch = scratch or Scratch()
    blocks = scratch.stage(_narrow_blocks(_visible_rows(rows, conv, turn, role, text)), "repair-blocks")
    kind = blocks.schema["conv"].dataType.simpleString()
    both = blocks.join(_seen_before(blocks), ["conv", "block"], "left").select("conv", "block", "rows", "seen")
    marked = scratch.stage(both.mapInArrow(_mark, f"conv {kind}, block bigint, {_MARKED_DDL}"), "repair-marked")
    placed = marked.join(_contexts(marked, scratch), ["conv", "block"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(0).cast("bigint"))
    )
    # one row per distinct run; runs with a common end are solved in one task and share nodes
    keys = ["signature", "entry", "after"]
    distinct = placed.select(*keys).distinct().repartition(F.substring("signature", -SHARED_SUFFIX, SHARED_SUFFIX))
    solved = distinct.mapInArrow(
        _solve,
        "signature string, entry bigint, after array<bigint>, audit string, cost bigint, places array<int>, roles array<string>",
    )
    nothing = F.array().cast("array<bigint>")  # a null is no join key
    found = placed.withColumn("after", F.coalesce("after", nothing)).join(
        solved.withColumn("after", F.coalesce("after", nothing)), keys
    )
    return found.drop(*keys)


def repaired_blocks(
    rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``plans`` with ``repaired``, the resulting (role, text) rows of each block in order."""
    row = F.struct("turn", "role", "digest", "text")
    texts = _visible_rows(rows, conv, turn, role, text).groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    made = F.transform(
        F.arrays_zip("places", "roles"),
        lambda p: F.when(p["places"] < 0, F.struct(p["roles"].alias("role"), F.lit("").alias("text"))).otherwise(
            F.struct(
                F.coalesce(p["roles"], F.get(F.col("rows"), p["places"])["role"]).alias("role"),
                F.get(F.col("rows"), p["places"])["text"].alias("text"),
            )
        ),
    )
    return texts.join(plans, ["conv", "block"]).withColumn("repaired", made).drop("rows", "places", "roles")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired rows: conversation id, block and place (their order), role, text."""
    names = {"conv": conv, "turn": turn, "role": role, "text": text}
    blocks = repaired_blocks(rows, plan_repairs(rows, **names), **names)
    return blocks.select(
        F.col("conv.id").alias(conv), "block", F.posexplode("repaired").alias("place", "_row")
    ).select(conv, "block", "place", F.col("_row.role").alias(role), F.col("_row.text").alias(text))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


class _Chain:
    """Counts, audit and digest of one conversation, block after block."""

    def __init__(self, conv: dict) -> None:
        self.conv, self.counts, self.audit = conv, dict.fromkeys(_COUNTS, 0), []
        self.turns, self.lows, self.highs, self.closes = 0, [], [], None
        self.digest, self.begun = hashlib.sha256(), False

    def take(self, row: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += row[c]
        if self.closes is not None:
            self.counts["illegal"] += self.closes + row["opens"] not in LEGAL
        self.closes = row["closes"]
        if row["turns"]:
            self.turns += row["turns"]
            self.lows, self.highs = [min([*self.lows, row["low"]])], [max([*self.highs, row["high"]])]
        self.audit.append(row["audit"])
        if row["body"] is not None:
            self.digest.update((b"\n" if self.begun else b"") + row["body"].encode())
            self.begun = True

    def close(self) -> tuple:
        gaps = self.highs[0] - self.lows[0] + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), "".join(self.audit), self.digest.hexdigest())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one row per conversation; a conversation's text is never held."""
    chain, kind = None, None

    def table(done: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * (1 + len(_COUNTS)), pa.string(), pa.string()]
        names = ["conv", "gaps", *_COUNTS, "audit", "repaired_sha256"]
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        kind, done = batch.schema.field("conv").type, []
        for row in batch.to_pylist():
            if chain is None or row["conv"] != chain.conv:
                if chain is not None:
                    done.append(chain.close())
                chain = _Chain(row["conv"])
            chain.take(row)
        if done:
            yield table(done)
    if chain is not None:
        yield table([chain.close()])


def conversation_digests(blocks: DataFrame) -> DataFrame:
    """Counts, audit and SHA-256 of the repaired text of each conversation, from ``repaired_blocks``.

    A digest of a text is one chain, so the blocks of a conversation pass through one task,
    one at a time; the rows behind them were repaired in parallel.
    """
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    body = F.when(F.size("repaired") > 0, F.array_join(line, "\n"))
    kind = blocks.schema["conv"].dataType.simpleString()
    columns = ["conv", "block", *_COUNTS, "opens", "closes", "low", "high", "turns", "audit"]
    placed = blocks.select(*columns, body.alias("body")).repartition("conv").sortWithinPartitions("conv", "block")
    counts = ", ".join(f"{c} bigint" for c in ("gaps", *_COUNTS))
    return placed.mapInArrow(_digest, f"conv {kind}, {counts}, audit string, repaired_sha256 string")
