"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Every kind is found left to right without overlap.  Positions are code points, the end is
exclusive.  DataFrame expressions only, and no shuffle: each text is read where it lies.

The patterns are possessive and start only where an earlier start could not match, so long
runs of digits or address characters cost linear time and no regular-expression stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
BEFORE, AFTER = 40, 20
CONTEXT_BONUS = 0.3
_BLOCK = 64


def _start(chars: str) -> str:
    """At the end of the last match, or where no character of the run stands before."""
    return rf"(?:\G|(?<!{chars}))"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Luhn checksum of a non-empty digit string."""

    def add(total: Column, digit: Column, place: Column) -> Column:
        twice = digit * 2
        return total + F.when(place % 2 == 0, digit).otherwise(twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0)))

    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("place"))
    return F.aggregate(
        _chars(F.reverse(digits)),
        state,
        lambda s, c: F.struct(add(s["sum"], c.cast("int"), s["place"]).alias("sum"), (s["place"] + 1).alias("place")),
        lambda s: s["sum"] % 10 == 0,
    )


def mod97(account: Column) -> Column:
    """ISO 7064 mod-97 check of an account number: letters count 10 to 35."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(_chars(moved), F.lit(0), step) == 1


def _octets(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def _card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(12, 19) & luhn(d)


def _social(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that every text with a match passes; ``added`` kinds need ``floor``."""

    name: str
    pattern: str
    hint: str
    check: object
    prior: float
    words: str
    added: bool = False


# base kinds come first, in the order in which equal starts are listed
KINDS = (
    Kind("email", rf"{_start(_LOCAL)}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True),
         0.9, "mail|contact|write"),
    Kind("ip", rf"{_start('[0-9]')}[0-9]++(?:\.[0-9]++){{3}}", ".", _octets, 0.6, "ip|host|server|address|login"),
    Kind("card", rf"{_start('[0-9]')}[0-9](?:[\x20-]?[0-9]){{11,}}+", "", _card, 0.8, "card|visa|credit|pay|debit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda v: F.length(_digits(v)).between(9, 15),
         0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", "", mod97,
         0.9, "iban|account|bank|konto", added=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", _social,
         0.4, "ssn|social|security", added=True),
)
BASE_KINDS = tuple(k.name for k in KINDS if not k.added)
FLOOR = 0.6

_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,score:double>"


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """Confirmed spans of one kind in ``text``."""
    none = F.array().cast(f"array<{_SPAN}>")

    def place(found: Column) -> Column:
        # text before, match, text after; the text behind the last match has no match of its own
        pieces = F.filter(
            F.zip_with(
                F.zip_with(found["hits"], found["gaps"], lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))),
                F.slice(found["gaps"], F.lit(2), F.size(found["gaps"])),
                lambda x, after: F.struct(
                    x["hit"].alias("hit"),
                    F.length(x["gap"]).cast("bigint").alias("skip"),
                    F.lower(
                        F.concat(F.right(x["gap"], F.lit(BEFORE)), F.lit(" "), F.left(F.coalesce(after, F.lit("")), F.lit(AFTER)))
                    ).alias("near"),
                ),
            ),
            lambda x: x["hit"].isNotNull(),
        )
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,hit:string,near:string>>").alias("out"))

        def walk(state: Column, x: Column) -> Column:
            begin = state["at"] + x["skip"]
            row = F.struct(begin.alias("start"), x["hit"].alias("hit"), x["near"].alias("near"))
            return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

        # blocks of matches keep the copying of growing arrays short
        outer = F.struct(
            F.lit(0).cast("bigint").alias("at"),
            F.array().cast("array<array<struct<start:bigint,hit:string,near:string>>>").alias("out"),
        )

        def block(state: Column, part: Column) -> Column:
            inner = F.aggregate(part, F.struct(state["at"].alias("at"), start["out"].alias("out")), walk)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

        blocks = let(
            pieces,
            lambda p: F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(_BLOCK)), lambda b: F.slice(p, b, F.lit(_BLOCK))
            ),
        )
        return F.flatten(F.aggregate(blocks, outer, block)["out"])

    found = F.struct(
        F.split(text, kind.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
    )
    checked = F.filter(let(found, place), lambda x: kind.check(x["hit"]))
    scored = F.transform(
        checked,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("kind"),
            (x["start"] + F.length(x["hit"])).alias("end"),
            x["hit"].alias("value"),
            F.least(
                F.lit(1.0),
                F.lit(kind.prior) + F.when(x["near"].rlike(kind.words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)),
            ).alias("score"),
        ).cast(_SPAN),
    )
    if kind.added:
        scored = F.filter(scored, lambda x: x["score"] >= FLOOR)
    hint = text.contains(kind.hint) if kind.hint else text.rlike(kind.pattern)
    return F.when(hint & text.rlike("[0-9@]"), scored).otherwise(none)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with its personal-data spans in ``out``, by start and then kind.

    Each span is (start, kind, end, value, score); ``kind`` indexes ``KINDS``.  Base kinds
    stay whatever their score, added kinds need ``FLOOR``.  Null and empty texts have no
    spans; a column named ``out`` is replaced; repeated rows get the same spans each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(body, i, kind) for i, kind in enumerate(KINDS)])
    return df.withColumn(out, F.array_sort(found))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS))


def count_kind(spans: Column, name: str) -> Column:
    number = [k.name for k in KINDS].index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def redact(df: DataFrame, text: str = "text", pii: str = "pii", out: str = "redacted") -> DataFrame:
    """``df`` with every span's characters replaced by ``[KIND]``; overlapping spans by the first."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substr(body, state["at"].cast("int") + 1, (s["start"] - state["at"]).cast("int"))
        grown = F.struct(s["end"].alias("at"), F.concat(state["out"], kept, names[s["kind"]]).alias("out"))
        return F.when(s["start"] >= state["at"], grown).otherwise(state)

    rest = F.aggregate(
        F.col(pii), start, step, lambda s: F.concat(s["out"], F.substr(body, s["at"].cast("int") + 1))
    )
    return df.withColumn(out, rest)
