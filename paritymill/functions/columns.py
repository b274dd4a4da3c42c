"""Column helpers shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, STATUS_MAP

_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"
# shape and offset only; the timestamp parser judges the fields
_CLOCK = r"^\d{4}(-\d\d){2}T\d\d(:\d\d){2}(\.\d+)?"


def flags(*pairs: tuple[Column, str | Column]) -> Column:
    """Ordered labels of the conditions that hold."""
    return F.array_compact(
        F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in pairs])
    )


def has(array: Column, *labels: str) -> Column:
    """True when any of ``labels`` is in ``array`` (false for a null array)."""
    return F.coalesce(F.arrays_overlap(array, F.array(*[F.lit(x) for x in labels])), F.lit(False))


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Literal map lookup, null when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def dec(value: Column | str | int, kind: str = PRICE) -> Column:
    """Cast to a fixed decimal type; strings and ints become literals."""
    c = value if isinstance(value, Column) else F.lit(str(value))
    return c.cast(kind)


def decimal_from_text(text: Column, kind: str = PRICE) -> Column:
    """Exact decimal of a plain decimal string, null when it would have to be rounded."""
    scale = int(kind.rstrip(")").split(",")[1])
    ok = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$") & ~text.rlike(rf"\.\d{{{scale}}}\d*[1-9]\d*$")
    return F.when(ok, text.try_cast(kind))


def decimal_text(c: Column) -> Column:
    """Fixed-point text with trailing zeros trimmed; zero is ``0``."""
    text = c.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c.isNull(), F.lit(None)).when(c == 0, F.lit("0")).otherwise(trimmed)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls kept.  Pass decimals as text."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def record_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 hex of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def identifier_ok(c: Column) -> Column:
    """Non-empty text without whitespace, separators or control characters."""
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"[\p{C}\p{Z}\s]"), F.lit(False))


def market_identity(ticker: Column, market_ticker: Column) -> Column:
    """The one exact identity of a market, null when absent or contradictory."""
    usable = (ticker.isNotNull() | market_ticker.isNotNull()) & (
        (ticker.isNull() | identifier_ok(ticker))
        & (market_ticker.isNull() | identifier_ok(market_ticker))
        & (ticker.isNull() | market_ticker.isNull() | (ticker == market_ticker))
    )
    return F.when(usable, F.coalesce(ticker, market_ticker))


def aware_timestamp(text: Column) -> Column:
    """Timestamp of ISO text that carries an offset, else null."""
    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def rfc3339(text: Column) -> Column:
    """Timestamp of strict RFC 3339 text; the unknown offset ``-00:00`` is refused."""
    ok = text.rlike(_CLOCK + _OFFSET) & ~text.endswith("-00:00")
    return F.when(ok, F.try_to_timestamp(text))


def date_label(text: Column) -> Column:
    return F.to_date(F.substring(text, 1, 10))


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Signed seconds truncated toward zero."""
    micros = micros_between(later, earlier)
    return F.signum(micros).cast("bigint") * F.floor(F.abs(micros) / F.lit(1_000_000)).cast("bigint")


def age_seconds(later: Column, earlier: Column) -> Column:
    """Age in whole seconds, rounded up."""
    micros = micros_between(later, earlier)
    return F.ceil(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")


def seconds_decimal(micros: Column) -> Column:
    """Exact seconds of a microsecond count."""
    return (micros.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,6)")


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def first_nonzero(*columns: Column) -> Column:
    """First number that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("bigint")) for c in columns])


def normalized_status(status: Column) -> tuple[Column, Column]:
    """(raw status, normalized status): known words map, unknown words pass through."""
    raw = F.nullif(F.lower(F.trim(status)), F.lit(""))
    return raw, F.coalesce(lookup(STATUS_MAP, raw), raw)


def sorted_labels(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def clamp(c: Column, low: Column, high: Column) -> Column:
    """Bounded value; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def digest(text: Column) -> Column:
    """Sixteen bytes that stand for a text that is only compared with others; null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
