"""Native WebSocket envelopes: coherent routing fields, identifiers, pricing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import ACK_TYPES, ORDERBOOK_TYPES


def _get(v: Column, path: str) -> Column:
    return F.variant_get(v, f"$.{path}", "variant")


def _tag(v: Column) -> Column:
    """JSON type of a value: STRING, BIGINT, BOOLEAN, VOID, ..."""
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def native_envelope(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Routing fields found at the top or in ``msg``, with provenance and a typed rejection.

    A field given twice must agree in type and value; nothing takes silent precedence.
    Adds native_type, channel, request_id, sid (text), request_id_is_int,
    envelope_rejection and provenance (struct).
    """
    v = df.withColumn("_v", F.try_parse_json(payload))
    keys = ("type", "channel", "id", "sid")
    parts = {}
    for k in keys:
        parts[f"_t_{k}"] = _get(F.col("_v"), k)
        parts[f"_n_{k}"] = F.when(_tag(_get(F.col("_v"), "msg")).startswith("OBJECT"), _get(F.col("_v"), f"msg.{k}"))
    v = v.withColumns(parts)
    fields = {}
    for k in keys:
        top, inner = F.col(f"_t_{k}"), F.col(f"_n_{k}")
        both = top.isNotNull() & inner.isNotNull()
        clash = both & ((_tag(top) != _tag(inner)) | ~_text(top).eqNullSafe(_text(inner)))
        value = F.coalesce(top, inner)
        wanted = ("STRING",) if k in ("type", "channel") else ("STRING", "BIGINT")
        empty = value.isNull() | (_tag(value) == "VOID")
        fields[f"_p_{k}"] = (
            F.when(clash, "conflicting")
            .when(both, "duplicate_equal")
            .when(top.isNotNull(), "top_level")
            .when(inner.isNotNull(), "nested_msg")
            .otherwise("missing")
        )
        bad = ~F.coalesce(_tag(value).isin(*wanted), F.lit(False))
        fields[f"_r_{k}"] = F.when(clash, f"CONFLICTING_NATIVE_{k.upper()}").when(
            ~empty & bad, f"INVALID_NATIVE_{k.upper()}"
        )
        fields[f"_v_{k}"] = F.when(~clash & ~empty & ~bad, _text(value))
        fields[f"_i_{k}"] = F.when(~clash & ~empty & ~bad, _tag(value) == "BIGINT")
    v = v.withColumns(fields)
    kind, named = F.col("_v_type"), F.col("_v_channel")
    derived = (
        F.when(kind.isin(*ORDERBOOK_TYPES), "orderbook_delta").when(kind == "trade", "trade").otherwise(
            F.coalesce(kind, F.lit("unknown"))
        )
    )
    v = v.withColumn("channel", F.coalesce(named, derived))
    first = F.coalesce(*[F.col(f"_r_{k}") for k in keys])
    first = F.coalesce(first, F.when(kind.isNull(), "MISSING_NATIVE_TYPE"))
    ack = kind.isin(*ACK_TYPES)
    data = kind.isin(*ORDERBOOK_TYPES, "trade")
    late = (
        F.when(ack & ((F.col("channel") == kind) | (F.col("channel") == "unknown")), "MISSING_ACK_CHANNEL")
        .when(ack & F.col("_v_id").isNull(), "MISSING_ACK_ID")
        .when(ack & F.col("_v_sid").isNull(), "MISSING_ACK_SID")
        .when(data & F.col("_v_sid").isNull(), "MISSING_DATA_SID")
    )
    channel_from = F.when(named.isNotNull(), F.col("_p_channel")).otherwise(
        F.when(kind.isNotNull(), "derived_from_type").otherwise("missing")
    )
    provenance = F.struct(
        channel_from.alias("channel"), F.col("_p_id").alias("id"), F.col("_p_sid").alias("sid"),
        F.col("_p_type").alias("type"),
    )
    return v.select(
        *df.columns,
        kind.alias("native_type"),
        "channel",
        F.col("_v_id").alias("request_id"),
        F.coalesce("_i_id", F.lit(False)).alias("request_id_is_int"),
        F.col("_v_sid").alias("sid"),
        F.coalesce(first, late).alias("envelope_rejection"),
        provenance.alias("provenance"),
    )


def native_scalar(payload: Column, *keys: str, kinds: tuple[str, ...] = ("STRING", "BIGINT")) -> Column:
    """First value of a wanted JSON type over (top, ``msg``) and then the keys."""
    v = F.try_parse_json(payload)
    found = []
    for prefix in ("", "msg."):
        for k in keys:
            x = _get(v, prefix + k)
            found.append(F.when(_tag(x).isin(*kinds), _text(x)))
    return F.coalesce(*found)


def pricing_values(payload: Column) -> Column:
    """JSON text of every ``use_yes_price`` in nested ``msg`` / ``params`` at any depth, outer ones first.

    Each step takes the values of one level and goes on to the objects below it; a text has no
    more levels than opening braces, and a level without objects costs nothing.
    """
    levels = F.length(payload) - F.length(F.replace(payload, F.lit("{"), F.lit("")))
    start = F.struct(
        F.array(F.try_parse_json(payload)).alias("level"), F.array().cast("array<string>").alias("found")
    )

    def descend(s: Column, _: Column) -> Column:
        own = F.transform(s["level"], lambda v: F.to_json(_get(v, "use_yes_price")))
        below = F.flatten(F.transform(s["level"], lambda v: F.array(_get(v, "msg"), _get(v, "params"))))
        return F.struct(
            F.filter(below, lambda v: v.isNotNull()).alias("level"),
            F.concat(s["found"], F.array_compact(own)).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, descend)["found"]
