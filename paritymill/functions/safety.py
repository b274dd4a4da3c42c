"""Payload safety: forbidden keys at any depth, and redaction of secret values."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import (
    FORBIDDEN_KEY_PARTS,
    MONITOR_SECRET_PARTS,
    PRIVATE_ACCOUNT_KEYS,
    PRIVATE_ACCOUNT_PREFIXES,
    REDACTED,
)

# every JSON string token with the colon that makes it a key; values are consumed whole.
# possessive loops neither backtrack nor recurse, so a text of any length is fine
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf"({_STRING}\s*+:?)"


def _decoded(key: Column) -> Column:
    """Text of a quoted key; a key with escapes is decoded as JSON."""
    plain = F.regexp_extract(key, r'(?s)^"(.*)"$', 1)
    return F.when(key.contains("\\"), F.coalesce(F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>")[0], plain)).otherwise(plain)


def json_keys(payload: Column) -> Column:
    """Lower-cased keys of a JSON text at any depth, escapes decoded."""
    tokens = F.regexp_extract_all(payload, F.lit(_TOKEN), F.lit(1))
    named = F.filter(tokens, lambda t: t.endswith(":"))
    return F.transform(named, lambda t: F.lower(_decoded(F.regexp_replace(t, r"\s*:$", ""))))


def secret_keys(payload: Column, parts: Sequence[str] = FORBIDDEN_KEY_PARTS) -> Column:
    """Keys that contain a secret-like part."""
    pattern = "|".join(p.replace("-", r"\-") for p in parts)
    return F.filter(json_keys(payload), lambda k: k.rlike(pattern))


def private_keys(payload: Column) -> Column:
    """Keys that name private account data."""
    prefixes = "^(" + "|".join(PRIVATE_ACCOUNT_PREFIXES) + ")"
    return F.filter(
        json_keys(payload), lambda k: k.isin(*PRIVATE_ACCOUNT_KEYS) | k.rlike(prefixes)
    )


def payload_safety(df: DataFrame, payload: str) -> DataFrame:
    """Adds secret_keys, private_keys and payload_safe."""
    out = df.withColumns(
        {"secret_keys": secret_keys(F.col(payload)), "private_keys": private_keys(F.col(payload))}
    )
    safe = (F.size("secret_keys") == 0) & (F.size("private_keys") == 0)
    return out.withColumn("payload_safe", safe)


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)


def _mask(text: str, parts: Sequence[str]) -> str:
    """``text``, valid JSON, with the value of every secret key replaced; all other bytes stay."""
    out, kept, hide_from, depth, key = [], 0, None, 0, None
    for m in _TOKENS.finditer(text):
        token = m.group()
        if hide_from is not None:  # inside a secret value: a scalar ends at once, a nested one at its closing bracket
            depth += (token in "{[") - (token in "}]")
            if depth == 0:
                out += [text[kept:hide_from], f'"{REDACTED}"']
                kept, hide_from = m.end(), None
        elif token == ":" and key is not None and any(p in json.loads(key).lower() for p in parts):
            value = _TOKENS.search(text, m.end())
            hide_from, depth = value.start(), 0
        key = token if token[0] == '"' else None
    return "".join([*out, text[kept:]])


def redact_payload(df: DataFrame, payload: str, parts: Sequence[str] = MONITOR_SECRET_PARTS) -> DataFrame:
    """Replace the value of every key that contains a secret part, nested values included.

    ``payload`` holds valid JSON or null.  Only the values' own spans change: numbers, spacing and
    escapes elsewhere keep their bytes.  Rows without a secret key, or with scalar values only, stay
    in the JVM; the others go through an Arrow batch function.
    """
    words = "|".join(p.replace("-", r"\-") for p in parts)
    key = rf'"([^"\\]*(?:{words})[^"\\]*)"(\s*+:\s*+)'
    scalar = rf"(?:{_STRING}|-?\d[0-9.eE+\-]*+|true|false|null)"

    @F.pandas_udf("string")
    def nested(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _mask(t, parts))

    text = F.col(payload)
    # an escaped key, or one whose value is an object or a list
    deep = text.rlike(rf'(?i){key}[\[{{]') | text.rlike(rf'"[^"\\]*+\\(?:[^"\\]|\\.)*+"\s*+:')
    flat = F.regexp_replace(text, f"(?i){key}{scalar}", f'"$1"$2"{REDACTED}"')
    hidden = F.when(F.coalesce(deep, F.lit(False)), nested(F.when(deep, text))).otherwise(flat)
    return df.withColumn(payload, hidden)
