"""Typed reads of live events, snapshots, fixtures, filings and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritymill.fixed import PRICE, QTY, REPORT_INPUT_KINDS, SOURCE_CONTENT_FIELDS, SUMMARY_STATUSES
from paritymill.functions.columns import aware_timestamp, decimal_from_text, flags
from paritymill.functions.safety import json_keys, secret_keys
from paritymill.operators.books import book_errors, level, normalize_yes_no, sort_levels
from paritymill.schemas import (
    BOOK_FIELDS,
    BOOKS_FIXTURE,
    COMPANY_FACTS,
    CONCEPT,
    LIVE_EVENT,
    MANIFEST,
    SCENARIO_FIELDS,
    SNAPSHOT,
)
from paritymill.sources.jsonl import read_jsonl, write_jsonl

LIVE_SOURCES = ("mock_websocket", "kalshi_demo_rest", "polymarket_us_market_channel")
SNAPSHOT_SOURCES = ("fixture", "rest", "manual")


def _absent(*names: str) -> list[tuple[Column, str]]:
    return [(F.coalesce(F.col(n), F.lit("")) == "", f"{n}_required") for n in names]


def validate_live_events(df: DataFrame) -> DataFrame:
    """Clocks as timestamps, and an ``errors`` array for everything a record lacks."""
    typed = df.withColumns(
        {"observed_at": aware_timestamp(F.col("observed_at")), "received_at": aware_timestamp(F.col("received_at"))}
    )
    return typed.withColumn(
        "errors",
        flags(
            (~F.col("schema_version").eqNullSafe(1), "schema_version_unsupported"),
            *_absent("venue", "channel", "market_id", "event_type"),
            (~F.coalesce(F.col("sequence") > 0, F.lit(False)), "sequence_not_positive"),
            (F.col("observed_at").isNull(), "observed_at_not_aware"),
            (F.col("received_at").isNull(), "received_at_not_aware"),
            (~F.coalesce(F.col("source_type").isin(*LIVE_SOURCES), F.lit(False)), "source_type_unsupported"),
            (F.col("payload").isNull(), "payload_required"),
            (F.coalesce(F.size(secret_keys(F.col("payload"))) > 0, F.lit(False)), "secret_like_payload"),
        ),
    )


def read_live_events(spark: SparkSession, paths: str | Sequence[str], mode: str = "strict") -> DataFrame:
    """Live events with ``errors``; strict mode fails on malformed lines."""
    records, _ = read_jsonl(spark, paths, LIVE_EVENT, mode)
    return validate_live_events(records)


def validate_snapshots(df: DataFrame) -> DataFrame:
    """Flat snapshot rows with typed, sorted ladders and an ``errors`` array."""
    book = F.col("normalized_orderbook")

    def side(name: str) -> Column:
        return F.transform(
            F.coalesce(book[name], F.array().cast("array<struct<price: string, quantity: string>>")),
            lambda x: level(decimal_from_text(x["price"], PRICE), decimal_from_text(x["quantity"], QTY)),
        )

    typed = df.withColumns(
        {
            "observed_at": aware_timestamp(F.col("observed_at")),
            "recorded_at": aware_timestamp(F.col("recorded_at")),
            "instrument_id": book["instrument_id"],
            "source": book["source"],
            "bids": sort_levels(side("bids"), True),
            "asks": sort_levels(side("asks"), False),
        }
    )
    own = flags(
        (~F.col("schema_version").eqNullSafe(1), "schema_version_unsupported"),
        *_absent("exchange", "ticker", "instrument_id"),
        (F.col("observed_at").isNull(), "observed_at_not_aware"),
        (F.col("recorded_at").isNull(), "recorded_at_not_aware"),
        (~F.coalesce(F.col("source_type").isin(*SNAPSHOT_SOURCES), F.lit(False)), "source_type_unsupported"),
        (F.coalesce(F.size(secret_keys(F.col("raw_payload"))) > 0, F.lit(False)), "secret_like_payload"),
    )
    return typed.withColumn("errors", F.concat(own, book_errors(F.col("bids"), F.col("asks")))).drop(
        "normalized_orderbook"
    )


def read_snapshots(spark: SparkSession, paths: str | Sequence[str], mode: str = "strict") -> DataFrame:
    records, _ = read_jsonl(spark, paths, SNAPSHOT, mode)
    return validate_snapshots(records)


def snapshot_records(df: DataFrame) -> DataFrame:
    """Snapshot rows in the recorded shape, ladders as text."""
    text = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    side = lambda n: F.transform(
        n, lambda x: F.struct(text(x["price"]).alias("price"), text(x["quantity"]).alias("quantity"))
    )
    pick = lambda n, k: F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n)
    return df.select(
        F.lit(1).alias("schema_version"), "exchange", "ticker", "observed_at", "recorded_at", "source_type",
        F.struct(
            side("asks").alias("asks"), side("bids").alias("bids"), F.col("instrument_id"), F.col("source")
        ).alias("normalized_orderbook"),
        pick("raw_payload", "string"), pick("notes", "string"), pick("tags", "array<string>"),
    )


def write_snapshots(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_jsonl(snapshot_records(df), path, mode)


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole JSON documents, one row per file."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(listed, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("document")
    )


_DEFAULTED = (
    "fee_status", "fee_per_contract", "fee_source_note", "estimated_slippage_per_contract",
    "failed_leg_reserve_per_contract", "minimum_net_edge_per_contract",
)
_AMOUNTS = {
    "best_yes_bid": PRICE, "best_no_bid": PRICE, "yes_bid_size": QTY, "no_bid_size": QTY,
    "fee_per_contract": PRICE, "estimated_slippage_per_contract": PRICE,
    "failed_leg_reserve_per_contract": PRICE, "minimum_net_edge_per_contract": PRICE,
}


def books_from_documents(df: DataFrame, document: str = "document") -> DataFrame:
    """Top-of-book rows of fixture documents: an object with markets or books, or a bare list.

    Any other document fails the read.
    Top-level fee and edge fields are defaults for each row.  ``sequence`` counts from one.
    """
    text = F.col(document)
    bare = F.trim(text).startswith("[")
    parsed = df.withColumns(
        {
            "_d": F.when(~bare, F.from_json(text, BOOKS_FIXTURE)),
            "_l": F.when(bare, F.from_json(text, f"array<struct<{BOOK_FIELDS}>>")),
        }
    )
    kind = parsed.schema["_l"].dataType.simpleString()
    refused = F.raise_error(F.concat(F.lit("document without markets or books: "), F.substring(text, 1, 80))).cast(kind)
    rows = parsed.select(
        *[c for c in df.columns if c != document], "_d",
        F.posexplode(F.coalesce("_d.markets", "_d.books", "_l", refused)).alias("_i", "_b"),
    )
    given = [f.split(":")[0].strip() for f in BOOK_FIELDS.replace("array<string>", "array").split(", ")]
    filled = {
        f: F.coalesce(F.col(f"_b.{f}"), F.col(f"_d.{f}")) if f in _DEFAULTED else F.col(f"_b.{f}") for f in given
    }
    typed = {f: decimal_from_text(c, _AMOUNTS[f]) if f in _AMOUNTS else c for f, c in filled.items()}
    path = F.col("source_path") if "source_path" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in (document, "source_path")]
    return rows.select(
        *kept,
        F.coalesce("_d.source", path).alias("source"),
        (F.col("_i") + 1).cast("bigint").alias("sequence"),
        *[c.alias(f) for f, c in typed.items()],
    )


def read_books_fixture(spark: SparkSession, path: str) -> DataFrame:
    return books_from_documents(read_documents(spark, path))


def scenarios_from_documents(df: DataFrame, document: str = "document") -> DataFrame:
    """Scenario rows of an object with ``scenarios``, or of a single scenario object."""
    text = F.col(document)
    many = F.from_json(text, f"struct<scenarios: array<struct<{SCENARIO_FIELDS}>>>")["scenarios"]
    one = F.array(F.from_json(text, f"struct<{SCENARIO_FIELDS}>"))
    rows = df.select(
        *[c for c in df.columns if c != document], F.posexplode(F.coalesce(many, one)).alias("_i", "_s")
    )
    amounts = {
        **_AMOUNTS, "target_size": QTY, "yes_available_size": QTY, "no_available_size": QTY,
        "yes_slippage_per_contract": PRICE, "no_slippage_per_contract": PRICE, "latency_shock_per_contract": PRICE,
    }
    names = [f.split(":")[0].strip() for f in SCENARIO_FIELDS.replace("array<string>", "array").split(", ")]
    return rows.select(
        *[c for c in df.columns if c != document],
        (F.col("_i") + 1).cast("bigint").alias("sequence"),
        *[
            (decimal_from_text(F.col(f"_s.{n}"), amounts[n]) if n in amounts else F.col(f"_s.{n}")).alias(n)
            for n in names
        ],
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return scenarios_from_documents(read_documents(spark, path))


def explode_pages(pages: DataFrame, document: str, item: str) -> DataFrame:
    """Items of paged list documents; a page whose list is not a list fails the read."""
    text = F.get_json_object(document, f"$.{item}")
    kept = [c for c in pages.columns if c != document]
    listed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    refused = F.raise_error(F.concat(F.lit(f"page without a list of {item}: "), F.substring(document, 1, 80)))
    return pages.select(*kept, F.explode(F.coalesce(listed, refused.cast("array<string>"))).alias("item"))


_FACT_VALUE = "decimal(38,12)"


def _exact(value: Column, kind: str) -> Column:
    """Value of a JSON number's text; null stays null, anything that would be rounded or lost raises."""
    text = value.cast("string")
    number = text.try_cast(kind)
    places = int(kind.rstrip(")").split(",")[1]) if "," in kind else 0
    lossless = number.isNotNull() & ~text.rlike(rf"\.\d{{{places}}}\d*[1-9]")
    refused = F.raise_error(F.concat(F.lit("fact value out of range: "), text)).cast(kind)
    return F.when(text.isNotNull(), F.when(lossless, number).otherwise(refused))


def flatten_company_facts(df: DataFrame, document: str = "document") -> DataFrame:
    """One row per reported fact of company-facts documents.

    Parsed level by level, so a taxonomy or concept of the wrong shape is skipped without
    losing the document.  cik is padded to ten digits; a concept without label names itself.
    """
    parsed = df.select(F.from_json(document, COMPANY_FACTS).alias("_d"), F.col(document).alias("_t"))
    malformed = F.raise_error(F.concat(F.lit("document without facts: "), F.substring("_t", 1, 80))).cast("boolean")
    top = parsed.where(F.when(F.col("_d.facts").isNotNull(), F.lit(True)).otherwise(malformed))
    taxonomies = top.select(
        F.lpad("_d.cik", 10, "0").alias("cik"), F.col("_d.entityName").alias("entity_name"),
        F.explode("_d.facts").alias("taxonomy", "_concepts"),
    ).where(F.col("_concepts").startswith("{"))
    concepts = taxonomies.select(
        "cik", "entity_name", "taxonomy",
        F.explode(F.from_json("_concepts", "map<string, string>")).alias("concept", "_body"),
    ).where(F.col("_body").startswith("{"))
    bodies = concepts.withColumn("_c", F.from_json("_body", CONCEPT))
    kind = bodies.schema["_c"].dataType["units"].dataType.simpleString()
    refused = F.raise_error(F.concat(F.lit("concept without units: "), F.col("concept"))).cast(kind)
    units = bodies.select(
        "cik", "entity_name", "taxonomy", "concept", F.coalesce("_c.label", "concept").alias("label"),
        F.explode(F.coalesce(F.col("_c.units"), refused)).alias("unit", "_facts"),
    )
    return units.select("*", F.explode("_facts").alias("_f")).select(
        "cik", "entity_name", "taxonomy", "concept", "label", "unit",
        _exact(F.col("_f.val"), _FACT_VALUE).alias("value"),
        _exact(F.col("_f.fy"), "int").alias("fiscal_year"),
        F.col("_f.fp").alias("fiscal_period"), F.col("_f.form").alias("form"), F.col("_f.filed").alias("filed"),
        F.col("_f.end").alias("end_date"), F.col("_f.accn").alias("accession_number"),
    )


def manifest_entries(df: DataFrame, document: str = "document") -> DataFrame:
    """Entries of report-input manifests, with what makes an entry unusable."""
    rows = df.select(
        *[c for c in df.columns if c != document],
        F.posexplode(F.from_json(document, MANIFEST)["inputs"]).alias("_i", "_e"),
    ).select(*[c for c in df.columns if c != document], (F.col("_i") + 1).alias("entry_index"), "_e.*")
    remote = F.col("local_path").rlike(r"^([a-zA-Z][a-zA-Z0-9+.\-]*:|//)")
    return rows.withColumn(
        "errors",
        flags(
            *[
                (F.col(c).isNull(), f"{c}_missing")
                for c in ("local_path", "input_kind", "display_label", "rights_note", "assumption_scope", "required")
            ],
            (F.coalesce(remote, F.lit(False)), "remote_url"),
            (~F.coalesce(F.col("input_kind").isin(*REPORT_INPUT_KINDS), F.lit(False)), "unknown_input_kind"),
        ),
    )


def manifest_coverage(manifest: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Entries by input kind: found with their row count, missing optional, missing required.

    ``descriptors``: local_path and row content, many rows per path.  They are counted per
    path before the join, so one large descriptor is one joined row.
    """
    rows = descriptors.groupBy("local_path").agg(F.count(F.lit(1)).alias("_rows"))
    joined = manifest.join(rows, "local_path", "left")
    found = F.col("_rows").isNotNull()
    return joined.groupBy("input_kind").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(found).alias("found_count"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("descriptor_row_count"),
        F.count_if(~found & ~F.col("required")).alias("missing_optional_count"),
        F.count_if(~found & F.col("required")).alias("missing_required_count"),
    )


def validate_descriptor_rows(df: DataFrame, required: Sequence[str], row_json: str = "row_json") -> DataFrame:
    """Errors of descriptor rows: missing fields, bad status, copied source content, secrets."""
    keys = json_keys(F.col(row_json))
    return df.withColumn(
        "errors",
        flags(
            *[(~F.array_contains(keys, F.lit(c)), f"{c}_missing") for c in required],
            (
                F.array_contains(keys, F.lit("status"))
                & ~F.coalesce(F.get_json_object(row_json, "$.status").isin(*SUMMARY_STATUSES), F.lit(False)),
                "status_unsupported",
            ),
            (F.arrays_overlap(keys, F.array(*[F.lit(c) for c in SOURCE_CONTENT_FIELDS])), "source_content_field"),
            (F.size(secret_keys(F.col(row_json))) > 0, "secret_like_field"),
        ),
    )


def fixture_snapshots(markets: DataFrame, books: DataFrame, observed_at: str, recorded_at: str) -> DataFrame:
    """Snapshots of fixture books under their market's ticker.

    ``markets``: fixture_id, ticker.  ``books``: fixture_id, payload.
    """
    named = books.join(markets.select("fixture_id", "ticker"), "fixture_id")
    return normalize_yes_no(named).select(
        F.lit("kalshi_demo").alias("exchange"), "ticker",
        F.lit(observed_at).cast("timestamp").alias("observed_at"),
        F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
        F.lit("fixture").alias("source_type"),
        F.col("ticker").alias("instrument_id"), "source", "bids", "asks", "errors",
        F.col("payload").alias("raw_payload"),
    )
