"""Market metadata: identity, enrichment, lifecycle selection and discovery audit."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritymill.fixed import (
    ACTIVITY_PATTERN,
    CANARY_SECONDS,
    CLOSED_OR_FINAL_STATUSES,
    MATCH_WORDS,
    NEAR_MISS_LIMIT,
    OCCURRENCE_TOLERANCE_SECONDS,
    OPEN_STATUSES,
    SAFETY_BUFFER_SECONDS,
    SEVEN_DAY_SECONDS,
    STATUS_REJECTIONS,
)
from paritymill.functions.columns import (
    first_filled,
    flags,
    identifier_ok,
    is_true,
    lookup,
    market_identity,
    normalized_status,
    rfc3339,
    whole_seconds,
)
from paritymill.functions.ordered import scan
from paritymill.session import stage

_TEXT = (
    "ticker", "market_ticker", "event_ticker", "title", "name", "status", "raw_status", "category",
    "event_category", "event_title", "event_subtitle", "event_type", "market_type", "open_time",
    "close_time", "expected_expiration_time", "expected_expiration", "early_close_deadline",
    "early_close_time", "early_close_condition_deadline", "occurrence_datetime", "occurrence_time",
    "can_close_early", "volume_24h_fp", "yes_bid_size_fp", "yes_ask_size_fp", "no_bid_size_fp",
    "no_ask_size_fp",
)
_BOOL = ("event_metadata_fetched", "early_close_deadline_authoritative", "orderbook_empty", "has_orderbook")


def with_market_columns(df: DataFrame) -> DataFrame:
    """Add the metadata columns a market table lacks as nulls."""
    add = {c: F.lit(None).cast("string") for c in _TEXT if c not in df.columns}
    add |= {c: F.lit(None).cast("boolean") for c in _BOOL if c not in df.columns}
    if "orderbook_level_count" not in df.columns:
        add["orderbook_level_count"] = F.lit(None).cast("bigint")
    return df.withColumns(add) if add else df


def normalize_status(df: DataFrame) -> DataFrame:
    """Normalized market status; the exchange's own word stays in ``raw_status``."""
    raw, normal = normalized_status(F.col("status"))
    return df.withColumns({"raw_status": raw, "status": normal})


def check_identity(df: DataFrame, expected: str | None = None) -> DataFrame:
    """The exact market identity, and why there is none."""
    ident = market_identity(F.col("ticker"), F.col("market_ticker"))
    none = F.col("ticker").isNull() & F.col("market_ticker").isNull()
    inexact = (F.col("ticker").isNotNull() & ~identifier_ok(F.col("ticker"))) | (
        F.col("market_ticker").isNotNull() & ~identifier_ok(F.col("market_ticker"))
    )
    reason = F.when(none, "identity_missing").when(inexact, "identity_not_exact").when(
        ident.isNull(), "aliases_differ"
    )
    if expected is not None:
        reason = reason.when(~ident.eqNullSafe(F.col(expected)), "unexpected_identity")
    return df.withColumns({"market_identity": ident, "identity_error": reason})


def dedupe_markets(df: DataFrame, order: str) -> DataFrame:
    """First market per identity; markets without one are all kept.

    The first row is picked by a combining aggregate, so copies of a hot identity shrink
    on the map side.
    """
    m = with_market_columns(df).withColumn("_id", market_identity(F.col("ticker"), F.col("market_ticker")))
    kept = m.where(F.col("_id").isNotNull()).groupBy("_id").agg(
        F.min_by(F.struct(*df.columns), order).alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    first = kept.select("_row.*", (F.col("_n") - 1).alias("duplicate_count"))
    loose = m.where(F.col("_id").isNull()).select(*df.columns, F.lit(0).cast("bigint").alias("duplicate_count"))
    return first.unionByName(loose)


def event_identity_ok() -> Column:
    """Whether an event row and the markets nested in it agree on its ticker."""
    own = identifier_ok(F.col("event_ticker"))
    nested = F.forall(
        "markets",
        lambda m: (m["event_ticker"].isNull() | (m["event_ticker"] == F.col("event_ticker")))
        & (
            (m["ticker"].isNull() & m["market_ticker"].isNull())
            | market_identity(m["ticker"], m["market_ticker"]).isNotNull()
        ),
    )
    return own & F.coalesce(nested, F.lit(True))


def enrich_events(markets: DataFrame, events: DataFrame, event_order: str) -> DataFrame:
    """Markets with the category and title of the last event row of their event ticker."""
    latest = events.where(identifier_ok(F.col("event_ticker"))).groupBy("event_ticker").agg(
        F.max_by(F.struct("category", "title", "sub_title"), event_order).alias("_event")
    )
    m = with_market_columns(markets)
    kept = [c for c in m.columns if c not in ("event_category", "event_title", "event_subtitle", "event_metadata_fetched")]
    joined = m.join(latest, "event_ticker", "left")
    filled = lambda c: F.coalesce(F.col(f"_event.{c}"), F.lit("")) != ""
    whole = filled("category") & filled("title")
    out = lambda c: F.when(whole, F.col(f"_event.{c}"))
    return joined.select(
        *kept,
        out("category").alias("event_category"),
        out("title").alias("event_title"),
        out("sub_title").alias("event_subtitle"),
        is_true(whole).alias("event_metadata_fetched"),
        F.when(~identifier_ok(F.col("event_ticker")), "INVALID_EVENT_IDENTITY")
        .when(F.col("_event").isNull(), "EVENT_METADATA_FETCH_FAILED")
        .when(~whole, "EVENT_METADATA_INCOMPLETE")
        .alias("event_reason"),
    )


def missing_events(markets: DataFrame, events: DataFrame) -> DataFrame:
    """Requested event tickers that no event row carries."""
    wanted = markets.where(F.col("event_ticker").isNotNull()).select("event_ticker").distinct()
    return wanted.join(events.select("event_ticker"), "event_ticker", "left_anti")


def activity_score() -> Column:
    """Positive 24-hour volume written as plain fixed-point text, else null."""
    text = F.col("volume_24h_fp")
    score = F.when(text.rlike(ACTIVITY_PATTERN), text.try_cast("decimal(38,18)"))
    return F.when(score > 0, score)


def quote_indicator() -> Column:
    """Whether any of the four quoted sizes is positive."""
    sizes = [
        F.coalesce(F.col(c).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))
        for c in ("yes_bid_size_fp", "yes_ask_size_fp", "no_bid_size_fp", "no_ask_size_fp")
    ]
    return F.greatest(*sizes) > 0


def is_sports() -> Column:
    words = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("event_category", "category")]
    return words[0].contains("sport") | words[1].contains("sport")


def is_match() -> Column:
    text = F.concat_ws(" ", *[F.col(c) for c in ("title", "event_title", "event_subtitle", "event_type", "market_type")])
    words = F.transform(
        F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
    )
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in MATCH_WORDS]))


def optional_bool(text: Column) -> Column:
    """Boolean of 1/true/yes and 0/false/no words, else null."""
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin("1", "true", "yes"), True).when(word.isin("0", "false", "no"), False)


def profile_of(duration_seconds: int) -> str:
    if duration_seconds == CANARY_SECONDS:
        return "canary"
    return "seven_day" if duration_seconds >= SEVEN_DAY_SECONDS else "smoke"


def profile_hash(profile: str, duration_seconds: int, buffer_seconds: int, version: str) -> str:
    """Hash that names a selection policy, for records of different runs to be compared."""
    strict = profile != "smoke"
    policy = {
        "version": version,
        "profile": profile,
        "duration_seconds": duration_seconds,
        "safety_buffer_seconds": buffer_seconds,
        "strict": strict,
    }
    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()


def select_markets(
    df: DataFrame,
    at: datetime,
    duration_seconds: int,
    profile: str | None = None,
    buffer_seconds: int | None = None,
    require_non_empty_orderbook: bool = True,
    require_event_metadata: bool = False,
    allow_sports_long_horizon: bool = False,
    policy_version: str = "1",
) -> DataFrame:
    """Lifecycle evidence, ordered rejection reasons and gate result of every market.

    A projection over metadata columns: markets are judged where they are read.
    """
    profile = profile or profile_of(duration_seconds)
    buffer_seconds = SAFETY_BUFFER_SECONDS[profile] if buffer_seconds is None else buffer_seconds
    strict = profile != "smoke"
    chosen = F.lit(at.isoformat()).cast("timestamp")
    end = F.lit((at + timedelta(seconds=duration_seconds + buffer_seconds)).isoformat()).cast("timestamp")
    skew = F.lit((at + timedelta(seconds=OCCURRENCE_TOLERANCE_SECONDS)).isoformat()).cast("timestamp")

    m = with_market_columns(df)
    occurrence_text = F.coalesce("occurrence_datetime", "occurrence_time")
    m = m.withColumns(
        {
            "market_identity": market_identity(F.col("ticker"), F.col("market_ticker")),
            "close_at": rfc3339(F.col("close_time")),
            "expiration_at": rfc3339(F.coalesce("expected_expiration_time", "expected_expiration")),
            "early_close_at": rfc3339(
                F.coalesce("early_close_deadline", "early_close_time", "early_close_condition_deadline")
            ),
            "occurrence_at": rfc3339(occurrence_text),
            "closes_early": optional_bool(F.col("can_close_early")),
            "sports": is_sports(),
            "match_like": is_match(),
            "current_quote": quote_indicator(),
            "activity": activity_score(),
            "_category": F.trim(F.coalesce(first_filled(F.col("event_category"), F.col("category")), F.lit(""))),
            "_status": F.lower(F.trim(F.coalesce("status", F.lit("")))),
        }
    )
    future = "SMOKE_UNINTERPRETED_OCCURRENCE" if not strict else "AMBIGUOUS_FUTURE_OCCURRENCE"
    semantics = F.when(occurrence_text.isNull(), "MISSING").when(F.col("occurrence_at").isNull(), "INVALID")
    if strict:
        semantics = semantics.when(F.col("occurrence_at") <= skew, "HISTORICAL_OR_ALREADY_OCCURRED")
    m = m.withColumn("occurrence_class", semantics.otherwise(future))
    m = m.withColumn(
        "occurrence_bound", F.when(F.col("occurrence_class") == future, F.col("occurrence_at"))
    )
    parts = ("close_at", "expiration_at", "early_close_at", "occurrence_bound")
    m = m.withColumn("lifecycle_deadline", F.least(*parts))
    source = F.coalesce(
        *[
            F.when(F.col(c) == F.col("lifecycle_deadline"), F.lit(n))
            for c, n in zip(
                parts,
                ("close_time", "expected_expiration_time", "early_close_deadline", "occurrence_safety_bound"),
                strict=True,
            )
        ]
    )
    late = lambda c: is_true(F.col(c) > end)
    authoritative = is_true(F.col("early_close_deadline_authoritative"))
    early_ok = authoritative & late("early_close_at")
    class_is = lambda v: F.col("occurrence_class") == v
    dual = (
        late("close_at")
        & late("expiration_at")
        & (class_is("MISSING") | (class_is("AMBIGUOUS_FUTURE_OCCURRENCE") & late("occurrence_at")))
        & (
            F.col("closes_early").eqNullSafe(False)
            | (F.col("closes_early").eqNullSafe(True) & ~class_is("MISSING") & early_ok)
        )
    )
    fetched = (
        is_true(F.col("event_metadata_fetched"))
        & (F.col("_category") != "")
        & (F.coalesce("event_title", F.lit("")) != "")
    )
    m = m.withColumns(
        {
            "lifecycle_deadline_source": source,
            "dual_interpretation_pass": dual if strict else F.lit(None).cast("boolean"),
            "_fetched": fetched,
        }
    )
    reasons = _rejections(
        profile, end, early_ok, require_non_empty_orderbook, require_event_metadata or strict,
        allow_sports_long_horizon,
    )
    m = m.withColumn("rejection_reasons", F.array_distinct(reasons))
    return m.withColumns(
        {
            "primary_rejection_reason": F.try_element_at("rejection_reasons", F.lit(1)),
            "selection_gate_result": F.when(F.size("rejection_reasons") == 0, "pass").otherwise("reject"),
            "selection_profile": F.lit(profile),
            "selection_profile_hash": F.lit(
                profile_hash(profile, duration_seconds, buffer_seconds, policy_version)
            ),
            "market_lifecycle_status": lifecycle_class(F.col("_status")),
            "seconds_to_close": whole_seconds(F.col("close_at"), chosen),
            "seconds_to_deadline": whole_seconds(F.col("lifecycle_deadline"), chosen),
            "lifecycle_margin_seconds": whole_seconds(F.col("lifecycle_deadline"), end),
            "close_margin_seconds": whole_seconds(F.col("close_at"), end),
            "expiration_margin_seconds": whole_seconds(F.col("expiration_at"), end),
            "occurrence_margin_seconds": whole_seconds(F.col("occurrence_bound"), end),
        }
    ).drop("_category", "_status", "_fetched")


def lifecycle_class(status: Column) -> Column:
    return (
        F.when(status.isin(*OPEN_STATUSES), "OPEN")
        .when(status.isin(*CLOSED_OR_FINAL_STATUSES), "CLOSED_OR_FINALIZED")
        .when(status == "paused", "PAUSED")
        .when(status == "unopened", "UNOPENED")
        .otherwise("UNKNOWN")
    )


def _rejections(
    profile: str, end: Column, early_ok: Column, need_book: bool, need_event: bool, allow_sports: bool
) -> Column:
    canary, strict, week = profile == "canary", profile != "smoke", profile == "seven_day"
    status, no = F.col("_status"), F.lit(False)
    early_label = "CAN_CLOSE_EARLY_UNSAFE_FOR_" + ("CANARY" if canary else "DURATION")
    closes = F.col("closes_early").eqNullSafe(True)
    klass, deadline = F.col("occurrence_class"), F.col("lifecycle_deadline")
    short = is_true(deadline <= end)
    only_close = (
        (F.col("close_at") == deadline) & F.col("expiration_at").isNull() & F.col("early_close_at").isNull()
    )
    deadline_label = (
        F.lit("CANARY_LIFECYCLE_DEADLINE_TOO_SHORT")
        if canary
        else F.when(is_true(only_close), "TIME_TO_CLOSE_TOO_SHORT").otherwise(
            "CONSERVATIVE_LIFECYCLE_DEADLINE_TOO_SHORT"
        )
    )
    empty_book = (
        is_true(F.col("orderbook_empty"))
        | F.col("has_orderbook").eqNullSafe(False)
        | is_true(F.col("orderbook_level_count") <= 0)
    )

    def when(applies: bool, condition: Column) -> Column:
        return condition if applies else no

    return flags(
        (F.col("market_identity").isNull(), "INVALID_MARKET_IDENTITY"),
        (~identifier_ok(F.col("event_ticker")), "INVALID_EVENT_IDENTITY"),
        (status == "", "MARKET_STATUS_UNKNOWN"),
        (
            (status != "") & ~status.isin(*OPEN_STATUSES),
            F.coalesce(lookup(STATUS_REJECTIONS, status), F.lit("MARKET_STATUS_UNKNOWN")),
        ),
        (when(need_event, F.col("_category") == ""), "EVENT_CATEGORY_MISSING"),
        (
            when(need_event, ~F.col("_fetched")),
            "EVENT_METADATA_INCOMPLETE" if canary else "EVENT_METADATA_MISSING",
        ),
        (when(strict, F.col("closes_early").isNull()), "CAN_CLOSE_EARLY_STATUS_UNKNOWN"),
        (when(strict, closes & ~early_ok), early_label),
        (when(strict, F.col("close_at").isNull()), "MISSING_CLOSE_TIME"),
        (when(strict, is_true(F.col("close_at") <= end)), "TIME_TO_CLOSE_TOO_SHORT"),
        (when(strict, F.col("expiration_at").isNull()), "MISSING_EXPECTED_EXPIRATION_TIME"),
        (when(strict, is_true(F.col("expiration_at") <= end)), "EXPECTED_EXPIRATION_TOO_SHORT"),
        (when(strict, klass == "INVALID"), "OCCURRENCE_DATETIME_INVALID"),
        (when(strict, klass == "HISTORICAL_OR_ALREADY_OCCURRED"), "OCCURRENCE_ALREADY_OCCURRED_UNSAFE"),
        (
            when(strict, is_true((klass == "AMBIGUOUS_FUTURE_OCCURRENCE") & (F.col("occurrence_bound") <= end))),
            "OCCURRENCE_SAFETY_BOUND_TOO_SHORT",
        ),
        (when(strict, closes & (klass == "MISSING")), early_label),
        (when(not strict, deadline.isNull()), "MISSING_CLOSE_TIME"),
        (short, deadline_label),
        (when(canary, F.col("sports")), "SPORTS_UNSUITABLE_FOR_CANARY"),
        (when(canary, F.col("match_like")), "MATCH_EVENT_UNSUITABLE_FOR_CANARY"),
        (
            when(week and not allow_sports, F.col("sports") | F.col("match_like")),
            "SPORTS_MATCH_UNSUITABLE_FOR_LONG_CAMPAIGN",
        ),
        (when(need_book, empty_book), "EMPTY_ORDERBOOK"),
    )


def _rank_columns(selected: DataFrame, by_activity: bool) -> DataFrame:
    activity = F.coalesce("activity", F.lit(0).cast("decimal(38,18)"))
    return selected.withColumns(
        {
            "_o1": -activity if by_activity else F.lit(0).cast("decimal(38,18)"),
            "_o2": F.coalesce("closes_early", F.lit(False)),
            "_o3": -F.coalesce("seconds_to_deadline", F.lit(0)),
            "_o4": ~F.col("current_quote"),
            "_o5": F.coalesce("ticker", "market_ticker", F.lit("")),
        }
    )


_RANK = ("_o1", "_o2", "_o3", "_o4", "_o5")


def candidate_rank(selected: DataFrame, by_activity: bool = True) -> DataFrame:
    """Rank of every candidate, counted in parallel along ranges of all rank columns.

    The ranges are Spark's own, drawn from a sample of the ranks, so they stay even whatever
    values are common; the ranged rows are written once, which fixes the ranges.
    """
    ranged = _rank_columns(selected, by_activity).repartitionByRange(*_RANK)
    r = stage(ranged.withColumn("_range", F.spark_partition_id()), "candidate-ranges")
    return scan(
        r, [], list(_RANK), F.col("_range"), running={"candidate_rank": ("sum", F.lit(1).cast("bigint"))}
    ).drop("_range", *_RANK)


def eligible_candidates(
    selected: DataFrame,
    eligible: Column,
    max_probes: int | None = None,
    eligible_limit: int | None = None,
    by_activity: bool = True,
) -> DataFrame:
    """Probe candidates in rank order, stop after enough are eligible.

    The candidates are dealt into ranges of all rank columns and written once.  One row of
    counts per range tells the last range that holds a probe at all; later ranges are
    left unread, since every file holds one range.  A null ``eligible`` counts as not eligible.
    """
    ranged = _rank_columns(selected.withColumn("eligible", eligible), by_activity).repartitionByRange(*_RANK)
    r = stage(ranged.withColumn("_range", F.spark_partition_id()), "eligible-ranges")
    passed = F.coalesce(F.col("eligible").cast("bigint"), F.lit(0).cast("bigint"))
    counts = r.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.sum(passed).alias("passed"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    zero = F.lit(0).cast("bigint")
    entered = counts.select(
        "_range",
        F.coalesce(F.sum("rows").over(earlier), zero).alias("_rows_before"),
        F.coalesce(F.sum("passed").over(earlier), zero).alias("_passed_before"),
    )
    if max_probes is not None:
        entered = entered.where(F.col("_rows_before") < max_probes)
    if eligible_limit is not None:
        entered = entered.where(F.col("_passed_before") < eligible_limit)
    last = entered.agg(F.coalesce(F.max("_range"), F.lit(-1)).alias("n")).head().n
    inside = Window.partitionBy("_range").orderBy(*_RANK)
    before = F.sum(passed).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    probed = r.where(F.col("_range") <= last).withColumns(
        {"_place": F.row_number().over(inside), "_inside": F.coalesce(before, zero)}
    )
    probed = probed.join(entered, "_range").withColumns(
        {
            "candidate_rank": (F.col("_rows_before") + F.col("_place")).cast("bigint"),
            "_earlier": F.col("_passed_before") + F.col("_inside"),
        }
    )
    if max_probes is not None:
        probed = probed.where(F.col("candidate_rank") <= max_probes)
    if eligible_limit is not None:
        probed = probed.where(F.col("_earlier") < eligible_limit)
    names = [c for c in selected.columns if c not in ("eligible", "candidate_rank")]
    return probed.select(*names, "candidate_rank", "eligible")


def discovery_audit(selected: DataFrame) -> DataFrame:
    """Every audit count in one long table (section, label, row_count).

    Sections: primary, multi_label, overlap (pairs of distinct reasons of one market, at
    most a fixed set of labels), occurrence, occurrence_equals, dual_interpretation.
    """
    reasons = F.col("rejection_reasons")
    ordered = F.array_sort(F.array_distinct(reasons))

    def entry(section: str, label: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"))

    primary = F.when(F.size(reasons) > 0, entry("primary", F.try_element_at(reasons, F.lit(1))))
    multi = F.transform(reasons, lambda r: entry("multi_label", r))
    pairs = F.flatten(
        F.transform(
            ordered,
            lambda a: F.transform(
                F.filter(ordered, lambda b: b > a), lambda b: entry("overlap", F.concat_ws("|", a, b))
            ),
        )
    )
    single = F.array_compact(
        F.array(
            primary,
            entry("occurrence", F.col("occurrence_class")),
            F.when(
                F.col("occurrence_at") == F.col("close_at"), entry("occurrence_equals", F.lit("equals_close_time"))
            ),
            F.when(
                F.col("occurrence_at") == F.col("expiration_at"),
                entry("occurrence_equals", F.lit("equals_expected_expiration_time")),
            ),
            F.when(F.col("dual_interpretation_pass"), entry("dual_interpretation", F.lit("pass"))),
        )
    )
    return (
        selected.select(F.explode(F.concat(single, multi, pairs)).alias("_e"))
        .groupBy("_e.section", "_e.label")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def near_misses(selected: DataFrame, limit: int = NEAR_MISS_LIMIT) -> DataFrame:
    """Markets closest to the required end, nulls last, identities hashed: a top-k report.

    Markets without an identity share the place of their event; the rest of the report orders
    them, so the cut does not depend on how the rows lie.
    """
    short_hash = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    event = F.when(identifier_ok(F.col("event_ticker")), F.col("event_ticker"))
    rows = selected.select(
        short_hash(F.col("market_identity")).alias("market_id_hash"),
        short_hash(event).alias("event_id_hash"),
        "primary_rejection_reason", "lifecycle_deadline_source", "lifecycle_margin_seconds",
        "close_margin_seconds", "expiration_margin_seconds", "occurrence_class",
        "occurrence_margin_seconds", "dual_interpretation_pass", "closes_early",
        F.when(F.col("sports"), "sports").otherwise("non_sports").alias("event_category_class"),
        "match_like", "current_quote",
    )
    return rows.orderBy(
        F.abs("lifecycle_margin_seconds").asc_nulls_last(),
        F.coalesce("market_id_hash", F.lit("")),
        F.coalesce("event_id_hash", F.lit("")),
        *[F.col(c) for c in rows.columns if not c.endswith("_hash")],
    ).limit(limit)


def required_channels_acknowledged(acks: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Acknowledged channels of every key and whether all required ones are among them.

    A key whose acknowledgements are all of other channels, or null, has none of them.
    """
    wanted = F.when(F.col("channel").isin(*required), F.col("channel"))
    got = acks.groupBy(*keys).agg(F.sort_array(F.collect_set(wanted)).alias("acknowledged_channels"))
    need = F.array(*[F.lit(c) for c in required])
    return got.withColumn(
        "all_acknowledged", F.size(F.array_except(need, F.col("acknowledged_channels"))) == 0
    )
