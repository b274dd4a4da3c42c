"""Reconcile demo order events with the orders an audit record previewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import TOTAL
from paritymill.functions.columns import canonical_json, digest, flags, is_true
from paritymill.functions.ordered import scan
from paritymill.session import stage

_ORDER = ["audit_id", "client_order_id"]
_QTY = "decimal(28,8)"
_AVERAGE = "decimal(38,12)"
EVENT_TYPES = ("accepted", "rejected", "partial_fill", "full_fill", "cancel", "error", "timeout", "backfill")
TERMINAL_TYPES = ("rejected", "cancel", "error", "timeout")


def _source() -> Column:
    """Digest of the proposal and candidate that a row names; nulls are values."""
    return digest(canonical_json({c: F.col(c) for c in ("proposal_id", "candidate_hash")}))


def reconcile(audits: DataFrame, events: DataFrame, chunk: Column) -> dict[str, DataFrame]:
    """Order states, mismatches and counts for many audits at once.

    ``audits``: one row per previewed order with audit_id, proposal_id, candidate_hash,
    approval_id, status, client_order_id, side, submitted_quantity.
    ``events``: audit_id, ord, event_id, event_hash, event_type, resolved_event_type,
    proposal_id, candidate_hash, approval_id, client_order_id, price, quantity.

    The order rules never look back through a loop: filled quantity is a running sum of
    all fills; the order ends at its first terminal event with the quantity not filled;
    it is accepted from its first acceptance before that end.  So three aggregates, each
    combined before its shuffle, replace the per-order state.
    """
    kind = F.when(F.col("event_type") == "backfill", F.col("resolved_event_type")).otherwise(
        F.col("event_type")
    )
    # hashes are only compared: digests travel in their place, and no verdict is carried further as its parts
    narrow = events.select(
        *_ORDER, "ord", "event_id", "event_type", kind.alias("kind"), "price", F.col("quantity").cast(_QTY).alias("quantity"),
        digest(F.col("event_hash")).alias("_hash"), _source().alias("_source"), "approval_id",
    )
    firsts = narrow.groupBy("audit_id", "event_id").agg(
        F.min("ord").alias("_first_ord"), F.min_by("_hash", "ord").alias("_first_hash")
    )
    header = audits.select("audit_id", _source().alias("_source"), "approval_id", "status").groupBy("audit_id").agg(
        F.first("_source").alias("_audited"), F.first("approval_id").alias("_approval_id"), F.first("status").alias("_status")
    )
    orders = audits.select(*_ORDER, "side", F.col("submitted_quantity").cast(_QTY).alias("submitted_quantity"))
    first = F.col("ord") == F.col("_first_ord")
    same = F.col("_hash") == F.col("_first_hash")
    seen = narrow.join(firsts, ["audit_id", "event_id"]).withColumn(
        "_link", F.when(~first & same, "duplicate").when(~first, "conflicting_duplicate_event")
    ).drop("_hash", "_first_ord", "_first_hash")
    seen = seen.join(header.drop("_status"), "audit_id").withColumn(
        "_link",
        F.coalesce(
            "_link",
            F.when(F.col("_source") != F.col("_audited"), "source_hash_mismatch").when(
                ~F.col("approval_id").eqNullSafe(F.col("_approval_id")), "approval_id_mismatch"
            ),
        ),
    ).drop("_source", "_audited", "approval_id", "_approval_id")
    seen = seen.join(orders.select(*_ORDER, "submitted_quantity"), _ORDER, "left")
    unknown = F.when(F.col("submitted_quantity").isNull(), "unknown_client_order_id")
    linked = stage(
        seen.select(
            *_ORDER, "ord", "event_id", "event_type", "kind", "price", "quantity", "submitted_quantity",
            F.coalesce("_link", unknown).alias("link"),
        ),
        "reconcile-events",
    )
    fill = F.col("kind").isin("partial_fill", "full_fill")
    live = linked.where(F.col("link").isNull())
    walked = scan(
        live, _ORDER, ["ord"], chunk,
        running={"filled": ("sum", F.when(fill, F.col("quantity")).otherwise(F.lit(0).cast(_QTY)))},
    ).withColumn("filled_before", F.when(fill, F.col("filled") - F.col("quantity")).otherwise(F.col("filled")))
    walked = stage(walked, "reconcile-filled")
    terminal = F.col("kind").isin(*TERMINAL_TYPES)
    ends = terminal & (F.col("filled_before") != F.col("submitted_quantity"))
    ended = walked.groupBy(*_ORDER).agg(
        F.min(F.when(ends, F.col("ord"))).alias("end_ord"),
        F.min_by("kind", F.when(ends, F.col("ord"))).alias("end_kind"),
        F.max("filled").alias("filled_quantity"),
        F.sum(F.when(fill, (F.col("price") * F.col("quantity")).cast(TOTAL))).cast(TOTAL).alias("fill_cost"),
    )
    staged_end = stage(ended, "reconcile-ends")
    with_end = walked.join(staged_end.select(*_ORDER, "end_ord"), _ORDER)
    open_ = F.col("end_ord").isNull() | (F.col("ord") < F.col("end_ord"))
    accepts = with_end.where((F.col("kind") == "accepted") & open_).groupBy(*_ORDER).agg(
        F.min("ord").alias("accept_ord")
    )
    judged = with_end.join(accepts, _ORDER, "left")
    accepted = F.coalesce(F.col("accept_ord") < F.col("ord"), F.lit(False))
    after_end = F.coalesce(F.col("ord") > F.col("end_ord"), F.lit(False))
    full = F.col("filled_before") == F.col("submitted_quantity")
    done, target = F.col("filled"), F.col("submitted_quantity")
    effective = terminal & ~full & ~after_end
    reasons = flags(
        ((F.col("kind") == "accepted") & after_end, "accepted_after_terminal_event"),
        (terminal & full, "terminal_event_after_full_fill"),
        (terminal & ~full & after_end, "conflicting_terminal_event"),
        (
            effective & (F.col("kind") == "rejected") & (accepted | (F.col("filled_before") > 0)),
            "reject_after_accept_or_fill",
        ),
        (effective & (F.col("kind") == "cancel") & ~accepted, "missing_acceptance_before_cancel"),
        (fill & ~accepted, "missing_acceptance_before_fill"),
        (fill & (done > target), "fill_exceeds_submitted_quantity"),
        ((F.col("kind") == "partial_fill") & (done >= target), "partial_fill_not_partial"),
        ((F.col("kind") == "full_fill") & (done != target), "full_fill_quantity_mismatch"),
    )
    from_rules = judged.select(*_ORDER, "event_id", "ord", F.explode(reasons).alias("reason"))
    from_links = linked.where(F.col("link").isNotNull() & (F.col("link") != "duplicate")).select(
        *_ORDER, "event_id", "ord", F.col("link").alias("reason")
    )
    states = (
        orders.join(staged_end, _ORDER, "left")
        .join(accepts, _ORDER, "left")
        .select(
            *_ORDER, "side", "submitted_quantity",
            F.col("accept_ord").isNotNull().alias("accepted"),
            *[
                is_true(F.col("end_kind") == k).alias(n)
                for k, n in (
                    ("rejected", "rejected"), ("cancel", "canceled"), ("error", "errored"), ("timeout", "timed_out")
                )
            ],
            F.coalesce("filled_quantity", F.lit(0).cast(_QTY)).alias("filled_quantity"),
            F.when(
                F.col("filled_quantity") > 0,
                (F.col("fill_cost") / F.col("filled_quantity")).cast(_AVERAGE),
            ).otherwise(F.lit(0).cast(_AVERAGE)).alias("average_fill_price"),
        )
        .withColumn("fully_filled", F.col("filled_quantity") == F.col("submitted_quantity"))
    )
    touched = F.col("accepted") | F.col("rejected") | F.col("canceled") | F.col("errored") | F.col("timed_out")
    silent = (
        states.join(header.select("audit_id", "_status"), "audit_id")
        .where((F.col("_status") == "submitted") & ~touched & (F.col("filled_quantity") == 0))
        .select(
            *_ORDER, F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("bigint").alias("ord"),
            F.lit("missing_demo_event").alias("reason"),
        )
    )
    mismatches = from_links.unionByName(from_rules).unionByName(silent)
    counted = F.col("link").isNull()
    backfilled = counted & (F.col("event_type") == "backfill")
    counts = linked.groupBy("audit_id").agg(
        *[
            (
                F.count_if(counted & (F.col("event_type") == k))
                + (F.count_if(backfilled & (F.col("kind") == k)) if k != "backfill" else F.lit(0))
            ).alias(f"{k}_count")
            for k in EVENT_TYPES
        ],
        F.count_if(F.col("link") == "duplicate").alias("duplicate_event_count"),
    )
    return {"orders": states, "mismatches": mismatches, "counts": counts}


def reconciliation_state(result: dict[str, DataFrame]) -> DataFrame:
    """One row per audit: counts, mismatch count and submit eligibility."""
    bad = result["mismatches"].groupBy("audit_id").agg(F.count(F.lit(1)).alias("mismatch_count"))
    per = result["orders"].groupBy("audit_id").agg(F.count(F.lit(1)).alias("order_count"))
    out = per.join(result["counts"], "audit_id", "left").join(bad, "audit_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in out.columns if c.endswith("_count")}
    return out.withColumns(zeros).withColumn("submit_eligible", F.col("mismatch_count") == 0)
