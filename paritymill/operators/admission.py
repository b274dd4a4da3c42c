"""Subscription bindings and sequence admission of native rows.

Bindings need no replay: the state of a binding at a row follows from its first answer
and its first answer that contradicts it.  Both come from combining aggregates.  The sequence
automaton, whose resets depend on earlier verdicts, runs per (campaign, connection,
order-book subscription) in chunks (``sequences``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.fixed import ACK_TYPES, ORDERBOOK_TYPES, REJECT_TYPES
from paritymill.functions.columns import is_true
from paritymill.functions.ordered import scan
from paritymill.operators.sequences import sequence_verdicts
from paritymill.session import stage

_CONN = ["campaign_id", "connection_epoch"]
_BIND = [*_CONN, "binding_channel", "generation"]


def bindings(requests: DataFrame, chunk: Column) -> DataFrame:
    """Requests with their generation per channel, run index and the ord that ends them.

    ``requests``: campaign_id, connection_epoch, ord, channel, command_id.
    """
    one = ("sum", F.lit(1).cast("bigint"))
    g = scan(requests, ["campaign_id", "channel"], ["ord"], chunk, running={"generation": one})
    r = scan(g, ["campaign_id"], ["ord"], chunk, running={"run_request_index": one})
    # the next request of the channel on the connection ends a binding
    back = r.withColumn("_back", -F.col("ord"))
    ended = scan(
        back, [*_CONN, "channel"], ["_back"], -chunk, prior={"end_ord": F.col("ord")}
    ).drop("_back")
    return ended.withColumnRenamed("channel", "binding_channel").withColumnRenamed("ord", "bind_ord")


def bind_rows(rows: DataFrame, requests: DataFrame, chunk: Column) -> DataFrame:
    """Each native row with its binding, the binding's state after the row, and what it observed.

    ``rows``: campaign_id, connection_epoch, ord and the columns of ``native_envelope``.
    """
    binds = stage(bindings(requests, chunk), "bindings")
    own = binds.select(
        *_CONN, F.col("binding_channel").alias("channel"), F.col("bind_ord").alias("ord"),
        F.struct("binding_channel", "generation", "command_id", "run_request_index").alias("_bind"),
    )
    both = rows.withColumn("_bind", F.lit(None).cast(own.schema["_bind"].dataType)).unionByName(
        own, allowMissingColumns=True
    )
    # the scan reads its rows twice; envelopes are parsed once
    both = stage(both, "binding-rows")
    marked = scan(
        both.withColumn("_is_row", F.col("_bind").isNull()),
        [*_CONN, "channel"], ["ord"], chunk, running={"_current": ("last", F.col("_bind"))},
    ).where("_is_row")
    # an error row without a binding of its own channel may name the command it answers
    by_command = binds.select(
        *_CONN, F.col("command_id").cast("string").alias("_cmd"), "bind_ord", "end_ord",
        F.struct("binding_channel", "generation", "command_id", "run_request_index").alias("_named"),
    )
    wants = F.when(
        F.col("_current").isNull() & F.col("native_type").isin(*REJECT_TYPES) & F.col("request_id_is_int"),
        F.col("request_id"),
    )
    left = marked.drop("_bind", "_is_row").withColumn("_cmd", wants)
    # only the few rows that name a command are joined; the rest would share one null key
    plain = left.where(F.col("_cmd").isNull()).withColumn(
        "_named", F.lit(None).cast(by_command.schema["_named"].dataType)
    )
    asking = left.where(F.col("_cmd").isNotNull()).join(
        by_command.withColumnsRenamed({c: f"_b_{c}" for c in _CONN} | {"_cmd": "_b_cmd"}),
        (F.col("_cmd") == F.col("_b_cmd"))
        & (F.col("campaign_id") == F.col("_b_campaign_id"))
        & (F.col("connection_epoch") == F.col("_b_connection_epoch"))
        & (F.col("bind_ord") < F.col("ord"))
        & (F.col("end_ord").isNull() | (F.col("end_ord") > F.col("ord"))),
        "left",
    )
    found = plain.unionByName(asking.select(*plain.columns))
    bound = F.coalesce("_current", "_named")
    linked = stage(
        found.select(
            *rows.columns,
            bound["binding_channel"].alias("binding_channel"),
            bound["generation"].alias("generation"),
            bound["command_id"].alias("command_id"),
            bound["run_request_index"].alias("run_request_index"),
        ),
        "bound-rows",
    )
    control = F.col("envelope_rejection").isNull() & F.col("generation").isNotNull()
    ack = control & F.col("native_type").isin(*ACK_TYPES)
    reject = control & F.col("native_type").isin(*REJECT_TYPES)
    matches = F.col("request_id_is_int") & (F.col("request_id") == F.col("command_id").cast("string"))
    answers = linked.where((ack | reject) & matches).select(
        *_BIND, "ord", F.when(ack, "A").otherwise("R").alias("_a"), F.col("sid").alias("_sid")
    )
    first = answers.groupBy(*_BIND).agg(
        F.min("ord").alias("first_ord"), F.min_by(F.struct("_a", "_sid"), "ord").alias("_first")
    )
    contrary = answers.join(first, _BIND).where(
        (F.col("_a") != F.col("_first._a"))
        | ((F.col("_a") == "A") & ~F.col("_sid").eqNullSafe(F.col("_first._sid")))
    ).groupBy(*_BIND).agg(F.min("ord").alias("conflict_ord"))
    life = first.join(contrary, _BIND, "left").select(
        *_BIND, "first_ord", "conflict_ord", F.col("_first._a").alias("_answer"),
        F.col("_first._sid").alias("binding_sid"),
    )
    r = linked.join(life, _BIND, "left")
    conflicted = is_true(F.col("conflict_ord") <= F.col("ord"))
    answered = is_true(F.col("first_ord") <= F.col("ord"))
    state = (
        F.when(F.col("generation").isNull(), "UNKNOWN")
        .when(conflicted, "CONFLICTED")
        .when(answered & (F.col("_answer") == "A"), "ACKNOWLEDGED")
        .when(answered, "REJECTED")
        .otherwise("REQUESTED")
    )
    before = is_true(F.col("conflict_ord") < F.col("ord"))
    at_first = F.col("ord") == F.col("first_ord")
    clash = before | is_true(F.col("conflict_ord") == F.col("ord"))
    observed = (
        F.when(ack & ~matches, "STALE_ACK")
        .when(ack & at_first, "ACKNOWLEDGED")
        .when(ack & clash, "CONFLICTING_ACK")
        .when(ack, "DUPLICATE_ACK")
        .when(reject & ~matches, "REJECTED")
        .when(reject & at_first, "REJECTED")
        .when(reject & clash, "CONFLICTING_REJECTION")
        .when(reject, "DUPLICATE_REJECTION")
    )
    return r.withColumns(
        {
            "_state": state,
            "binding_observation": observed,
        }
    ).withColumn(
        "binding_state", F.when((ack | reject) & ~matches, "REQUEST_MISMATCH").otherwise(F.col("_state"))
    ).drop("first_ord", "conflict_ord", "_answer")


def prepare_rows(
    bound: DataFrame, requests: DataFrame, requested_markets: Sequence[str], chunk: Column
) -> tuple[DataFrame, DataFrame]:
    """(rows as the sequence automaton reads them, order-book subscriptions) of ``bind_rows``.

    A subscription is numbered in its connection and starts with its request; what comes
    before the first belongs to subscription 0.
    """
    ob = requests.where(F.col("channel") == "orderbook_delta")
    cuts = scan(
        ob, _CONN, ["ord"], chunk, running={"subscription": ("sum", F.lit(1).cast("bigint"))}
    ).select(*_CONN, "ord", "subscription")
    kind = F.col("native_type")
    book = is_true(kind.isin(*ORDERBOOK_TYPES))
    data = is_true(kind.isin(*ORDERBOOK_TYPES, "trade"))
    requested = is_true(F.col("market_ticker").isin(*requested_markets))
    acked = F.col("_state") == "ACKNOWLEDGED"
    expected = F.when(book, "orderbook_delta").when(kind == "trade", "trade")
    sid_differs = data & acked & is_true(F.col("sid") != F.col("binding_sid"))
    static = (
        F.when(sid_differs, "SUBSCRIPTION_IDENTITY_MISMATCH")
        .when(is_true(F.col("channel") != expected), "CHANNEL_TYPE_MISMATCH")
        .when(F.col("envelope_rejection").isNotNull(), "NATIVE_ENVELOPE_REJECTED")
        .when(data & (F.col("_state") == "CONFLICTED"), "SUBSCRIPTION_BINDING_CONFLICTED")
        .when(data & ~acked, "PRE_ACKNOWLEDGMENT_DATA")
    )
    number = is_true(F.col("seq_is_int"))
    eligible = book & requested & F.col("envelope_rejection").isNull() & acked
    narrow = bound.select(
        *_CONN, "ord", "native_type", "market_ticker",
        F.coalesce(F.when(number, F.col("seq").cast("bigint")), F.lit(0)).alias("seq"),
        F.col("seq").isNotNull().alias("seq_present"),
        (F.col("seq").isNotNull() & eligible & number).alias("known"),
        requested.alias("requested"),
        static.alias("static_exclusion"),
    )
    joined = stage(
        narrow.withColumn("subscription", F.lit(None).cast("bigint")).unionByName(
            cuts.withColumn("_cut", F.lit(True)), allowMissingColumns=True
        ),
        "admission-narrow",
    )
    placed = scan(joined, _CONN, ["ord"], chunk, running={"_sub": ("last", F.col("subscription"))})
    rows = placed.where(F.col("_cut").isNull()).withColumn("subscription", F.coalesce("_sub", F.lit(0)))
    return rows.drop("_sub", "_cut"), cuts


def admit_rows(
    rows: DataFrame,
    requests: DataFrame,
    connections: DataFrame,
    requested_markets: Sequence[str],
    chunk: Column,
    contiguous: bool = False,
) -> DataFrame:
    """Binding, sequence state, admission and segment of every native row.

    ``rows`` also need market_ticker, seq (text) and seq_is_int.
    ``connections``: campaign_id, connection_epoch, one row per started connection.
    """
    bound = bind_rows(rows, requests, chunk)
    prepared, cuts = prepare_rows(bound, requests, requested_markets, chunk)
    judged = stage(sequence_verdicts(prepared, [*_CONN, "subscription"], chunk, contiguous), "admission-judged")
    # segments are numbered through the campaign: one per connection start, per order-book
    # subscription and per sequence failure
    starts = connections.select(*_CONN, F.lit(0).cast("bigint").alias("subscription")).unionByName(
        cuts.select(*_CONN, "subscription")
    )
    failures = judged.where(
        F.col("exclusion_reason").isin("SEQUENCE_DUPLICATE", "SEQUENCE_OUT_OF_ORDER", "SEQUENCE_GAP")
        & (F.col("admission_status") == "EXCLUDED")
    ).groupBy(*_CONN, "subscription").agg(F.count(F.lit(1)).alias("_made"))
    numbered = scan(
        starts.join(failures, [*_CONN, "subscription"], "left"),
        ["campaign_id"], ["connection_epoch", "subscription"], F.col("connection_epoch"),
        exclusive={"_before": ("sum", F.coalesce("_made", F.lit(0)) + 1)},
    ).select(*_CONN, "subscription", (F.coalesce("_before", F.lit(0)) + 1).alias("_base"))
    segment = F.col("_base") + F.col("failures")
    verdicts = judged.join(numbered, [*_CONN, "subscription"]).select(
        *_CONN, "ord", "subscription", "sequence_state", "admission_status", "exclusion_reason",
        "resync_state", segment.alias("segment_number"),
        F.when(F.col("failures") > 0, "INTEGRITY_FAILURE").alias("_boundary"),
    )
    generation = bindings(requests, chunk).where(F.col("binding_channel") == "orderbook_delta")
    first_ever = generation.where(F.col("generation") == 1).select(*_CONN, F.lit(True).alias("_new"))
    out = bound.join(verdicts, [*_CONN, "ord"]).join(first_ever, _CONN, "left")
    boundary = F.coalesce(
        "_boundary",
        F.when((F.col("subscription") == 0) & (F.col("connection_epoch") == 1), "INITIAL_CONNECTION")
        .when(F.col("subscription") == 0, "RECONNECTION")
        .when((F.col("subscription") == 1) & is_true(F.col("_new")), "NEW_SUBSCRIPTION")
        .otherwise("RESUBSCRIPTION"),
    )
    return out.withColumns(
        {
            "segment_boundary_reason": boundary,
            "connection_id": F.format_string("%s:connection:%04d", "campaign_id", "connection_epoch"),
            "segment_id": F.format_string("%s:segment:%04d", "campaign_id", "segment_number"),
            "binding_id": F.when(
                F.col("generation").isNotNull(),
                F.format_string(
                    "%s:connection:%04d:subscription:%s:%04d",
                    "campaign_id", "connection_epoch", "binding_channel", "generation",
                ),
            ),
        }
    ).drop("_boundary", "_new", "_state")
