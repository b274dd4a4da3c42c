"""Read schemas of recorded JSON lines.  Decimals and clocks arrive as text."""

from __future__ import annotations

_LEVEL = "array<struct<price: string, quantity: string>>"

LIVE_EVENT = (
    "schema_version int, venue string, channel string, market_id string, event_type string, "
    "sequence bigint, observed_at string, received_at string, source_type string, "
    "payload string, tags array<string>"
)
SNAPSHOT = (
    "schema_version int, exchange string, ticker string, observed_at string, recorded_at string, "
    f"source_type string, normalized_orderbook struct<instrument_id: string, source: string, bids: {_LEVEL}, "
    f"asks: {_LEVEL}>, raw_payload string, notes string, tags array<string>"
)
BOOK_FIELDS = (
    "venue: string, market_id: string, best_yes_bid: string, best_no_bid: string, yes_bid_size: string, "
    "no_bid_size: string, fee_status: string, fee_per_contract: string, fee_source_note: string, "
    "estimated_slippage_per_contract: string, failed_leg_reserve_per_contract: string, "
    "minimum_net_edge_per_contract: string, data_quality_flags: array<string>, stale_book: boolean, "
    "invalid_book_state: boolean"
)
BOOKS_FIXTURE = (
    f"struct<source: string, markets: array<struct<{BOOK_FIELDS}>>, books: array<struct<{BOOK_FIELDS}>>, "
    "fee_status: string, fee_per_contract: string, fee_source_note: string, "
    "estimated_slippage_per_contract: string, failed_leg_reserve_per_contract: string, "
    "minimum_net_edge_per_contract: string>"
)
SCENARIO_FIELDS = (
    BOOK_FIELDS
    + ", policy: string, target_size: string, yes_available_size: string, no_available_size: string, "
    "yes_slippage_per_contract: string, no_slippage_per_contract: string, latency_shock_per_contract: string"
)
COMPANY_FACTS = (
    "struct<cik: string, entityName: string, facts: map<string, string>>"
)
CONCEPT = (
    "struct<label: string, units: map<string, array<struct<val: string, fy: string, fp: string, form: string, "
    "filed: string, end: string, accn: string>>>>"
)
MANIFEST = (
    "struct<inputs: array<struct<local_path: string, input_kind: string, display_label: string, "
    "rights_note: string, assumption_scope: string, required: boolean>>>"
)
