"""Fixed values that results must agree on: labels, word lists, limits, formats."""

# --- decimal types ---------------------------------------------------------
PRICE = "decimal(20,18)"
QTY = "decimal(17,8)"
TOTAL = "decimal(38,18)"

# --- record types ----------------------------------------------------------
CANDIDATE_RECORD = "offline_complement_research_candidate"
FILL_SIM_RECORD = "offline_taker_fill_simulation"
PROPOSAL_RECORD = "paper_complement_order_proposal"
PAPER_FILL_RECORD = "paper_fill"
PAPER_SETTLEMENT_RECORD = "paper_settlement"
LEDGER_RECORD = "paper_ledger_state"
RISK_RECORD = "complement_risk_decision_v2"
APPROVAL_PENDING_RECORD = "manual_approval_pending"
APPROVAL_DECISION_RECORD = "manual_approval_decision"
DEMO_PREVIEW_RECORD = "kalshi_demo_submission_preview"
DEMO_EVENT_RECORD = "kalshi_demo_event"
DEMO_RECONCILIATION_RECORD = "kalshi_demo_reconciliation_state"
DAILY_RECORD = "daily_validation_report"
ORDER_RECORDS = (
    "paper_complement_order_proposal",
    "kalshi_demo_submission_preview",
    "open_order",
    "proposed_order",
)

# --- market status ---------------------------------------------------------
STATUS_MAP = {
    "initialized": "unopened",
    "active": "open",
    "inactive": "paused",
    "closed": "closed",
    "determined": "closed",
    "disputed": "closed",
    "amended": "closed",
    "finalized": "settled",
}
OPEN_STATUSES = ("open", "trading")
CLOSED_OR_FINAL_STATUSES = (
    "closed",
    "settled",
    "finalized",
    "resolved",
    "expired",
    "determined",
    "disputed",
    "amended",
)
STATUS_REJECTIONS = {
    "initialized": "MARKET_STATUS_UNOPENED",
    "unopened": "MARKET_STATUS_UNOPENED",
    "inactive": "MARKET_STATUS_PAUSED",
    "paused": "MARKET_STATUS_PAUSED",
    "closed": "MARKET_STATUS_CLOSED",
    "settled": "MARKET_STATUS_SETTLED",
    "determined": "MARKET_STATUS_DETERMINED",
    "disputed": "MARKET_STATUS_DISPUTED",
    "amended": "MARKET_STATUS_AMENDED",
    "finalized": "MARKET_STATUS_FINALIZED",
    "resolved": "MARKET_STATUS_FINALIZED",
    "expired": "MARKET_STATUS_CLOSED",
}

# --- market selection ------------------------------------------------------
CANARY_SECONDS = 1_800
SEVEN_DAY_SECONDS = 604_800
SAFETY_BUFFER_SECONDS = {"smoke": 900, "canary": 3_600, "seven_day": 86_400}
OCCURRENCE_TOLERANCE_SECONDS = 60
MATCH_WORDS = ("game", "match", "race", "bout", "set", "tournamentmatch")
ACTIVITY_PATTERN = r"^[0-9]+(\.[0-9]+)?$"
NEAR_MISS_LIMIT = 100

# --- evidence thresholds ---------------------------------------------------
MIN_COVERAGE = "0.95"
MAX_DISCONNECT_SECONDS = 15
MAX_LIFECYCLE_AGE_SECONDS = 120
QUIET_WARNING_SECONDS = 300
MAX_KEEPALIVE_AGE_SECONDS = 120
STALE_VENUE_SECONDS = 900
DEFAULT_MAX_STALENESS_SECONDS = 30
EVIDENCE_DIMENSIONS = (
    "artifact_integrity",
    "transport_connectivity",
    "transport_keepalive",
    "subscription_status",
    "sequence_integrity",
    "rebuild_integrity",
    "market_lifecycle_validity",
    "duration_evidence",
    "process_liveness",
    "supervisor_liveness",
    "backup_integrity",
    "replay_qualification",
)

# --- native WebSocket rows -------------------------------------------------
ORDERBOOK_TYPES = ("orderbook_snapshot", "orderbook_delta")
ACK_TYPES = ("subscribed", "ack", "ok")
REJECT_TYPES = ("error", "rejected")
KEEPALIVE_TYPES = ("heartbeat", "pong")
REQUIRED_CHANNELS = ("orderbook_delta", "trade")
BAD_SEQUENCE_STATES = (
    "SEQUENCE_GAP_DETECTED",
    "SEQUENCE_OUT_OF_ORDER",
    "SEQUENCE_DUPLICATE",
    "RESYNC_REQUIRED",
    "UNRECOVERED_GAP",
)

# --- campaign classes ------------------------------------------------------
EXTENDED_SMOKE_SECONDS = 900
MAX_SMOKE_SECONDS = 1_800
CAMPAIGN_SOURCE_TYPES = ("SYNTHETIC", "REST", "WEBSOCKET_SNAPSHOT", "WEBSOCKET_DELTA")
WEBSOCKET_SOURCE_TYPES = ("WEBSOCKET_SNAPSHOT", "WEBSOCKET_DELTA")

# --- payload safety --------------------------------------------------------
FORBIDDEN_KEY_PARTS = (
    "authorization",
    "api_key",
    "apikey",
    "secret",
    "signature",
    "kalshi-access",
    "token",
    "private_key",
    "password",
    "headers",
)
PRIVATE_ACCOUNT_KEYS = (
    "account",
    "account_id",
    "account_number",
    "accounts",
    "client_order_id",
    "fill",
    "fill_id",
    "fills",
    "member_id",
    "order",
    "order_id",
    "orders",
    "portfolio",
    "portfolio_id",
    "portfolios",
    "position",
    "positions",
    "user",
    "user_id",
    "users",
)
PRIVATE_ACCOUNT_PREFIXES = (
    "account_",
    "client_order_",
    "fill_",
    "member_",
    "order_",
    "portfolio_",
    "position_",
    "user_",
)
MONITOR_SECRET_PARTS = (
    "authorization",
    "credential",
    "key",
    "pass",
    "private_key",
    "secret",
    "signature",
    "token",
)
REDACTED = "[REDACTED]"

# --- rolling reports -------------------------------------------------------
WINDOW_DAYS = (7, 30, 90)
DATE_FIELDS = (
    "report_date",
    "observed_at",
    "timestamp",
    "created_at",
    "submitted_at",
    "resolved_at",
    "occurred_at",
    "recorded_at",
    "date",
)

# --- report inputs ---------------------------------------------------------
SUMMARY_STATUSES = ("pass", "fail", "skipped")
SOURCE_CONTENT_FIELDS = (
    "content",
    "excerpt",
    "quote",
    "raw_text",
    "source_content",
    "source_excerpt",
    "text",
)

REPORT_INPUT_KINDS = (
    "local_run_comparison",
    "local_validation_summary",
    "local_review_notes",
    "local_methodology_notes",
    "local_data_dictionary",
    "local_citation_index",
    "local_term_glossary",
    "local_assumption_register",
    "local_coverage_matrix",
    "local_reproducibility_checklist",
    "local_risk_review",
    "local_data_rights_review",
    "local_artifact_inventory",
    "local_appendix_index",
    "local_limitation_register",
    "local_open_questions",
    "local_decision_log",
    "local_follow_up_register",
    "local_version_notes",
    "local_distribution_checklist",
    "local_handoff_notes",
    "local_archive_notes",
)
