"""ANSI SQL for the registered queries, runnable on the same Parquet tables."""

from __future__ import annotations


def d6(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(24,6)) AS DOUBLE)"


P = "DECIMAL(20,18)"
Q = "DECIMAL(17,8)"

TOP = f"""
top AS (
  SELECT 'venue_' || l_linestatus AS venue, 'M-' || CAST(l_partkey AS VARCHAR) AS market_id,
    CAST(0.45 + CAST(l_discount AS DECIMAL(10,4)) AS {P}) AS yb,
    CAST(0.46 + CAST(l_tax AS DECIMAL(10,4)) AS {P}) AS nb,
    CAST(CAST(l_quantity AS DECIMAL(14,2)) AS {Q}) AS ys,
    CAST(CAST(51 - l_quantity AS DECIMAL(14,2)) AS {Q}) AS ns,
    CASE l_returnflag WHEN 'A' THEN 'supplied' WHEN 'N' THEN 'missing' ELSE 'unknown' END AS fee_status,
    CASE WHEN l_returnflag = 'A' THEN CAST(0.01 AS {P}) END AS fee,
    year(l_shipdate) < 1996 AS stale, *
  FROM lineitem
)"""

CAND = f"""{TOP},
priced AS (
  SELECT *, CAST(1 - nb AS {P}) AS yes_ask, CAST(1 - yb AS {P}) AS no_ask,
    CAST(yb + nb - 1 AS {P}) AS gross, least(ys, ns) AS size,
    CAST(yb + nb - 1 - coalesce(fee, 0) - CAST(0.005 AS {P}) AS {P}) AS net
  FROM top
),
cand AS (
  SELECT *, CAST(net * size AS DECIMAL(38,18)) AS total,
    CASE WHEN gross <= 0 THEN 'reject'
         WHEN stale OR size <= 0 OR fee_status <> 'supplied' THEN 'audit_only'
         WHEN net > 0.01 THEN 'paper_candidate' ELSE 'reject' END AS decision
  FROM priced
)"""

M = "CAST(CAST({} AS DECIMAL(14,2)) AS VARCHAR)"
KEY = (
    "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(M.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))"
)
FLAGS = """concat_ws('|', 'manual_review_required', CASE WHEN stale THEN 'stale_book' END,
    CASE WHEN size <= 0 THEN 'insufficient_depth' END,
    CASE WHEN fee_status = 'missing' THEN 'missing_fee_model' END,
    CASE WHEN fee_status = 'unknown' THEN 'unknown_fee_model' END,
    CASE WHEN gross > 0 THEN 'crossed_book' WHEN gross = 0 THEN 'locked_book' END)"""
REASONS = """CASE WHEN decision = 'paper_candidate' THEN '' ELSE concat_ws('|',
    CASE WHEN gross > 0 THEN 'failed_leg_reserve' END,
    CASE WHEN gross > 0 AND fee IS NOT NULL THEN 'fee_adjustment' END,
    CASE WHEN size <= 0 THEN 'insufficient_depth' END,
    CASE WHEN fee_status = 'missing' THEN 'missing_fee_model' END,
    CASE WHEN gross <= 0 THEN 'no_complement_edge' END,
    CASE WHEN decision = 'reject' THEN 'not_paper_candidate' END,
    CASE WHEN stale THEN 'stale_book' END,
    CASE WHEN fee_status = 'unknown' THEN 'unknown_fee_model' END) END"""
COUNTS = f"""count(*) AS candidate_count,
  count(*) FILTER (decision = 'paper_candidate') AS paper_candidate_count,
  count(*) FILTER (decision = 'audit_only') AS audit_only_count,
  count(*) FILTER (decision = 'reject') AS reject_count,
  count(*) FILTER (fee_status = 'missing') AS missing_fee_count,
  count(*) FILTER (fee_status = 'unknown') AS unknown_fee_count,
  {d6("sum(total)")} AS total_estimated_net_edge"""

SCEN = f"""{CAND},
scen(scenario, policy, target, yes_av, no_av, ysl, nsl, lat, res) AS (VALUES
  ('fok20', 'fok', 20, NULL, NULL, 0.0, 0.0, 0.0, NULL),
  ('ioc30', 'ioc', 30, NULL, NULL, 0.01, 0.02, 0.0, NULL),
  ('ioc_all', 'ioc', NULL, NULL, NULL, 0.0, 0.0, 0.005, 0.0),
  ('fok_thin', 'fok', 10, 8, NULL, 0.0, 0.0, 0.0, 0.02)),
sized AS (
  SELECT *, CAST(coalesce(target, size) AS {Q}) AS tgt, CAST(coalesce(yes_av, ys) AS {Q}) AS ya,
    CAST(coalesce(no_av, ns) AS {Q}) AS na, CAST(coalesce(res, 0.005) AS {P}) AS reserve
  FROM cand CROSS JOIN scen
),
filled AS (
  SELECT *, CASE WHEN policy = 'fok' AND (ya < tgt OR na < tgt) THEN CAST(0 AS {Q}) ELSE least(tgt, ya) END AS fy,
    CASE WHEN policy = 'fok' AND (ya < tgt OR na < tgt) THEN CAST(0 AS {Q}) ELSE least(tgt, na) END AS fn,
    CAST(gross - coalesce(fee, 0) - ysl - nsl - lat - reserve AS {P}) AS pair_net
  FROM sized
)"""

TWO = f"""{TOP},
two AS (
  SELECT {KEY} AS book_key, CASE WHEN l_linenumber NOT IN (1, 3) THEN yb END AS bid,
    CASE WHEN l_linenumber NOT IN (2, 3) THEN CAST(1 - nb AS {P}) END AS ask,
    CAST(CAST(l_quantity - 25 AS DECIMAL(14,2)) AS {Q}) AS inv
  FROM top
),
fair AS (
  SELECT *, coalesce(CAST((bid + ask) * 0.5 AS DECIMAL(20,18)),
      CASE WHEN bid IS NOT NULL THEN least(greatest(CAST(bid + 0.01 AS {P}), 0), 1)
           WHEN ask IS NOT NULL THEN least(greatest(CAST(ask - 0.01 AS {P}), 0), 1) END) AS fv
  FROM two
)"""

RISK = f"""{CAND},
risk AS (
  SELECT {KEY} AS proposal_id, concat_ws('|', 'manual_approval_required',
    CASE WHEN l_linenumber <> 7 AND stale THEN 'stale_data' END,
    CASE WHEN l_linenumber = 7 THEN 'data_gap' END,
    CASE WHEN fee_status = 'missing' THEN 'missing_fee_model' END,
    CASE WHEN fee_status = 'unknown' THEN 'unknown_fee_model' END,
    CASE WHEN net < 0.01 THEN 'insufficient_net_edge' END,
    CASE WHEN CAST(l_extendedprice AS DECIMAL(14,2)) > 60000 THEN 'exposure_limit_breach' END,
    CASE WHEN l_linenumber > 5 THEN 'open_order_limit_breach' END,
    CASE WHEN CAST(l_tax * 100 AS DECIMAL(14,2)) > 6 THEN 'daily_loss_limit_breach' END,
    CASE WHEN l_suppkey % 11 = 0 THEN 'reconciliation_mismatch' END,
    CASE WHEN l_partkey % 97 = 0 THEN 'kill_switch_active' END) AS reasons
  FROM cand
),
decided AS (
  SELECT *, CASE WHEN reasons <> 'manual_approval_required' THEN 'reject' ELSE 'manual_review_required' END AS decision
  FROM risk
)"""

PROPOSE = f"""{CAND},
keyed AS (SELECT *, {KEY} AS line_key FROM cand),
sim_rows AS (
  SELECT venue, CASE WHEN l_linenumber < 4 THEN 'other-' ELSE '' END || market_id AS market_id, line_key AS sim_key, least(least(CAST(30 AS {Q}), ys), least(CAST(30 AS {Q}), ns)) AS completed,
    abs(least(CAST(30 AS {Q}), ys) - least(CAST(30 AS {Q}), ns)) AS failed,
    CAST(gross - coalesce(fee, 0) - 0.03 - 0.005 AS {P}) AS pair_net,
    CAST(yes_ask + 0.01 AS {P}) AS yfp, CAST(no_ask + 0.02 AS {P}) AS nfp
  FROM keyed
),
sims AS (
  SELECT *, sha256('sim:' || sim_key) AS simulation_hash FROM sim_rows
  QUALIFY row_number() OVER (PARTITION BY venue, market_id ORDER BY sim_key DESC) = 1
),
paired AS (
  SELECT k.line_key, k.decision, k.market_id, s.*, sha256(k.line_key) AS candidate_hash,
    CASE WHEN s.simulation_hash IS NOT NULL THEN sha256('{{"candidate_hash":"' || sha256(k.line_key)
      || '","market_id":"' || k.market_id || '","simulation_hash":"' || s.simulation_hash
      || '","venue":"' || k.venue || '"}}') END AS proposal_id
  FROM keyed k LEFT JOIN sims s ON s.venue = k.venue AND s.market_id = k.market_id
)"""

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
FEED = f"""
feed AS (
  SELECT event_id, 'v' || (user_id % 2) AS venue, 'M-' || (user_id % 10) AS market_id, ts AS received_at,
    ts - to_minutes({K}) AS observed_at, event_type, user_id, value,
    CAST(sum(1 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS BIGINT) AS sequence
  FROM events
),
flagged AS (
  SELECT *, lag(sequence) OVER w AS pseq, lag(observed_at) OVER w AS pobs
  FROM feed WINDOW w AS (PARTITION BY venue, market_id ORDER BY event_id)
)"""
GAP = "pseq IS NOT NULL AND sequence <> pseq + 1"
OOO = "pobs IS NOT NULL AND observed_at < pobs"
STALE = "received_at - observed_at > INTERVAL 30 MINUTE"

YN = """
yn AS (
  SELECT event_id, 'M-' || (user_id % 10) AS instrument_id,
    CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 3 + 2) / 10.0 AS DECIMAL(6,2)) END AS bb,
    CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 3 + 1) / 10.0 AS DECIMAL(6,2)) END AS b2,
    CAST(1 - (event_id % 4 + 3) / 10.0 AS DECIMAL(6,2)) AS ba,
    CAST(1 - (event_id % 4 + 1) / 10.0 AS DECIMAL(6,2)) AS a2
  FROM events
)"""
MSG = f"""
msg AS (
  SELECT event_id AS row_index, 'M-' || (user_id % 10) AS market_ticker,
    'conn-' || CAST((day(ts) - 1) // 10 AS VARCHAR) AS connection_id, event_type = 'signup' AS snap,
    event_type = 'signup' AND event_id % 37 <> 0 AS good,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 37 = 0 THEN 'DUPLICATE_SNAPSHOT_PRICE' END
         WHEN event_id % 101 = 0 THEN 'MALFORMED_DELTA' WHEN event_id % 103 = 0 THEN 'IMPOSSIBLE_PRICE' END AS perr,
    CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side,
    CAST((event_id % 9 + 1) / 10.0 AS DECIMAL(6,2)) AS price,
    CAST(CASE WHEN event_type = 'purchase' THEN -floor(value / 10) ELSE floor(value) + 1 END AS BIGINT) AS delta
  FROM events WHERE event_type <> 'error'
),
ep AS (
  SELECT *, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (
    PARTITION BY market_ticker, connection_id ORDER BY row_index) AS BIGINT) AS epoch FROM msg
),
chg AS (
  SELECT market_ticker, connection_id, epoch, row_index, side, price, delta AS change FROM ep
  WHERE NOT snap AND perr IS NULL AND epoch > 0
  UNION ALL
  SELECT market_ticker, connection_id, epoch, row_index, l.side, CAST(l.price AS DECIMAL(6,2)), l.qty
  FROM ep, LATERAL (VALUES ('yes', (row_index % 3 + 1) / 10.0, 5), ('yes', (row_index % 3 + 2) / 10.0, 7),
    ('no', (row_index % 4 + 1) / 10.0, 6), ('no', (row_index % 4 + 3) / 10.0, 4)) AS l(side, price, qty)
  WHERE good
),
lev AS (
  SELECT *, CAST(sum(change) OVER (PARTITION BY market_ticker, connection_id, epoch, side, price ORDER BY row_index) AS BIGINT) AS qty
  FROM chg
),
badrows AS (
  SELECT market_ticker, connection_id, epoch, row_index, 'NEGATIVE_RESULTING_QUANTITY' AS bad FROM lev WHERE qty < 0
  UNION ALL
  SELECT market_ticker, connection_id, epoch, row_index,
    CASE WHEN epoch = 0 AND NOT snap THEN 'DELTA_BEFORE_SNAPSHOT' ELSE perr END
  FROM ep WHERE perr IS NOT NULL OR epoch = 0
),
fb AS (
  SELECT market_ticker, connection_id, epoch, min(row_index) AS bad_from, arg_min(bad, row_index) AS bad_reason
  FROM badrows GROUP BY ALL
),
disp AS (
  SELECT ep.*, fb.bad_from, fb.bad_reason, pb.bad_from IS NOT NULL AS after_bad,
    CASE WHEN (snap AND perr IS NOT NULL) OR ep.row_index = fb.bad_from THEN 'QUARANTINED'
         WHEN fb.bad_from IS NULL OR ep.row_index < fb.bad_from THEN 'FRAME_EMITTED' ELSE 'EXCLUDED' END AS disposition
  FROM ep LEFT JOIN fb USING (market_ticker, connection_id, epoch)
  LEFT JOIN fb pb ON pb.market_ticker = ep.market_ticker AND pb.connection_id = ep.connection_id AND pb.epoch = ep.epoch - 1
)"""
TOB = f"""{MSG},
seg AS (
  SELECT lev.*, lead(lev.row_index) OVER (PARTITION BY lev.market_ticker, lev.connection_id, lev.epoch, lev.side, lev.price ORDER BY lev.row_index) AS nxt
  FROM lev JOIN disp ON disp.row_index = lev.row_index WHERE disp.disposition = 'FRAME_EMITTED'
),
tob AS (
  SELECT f.row_index, f.market_ticker,
    max(CASE WHEN s.side = 'yes' THEN s.price END) AS bb, arg_max(s.qty, s.price) FILTER (s.side = 'yes') AS bs,
    max(CASE WHEN s.side = 'no' THEN s.price END) AS nb, arg_max(s.qty, s.price) FILTER (s.side = 'no') AS asz,
    count(*) FILTER (s.side = 'yes') AS bl, count(*) FILTER (s.side = 'no') AS al
  FROM disp f LEFT JOIN seg s ON s.market_ticker = f.market_ticker AND s.connection_id = f.connection_id
    AND s.epoch = f.epoch AND s.row_index <= f.row_index AND (s.nxt IS NULL OR f.row_index < s.nxt) AND s.qty > 0
  WHERE f.disposition = 'FRAME_EMITTED' GROUP BY ALL
)"""

FIFO = """
fl AS (
  SELECT user_id, event_id, event_type IN ('purchase', 'click', 'signup') AS buy,
    CAST((event_id % 99 + 1) / 100.0 AS DECIMAL(10,2)) AS price, CAST(floor(value / 10) + 1 AS BIGINT) AS qty FROM events
),
cum AS (
  SELECT *, sum(CASE WHEN buy THEN qty ELSE 0 END) OVER w AS b, sum(CASE WHEN buy THEN qty ELSE -qty END) OVER w AS n
  FROM fl WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
),
low AS (SELECT *, greatest(0, -min(n) OVER (PARTITION BY user_id ORDER BY event_id)) AS u FROM cum),
mat AS (SELECT *, b - n - u AS m, coalesce(lag(b - n - u) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS pm FROM low),
pieces AS (
  SELECT s.user_id, (least(s.m, y.b) - greatest(s.pm, y.b - y.qty)) * (s.price - y.price) AS gain
  FROM mat s JOIN mat y ON s.user_id = y.user_id AND NOT s.buy AND y.buy AND s.m > y.b - y.qty AND y.b > s.pm
  WHERE s.m > s.pm
)"""
LEDGER = f"""
prop AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day
  FROM orders WHERE o_orderkey % 97 <> 0
),
rows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS proposal_id, {KEY} AS event_key, l_returnflag <> 'R' AS fill,
    CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side, CAST(0.3 + CAST(l_discount AS DECIMAL(10,4)) AS DOUBLE) AS price,
    CAST(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE floor(l_quantity / 4) END AS DOUBLE) AS qty,
    l_tax AS fee, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS payout,
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_partkey % 50 = 0 AS bad_c, l_suppkey % 40 = 7 AS bad_s
  FROM lineitem
),
linked AS (
  SELECT r.*, CASE WHEN p.proposal_id IS NULL THEN 'unknown_proposal' WHEN fill AND bad_c THEN 'candidate_hash_mismatch'
    WHEN fill AND bad_s THEN 'simulation_hash_mismatch' END AS mismatch
  FROM rows r LEFT JOIN prop p ON p.proposal_id = r.proposal_id AND (p.day, '!' || p.proposal_id) < (r.day, r.event_key)
),
folded AS (
  SELECT proposal_id, side, list_reduce(
    list_prepend({{'k': '', 'f': true, 'q': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'x': false, 'bad': []::VARCHAR[]}},
      list({{'k': event_key, 'f': fill, 'q': qty, 'c': CASE WHEN fill THEN price * qty ELSE payout END,
        'g': fee, 'x': fill, 'bad': []::VARCHAR[]}} ORDER BY day, event_key)),
    lambda a, r: CASE WHEN r.f THEN {{'k': '', 'f': true, 'q': a.q + r.q, 'c': a.c + r.c, 'g': a.g, 'x': true, 'bad': a.bad}}
      WHEN NOT a.x OR a.q < r.q THEN {{'k': '', 'f': true, 'q': a.q, 'c': a.c, 'g': a.g, 'x': a.x, 'bad': list_append(a.bad, r.k)}}
      ELSE {{'k': '', 'f': true, 'q': a.q - r.q, 'c': CASE WHEN a.q = r.q THEN 0.0 ELSE a.c - a.c / a.q * r.q END,
        'g': a.g + CASE WHEN a.q > 0 THEN (r.c - a.c / a.q) * r.q ELSE r.c * r.q END, 'x': true, 'bad': a.bad}} END) AS st,
    sum(CASE WHEN fill THEN fee END) AS fees
  FROM linked WHERE mismatch IS NULL GROUP BY proposal_id, side
)"""
DEMO = """
ev AS (
  SELECT event_id AS ord, event_id // 500 AS block, user_id, 'A-' || (event_id // 500) AS audit_id,
    'O-' || user_id || '-' || (event_id // 500) AS client_order_id, user_id % 13 <> 0 AS known,
    CASE WHEN event_id % 10 < 4 THEN 'D-' || (event_id // 2) ELSE 'E-' || event_id END AS event_id, user_id % 2 AS h,
    CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'click' THEN 'partial_fill' WHEN 'purchase' THEN 'full_fill'
      WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'rejected' ELSE 'timeout' END
      ELSE CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'backfill' END END AS event_type,
    event_id % 41 = 0 AS bad_src, event_id % 43 = 0 AS bad_app, (event_id % 99 + 1) / 100.0 AS price, event_id % 10 + 1 AS qty
  FROM events
),
fst AS (SELECT audit_id, event_id, min(ord) AS fo, arg_min(h, ord) AS fh FROM ev GROUP BY 1, 2),
lnk AS (
  SELECT ev.*, CASE WHEN event_type = 'backfill' THEN 'partial_fill' ELSE event_type END AS kind,
    CASE WHEN ord <> fo AND h = fh THEN 'duplicate' WHEN ord <> fo THEN 'conflicting_duplicate_event'
      WHEN bad_src THEN 'source_hash_mismatch' WHEN bad_app THEN 'approval_id_mismatch'
      WHEN NOT known THEN 'unknown_client_order_id' END AS link
  FROM ev JOIN fst USING (audit_id, event_id)
),
wk AS (
  SELECT *, kind IN ('partial_fill', 'full_fill') AS fill,
    sum(CASE WHEN kind IN ('partial_fill', 'full_fill') THEN qty ELSE 0 END) OVER (PARTITION BY client_order_id ORDER BY ord) AS filled
  FROM lnk WHERE link IS NULL
),
wb AS (SELECT *, filled - CASE WHEN fill THEN qty ELSE 0 END AS fbef, kind IN ('rejected', 'cancel', 'error', 'timeout') AS term FROM wk),
en AS (
  SELECT client_order_id, min(ord) FILTER (term AND fbef <> 20) AS end_ord, arg_min(kind, ord) FILTER (term AND fbef <> 20) AS end_kind,
    max(filled) AS total, sum(CASE WHEN fill THEN price * qty END) AS cost FROM wb GROUP BY 1
),
ac AS (
  SELECT client_order_id, min(ord) AS acc_ord FROM wb JOIN en USING (client_order_id)
  WHERE kind = 'accepted' AND (end_ord IS NULL OR ord < end_ord) GROUP BY 1
),
jd AS (SELECT *, coalesce(acc_ord < ord, false) AS acc, coalesce(ord > end_ord, false) AS aft FROM wb JOIN en USING (client_order_id) LEFT JOIN ac USING (client_order_id)),
orders_ AS (SELECT DISTINCT audit_id, client_order_id, block FROM ev WHERE known),
st AS (
  SELECT o.*, acc_ord IS NOT NULL AS accepted, coalesce(end_kind = 'rejected', false) AS rejected, coalesce(end_kind = 'cancel', false) AS canceled,
    coalesce(end_kind = 'error', false) AS errored, coalesce(end_kind = 'timeout', false) AS timed_out, coalesce(total, 0) AS total, cost
  FROM orders_ o LEFT JOIN en USING (client_order_id) LEFT JOIN ac USING (client_order_id)
),
mm AS (
  SELECT audit_id, client_order_id, event_id, ord, link AS reason FROM lnk WHERE link IS NOT NULL AND link <> 'duplicate'
  UNION ALL SELECT audit_id, client_order_id, event_id, ord, unnest(list_filter([
    CASE WHEN kind = 'accepted' AND aft THEN 'accepted_after_terminal_event' END,
    CASE WHEN term AND fbef = 20 THEN 'terminal_event_after_full_fill' END,
    CASE WHEN term AND fbef <> 20 AND aft THEN 'conflicting_terminal_event' END,
    CASE WHEN kind = 'rejected' AND fbef <> 20 AND NOT aft AND (acc OR fbef > 0) THEN 'reject_after_accept_or_fill' END,
    CASE WHEN kind = 'cancel' AND fbef <> 20 AND NOT aft AND NOT acc THEN 'missing_acceptance_before_cancel' END,
    CASE WHEN fill AND NOT acc THEN 'missing_acceptance_before_fill' END,
    CASE WHEN fill AND filled > 20 THEN 'fill_exceeds_submitted_quantity' END,
    CASE WHEN kind = 'partial_fill' AND filled >= 20 THEN 'partial_fill_not_partial' END,
    CASE WHEN kind = 'full_fill' AND filled <> 20 THEN 'full_fill_quantity_mismatch' END], lambda x: x IS NOT NULL)) FROM jd
  UNION ALL SELECT audit_id, client_order_id, NULL, NULL, 'missing_demo_event' FROM st
  WHERE block % 2 = 0 AND NOT (accepted OR rejected OR canceled OR errored OR timed_out) AND total = 0
)"""

REC = """
rec AS (
  SELECT o_orderkey AS k, o_orderkey % 8 AS t, CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS d,
    CASE o_orderstatus WHEN 'F' THEN 'paper_candidate' WHEN 'O' THEN 'audit_only' ELSE 'reject' END AS decision,
    o_orderstatus, o_custkey, CAST((CAST(o_totalprice AS DECIMAL(14,2)) - 250000) * 0.001 AS DECIMAL(20,5)) AS pnl,
    o_orderkey % 29 = 0 AS gapf
  FROM orders
),
pnls AS (SELECT k, d, CASE t WHEN 2 THEN pnl WHEN 5 THEN CAST(-pnl * 0.5 AS DECIMAL(20,6)) ELSE 0 END AS p FROM rec)"""
CONN = """
ce AS (
  SELECT 'R-' || user_id AS run_id, user_id, 'C-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS connection_id,
    'S-' || (event_id % 3) AS segment_id, ts, event_id AS ord, event_type AS s,
    CASE event_type WHEN 'signup' THEN 'O' WHEN 'click' THEN 'O' WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'E' ELSE 'A' END AS kind,
    CASE event_type WHEN 'error' THEN 'keepalive' WHEN 'view' THEN 'lifecycle' ELSE 'orderbook' END AS obs
  FROM events
),
runs AS (
  SELECT 'R-' || user_id AS run_id, date_trunc('day', min(ts))::TIMESTAMP AS started_at,
    date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY AS ended_at FROM events GROUP BY user_id
),
win AS (
  SELECT ce.run_id, connection_id, arg_min(ts, ord) FILTER (kind = 'O') AS opened_at,
    coalesce(arg_max(ts, ord) FILTER (kind = 'C'), any_value(ended_at)) AS clo,
    CAST(count(*) FILTER (kind = 'E') AS BIGINT) AS error_count, count(*) AS event_count
  FROM ce JOIN runs USING (run_id) GROUP BY ce.run_id, connection_id
),
segs AS (
  SELECT connection_id, string_agg(segment_id, '|' ORDER BY f) AS segment_ids
  FROM (SELECT connection_id, segment_id, min(ord) AS f FROM ce GROUP BY 1, 2) GROUP BY 1
),
windows AS (
  SELECT run_id, connection_id, opened_at, CASE WHEN opened_at IS NOT NULL THEN clo END AS closed_at, error_count, event_count,
    CASE WHEN clo >= opened_at THEN epoch_us(clo) - epoch_us(opened_at) ELSE 0 END AS us FROM win
),
seq AS (
  SELECT run_id, opened_at, closed_at, lag(closed_at) OVER (PARTITION BY run_id ORDER BY opened_at, connection_id) AS pc FROM windows
  WHERE opened_at IS NOT NULL
),
edge AS (
  SELECT run_id, min(opened_at) AS f, arg_max(closed_at, (opened_at, connection_id)) AS l FROM windows WHERE opened_at IS NOT NULL GROUP BY 1
),
gaps AS (
  SELECT run_id, 'between' AS gap_kind, pc AS a, opened_at AS b FROM seq WHERE pc IS NOT NULL AND opened_at >= pc
  UNION ALL SELECT run_id, 'whole_run', started_at, ended_at FROM runs LEFT JOIN edge USING (run_id) WHERE f IS NULL
  UNION ALL SELECT run_id, 'lead_in', started_at, f FROM runs JOIN edge USING (run_id) WHERE f > started_at
  UNION ALL SELECT run_id, 'tail', l, ended_at FROM runs JOIN edge USING (run_id) WHERE ended_at > l
)"""
CEIL = "CAST(ceil((epoch_us({}) - epoch_us({})) / 1000000.0) AS BIGINT)"

T0 = "TIMESTAMP '2026-08-01 00:00:00'"
MKT = f"""
mk AS (
  SELECT p_partkey AS k, p_partkey AS ord, CASE WHEN p_partkey % 41 = 0 THEN 'MKT ' ELSE 'MKT-' END || p_partkey AS ticker,
    CASE WHEN p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 THEN 'MKT-' || p_partkey END AS ident,
    CASE WHEN p_partkey % 47 <> 0 THEN 'EV-' || regexp_extract(p_brand, '([0-9]+)', 1) END AS event_ticker,
    ['active', 'open', 'open', 'trading', 'closed', 'inactive', '', 'odd', 'open'][p_partkey % 9 + 1] AS status,
    p_name, CASE WHEN p_partkey % 23 <> 0 THEN {T0} + to_seconds(p_size * 600) END AS close_at,
    CASE WHEN p_partkey % 13 <> 0 THEN {T0} + to_seconds(p_size * 600 + 7200) END AS exp_at,
    CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS ce,
    CASE WHEN p_partkey % 8 = 0 THEN {T0} + to_seconds(14400) END AS early_at, p_partkey % 16 = 0 AS auth,
    CASE WHEN p_partkey % 5 = 0 THEN {T0} + to_seconds(p_size * 600) WHEN p_partkey % 5 = 1 THEN {T0} - INTERVAL 1 HOUR END AS occ_at,
    p_partkey % 5 >= 3 AS occ_missing,
    CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(14,2)) END AS activity,
    p_partkey % 6 = 0 AS quoted, p_size % 5 AS lvl, p_partkey % 17 = 0 AS is_match
  FROM part
),
evs AS (
  SELECT s_suppkey AS ord, 'EV-' || n_nationkey AS event_ticker, CASE WHEN r_regionkey = 0 THEN 'Sports' ELSE 'Topic ' || r_name END AS category,
    CASE WHEN s_suppkey % 9 <> 0 THEN n_name || ' outcome ' || s_suppkey END AS title, n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
lst AS (SELECT * FROM evs QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY ord DESC) = 1),
enr AS (
  SELECT mk.*, CASE WHEN title IS NOT NULL THEN category END AS cat, title AS etitle,
    CASE WHEN mk.event_ticker IS NULL THEN 'INVALID_EVENT_IDENTITY' WHEN lst.event_ticker IS NULL THEN 'EVENT_METADATA_FETCH_FAILED'
      WHEN title IS NULL THEN 'EVENT_METADATA_INCOMPLETE' END AS event_reason
  FROM mk LEFT JOIN lst ON mk.event_ticker = lst.event_ticker
),
prof(profile, need) AS (VALUES ('canary', 5400), ('smoke', 1800), ('seven_day', 691200)),
occ AS (
  SELECT *, {T0} + to_seconds(need) AS fin, profile <> 'smoke' AS strict,
    CASE WHEN occ_missing THEN 'MISSING' WHEN occ_at IS NULL THEN 'INVALID' WHEN profile = 'smoke' THEN 'SMOKE_UNINTERPRETED_OCCURRENCE'
      WHEN occ_at <= {T0} + INTERVAL 60 SECOND THEN 'HISTORICAL_OR_ALREADY_OCCURRED' ELSE 'AMBIGUOUS_FUTURE_OCCURRENCE' END AS oc
  FROM enr CROSS JOIN prof
),
bnd AS (SELECT *, CASE WHEN oc IN ('SMOKE_UNINTERPRETED_OCCURRENCE', 'AMBIGUOUS_FUTURE_OCCURRENCE') THEN occ_at END AS ob FROM occ),
ddl AS (SELECT *, least(close_at, exp_at, early_at, ob) AS dl, auth AND coalesce(early_at > fin, false) AS eok,
  CASE profile WHEN 'canary' THEN 'CAN_CLOSE_EARLY_UNSAFE_FOR_CANARY' ELSE 'CAN_CLOSE_EARLY_UNSAFE_FOR_DURATION' END AS elabel FROM bnd),
rej AS (
  SELECT *, list_filter([
    CASE WHEN ident IS NULL THEN 'INVALID_MARKET_IDENTITY' END,
    CASE WHEN event_ticker IS NULL THEN 'INVALID_EVENT_IDENTITY' END,
    CASE status WHEN '' THEN 'MARKET_STATUS_UNKNOWN' WHEN 'open' THEN NULL WHEN 'trading' THEN NULL WHEN 'closed' THEN 'MARKET_STATUS_CLOSED'
      WHEN 'inactive' THEN 'MARKET_STATUS_PAUSED' ELSE 'MARKET_STATUS_UNKNOWN' END,
    CASE WHEN strict AND cat IS NULL THEN 'EVENT_CATEGORY_MISSING' END,
    CASE WHEN strict AND cat IS NULL THEN CASE profile WHEN 'canary' THEN 'EVENT_METADATA_INCOMPLETE' ELSE 'EVENT_METADATA_MISSING' END END,
    CASE WHEN strict AND ce IS NULL THEN 'CAN_CLOSE_EARLY_STATUS_UNKNOWN' END,
    CASE WHEN strict AND ce AND NOT eok THEN elabel END,
    CASE WHEN strict AND close_at IS NULL THEN 'MISSING_CLOSE_TIME' WHEN strict AND close_at <= fin THEN 'TIME_TO_CLOSE_TOO_SHORT' END,
    CASE WHEN strict AND exp_at IS NULL THEN 'MISSING_EXPECTED_EXPIRATION_TIME' WHEN strict AND exp_at <= fin THEN 'EXPECTED_EXPIRATION_TOO_SHORT' END,
    CASE WHEN strict THEN CASE oc WHEN 'INVALID' THEN 'OCCURRENCE_DATETIME_INVALID' WHEN 'HISTORICAL_OR_ALREADY_OCCURRED' THEN 'OCCURRENCE_ALREADY_OCCURRED_UNSAFE'
      WHEN 'AMBIGUOUS_FUTURE_OCCURRENCE' THEN CASE WHEN ob <= fin THEN 'OCCURRENCE_SAFETY_BOUND_TOO_SHORT' END END END,
    CASE WHEN strict AND ce AND oc = 'MISSING' AND eok THEN elabel END,
    CASE WHEN dl IS NULL THEN CASE WHEN NOT strict THEN 'MISSING_CLOSE_TIME' END
      WHEN dl <= fin THEN CASE WHEN profile = 'canary' THEN 'CANARY_LIFECYCLE_DEADLINE_TOO_SHORT'
        WHEN close_at = dl AND exp_at IS NULL AND early_at IS NULL THEN CASE WHEN strict AND close_at <= fin THEN NULL ELSE 'TIME_TO_CLOSE_TOO_SHORT' END
        ELSE 'CONSERVATIVE_LIFECYCLE_DEADLINE_TOO_SHORT' END END,
    CASE WHEN profile = 'canary' AND cat = 'Sports' THEN 'SPORTS_UNSUITABLE_FOR_CANARY' END,
    CASE WHEN profile = 'canary' AND is_match THEN 'MATCH_EVENT_UNSUITABLE_FOR_CANARY' END,
    CASE WHEN profile = 'seven_day' AND (coalesce(cat = 'Sports', false) OR is_match) THEN 'SPORTS_MATCH_UNSUITABLE_FOR_LONG_CAMPAIGN' END,
    CASE WHEN lvl <= 0 THEN 'EMPTY_ORDERBOOK' END], lambda x: x IS NOT NULL) AS rs,
    CASE WHEN strict THEN coalesce(close_at > fin, false) AND coalesce(exp_at > fin, false)
      AND (oc = 'MISSING' OR (oc = 'AMBIGUOUS_FUTURE_OCCURRENCE' AND occ_at > fin))
      AND (coalesce(NOT ce, false) OR (coalesce(ce, false) AND oc <> 'MISSING' AND eok)) END AS dual
  FROM ddl
)"""
SECS = "CAST((epoch_us({}) - epoch_us({})) // 1000000 AS BIGINT)"
RANKA = "coalesce(activity, 0) DESC, coalesce(ce, false), coalesce(epoch_us(dl), epoch_us(TIMESTAMP '2026-08-01 00:00:00')) DESC, NOT quoted, ticker"
RANKD = RANKA.split(" DESC, ", 1)[1]

NATIVE = """
nat AS (
  SELECT event_id AS ord, event_id AS e, event_id % 50 AS slot, event_id // 50 * 50 AS block, user_id, event_type,
    CASE WHEN event_id % 50 IN (3, 4, 23) THEN 'subscribed' WHEN event_id % 50 = 33 THEN 'error' WHEN event_type = 'signup' THEN 'orderbook_snapshot'
      WHEN event_type = 'purchase' THEN 'trade' WHEN event_id % 67 = 0 THEN 'heartbeat' ELSE 'orderbook_delta' END AS kind
  FROM events WHERE event_id % 50 NOT IN (0, 1)
),
natd AS (
  SELECT *, CASE WHEN slot IN (3, 23) THEN 'orderbook_delta' WHEN slot = 4 THEN 'trade' END AS ch,
    CASE WHEN slot = 4 THEN block + 2 WHEN slot IN (3, 23) THEN block + 1 WHEN slot = 33 THEN CASE WHEN block % 200 = 0 THEN block + 1 ELSE block + 40 END END AS rid,
    CASE WHEN slot = 23 AND block % 150 = 0 THEN 9 WHEN e % 71 = 0 THEN 8 WHEN e % 73 <> 0 THEN 7 END AS sid_,
    e + CASE WHEN e % 29 = 0 THEN 1 WHEN e % 31 = 0 THEN -1 ELSE 0 END AS sq FROM nat
)"""
BOUND = """
rq AS (SELECT event_id AS bo, event_id // 1000 AS camp, event_id // 250 AS cn, CASE WHEN event_id % 50 = 0 THEN 'orderbook_delta' ELSE 'trade' END AS bch, event_id + 1 AS cmd
  FROM events WHERE event_id % 50 IN (0, 1)),
bd AS (SELECT *, row_number() OVER (PARTITION BY camp, bch ORDER BY bo) AS gen, row_number() OVER (PARTITION BY camp ORDER BY bo) AS rix,
  lead(bo) OVER (PARTITION BY cn, bch ORDER BY bo) AS eo FROM rq),
nr AS (SELECT *, ord // 1000 AS camp, ord // 250 AS cn,
  coalesce(ch, CASE WHEN kind IN ('orderbook_snapshot', 'orderbook_delta') THEN 'orderbook_delta' ELSE kind END) AS chan,
  CASE WHEN sid_ IS NULL AND kind IN ('subscribed', 'orderbook_snapshot', 'orderbook_delta', 'trade') THEN 1 END AS rejected FROM natd),
lk AS (SELECT nr.*, coalesce(o.bch, c.bch) AS bch, coalesce(o.gen, c.gen) AS gen, coalesce(o.cmd, c.cmd) AS cmd, coalesce(o.rix, c.rix) AS rix FROM nr
  LEFT JOIN bd o ON o.cn = nr.cn AND o.bch = nr.chan AND o.bo < nr.ord AND (o.eo IS NULL OR o.eo > nr.ord)
  LEFT JOIN bd c ON o.bo IS NULL AND nr.kind = 'error' AND c.cn = nr.cn AND c.cmd = nr.rid AND c.bo < nr.ord AND (c.eo IS NULL OR c.eo > nr.ord)),
an AS (SELECT camp, bch, gen, ord, CASE WHEN kind = 'subscribed' THEN 'A' ELSE 'R' END AS a, sid_ FROM lk
  WHERE rejected IS NULL AND gen IS NOT NULL AND kind IN ('subscribed', 'error') AND rid = cmd),
fs AS (SELECT camp, bch, gen, min(ord) AS fo, arg_min(a, ord) AS fa, arg_min(coalesce(sid_, -1), ord) AS fsid FROM an GROUP BY 1, 2, 3),
cf AS (SELECT camp, bch, gen, min(ord) AS co FROM an JOIN fs USING (camp, bch, gen) WHERE a <> fa OR (a = 'A' AND coalesce(sid_, -1) <> fsid) GROUP BY 1, 2, 3),
j AS (SELECT lk.*, fo, fa, fsid, co, rejected IS NULL AND gen IS NOT NULL AND kind = 'subscribed' AS ack, rejected IS NULL AND gen IS NOT NULL AND kind = 'error' AS rej,
  coalesce(rid = cmd, false) AS hit FROM lk LEFT JOIN fs USING (camp, bch, gen) LEFT JOIN cf USING (camp, bch, gen))"""
WALK = """
bs AS (SELECT j.*, kind IN ('orderbook_snapshot', 'orderbook_delta') AS book, kind = 'orderbook_snapshot' AS snap, e % 61 <> 0 AS has_seq,
    CASE WHEN e % 59 <> 0 THEN 'M-' || (user_id % 3) END AS market, coalesce(gen IS NOT NULL AND fa = 'A' AND fo <= ord AND NOT coalesce(co <= ord, false), false) AS acked,
    coalesce(co <= ord, false) AS conflicted, (SELECT count(*) FROM rq WHERE rq.cn = j.cn AND rq.bch = 'orderbook_delta' AND rq.bo < j.ord) AS sub FROM j),
st AS (SELECT *, coalesce(market IN ('M-0', 'M-1'), false) AS wanted, book OR kind = 'trade' AS data FROM bs),
r AS (SELECT *, wanted AND book AND rejected IS NULL AND acked AND has_seq AS known, row_number() OVER (PARTITION BY cn, sub ORDER BY ord) AS n,
    CASE WHEN data AND acked AND coalesce(sid_ <> fsid, false) THEN 'SUBSCRIPTION_IDENTITY_MISMATCH'
      WHEN data AND chan <> CASE WHEN book THEN 'orderbook_delta' ELSE 'trade' END THEN 'CHANNEL_TYPE_MISMATCH'
      WHEN rejected IS NOT NULL THEN 'NATIVE_ENVELOPE_REJECTED' WHEN data AND gen IS NOT NULL AND conflicted THEN 'SUBSCRIPTION_BINDING_CONFLICTED'
      WHEN data AND NOT acked THEN 'PRE_ACKNOWLEDGMENT_DATA' END AS static FROM st),
w AS (
  SELECT DISTINCT cn, sub, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::BIGINT AS last, []::VARCHAR[] AS seen, 0::BIGINT AS failures, 0::BIGINT AS made,
    '' AS verdict, '' AS status, '' AS fault, '' AS resync FROM r
  UNION ALL
  SELECT cn, sub, n, ord, CASE WHEN broken OR fault = 'DELTA_BEFORE_SNAPSHOT' THEN NULL WHEN known AND (last0 IS NULL OR sq > last0) THEN sq ELSE last0 END AS last,
    CASE WHEN broken THEN [] WHEN status = 'ADMITTED' AND snap THEN list_distinct(list_append(seen, market)) ELSE seen END AS seen,
    made AS failures, made + broken::BIGINT AS made, verdict, status, fault, CASE WHEN status = 'ADMITTED' THEN 'RESYNCED_WITH_SNAPSHOT' ELSE 'RESYNC_REQUIRED' END AS resync
  FROM (SELECT *, book AND static IS NULL AND seqfault IS NOT NULL AS broken,
      CASE WHEN coalesce(static, seqfault) IS NOT NULL THEN 'EXCLUDED' WHEN NOT book THEN 'NOT_APPLICABLE'
        WHEN NOT wanted THEN 'EXCLUDED' WHEN snap OR list_contains(seen, market) THEN 'ADMITTED' ELSE 'EXCLUDED' END AS status,
      CASE WHEN coalesce(static, seqfault) IS NOT NULL THEN coalesce(static, seqfault) WHEN NOT book THEN NULL WHEN market IS NULL THEN 'MISSING_MARKET_TICKER'
        WHEN NOT wanted THEN 'UNREQUESTED_MARKET_TICKER' WHEN snap OR list_contains(seen, market) THEN NULL ELSE 'DELTA_BEFORE_SNAPSHOT' END AS fault
    FROM (SELECT *, CASE verdict WHEN 'SEQUENCE_DUPLICATE' THEN verdict WHEN 'SEQUENCE_OUT_OF_ORDER' THEN verdict WHEN 'SEQUENCE_GAP_DETECTED' THEN 'SEQUENCE_GAP' END AS seqfault
      FROM (SELECT *, CASE WHEN NOT has_seq THEN 'SEQUENCE_NOT_OBSERVED' WHEN NOT known OR last0 IS NULL THEN 'SEQUENCE_PRESENT_SEMANTICS_UNKNOWN'
          WHEN sq = last0 THEN 'SEQUENCE_DUPLICATE' WHEN sq < last0 THEN 'SEQUENCE_OUT_OF_ORDER' WHEN sq = last0 + 1 THEN 'SEQUENCE_CONTIGUITY_VERIFIED'
          ELSE 'SEQUENCE_GAP_DETECTED' END AS verdict
        FROM (SELECT r.*, w.seen, w.made, CASE WHEN r.snap AND r.wanted AND len(w.seen) = 0 THEN NULL ELSE w.last END AS last0
          FROM w JOIN r ON r.cn = w.cn AND r.sub = w.sub AND r.n = w.n + 1)))))"""
RECD = """
recd AS (
  SELECT event_id AS e, event_id AS row_index, user_id, event_id // 40 AS sg, 'conn-' || ((event_id // 40) % 7) AS connection_id, 'seg-' || (event_id // 40) AS segment_id,
    ['INITIAL_CONNECTION', 'RESUBSCRIPTION', 'INTEGRITY_FAILURE'][(event_id // 40) % 3 + 1] AS boundary,
    CASE event_type WHEN 'signup' THEN 'orderbook_snapshot' WHEN 'purchase' THEN 'trade' WHEN 'error' THEN ['subscribed', 'error', 'heartbeat'][event_id % 3 + 1]
      ELSE 'orderbook_delta' END AS kind,
    CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 3 + 7 AS VARCHAR) END AS sid,
    CASE WHEN (event_id // 40) % 5 = 0 AND event_id % 11 = 0 THEN ['SEQUENCE_GAP_DETECTED', 'SEQUENCE_DUPLICATE'][event_id % 2 + 1]
      WHEN (event_id // 40) % 5 = 1 THEN ['SEQUENCE_NOT_OBSERVED', 'SEQUENCE_PRESENT_SEMANTICS_UNKNOWN'][event_id % 2 + 1]
      ELSE ['SEQUENCE_CONTIGUITY_VERIFIED', 'SEQUENCE_OBSERVED_MONOTONIC', 'SEQUENCE_NOT_OBSERVED', 'SEQUENCE_PRESENT_SEMANTICS_UNKNOWN'][event_id % 4 + 1] END AS st,
    ['ADMITTED', 'EXCLUDED', 'ADMITTED', 'NOT_APPLICABLE', 'ADMITTED'][event_id % 5 + 1] AS adm,
    ['ACKNOWLEDGED', 'REQUESTED', 'CONFLICTED'][event_id % 3 + 1] AS bst,
    CASE WHEN event_id % 23 <> 0 THEN 'M-' || (user_id % 10) END AS market_ticker
  FROM events
),
rch AS (SELECT *, CASE WHEN kind = 'trade' THEN 'trade' WHEN kind IN ('subscribed', 'error', 'heartbeat') THEN kind ELSE 'orderbook_delta' END AS channel FROM recd)"""


def trade_class(selected: str) -> str:
    return f"""CASE WHEN e % 37 = 0 THEN 'quarantined' WHEN kind <> 'trade' THEN 'ignored' WHEN e % 5 = 1 THEN 'quarantined'
  WHEN market_ticker IS NULL THEN 'quarantined' WHEN NOT ({selected}) THEN 'filtered' WHEN e % 31 = 0 THEN 'quarantined'
  WHEN user_id % 10 = 9 OR e % 29 = 0 THEN 'quarantined' ELSE 'trade' END"""


CAMP = """
camp AS (
  SELECT o_orderkey AS k, ['REST', 'WEBSOCKET_DELTA', 'WEBSOCKET_SNAPSHOT', 'SYNTHETIC', 'OTHER'][o_orderkey % 5 + 1] AS src,
    ['recorder_smoke_complete', 'websocket_campaign_complete', 'websocket_smoke_complete', 'websocket_blocked', 'smoke_complete', 'websocket_auth_blocked'][o_orderkey % 6 + 1] AS status,
    o_orderkey % 3 <> 2 AS ro, [600, 1200, 604800, 1800][o_orderkey % 4 + 1] AS dur,
    CASE WHEN o_orderkey % 53 = 0 THEN 'NO_WS_CREDENTIALS' WHEN o_orderkey % 59 = 0 THEN 'AUTH_SIGNATURE_FAILED' WHEN o_orderkey % 9 = 0 THEN 'DEMO_NO_ELIGIBLE_MARKET' END AS code,
    o_orderkey % 11 IN (2, 6) AS closed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 ELSE o_orderkey % 5 END AS events_
  FROM orders
),
cf AS (
  SELECT *, concat_ws('|', CASE WHEN k % 31 = 0 THEN 'live_gate_not_disabled' END, CASE WHEN k % 37 = 0 THEN 'production_endpoint_used' END,
    CASE WHEN k % 41 = 0 THEN 'submit_attempts' END, CASE WHEN dur > 1800 AND NOT ro THEN 'duration_exceeds_smoke_maximum' END,
    CASE WHEN src = 'OTHER' THEN 'source_type_unsupported' END, CASE WHEN k % 7 = 0 OR k % 4 = 0 THEN 'no_heartbeat' END,
    CASE WHEN k % 43 = 0 THEN 'unsafe_heartbeat' END, CASE WHEN k % 6 = 0 AND k % 5 = 0 THEN 'recorder_events_missing' END,
    CASE WHEN k % 6 = 0 AND k % 4 = 0 THEN 'rebuild_frames_missing' END, CASE WHEN k % 6 = 0 AND k % 3 = 0 THEN 'daily_validation_missing' END,
    CASE WHEN k % 47 = 0 THEN 'secret_like_field' END) AS failures FROM camp
)"""
MON = """
mon AS (
  SELECT o_orderkey AS k, 'run-' || (o_custkey % 25) AS run_id, o_orderkey % 7 AS t, o_orderstatus, o_orderdate FROM orders
),
fr AS (
  SELECT run_id, arg_min(k, k) FILTER (t = 1) AS rk, arg_min(o_orderstatus, k) FILTER (t = 1) AS rs, arg_min(k, k) FILTER (t = 2) AS lk,
    count(*) AS n, count(*) FILTER (t = 5) AS ev, count(DISTINCT CASE WHEN t = 5 THEN k % 40 END) AS mk,
    arg_max(o_orderdate, k) FILTER (t = 5) AS last_event, count(*) FILTER (k % 30 <> 0 AND k % 21 = 5) AS gaps,
    bool_or(k % 30 = 0) AS stale, bool_or(t = 6) AS sim, bool_or(t = 2) AS led, bool_or(t = 1) AS rsk, bool_or(t = 5) AS evs FROM mon GROUP BY run_id
),
ven AS (SELECT 'run-' || (o_custkey % 25) AS run_id, o_custkey % 25 AS r, max(o_orderdate) AS last_ts, count(*) AS n FROM orders GROUP BY 1, 2),
vst AS (SELECT *, CASE WHEN r % 3 = 0 THEN 30 ELSE greatest(0, CAST(ceil((epoch_us(TIMESTAMP '2001-08-01 00:10:00') - epoch_us(last_ts)) / 1000000.0) AS BIGINT)) END AS stale_s FROM ven)"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["scan_report"] = f"WITH {CAND} SELECT venue, {COUNTS} FROM cand GROUP BY venue"
    out["complement_candidate"] = f"""WITH {CAND}
SELECT {KEY} AS line_key, venue, market_id, {d6("yes_ask")} AS yes_ask, {d6("no_ask")} AS no_ask,
  {d6("gross")} AS gross_edge, {d6("net")} AS net_edge, {d6("size")} AS candidate_size,
  {d6("total")} AS total_edge, decision, {FLAGS} AS flags, {REASONS} AS rejection_reasons
FROM cand"""
    out["complement_from_canonical"] = (
        f"WITH {CAND} SELECT venue, fee_status, {COUNTS} FROM cand GROUP BY venue, fee_status"
    )
    out["fee_resolution"] = f"""WITH {TOP},
fees AS (SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN 'unknown' ELSE 'supplied' END AS st
  FROM supplier WHERE s_acctbal > 2000),
cand AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS venue, coalesce(st, 'missing') AS fee_status,
    CAST((yb + nb - 1 - CASE WHEN st = 'supplied' THEN 0.02 ELSE 0 END - CAST(0.005 AS {P})) AS {P}) AS net,
    yb + nb - 1 AS gross, least(ys, ns) AS size, stale
  FROM top LEFT JOIN fees ON l_suppkey = s_suppkey
),
dec AS (SELECT *, CAST(net * size AS DECIMAL(38,18)) AS total,
    CASE WHEN gross <= 0 THEN 'reject' WHEN stale OR size <= 0 OR fee_status <> 'supplied' THEN 'audit_only'
         WHEN net > 0.01 THEN 'paper_candidate' ELSE 'reject' END AS decision FROM cand)
SELECT venue, {COUNTS} FROM dec GROUP BY venue"""
    out["scan_label_counts"] = f"""WITH {CAND},
labels AS (
  SELECT 'rejection_reason' AS kind, unnest(string_split({REASONS}, '|')) AS label FROM cand
  UNION ALL SELECT 'data_flag', 'stale_book' FROM cand WHERE stale
)
SELECT kind, label, count(*) AS label_count FROM labels WHERE label <> '' GROUP BY kind, label"""
    out["scan_rollup"] = f"""WITH {CAND}
SELECT venue, decision, count(*) AS candidate_count FROM cand GROUP BY ROLLUP (venue, decision)"""
    out["fill_stress"] = f"""WITH {SCEN}
SELECT market_id, scenario, count(*) AS simulations, {d6("sum(least(fy, fn))")} AS completed,
  {d6("sum(abs(fy - fn))")} AS failed_leg, {d6("sum(CAST(pair_net * least(fy, fn) AS DECIMAL(38,18)))")} AS net_edge,
  {d6("sum(CAST(reserve * abs(fy - fn) AS DECIMAL(38,18)))")} AS reserve_total,
  {d6("sum(yes_ask + ysl)")} AS yes_price_sum, {d6("sum(no_ask + nsl)")} AS no_price_sum,
  count(*) FILTER (ysl > 0 OR nsl > 0) AS slippage_count, count(*) FILTER (lat > 0) AS latency_count,
  count(*) FILTER (reserve > 0) AS reserve_count
FROM filled GROUP BY market_id, scenario"""
    out["fill_summary"] = f"""WITH {SCEN}
SELECT venue, scenario, count(*) AS simulations, count(*) FILTER (fy <> fn) AS partial_fill_count,
  count(*) FILTER (fy = 0 AND fn = 0 AND tgt > 0) AS blocked_by_fok_depth_count
FROM filled GROUP BY venue, scenario"""
    out["fair_value"] = f"""WITH {TWO}
SELECT book_key, {d6("fv")} AS fair_value,
  CASE WHEN bid IS NULL AND ask IS NULL THEN 'empty_orderbook' END AS fair_value_error FROM fair"""
    out["quote_bands"] = f"""WITH {TWO},
skewed AS (
  SELECT *, least(greatest(CAST(inv * 0.001 AS DECIMAL(20,8)), -0.05), 0.05) AS skew,
    greatest(coalesce(CAST(ask - bid AS {P}), 0.02), 0.02) * 0.5 AS half FROM fair
),
adj AS (SELECT *, CASE WHEN fv IS NOT NULL THEN least(greatest(CAST(fv - skew AS DECIMAL(24,18)), 0), 1) END AS af FROM skewed),
grid AS (
  SELECT *, CAST(least(greatest(af - half, 0), 1) * 1000000 AS BIGINT) AS b6,
    CAST(least(greatest(af + half, 0), 1) * 1000000 AS BIGINT) AS a6 FROM adj
),
tick AS (SELECT *, (b6 // 100) AS bt, ((a6 + 99) // 100) AS sk FROM grid),
fixed AS (
  SELECT *, CASE WHEN bt < sk OR sk + 1 <= 10000 THEN bt WHEN bt - 1 >= 0 THEN bt - 1 END AS bt2,
    CASE WHEN bt < sk THEN sk WHEN sk + 1 <= 10000 THEN sk + 1 WHEN bt - 1 >= 0 THEN sk END AS at2 FROM tick
)
SELECT book_key, {d6("fv")} AS fair_value, {d6("af")} AS adjusted_fair_value, {d6("skew")} AS inventory_skew,
  CASE WHEN fv IS NOT NULL THEN bt2 / 10000.0::DOUBLE END AS bid_price,
  CASE WHEN fv IS NOT NULL THEN at2 / 10000.0::DOUBLE END AS ask_price,
  CASE WHEN fv IS NOT NULL THEN (at2 - bt2) / 10000.0::DOUBLE END AS target_spread FROM fixed"""
    out["risk_decisions"] = f"WITH {RISK} SELECT proposal_id, decision, reasons FROM decided"
    out["risk_report"] = (
        f"WITH {RISK} SELECT decision, count(*) AS risk_decision_count FROM decided GROUP BY decision"
    )
    out["proposal_join"] = f"""WITH {PROPOSE}
SELECT line_key, proposal_id, CASE WHEN completed > 0 THEN 2 ELSE 0 END AS leg_count,
  CASE WHEN proposal_id IS NULL THEN 'missing_simulation' ELSE concat_ws('|', 'manual_approval_required',
    CASE WHEN decision <> 'paper_candidate' THEN 'candidate_not_paper_candidate' END,
    CASE WHEN completed <= 0 THEN 'simulation_not_complete' END,
    CASE WHEN pair_net <= 0 THEN 'non_positive_simulated_edge' END,
    CASE WHEN failed > 0 THEN 'partial_fill_requires_review' END) END AS risk_reasons,
  {d6("completed")} AS completed FROM paired"""
    out["order_preview_screen"] = f"""WITH {PROPOSE},
screened AS (
  SELECT *, CASE WHEN completed > 0 THEN CAST((yfp + nfp) * completed AS DECIMAL(38,18)) ELSE 0 END AS notional
  FROM paired WHERE proposal_id IS NOT NULL
),
named AS (
  SELECT *, CASE WHEN completed <= 0 THEN 'leg_count'
    WHEN yfp NOT BETWEEN 0 AND 1 OR nfp NOT BETWEEN 0 AND 1 THEN 'price_range'
    WHEN completed > 25 THEN 'leg_quantity_limit' WHEN completed <> floor(completed) THEN 'whole_contracts_required'
    WHEN yfp <> CAST(yfp AS DECIMAL(4,2)) OR nfp <> CAST(nfp AS DECIMAL(4,2)) THEN 'cent_precision_required'
    WHEN notional > 20 THEN 'total_notional_limit' END AS blocked_by FROM screened
)
SELECT proposal_id, line_key, blocked_by, {d6("notional")} AS total_notional,
  CASE WHEN blocked_by IS NULL THEN 'demo-' || substr(proposal_id, 1, 16) || '-yes-fok' END AS first_order_id
FROM named"""
    out["limit_screen"] = f"""WITH req AS (
  SELECT {KEY} AS request_id, *, CAST(l_discount AS DECIMAL(10,4)) * 10 AS price, CAST(l_quantity AS DECIMAL(14,2)) AS qty,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS DECIMAL(14,2)) AS signed FROM lineitem
),
named AS (
  SELECT request_id, CASE WHEN l_linenumber = 7 THEN 'execution_mode' WHEN l_suppkey % 13 = 0 THEN 'base_url'
    WHEN l_partkey % 17 = 0 THEN 'demo_opt_in' WHEN price NOT BETWEEN 0 AND 1 THEN 'price_boundary'
    WHEN qty > 45 THEN 'max_order_quantity' WHEN price * qty > 25 THEN 'max_notional'
    WHEN abs(l_linenumber * 5 + signed) > 40 THEN 'max_position_abs'
    WHEN abs(l_linenumber * 7 - 20 + signed) > 40 THEN 'max_inventory_abs'
    WHEN CAST(l_tax * 100 AS DECIMAL(14,2)) > 7 THEN 'max_daily_loss' END AS limit_name FROM req
)
SELECT request_id, limit_name, limit_name IS NULL AS approved FROM named"""
    out["book_normalize_yes_no"] = f"""WITH {YN}
SELECT event_id, instrument_id, CASE WHEN bb >= ba THEN 'locked_or_crossed' ELSE '' END AS errors,
  {d6("bb")} AS best_bid, {d6("ba")} AS best_ask, {d6("ba - bb")} AS spread, {d6("(ba + bb) * 0.5")} AS mid,
  CASE WHEN bb IS NULL THEN 0.0 ELSE 12.0 END::DOUBLE AS bid_depth, 10.0::DOUBLE AS ask_depth,
  CASE WHEN bb IS NULL THEN 0 ELSE 2 END AS bid_level_count, 2 AS ask_level_count FROM yn"""
    out["book_normalize_bid_offer"] = f"""WITH bo AS (
  SELECT event_id, 'slug-' || (user_id % 10) AS instrument_id,
    CASE WHEN event_id % 11 <> 0 THEN CAST((event_id % 40 + 10) / 100.0 AS DECIMAL(6,2)) END AS bb,
    CASE WHEN event_id % 11 <> 0 THEN CAST((event_id % 30 + 45) / 100.0 AS DECIMAL(6,2)) END AS ba FROM events
)
SELECT event_id, instrument_id, CASE WHEN bb IS NULL THEN 'empty_orderbook' WHEN bb >= ba THEN 'locked_or_crossed' ELSE '' END AS errors,
  {d6("bb")} AS best_bid, {d6("ba")} AS best_ask, {d6("ba - bb")} AS spread, {d6("(ba + bb) * 0.5")} AS mid,
  CASE WHEN bb IS NULL THEN 0.0 ELSE 3.0 END::DOUBLE AS bid_depth,
  CASE WHEN bb IS NULL THEN 0.0 ELSE event_id % 7 + 1 END::DOUBLE AS ask_depth,
  CASE WHEN bb IS NULL THEN 0 ELSE 1 END AS bid_level_count, CASE WHEN bb IS NULL THEN 0 ELSE 1 END AS ask_level_count FROM bo"""
    out["book_validity"] = f"""WITH {YN}
SELECT instrument_id, CASE WHEN bb >= ba THEN 'locked_or_crossed' ELSE 'valid' END AS state, count(*) AS book_count
FROM yn GROUP BY 1, 2"""
    out["book_metrics"] = f"""WITH {YN}
SELECT instrument_id, count(*) AS snapshot_count, {d6("max(bb)")} AS max_bid, {d6("min(ba)")} AS min_ask,
  {d6("sum(ba - bb)")} AS spread_sum, {d6("sum(CASE WHEN bb IS NULL THEN 0 ELSE 12 END)")} AS bid_depth_sum,
  {d6("sum(10)")} AS ask_depth_sum FROM yn GROUP BY 1"""
    out["book_quality_flags"] = """SELECT concat_ws('|', CASE WHEN event_id % 11 = 0 THEN 'one_sided_book' END,
  CASE WHEN event_id % 6 = 0 THEN 'non_open_market' END) AS labels, count(*) AS book_count FROM events GROUP BY 1"""
    txt = lambda c: f"rtrim(CAST({c} AS VARCHAR), '0')"
    lvl = lambda p, q: f"""'{{"price":"' || {txt(p)} || '","quantity":"{q}"}}'"""
    out["book_hash"] = f"""WITH {YN}
SELECT event_id, sha256('{{"asks":[' || {lvl("ba", 4)} || ',' || {lvl("a2", 6)} || '],"bids":['
  || CASE WHEN bb IS NULL THEN '' ELSE {lvl("bb", 7)} || ',' || {lvl("b2", 5)} END
  || '],"instrument_id":"' || instrument_id || '","source":"kalshi_orderbook_fp"}}') AS book_hash FROM yn"""
    out["feed_consistency"] = f"""WITH {FEED}
SELECT event_id, venue, market_id, sequence, concat_ws('|', CASE WHEN {GAP} THEN 'sequence_gap' END,
  CASE WHEN {OOO} THEN 'out_of_order' END, CASE WHEN {STALE} THEN 'stale_event' END) AS flags FROM flagged"""
    out["feed_consistency_summary"] = f"""WITH {FEED}
SELECT market_id, count(*) AS events_read, count(*) FILTER ({GAP}) AS sequence_gap_count,
  count(*) FILTER ({STALE}) AS stale_count, count(*) FILTER ({OOO}) AS out_of_order_count FROM flagged GROUP BY 1"""
    out["replay_frames"] = f"""WITH {FEED}
SELECT 'strict' AS mode, event_id, row_number() OVER (PARTITION BY market_id ORDER BY event_id) AS frame_sequence,
  coalesce(observed_at < lag(observed_at) OVER (PARTITION BY market_id ORDER BY event_id), false) AS order_violation FROM feed
UNION ALL
SELECT 'lenient', event_id, row_number() OVER (PARTITION BY market_id ORDER BY observed_at, event_id), false FROM feed"""
    out["book_rebuild"] = f"""WITH {MSG}
SELECT row_index, market_ticker, connection_id, epoch, disposition,
  CASE WHEN snap AND perr IS NOT NULL THEN perr WHEN row_index = bad_from THEN bad_reason
       WHEN disposition = 'EXCLUDED' THEN 'SEGMENT_INVALID' END AS reason,
  CASE WHEN good THEN CASE WHEN after_bad THEN 'RECOVERY_AFTER_INVALIDATION' WHEN epoch = 1 THEN 'INITIAL_SNAPSHOT'
    ELSE 'RESNAPSHOT_SAME_SEGMENT' END END AS reset_reason,
  CAST(sum(CASE WHEN disposition = 'FRAME_EMITTED' THEN 1 ELSE 0 END) OVER (
    PARTITION BY market_ticker, connection_id ORDER BY row_index) AS BIGINT) AS frame_count FROM disp"""
    out["book_frames"] = f"""WITH {TOB}
SELECT row_index, market_ticker, {d6("bb")} AS best_bid, {d6("bs")} AS best_bid_size, {d6("1 - nb")} AS best_ask,
  {d6("asz")} AS best_ask_size, bl AS bid_level_count, al AS ask_level_count,
  CASE WHEN bl = 0 AND al = 0 THEN 'EMPTY' WHEN al = 0 THEN 'YES_BIDS_ONLY' WHEN bl = 0 THEN 'YES_ASKS_ONLY'
    WHEN bb > 1 - nb THEN 'CROSSED' WHEN bb = 1 - nb THEN 'LOCKED' ELSE 'TWO_SIDED' END AS book_state FROM tob"""
    out["fifo_attribution"] = f"""WITH {FIFO},
g AS (SELECT user_id, sum(gain) AS gross FROM pieces GROUP BY 1),
t AS (SELECT user_id, count(*) AS c, CAST(count(*) AS DECIMAL(18,2)) * 0.01 AS fees, sum(CASE WHEN buy THEN qty ELSE -qty END) AS inv FROM fl GROUP BY 1)
SELECT CAST(t.user_id AS VARCHAR) AS instrument_id, c AS supplied_fills, {d6("fees")} AS total_fees,
  {d6("coalesce(gross, 0)")} AS realized_gross_pnl, {d6("coalesce(gross, 0) - fees")} AS realized_net_pnl,
  {d6("inv")} AS ending_inventory FROM t LEFT JOIN g USING (user_id)"""
    out["paper_ledger"] = f"""WITH {LEDGER}
SELECT proposal_id, side, st.q AS quantity, round(CASE WHEN st.q > 0 THEN st.c / st.q ELSE 0 END, 10) AS average_price,
  {d6("fees")} AS fees_paid FROM folded WHERE st.x"""
    out["paper_ledger_state"] = f"""WITH {LEDGER}
SELECT (SELECT count(*) FROM prop) AS paper_order_count, (SELECT count(*) FROM rows WHERE fill) AS paper_fill_count,
  (SELECT count(*) FROM rows WHERE NOT fill) AS settlement_count,
  CAST((SELECT count(*) FROM linked WHERE mismatch IS NOT NULL) + (SELECT sum(len(st.bad)) FROM folded) AS BIGINT) AS reconciliation_mismatch_count,
  round((SELECT sum(fees) FROM folded), 4) AS total_fees, round((SELECT sum(st.g) FROM folded), 4) AS realized_gross_pnl,
  round((SELECT sum(st.g) - sum(fees) FROM folded), 4) AS realized_net_pnl"""
    out["paper_ledger_mismatches"] = f"""WITH {LEDGER}
SELECT event_key, proposal_id, mismatch AS reason FROM linked WHERE mismatch IS NOT NULL
UNION ALL SELECT unnest(st.bad), proposal_id, 'settlement_exceeds_position' FROM folded"""
    out["reconcile_orders"] = f"""WITH {DEMO}
SELECT audit_id, client_order_id, accepted, rejected, canceled, errored, timed_out, {d6("total")} AS filled_quantity,
  round(CASE WHEN total > 0 THEN CAST(cost AS DOUBLE) / total ELSE 0 END, 10) AS average_fill_price, total = 20 AS fully_filled FROM st"""
    out["reconcile_mismatches"] = f"WITH {DEMO} SELECT audit_id, client_order_id, event_id, ord, reason FROM mm"
    kinds = ("accepted", "rejected", "partial_fill", "full_fill", "cancel", "error", "timeout", "backfill")
    counts = ", ".join(
        f"count(*) FILTER (link IS NULL AND event_type = '{k}')"
        + ("" if k == "backfill" else f" + count(*) FILTER (link IS NULL AND event_type = 'backfill' AND kind = '{k}')")
        + f" AS {k}_count"
        for k in kinds
    )
    out["reconcile_state"] = f"""WITH {DEMO},
oc AS (SELECT audit_id, count(*) AS order_count FROM orders_ GROUP BY 1),
mc AS (SELECT audit_id, count(*) AS mismatch_count FROM mm GROUP BY 1),
cc AS (SELECT audit_id, {counts}, count(*) FILTER (link = 'duplicate') AS duplicate_event_count FROM lnk GROUP BY 1)
SELECT oc.audit_id, order_count, {", ".join(f"coalesce({k}_count, 0) AS {k}_count" for k in kinds)},
  coalesce(duplicate_event_count, 0) AS duplicate_event_count, coalesce(mismatch_count, 0) AS mismatch_count,
  coalesce(mismatch_count, 0) = 0 AS submit_eligible
FROM oc LEFT JOIN cc USING (audit_id) LEFT JOIN mc USING (audit_id)"""
    out["daily_report"] = f"""WITH {REC}
SELECT CAST(d AS VARCHAR) AS report_date, count(*) FILTER (t = 1 AND o_orderstatus <> 'P') AS recorder_uptime_count,
  count(*) FILTER (t = 1 AND o_orderstatus = 'P') AS recorder_downtime_count,
  {d6("coalesce(max(CASE WHEN t = 1 THEN o_custkey % 100 END), 0)")} AS max_data_lag_seconds,
  CAST(count(*) FILTER (gapf) + coalesce(sum(CASE WHEN t = 1 THEN k % 3 END), 0) AS BIGINT) AS gap_count,
  count(*) FILTER (t = 0) AS candidate_count, count(*) FILTER (t = 0 AND decision = 'paper_candidate') AS paper_candidate_count,
  count(*) FILTER (t = 0 AND decision = 'audit_only') AS audit_only_count, count(*) FILTER (t = 0 AND decision = 'reject') AS reject_count,
  count(*) FILTER (t = 4) AS paper_outcome_count, count(*) FILTER (t = 5) AS demo_outcome_count,
  {d6("coalesce(sum(CASE WHEN t = 2 THEN k % 7 END), 0)")} AS total_fees,
  count(*) FILTER (t = 3 AND NOT gapf AND k % 2 = 1) AS slippage_incident_count,
  count(*) FILTER (t = 3 AND k % 4 > 0) AS failed_leg_incident_count,
  count(*) FILTER (t = 2 AND k % 5 = 0) AS reconciliation_mismatch_count,
  count(*) FILTER (t = 4 AND k % 11 = 0) AS kill_switch_event_count FROM rec GROUP BY d"""
    out["daily_rejections"] = f"""WITH {REC}
SELECT CAST(d AS VARCHAR) AS report_date, reason, count(*) AS reason_count FROM (
  SELECT d, unnest(CASE WHEN k % 3 = 0 THEN ['no_complement_edge', 'not_paper_candidate'] ELSE ['not_paper_candidate'] END) AS reason
  FROM rec WHERE t = 0 AND decision = 'reject') GROUP BY 1, 2"""
    out["rolling_windows"] = f"""WITH {REC},
w AS (SELECT * FROM rec CROSS JOIN (VALUES (7), (30), (90)) v(days)
  WHERE d IS NULL OR (d <= DATE '2001-08-01' AND date_diff('day', d, DATE '2001-08-01') < days)),
a AS (
  SELECT days AS window_days, count(*) FILTER (t = 0) AS candidate_count,
    count(*) FILTER (t = 0 AND decision = 'paper_candidate') AS paper_candidate_count,
    CAST(coalesce(sum(CASE WHEN t = 6 AND o_custkey % 2 <> 0 THEN 2 END), 0) AS BIGINT) AS demo_order_count,
    coalesce(sum(CASE WHEN t = 7 THEN k % 3 END), 0) AS rec_n, coalesce(sum(CASE WHEN t = 7 THEN k % 2 END), 0) AS full_n,
    count(*) FILTER (t = 7 AND k % 3 = 1) AS part_n, count(*) FILTER (t = 3 AND k % 4 > 0) AS failed_leg_incident_count,
    {d6("coalesce(sum(CASE WHEN t = 0 THEN 0.02 * (k % 50) END), 0)")} AS gross_edge,
    {d6("coalesce(sum(CASE t WHEN 0 THEN 0.01 * (k % 50) WHEN 3 THEN 0.1 * (k % 9) END), 0)")} AS net_edge_after_cost,
    {d6("coalesce(sum(CASE WHEN t = 2 THEN pnl END), 0)")} AS paper_pnl,
    {d6("coalesce(sum(CASE WHEN t = 5 THEN CAST(-pnl * 0.5 AS DECIMAL(20,6)) END), 0)")} AS demo_pnl,
    count(*) FILTER ((t = 2 AND k % 5 = 0) OR (t = 7 AND k % 10 = 7)) AS reconciliation_mismatch_count,
    CAST(coalesce(sum(CASE WHEN t = 1 THEN k % 3 END), 0) + count(*) FILTER (gapf) AS BIGINT) AS data_gap_count,
    count(*) FILTER (t = 4 AND k % 11 = 0) AS kill_switch_event_count, count(*) FILTER (k % 101 = 0) AS false_positive_style_rejection_count,
    count(*) FILTER (d IS NULL) AS undated_record_count FROM w GROUP BY days
)
SELECT * EXCLUDE (rec_n, full_n, part_n), CAST(DATE '2001-08-01' - (window_days - 1) AS VARCHAR) AS start_date, '2001-08-01' AS end_date,
  round(CASE WHEN demo_order_count <> 0 THEN full_n / demo_order_count WHEN rec_n = 0 THEN 0 ELSE full_n / rec_n END, 10) AS fill_success_rate,
  round(CASE WHEN demo_order_count <> 0 THEN part_n / demo_order_count WHEN rec_n = 0 THEN 0 ELSE part_n / rec_n END, 10) AS partial_fill_rate
FROM a"""
    out["max_drawdown"] = f"""WITH {REC},
w AS (SELECT days, k, p, coalesce(d, DATE '2001-08-01' - (days - 1)) AS day FROM pnls CROSS JOIN (VALUES (7), (30), (90), (2500)) v(days)
  WHERE p <> 0 AND (d IS NULL OR (d <= DATE '2001-08-01' AND date_diff('day', d, DATE '2001-08-01') < days))),
e AS (SELECT *, sum(p) OVER (PARTITION BY days ORDER BY day, k) AS eq FROM w),
pk AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY days ORDER BY day, k)) AS peak FROM e)
SELECT days AS window_days, {d6("max(peak - eq)")} AS max_drawdown FROM pk GROUP BY days"""
    names = (
        "offline_complement_research_candidate", "recorder_status", "paper_ledger_state",
        "offline_taker_fill_simulation", "manual_approval_decision", "demo_outcome",
        "kalshi_demo_submission_preview", "kalshi_demo_reconciliation_state",
    )
    listed = ", ".join(f"'{n}'" for n in names)
    out["artifact_counts"] = f"SELECT [{listed}][o_orderkey % 8 + 1] AS record_type, count(*) AS artifact_count FROM orders GROUP BY 1"
    out["unmet_prerequisites"] = f"""WITH {REC}
SELECT concat_ws('|', 'missing real 30-90 day live-readonly data', CASE WHEN count(*) FILTER (
    ((t = 2 AND k % 5 = 0) OR (t = 7 AND k % 10 = 7)) AND (d IS NULL OR (d <= DATE '2001-08-01' AND date_diff('day', d, DATE '2001-08-01') < 90))) > 0
  THEN 'unresolved reconciliation mismatch status' END, 'unvalidated fee/slippage assumptions', 'missing legal/platform review') AS prerequisites_unmet FROM rec"""
    out["log_counts"] = """WITH l AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'frame' WHEN 'click' THEN 'quote_candidate'
  WHEN 'view' THEN 'risk_decision' WHEN 'error' THEN 'lifecycle_intent' ELSE 'adapter_submission' END AS record_type FROM events)
SELECT record_type, count(*) AS record_count, count(*) FILTER (record_type = 'risk_decision' AND event_id % 3 = 0) AS risk_approval_count,
  count(*) FILTER (record_type = 'risk_decision' AND event_id % 3 <> 0) AS risk_rejection_count,
  count(*) FILTER (record_type = 'lifecycle_intent' AND event_id % 4 = 0) AS skipped_action_count FROM l GROUP BY 1"""
    out["connection_windows"] = f"""WITH {CONN}
SELECT run_id, connection_id, segment_ids, epoch_us(opened_at) AS opened_at, epoch_us(closed_at) AS closed_at, error_count, event_count,
  {d6("us / 1000000.0")} AS duration_seconds FROM windows JOIN segs USING (connection_id)"""
    out["disconnect_gaps"] = f"""WITH {CONN}
SELECT run_id, gap_kind, epoch_us(a) AS gap_from, epoch_us(b) AS gap_to, {d6("(epoch_us(b) - epoch_us(a)) / 1000000.0")} AS gap_seconds FROM gaps"""
    out["window_overlaps"] = f"""WITH {CONN},
sh AS (SELECT 'R-' || (CAST(regexp_extract(run_id, '([0-9]+)', 1) AS BIGINT) % 5) AS run_id, connection_id, opened_at, closed_at FROM windows WHERE opened_at IS NOT NULL),
lg AS (SELECT *, lag(closed_at) OVER (PARTITION BY run_id ORDER BY opened_at, connection_id) AS pc FROM sh)
SELECT run_id, count(*) AS overlap_count FROM lg WHERE opened_at < pc GROUP BY 1"""
    out["coverage"] = f"""WITH {CONN},
o AS (SELECT run_id, sum(us) AS us FROM windows GROUP BY 1), m AS (SELECT run_id, max(epoch_us(b) - epoch_us(a)) AS g FROM gaps GROUP BY 1)
SELECT run_id, {d6("(epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0")} AS actual_seconds, {d6("coalesce(us, 0) / 1000000.0")} AS connected_seconds,
  round(coalesce(us, 0) / (epoch_us(ended_at) - epoch_us(started_at)), 10) AS coverage, {d6("coalesce(g, 0) / 1000000.0")} AS max_gap_seconds
FROM runs LEFT JOIN o USING (run_id) LEFT JOIN m USING (run_id)"""
    out["max_quiet_gap"] = f"""WITH {CONN},
lg AS (SELECT run_id, obs, ts, lag(ts) OVER (PARTITION BY run_id, obs ORDER BY ts) AS p FROM ce),
ag AS (SELECT run_id, obs, max({CEIL.format("ts", "p")}) AS g, min(ts) AS f, max(ts) AS l, count(*) AS n FROM lg GROUP BY 1, 2)
SELECT run_id, obs AS kind, n AS observation_count, greatest(0, coalesce(g, 0), {CEIL.format("f", "started_at")}, {CEIL.format("ended_at", "l")}) AS max_gap_seconds,
  greatest(0, {CEIL.format("ended_at", "l")}) AS last_age_seconds FROM ag JOIN runs USING (run_id)"""
    late = lambda kind: CEIL.format("TIMESTAMP '2024-02-01'", f"max(CASE WHEN obs = '{kind}' THEN ts END)")
    out["freshness"] = f"""WITH {CONN}
SELECT run_id, CASE WHEN count(*) FILTER (obs = 'keepalive') > 0 THEN 'OBSERVED' ELSE 'UNKNOWN_NOT_OBSERVED' END AS transport_keepalive_status,
  {late("keepalive")} AS transport_keepalive_age_seconds, {late("lifecycle")} AS lifecycle_observation_age_seconds,
  {late("orderbook")} AS orderbook_event_quiet_interval_seconds, max(ts) > TIMESTAMP '2024-02-01' AS observed_in_future FROM ce GROUP BY run_id"""
    out["lifecycle_observations"] = f"""WITH l AS (SELECT event_id, {K} * 60 AS age,
  ['open', 'unopened', 'settled', 'paused', 'closed', 'mystery', 'open'][event_id % 7 + 1] AS normalized_status FROM events)
SELECT event_id, normalized_status, CASE WHEN normalized_status = 'mystery' THEN 'UNKNOWN' ELSE upper(normalized_status) END AS lifecycle_status,
  age AS observation_age_seconds, CASE WHEN event_id % 19 = 0 THEN 'MVE_UNSUPPORTED' WHEN age > 3000 THEN 'STALE'
    WHEN normalized_status = 'mystery' THEN 'UNKNOWN_STATUS' ELSE 'VALID' END AS validity, event_id % 8 <> 0 AS identity_ok FROM l"""
    out["run_order_violations"] = f"""WITH r AS (
  SELECT 'R-' || (event_id // 100) AS run_id, event_id % 100 + CASE WHEN event_id % 23 = 0 THEN 2 ELSE 1 END AS idx,
    CASE WHEN event_id % 31 = 0 THEN event_id % 100 ELSE event_id % 100 + 1000 END AS cmd, event_id % 2 AS ch,
    (event_id % 100) // 2 + CASE WHEN event_id % 37 = 0 THEN 3 ELSE 1 END AS gen, ts - to_minutes({K} % 10) AS created_at, event_id AS ord FROM events
),
s AS (SELECT *, lag(idx) OVER (PARTITION BY run_id ORDER BY ord) AS pi, lag(created_at) OVER (PARTITION BY run_id ORDER BY ord) AS pt,
  lag(gen) OVER (PARTITION BY run_id, ch ORDER BY ord) AS pg, min(ord) OVER (PARTITION BY run_id, cmd) AS fo FROM r)
SELECT run_id, ord, unnest(list_filter([CASE WHEN idx <> coalesce(pi, 0) + 1 THEN 'request_index_not_contiguous' END,
  CASE WHEN gen <> coalesce(pg, 0) + 1 THEN 'generation_not_contiguous' END, CASE WHEN ord <> fo THEN 'command_id_reused' END,
  CASE WHEN created_at < pt THEN 'chronology_backwards' END], lambda x: x IS NOT NULL)) AS violation FROM s"""
    src = """CASE WHEN dl = close_at THEN 'close_time' WHEN dl = exp_at THEN 'expected_expiration_time'
    WHEN dl = early_at THEN 'early_close_deadline' WHEN dl = ob THEN 'occurrence_safety_bound' END"""
    out["market_selection"] = f"""WITH {MKT}
SELECT ord, profile AS selection_profile, CASE WHEN len(rs) = 0 THEN 'pass' ELSE 'reject' END AS selection_gate_result,
  rs[1] AS primary_rejection_reason, array_to_string(rs, '|') AS reasons, oc AS occurrence_class, dual AS dual_interpretation_pass,
  {SECS.format("close_at", T0)} AS seconds_to_close, CAST(trunc((epoch_us(dl) - epoch_us({T0})) / 1000000.0) AS BIGINT) AS seconds_to_deadline,
  {src} AS lifecycle_deadline_source, CASE WHEN status IN ('open', 'trading') THEN 'OPEN' WHEN status = 'closed' THEN 'CLOSED_OR_FINALIZED'
    ELSE 'UNKNOWN' END AS market_lifecycle_status FROM rej"""
    out["discovery_audit"] = f"""WITH {MKT},
c AS (SELECT *, list_sort(rs) AS so FROM rej WHERE profile = 'canary'),
lab AS (
  SELECT 'primary' AS section, rs[1] AS label FROM c WHERE len(rs) > 0
  UNION ALL SELECT 'multi_label', unnest(rs) FROM c
  UNION ALL SELECT 'overlap', a.r || '|' || b.r FROM (SELECT k, unnest(rs) AS r FROM c) a JOIN (SELECT k, unnest(rs) AS r FROM c) b ON a.k = b.k AND a.r < b.r
  UNION ALL SELECT 'occurrence', oc FROM c
  UNION ALL SELECT 'occurrence_equals', 'equals_close_time' FROM c WHERE occ_at = close_at
  UNION ALL SELECT 'occurrence_equals', 'equals_expected_expiration_time' FROM c WHERE occ_at = exp_at
  UNION ALL SELECT 'dual_interpretation', 'pass' FROM c WHERE dual
)
SELECT section, label, count(*) AS row_count FROM lab GROUP BY 1, 2"""
    out["near_miss_topk"] = f"""WITH {MKT}
SELECT substr(sha256(ident), 1, 16) AS market_id_hash, substr(sha256(event_ticker), 1, 16) AS event_id_hash,
  CAST((epoch_us(dl) - epoch_us(fin)) // 1000000 AS BIGINT) AS lifecycle_margin_seconds, {SECS.format("close_at", "fin")} AS close_margin_seconds,
  {SECS.format("exp_at", "fin")} AS expiration_margin_seconds, {SECS.format("ob", "fin")} AS occurrence_margin_seconds,
  CASE WHEN cat = 'Sports' THEN 'sports' ELSE 'non_sports' END AS event_category_class, is_match AS match_like, quoted AS current_quote, ce AS closes_early
FROM rej WHERE profile = 'canary'
ORDER BY abs(epoch_us(dl) - epoch_us(fin)) NULLS LAST, coalesce(substr(sha256(ident), 1, 16), ''), coalesce(substr(sha256(event_ticker), 1, 16), '') LIMIT 100"""
    out["candidate_rank"] = f"""WITH {MKT}, c AS (SELECT * FROM rej WHERE profile = 'canary')
SELECT 'activity' AS mode, ord, row_number() OVER (ORDER BY {RANKA}) AS candidate_rank FROM c
UNION ALL SELECT 'deadline', ord, row_number() OVER (ORDER BY {RANKD}) FROM c"""
    out["eligible_candidates"] = f"""WITH {MKT},
r AS (SELECT ord, lvl > 2 AS eligible, row_number() OVER (ORDER BY {RANKA}) AS candidate_rank FROM rej WHERE profile = 'canary'),
e AS (SELECT *, coalesce(sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (ORDER BY candidate_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM r)
SELECT ord, candidate_rank, eligible FROM e WHERE n < 12"""
    out["market_dedupe"] = """WITH d AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 41 = 0 THEN 'MKT ' ELSE 'MKT-' END || (p_partkey // 3) AS ticker,
  p_partkey % 41 = 0 AS bad FROM part)
SELECT ord, ticker, 0 AS duplicate_count FROM d WHERE bad
UNION ALL SELECT min(ord), ticker, count(*) - 1 FROM d WHERE NOT bad GROUP BY ticker"""
    out["market_event_enrich"] = f"""WITH {MKT}
SELECT ord, event_ticker, cat AS event_category, etitle AS event_title, cat IS NOT NULL AS event_metadata_fetched, event_reason FROM enr"""
    out["event_identity_check"] = f"""WITH {MKT} SELECT ord, event_ticker, ord % 10 <> 3 AS identity_ok FROM evs"""
    out["missing_events"] = f"""WITH {MKT} SELECT DISTINCT event_ticker FROM mk WHERE event_ticker IS NOT NULL
  AND event_ticker NOT IN (SELECT event_ticker FROM evs WHERE ord % 3 = 0)"""
    out["market_status_normalize"] = f"""WITH {MKT}
SELECT nullif(status, '') AS raw_status, CASE status WHEN 'active' THEN 'open' WHEN 'inactive' THEN 'paused' WHEN '' THEN NULL ELSE status END AS status,
  count(*) AS market_count FROM mk GROUP BY 1, 2"""
    out["market_identity_check"] = f"""WITH {MKT}
SELECT ord, ident AS market_identity, CASE WHEN k % 41 = 0 THEN 'identity_not_exact' WHEN k % 43 = 0 THEN 'aliases_differ' END AS identity_error FROM mk"""
    out["market_activity"] = f"""WITH {MKT} SELECT ord, {d6("activity")} AS activity, quoted AS current_quote, is_match AS match_like FROM mk"""
    out["native_envelope"] = f"""WITH {NATIVE}
SELECT ord, kind AS native_type, coalesce(ch, CASE WHEN kind IN ('orderbook_snapshot', 'orderbook_delta') THEN 'orderbook_delta' ELSE kind END) AS channel,
  CAST(rid AS VARCHAR) AS request_id, CAST(sid_ AS VARCHAR) AS sid,
  CASE WHEN sid_ IS NULL AND kind = 'subscribed' THEN 'MISSING_ACK_SID' WHEN sid_ IS NULL AND kind IN ('orderbook_snapshot', 'orderbook_delta', 'trade')
    THEN 'MISSING_DATA_SID' END AS envelope_rejection, CASE WHEN e % 59 <> 0 THEN 'M-' || (user_id % 3) END AS market_ticker,
  CASE WHEN e % 61 <> 0 THEN CAST(sq AS VARCHAR) END AS seq, CASE WHEN ch IS NULL THEN 'derived_from_type' ELSE 'top_level' END AS channel_source,
  CASE WHEN sid_ IS NULL THEN 'missing' ELSE 'top_level' END AS sid_source FROM natd"""
    tok = """['true', 'false', '"yes"', '1'][event_id % 4 + 1]"""
    out["pricing_values"] = f"""SELECT event_id, concat_ws('|', CASE WHEN event_id % 5 = 0 THEN NULL END,
  CASE WHEN event_id % 3 = 0 THEN {tok} END, CASE WHEN event_id % 5 = 0 THEN {tok} END,
  CASE WHEN event_id % 7 = 0 THEN {tok} END) AS pricing_values FROM events"""
    out["sequence_summary"] = f"""WITH {RECD}
SELECT connection_id, segment_id, any_value(boundary) AS segment_boundary_reasons, array_to_string(list_sort(list_distinct(list(sid) FILTER (sid IS NOT NULL))), '|') AS native_sid_values,
  count(*) FILTER (e % 17 <> 0) AS native_seq_present_count,
  (SELECT string_agg(st || '=' || n, '|' ORDER BY st) FROM (SELECT st, count(*) AS n FROM recd x WHERE x.segment_id = recd.segment_id GROUP BY st)) AS sequence_states,
  count(*) FILTER (adm = 'ADMITTED') AS admitted_rows, count(*) FILTER (adm = 'EXCLUDED') AS excluded_rows,
  count(*) FILTER (kind = 'subscribed') AS acknowledgement_count, count(*) FILTER (kind = 'error') AS rejection_count,
  bool_or(st = 'SEQUENCE_CONTIGUITY_VERIFIED') AS continuity_semantics_supported,
  CASE WHEN bool_or(st IN ('SEQUENCE_GAP_DETECTED', 'SEQUENCE_DUPLICATE')) THEN 'SEQUENCE_INTEGRITY_FAIL'
    WHEN bool_or(st = 'SEQUENCE_CONTIGUITY_VERIFIED') THEN 'SEQUENCE_CONTIGUITY_VERIFIED' ELSE 'SEQUENCE_INTEGRITY_UNKNOWN' END AS aggregate_result
FROM recd GROUP BY connection_id, segment_id"""
    out["sequence_evidence"] = f"""WITH {RECD},
g AS (SELECT connection_id, segment_id, bool_or(st IN ('SEQUENCE_GAP_DETECTED', 'SEQUENCE_DUPLICATE')) AS b, bool_or(st = 'SEQUENCE_CONTIGUITY_VERIFIED') AS c FROM recd GROUP BY 1, 2)
SELECT connection_id, CASE WHEN bool_or(b) THEN 'FAIL' WHEN bool_and(c) THEN 'PASS' ELSE 'UNKNOWN' END AS sequence_integrity FROM g GROUP BY 1"""
    st_ = lambda c: f"coalesce(array_to_string(list_sort(list_distinct(list({c}) FILTER ({c} IS NOT NULL))), '|'), '')"
    out["binding_summary"] = f"""WITH {RECD},
b AS (SELECT *, CAST(e // 200 + 1 AS VARCHAR) AS cmd, CAST(e // 400 + 1 AS VARCHAR) AS gen, 'b-' || (e // 400) AS bid FROM rch WHERE e % 19 <> 0)
SELECT connection_id, segment_id, channel, {st_("cmd")} AS command_ids, {st_("gen")} AS generations, {st_("bid")} AS binding_ids,
  {st_("sid")} AS native_sids, {st_("bst")} AS states FROM b GROUP BY 1, 2, 3"""
    out["rebuild_summary"] = f"""WITH {MSG},
r AS (SELECT *, disposition = 'FRAME_EMITTED' AS fr, CASE WHEN snap AND perr IS NOT NULL THEN perr WHEN row_index = bad_from THEN bad_reason
    WHEN disposition = 'EXCLUDED' THEN 'SEGMENT_INVALID' END AS reason FROM disp),
h AS (SELECT market_ticker, connection_id, string_agg(reason || '=' || n, '|' ORDER BY reason) AS inv FROM
  (SELECT market_ticker, connection_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT market_ticker, connection_id, 'seg-1' AS segment_id, count(*) FILTER (fr) AS frame_count, count(*) AS orderbook_row_count,
  count(*) FILTER (NOT fr) AS excluded_row_count, coalesce(any_value(inv), '') AS invalidation_reasons, arg_max(fr, row_index) AS native_state_valid,
  bool_or(fr AND snap) AS snapshot_first_admitted FROM r LEFT JOIN h USING (market_ticker, connection_id) GROUP BY market_ticker, connection_id"""
    out["rebuild_evidence"] = f"""WITH {MSG},
g AS (SELECT market_ticker, connection_id, bool_or(disposition <> 'FRAME_EMITTED') AS bad, bool_or(disposition = 'FRAME_EMITTED') AS fr FROM disp GROUP BY 1, 2)
SELECT connection_id, CASE WHEN bool_or(bad) THEN 'FAIL' WHEN bool_or(NOT fr) THEN 'UNKNOWN' ELSE 'PASS' END AS rebuild_integrity FROM g GROUP BY 1"""
    out["segment_contradictions"] = f"""WITH {RECD},
x AS (SELECT connection_id, segment_id, row_index, channel, CASE WHEN e % 1600 = 799 THEN '99' ELSE '7' END AS s,
    CASE WHEN e % 2000 = 1555 THEN 'odd' ELSE market_ticker END AS mid, market_ticker, e % 2400 = 2250 AND e % 40 <> 0 AS flip FROM rch),
f AS (SELECT *, first_value(s) OVER (PARTITION BY connection_id, segment_id, channel ORDER BY row_index) AS fs FROM x),
m AS (SELECT connection_id, segment_id, market_ticker, arg_min(mid, row_index) FILTER (mid IS NOT NULL) AS fm FROM x WHERE market_ticker IS NOT NULL GROUP BY ALL),
j AS (SELECT f.*, CASE WHEN s <> fs OR coalesce(mid <> fm, false) THEN 'IDENTITY_MISMATCH' WHEN flip THEN 'CONTRADICTORY_PRICING_MODE' END AS why
  FROM f LEFT JOIN m USING (connection_id, segment_id, market_ticker)),
b AS (SELECT segment_id, min(row_index) AS bf, arg_min(why, row_index) AS bw FROM j WHERE why IS NOT NULL GROUP BY 1)
SELECT row_index, segment_id, CASE WHEN row_index >= bf THEN bw END AS segment_error FROM j LEFT JOIN b USING (segment_id)"""
    out["public_trades"] = f"""WITH {RECD}, c AS (SELECT connection_id, {trade_class("market_ticker IN ('M-0', 'M-1', 'M-2', 'M-9')")} AS tc FROM rch)
SELECT connection_id, count(*) FILTER (tc = 'trade') AS trade_count, count(*) FILTER (tc = 'filtered') AS filtered_nonselected_count,
  count(*) FILTER (tc = 'ignored') AS ignored_nontrade_count, count(*) FILTER (tc = 'quarantined') AS quarantined_count,
  CASE WHEN count(*) FILTER (tc = 'quarantined') > 0 THEN 'QUARANTINED_INPUT' WHEN count(*) FILTER (tc = 'trade') > 0 THEN 'OBSERVED' ELSE 'QUIET_NO_PUBLIC_TRADES' END AS status
FROM c GROUP BY 1"""
    out["selected_market_semi_join"] = f"""WITH {RECD}
SELECT row_index, market_ticker, 'T' || e AS trade_id FROM rch
WHERE {trade_class("market_ticker IN (SELECT 'M-' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")} = 'trade'"""
    wait = lambda kind: f"(SELECT g FROM q WHERE q.run_id = runs.run_id AND q.obs = '{kind}')"
    out["evidence_dimensions"] = f"""WITH {CONN},
lg AS (SELECT run_id, obs, ts, lag(ts) OVER (PARTITION BY run_id, obs ORDER BY ts) AS p FROM ce),
ag AS (SELECT run_id, obs, max({CEIL.format("ts", "p")}) AS g, min(ts) AS f, max(ts) AS l FROM lg GROUP BY 1, 2),
q AS (SELECT run_id, obs, greatest(0, coalesce(g, 0), {CEIL.format("f", "started_at")}, {CEIL.format("ended_at", "l")}) AS g FROM ag JOIN runs USING (run_id)),
o AS (SELECT run_id, sum(us) AS us, count(opened_at) AS oc FROM windows GROUP BY 1), mg AS (SELECT run_id, max(epoch_us(b) - epoch_us(a)) AS g FROM gaps GROUP BY 1),
v AS (SELECT runs.run_id, CAST(regexp_extract(runs.run_id, '([0-9]+)', 1) AS BIGINT) AS n, oc, us / (epoch_us(ended_at) - epoch_us(started_at)) AS cov, coalesce(mg.g, 0) / 1000000.0 AS gap,
  {wait("keepalive")} AS kg, {wait("lifecycle")} AS lg_, (epoch_us(ended_at) - epoch_us(started_at)) / 1000000 AS act FROM runs JOIN o USING (run_id) LEFT JOIN mg USING (run_id)),
d AS (SELECT run_id, 'UNKNOWN' AS artifact_integrity, CASE WHEN oc > 0 AND cov >= 0.95 AND gap <= 15 THEN 'PASS' ELSE 'FAIL' END AS transport_connectivity,
  CASE WHEN kg IS NULL THEN 'UNKNOWN' WHEN kg <= 120 THEN 'PASS' ELSE 'FAIL' END AS transport_keepalive,
  CASE WHEN oc > 0 AND n % 4 <> 0 AND n % 10 <> 1 AND n % 6 <> 5 THEN 'PASS' ELSE 'FAIL' END AS subscription_status,
  ['PASS', 'UNKNOWN', 'FAIL'][n % 3 + 1] AS sequence_integrity, ['PASS', 'UNKNOWN'][n % 2 + 1] AS rebuild_integrity,
  CASE WHEN lg_ IS NULL THEN 'UNKNOWN' WHEN n % 9 = 0 THEN 'FAIL' WHEN lg_ <= 120 THEN 'PASS' ELSE 'FAIL' END AS market_lifecycle_validity,
  CASE WHEN act >= 1728000 THEN 'PASS' WHEN n % 5 <> 0 THEN 'FAIL' ELSE 'UNKNOWN' END AS duration_evidence,
  CASE WHEN n % 7 <> 0 THEN 'PASS' ELSE 'FAIL' END AS process_liveness, 'UNKNOWN' AS supervisor_liveness, 'UNKNOWN' AS backup_integrity, 'UNKNOWN' AS replay_qualification FROM v)
SELECT *, CASE WHEN 'FAIL' IN (transport_connectivity, transport_keepalive, subscription_status, sequence_integrity, rebuild_integrity, market_lifecycle_validity, duration_evidence, process_liveness)
  THEN 'FAIL' ELSE 'INCOMPLETE' END AS overall_classification FROM d"""
    fails = " OR ".join(f"o_orderkey % {40 + i} = 0" for i in range(12))
    opens = " OR ".join(f"o_orderkey % {20 + i} = 1" for i in range(12))
    out["evidence_overall"] = (
        f"SELECT o_orderkey AS run, CASE WHEN {fails} THEN 'FAIL' WHEN {opens} THEN 'INCOMPLETE' ELSE 'PASS' END AS overall_classification FROM orders"
    )
    out["campaign_classify"] = f"""WITH {CAMP}
SELECT k AS campaign, failures, CASE WHEN code = 'NO_WS_CREDENTIALS' THEN code WHEN code = 'AUTH_SIGNATURE_FAILED' THEN 'WS_AUTH_FAILED'
    WHEN closed THEN 'MARKET_CLOSED_OR_FINALIZED_ENDS_CAMPAIGN_EVIDENCE' WHEN failures <> '' OR status = 'websocket_blocked' THEN 'LAYER1_WS_CAMPAIGN_INCOMPLETE'
    WHEN src = 'REST' THEN 'LAYER1_REST_SMOKE_PASS' WHEN src NOT IN ('WEBSOCKET_DELTA', 'WEBSOCKET_SNAPSHOT') OR events_ <= 0 THEN 'LAYER1_WS_CAMPAIGN_INCOMPLETE'
    WHEN dur >= 604800 AND status = 'websocket_campaign_complete' THEN 'LAYER1_WS_CAMPAIGN_PASS_7D' WHEN k % 3 > 0 THEN 'LAYER1_WS_DELTA_SMOKE_PASS'
    WHEN dur >= 604800 THEN 'LAYER1_WS_CAMPAIGN_INCOMPLETE' WHEN k % 4 > 0 AND k % 8 <> 0 THEN CASE WHEN dur >= 900 THEN 'LAYER1_WS_SNAPSHOT_ONLY_EXTENDED'
    ELSE 'LAYER1_WS_SNAPSHOT_SMOKE_PASS' END ELSE 'LAYER1_WS_CAMPAIGN_INCOMPLETE' END AS evidence_classification,
  NOT closed AND NOT (ro AND k % 13 = 0) AS campaign_evidence_valid,
  CASE WHEN failures <> '' THEN 'fail' WHEN (status LIKE 'websocket_%' AND code IS NOT NULL) OR status = 'websocket_auth_blocked' THEN 'blocked' ELSE 'pass' END AS validation_status,
  CASE WHEN failures <> '' THEN 'DATA_INTEGRITY_FAIL' ELSE 'DATA_INTEGRITY_PASS' END AS data_integrity_classification FROM cf"""
    g_ = lambda n: f"(k % {n} <> 0 AND k % {n + 4} <> 0)"
    out["phase_assessment"] = f"""WITH p AS (
  SELECT o_orderkey AS k, o_orderkey AS run, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS controlled_exit FROM orders),
g AS (SELECT *, k % 13 <> 0 AND {g_(21)} AS duration_gate, k % 23 <> 0 AND {g_(22)} AS transport_gate, k % 29 <> 0 AND {g_(26)} AS subscription_gate,
  k % 3 > 0 AS snapshot_admitted, k % 4 > 0 AS delta_admitted, {g_(27)} AS lifecycle_valid, k % 8 <> 0 AND k % 5 > 0 AND k % 11 <> 0 AS sequence_safe,
  k % 9 <> 0 AND k % 6 > 0 AND k % 10 <> 0 AS rebuild_noninvalid, k % 25 <> 0 AND {g_(33)} AS artifact_integrity_gate,
  k % 7 > 0 AND k % 31 <> 0 AS source_closed, k % 71 <> 0 AS safety_gate FROM p)
SELECT * EXCLUDE (k), controlled_exit AND duration_gate AND transport_gate AND subscription_gate AND snapshot_admitted AND delta_admitted AND lifecycle_valid
    AND sequence_safe AND rebuild_noninvalid AND artifact_integrity_gate AND source_closed AND safety_gate AS qualified,
  controlled_exit AND duration_gate AND transport_gate AND subscription_gate AND lifecycle_valid AND artifact_integrity_gate AND source_closed AND safety_gate
    AND NOT delta_admitted AND k % 8 <> 0 AND k % 9 <> 0 AND NOT (snapshot_admitted AND NOT {g_(9)}) AS fallback_allowed FROM g"""
    out["record_hash"] = """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"')
  || '","user_id":' || user_id || '}') AS record_hash FROM events"""
    appr = """'{"candidate_hash": "' || sha256(proposal_id) || '", "expires_at": "2026-01-02T00:00:00+00:00", "proposal_id": "' || proposal_id
      || '", "requested_at": "2026-01-01T00:00:00+00:00"}'"""
    out["approval_verify"] = f"""WITH {RISK},
p AS (SELECT proposal_id, sha256({appr}) AS approval_id FROM decided WHERE decision = 'manual_review_required'),
n AS (SELECT *, CAST('0x' || substr(approval_id, 1, 4) AS BIGINT) AS n FROM p),
r AS (SELECT *, concat_ws('|', CASE WHEN n % 7 = 0 THEN 'approval_id_mismatch' END, CASE WHEN n % 11 = 0 THEN 'candidate_hash_mismatch' END,
  CASE WHEN n % 5 = 0 THEN 'approval_not_granted' END, CASE WHEN n % 9 = 0 THEN 'approval_already_used' END) AS bad FROM n)
SELECT approval_id, proposal_id, CASE WHEN bad = '' THEN 'approved_for_paper_once' ELSE 'reject' END AS status, bad = '' AS approved,
  CASE WHEN bad = '' THEN 'manual_approval_verified|single_use_only' ELSE bad END AS reasons FROM r"""
    out["preview_chain"] = """WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'risk_missing_or_mismatched'
    WHEN o_orderkey % 5 = 0 THEN 'risk_not_passing' WHEN o_orderkey % 23 = 0 THEN 'risk_blocked' WHEN o_orderkey % 7 = 0 THEN 'approval_missing_or_mismatched'
    WHEN o_orderkey % 11 = 0 THEN 'approval_expired' WHEN o_orderkey % 13 = 0 THEN 'approval_already_used' WHEN o_orderkey % 4 = 0 THEN 'approval_not_granted'
    WHEN o_orderkey % 29 = 0 THEN 'ledger_without_proposal' WHEN o_orderkey % 31 = 0 THEN 'ledger_mismatch' WHEN o_orderkey % 37 = 0 THEN 'reconciliation_missing_or_mismatched'
    WHEN o_orderkey % 41 = 0 THEN 'reconciliation_approval_mismatch' WHEN o_orderkey % 43 = 0 THEN 'reconciliation_mismatch' END AS gate FROM orders)
SELECT CAST(k AS VARCHAR) AS proposal_id, gate AS first_failing_gate, gate IS NULL AS preview_allowed FROM g"""
    out["monitor_rollup"] = f"""WITH {MON}
SELECT run_id, n AS record_count, ev AS event_count, mk AS market_count, epoch_us(last_event) AS last_event_time, gaps AS gap_count,
  CASE WHEN stale THEN 'WARN' ELSE 'OK' END AS stale_flag_status,
  CASE WHEN rk % 4 = 0 THEN 'manual_approval_required|stale_data' WHEN rk IS NOT NULL THEN 'manual_approval_required' END AS risk_reasons,
  CASE WHEN rs = 'F' THEN 'reject' WHEN rs IS NOT NULL THEN 'manual_review_required' END AS risk_decision, CASE WHEN lk % 50 = 2 THEN 1 ELSE 0 END AS mismatch_count,
  'pass' AS layer_0_schema, CASE WHEN evs THEN 'pass' ELSE 'missing' END AS layer_1_recorder, CASE WHEN sim THEN 'pass' ELSE 'missing' END AS layer_2_simulation,
  CASE WHEN led THEN 'pass' ELSE 'missing' END AS layer_3_ledger, CASE WHEN rsk THEN 'pass' ELSE 'missing' END AS layer_4_risk, false AS kill_switch,
  coalesce(rk % 4 = 0, false) AS stale_data, false AS data_gap, false AS fee_missing, false AS edge_insufficient, false AS exposure_limit, false AS daily_loss_limit,
  false AS reconciliation_mismatch, CASE WHEN lk % 50 = 2 THEN 'mismatch' ELSE 'clean' END AS reconciliation_status FROM fr"""
    out["monitor_venues"] = f"""WITH {MON}
SELECT run_id, 'kalshi_demo' AS venue, 'read_only' AS mode, 'unknown' AS connectivity, epoch_us(last_ts) AS last_event_ts, stale_s AS data_staleness_seconds,
  n AS gap_count, 0 AS warning_count, stale_s > 900 AS is_stale FROM vst"""
    out["monitor_health"] = f"""WITH {MON}
SELECT fr.run_id, fr.n AS record_count, stale_s > 900 AS venue_stale, CASE WHEN rs = 'F' OR lk % 50 = 2 THEN 'BLOCKED' WHEN stale_s > 900 THEN 'WARNING' ELSE 'OK_PAPER' END AS health
FROM fr JOIN vst ON fr.run_id = vst.run_id"""
    out["monitor_orders"] = f"""WITH {MON},
o AS (SELECT *, CASE WHEN t = 3 AND k % 5 <> 0 THEN 'O-' || (k // 70) WHEN t = 4 THEN 'P-' || (k // 35) END AS order_id,
    CAST((k % 99 + 1) / 100.0 AS DECIMAL(10,2)) AS price, k % 8 AS qty FROM mon WHERE t IN (3, 4)),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, coalesce(order_id, CAST(k AS VARCHAR)) ORDER BY k) AS rn FROM o)
SELECT run_id, k AS ord, order_id, 'kalshi_demo' AS venue, 'M-' || (k % 40) AS market_ticker, 'paper_propose' AS action, {d6("price")} AS price,
  {d6("nullif(qty, 0)")} AS quantity, {d6("price * nullif(qty, 0)")} AS notional, 'paper' AS status,
  CASE WHEN t = 3 THEN 'open_order' ELSE 'paper_complement_order_proposal' END AS source FROM f WHERE rn = 1"""
    out["monitor_candidates"] = f"""WITH {MON}
SELECT run_id, k AS ord, 'M-' || (k % 40) AS market_ticker, 'same_market_complement' AS strategy, CASE WHEN k % 2 = 0 THEN 0.02 ELSE 0.03 END::DOUBLE AS edge_before_fees,
  CAST(k % 9 AS DOUBLE) AS liquidity, k % 30 = 0 AS stale, 'audit_only' AS risk_decision FROM mon WHERE t = 0"""
    aged = lambda c: f"CASE WHEN k % 3 <> 0 THEN {c} + k % 90 ELSE {c} END"
    out["monitor_refresh"] = f"""WITH c AS (SELECT o_orderkey AS k FROM orders),
a AS (SELECT k, k % 3 <> 0 AS running, {aged("k % 100")} AS keepalive_age, {aged("k % 110")} AS lifecycle_age, CASE WHEN k % 5 <> 0 THEN {aged("k % 300")} END AS quiet_age FROM c)
SELECT k AS campaign, running, keepalive_age, lifecycle_age, quiet_age, CASE WHEN running AND keepalive_age > 120 THEN 'FAIL' ELSE 'PASS' END AS transport_keepalive,
  CASE WHEN running AND lifecycle_age > 120 THEN 'FAIL' ELSE 'PASS' END AS market_lifecycle_validity,
  CASE WHEN running AND quiet_age IS NOT NULL THEN CASE WHEN quiet_age > 300 THEN 'QUIET_WARNING' ELSE 'FRESH' END ELSE 'UNKNOWN' END AS message_freshness FROM a"""
    text = lambda n, c: f"CASE WHEN l_orderkey % {n} NOT IN (0, 1) THEN {c} END"
    market = f"coalesce({text(3, "'M-' || l_partkey")}, 'P-' || l_orderkey)"
    out["monitor_positions"] = f"""SELECT coalesce({text(5, "'v'")}, 'paper') AS venue, {market} AS market_id,
  'P-' || l_orderkey AS market_ticker, 'USD' AS currency, l_returnflag AS side, CAST(l_quantity AS DOUBLE) AS quantity,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE nullif(l_suppkey, 0) END AS DOUBLE) AS exposure,
  CAST(nullif(l_linenumber % 3, 0) AS DOUBLE) AS fees, 'paper_ledger' AS source FROM lineitem"""
    out["run_record_counts"] = """WITH r AS (SELECT 'R-' || (event_id // 7) AS run_id, CASE WHEN event_id % 91 = 0 THEN 'runtime_terminal'
    WHEN event_id % 7 = 0 THEN 'runtime_launch' WHEN event_id % 7 = 3 THEN 'runtime_terminal' ELSE 'frame' END AS k FROM events)
SELECT run_id, count(*) FILTER (k = 'runtime_launch') AS launch_count, count(*) FILTER (k = 'runtime_terminal') AS terminal_count,
  count(*) FILTER (k = 'runtime_launch') = 1 AND count(*) FILTER (k = 'runtime_terminal') = 1 AS run_ok FROM r GROUP BY 1"""
    out["required_channels"] = """WITH a AS (SELECT 'C-' || (event_id // 4) AS connection_id,
    ['orderbook_delta', 'trade', 'ticker', 'trade'][event_id // 3 % 4 + 1] AS channel FROM events),
g AS (SELECT connection_id, bool_or(channel = 'orderbook_delta') AS d, bool_or(channel = 'trade') AS t FROM a GROUP BY 1)
SELECT connection_id, concat_ws('|', CASE WHEN d THEN 'orderbook_delta' END, CASE WHEN t THEN 'trade' END) AS acknowledged_channels,
  d AND t AS all_acknowledged FROM g"""
    out["native_source_class"] = """WITH s AS (SELECT user_id, count(*) FILTER (event_id % 5 = 0 AND user_id % 3 = 0) AS d,
  count(*) FILTER (event_id % 5 = 1 AND user_id % 2 = 0) AS n, count(*) FILTER (event_id % 5 = 2) AS t,
  max(CASE WHEN user_id % 4 <> 0 THEN event_id % 600 END) AS age FROM events GROUP BY 1)
SELECT user_id, CASE WHEN d > 0 THEN 'WEBSOCKET_DELTA' WHEN n > 0 THEN 'WEBSOCKET_SNAPSHOT' WHEN t > 0 THEN 'WEBSOCKET_PUBLIC_TRADE'
  ELSE 'WEBSOCKET_NO_ORDERBOOK' END AS source_type,
  CASE WHEN age IS NULL THEN 'UNKNOWN_NOT_OBSERVED' WHEN age > 300 THEN 'QUIET_WARNING' ELSE 'FRESH' END AS freshness FROM s"""
    out["jsonl_strict_scan"] = "SELECT event_id, event_type, user_id FROM events"
    out["jsonl_quarantine_scan"] = """SELECT CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'CORRUPT_JSONL' ELSE event_type END AS event_type, count(*) AS line_count
FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 <> 0 GROUP BY 1"""
    cents = "(event_id % 99 + 1)"
    ptxt = f"rtrim(CAST(CAST({cents} / 100.0 AS DECIMAL(10,2)) AS VARCHAR), '0')"
    out["jsonl_canonical_write"] = f"""SELECT '{{"instrument_id":"' || user_id || '","ord":' || event_id || ',"price":"' || {ptxt} || '","quantity":"' || CAST(floor(value / 10) + 1 AS BIGINT)
  || '","side":"' || CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'buy' ELSE 'sell' END || '"}}' AS line FROM events"""
    out["mixed_artifact_union"] = """SELECT CASE WHEN event_id % 2 = 0 THEN 'frame' ELSE 'quote' END AS record_type, count(*) AS record_count,
  count(*) FILTER (event_id % 2 = 0) AS event_ids, count(*) FILTER (event_id % 2 = 1) AS user_ids FROM events GROUP BY 1"""
    out["live_event_validation"] = """SELECT event_id, concat_ws('|', CASE WHEN event_id % 11 = 0 THEN 'venue_required' END, CASE WHEN event_id % 13 = 0 THEN 'sequence_not_positive' END,
  CASE WHEN event_id % 7 = 0 THEN 'observed_at_not_aware' END, CASE WHEN event_id % 17 = 0 THEN 'source_type_unsupported' END,
  CASE WHEN event_id % 19 = 0 THEN 'secret_like_payload' END) AS errors FROM events"""
    out["snapshot_round_trip"] = f"""WITH {YN}
SELECT event_id, CASE WHEN bb >= ba THEN 'locked_or_crossed' ELSE '' END AS errors, {d6("bb")} AS best_bid, {d6("ba")} AS best_ask,
  CASE WHEN bb IS NULL THEN 0.0 ELSE 12.0 END::DOUBLE AS bid_depth FROM yn"""
    out["scan_fixture"] = f"""WITH r AS (
  SELECT l_orderkey, l_orderkey % 3 = 0 AS bare, l_returnflag = 'A' AS unk, CAST(0.45 + l_discount AS DECIMAL(6,2)) + CAST(0.46 + l_tax AS DECIMAL(6,2)) - 1 AS gross,
    least(l_quantity, 51 - l_quantity) AS size FROM lineitem),
n AS (SELECT *, CASE WHEN unk THEN 'unknown' WHEN bare THEN 'missing' ELSE 'supplied' END AS fs FROM r),
c AS (SELECT *, gross - CASE WHEN fs = 'supplied' THEN 0.01 ELSE 0 END AS net FROM n)
SELECT l_orderkey, count(*) AS row_count, count(*) AS max_sequence,
  count(*) FILTER (gross > 0 AND size > 0 AND fs = 'supplied' AND net > 0.005) AS paper_candidate_count, count(*) FILTER (fs = 'missing') AS missing_fee_count,
  {d6("sum(net)")} AS net_edge_sum FROM c GROUP BY 1"""
    out["scenario_fixture"] = """SELECT o_orderkey, 1 AS sequence, CASE WHEN o_orderkey % 2 = 0 THEN 'fok' ELSE 'ioc' END AS policy,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE o_orderkey % 5 END AS DOUBLE) AS target_size FROM orders
UNION ALL SELECT o_orderkey, 2, 'ioc', CAST(o_orderkey % 7 AS DOUBLE) FROM orders WHERE o_orderkey % 2 = 0"""
    out["paged_list_union"] = "SELECT p_partkey // 50 AS page, p_partkey AS ticker FROM part"
    fact = """SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS entity_name, 'us-gaap' AS taxonomy, '{c}' AS concept, '{l}' AS label, '{u}' AS unit,
  {v} AS value, {y} AS fiscal_year, 'FY' AS fiscal_period, '10-K' AS form, '{f}-02-01' AS filed, '{y}-12-31' AS end_date, 'a-' || s_suppkey || '-{y}' AS accession_number FROM supplier"""
    out["facts_flatten"] = " UNION ALL ".join(
        (
            fact.format(c="Balance", l="Account balance", u="USD", v=d6("CAST(s_acctbal AS DECIMAL(14,2))"), y=2022, f=2023),
            fact.format(c="Balance", l="Account balance", u="USD", v=d6("CAST(s_acctbal * 2 AS DECIMAL(14,2))"), y=2023, f=2024),
            fact.format(c="Nation", l="Nation", u="count", v=d6("s_nationkey"), y=2023, f=2024),
        )
    )
    from paritymill.fixed import REPORT_INPUT_KINDS

    kinds_sql = ", ".join(f"'{x}'" for x in REPORT_INPUT_KINDS)
    out["manifest_coverage"] = f"""WITH m AS (SELECT p_partkey, [{kinds_sql}][p_partkey % 22 + 1] AS input_kind, p_size % 4 = 0 AS required FROM part),
d AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT input_kind, count(*) AS entry_count, count(n) AS found_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS descriptor_row_count,
  count(*) FILTER (n IS NULL AND NOT required) AS missing_optional_count, count(*) FILTER (n IS NULL AND required) AS missing_required_count
FROM m LEFT JOIN d ON p_partkey = l_partkey GROUP BY 1"""
    out["manifest_entries"] = """SELECT p_partkey AS manifest_id, CASE WHEN p_partkey % 9 = 0 THEN 'https://x/' ELSE 'data/' END || p_partkey AS local_path,
  concat_ws('|', CASE WHEN p_partkey % 7 = 0 THEN 'assumption_scope_missing' END, CASE WHEN p_partkey % 9 = 0 THEN 'remote_url' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'unknown_input_kind' END) AS errors FROM part"""
    out["descriptor_validation"] = """SELECT event_id, concat_ws('|', CASE WHEN event_id % 5 = 0 THEN 'note_missing' END, CASE WHEN event_id % 4 = 3 THEN 'status_unsupported' END,
  CASE WHEN event_id % 7 = 0 THEN 'source_content_field' END, CASE WHEN event_id % 11 = 0 THEN 'secret_like_field' END) AS errors FROM events"""
    out["fixture_snapshots"] = f"""WITH {YN}
SELECT 'F-' || (event_id % 100) AS ticker, count(*) AS snapshot_count, count(*) FILTER (bb >= ba) AS error_count,
  CAST(sum(CASE WHEN bb IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS bid_levels FROM yn GROUP BY 1"""
    out["payload_safety"] = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'auth_token' WHEN 2 THEN 'my_secret' ELSE '' END AS secret_keys,
  CASE WHEN doc_id % 5 = 1 THEN 'order_id' ELSE '' END AS private_keys, doc_id % 5 >= 3 AS payload_safe FROM documents"""
    out["payload_redact"] = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[REDACTED]' END AS auth_token, CASE WHEN doc_id % 5 = 2 THEN '[REDACTED]' END AS nested_secret,
  sha256(text) AS text_hash FROM documents"""
    out["feed_consistency_stream"] = f"""WITH s AS (SELECT event_id AS arrival, 'v' || (user_id % 2) AS venue, 'M-' || (user_id % 10) AS market_id,
  event_id + event_id // 17 AS sequence, ts AS received_at, ts - to_minutes({K}) AS observed_at FROM events),
flagged AS (SELECT *, lag(sequence) OVER w AS pseq, lag(observed_at) OVER w AS pobs FROM s WINDOW w AS (PARTITION BY venue, market_id ORDER BY arrival))
SELECT market_id, arrival, sequence, concat_ws('|', CASE WHEN {GAP} THEN 'sequence_gap' END, CASE WHEN {OOO} THEN 'out_of_order' END,
  CASE WHEN {STALE} THEN 'stale_event' END) AS flags FROM flagged"""
    out["rebuild_stream"] = f"""WITH {TOB}
SELECT d.row_index, d.market_ticker, disposition, CASE WHEN snap AND perr IS NOT NULL THEN perr WHEN d.row_index = bad_from THEN bad_reason
    WHEN disposition = 'EXCLUDED' THEN 'SEGMENT_INVALID' END AS reason,
  CAST(sum(CASE WHEN disposition = 'FRAME_EMITTED' THEN 1 ELSE 0 END) OVER (PARTITION BY d.market_ticker, connection_id ORDER BY d.row_index) AS BIGINT) AS frame_count,
  {d6("bb")} AS best_bid, {d6("1 - nb")} AS best_ask FROM disp d LEFT JOIN tob ON tob.row_index = d.row_index"""
    out["distinct_events_stream"] = "SELECT DISTINCT event_id % 500 AS event_id FROM events"
    out["daily_counters_stream"] = f"""SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day, 'M-' || (user_id % 10) AS market_id, count(*) AS row_count,
  CAST(sum(floor(value / 10) + 1) AS BIGINT) AS quantity FROM events GROUP BY 1, 2"""
    out["sliding_counters_stream"] = f"""WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(CAST(n AS INTEGER)) AS st, value, ts FROM events, range(7) r(n))
SELECT epoch_us(st) AS start, epoch_us(st + INTERVAL 7 DAY) AS "end", count(*) AS row_count, CAST(sum(floor(value / 10) + 1) AS BIGINT) AS quantity
FROM d GROUP BY st"""
    out["quiet_sessions_stream"] = f"""WITH m AS (SELECT 'M-' || (user_id % 10) AS market_id, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY market_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS n FROM m),
s AS (SELECT *, sum(n) OVER (PARTITION BY market_id ORDER BY ts) AS sid FROM g)
SELECT market_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 300000000 AS "end", count(*) AS row_count FROM s GROUP BY market_id, sid"""
    out["stale_split_stream"] = f"SELECT event_id, CASE WHEN {K} > 30 THEN 'stale' ELSE 'fresh' END AS sink FROM events"
    out["quote_hysteresis"] = f"""WITH q AS (
  SELECT CAST(user_id AS VARCHAR) AS instrument_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id AS ord,
    40 + CAST(floor(value) AS BIGINT) % 8 AS cents, CASE WHEN event_id % 50 < 5 THEN 2 ELSE 1 END AS qty FROM events
),
f AS (
  SELECT instrument_id, side, list_reduce(
    list_prepend({{'o': -1::BIGINT, 'c': NULL::BIGINT, 'z': NULL::BIGINT, 'log': []::STRUCT(ord BIGINT, action VARCHAR, held BIGINT)[]}},
      list({{'o': ord, 'c': CAST(cents AS BIGINT), 'z': CAST(qty AS BIGINT), 'log': []::STRUCT(ord BIGINT, action VARCHAR, held BIGINT)[]}} ORDER BY ord)),
    lambda a, r: CASE WHEN a.c IS NOT NULL AND a.z = r.z AND abs(a.c - r.c) < 2
      THEN {{'o': r.o, 'c': a.c, 'z': a.z, 'log': list_append(a.log, {{'ord': r.o, 'action': 'hold', 'held': a.c}})}}
      ELSE {{'o': r.o, 'c': r.c, 'z': r.z, 'log': list_append(a.log, {{'ord': r.o, 'action': CASE WHEN a.c IS NULL THEN 'place' ELSE 'replace' END, 'held': r.c}})}} END) AS st
  FROM q GROUP BY 1, 2
),
u AS (SELECT instrument_id, side, unnest(st.log) AS x FROM f)
SELECT instrument_id, side, x.ord AS ord, x.action AS action, CASE WHEN x.action = 'hold' THEN 'skipped' ELSE 'accepted' END AS result_status,
  {d6("CAST(x.held AS DECIMAL(10,2)) * 0.01")} AS accepted_price FROM u"""
    gap = "CASE WHEN event_id % 3407 = 3406 THEN ' ' ELSE '' END"
    out["segment_chain_audit"] = f"""WITH l AS (
  SELECT 'segment-' || (event_id // 1000) AS segment_id, event_id AS ord, event_id % 3407 = 3406 AS spaced, event_id % 2501 = 2500 AS skipped,
    '{{"event_id":' || {gap} || event_id || ',"kind":"' || event_type || '","local_row_index":' || (event_id % 1000 + CASE WHEN event_id % 2501 = 2500 THEN 2 ELSE 1 END)
      || '}}' || chr(10) AS line FROM events
),
n AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ord) AS i FROM l)
SELECT segment_id, count(*) AS record_count, CAST(sum(length(line)) AS BIGINT) AS byte_count,
  list_reduce(list_prepend(sha256('v1:' || segment_id), list(lpad(lower(to_hex(length(line))), 16, '0') || hex(line) ORDER BY ord)),
    lambda a, x: sha256(unhex(a || x))) AS chain_hash,
  coalesce(CAST(min(i) FILTER (spaced OR skipped) AS VARCHAR), '') AS first_flaw_index,
  arg_min(CASE WHEN skipped THEN 'row_index_not_contiguous' ELSE 'not_canonical' END, i) FILTER (spaced OR skipped) AS first_flaw FROM n GROUP BY segment_id"""
    level = lambda price: f"""'{{"price":"' || CASE WHEN {price} = 0 THEN '0' ELSE rtrim(rtrim(CAST({price} AS VARCHAR), '0'), '.') END || '","quantity":"' || s.qty || '"}}'"""
    state = """CASE WHEN bl = 0 AND al = 0 THEN 'EMPTY' WHEN al = 0 THEN 'YES_BIDS_ONLY' WHEN bl = 0 THEN 'YES_ASKS_ONLY'
    WHEN bb > 1 - nb THEN 'CROSSED' WHEN bb = 1 - nb THEN 'LOCKED' ELSE 'TWO_SIDED' END"""
    ladders = f"""{TOB},
lad AS (
  SELECT f.row_index, coalesce(string_agg({level("s.price")}, ',' ORDER BY s.price DESC) FILTER (s.side = 'yes'), '') AS bids,
    coalesce(string_agg({level("CAST(1 - s.price AS DECIMAL(6,2))")}, ',' ORDER BY s.price DESC) FILTER (s.side = 'no'), '') AS asks
  FROM disp f LEFT JOIN seg s ON s.market_ticker = f.market_ticker AND s.connection_id = f.connection_id
    AND s.epoch = f.epoch AND s.row_index <= f.row_index AND (s.nxt IS NULL OR f.row_index < s.nxt) AND s.qty > 0
  WHERE f.disposition = 'FRAME_EMITTED' GROUP BY f.row_index
),
hsh AS (
  SELECT t.row_index, t.market_ticker, d.connection_id, sha256('{{"book_state":"' || {state} || '","canonical_yes_asks":[' || asks || '],"canonical_yes_bids":[' || bids
    || '],"connection_id":"' || d.connection_id || '","market_ticker":"' || t.market_ticker || '","row_index":' || t.row_index || ',"segment_id":"seg-1"}}') AS frame_hash
  FROM tob t JOIN lad ON lad.row_index = t.row_index JOIN disp d ON d.row_index = t.row_index
)"""
    out["book_ladder_hash"] = f"WITH {ladders} SELECT row_index, market_ticker, frame_hash FROM hsh"
    out["frame_hash_chain"] = f"""WITH {ladders}
SELECT market_ticker, connection_id, 'seg-1' AS segment_id, count(*) AS frame_count,
  list_reduce(list_prepend('', list(frame_hash ORDER BY row_index)), lambda a, x: sha256(unhex(a || x))) AS frame_hash_chain,
  arg_max(frame_hash, row_index) AS latest_frame_hash FROM hsh GROUP BY 1, 2"""
    out["binding_state"] = f"""WITH {NATIVE},
{BOUND}
SELECT 'camp-' || camp AS campaign_id, cn % 4 + 1 AS connection_epoch, ord, bch AS binding_channel, gen AS generation, cmd AS command_id, rix AS run_request_index,
  CASE WHEN (ack OR rej) AND NOT hit THEN 'REQUEST_MISMATCH' WHEN gen IS NULL THEN 'UNKNOWN' WHEN co <= ord THEN 'CONFLICTED'
    WHEN fo <= ord THEN CASE fa WHEN 'A' THEN 'ACKNOWLEDGED' ELSE 'REJECTED' END ELSE 'REQUESTED' END AS binding_state,
  CASE WHEN ack AND NOT hit THEN 'STALE_ACK' WHEN ack AND ord = fo THEN 'ACKNOWLEDGED' WHEN ack AND co <= ord THEN 'CONFLICTING_ACK' WHEN ack THEN 'DUPLICATE_ACK'
    WHEN rej AND NOT hit THEN 'REJECTED' WHEN rej AND ord = fo THEN 'REJECTED' WHEN rej AND co <= ord THEN 'CONFLICTING_REJECTION' WHEN rej THEN 'DUPLICATE_REJECTION' END AS binding_observation
FROM j"""
    out["sequence_state"] = f"""WITH RECURSIVE {NATIVE},
{BOUND},
{WALK},
ends AS (SELECT cn, sub, max(made) AS made FROM w GROUP BY 1, 2),
starts AS (SELECT DISTINCT event_id // 1000 AS camp, event_id // 250 AS cn, 0 AS sub FROM events UNION ALL
  SELECT camp, cn, row_number() OVER (PARTITION BY cn ORDER BY bo) FROM rq WHERE bch = 'orderbook_delta'),
base AS (SELECT starts.*, coalesce(sum(coalesce(made, 0) + 1) OVER (PARTITION BY camp ORDER BY cn, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS base
  FROM starts LEFT JOIN ends USING (cn, sub)),
news AS (SELECT DISTINCT cn FROM bd WHERE bch = 'orderbook_delta' AND gen = 1)
SELECT 'camp-' || r.camp AS campaign_id, r.ord, kind AS native_type, verdict AS sequence_state, status AS admission_status, fault AS exclusion_reason,
  resync AS resync_state, (base + failures)::BIGINT AS segment_number,
  CASE WHEN failures > 0 THEN 'INTEGRITY_FAILURE' WHEN r.sub = 0 AND r.cn % 4 = 0 THEN 'INITIAL_CONNECTION' WHEN r.sub = 0 THEN 'RECONNECTION'
    WHEN r.sub = 1 AND news.cn IS NOT NULL THEN 'NEW_SUBSCRIPTION' ELSE 'RESUBSCRIPTION' END AS segment_boundary_reason
FROM r JOIN w ON w.cn = r.cn AND w.sub = r.sub AND w.ord = r.ord JOIN base ON base.cn = r.cn AND base.sub = r.sub LEFT JOIN news ON news.cn = r.cn"""
    out["sequence_stream"] = f"""WITH RECURSIVE {NATIVE},
{BOUND},
{WALK}
SELECT 'camp-' || r.camp AS campaign_id, r.cn % 4 + 1 AS connection_epoch, r.sub AS subscription, r.ord, verdict AS sequence_state, status AS admission_status,
  fault AS exclusion_reason, resync AS resync_state, failures FROM r JOIN w ON w.cn = r.cn AND w.sub = r.sub AND w.ord = r.ord"""
    out["event_identity_stream"] = f"""WITH {DEMO}
SELECT audit_id, event_id, ord, CASE WHEN ord = fo THEN 'first' WHEN h = fh THEN 'duplicate' ELSE 'conflicting_duplicate_event' END AS outcome
FROM ev JOIN fst USING (audit_id, event_id)"""
    out["late_split_stream"] = """WITH t AS (SELECT event_id, ts, CASE WHEN event_id % 10 < 6 THEN 0 WHEN event_id % 10 < 9 THEN 1 ELSE 2 END AS turn FROM events),
m AS (SELECT turn, max(ts) AS latest FROM t GROUP BY 1)
SELECT event_id, CASE WHEN ts < (SELECT max(latest) FROM m WHERE m.turn < t.turn) - INTERVAL 3 DAY THEN 'late' ELSE 'kept' END AS sink FROM t"""
    return out
