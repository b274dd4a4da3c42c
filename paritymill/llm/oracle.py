"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from paritymill.llm import interactions, quality

_WORD = r"[^\x20\x09-\x0D]+"


def _host_quality() -> str:
    q = quality
    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body,
             regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    win AS (
      SELECT doc_id, i, list_slice(w, i, i + {q.WINDOW - 1}) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {q.WINDOW})),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    rep AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS p FROM twice) GROUP BY 1),
    ln AS (
      SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    f AS (
      SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(body, '[^!]', '', 'g')) AS n_exclaims, len(l) AS n_lines
      FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
    b AS (
      SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM f),
    j AS (
      SELECT *, base_failed OR 100 * n_symbols > {q.SYMBOL_PERCENT} * word_chars
             OR 100 * n_exclaims > {q.EXCLAIM_PERCENT} * word_chars
             OR 100 * n_dup_lines > {q.DUP_LINE_PERCENT} * n_lines AS failed FROM b),
    h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM j GROUP BY 1),
    m AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS second FROM h),
    p AS (
      SELECT mean, least(greatest(mean * (1 - mean) / greatest(second - mean * mean, 1e-12) - 1, 1.0), 1e6) AS weight FROM m),
    v AS (
      SELECT host, CASE WHEN r < {q.TRUSTED_RATE} THEN 'trusted' WHEN r > {q.BLOCKED_RATE} THEN 'blocked' ELSE 'mixed' END
             AS host_verdict FROM (SELECT host, (f + mean * weight) / (n + weight) AS r FROM h, p))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND host_verdict <> 'blocked' AND (NOT failed OR host_verdict = 'trusted') AS kept, host_verdict
    FROM j JOIN v USING (host)"""


def _filter_interactions() -> str:
    i = interactions
    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
    m AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(w) < {i.MIN_WORDS} THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(w)) < {i.DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {i.UPPER_PERCENT} * length(t)
                     THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
      FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
    g AS (
      SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
      FROM m GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (
      SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
    k AS (
      SELECT g.*, filter_order, step, substr(filter_order, step, 1) AS letter,
             CASE WHEN fails = '' THEN 9
                  ELSE list_min(list_transform(string_split(fails, ''), lambda x: instr(filter_order, x))) END AS gone
      FROM g, s),
    c AS (
      SELECT part, filter_order, step, letter,
             sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
             sum(n) FILTER (gone < step AND contains(fails, letter)) AS redundant,
             sum(n) FILTER (fails = letter) AS unique_fails,
             sum(n_good) FILTER (gone = step) AS good_lost, sum(n_toxic) FILTER (gone = step) AS toxic_lost
      FROM k GROUP BY ALL),
    z AS (SELECT part, letter, sum(removed) AS shapley FROM c GROUP BY 1, 2)
    SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           coalesce(shapley, 0)::BIGINT AS shapley
    FROM c JOIN z USING (part, letter)"""


def sql() -> dict[str, str]:
    return {"op2_host_quality": _host_quality(), "op12_filter_interactions": _filter_interactions()}
