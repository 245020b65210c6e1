"""DuckDB SQL of the queries that SQL can express; `tests/llm` compares the others with plain Python instead."""

from __future__ import annotations

_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), lows AS (
  SELECT text, min(doc_id) AS low FROM texts GROUP BY text
), marked AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals
  FROM texts
), fails AS (
  SELECT m.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * capitals > 3 * length(m.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(m.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN m.doc_id > l.low THEN 'E' ELSE '' END AS f
  FROM measured m JOIN lows l ON m.text = l.text LEFT JOIN marked k ON m.doc_id = k.doc_id
), sets AS (
  SELECT part, f, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM fails GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT s.part, o.filter_order, o.step, o.letter, s.f, s.n, s.n_good, s.n_toxic,
    contains(s.f, o.letter) AS hit, translate(s.f, o.earlier, '') = s.f AS passed
  FROM sets s, steps o
)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (passed AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (passed AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (NOT passed AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (f = letter), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n_good) FILTER (passed AND hit), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n_toxic) FILTER (passed AND hit), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(length(f), 1)) FILTER (hit), 0) AS BIGINT) AS shapley
FROM met GROUP BY part, filter_order, step
"""

ORACLES: dict[str, str] = {"op12_filter_audit": _AUDIT}
