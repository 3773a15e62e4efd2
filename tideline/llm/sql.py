"""SQL beside the queries of this package, written another way than the operators."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def crc32(text: str) -> str:
    """The unsigned checksum of an ASCII text, bit by bit."""
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Trees level by level, then a walk from every leaf to the top, digests in hand.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 3 = 0
      THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_leaf("text")} END AS claim
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf, claim) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), lv AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, any_value(lvl) + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY g, i // 8
), tops AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1
), tl AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM tops
  UNION ALL
  SELECT any_value(lvl) + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tl WHERE n > 1 GROUP BY i // 8
), sib AS (
  SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM lv a JOIN lv b ON b.g = a.g AND b.lvl = a.lvl AND b.i // 8 = a.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.i
), tsib AS (
  SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM tl a JOIN tl b ON b.lvl = a.lvl AND b.i // 8 = a.i // 8 WHERE a.n > 1 GROUP BY a.lvl, a.i
), walk AS (
  SELECT g, i AS k, 0 AS lvl, i, '' AS proof, claim AS h FROM leaves
  UNION ALL
  SELECT w.g, w.k, w.lvl + 1, w.i // 8, w.proof || s.l || s.r, sha256(s.l || w.h || s.r)
  FROM walk w JOIN sib s ON s.g = w.g AND s.lvl = w.lvl AND s.i = w.i
), sub AS (
  SELECT w.g, w.k, w.proof, w.h, t.i, t.subroot FROM walk w JOIN tops t ON t.g = w.g
  WHERE NOT EXISTS (SELECT 1 FROM sib s WHERE s.g = w.g AND s.lvl = w.lvl)
), climb AS (
  SELECT g, k, subroot, 0 AS lvl, i, proof, h FROM sub
  UNION ALL
  SELECT c.g, c.k, c.subroot, c.lvl + 1, c.i // 8, c.proof || s.l || s.r, sha256(s.l || c.h || s.r)
  FROM climb c JOIN tsib s ON s.lvl = c.lvl AND s.i = c.i
)
SELECT leaves.doc_id, leaves.leaf, c.subroot, tl.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = tl.h AS verified
FROM leaves JOIN climb c ON c.g = leaves.g AND c.k = leaves.i JOIN tl ON tl.n = 1 AND tl.lvl = c.lvl
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Row by row: the cheapest edits that leave a conversation on each initial.
OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, {_BLANKS}) AS ends, left(role, 1) AS initial
  FROM damaged
), judged AS (
  SELECT *, ends = '' AS blank, ends <> '' AND again AS duplicate, ends <> '' AND NOT again AND right(ends, 1) NOT IN ('.', '!', '?') AS truncated,
    initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM placed
), ahead(p, q, cost, letter, line) AS (
  VALUES ('', '', 0, '', NULL), ('s', 's', 0, '', NULL), ('u', 'u', 0, '', NULL), ('a', 'a', 0, '', NULL),
    ('', 'u', 3, 'I', 'user:'), ('s', 'u', 3, 'I', 'user:'), ('a', 'u', 3, 'I', 'user:'), ('u', 'a', 3, 'I', 'assistant:')
), edit(p, letter, q) AS (
  VALUES ('', 'D', ''), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a'), ('', 'K', 's'), ('', 'K', 'u'), ('s', 'K', 'u'), ('u', 'K', 'a'), ('a', 'K', 'u'),
    ('', 'R', 'u'), ('s', 'R', 'u'), ('u', 'R', 'a'), ('a', 'R', 'u')
), state AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS p, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS way FROM damaged
  UNION ALL
  SELECT s.conv_id, s.i + 1, e.q, min({{
      'cost': s.way.cost + a.cost + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN j.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END,
      'audit': s.way.audit || a.letter || e.letter,
      'lines': s.way.lines || CASE WHEN a.line IS NULL THEN []::VARCHAR[] ELSE [a.line] END || CASE e.letter WHEN 'D' THEN []::VARCHAR[]
        WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.q WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text] END
    }})
  FROM state s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1
    JOIN ahead a ON a.p = s.p JOIN edit e ON e.p = a.q
  WHERE e.letter = 'D' OR (NOT j.blank AND NOT j.duplicate AND (e.letter = 'R' OR j.initial = e.q))
  GROUP BY s.conv_id, s.i, e.q
), ended AS (
  SELECT conv_id, i, CASE WHEN p = 'u' THEN {{'cost': way.cost + 3, 'audit': way.audit || 'I', 'lines': way.lines || ['assistant:']}} ELSE way END AS way
  FROM state WHERE p <> 's'
), tally AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE i < k AND (pair IS NULL OR pair NOT IN ('su', 'ua', 'au'))) AS illegal
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS k FROM judged) GROUP BY conv_id
), cheapest AS (
  SELECT e.conv_id, min(e.way) AS way FROM ended e JOIN tally t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.n = e.i GROUP BY e.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(c.way.cost, 0)::BIGINT AS cost,
  coalesce(c.way.audit, '') AS audit, sha256(coalesce(array_to_string(c.way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN tally t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN cheapest c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""
