"""DuckDB texts that check queries of this subpackage, and parts that several of them need."""

from __future__ import annotations

#: Common table expression with the 256 steps of CRC-32, by its rule.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_steps
  FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text; the query needs ``crc_table`` among its tables."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda s, b: xor(s >> 8, crc_steps[CAST(xor(s, b) & 255 AS INT) + 1])), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(length: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", length, "text"))) + ")"


def _tree(name: str, leaves: str) -> str:
    """All levels of the trees over ``leaves`` (tree, spot, h, n)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, spot, h, n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, spot // 2, sha256(string_agg(h, '' ORDER BY spot)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, spot // 2, n)"""


def _fold(name: str, start: str, tree: str) -> str:
    """Folds (row, tree, spot, node, proof) to the root, in as many steps as the tree has levels."""
    return f"""{name} AS (
  SELECT row, tree, 0 AS level, spot, node, proof FROM {start}
  UNION ALL
  SELECT f.row, f.tree, f.level + 1, f.spot // 2, sha256(CASE WHEN s.h IS NULL THEN f.node WHEN f.spot % 2 = 1 THEN s.h || f.node ELSE f.node || s.h END), f.proof || coalesce(s.h, '')
  FROM {name} f JOIN (SELECT tree, max(level) AS height FROM {tree} GROUP BY tree) t ON t.tree = f.tree LEFT JOIN {tree} s ON s.tree = f.tree AND s.level = f.level AND s.spot = xor(f.spot, 1)
  WHERE f.level < t.height)"""


def _ends(fold: str, tree: str) -> str:
    return f"(SELECT f.* FROM {fold} f JOIN (SELECT tree, max(level) AS height FROM {tree} GROUP BY tree) t ON t.tree = f.tree AND t.height = f.level)"


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS h,
         CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS forged
  FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_tree("trees", "leaves")},
subroots AS (SELECT tree AS of_tree, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS spot, h, count(*) OVER () AS n FROM trees WHERE n = 1),
{_tree("top", "subroots")},
{_fold("below", "(SELECT row, tree, spot, forged AS node, '' AS proof FROM leaves)", "trees")},
{_fold("above", f"(SELECT e.row, '' AS tree, s.spot, e.node, e.proof FROM {_ends('below', 'trees')} e JOIN subroots s ON s.of_tree = e.tree)", "top")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = r.h AS verified
FROM leaves l JOIN {_ends("above", "top")} e ON e.row = l.row JOIN subroots s ON s.of_tree = l.tree JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""

_BLANKS = r"\x20\x09-\x0D"
#: Every edit that takes a phrase (B nothing yet, S system turn, H open pair, P whole pairs) over a row, after up to two insertions.
CONVERSATION_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM plain WHERE kind <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS pos FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANKS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{_BLANKS}]*$') THEN 'truncated' ELSE '' END AS fault,
         role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY conv ORDER BY pos) AS before
  FROM placed),
counted AS (
  SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
         count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows
  FROM faulty GROUP BY conv_id, conv),
inserted(src, dst, cost, audit) AS (VALUES ('B', 'B', 0, ''), ('S', 'S', 0, ''), ('H', 'H', 0, ''), ('P', 'P', 0, ''), ('B', 'H', 2, 'I'), ('S', 'H', 2, 'I'), ('P', 'H', 2, 'I'), ('H', 'P', 2, 'I'), ('B', 'P', 4, 'II'), ('S', 'P', 4, 'II'), ('H', 'H', 4, 'II'), ('P', 'P', 4, 'II')),
edits(src, dst, cost, audit, ini, other) AS (VALUES
  ('B', 'B', 3, 'D', NULL, NULL), ('S', 'S', 3, 'D', NULL, NULL), ('H', 'H', 3, 'D', NULL, NULL), ('P', 'P', 3, 'D', NULL, NULL),
  ('B', 'S', 0, 'K', 's', NULL), ('B', 'H', 0, 'K', 'u', NULL), ('S', 'H', 0, 'K', 'u', NULL), ('P', 'H', 0, 'K', 'u', NULL), ('H', 'P', 0, 'K', 'a', NULL),
  ('B', 'H', 2, 'R', NULL, 'u'), ('S', 'H', 2, 'R', NULL, 'u'), ('P', 'H', 2, 'R', NULL, 'u'), ('H', 'P', 2, 'R', NULL, 'a')),
moves AS (SELECT i.src, e.dst, i.cost + e.cost AS cost, i.audit || e.audit AS audit, e.audit = 'D' AS gone, e.ini, e.other FROM inserted i JOIN edits e ON i.dst = e.src),
best AS (
  SELECT conv, CAST(0 AS BIGINT) AS pos, 'B' AS phrase, {{'cost': 0, 'audit': ''}} AS v FROM counted
  UNION ALL
  SELECT b.conv, b.pos + 1, m.dst, min({{'cost': b.v.cost + m.cost + CASE WHEN NOT m.gone AND r.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': b.v.audit || m.audit}})
  FROM best b JOIN faulty r ON r.conv = b.conv AND r.pos = b.pos + 1 JOIN moves m ON m.src = b.phrase AND (m.gone OR r.fault NOT IN ('blank', 'duplicate')) AND (m.ini IS NULL OR m.ini = r.ini) AND (m.other IS NULL OR m.other <> r.ini)
  GROUP BY b.conv, b.pos, m.dst),
repairs AS (
  SELECT b.conv, min({{'cost': b.v.cost + i.cost, 'audit': b.v.audit || i.audit}}) AS v
  FROM best b JOIN counted c ON c.conv = b.conv AND c.rows = b.pos JOIN inserted i ON i.src = b.phrase WHERE i.dst IN ('B', 'P') GROUP BY b.conv),
letters AS (SELECT conv, v.audit AS audit, unnest(range(1, len(v.audit) + 1)) AS i FROM repairs),
edited AS (
  SELECT conv, i, audit[i] AS edit, len(replace(audit[:i], 'I', '')) AS pos, len(replace(audit[:i], 'D', '')) AS turn, len(replace(audit, 'D', '')) % 2 AS odd FROM letters WHERE audit[i] <> 'D'),
lines AS (
  SELECT e.conv, e.i, CASE WHEN e.edit = 'K' THEN r.role WHEN (e.turn - e.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS line
  FROM edited e LEFT JOIN faulty r ON r.conv = e.conv AND r.pos = e.pos),
digests AS (SELECT conv, string_agg(line, chr(10) ORDER BY i) AS whole FROM lines GROUP BY conv),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(p.v.cost, 0) AS BIGINT) AS cost, coalesce(p.v.audit, '') AS audit, sha256(coalesce(d.whole, '')) AS repaired_sha256
FROM everyone a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repairs p ON p.conv = c.conv LEFT JOIN digests d ON d.conv = c.conv
"""
