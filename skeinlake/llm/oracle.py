"""SQL of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

#: crc32 of the decimal digits of each id in `ids`, bit by bit.
_CRC = """crc AS (SELECT id, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(8), lambda b: (ascii(s[i]) >> b) & 1)))),
  lambda c, bit: xor(c >> 1, (xor(c, bit) & 1) * 3988292384)), 4294967295) AS crc FROM (SELECT DISTINCT id, CAST(id AS VARCHAR) AS s FROM ids)),"""

_OP9 = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS points
  FROM documents
), g AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

_OP11 = r"""
WITH RECURSIVE split AS (
  SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
), links AS (
  SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref[\x20\x09-\x0D]{0,9}=[\x20\x09-\x0D]{0,9}["'']?(?:https?:)?//([^/?#"''\x20\x09-\x0D<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parts WHERE host <> '')
  WHERE src <> dst
), edges AS (SELECT 'trust' AS kind, src AS a, dst AS b FROM links UNION ALL SELECT 'distrust', dst, src FROM links),
shares AS (SELECT kind, a, b, 0.85::DOUBLE / count(*) OVER (PARTITION BY kind, a) AS share FROM edges),
seeds AS (
  SELECT kind, host, score FROM (
    SELECT 'trust' AS kind, host, (1 - 0.85::DOUBLE) * avg((coalesce(verdict, '') = 'allow')::INT) AS score FROM judged WHERE host <> '' GROUP BY host
    UNION ALL SELECT 'distrust', host, (1 - 0.85::DOUBLE) * avg((coalesce(verdict, '') = 'block')::INT) FROM judged WHERE host <> '' GROUP BY host) WHERE score > 0
), scores AS (
  SELECT 0 AS round, kind, host, score FROM seeds
  UNION ALL SELECT round, kind, host, sum(score) FROM (
    SELECT r.round + 1 AS round, r.kind, e.b AS host, r.score * e.share AS score FROM scores r JOIN shares e ON e.kind = r.kind AND e.a = r.host
    UNION ALL SELECT k.round + 1, s.kind, s.host, s.score FROM (SELECT DISTINCT round FROM scores) k CROSS JOIN seeds s) WHERE round <= 57 GROUP BY round, kind, host
), shunned AS (
  SELECT host FROM (SELECT host, sum(score) FILTER (WHERE kind = 'trust') AS trust, sum(score) FILTER (WHERE kind = 'distrust') AS distrust FROM scores WHERE round = 57 GROUP BY host)
  WHERE distrust >= 0.077 AND distrust > coalesce(trust, 0)
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN s.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM judged j LEFT JOIN shunned s ON s.host = j.host
"""

_OP12 = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(turn ORDER BY k) AS turns FROM turns GROUP BY conv_id),
ids AS (SELECT conv_id AS id FROM own),""" + _CRC + """
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[:CAST(crc % 6 AS BIGINT)], []), c.turns[CAST(crc % 6 AS BIGINT) + 1:]) AS turns
  FROM own c JOIN crc ON crc.id = c.conv_id LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, turns[:d] AS path, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY path, d
), kids AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT n.path, n.d, k.n_children IS NULL AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(n.path[d].text) END AS saved FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (SELECT path[:up] AS path, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS up FROM own_sums) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[:n.d - 1]
"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(parts) + ")"


_OP13 = f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents WHERE doc_id IS NOT NULL), {_CRC}
leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN crc.crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents LEFT JOIN crc ON crc.id = doc_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
lower_levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM lower_levels WHERE len(nodes) > 1
), subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS j FROM lower_levels WHERE len(nodes) = 1),
upper_levels AS (
  SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM subroots
  UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM upper_levels WHERE len(nodes) > 1
), root AS (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1),
steps AS (
  SELECT p.source, p.i, l.level, nodes, CAST(p.i // CAST(power(3, l.level) AS BIGINT) AS BIGINT) AS here FROM placed p JOIN lower_levels l ON l.source IS NOT DISTINCT FROM p.source WHERE len(nodes) > 1
  UNION ALL SELECT p.source, p.i, 1000 + u.level, nodes, CAST(s.j // CAST(power(3, u.level) AS BIGINT) AS BIGINT) FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN upper_levels u WHERE len(nodes) > 1
), siblings AS (
  SELECT source, i, level, array_to_string(nodes[here - here % 3 + 1:here], '') AS lefts, array_to_string(nodes[here + 2:here - here % 3 + 3], '') AS rights FROM steps
), proofs AS (SELECT source, i, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof_sha256, list({{'l': lefts, 'r': rights}} ORDER BY level) AS proof FROM siblings GROUP BY source, i),
folded AS (
  SELECT p.*, s.subroot, root.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend({{'l': tampered, 'r': ''}}, coalesce(f.proof, [])), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN root LEFT JOIN proofs f ON f.source IS NOT DISTINCT FROM p.source AND f.i = p.i
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLE_SQL = {"op9_exact_dedup": _OP9, "op11_url_filter": _OP11, "op12_conversation_trie": _OP12, "op13_merkle_manifest": _OP13}
