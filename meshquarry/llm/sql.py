"""DuckDB SQL for the queries that SQL expresses."""

LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {docs}
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), kept AS (
  SELECT k.doc_id, count(*) AS n_lines,
         count(*) FILTER (WHERE f.first IS NOT NULL AND f.first < k.doc_id) AS n_dropped,
         coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.first IS NULL OR f.first >= k.doc_id), '') AS kept_text
  FROM keyed k LEFT JOIN firsts f USING (key) GROUP BY k.doc_id
)
"""

INFILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), h AS (
  SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(digest, 9, 8))::BIGINT % (n + 1) AS two,
         ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
            ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

SQL = {
    "op13_infill": INFILL,
    "op9_line_dedup": "WITH " + LINES.format(docs="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM kept",
}
