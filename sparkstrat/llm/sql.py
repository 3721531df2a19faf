"""DuckDB SQL of the text queries that SQL can express."""

_OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), l AS (
  SELECT doc_id, source, x, array_to_string(list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), frequent AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS docs FROM l GROUP BY ALL)
  JOIN (SELECT source, count(DISTINCT doc_id) AS all_docs FROM documents GROUP BY ALL) USING (source)
  WHERE docs >= 20 AND 100 * docs > 5 * all_docs
), lost AS (
  SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS n FROM l SEMI JOIN frequent USING (source, line) GROUP BY ALL
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY ALL
), g AS (
  SELECT doc_id, i, ws[i:i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), range(3) AS r(k) WHERE c > 1 GROUP BY ALL
), b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(again.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept
FROM b
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY ALL
), linked AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN n USING (doc_id)
"""

ORACLE = {"op1_exact_dedup": _OP1, "op3_line_quality": _OP3, "op4_near_dedup": _OP4}
