"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS

_stops = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP4_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
k AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM g),
d AS (
  SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM d, range(5) r(o) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \t\n\x0b\x0c\r]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_stops}))) AS n_stop_words
  FROM t LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         array_to_string(list_filter([
           CASE WHEN n_words < 10 OR n_words > 1000000 THEN 'length' END,
           CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words) THEN 'word_length' END,
           CASE WHEN n_words > 0 AND n_symbols > 0.1::DOUBLE * n_words THEN 'symbols' END,
           CASE WHEN n_words > 0 AND n_marks > 0.3::DOUBLE * n_words THEN 'exclamations' END,
           CASE WHEN n_words > 0 AND n_stop_words < 0.02::DOUBLE * n_words THEN 'stop_words' END,
           CASE WHEN n_lines > 0 AND n_dup_lines > 0.3::DOUBLE * n_lines THEN 'repeated_lines' END,
           CASE WHEN n_words > 0 AND n_repeat_words > 0.2::DOUBLE * n_words THEN 'repeated_words' END], lambda x: x IS NOT NULL), ',') AS broken_rules
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM b"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
