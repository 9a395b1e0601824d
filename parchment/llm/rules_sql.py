"""The quality rules in DuckDB's SQL, for comparison with quality_rules.judge."""

from __future__ import annotations

# Fixed values, the same as the operator's.
N_CLASSES, N_WORDS, N_BINS = 6, 16, 17
LEAST_TRUSTED, LEAST_CHARS, LEAST_WORDS, MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 20, 200, 100, 0.25, 0.28


def distance(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of n numbers; 0 where either sums to 0."""
    x, y = (lambda i: f"({p}[{i}] / list_sum({p}))"), (lambda i: f"({q}[{i}] / list_sum({q}))")
    part = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END"
    terms = [f"{part(v, f'(({x(i)} + {y(i)}) / 2)')}" for i in range(1, n + 1) for v in (x(i), y(i))]
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(({' + '.join(terms)}) / 2, 0)) ELSE 0 END"


def total(column: str, n: int, which: str = "") -> str:
    return "[" + ", ".join(f"sum({column}[{i}]){which}" for i in range(1, n + 1)) + "]"


TRUSTED = " FILTER (WHERE trusted)"
SQL = rf"""
WITH good AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL
), d AS (
  SELECT doc_id, coalesce('l' || lang, '') AS k, coalesce(doc_id IN (SELECT doc_id FROM good), false) AS trusted, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), seen AS (
  SELECT k, unnest(list_append(list_distinct(list_transform(w, lambda x: lower(x))), '')) AS word FROM d WHERE trusted AND len(w) >= 20
), ranked AS (
  SELECT k, word, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, word) AS r FROM seen GROUP BY 1, 2
), common AS (
  SELECT k, list_concat(list(word ORDER BY r) FILTER (WHERE word <> ''), list_transform(range({N_WORDS}), lambda i: ''))[1:{N_WORDS}] AS bins
  FROM ranked WHERE r <= {N_BINS} GROUP BY k HAVING max(n) >= {LEAST_TRUSTED}
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8
), g8 AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM g
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g8
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY 1
), left_ AS (
  SELECT *, regexp_replace(text, '\p{{Ll}}+', '', 'g') AS t1 FROM d
), left2 AS (
  SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM left_
), left3 AS (
  SELECT *, regexp_replace(t2, '\p{{Lu}}+', '', 'g') AS t3 FROM left2
), left4 AS (
  SELECT *, regexp_replace(t3, '\p{{Nd}}+', '', 'g') AS t4 FROM left3
), left5 AS (
  SELECT *, regexp_replace(t4, '[.,;:!?''"()\-]+', '', 'g') AS t5, list_transform(w, lambda x: lower(x)) AS lw,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM left4
), counts AS (
  SELECT doc_id, k, trusted, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(text) AS n_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    list_transform([length(text) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5)], lambda x: x::DOUBLE) AS classes,
    list_transform(bins, lambda b: len(list_filter(lw, lambda x: x = b))::DOUBLE) AS held
  FROM left5 LEFT JOIN covered c USING (doc_id) LEFT JOIN common USING (k)
), judged AS (
  SELECT * EXCLUDE (held), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN held IS NULL THEN [] ELSE list_append(held, n_words - list_sum(held)) END AS held FROM counts
), reference AS (
  SELECT k, CASE WHEN count(*){TRUSTED} >= {LEAST_TRUSTED} THEN {total("classes", N_CLASSES, TRUSTED)} ELSE {total("classes", N_CLASSES)} END AS class_ref,
    CASE WHEN count(*){TRUSTED} >= {LEAST_TRUSTED} THEN {total("held", N_BINS, TRUSTED)} END AS held_ref
  FROM judged WHERE NOT base_failed GROUP BY 1
), far AS (
  SELECT j.*, CASE WHEN n_chars >= {LEAST_CHARS} THEN {distance("classes", "class_ref", N_CLASSES)} ELSE 0 END AS char_distance,
    CASE WHEN n_words >= {LEAST_WORDS} AND len(held) > 0 THEN {distance("held", "held_ref", N_BINS)} ELSE 0 END AS word_distance
  FROM judged j LEFT JOIN reference USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {MOST_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE} AS kept
FROM far
"""
