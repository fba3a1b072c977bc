"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_SPACE = r"\x20\x09-\x0D"

ORACLES["op1_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
item_sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY 1),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
kinds AS (SELECT DISTINCT k FROM sized),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, kinds WHERE len(w) >= k))
SELECT doc_id, item_id, count(*) / n AS containment, count(*) AS n_found, n AS n_shingles
FROM doc_shingles JOIN item_shingles USING (s) JOIN item_sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""

ORACLES["op9_line_rules"] = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
kept AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM base),
runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
marks AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM runs) WHERE c > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM marks) GROUP BY 1),
lines AS (
  SELECT doc_id, source, lower(trim(regexp_replace(l, '[{_SPACE}]+', ' ', 'g'))) AS l
  FROM (SELECT doc_id, source, unnest(ls) AS l FROM kept JOIN base USING (doc_id))),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
frequent AS (
  SELECT source, l FROM (SELECT source, l, count(DISTINCT doc_id) AS c FROM lines GROUP BY 1, 2) JOIN hosts USING (source)
  WHERE c > 20 AND c > 0.1 * docs),
gone AS (
  SELECT doc_id, sum(len(string_split(l, ' '))) AS bw, count(*) AS bl FROM lines JOIN frequent USING (source, l) GROUP BY 1),
figures AS (
  SELECT b.doc_id, len(w) AS n_words, length(t) - len(regexp_extract_all(t, '[{_SPACE}]')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(bw, 0) AS bw, coalesce(bl, 0) AS bl
  FROM base b JOIN kept USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bw::BIGINT AS boilerplate_words, bl AS boilerplate_lines,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - bw >= 0.3 * n_words AS kept
FROM figures
"""
