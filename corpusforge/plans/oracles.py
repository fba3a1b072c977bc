r"""What each registered query must return, as SQL for another engine over the same tables.

The SQL is written from the rules, not from the Spark code: chunking recurses, counting splits
and filters, windows are plain windows.
"""

from __future__ import annotations

from corpusforge import fixed_values as fixed

ORACLES: dict[str, str] = {}

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '{WS}+', '', 'g'))"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def one_of(key: str, values: list[str]) -> str:
    return f"([{', '.join(map(quoted, values))}])[({key}) % {len(values)} + 1]"


def case_of(key: str, values: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def score(x: str) -> str:
    mean = f"({letters(x)}::DOUBLE / {words(x)})"
    return f"""CASE WHEN NOT regexp_matches({x}, '{NOT_WS}') THEN 0.0 ELSE
      0.2 * least(1.0, length({x}) / 1000.0::DOUBLE) + 0.2 * least(1.0, {words(x)} / 100.0::DOUBLE)
      + 0.3 * (CASE WHEN {mean} < 4 THEN {mean} / 4 WHEN {mean} <= 8 THEN 1.0 ELSE greatest(0.1, 8 / {mean}) END)
      + 0.2 * least(1.0, len(regexp_split_to_array({x}, '[.!?]+')) / 10.0::DOUBLE)
      + 0.1 * least(1.0, len(list_distinct(string_split(lower({x}), ''))) / 26.0::DOUBLE) END"""


def status(x: str) -> str:
    return f"CASE WHEN length({strip(x)}) < 100 THEN 'too_short' WHEN {score(x)} < 0.7 THEN 'low_quality' ELSE 'ok' END"


def clean(x: str) -> str:
    """Every table text has the same NFC and NFKC forms, so NFC stands for both."""
    flat = f"replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    flat = f"regexp_replace({flat}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    flat = f"regexp_replace({flat}, '[ \\t]{{2,}}', ' ', 'g')"
    kept = r"""[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}\-.,!?;:()\[\]{}"''/@#$%^&*+=<>|\\`~]"""
    return strip(f"regexp_replace({flat}, '{kept}', '', 'g')")


def header(x: str) -> str:
    listed = " OR ".join(f"contains(lower({x}), {quoted(w)})" for w in fixed.HEADER_FOOTER_WORDS)
    return f"({words(x)} <= 3 OR {listed})"


def prose(x: str) -> str:
    return rf"(length({x}) > 10 AND NOT regexp_full_match({x}, '\p{{Nd}}+') AND {words(x)} > 2 AND NOT {header(x)})"


def meaningful(x: str) -> str:
    full = f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda l: l <> '')"
    return f"(len({full}) >= 2 AND len(list_filter({full}, lambda l: {prose('l')})) * 2 > len({full}))"


def chunks(source: str, size: int = 4000, overlap: int = 200, name: str = "chunks") -> str:
    """CTEs ending in `name`(doc_id, chunk_id, start, stop, chunk) of `source`(doc_id, text)."""
    return f"""
    {name}_w AS (
      SELECT doc_id, text, length(text) AS n, 0 AS s,
        CASE WHEN length(text) <= {size} THEN length(text) ELSE {size} END AS e0 FROM {source}
      UNION ALL
      SELECT doc_id, text, n, e - {overlap}, e - {overlap} + {size} FROM (
        SELECT *, CASE WHEN n <= {size} THEN n + {overlap} WHEN s + {size} < n AND p > 0 THEN s + {size} - {overlap} + p + 1
          ELSE s + {size} END AS e
        FROM (SELECT *, {overlap} - strpos(reverse(substring(text, s + {size} - {overlap} + 1, {overlap})), '.')
            - CASE WHEN contains(substring(text, s + {size} - {overlap} + 1, {overlap}), '.') THEN 0 ELSE {overlap} END AS p FROM {name}_w)
      ) WHERE e - {overlap} < n
    ),
    {name}_c AS (
      SELECT doc_id, n, s AS start,
        CASE WHEN n <= {size} THEN n WHEN s + {size} < n AND p > 0 THEN s + {size} - {overlap} + p + 1 ELSE least(n, s + {size}) END AS stop, text
      FROM (SELECT *, {overlap} - strpos(reverse(substring(text, s + {size} - {overlap} + 1, {overlap})), '.')
          - CASE WHEN contains(substring(text, s + {size} - {overlap} + 1, {overlap}), '.') THEN 0 ELSE {overlap} END AS p FROM {name}_w)
    ),
    {name}_t AS (
      SELECT doc_id, start, stop, CASE WHEN n <= {size} THEN text ELSE {strip("substring(text, start + 1, stop - start)")} END AS chunk, n
      FROM {name}_c
    ),
    {name} AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_id, start, stop, chunk
      FROM {name}_t WHERE n <= {size} OR chunk <> ''
    )"""


def chunk_rows(ctes: str, name: str = "chunks") -> str:
    return f"WITH RECURSIVE {ctes} SELECT doc_id, chunk_id::BIGINT AS chunk_id, length(chunk)::BIGINT AS n_chars, md5(chunk) AS chunk_md5 FROM {name}"


# --- text -------------------------------------------------------------------------------

ORACLES["text_quality"] = f"SELECT doc_id, round({score('text')}, 6) AS score FROM documents"
ORACLES["quality_gate"] = f"SELECT doc_id, {status('text')} AS status FROM documents"
ORACLES["simple_check"] = (
    f"SELECT doc_id, length({strip('text')}) >= 100 AND {words('text')} >= 10 AND {letters('text')}::DOUBLE / {words('text')} <= 15 AS passes FROM documents"
)
ORACLES["min_length"] = f"""
SELECT doc_id, md5(t) AS text_md5, NOT regexp_matches(t, '{NOT_WS}') AS is_blank
FROM (SELECT doc_id, CASE WHEN length({strip('text')}) < 500 THEN '' ELSE text END AS t FROM documents)"""
ORACLES["text_profile"] = f"""
SELECT doc_id, len({lines('text')})::BIGINT AS line_count, {words('text')}::BIGINT AS word_count, length(text)::BIGINT AS char_count,
  round({words('text')} / 200.0::DOUBLE, 6) AS reading_minutes FROM documents"""
ORACLES["token_estimates"] = f"""
SELECT doc_id, (length(text) // 4)::BIGINT AS by_chars, len(regexp_extract_all(text, '{NOT_WS}+'))::BIGINT AS by_words,
  (strlen(text) // 2)::BIGINT AS by_bytes FROM documents"""
ORACLES["clean_text"] = f"SELECT doc_id, md5({clean('text')}) AS clean_md5 FROM documents"
_KEPT = rf"array_to_string(list_filter({lines('text')}, lambda l: NOT regexp_matches({strip('l')}, '^(copyright|licensed|all rights|[a-z]{{1,12}}\.)', 'i')), chr(10))"
ORACLES["remove_headers"] = f"SELECT doc_id, md5(t) AS kept_md5, length(t)::BIGINT AS kept_chars FROM (SELECT doc_id, {_KEPT} AS t FROM documents)"
ORACLES["meaningful_text"] = f"SELECT doc_id, {meaningful('text')} AS meaningful FROM documents"
ORACLES["header_lines"] = f"""
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE {header('l')})::BIGINT AS n_header_lines
FROM (SELECT doc_id, {strip('l')} AS l FROM (SELECT doc_id, unnest({lines('text')}) AS l FROM documents)) GROUP BY doc_id"""
ORACLES["excerpts"] = "SELECT doc_id, " + ", ".join(
    f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '...' ELSE text END AS excerpt_{n}" for n in (200, 500, 1000)
) + " FROM documents"


def html(x: str) -> str:
    hidden = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"
    shown = f"regexp_replace({x}, '{hidden}', chr(64976), 'g')"
    shown = f"regexp_replace({shown}, '(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>', chr(64976), 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        shown = f"replace({shown}, '&{name};', '{char}')"
    return f"array_to_string(list_filter(list_transform(string_split({shown}, chr(64976)), lambda s: {strip('s')}), lambda s: s <> ''), ' ')"


ORACLES["html_text"] = f"SELECT page_id, {html('html')} AS text FROM pages"
_BOOK = "regexp_extract(url, '^https?://([^/]+)', 1)"
ORACLES["html_profile"] = f"""
SELECT {_BOOK} AS book, count(*)::BIGINT AS chapter_count, sum(strlen(html))::BIGINT AS total_content_size,
  (sum(strlen(html)) // 2000)::BIGINT AS estimated_pages FROM pages GROUP BY 1"""
ORACLES["html_book"] = f"""
WITH c AS (SELECT {_BOOK} AS path, page_id + 1 AS p, {html('html')} AS t FROM pages)
SELECT path, count(*)::BIGINT AS n_pages,
  md5({strip("string_agg('=== Chapter ' || p || ' ===' || chr(10) || chr(10) || t, repeat(chr(10), 4) ORDER BY p)")}) AS text_md5
FROM c WHERE p >= 3 AND p NOT IN (5, 8) GROUP BY 1"""
_FLAT = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"
ORACLES["srt_text"] = rf"""
WITH l AS (SELECT conv_id, turn, role, list_filter(list_transform({lines("replace(" + _FLAT + ", chr(13), chr(10))")}, lambda s: {strip('s')}),
  lambda s: s <> '' AND NOT regexp_full_match(s, '\p{{Nd}}+')) AS said FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat(said, ['<i>' || role || '</i>']), ' ') AS said, 2::BIGINT AS entries FROM l"""
ORACLES["vtt_text"] = f"""
SELECT conv_id, turn, regexp_replace({_FLAT}, '<[^>]+>', '', 'g') || ' ' || role || chr(10) || '12345' AS said, 2::BIGINT AS entries FROM conversations"""
ORACLES["decoded_text"] = "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS utf8_md5, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS latin_md5 FROM documents"

# --- chunks -----------------------------------------------------------------------------

ORACLES["chunk_default"] = chunk_rows(chunks("documents"))
ORACLES["chunk_tokens"] = chunk_rows(chunks("documents", 800, 200))
ORACLES["chunks_first_two"] = f"""
WITH RECURSIVE {chunks("documents")} SELECT doc_id, chunk_id::BIGINT AS chunk_id, md5(chunk) AS chunk_md5 FROM chunks WHERE chunk_id < 2"""
ORACLES["chunk_offsets"] = f"""
WITH RECURSIVE {chunks("documents")}
SELECT doc_id, chunk_id::BIGINT AS chunk_id, start::BIGINT AS start, stop::BIGINT AS "end",
  (lag(stop) OVER (PARTITION BY doc_id ORDER BY chunk_id) - start)::BIGINT AS overlap FROM chunks"""
ORACLES["chunk_paragraph"] = f"""
WITH RECURSIVE p AS (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps
  FROM documents),
m AS (
  SELECT doc_id, ps, 1 AS i, '' AS cur, NULL::VARCHAR AS done, 0 AS k FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN i > len(ps) THEN '' WHEN cur <> '' AND length(cur) + length(ps[i]) + 2 <= 1000 THEN cur || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
    CASE WHEN cur <> '' AND (i > len(ps) OR length(cur) + length(ps[i]) + 2 > 1000) THEN cur END,
    CASE WHEN cur <> '' AND (i > len(ps) OR length(cur) + length(ps[i]) + 2 > 1000) THEN k + 1 ELSE k END
  FROM m WHERE i <= len(ps) + 1)
SELECT doc_id, (k - 1)::BIGINT AS chunk_id, length(done)::BIGINT AS n_chars, md5(done) AS chunk_md5 FROM m WHERE done IS NOT NULL"""


def line_groups(size: int = 20) -> str:
    return f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS k, chunk FROM (
    SELECT doc_id, g, {strip("string_agg(l, chr(10) ORDER BY i)")} AS chunk FROM (
      SELECT doc_id, l, i, (i - 1) // {size} AS g FROM (
        SELECT doc_id, unnest({lines('text')}) AS l, unnest(range(1, len({lines('text')}) + 1)) AS i FROM documents))
    GROUP BY doc_id, g) WHERE chunk <> ''"""


ORACLES["chunk_lines"] = f"SELECT doc_id, k::BIGINT AS chunk_id, length(chunk)::BIGINT AS n_chars, md5(chunk) AS chunk_md5 FROM ({line_groups()})"
ORACLES["chunk_separator"] = f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.' || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS chunk_id, length(c)::BIGINT AS n_chars, md5(c) AS chunk_md5
FROM (SELECT doc_id, unnest(ps) AS c, unnest(range(1, len(ps) + 1)) AS i FROM p)"""

# --- prompts ----------------------------------------------------------------------------

_TEMPLATES = ", ".join(f"({quoted(g)}, {quoted(fixed.DEFAULT_PROMPTS[g] + chr(10) * 2 + 'Content:' + chr(10))})" for g in fixed.GENERATORS)
GENERATORS = f"g(generator, lead) AS (VALUES {_TEMPLATES})"
ORACLES["prompt_fanout"] = f"""
WITH RECURSIVE {GENERATORS}, {chunks("documents")}
SELECT doc_id, chunk_id::BIGINT AS chunk_id, generator, md5(lead || chunk) AS prompt_md5 FROM chunks, g"""
_ROUTES = "r(generator, provider, model, pin, pout) AS (VALUES ('conversations', 'openai', 'gpt-4o-mini', 0.15, 0.6), ('qa_pairs', 'anthropic', 'claude-3-haiku-20240307', 3.0, 15.0), ('embeddings', 'mistral', 'mistral-small-latest', 0.4, 0.8), ('summaries', 'local', 'local-unlisted', 0.0, 0.0))"
ORACLES["corpus_cost"] = f"""
WITH RECURSIVE {GENERATORS}, {_ROUTES},
cleaned AS (SELECT doc_id, {clean("CASE WHEN length(" + strip("text") + ") < 100 THEN '' ELSE text END")} AS text FROM documents),
good AS MATERIALIZED (SELECT doc_id, text FROM cleaned WHERE {status('text')} = 'ok'), {chunks("good")}
SELECT generator, provider, model, count(*)::BIGINT AS n_calls, sum(length(lead || chunk) // 4)::BIGINT AS tokens,
  round(sum(length(lead || chunk) // 4) / 1000.0::DOUBLE * (any_value(pin) + any_value(pout))::DOUBLE, 6) AS cost
FROM chunks, g JOIN r USING (generator) GROUP BY ALL"""
_STYLES = {"default": fixed.DEFAULT_PROMPTS, **fixed.STYLE_PROMPTS}
_STYLE_ROWS = ", ".join(f"({quoted(s)}, {quoted(g)}, {quoted(p)})" for s, ps in _STYLES.items() for g, p in ps.items())
ORACLES["prompt_styles"] = f"""
WITH s(style, generator, prompt) AS (VALUES {_STYLE_ROWS}), g(generator) AS (VALUES ('conversations'), ('qa_pairs'), ('embeddings'), ('summaries')),
d AS (SELECT doc_id, {one_of('doc_id', list(_STYLES))} AS style FROM documents)
SELECT doc_id, x.style, x.generator, coalesce(s.prompt, f.prompt) AS prompt, {case_of('x.generator', {g: quoted(p) for g, p in fixed.SYSTEM_PROMPTS.items()}, 'NULL')} AS system_prompt FROM (SELECT * FROM d CROSS JOIN g) x LEFT JOIN s ON s.style = x.style AND s.generator = x.generator LEFT JOIN s f ON f.style = 'default' AND f.generator = x.generator"""

# Answers by shape. `n` items each; shapes 6 and 7 give none.
ANSWERS = f"""{GENERATORS}, {chunks("documents")},
a AS (SELECT doc_id, chunk_id, generator, (doc_id + chunk_id) % 8 AS shape, (doc_id + chunk_id) % 3 + 1 AS attempt,
  chunk AS said, to_json('q ' || chunk)::VARCHAR AS q, to_json('a ' || chunk)::VARCHAR AS ans,
  CASE WHEN (doc_id + chunk_id) % 8 = 5 THEN ',"timestamp":"2024-02-02T00:00:00Z"}}' ELSE '}}' END AS fin FROM chunks, g),
listed AS (SELECT *, CASE generator WHEN 'conversations' THEN '{{"messages":[{{"content":' || q || ',"role":"user"}},{{"content":' || ans || ',"role":"assistant"}}]' || fin
  WHEN 'qa_pairs' THEN '{{"answer":' || ans || ',"question":' || q || fin
  WHEN 'embeddings' THEN '{{"sentence1":' || q || ',"sentence2":' || ans || ',"similarity":0.5' || fin
  ELSE '{{"summary":' || ans || fin END AS item,
  CASE shape WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS n FROM a),
items AS (SELECT doc_id, chunk_id, generator, said, shape, unnest(range(n)) AS item_no, item FROM listed)"""
ORACLES["parse_completions"] = f"WITH RECURSIVE {ANSWERS} SELECT doc_id, chunk_id::BIGINT AS chunk_id, generator, item_no::BIGINT AS item_no, md5(item) AS item_md5 FROM items"
ORACLES["rejected_completions"] = f"""
WITH RECURSIVE {ANSWERS} SELECT doc_id, chunk_id::BIGINT AS chunk_id, generator, CASE shape WHEN 6 THEN 'unexpected_type' ELSE 'not_json' END AS reason,
  CASE shape WHEN 6 THEN '42' ELSE 'Sorry, here is ' || said END AS raw FROM a WHERE shape >= 6"""
ORACLES["retry_prompts"] = f"""
WITH RECURSIVE {ANSWERS} SELECT doc_id, chunk_id::BIGINT AS chunk_id, generator, (attempt + 1)::BIGINT AS attempt,
  'Your output wasn''t valid JSON. Please re-emit exactly valid JSON matching this schema:' || chr(10) || chr(10) || CASE generator
    WHEN 'conversations' THEN '{{"conversations": [{{"messages": [{{"role": "string", "content": "string"}}]}}]}}'
    WHEN 'qa_pairs' THEN '{{"qa_pairs": [{{"question": "string", "answer": "string"}}]}}'
    WHEN 'embeddings' THEN '{{"embeddings": [{{"sentence1": "string", "sentence2": "string", "similarity": 0.0}}]}}'
    ELSE '{{"summaries": ["string"]}}' END || chr(10) || chr(10) || 'Previous output:' || chr(10) || {strip("'Sorry, here is ' || said")} AS prompt
FROM a WHERE shape = 7 AND attempt < 3"""
_KEYS = "doc_id, chunk_id::BIGINT AS chunk_id, item_no::BIGINT AS item_no"
ORACLES["typed_qa_pairs"] = f"WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, 'q ' || said AS question, 'a ' || said AS answer FROM items WHERE generator = 'qa_pairs'"
ORACLES["typed_embeddings"] = f"WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, 'q ' || said AS sentence1, 'a ' || said AS sentence2, 0.5::DOUBLE AS similarity FROM items WHERE generator = 'embeddings'"
ORACLES["typed_summaries"] = f"WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, 'a ' || said AS summary FROM items WHERE generator = 'summaries'"
ORACLES["typed_conversations"] = f"""
WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, m::BIGINT AS message_no, CASE m WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE m WHEN 0 THEN 'q ' ELSE 'a ' END || said AS content FROM items, range(2) t(m) WHERE generator = 'conversations'"""
ORACLES["tagged_items"] = f"""
WITH RECURSIVE {ANSWERS} SELECT generator AS item_generator, CASE shape WHEN 5 THEN '2024-02-02T00:00:00Z' ELSE '2024-01-20T00:00:00Z' END AS item_timestamp,
  count(*)::BIGINT AS n_items FROM items GROUP BY 1, 2"""
ORACLES["items_merged"] = f"""
WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, generator, CASE generator WHEN 'summaries' THEN 'a ' ELSE 'q ' END || said AS lead FROM items WHERE generator <> 'conversations'"""
ORACLES["items_of_two_runs"] = """
SELECT doc_id, text AS question, lang, NULL::VARCHAR AS summary FROM documents UNION ALL SELECT item_id, NULL, NULL, text FROM benchmark"""
ORACLES["items_override"] = f"""
WITH RECURSIVE {ANSWERS}, toxic AS (SELECT doc_id FROM labels WHERE toxic = 1),
u AS (SELECT doc_id, generator, item FROM items WHERE NOT (generator = 'qa_pairs' AND doc_id IN (SELECT doc_id FROM toxic))
  UNION ALL SELECT doc_id, 'qa_pairs', '{{"question":"picture?"}}' FROM toxic)
SELECT doc_id, generator, count(*)::BIGINT AS n_items, max(item) AS last_item FROM u GROUP BY 1, 2"""
ORACLES["full_flow"] = f"""
WITH RECURSIVE {GENERATORS}, {chunks("documents")}, toxic AS (SELECT doc_id FROM labels WHERE toxic = 1),
p AS (SELECT doc_id, chunk_id, generator, lead || chunk AS asked FROM chunks, g
  WHERE generator = 'summaries' OR generator = 'qa_pairs' AND doc_id NOT IN (SELECT doc_id FROM toxic)
  UNION ALL SELECT doc_id, 0, 'qa_pairs', 'Describe the picture: img/' || doc_id || '.png' FROM toxic)
SELECT doc_id, chunk_id::BIGINT AS chunk_id, 0::BIGINT AS item_no, generator, CASE generator WHEN 'qa_pairs' THEN md5(asked) END AS question,
  CASE generator WHEN 'qa_pairs' THEN length(asked)::VARCHAR END AS answer, CASE generator WHEN 'summaries' THEN md5(asked) END AS summary FROM p"""
ORACLES["items_by_generator"] = f"""
WITH RECURSIVE {ANSWERS} SELECT generator, count(*)::BIGINT AS n_items, count(DISTINCT doc_id)::BIGINT AS n_docs FROM items GROUP BY 1"""
ORACLES["items_per_document"] = f"WITH RECURSIVE {ANSWERS} SELECT doc_id, " + ", ".join(
    f"(count(*) FILTER (WHERE generator = '{g}'))::BIGINT AS {g}" for g in fixed.GENERATORS
) + " FROM items GROUP BY 1"
ORACLES["item_stats"] = f"WITH RECURSIVE {ANSWERS} SELECT count(*)::BIGINT AS n_items, round(avg(length(item)) + 3e-9, 6) AS avg_length FROM items"
ORACLES["csv_header"] = f"""
WITH RECURSIVE {ANSWERS} SELECT DISTINCT generator, unnest(json_keys(item)) AS field FROM items WHERE item[1] = '{{'"""
_OWN_TIME = "CASE shape WHEN 5 THEN '|2024-02-02T00:00:00Z' ELSE '' END"
ORACLES["typed_csv"] = f"""
WITH RECURSIVE {ANSWERS} SELECT {_KEYS}, generator, CASE generator WHEN 'embeddings' THEN 'chunk_id,doc_id,item_no,sentence1,sentence2,similarity,timestamp'
    ELSE 'chunk_id,doc_id,item_no,messages,timestamp' END AS header,
  md5(CASE generator WHEN 'embeddings' THEN 'q ' || said || '|a ' || said || '|0.5' ELSE json_extract(item, '$.messages')::VARCHAR END || {_OWN_TIME}) AS values_md5
FROM items WHERE generator IN ('embeddings', 'conversations')"""
ORACLES["sample_items"] = "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || ':0'), doc_id LIMIT 5"

# --- conversations and rendering ---------------------------------------------------------

ORACLES["chat_rows"] = """
SELECT conv_id, count(*)::BIGINT AS n_messages, string_agg(role || ': ' || text, '|' ORDER BY turn) AS chat
FROM conversations GROUP BY 1"""
ORACLES["chat_flat"] = """
SELECT conv_id AS conversation_id, '' AS source_file, row_number() OVER w - 1 AS message_index, role, text AS content,
  count(*) OVER (PARTITION BY conv_id)::BIGINT AS conversation_length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
ORACLES["chat_jsonl"] = """
SELECT conv_id,
  '{"messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS json
FROM conversations GROUP BY 1"""
ORACLES["chat_long"] = """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS message_index, role, md5(text) AS content_md5, count(*) OVER () AS conversation_length FROM conversations"""
_CHATS = """chats AS (SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS said FROM conversations GROUP BY 1),
docs AS (SELECT 'turns-' || n AS stem, row_number() OVER (PARTITION BY n ORDER BY conv_id) AS i, count(*) OVER (PARTITION BY n) AS total, * FROM chats)"""
ORACLES["csv_rows"] = f"""
WITH {_CHATS} SELECT stem, i::BIGINT AS item_no, (k - 1)::BIGINT AS message_index, roles[k] AS role, md5(said[k]) AS content_md5, n::BIGINT AS conversation_length
FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM docs)"""
ORACLES["render_txt"] = f"""
WITH {_CHATS}
SELECT stem, i::BIGINT AS block_no, 'CONVERSATION ' || i || chr(10) || repeat('-', 30) || chr(10)
  || array_to_string(list_transform(range(1, n + 1), lambda k: upper(roles[k]) || ': ' || said[k] || chr(10) || chr(10)), '')
  || 'Source: ' || stem || '.txt' || chr(10) || repeat('=', 50) || chr(10) AS block FROM docs
UNION ALL SELECT DISTINCT stem, 0::BIGINT, 'CONVERSATION TRAINING DATA' || chr(10) || repeat('=', 50) || chr(10) || 'Total conversations: ' || total || chr(10) FROM docs"""
ORACLES["render_markdown"] = f"""
WITH {_CHATS}
SELECT stem, i::BIGINT AS block_no, '## Conversation ' || i || chr(10) || chr(10)
  || array_to_string(list_transform(range(1, n + 1), lambda k: '**' || upper(left(roles[k], 1)) || substring(roles[k], 2) || ':** ' || said[k] || chr(10) || chr(10)), '')
  || '*Source: ' || stem || '.txt*' || chr(10) || chr(10) || '---' || chr(10) AS block FROM docs
UNION ALL SELECT DISTINCT stem, 0::BIGINT, '# Conversation Training Data' || chr(10) || chr(10) || '**Total conversations:** ' || total || chr(10) FROM docs"""


def xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_QA = f"""{ANSWERS}, qa AS (SELECT doc_id, said, {xml('said')} AS shown, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, item_no) AS i,
  count(*) OVER (PARTITION BY doc_id) AS total FROM items WHERE generator = 'qa_pairs')"""
ORACLES["render_xml"] = f"""
WITH RECURSIVE {_QA}
SELECT doc_id, i::BIGINT AS block_no, '  <qa_pair id="' || i || '">' || chr(10) || '    <question>q ' || shown || '</question>' || chr(10)
  || '    <answer>a ' || shown || '</answer>' || chr(10) || '  </qa_pair>' AS block FROM qa
UNION ALL SELECT DISTINCT doc_id, 0::BIGINT, '<?xml version="1.0" ?>' || chr(10) || '<qa_pairs count="' || total || '">' FROM qa
UNION ALL SELECT DISTINCT doc_id, (total + 1)::BIGINT, '</qa_pairs>' || chr(10) FROM qa"""
ORACLES["render_json"] = f"""
WITH RECURSIVE {_QA}
SELECT doc_id, i::BIGINT AS block_no, CASE WHEN i > 1 THEN ',' ELSE '' END || '{{"question":' || to_json('q ' || said)::VARCHAR || ',"answer":' || to_json('a ' || said)::VARCHAR || '}}' AS block FROM qa
UNION ALL SELECT DISTINCT doc_id, 0::BIGINT, '[' FROM qa UNION ALL SELECT DISTINCT doc_id, (total + 1)::BIGINT, ']' FROM qa"""
ORACLES["render_summaries"] = """
WITH n AS (SELECT source, text AS summary, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
  count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, i::BIGINT AS block_no, '## Summary ' || i || chr(10) || chr(10) || '**Summary:** ' || summary || chr(10) || chr(10)
  || '**Original Text:**' || chr(10) || '```' || chr(10) || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END
  || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) AS block FROM n
UNION ALL SELECT DISTINCT source, 0::BIGINT, '# Summary Training Data' || chr(10) || chr(10) || '**Total summaries:** ' || total || chr(10) FROM n"""

# --- labels and duplicates ---------------------------------------------------------------

ORACLES["labelled_filter"] = """
SELECT doc_id, lang, quality::DOUBLE AS quality_score FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) >= 0.7"""
ORACLES["duplicate_groups"] = """
SELECT md5(text) AS content_hash, count(*)::BIGINT AS n_members, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1"""
ORACLES["duplicate_members"] = """
SELECT doc_id, content_hash, n_members, first_member FROM (SELECT doc_id, md5(text) AS content_hash, count(*) OVER (PARTITION BY md5(text))::BIGINT AS n_members,
  min(doc_id) OVER (PARTITION BY md5(text)) AS first_member FROM documents) WHERE n_members > 1"""
ORACLES["dedupe_documents"] = """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1"""
ORACLES["file_hashes"] = "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents"

# --- manifests ---------------------------------------------------------------------------

_EXT = one_of("doc_id", ["pdf", "txt", "srt", "vtt", "epub", "png", "docx", "TXT"])
FILES = f"""f AS (SELECT doc_id, source || '/' || doc_id || '.' || {_EXT} AS path, doc_id::VARCHAR AS stem, '.' || lower({_EXT}) AS ext,
  strlen(text)::BIGINT AS length, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime, text FROM documents)"""
_PROCESSOR = case_of("ext", {k: quoted(v) for k, v in fixed.PROCESSOR_BY_EXT.items()}, "'unsupported'")
_MIME = case_of("ext", {k: quoted(v) for k, v in fixed.MIME_BY_EXT.items()}, "NULL")
_SUPPORTED = "ext IN (" + ", ".join(map(quoted, fixed.PROCESSOR_BY_EXT)) + ")"
ORACLES["file_manifest"] = f"""
WITH {FILES} SELECT path, split_part(path, '/', 2) AS name, stem, ext, length, round(length / 1048576.0::DOUBLE, 6) AS size_mb, {_MIME} AS mime_type,
  {_PROCESSOR} AS processor, md5(text) AS md5, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS modified FROM f"""
ORACLES["files_by_type"] = f"""
WITH {FILES} SELECT ext, count(*)::BIGINT AS n_files, sum(length)::BIGINT AS total_bytes, min(path) AS first_path, max(path) AS last_path FROM f GROUP BY 1"""
ORACLES["extensions"] = f"WITH {FILES} SELECT DISTINCT ext FROM f"
ORACLES["dir_size"] = f"WITH {FILES} SELECT count(*)::BIGINT AS n_files, sum(length)::BIGINT AS total_bytes FROM f"
ORACLES["admission"] = f"""
WITH {FILES} SELECT path, {_SUPPORTED} AS supported, length > 20000 AS too_large,
  CASE WHEN length > 20000 THEN 'too_large' WHEN {_SUPPORTED} THEN 'ok' ELSE 'unsupported' END AS status FROM f"""
ORACLES["validation_summary"] = f"""
WITH {FILES} SELECT count(*)::BIGINT AS total_files, (count(*) FILTER (WHERE {_SUPPORTED}))::BIGINT AS supported_files,
  (count(*) FILTER (WHERE NOT {_SUPPORTED}))::BIGINT AS unsupported_files, (count(*) FILTER (WHERE length > 20000))::BIGINT AS large_files,
  round(sum(length / 1048576.0::DOUBLE), 6) AS total_size_mb FROM f"""
ORACLES["first_files"] = f"WITH {FILES} SELECT path, length FROM f ORDER BY path LIMIT 3"
ORACLES["snapshot_diff"] = f"""
WITH {FILES}, later AS (
  SELECT path, mtime + CASE WHEN toxic = 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS mtime FROM f LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) <> 0
  UNION ALL SELECT 'web/' || page_id || '.html', TIMESTAMP '2024-01-01' + to_minutes(page_id) FROM pages)
SELECT path, change FROM (SELECT path, CASE WHEN f.mtime IS NULL THEN 'added' WHEN later.mtime IS NULL THEN 'deleted' WHEN f.mtime <> later.mtime THEN 'modified' END AS change
  FROM f FULL JOIN later USING (path)) WHERE change IS NOT NULL"""
ORACLES["remaining_files"] = f"WITH {FILES} SELECT path, length FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
_SIMPLE = "md5(path || epoch(mtime)::BIGINT || length)"
_FACTS = '{"end_page":null,"header_regex":"","min_image_size":1000,"min_text_length":100,"quality_threshold":0.7,"skip_pages":"","skip_single_color_images":false,"start_page":1,"use_ocr":true}'
ORACLES["cache_keys"] = f"""
WITH {FILES} SELECT path, sha256('{{"config":{_FACTS.replace(',"header', ',"header').replace('"end_page":null,', '')},"file_mtime":' || epoch(mtime)::BIGINT || ',"file_path":' || to_json(path) || ',"file_size":' || length || '}}') AS cache_key,
  {_SIMPLE} AS simple_key FROM f"""
STORE = f"""{FILES}, store AS (SELECT {_SIMPLE} AS cache_key, path || CASE WHEN toxic = 1 THEN '' ELSE '.gz' END AS path,
  CASE WHEN quality = 0 THEN '1.0' ELSE '2.0' END AS version, length, mtime + CASE WHEN toxic = 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS mtime,
  mtime + INTERVAL 2 HOUR AS cached_at, mtime + to_seconds(length) AS accessed_at, length AS size, text FROM f JOIN labels USING (doc_id))"""
ORACLES["reuse_extractions"] = f"""
WITH {STORE} SELECT path, reuse, CASE reuse WHEN 'valid' THEN md5(text) END AS text_md5 FROM (
  SELECT f.path, s.text, CASE WHEN s.cache_key IS NULL THEN 'missing' WHEN s.version <> '2.0' THEN 'version' WHEN s.mtime <> f.mtime OR s.length <> f.length THEN 'changed'
    WHEN TIMESTAMP '2024-01-31 06:00:00' - s.cached_at > INTERVAL 30 DAY THEN 'expired' ELSE 'valid' END AS reuse
  FROM f LEFT JOIN store s ON s.cache_key = md5(f.path || epoch(f.mtime)::BIGINT || f.length))"""
ORACLES["retention"] = f"""
WITH {STORE}, aged AS (SELECT *, epoch(TIMESTAMP '2024-01-20' - accessed_at) / 86400.0 > 19 AS old FROM store),
live AS (SELECT *, sum(size) OVER (ORDER BY accessed_at DESC, path DESC ROWS UNBOUNDED PRECEDING) AS newer FROM aged WHERE NOT old)
SELECT path, size, CASE WHEN newer > 400000 THEN 'evicted' ELSE 'kept' END AS verdict FROM live
UNION ALL SELECT path, size, 'expired' FROM aged WHERE old"""
ORACLES["store_stats"] = f"""
WITH {STORE} SELECT count(*)::BIGINT AS entries, round(sum(size / 1048576.0::DOUBLE), 2) AS total_mb, round(avg(size / 1048576.0::DOUBLE), 2) AS avg_mb,
  (count(*) FILTER (WHERE path LIKE '%.gz'))::BIGINT AS compressed_entries, round((count(*) FILTER (WHERE path LIKE '%.gz')) / count(*)::DOUBLE, 2) AS compressed_share FROM store"""
ORACLES["store_types_sample"] = f"""
WITH {STORE} SELECT lower('.' || split_part(replace(path, '.gz', ''), '.', 2)) AS ext, count(*)::BIGINT AS n_entries
FROM (SELECT path FROM store ORDER BY cache_key LIMIT 100) GROUP BY 1"""
ORACLES["file_batches"] = f"WITH {FILES} SELECT path, ((row_number() OVER (ORDER BY path) - 1) // 10 + 1)::BIGINT AS batch_no FROM f"
_RATE = "CASE WHEN ext = '.pdf' THEN 2.0 WHEN ext IN ('.png', '.jpg', '.jpeg') THEN 0.5 ELSE 0.1 END"
ORACLES["dry_run"] = f"""
WITH {FILES} SELECT count(*)::BIGINT AS n_files, round(sum(length / 1048576.0::DOUBLE), 6) AS total_mb,
  round(sum(length / 1048576.0::DOUBLE * {_RATE}) / (4 * 0.7::DOUBLE), 6) AS estimated_seconds FROM f"""
ORACLES["processing_estimates"] = f"""
WITH {FILES} SELECT path, round(CASE WHEN ext = '.pdf' THEN (doc_id % 40 + 1) * (CASE doc_id % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 0.8 END + 0.8)::DOUBLE
  WHEN ext = '.epub' THEN (doc_id % 40 + 1) * 0.3::DOUBLE WHEN ext = '.png' THEN length / 1048576.0::DOUBLE * 2.1 WHEN ext IN ('.txt', '.srt', '.vtt') THEN length / 1048576.0::DOUBLE * 0.1
  ELSE length / 1048576.0::DOUBLE END, 6) AS seconds FROM f"""

# --- run logs ----------------------------------------------------------------------------

LOG = """log AS (SELECT doc_id AS seq, source || '/' || doc_id AS path, source AS processor, doc_id % 17 NOT IN (3, 4, 5) AS success,
  CASE WHEN doc_id % 17 IN (3, 4, 5) THEN 0 ELSE n_chars END AS text_chars, CASE WHEN doc_id % 17 IN (3, 4, 5) THEN 0 ELSE doc_id % 4 END AS image_count,
  n_chars % 997 / 64.0::DOUBLE + 0.5 AS seconds, CASE WHEN doc_id % 17 IN (3, 4, 5) THEN CASE WHEN doc_id % 5 = 0 THEN 'HTTP 429: quota exceeded'
  ELSE 'Content quality below threshold' END END AS error FROM documents)"""
STREAKS = f"""{LOG}, isles AS (SELECT *, sum(success::INT) OVER (ORDER BY seq) AS successes, sum(seconds) OVER (ORDER BY seq) AS elapsed FROM log),
streaks AS (SELECT *, CASE WHEN success THEN 0 ELSE sum((NOT success)::INT) OVER (PARTITION BY successes ORDER BY seq) END AS streak FROM isles)"""


def reasons(failures: int, files: int | None = None, seconds: float | None = None) -> str:
    rules = [f"WHEN streak >= {failures} THEN 'consecutive failures'"]
    rules += [f"WHEN elapsed >= {seconds} THEN 'time limit'"] if seconds else []
    rules += [f"WHEN successes >= {files} THEN 'file limit'"] if files else []
    rules += ["WHEN NOT success AND (lower(error) LIKE '%quota%' OR lower(error) LIKE '%429%') THEN 'quota exceeded'"]
    return "CASE " + " ".join(rules) + " END"


ORACLES["auto_stop"] = f"""
WITH {STREAKS}, m AS (SELECT seq, {reasons(3)} AS reason FROM streaks)
SELECT min(seq) AS stop_seq, arg_min(reason, seq) AS reason FROM m WHERE reason IS NOT NULL"""
ORACLES["auto_stop_limits"] = f"""
WITH {STREAKS} SELECT seq, streak::BIGINT AS streak, successes::BIGINT AS successes, round(elapsed, 6) AS elapsed, {reasons(3, 40, 600)} AS reason FROM streaks"""
ORACLES["checkpoint_split"] = f"""
WITH {STREAKS}, m AS (SELECT min(seq) AS stop FROM streaks WHERE {reasons(4, 60)} IS NOT NULL)
SELECT seq, path, CASE WHEN stop IS NULL OR seq < stop THEN 'processed' ELSE 'remaining' END AS state FROM log, m"""
ORACLES["resume"] = f"""
WITH {STREAKS}, m AS (SELECT min(seq) AS stop FROM streaks WHERE {reasons(4, 60)} IS NOT NULL)
SELECT seq, path, success, text_chars::BIGINT AS text_chars, CASE WHEN stop IS NULL OR seq < stop THEN 'before' ELSE 'resumed' END AS run FROM log, m"""
ORACLES["run_summary"] = f"""
WITH {LOG} SELECT count(*)::BIGINT AS files_total, sum(success::INT)::BIGINT AS files_successful, sum((NOT success)::INT)::BIGINT AS files_failed,
  sum(text_chars)::BIGINT AS total_text_chars, sum(image_count)::BIGINT AS total_images FROM log"""
ORACLES["run_errors"] = f"WITH {LOG} SELECT seq, path, error FROM log WHERE NOT success"
_PERF = """count(*)::BIGINT AS files, sum(image_count)::BIGINT AS images, round(sum(seconds) + 3e-9, 6) AS total_seconds, round(avg(seconds) + 3e-9, 6) AS avg_seconds,
  round(avg(text_chars) + 3e-9, 6) AS avg_chars, round(sum(text_chars) / sum(seconds) + 3e-9, 6) AS chars_per_second FROM log WHERE success"""
ORACLES["processor_performance"] = f"WITH {LOG} SELECT processor, {_PERF} GROUP BY 1 UNION ALL SELECT '*', {_PERF}"
ORACLES["processor_stats"] = f"""
WITH {LOG} SELECT processor, count(*)::BIGINT AS files_processed, sum(success::INT)::BIGINT AS files_successful, round(avg(success::INT) + 3e-9, 6) AS success_rate,
  round(avg(seconds) + 3e-9, 6) AS avg_seconds, round(avg(text_chars) FILTER (WHERE success) + 3e-9, 6) AS avg_text_per_file,
  round(avg(image_count) FILTER (WHERE success) + 3e-9, 6) AS avg_images_per_file FROM log GROUP BY 1"""
ORACLES["slowest_files"] = f"WITH {LOG} SELECT path, seconds FROM log WHERE success ORDER BY seconds DESC, path LIMIT 5"
ORACLES["recent_errors"] = f"WITH {LOG} SELECT seq, path, error FROM log WHERE NOT success ORDER BY seq DESC LIMIT 3"
_BATCH = """count(*)::BIGINT AS files_processed, sum(success::INT)::BIGINT AS successful, sum((NOT success)::INT)::BIGINT AS failed,
  sum(text_chars)::BIGINT AS total_text_chars, bool_and(success) AS all_ok"""
ORACLES["batch_totals"] = f"""
WITH {LOG}, b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 100 + 1 AS batch_no FROM log)
SELECT batch_no::BIGINT AS batch_no, {_BATCH} FROM b GROUP BY 1 UNION ALL SELECT 0::BIGINT, {_BATCH} FROM b"""
ORACLES["run_progress"] = f"""
WITH {LOG}, p AS (SELECT *, row_number() OVER (ORDER BY seq) AS n, count(*) OVER () AS total, sum(success::INT) OVER (ORDER BY seq) AS ok,
  sum(text_chars) OVER (ORDER BY seq) AS c, sum(seconds) OVER (ORDER BY seq) AS el FROM log)
SELECT seq, n::BIGINT AS processed, ok::BIGINT AS completed, c::BIGINT AS chars, round(el + 3e-9, 6) AS elapsed, round(n / total::DOUBLE * 100 + 3e-9, 6) AS percent,
  round(el / n + 3e-9, 6) AS avg_seconds, round(el / n * (total - n) + 3e-9, 6) AS eta_seconds FROM p"""
ORACLES["moving_average"] = """
SELECT event_id, round(avg(round(value * 100)::BIGINT) OVER w + 3e-9, 6) AS moving_avg, count(value) OVER w AS sample_count, round(epoch_us(ts) / 1e6 - epoch_us(first_value(ts) OVER w) / 1e6, 6) AS span_seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING)"""

# --- pages and images --------------------------------------------------------------------

PAGES = f"""p AS (SELECT doc_id, 'doc/' || doc_id || '.pdf' AS path, k + 1 AS page_num, chunk AS text, (doc_id * (k + 1)) % 4 AS image_count FROM ({line_groups()})),
areas AS (SELECT doc_id, path, page_num, i - 1 AS image_index, (doc_id * 7919 + page_num * 104729 + i * 1299709) % 1200000 AS area, doc_id + page_num * 31 AS seed
  FROM (SELECT *, unnest(range(1, image_count + 1)) AS i FROM p))"""
_BIG = "(SELECT count(*) FROM areas a WHERE a.doc_id = p.doc_id AND a.page_num = p.page_num AND a.area > 10000)"
INFO = f"""{PAGES}, big AS (SELECT doc_id, page_num, count(*) FILTER (WHERE area > 10000) AS n FROM areas GROUP BY 1, 2),
info AS (SELECT path, page_num, length({strip('text')}) AS chars, {words('text')} AS w, image_count, coalesce(n, 0) AS significant, text,
  (length({strip('text')}) >= 50 AND {words('text')} >= 10 AND {meaningful('text')}) AS prose, image_count > 0 AS pics FROM p LEFT JOIN big USING (doc_id, page_num))"""
ORACLES["page_analysis"] = f"""
WITH {INFO} SELECT path, page_num::BIGINT AS page_num, chars::BIGINT AS text_length, w::BIGINT AS word_count, image_count::BIGINT AS image_count,
  significant::BIGINT AS significant_images, prose AS has_meaningful_text, pics AS has_images, round(chars / greatest(image_count, 1)::DOUBLE + 3e-9, 6) AS text_to_image_ratio FROM info"""
ORACLES["document_class"] = f"""
WITH {INFO}, c AS (SELECT path, count(*)::BIGINT AS total_pages, sum(image_count)::BIGINT AS total_images, avg(prose::INT) AS t, avg(pics::INT) AS i, avg((prose AND pics)::INT) AS m, avg(chars) AS a FROM info GROUP BY 1),
r AS (SELECT *, CASE WHEN m > 0.3 THEN 1 WHEN t > 0.7 AND i > 0.1 THEN 2 WHEN t > 0.8 AND i < 0.2 THEN 3 WHEN i > 0.6 AND t < 0.3 THEN 4 WHEN t < 0.5 AND i > 0.5 AND a < 100 THEN 5
  WHEN t < 0.1 AND i < 0.1 THEN 6 ELSE 7 END AS rule FROM c)
SELECT path, (['mixed_content', 'mixed_content', 'text_only', 'image_only', 'scanned_document', 'empty', 'mixed_content'])[rule] AS content_type,
  (['mixed_processing', 'text_primary_mixed', 'text_only', 'image_heavy', 'ocr_primary', 'skip', 'conservative_mixed'])[rule] AS strategy,
  round(CASE rule WHEN 1 THEN least(0.9, m + 0.3) WHEN 2 THEN t * 0.8 WHEN 3 THEN t WHEN 4 THEN i WHEN 5 THEN 0.7 WHEN 6 THEN 0.9 ELSE 0.5 END + 3e-9, 6) AS confidence,
  round(t + 3e-9, 6) AS text_coverage, round(i + 3e-9, 6) AS image_coverage, round(a + 3e-9, 6) AS avg_text_per_page, total_pages, total_images FROM r"""
ORACLES["document_stats"] = f"""
WITH {PAGES} SELECT path, count(*)::BIGINT AS page_count, sum(length(text))::BIGINT AS total_text_length, sum(image_count)::BIGINT AS total_images,
  round(avg(length(text)) + 3e-9, 6) AS avg_text_per_page, round(avg(image_count) + 3e-9, 6) AS avg_images_per_page FROM p GROUP BY 1"""
ORACLES["assemble_pages"] = f"""
WITH {PAGES} SELECT path, count(*)::BIGINT AS n_pages, md5({strip("string_agg(text, chr(10) || chr(10) ORDER BY page_num)")}) AS text_md5 FROM p GROUP BY 1"""
ORACLES["page_range"] = "SELECT conv_id, turn + 1 AS page_num, md5(text) AS text_md5 FROM conversations WHERE turn + 1 BETWEEN 2 AND 6 AND turn + 1 <> 4"
ORACLES["skip_pages"] = """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([doc_id % 9 + 1], range(doc_id % 5 + 2, doc_id % 5 + 7)))), ',') AS skip FROM documents"""
ORACLES["image_markers"] = f"""
WITH {PAGES}, o AS (SELECT doc_id, page_num, string_agg(chr(10) || chr(10) || 'seen text', '') FILTER (WHERE area > 600000) AS seen FROM areas GROUP BY 1, 2)
SELECT path, page_num::BIGINT AS page_num,
  md5(text || CASE WHEN image_count > 0 THEN chr(10) || '[Document contains ' || image_count || ' image(s) on this page]' || chr(10) ELSE '' END) AS marked_md5,
  md5(text || CASE WHEN image_count > 0 THEN chr(10) || '[This page contains ' || image_count || ' image(s) with contextual relationships]' || chr(10) ELSE '' END) AS contextual_md5,
  md5(text || coalesce(seen, '')) AS ocr_md5 FROM p LEFT JOIN o USING (doc_id, page_num)"""
IMAGES = f"""{PAGES}, img AS (SELECT *, (seed * 101 + image_index * 37) % 400000 AS size_bytes, (['RGB', 'RGBA', 'L'])[(seed + image_index) % 3 + 1] AS mode,
  CASE WHEN (seed + image_index) % 5 <> 0 THEN (seed * 53 + image_index * 19) % 20000 END AS n_colors,
  CASE WHEN (seed + image_index) % 3 <> 0 THEN (seed * 7 + image_index) % 100 / 100.0::DOUBLE END AS quality_score,
  (seed * 29 + image_index * 83) % 400 AS x, (seed * 17 + image_index * 211) % 700 AS y, (seed + image_index) % 6 + 1 AS kinds FROM areas)"""
_PIXEL = "CASE WHEN area > 0 THEN size_bytes / area::DOUBLE ELSE 0.0 END"
_SINGLE = "(kinds <= 3 OR area > 0 AND (seed + image_index) % 12 = 11)"
ORACLES["image_quality"] = f"""
WITH {IMAGES} SELECT path, page_num::BIGINT AS page_num, image_index::BIGINT AS image_index,
  round(least(1.0, area / 100000.0::DOUBLE) * 0.4 + least(1.0, ({_PIXEL}) / CASE mode WHEN 'RGB' THEN 3.0 WHEN 'RGBA' THEN 4.0 ELSE 1.0 END) * 0.3 + coalesce(least(1.0, n_colors / 1000.0::DOUBLE), 1.0) * 0.3, 6) AS quality,
  round((least(1.0, area / 100000.0::DOUBLE) + least(1.0, ({_PIXEL}) / 3.0)) / 2, 6) AS epub_quality,
  CASE WHEN area > 500000 THEN 'high' WHEN area > 100000 THEN 'medium' ELSE 'low' END AS resolution,
  CASE WHEN n_colors IS NULL THEN 'many (>16M)' WHEN n_colors > 10000 THEN 'many (~' || n_colors // 1000 || 'K)' ELSE n_colors::VARCHAR END AS colors,
  {_SINGLE} AS single_color, area < 1000 AS small_page, area < 10000 AS small_mixed, area < 1000 OR size_bytes < 1000 AS small_epub FROM img"""
ORACLES["image_filter"] = f"""
WITH {IMAGES} SELECT path, page_num::BIGINT AS page_num, image_index::BIGINT AS image_index, area::BIGINT AS area FROM img
WHERE area >= 10000 AND coalesce(quality_score, 1.0) >= 0.3 AND NOT ({_SINGLE})"""
ORACLES["image_position"] = f"""
WITH {IMAGES} SELECT path, page_num::BIGINT AS page_num, image_index::BIGINT AS image_index,
  CASE WHEN y + 45 < 800 / 3.0::DOUBLE THEN 'top' WHEN y + 45 > 1600 / 3.0::DOUBLE THEN 'bottom' ELSE 'middle' END || '_' ||
  CASE WHEN x + 75 < 200 THEN 'left' WHEN x + 75 > 400 THEN 'right' ELSE 'center' END AS position FROM img"""
ORACLES["page_image_quality"] = f"""
WITH {IMAGES} SELECT path, page_num::BIGINT AS page_num, count(*)::BIGINT AS total_images, h::BIGINT AS high, m::BIGINT AS medium, l::BIGINT AS low, round(a + 3e-9, 6) AS average_resolution,
  CASE WHEN h > m + l THEN 'high_quality' WHEN m > l THEN 'medium_quality' WHEN l > 0 THEN 'low_quality' ELSE 'none' END AS dominant_image_type, a > 1000000 AS has_vector_graphics
FROM (SELECT path, page_num, count(*) FILTER (WHERE area > 500000) AS h, count(*) FILTER (WHERE area > 100000 AND area <= 500000) AS m, count(*) FILTER (WHERE area <= 100000) AS l, avg(area) AS a
  FROM img GROUP BY 1, 2) JOIN img USING (path, page_num) GROUP BY ALL"""
BLOCKS = f"""{IMAGES}, b AS (SELECT path, page_num, i, l, (seed * 13 + i * 57) % 300 AS bx, i * 40 AS byy FROM (
  SELECT path, page_num, doc_id + page_num * 31 AS seed, unnest({lines('text')}) AS l, unnest(range(len({lines('text')}))) AS i FROM p))"""
_GAPS = "greatest(0, bx - (x + 150), x - (bx + 200)) AS dx, greatest(0, byy - (y + 90), y - (byy + 20)) AS dy"
ORACLES["nearby_text"] = f"""
WITH {BLOCKS} SELECT img.path, img.page_num::BIGINT AS page_num, image_index::BIGINT AS image_index, (count(l) FILTER (WHERE near))::BIGINT AS n_blocks,
  md5(coalesce(string_agg(trim(l), chr(10) ORDER BY i) FILTER (WHERE near), '')) AS near_md5
FROM (SELECT *, sqrt(dx * dx + dy * dy) <= 50 AND trim(l) <> '' AS near FROM (SELECT img.*, i, l, {_GAPS} FROM img JOIN b USING (path, page_num))) img GROUP BY 1, 2, 3"""
ORACLES["text_around_image"] = f"""
WITH {BLOCKS} SELECT path, page_num::BIGINT AS page_num, image_index::BIGINT AS image_index, md5(trim(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE byy + 20 <= y), ''))) AS above_md5,
  md5(trim(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE byy >= y + 90), ''))) AS below_md5 FROM img JOIN b USING (path, page_num) GROUP BY 1, 2, 3"""
ORACLES["table_text"] = """
SELECT o_orderkey, chr(10) || '[TABLE on page 3]' || chr(10) || 'key | status | ' || chr(10) || o_orderkey || ' | ' || o_orderstatus || ' | ' || trim(o_orderpriority) || chr(10) || '[/TABLE]' || chr(10) || chr(10) AS block FROM orders"""
ORACLES["form_text"] = """
SELECT c_custkey, chr(10) || '[FORM FIELDS]' || chr(10) || 'Field: name (Type: Text) = ' || c_name || chr(10) || 'Field: segment (Type: Choice)' ||
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' = ' || c_mktsegment END || chr(10) || '[/FORM FIELDS]' || chr(10) || chr(10) AS form FROM customer"""

# --- requests, routing, catalogue ---------------------------------------------------------

ORACLES["completion_requests"] = """
SELECT conv_id, turn, '{"model":"gpt-4o-mini","messages":[{"role":"user","content":' || to_json(text) || '}],"max_tokens":2000,"temperature":0.7}' AS messages_body,
  '{"contents":[{"parts":[{"text":' || to_json(text) || '}]}],"generationConfig":{"maxOutputTokens":2048,"temperature":0.7}}' AS contents_body FROM conversations"""
ORACLES["response_texts"] = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN '' ELSE text END AS answer FROM conversations"
ORACLES["image_urls"] = """
SELECT page_id, md5('data:image/' || CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || base64(encode(html))) AS url_md5 FROM pages"""
ORACLES["route_task"] = f"""
SELECT doc_id, {one_of('doc_id', ['conversations', 'qa_pairs', 'image_descriptions', 'translation'])} AS task,
  {one_of('doc_id', ['openai', 'openai', 'openai', 'deepseek'])} AS provider, {one_of('doc_id', ['gpt-4o-mini', 'gpt-4o-mini', 'gpt-4o', 'deepseek-r1'])} AS model FROM documents"""


def _sql_value(v) -> str:
    return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)


_ROWS = ", ".join("(" + ", ".join(map(_sql_value, row)) + ")" for row in fixed.MODEL_CATALOG)
CATALOG = f"cat(provider, model, type, max_tokens, context_window, pin, pout, pimg, priority, vision, seq) AS (VALUES {_ROWS})"
REQUESTS = f"""req AS (SELECT doc_id, {one_of('doc_id', ['openai', 'mistral', 'nobody', 'google', 'local'])} AS ap,
  {one_of('doc_id // 5', ['gpt-4o-mini', 'mistral-small-latest', 'unknown-model', 'google/gemini-pro'])} AS am FROM documents)"""


def choice(where: str) -> str:
    return f"""
WITH {CATALOG}, {REQUESTS}, u AS (SELECT * FROM cat WHERE {where}), firsts AS (SELECT provider, arg_min(model, seq) AS dm FROM u GROUP BY 1)
SELECT doc_id, ap AS asked_provider, am AS asked_model,
  CASE WHEN ap IN (SELECT provider FROM u) THEN ap WHEN am IN (SELECT model FROM u) THEN (SELECT min(provider) FROM u WHERE model = am) ELSE (SELECT min(provider) FROM u) END AS provider,
  CASE WHEN ap IN (SELECT provider FROM u) THEN CASE WHEN EXISTS (SELECT 1 FROM u WHERE provider = ap AND model = am) THEN am ELSE (SELECT dm FROM firsts WHERE provider = ap) END
    WHEN am IN (SELECT model FROM u) THEN am ELSE (SELECT arg_min(dm, provider) FROM firsts) END AS model FROM req"""


ORACLES["provider_choice"] = choice("true")
ORACLES["vision_choice"] = choice("vision")
ORACLES["cost_by_model"] = f"""
WITH {CATALOG}, {REQUESTS}, t AS (SELECT doc_id, {words('text')} AS tokens FROM documents)
SELECT ap AS provider, am AS model, count(*)::BIGINT AS n_calls, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 1000.0::DOUBLE * coalesce(any_value(pin + pout), 0)::DOUBLE, 6) AS cost
FROM req JOIN t USING (doc_id) LEFT JOIN cat ON provider = ap AND model = am GROUP BY 1, 2"""
ORACLES["provider_priority"] = """
SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey::BIGINT AS c_custkey, floor(c_acctbal)::BIGINT AS priority FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) DESC, c_custkey) = 1"""

# --- parsed settings and names ------------------------------------------------------------

ORACLES["parse_sizes"] = """
SELECT doc_id, (CASE doc_id % 5 WHEN 3 THEN n_chars ELSE trunc(printf('%.1f', n_chars / 10.0::DOUBLE)::DOUBLE * CASE doc_id % 5 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1024 END) END)::BIGINT AS size_bytes FROM documents"""
ORACLES["durations"] = """
SELECT doc_id, CASE WHEN s < 60 THEN printf('%.1fs', floor(s * 10 + 0.5) / 10) WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ' || floor(s % 60 + 0.5)::BIGINT || 's'
  ELSE floor(s / 3600)::BIGINT || 'h ' || floor((s % 3600) / 60)::BIGINT || 'm' END AS exact,
  CASE WHEN w < 60 THEN w || 's' WHEN w < 3600 THEN w // 60 || 'm ' || w % 60 || 's' ELSE w // 3600 || 'h ' || (w % 3600) // 60 || 'm' END AS rounded
FROM (SELECT doc_id, n_chars / 4.0::DOUBLE AS s, floor(n_chars / 4.0::DOUBLE)::BIGINT AS w FROM documents)"""
ORACLES["output_paths"] = f"""
WITH {FILES}, o AS (SELECT doc_id, stem, strftime(mtime, '%d%m%y%H%M') AS b, {one_of('doc_id', fixed.GENERATORS)} AS gen FROM f)
SELECT doc_id, 'data/' || b || '/' || stem || '/' || stem || '_' || gen || '.jsonl' AS per_file, 'data/' || b || '/final_' || gen || '.csv' AS final, stem || '_' || gen || '.txt' AS flat FROM o"""

# --- streams ------------------------------------------------------------------------------

ORACLES["stream_corpus"] = f"""
WITH RECURSIVE cleaned AS (SELECT doc_id, {clean("CASE WHEN length(" + strip("text") + ") < 100 THEN '' ELSE text END")} AS text FROM documents),
good AS MATERIALIZED (SELECT doc_id, text FROM cleaned WHERE {status('text')} = 'ok'), {chunks("good")}
SELECT doc_id, chunk_id::BIGINT AS chunk_id, md5(chunk) AS chunk_md5 FROM chunks"""
ORACLES["stream_dedupe"] = "SELECT DISTINCT md5(text) AS content_hash, n_chars FROM documents"
ORACLES["read_epub"] = f"""
WITH c AS (SELECT page_id // 7 AS book, row_number() OVER (PARTITION BY page_id // 7 ORDER BY page_id) AS p, {html('html')} AS t FROM pages)
SELECT book, count(*)::BIGINT AS n_pages,
  md5({strip("string_agg('=== Chapter ' || p || ' ===' || chr(10) || chr(10) || t, repeat(chr(10), 4) ORDER BY p)")}) AS text_md5
FROM c WHERE p BETWEEN 2 AND 6 AND p <> 4 AND length(t) >= 100 GROUP BY 1"""
ORACLES["dedupe_arrivals"] = """
SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
ORACLES["write_and_read"] = "SELECT conv_id, turn, role, md5(text) AS text_md5, 2 * count(*)::BIGINT AS n_written FROM conversations GROUP BY ALL"
ORACLES["stream_metrics"] = """
SELECT source AS processor, count(*)::BIGINT AS files, (count(*) FILTER (WHERE doc_id % 17 NOT IN (3, 4, 5)))::BIGINT AS successful,
  coalesce(sum(n_chars) FILTER (WHERE doc_id % 17 NOT IN (3, 4, 5)), 0)::BIGINT AS text_chars, coalesce(sum(doc_id % 4) FILTER (WHERE doc_id % 17 NOT IN (3, 4, 5)), 0)::BIGINT AS images
FROM documents GROUP BY 1"""
ORACLES["stream_files_changes"] = f"""
WITH {FILES}, later AS (
  SELECT path, mtime + CASE WHEN toxic = 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS mtime FROM f LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) <> 0
  UNION ALL SELECT 'web/' || page_id || '.html', TIMESTAMP '2024-01-01' + to_minutes(page_id) FROM pages),
listed AS (SELECT path, mtime, 0 AS n FROM f UNION ALL SELECT path, mtime, 1 FROM later
  UNION ALL SELECT path, mtime + CASE WHEN doc_id % 7 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, 2 FROM f WHERE doc_id % 11 <> 0),
pairs AS (SELECT coalesce(a.path, b.path) AS path, a.mtime AS was, b.mtime AS now, coalesce(b.n, a.n + 1) AS n
  FROM listed a FULL JOIN listed b ON a.path = b.path AND b.n = a.n + 1)
SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END AS change, n::BIGINT AS listing
FROM pairs WHERE n < 3 AND was IS DISTINCT FROM now"""
