"""SQL pieces for DuckDB that the queries' oracles share: the corpus' tables as common table expressions."""

from __future__ import annotations

from .functions.text import CLOSERS, HEADING, JOINERS, TERMINALS, WORD


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GUARD = ""  # stands for a point between digits, which ends no sentence
STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TOKEN = rf"{WORD}+(?:[{JOINERS}]{WORD}+)*|[^\s\p{{Z}}]"
PIECE = rf"[^{TERMINALS}]*[{TERMINALS}][{CLOSERS}]*|[^{TERMINALS}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(STRIP)}, '', 'g')"


def sentences_of(x: str) -> str:
    point = lit(r"(\p{Nd})\.(\p{Nd})")
    guarded = f"regexp_replace(regexp_replace({x}, {point}, '\\1{GUARD}\\2', 'g'), {point}, '\\1{GUARD}\\2', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({guarded}, {lit(PIECE)}), lambda p: {strip(f'replace(p, {lit(GUARD)}, {lit(".")})')}), lambda p: p <> '')"


def normal(x: str) -> str:
    clean = rf"regexp_replace(regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F\x{{80}}-\x{{9F}}]', '', 'g')"
    return strip(rf"regexp_replace({clean}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\p{{P}}\p{{S}}]', '', 'g'), '\s+', ' ', 'g'))"


def heading(x: str) -> str:
    capitals = f"(upper({x}) = {x} AND lower({x}) <> {x} AND length({x}) BETWEEN 3 AND 60 AND NOT ends_with({x}, '.'))"
    return f"({x} <> '' AND length({x}) <= 80 AND (regexp_matches({x}, {lit(HEADING.replace('(?iu)', '(?i)'))}) OR {capitals}))"


def sections_of(source: str) -> str:
    """Common table expressions that end in `sect`: sections of (doc_id, text) rows; a text without any body is one section as it is."""
    return f"""sect_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {source}),
sect_mark AS (SELECT *, {heading('s')} AS hd FROM (SELECT *, {strip('line')} AS s FROM sect_line)),
sect_island AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM sect_mark),
sect_body AS (SELECT doc_id, island, max(CASE WHEN hd THEN s END) AS title, {strip("coalesce(string_agg(CASE WHEN NOT hd THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM sect_island GROUP BY doc_id, island),
sect_named AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS sect_pos, title, body FROM sect_body WHERE body <> ''),
sect AS MATERIALIZED (SELECT * FROM sect_named UNION ALL SELECT doc_id, 0, NULL, text FROM {source} WHERE doc_id NOT IN (SELECT doc_id FROM sect_named))"""


def paragraphs_of(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\n[ \t]*\n+'), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda y: {strip('y')}), lambda y: y <> ''), ' ')), lambda p: p <> '')"


def tokens_of(x: str) -> str:
    """Words and marks; texts without spaces between words give none."""
    spaced = rf"regexp_matches({x}, '[^\s\p{{Z}}][\s\p{{Z}}]+[^\s\p{{Z}}]')"
    return f"CASE WHEN {spaced} OR (regexp_matches({x}, {lit('^' + WORD)}) AND NOT regexp_matches({x}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Khmer}}]')) THEN regexp_extract_all({x}, {lit(TOKEN)}) ELSE [] END"


PARA = f"""normal_doc AS (SELECT doc_id, lang, source, {normal('text')} AS text FROM documents), {sections_of('normal_doc')},
para AS (SELECT p.*, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY sect_pos, sect_para) - 1 AS para_pos FROM (SELECT doc_id, sect_pos, title, unnest(p) AS para, generate_subscripts(p, 1) - 1 AS sect_para FROM (SELECT *, {paragraphs_of('body')} AS p FROM sect)) p JOIN normal_doc USING (doc_id))"""
SENT = f"""{PARA}, sent AS (SELECT doc_id, lang, source, sect_pos, sect_para, para_pos, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_pos FROM (SELECT *, {sentences_of('para')} AS s FROM para))"""
TOK = f"""{SENT}, raw AS (SELECT doc_id, lang, source, sect_pos, sect_para, para_pos, sent_pos, unnest(w) AS form, generate_subscripts(w, 1) - 1 AS word_pos FROM (SELECT *, {tokens_of('sentence')} AS w FROM sent)),
keyed AS (SELECT *, lower(form) AS form_key, {norm('form')} AS norm, regexp_full_match(form, '[^\\p{{L}}\\p{{N}}]+') AS is_punct FROM raw),
tok AS MATERIALIZED (SELECT *, row_number() OVER p - 1 AS g, CASE WHEN NOT is_punct THEN sum(CASE WHEN is_punct THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para_pos ORDER BY sent_pos, word_pos ROWS UNBOUNDED PRECEDING) - 1 END AS c
  FROM keyed WINDOW p AS (PARTITION BY doc_id, para_pos ORDER BY sent_pos, word_pos))"""
#: Tokens with annotation that follows from their forms and places, a lexicon of the forms that come twice, and lemmas.
ANN = f"""{TOK}, ann AS MATERIALIZED (SELECT *, format('w_{{:03d}}', word_pos + 1) AS local_id,
  CASE WHEN g % 3 = 0 THEN 'd_' || form END AS dict_id, CASE WHEN g % 5 = 0 THEN 'l_' || left(form_key, 3) END AS lemma_id,
  CASE WHEN g % 2 = 0 THEN form_key END AS gloss, CASE length(form) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' END AS part_of_speech,
  CASE WHEN length(form) >= 8 AND NOT is_punct AND NOT contains(form, '-') THEN left(form, 4) || '-' || substr(form, 5) END AS morphological_parse FROM tok),
entry AS MATERIALIZED (SELECT 'd_' || form AS id, form, CASE WHEN length(form) % 3 = 0 THEN 'bound.morpheme' ELSE 'word' END AS type, CASE WHEN length(form) % 2 = 0 THEN lower(form) END AS gloss, CASE WHEN length(form) % 4 = 0 THEN 'NOUN' END AS part_of_speech,
  CASE WHEN length(form) % 2 = 1 THEN 'l_' || left(lower(form), 3) END AS lemma_id, min(doc_id * 1000000000 + para_pos * 100000 + g) AS file_pos FROM tok WHERE NOT is_punct GROUP BY form HAVING count(*) >= 2),
lemma AS MATERIALIZED (SELECT 'l_' || left(form_key, 3) AS id, left(form_key, 3) AS form FROM tok WHERE NOT is_punct GROUP BY left(form_key, 3) HAVING count(*) >= 20)"""


def runs(nodes: str) -> str:
    """Runs of (doc_id, para_pos, hit, g) rows."""
    return f"runs AS (SELECT doc_id, para_pos, hit, min(g) AS g_start, max(g) AS g_end FROM (SELECT *, g - row_number() OVER (PARTITION BY doc_id, para_pos, hit ORDER BY g) AS island FROM (SELECT DISTINCT * FROM ({nodes}))) GROUP BY doc_id, para_pos, hit, island)"


def kwic(nodes: str, context: int) -> str:
    """Lines of nodes, over TOK."""
    first = f"greatest(g_start - {context}, 0) + 1"
    return f"""{runs(nodes)}, stream AS (SELECT doc_id, para_pos, list(form ORDER BY g) AS forms, list(norm ORDER BY g) AS norms, list(sent_pos ORDER BY g) AS sents FROM tok GROUP BY doc_id, para_pos),
line AS (SELECT r.doc_id, r.para_pos, hit, g_start, g_end, array_to_string(forms[{first}:g_start], ' ') AS "left", array_to_string(forms[g_start + 1:g_end + 1], ' ') AS node, array_to_string(forms[g_end + 2:g_end + 1 + {context}], ' ') AS "right",
  len(list_distinct(sents[{first}:g_end + 1 + {context}])) > 1 AS crosses, norms FROM runs r JOIN stream USING (doc_id, para_pos))"""
