"""DuckDB SQL for the registered queries, written from the rules, token by token.

The named parts are common table expressions; a query gets the parts it names,
with everything they name in turn.
"""

from __future__ import annotations

import re

from codemix.operators.prompts import BATCH_PROMPTS, STRATEGY_PROMPTS

# Tones, personas and topics, written out anew so that the SQL does not take them from the code it checks.
TONES = ["casual", "formal", "emotional", "humorous"]
PERSONAS = [
    ("Mexican-American student", "Anglo roommate"),
    ("Dominican grandmother", "American granddaughter"),
    ("Colombian engineer", "Indian colleague"),
    ("Puerto Rican teacher", "Mixed-background parent"),
]
TOPICS = [
    "weekend plans", "family dinner", "work meeting", "shopping trip",
    "movie night", "cooking together", "travel planning", "school project",
    "sports event", "birthday party", "restaurant visit", "health concerns",
]
BATCH_TOPICS = [
    "weekend plans", "cooking dinner", "office meeting", "gym workout",
    "movie review", "book club", "grocery shopping", "car repair",
    "vacation planning", "birthday party", "home renovation", "pet care",
    "weather chat", "sports game", "restaurant visit", "doctor appointment",
    "school project", "job interview", "morning routine", "coffee break",
    "hiking trip", "music concert", "art museum", "beach day",
    "game night", "study session", "cleaning day", "garden work",
    "family dinner", "online shopping", "tech support", "road trip",
    "gardening tips", "cooking show", "fitness goals", "meditation session",
]

# Fixed values, written out here as well so that a wrong one in the operators shows.
SPANISH_LETTERS = "ñáéíóúü"
SPANISH_WORDS = [
    "el", "la", "los", "las", "un", "una", "de", "que", "y", "en", "por", "para", "con", "sin", "pero",
    "cuando", "donde", "como", "está", "están", "estoy", "mi", "tu", "su", "qué", "así", "muy",
]
DETERMINERS = ["the", "a", "an", "el", "la", "los", "las"]
VERBS = ["is", "are", "was", "were", "es", "está", "son"]
CLEAN_PAIRS = [
    ("<ES>", ""), ("</ES>", ""), ("bolsa<.", "bolsa."), ("huevos<", "huevos"), ("Vamos<.", "Vamos."),
    ("<.", "."), ("< ", " "), (" >", " "), ("<", ""), (">", ""), ("ES¿", "¿"), ("ES¡", "¡"),
]
FINAL_TEXT_PAIRS = [
    ("<ES>", ""), ("</ES>", ""), ("bolsa<", "bolsa"), ("huevos<", "huevos"), ("Vamos<", "Vamos"),
    ("<.", "."), ("< ", " "),
]
CHECKED_STRATEGIES = ["monolingual_spanish", "monolingual_english", "minimal_switch"]
STRATEGIES = [
    "controlled_switch", "role_based", "topic_variation_casual", "back_translation",
    "free_generation", "monolingual_english", "monolingual_spanish", "minimal_switch",
]

W = r"\p{L}\p{N}_"
S = r"\t-\r\x1c-\x20\x85\p{Z}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(text(v) for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{S}]+'), lambda w: w <> '')"


def no_numbers(x: str) -> str:
    return rf"regexp_replace({x}, '\[\p{{Nd}}+\]', '', 'g')"


def replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {text(old)}, {text(new)})"
    return x


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{S}]+', ' ', 'g'))"


def cleaned_text(x: str) -> str:
    return collapsed(rf"regexp_replace({no_numbers(x)}, '<ES>([^\n]*?)</ES>', '\1', 'g')")


def at(values, index: str) -> str:
    return f"list_extract([{listed(values)}], ({index})::BIGINT + 1)"


FORCE = (
    "CASE strategy WHEN 'monolingual_spanish' THEN 'es' WHEN 'monolingual_english' THEN 'en' END"
)
PUNCT = r"['.', ',', '!', '?', ';', ':', '¿', '¡']"


def tokens(name: str, source: str) -> dict[str, str]:
    """Parts that tag `source(a, b, t, force)` into `<name>(a, b, pos, token, lang)`."""
    marked = rf"regexp_replace(t0, '<ES>([^\n]*?)</ES>', chr(1) || '\1' || chr(2), 'g')"
    unpadded = (
        rf"regexp_replace({marked}, '\x01([{S}][^\x02]*|[^\x02]*[{S}])\x02', '<ES>\1</ES>', 'g')"
    )
    return {
        f"{name}_pieces": f"""
            SELECT a, b, force, unnest(l) AS piece, generate_subscripts(l, 1) AS p FROM (
              SELECT a, b, force, CASE WHEN force IS NOT NULL THEN [t0]
                ELSE string_split_regex({unpadded}, '[\\x01\\x02]') END AS l
              FROM (SELECT a, b, force, {no_numbers('t')} AS t0 FROM {source}))""",
        f"{name}_words": f"""
            SELECT a, b, force, p, unnest(l) AS word, generate_subscripts(l, 1) AS w FROM (
              SELECT a, b, force, p, {words('piece')} AS l FROM {name}_pieces)""",
        f"{name}_parts": f"""
            SELECT *, force IS NULL AND p % 2 = 0 AS inside,
              regexp_extract(word, '[{W}](?:.*[{W}])?', 0) AS core,
              regexp_extract(word, '^([^{W}]*)', 1) AS pre,
              regexp_extract(word, '([^{W}]*)$', 1) AS post
            FROM {name}_words""",
        f"{name}_rows": f"""
            SELECT a, b, force, p, w, inside, unnest(l) AS token, generate_subscripts(l, 1) AS k
            FROM (SELECT *, CASE WHEN inside THEN [word] ELSE list_concat(
                list_filter(string_split(pre, ''), lambda c: list_contains({PUNCT}, c)),
                CASE WHEN core <> '' THEN [core] ELSE [] END,
                CASE WHEN core <> '' THEN
                  list_filter(string_split(post, ''), lambda c: list_contains({PUNCT}, c))
                ELSE [] END) END AS l FROM {name}_parts)""",
        name: f"""
            SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY p, w, k) - 1 AS pos, token,
              CASE WHEN inside THEN 'es'
                WHEN list_contains({PUNCT}, token) THEN 'punct'
                WHEN force IS NOT NULL THEN force
                WHEN regexp_matches(token, '[{SPANISH_LETTERS}]')
                  OR lower(token) IN ({listed(SPANISH_WORDS)}) THEN 'es'
                ELSE 'en' END AS lang
            FROM {name}_rows""",
    }


SHOWN = "coalesce(string_agg(token || '/' || lang, ' ' ORDER BY pos), '')"
COUNTS = """count(*) FILTER (lang = 'es') AS n_es, count(*) FILTER (lang = 'en') AS n_en,
    count(*) FILTER (lang <> 'punct') AS n_words"""
POS = (
    f"CASE WHEN lang = 'punct' THEN token WHEN lower(token) IN ({listed(DETERMINERS)}) THEN 'DT' "
    f"WHEN lower(token) IN ({listed(VERBS)}) THEN 'VB' ELSE 'NN' END"
)
FLAG = "CASE WHEN n_es > 0 AND n_en > 0 THEN 'yes' ELSE 'no' END"
SHARE = "CASE WHEN n_es + n_en > 0 THEN n_es / (n_es + n_en) * 100 ELSE 0.0 END"
SHARE_OUT = "round(spanish_percentage, 6) AS spanish_percentage"


def rate(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN ({part}) / ({whole}) * 100 ELSE 0.0 END, 6)"


PARTS: dict[str, str] = {
    # ---- conversations, lines, utterances
    "convs": f"""
        SELECT doc_id AS conv_pos, {at(STRATEGIES, 'doc_id % 8')} AS strategy,
          {at(TOPICS, 'doc_id % 12')} AS topic FROM documents""",
    "raw_lines": """
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "plain": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, ws
        FROM (SELECT doc_id, k, {words('line')} AS ws FROM raw_lines) WHERE len(ws) > 0""",
    "lines": """
        SELECT doc_id AS conv_pos, n AS utt_idx, array_to_string(ws, ' ') AS plain_text,
          CASE WHEN len(ws) >= 5 AND n % 3 > 0 THEN
            array_to_string(ws[1:2], ' ') || CASE n % 3 WHEN 1 THEN ' <ES>' ELSE ' <ES> ' END
            || ws[3] || ' ' || ws[4] || CASE n % 3 WHEN 1 THEN '</ES> ' ELSE ' </ES> ' END
            || array_to_string(ws[5:], ' ')
          ELSE array_to_string(ws, ' ') END AS original_text, strategy, topic
        FROM plain JOIN convs ON doc_id = conv_pos""",
    "free_text": """
        SELECT conv_pos AS a, utt_idx AS b, original_text AS t, NULL::VARCHAR AS force FROM lines""",
    "strategy_text": f"""
        SELECT conv_pos AS a, utt_idx AS b, original_text AS t, {FORCE} AS force FROM lines""",
    "turn_text": """
        SELECT conv_id AS a, turn AS b, text AS t, NULL::VARCHAR AS force FROM conversations""",
    **tokens("free_tok", "free_text"),
    **tokens("strategy_tok", "strategy_text"),
    **tokens("turn_tok", "turn_text"),
    "tok": "SELECT a AS conv_pos, b AS utt_idx, pos, token, lang FROM free_tok",
    "tok_agg": f"""
        SELECT conv_pos, utt_idx, {COUNTS}, count(*) AS n_all, {SHOWN} AS tagged,
          string_agg(token, ' ' ORDER BY pos) AS tokens_list,
          string_agg({POS}, ' ' ORDER BY pos) AS pos_tags,
          string_agg(token, '|' ORDER BY pos) FILTER (lang <> 'punct') AS piped,
          string_agg(upper(lang), '|' ORDER BY pos) FILTER (lang <> 'punct') AS piped_tags
        FROM tok GROUP BY ALL""",
    "utt": f"""
        SELECT l.conv_pos, l.utt_idx, strategy, topic, original_text,
          CASE l.utt_idx % 2 WHEN 0 THEN 'Speaker A' ELSE 'Speaker B' END AS speaker,
          {cleaned_text('original_text')}
            || CASE l.utt_idx % 7 WHEN 0 THEN '<.' WHEN 3 THEN ' >' ELSE '' END AS text,
          coalesce(n_es, 0) AS n_es, coalesce(n_en, 0) AS n_en, coalesce(n_words, 0) AS tokens,
          coalesce(n_all, 0) AS all_tokens, coalesce(tagged, '') AS tagged,
          coalesce(tokens_list, '') AS tokens_list, coalesce(pos_tags, '') AS pos_tags,
          coalesce(piped, '') AS piped, coalesce(piped_tags, '') AS piped_tags,
          CASE WHEN coalesce(n_es, 0) > 0 AND coalesce(n_en, 0) > 0 THEN 'yes' ELSE 'no' END
            AS has_code_switch,
          CASE WHEN n_es + n_en > 0 THEN n_es / (n_es + n_en) * 100 ELSE 0.0::DOUBLE END
            AS spanish_percentage
        FROM lines l LEFT JOIN tok_agg t ON l.conv_pos = t.conv_pos AND l.utt_idx = t.utt_idx""",
    # ---- answers
    "said": """
        SELECT conv_pos AS response_id, strategy, topic, utt_idx AS n,
          CASE conv_pos % 3
            WHEN 0 THEN CASE utt_idx % 2 WHEN 0 THEN 'Speaker A: ' ELSE 'Speaker B: ' END
            WHEN 1 THEN CASE utt_idx % 2 WHEN 0 THEN '**Speaker A:** ' ELSE '**Speaker B:** ' END
            ELSE list_extract(['Ana: ', 'Ben: ', 'Cara: '], utt_idx % 3 + 1) END
          || original_text
          || CASE conv_pos % 5 WHEN 1 THEN ' [3]' WHEN 2 THEN ' {7} **ok**' ELSE '' END AS line
        FROM lines""",
    "answers": """
        SELECT response_id, strategy, topic,
          CASE response_id % 5 WHEN 0 THEN 'Note: generated [12]' || chr(10)
            WHEN 3 THEN 'Dora: ...' || chr(10) || chr(10) || 'Hi' || chr(10) ELSE '' END
          || string_agg(line, chr(10) ORDER BY n) AS raw_text
        FROM said GROUP BY response_id, strategy, topic""",
    "clean_answers": r"""
        SELECT response_id, strategy, topic, regexp_replace(regexp_replace(regexp_replace(
          replace(replace(raw_text, '**Speaker A:**', 'Speaker A:'), '**Speaker B:**', 'Speaker B:'),
          '\*\*([^\n]*?)\*\*', '\1', 'g'), '\[\p{Nd}+\]', '', 'g'), '\{\p{Nd}+\}', '', 'g') AS clean
        FROM answers""",
    "answer_lines": f"""
        SELECT response_id, strategy, topic, k - 1 AS line_no, {strip('raw')} AS line FROM (
          SELECT *, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (
            SELECT response_id, strategy, topic, string_split(clean, chr(10)) AS l
            FROM clean_answers))""",
    "spoken_lines": rf"""
        SELECT response_id, strategy, topic, line_no,
          {strip("regexp_extract(line, '^([^:]+):', 1)")} AS name,
          {strip(r"regexp_extract(line, '^[^:]+:([^\n]*)$', 1)")} AS content
        FROM answer_lines
        WHERE length(line) >= 5
          AND NOT regexp_matches(lower(line), '^(example|format|instructions|note)')
          AND regexp_matches(line, '^[^:]+:[{S}]*[^\n]+$')""",
    "dialogue": """
        SELECT * FROM spoken_lines
        WHERE length(content) >= 3 AND content NOT IN ('...', '[text]', '[response]')""",
    "dialogue_text": f"""
        SELECT response_id AS a, line_no AS b, content AS t, {FORCE} AS force FROM dialogue""",
    **tokens("dia_tok", "dialogue_text"),
    "dia_agg": f"""
        SELECT a, b, {COUNTS}, count(*) AS n_all, {SHOWN} AS tagged,
          string_agg({POS}, ' ' ORDER BY pos) AS pos_tags,
          string_agg(token, '|' ORDER BY pos) FILTER (lang <> 'punct') AS piped,
          string_agg(upper(lang), '|' ORDER BY pos) FILTER (lang <> 'punct') AS piped_tags
        FROM dia_tok GROUP BY ALL""",
    "judged": """
        SELECT d.*, t.* EXCLUDE (a, b), coalesce(n_all, 0) > 2 AS accepted
        FROM dialogue d LEFT JOIN dia_agg t ON response_id = a AND line_no = b""",
    "numbered": """
        SELECT *, count(*) FILTER (accepted) OVER (PARTITION BY response_id) AS n_utterances,
          coalesce(sum(accepted::INT) OVER (PARTITION BY response_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS utt_idx
        FROM judged""",
    "names": """
        SELECT response_id, name, min(line_no) AS first_line, count(*) AS n_lines,
          arg_min(utt_idx, line_no) AS accepted_before FROM numbered GROUP BY ALL""",
    "speakers": """
        SELECT response_id, name, n_lines, CASE nr WHEN 1 THEN 'Speaker A' WHEN 2 THEN 'Speaker B'
          ELSE CASE accepted_before % 2 WHEN 0 THEN 'Speaker A' ELSE 'Speaker B' END END AS speaker
        FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY first_line) AS nr
              FROM names)""",
    "parsed_all": f"""
        SELECT response_id, utt_idx, speaker, {cleaned_text('content')} AS text,
          content AS original_text, n_words AS tokens, tagged, pos_tags,
          {FLAG} AS has_code_switch, {SHARE} AS share, strategy, topic,
          coalesce(piped, '') AS piped, coalesce(piped_tags, '') AS piped_tags
        FROM numbered JOIN speakers USING (response_id, name)
        WHERE accepted AND n_utterances >= 8""",
    "parsed": """
        SELECT * EXCLUDE (share, piped, piped_tags), round(share, 6) AS spanish_percentage
        FROM parsed_all""",
    # ---- batch answers
    "batch_rows": """
        SELECT doc_id AS batch_id, CASE lang WHEN 'es' THEN 'spanish' ELSE 'english' END AS language,
          n // 8 AS seg, max(n // 8) OVER (PARTITION BY doc_id) + 1 AS n_segments, n,
          CASE n % 2 WHEN 0 THEN 'Speaker A' ELSE 'Speaker B' END AS speaker, ws
        FROM plain JOIN documents USING (doc_id)""",
    # The views write the answers and the operator reads them back; here the rows
    # are judged directly, since no line of the table holds a mark or a label.
    "batch_said": """
        SELECT batch_id, language, seg + 1 AS segment, speaker, ws,
          array_to_string(ws, ' ') AS text,
          row_number() OVER (PARTITION BY batch_id, seg ORDER BY n) - 1 AS utt_idx,
          count(*) OVER (PARTITION BY batch_id, seg) AS n_said
        FROM batch_rows
        WHERE seg < n_segments - CASE batch_id % 4 WHEN 0 THEN 1 ELSE 0 END
          AND length(array_to_string(ws, ' ')) > 2""",
    "batch_utt": f"""
        SELECT batch_id, segment, utt_idx, speaker, text, len(ws) AS tokens,
          array_to_string(list_transform(ws,
            lambda w: w || CASE language WHEN 'spanish' THEN '/es' ELSE '/en' END), ' ') AS tagged,
          'no' AS has_code_switch,
          CASE language WHEN 'spanish' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS spanish_percentage,
          'monolingual_' || language AS strategy,
          {at(BATCH_TOPICS, '(batch_id + segment - 1) % 36')} AS topic
        FROM batch_said WHERE n_said >= 6""",
    "batch_convs": """
        SELECT batch_id, segment, strategy, topic,
          (SELECT max(conv_pos) + 1 FROM convs)
            + row_number() OVER (ORDER BY batch_id, segment) - 1 AS conversation_id
        FROM (SELECT DISTINCT batch_id, segment, strategy, topic FROM batch_utt)""",
    # ---- repairs
    "fixed_tok": f"""
        SELECT conv_pos, utt_idx, pos, token, strategy,
          CASE WHEN lang <> 'punct' THEN coalesce({FORCE}, lang) ELSE lang END AS lang
        FROM tok JOIN convs USING (conv_pos)""",
    "fixed": f"""
        SELECT u.* EXCLUDE (tagged, has_code_switch, spanish_percentage), coalesce(f.tagged, '') AS tagged,
          CASE WHEN {FORCE} IS NOT NULL THEN 'no' ELSE has_code_switch END AS has_code_switch,
          CASE {FORCE} WHEN 'es' THEN 100.0 WHEN 'en' THEN 0.0 ELSE spanish_percentage END
            AS spanish_percentage
        FROM utt u LEFT JOIN (SELECT conv_pos, utt_idx, {SHOWN} AS tagged FROM fixed_tok
          GROUP BY ALL) f USING (conv_pos, utt_idx)""",
    "bare_tok": """
        SELECT conv_pos, utt_idx, pos, trim(regexp_replace(token, '^ES', ''), '<>') AS token, lang
        FROM tok""",
    "bare_fixed_tok": """
        SELECT conv_pos, utt_idx, pos, trim(regexp_replace(token, '^ES', ''), '<>') AS token, lang
        FROM fixed_tok""",
    "cleaned": f"""
        SELECT u.conv_pos, u.utt_idx, original_text, text, coalesce(t.tagged, '') AS tagged,
          coalesce(t.tokens_list, '') AS tokens_list, coalesce(t.n_words, 0) AS tokens,
          CASE WHEN t.n_es + t.n_en > 0 THEN
            CASE WHEN t.n_es > 0 AND t.n_en > 0 THEN 'yes' ELSE 'no' END
            ELSE u.has_code_switch END AS has_code_switch,
          CASE WHEN t.n_es + t.n_en > 0 THEN t.n_es / (t.n_es + t.n_en) * 100
            ELSE u.spanish_percentage END AS spanish_percentage
        FROM utt u LEFT JOIN (SELECT conv_pos, utt_idx, {COUNTS}, {SHOWN} AS tagged,
            string_agg(token, ' ' ORDER BY pos) AS tokens_list
          FROM bare_tok WHERE token <> '' GROUP BY ALL) t USING (conv_pos, utt_idx)""",
    # Strategy repair and cleaning, the input of the retagging.
    "ready_tok": "SELECT * FROM bare_fixed_tok WHERE token <> ''",
    "ready": f"""
        SELECT u.conv_pos, u.utt_idx, original_text, coalesce(t.n_es, 0) AS n_es,
          coalesce(t.n_en, 0) AS n_en,
          CASE WHEN t.n_es + t.n_en > 0 THEN
            CASE WHEN t.n_es > 0 AND t.n_en > 0 THEN 'yes' ELSE 'no' END
            ELSE u.has_code_switch END AS has_code_switch,
          CASE WHEN t.n_es + t.n_en > 0 THEN t.n_es / (t.n_es + t.n_en) * 100
            ELSE u.spanish_percentage END AS spanish_percentage
        FROM fixed u LEFT JOIN (SELECT conv_pos, utt_idx, {COUNTS} FROM ready_tok GROUP BY ALL) t
          USING (conv_pos, utt_idx)""",
    "segs": r"""
        SELECT conv_pos, utt_idx,
          regexp_extract_all(original_text, '<ES>([^\n]*?)</ES>', 1) AS inner_texts FROM lines""",
    "word_sets": f"""
        SELECT conv_pos, utt_idx, list_sort(list_distinct({words("array_to_string(inner_texts, ' ')")}))
          AS set_words FROM segs""",
    "retagged_tok": f"""
        SELECT conv_pos, utt_idx, pos, token, lang AS old_lang,
          CASE WHEN lang = 'punct' THEN lang WHEN len(set_words) = 0 THEN lang
            WHEN len(list_filter(set_words, lambda w:
              lower(trim(w, '.,!?¿¡;:')) = lower(trim(token, '.,!?¿¡;:'))
              OR contains(w, trim(token, '.,!?¿¡;:'))
              OR contains(trim(token, '.,!?¿¡;:'), w))) > 0 THEN 'es' ELSE 'en' END AS lang
        FROM ready_tok JOIN word_sets USING (conv_pos, utt_idx)""",
    "retagged": f"""
        SELECT r.conv_pos, r.utt_idx, original_text, coalesce(t.tagged, '') AS tagged,
          coalesce(changed, false) AS modified,
          CASE WHEN changed AND t.n_es + t.n_en > 0 THEN
            CASE WHEN t.n_es > 0 AND t.n_en > 0 THEN 'yes' ELSE 'no' END
            ELSE has_code_switch END AS has_code_switch,
          CASE WHEN changed AND t.n_es + t.n_en > 0 THEN t.n_es / (t.n_es + t.n_en) * 100
            ELSE spanish_percentage END AS spanish_percentage
        FROM ready r LEFT JOIN (SELECT conv_pos, utt_idx, {COUNTS}, {SHOWN} AS tagged,
            bool_or(lang <> old_lang) AS changed FROM retagged_tok GROUP BY ALL) t
          USING (conv_pos, utt_idx)""",
    # ---- export and sequences
    "export": """
        SELECT row_number() OVER (ORDER BY conv_pos, utt_idx) - 1 AS id, conv_pos AS conversation_id,
          utt_idx AS utterance_id, speaker, text AS utterance, piped AS tokens,
          piped_tags AS pos_tags, has_code_switch,
          printf('%.1f', spanish_percentage) AS spanish_percentage,
          strategy AS generation_strategy, topic
        FROM utt""",
    # ---- existing, single and batch conversations in one export
    "single_ids": """
        SELECT response_id, (SELECT max(conv_pos) FROM convs)
          + row_number() OVER (ORDER BY response_id) AS conversation_id
        FROM (SELECT DISTINCT response_id FROM parsed_all)""",
    "later_ids": """
        SELECT batch_id, segment, (SELECT max(conversation_id) FROM single_ids)
          + row_number() OVER (ORDER BY batch_id, segment) AS conversation_id
        FROM (SELECT DISTINCT batch_id, segment FROM batch_utt)""",
    "three": """
        SELECT conv_pos AS conversation_id, utt_idx, speaker, text, piped, piped_tags,
          has_code_switch, spanish_percentage, strategy, topic FROM utt
        UNION ALL
        SELECT conversation_id, utt_idx, speaker, text, piped, piped_tags,
          has_code_switch, share, strategy, topic FROM parsed_all JOIN single_ids USING (response_id)
        UNION ALL
        SELECT conversation_id, b.utt_idx, b.speaker, text, replace(text, ' ', '|'),
          replace(regexp_replace(text, '[^ ]+',
            CASE WHEN spanish_percentage = 100 THEN 'ES' ELSE 'EN' END, 'g'), ' ', '|'),
          has_code_switch, spanish_percentage, strategy, topic
        FROM batch_utt b JOIN later_ids USING (batch_id, segment)""",
    "three_export": """
        SELECT row_number() OVER (ORDER BY conversation_id, utt_idx) - 1 AS id, conversation_id,
          utt_idx AS utterance_id, speaker, text AS utterance, piped AS tokens,
          piped_tags AS pos_tags, has_code_switch,
          printf('%.1f', spanish_percentage) AS spanish_percentage,
          strategy AS generation_strategy, topic
        FROM three""",
    "seq": """
        SELECT conv_pos, utt_idx, token, lang,
          row_number() OVER (PARTITION BY conv_pos, utt_idx ORDER BY pos) - 1 AS i,
          count(*) OVER (PARTITION BY conv_pos, utt_idx) AS n,
          lead(lang) OVER (PARTITION BY conv_pos, utt_idx ORDER BY pos) AS next_lang
        FROM tok WHERE lang IN ('en', 'es')""",
    "changes": """
        SELECT conv_pos, utt_idx, any_value(n) AS n, count(*) FILTER (lang <> next_lang) AS changes,
          coalesce(min(i) FILTER (lang <> next_lang) + 1, any_value(n)) AS first_change
        FROM seq GROUP BY ALL""",
    "points": """
        SELECT first_change AS x FROM changes JOIN utt USING (conv_pos, utt_idx)
        WHERE has_code_switch = 'yes'""",
    "lengths": """
        SELECT id, has_code_switch, len(string_split(tokens, '|')) AS token_count FROM export""",
    # ---- examples and features
    "pairs": """
        SELECT conv_pos, utt_idx, i, (lang <> next_lang)::BIGINT AS label
        FROM seq WHERE i < n - 1""",
    "found": f"""
        SELECT conv_pos, utt_idx, n, i AS pos,
          regexp_extract_all(lower(token), '[{W}]{{2,}}', 0) AS l FROM seq WHERE n > 1""",
    "single": """
        SELECT conv_pos, utt_idx, n, pos, unnest(l) AS term, generate_subscripts(l, 1) AS k
        FROM found""",
    "follow": """
        SELECT *, lag(term) OVER (PARTITION BY conv_pos, utt_idx ORDER BY pos, k) AS earlier
        FROM single""",
    "events": """
        SELECT conv_pos, utt_idx, n, pos, term FROM follow WHERE pos < n - 1
        UNION ALL
        SELECT conv_pos, utt_idx, n, pos, earlier || ' ' || term FROM follow
        WHERE pos < n - 1 AND earlier IS NOT NULL""",
    "vocab": """
        SELECT term, sum(n - 1 - pos)::BIGINT AS "count" FROM events GROUP BY term
        ORDER BY "count" DESC, term LIMIT 5000""",
    "weights": """
        SELECT term, df, ln(((SELECT count(*) FROM pairs) + 1) / (df + 1)) + 1 AS idf FROM (
          SELECT term, sum(n - 1 - first_pos)::BIGINT AS df FROM (
            SELECT term, conv_pos, utt_idx, n, min(pos) AS first_pos FROM events SEMI JOIN vocab
              USING (term) GROUP BY ALL) GROUP BY term)""",
    "hits": """
        SELECT conv_pos, utt_idx, n, pos, term, idf, row_number() OVER (
          PARTITION BY conv_pos, utt_idx, term ORDER BY pos) AS nth
        FROM events JOIN weights USING (term)""",
    "growths": """
        SELECT conv_pos, utt_idx, n, pos, sum((2 * nth - 1) * idf * idf) AS growth
        FROM hits GROUP BY ALL""",
    "norms": """
        SELECT conv_pos, utt_idx, i, sqrt(norm2) AS norm FROM (
          SELECT p.conv_pos, p.utt_idx, p.i, sum(growth) OVER (
            PARTITION BY p.conv_pos, p.utt_idx ORDER BY p.i) AS norm2
          FROM pairs p LEFT JOIN growths g
            ON p.conv_pos = g.conv_pos AND p.utt_idx = g.utt_idx AND p.i = g.pos)
        WHERE norm2 IS NOT NULL""",
    "split": """
        SELECT conv_pos, utt_idx, i, label, nr <= round(n_label * 0.2) AS is_test FROM (
          SELECT *, count(*) OVER (PARTITION BY label) AS n_label, row_number() OVER (
            PARTITION BY label ORDER BY md5(conv_pos || ':' || utt_idx || ':' || i || ':42')) AS nr
          FROM pairs)""",
    "scores": """
        SELECT conv_pos % 2 AS label, ((conv_pos * 31 + utt_idx * 17) % 101) / 100.0::DOUBLE AS score,
          CASE WHEN ((conv_pos * 31 + utt_idx * 17) % 101) / 100.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END
            AS prediction
        FROM lines""",
    "conf": """
        SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
          count(*) FILTER (label = 0 AND prediction = 1) AS fp,
          count(*) FILTER (label = 1 AND prediction = 0) AS fn,
          count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) AS total FROM scores""",
    "by_class": """
        SELECT class, support, hit / predicted AS precision, hit / support AS recall,
          2 * (hit / predicted) * (hit / support) / (hit / predicted + hit / support) AS f1,
          total, accuracy
        FROM (SELECT 'no_switch' AS class, tn AS hit, tn + fn AS predicted, tn + fp AS support, total,
                (tp + tn) / total AS accuracy FROM conf
              UNION ALL SELECT 'switch', tp, tp + fp, tp + fn, total, (tp + tn) / total FROM conf)""",
}


def uniform(row: str, choice: str) -> str:
    return f"(('0x' || substr(md5({row} || ':{choice}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def choose(values, row: str, choice: str) -> str:
    return at(values, f"floor({uniform(row, choice)} * {len(values)})")


PARTS.update({
    "plan_numbers": f"""
        SELECT doc_id AS i, (CASE WHEN doc_id < 50 THEN doc_id % 5 + 1
          WHEN doc_id >= 132 THEN CASE WHEN {uniform('doc_id', 'monolingual')} < 0.95 THEN
            CASE WHEN {uniform('doc_id', 'language')} < 0.5 THEN 6 ELSE 7 END ELSE 8 END
          ELSE floor({uniform('doc_id', 'strategy')} * 8) + 1 END)::BIGINT AS strategy
        FROM documents""",
    "plan": f"""
        SELECT i, strategy, CASE WHEN strategy = 3 THEN {choose(TONES, 'i', 'tone')} END AS tone,
          CASE strategy WHEN 1 THEN 'controlled_switch' WHEN 2 THEN 'role_based'
            WHEN 3 THEN 'topic_variation_' || {choose(TONES, 'i', 'tone')}
            WHEN 4 THEN 'back_translation' WHEN 5 THEN 'free_generation'
            WHEN 6 THEN 'monolingual_english' WHEN 7 THEN 'monolingual_spanish'
            ELSE 'minimal_switch' END AS strategy_name,
          {choose(TOPICS, 'i', 'topic')} AS topic,
          CASE WHEN strategy = 2 THEN {choose([a for a, _ in PERSONAS], 'i', 'persona')} END
            AS persona_a,
          CASE WHEN strategy = 2 THEN {choose([b for _, b in PERSONAS], 'i', 'persona')} END
            AS persona_b
        FROM plan_numbers""",
    "plan_points": """
        SELECT i, string_agg(v::VARCHAR, ',' ORDER BY v) AS switch_points FROM (
          SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY md5(i || ':' || v || ':points'))
            AS nr
          FROM plan_numbers, (SELECT unnest(range(10, 50)) AS v) WHERE strategy = 1)
        WHERE nr <= 3 GROUP BY i""",
    "batch_plan": """
        SELECT doc_id + 1 AS b, least(5, (SELECT count(*) * 5 - 3 FROM documents) - 5 * doc_id) AS n,
          CASE doc_id % 2 WHEN 0 THEN 'english' ELSE 'spanish' END AS language FROM documents""",
    "batch_topics": f"""
        SELECT b, string_agg(t, '; ' ORDER BY nr) AS topics,
          string_agg(nr || '. ' || t, chr(10) ORDER BY nr) AS numbered
        FROM (SELECT b, n, t, row_number() OVER (
                PARTITION BY b ORDER BY md5(b || ':' || t || ':topics')) AS nr
              FROM batch_plan, (SELECT unnest([{listed(BATCH_TOPICS)}]) AS t))
        WHERE nr <= n GROUP BY b""",
})


def sql(final: str) -> str:
    """The final SELECT with the parts it needs, in the order of `PARTS`."""
    needed: set[str] = set()
    queue = [final]
    while queue:
        mentioned = set(re.findall(r"\b[a-z_]+\b", queue.pop()))
        for name in mentioned & PARTS.keys() - needed:
            needed.add(name)
            queue.append(PARTS[name])
    parts = ", ".join(f"{name} AS ({PARTS[name].strip()})" for name in PARTS if name in needed)
    return (f"WITH {parts} " if parts else "") + final.strip()


def length_summary(source: str, x: str) -> str:
    return (
        f"SELECT count({x}) AS n, round(avg({x}), 6) AS mean, "
        f"round(median({x})::DOUBLE, 6) AS median, min({x}) AS min, max({x}) AS max FROM {source}"
    )


UTT_COLUMNS = f"""conv_pos, utt_idx, conv_pos AS conversation_id, speaker, text, original_text,
    tokens, has_code_switch, {SHARE_OUT}, strategy, topic"""
MIXED = "n_es > 0 AND n_en > 0"
MANN_WHITNEY = """
    SELECT n1, n2, u1 AS u, n1 * n2 / 2 AS mean_u, round(sigma, 6) AS sigma,
      round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma, 6) AS z
    FROM (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1,
        sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))))
          AS sigma
      FROM (SELECT sum(no)::BIGINT AS n1, sum(yes)::BIGINT AS n2,
          sum((before + (t + 1) / 2) * no) AS r1, sum(t::DOUBLE * t * t - t) AS ties
        FROM (SELECT no, yes, no + yes AS t, coalesce(sum(no + yes) OVER (ORDER BY x
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
          FROM (SELECT {x} AS x, count(*) FILTER ({first}) AS no, count(*) FILTER ({second}) AS yes
                FROM {source} GROUP BY x))))"""


# The normal approximation, which samples with ties or of more than eight values take. The error
# function by its series below 2 and by its continued fraction above.
P_VALUE = """
    SELECT n1, n2, u, mean_u, round(sigma, 6) AS sigma, round(z, 6) AS z, round(p, 6) AS p_value,
      CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict
    FROM (SELECT *, least(1.0, CASE WHEN x < 2
          THEN 1 - 2 / sqrt(pi()) * x * exp(-x * x) * list_reduce(
            list_prepend(1.0::DOUBLE, list_transform(range(1, 61), lambda k: (2 * (61 - k) + 1)::DOUBLE)),
            lambda s, d: 1 + 2 * x * x / d * s)
          ELSE exp(-x * x) / (sqrt(pi()) * list_reduce(
            list_prepend(x, list_transform(range(1, 101), lambda k: (101 - k)::DOUBLE / 2)), lambda f, a: x + a / f)) END) AS p
      FROM (SELECT *, z / sqrt(2) AS x FROM ({source})))"""


def strategy_prompt() -> str:
    cases = " ".join(
        f"WHEN {n} THEN replace({text(t)}, '{{topic}}', topic)" for n, t in STRATEGY_PROMPTS.items()
    )
    return f"CASE strategy {cases} END"


def batch_prompt() -> str:
    cases = " ".join(
        f"WHEN '{lang}' THEN replace(replace({text(t)}, '{{n}}', n::VARCHAR), '{{topics}}', numbered)"
        for lang, t in BATCH_PROMPTS.items()
    )
    return f"CASE language {cases} END"


_FINAL = {
    "flatten_utterances": f"SELECT {UTT_COLUMNS} FROM utt",
    "flatten_tokens": "SELECT conv_pos, utt_idx, pos, token, lang FROM tok",
    "json_roundtrip": f"SELECT {UTT_COLUMNS}, tagged, tokens_list, pos_tags FROM utt",
    "csv_roundtrip": "SELECT * REPLACE (nullif(tokens, '') AS tokens, nullif(pos_tags, '') AS pos_tags) FROM export",
    "parse_clean": "SELECT response_id, clean FROM clean_answers",
    "parse_lines": "SELECT response_id, line_no, name, content FROM dialogue",
    "speaker_map": "SELECT response_id, name, speaker, n_lines FROM speakers",
    "parse_transcript": "SELECT * FROM parsed",
    "parse_batch": "SELECT * FROM batch_utt",
    "assign_ids": "SELECT conversation_id, batch_id, segment, strategy, topic FROM batch_convs",
    "append_union": f"""
        SELECT conv_pos AS conversation_id, utt_idx, speaker, text, tokens, false AS no_pos_tags,
          has_code_switch, {SHARE_OUT}, strategy, topic FROM utt
        UNION ALL
        SELECT conversation_id, utt_idx, speaker, text, tokens, true, has_code_switch,
          spanish_percentage, strategy, topic
        FROM batch_utt JOIN batch_convs USING (batch_id, segment, strategy, topic)""",
    "append_export": "SELECT * FROM three_export",
    "tokenize": """
        SELECT conv_id, turn, coalesce(tokens, '') AS tokens FROM conversations LEFT JOIN (
          SELECT a, b, string_agg(token, ' ' ORDER BY pos) AS tokens FROM turn_tok GROUP BY ALL)
        ON conv_id = a AND turn = b""",
    "tag_forced": f"""
        SELECT conv_pos, utt_idx, strategy, coalesce(tagged, '') AS tagged FROM lines LEFT JOIN (
          SELECT a, b, {SHOWN} AS tagged FROM strategy_tok GROUP BY ALL)
        ON conv_pos = a AND utt_idx = b""",
    "tag_mixed": "SELECT conv_pos, utt_idx, tagged FROM utt",
    "tag_heuristic": f"""
        SELECT conv_id, turn, coalesce(tagged, '') AS tagged FROM conversations LEFT JOIN (
          SELECT a, b, {SHOWN} AS tagged FROM turn_tok GROUP BY ALL)
        ON conv_id = a AND turn = b""",
    "es_segments": f"""
        SELECT conv_pos, utt_idx, k - 1 AS k, {strip('segment')} AS segment FROM (
          SELECT conv_pos, utt_idx, unnest(inner_texts) AS segment,
            generate_subscripts(inner_texts, 1) AS k FROM segs)""",
    "pos_tags": "SELECT conv_pos, utt_idx, pos_tags FROM utt",
    "clean_text": f"SELECT conv_pos, utt_idx, {cleaned_text('original_text')} AS text FROM lines",
    "token_counts": "SELECT conv_pos, utt_idx, all_tokens, tokens FROM utt",
    "lang_profile": f"SELECT conv_pos, utt_idx, n_es, n_en, has_code_switch, {SHARE_OUT} FROM utt",
    "repair_strategy": f"SELECT conv_pos, utt_idx, tagged, has_code_switch, {SHARE_OUT} FROM fixed",
    "metadata_recount": """
        SELECT count(*) AS total_utterances, sum(tokens)::BIGINT AS total_tokens,
          count(*) FILTER (has_code_switch = 'yes') AS code_switching_utterances,
          count(*) FILTER (has_code_switch <> 'yes' AND spanish_percentage = 100)
            AS monolingual_spanish_utterances,
          count(*) FILTER (has_code_switch <> 'yes' AND spanish_percentage = 0)
            AS monolingual_english_utterances,
          count(*) FILTER (has_code_switch = 'yes') AS mixed_bilingual_utterances FROM fixed""",
    "repair_provenance": f"""
        SELECT (SELECT count(*) FROM convs WHERE {FORCE} IS NOT NULL) AS conversations_fixed,
          (SELECT count(*) FROM lines WHERE {FORCE} IS NOT NULL) AS utterances_fixed,
          'strategy-based-retagging' AS fix_method""",
    "repair_sample": f"""
        SELECT strategy, conv_pos, conv_pos AS conversation_id, text[1:100] AS text, has_code_switch,
          {SHARE_OUT}, array_to_string(list_slice(string_split(tagged, ' '), 1, 10), ' ')
            AS tagged_tokens
        FROM (SELECT strategy, min(conv_pos) AS conv_pos FROM convs
              WHERE strategy IN ({listed(CHECKED_STRATEGIES)}) GROUP BY strategy)
        LEFT JOIN (SELECT * EXCLUDE (strategy) FROM fixed WHERE utt_idx = 0) USING (conv_pos)""",
    "clean_tags_text": f"""
        SELECT conv_pos, utt_idx, text, {collapsed(replaced('text', CLEAN_PAIRS))} AS cleaned
        FROM utt""",
    "clean_tags_tokens": f"""
        SELECT conv_pos, utt_idx, tokens_list, tagged, tokens, has_code_switch, {SHARE_OUT}
        FROM cleaned""",
    "clean_tags_report": f"""
        SELECT count(*) AS utterances,
          count(*) FILTER (text <> {collapsed(replaced('text', CLEAN_PAIRS))}) AS fixed,
          count(*) FILTER (has_code_switch = 'yes') AS code_switched,
          {rate("count(*) FILTER (has_code_switch = 'yes')", 'count(*)')} AS cs_rate FROM cleaned""",
    "es_word_set": "SELECT conv_pos, utt_idx, array_to_string(set_words, ' ') AS words FROM word_sets",
    "retag_marks": f"""
        SELECT conv_pos, utt_idx, tagged, modified, has_code_switch, {SHARE_OUT} FROM retagged""",
    "retag_text": f"""
        SELECT conv_pos, utt_idx, {collapsed(replaced('text', FINAL_TEXT_PAIRS))} AS text FROM utt""",
    "retag_report": """
        SELECT count(*) AS utterances, count(*) FILTER (modified) AS modified FROM retagged""",
    "retag_examples": f"""
        SELECT conv_pos, utt_idx, original_text[1:80] AS original_text, {SHARE_OUT}, has_code_switch
        FROM retagged WHERE modified ORDER BY conv_pos, utt_idx LIMIT 5""",
    "export_flat": "SELECT * FROM export",
    "strategy_counts": "SELECT strategy, count(*) AS conversations FROM convs GROUP BY strategy",
    "export_summary": f"""
        SELECT count(*) AS rows, count(*) FILTER (has_code_switch = 'yes') AS code_switched,
          {rate("count(*) FILTER (has_code_switch = 'yes')", 'count(*)')} AS cs_rate FROM export""",
    "cs_rate_flag": f"""
        SELECT {rate("count(*) FILTER (has_code_switch = 'yes')", 'count(*)')} AS cs_rate,
          count(*) FILTER (has_code_switch = 'yes') AS cs_utterances, count(*) AS utterances FROM utt""",
    "cs_rate_true": f"""
        SELECT *, {rate('mixed', 'utterances')} AS mixed_share,
          {rate('spanish_only', 'utterances')} AS spanish_share,
          {rate('english_only', 'utterances')} AS english_share
        FROM (SELECT count(*) AS utterances, count(*) FILTER ({MIXED}) AS mixed,
          count(*) FILTER (n_es > 0 AND n_en = 0) AS spanish_only,
          count(*) FILTER (n_en > 0 AND n_es = 0) AS english_only FROM utt)""",
    "corpus_stats": f"""
        SELECT count(*) AS utterances, count(*) FILTER ({MIXED}) AS code_switched,
          count(*) FILTER (n_en > 0 AND n_es = 0) AS pure_english,
          count(*) FILTER (n_es > 0 AND n_en = 0) AS pure_spanish,
          sum(n_en)::BIGINT AS english_tokens, sum(n_es)::BIGINT AS spanish_tokens,
          count(*) FILTER ({MIXED} AND changes >= 2) AS intrasentential,
          count(*) FILTER ({MIXED} AND changes < 2) AS intersentential,
          {rate(f'count(*) FILTER ({MIXED})', 'count(*)')} AS cs_rate,
          round(avg(n), 6) AS mean_length, round(median(n)::DOUBLE, 6) AS median_length,
          min(n) AS min_length, max(n) AS max_length
        FROM utt LEFT JOIN changes USING (conv_pos, utt_idx)""",
    "lang_token_share": f"""
        SELECT *, {rate('english_tokens', 'english_tokens + spanish_tokens')} AS english_share,
          {rate('spanish_tokens', 'english_tokens + spanish_tokens')} AS spanish_share
        FROM (SELECT sum(n_en)::BIGINT AS english_tokens, sum(n_es)::BIGINT AS spanish_tokens
              FROM utt)""",
    "switch_types": f"""
        SELECT *, {rate('intersentential', 'intersentential + intrasentential')}
            AS intersentential_share,
          {rate('intrasentential', 'intersentential + intrasentential')} AS intrasentential_share
        FROM (SELECT count(*) FILTER (changes = 1) AS intersentential,
          count(*) FILTER (changes > 1) AS intrasentential FROM changes)""",
    "length_stats": length_summary("utt", "nullif(n_es + n_en, 0)"),
    "cs_only_stats": f"""
        SELECT a.*, b.* FROM ({length_summary(f'(SELECT * FROM utt WHERE {MIXED})', 'n_es + n_en')}) a,
          (SELECT round(avg(s), 6) AS mean_share, round(min(s), 6) AS min_share,
            round(max(s), 6) AS max_share, round(median(s), 6) AS median_share
           FROM (SELECT n_es / (n_es + n_en) * 100 AS s FROM utt WHERE {MIXED})) b""",
    "target_check": f"""
        SELECT *, cs_rate BETWEEN 20 AND 30 AS rate_in_target, total_tokens >= 15000 AS enough_tokens
        FROM (SELECT {rate(f'count(*) FILTER ({MIXED})', 'count(*)')} AS cs_rate,
          sum(tokens)::BIGINT AS total_tokens FROM utt)""",
    "retag_final_stats": f"""
        SELECT *, {rate('code_switched', 'utterances')} AS code_switched_share,
          {rate('spanish_only', 'utterances')} AS spanish_only_share,
          {rate('english_only', 'utterances')} AS english_only_share
        FROM (SELECT count(*) AS utterances,
          count(*) FILTER (has_code_switch = 'yes') AS code_switched,
          count(*) FILTER (has_code_switch <> 'yes' AND spanish_percentage = 100) AS spanish_only,
          count(*) FILTER (has_code_switch <> 'yes' AND spanish_percentage = 0) AS english_only
        FROM retagged)""",
    "conversation_summary": f"""
        SELECT conv_pos, strategy, count(*) AS utterances, sum(tokens)::BIGINT AS tokens,
          count(*) FILTER (has_code_switch = 'yes') AS cs_utterances,
          round(CASE {FORCE} WHEN 'en' THEN 0.0 WHEN 'es' THEN 100.0
            ELSE avg(spanish_percentage) END, 6)::DOUBLE AS avg_spanish
        FROM utt GROUP BY conv_pos, strategy""",
    "topup_needed": """
        SELECT greatest(0, trunc((cs_utterances / 0.25 - utterances) / 10)::BIGINT + 1)
            AS needed_conversations, cs_utterances, utterances
        FROM (SELECT count(*) FILTER (has_code_switch = 'yes') AS cs_utterances,
          count(*) AS utterances FROM utt)""",
    "dataset_totals": """
        SELECT (SELECT count(*) FROM convs) AS total_conversations, count(*) AS total_utterances,
          sum(tokens)::BIGINT AS total_tokens FROM utt""",
    "first_switch": """
        SELECT id, first_change AS switch_point FROM export
        JOIN changes ON conversation_id = conv_pos AND utterance_id = utt_idx
        WHERE has_code_switch = 'yes'""",
    "first_switch_stats": """
        SELECT count(*) AS n, round(avg(x), 6) AS mean, round(median(x)::DOUBLE, 6) AS median,
          round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max,
          CASE WHEN avg(x) < 5 THEN 'early' WHEN avg(x) < 10 THEN 'middle' ELSE 'late' END AS verdict
        FROM points""",
    "first_switch_hist": """
        SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, (
          SELECT count(*) FROM points WHERE x >= lower AND (x < upper OR bin = 19)) AS n
        FROM (SELECT bin, low + bin * (high - low) / 20 AS lower,
            CASE bin WHEN 19 THEN high ELSE low + (bin + 1) * (high - low) / 20 END AS upper
          FROM (SELECT min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM points),
            (SELECT unnest(range(0, 20)) AS bin))""",
    "export_lang_share": f"""
        SELECT english, spanish, english + spanish AS total,
          {rate('english', 'english + spanish')} AS english_share,
          {rate('spanish', 'english + spanish')} AS spanish_share
        FROM (SELECT sum(len(list_filter(l, lambda t: t = 'EN')))::BIGINT AS english,
          sum(len(list_filter(l, lambda t: t = 'ES')))::BIGINT AS spanish
          FROM (SELECT string_split(pos_tags, '|') AS l FROM export))""",
    "turn_lengths": "SELECT * FROM lengths",
    "turn_length_stats": """
        SELECT has_code_switch, count(*) AS n, round(avg(token_count), 6) AS mean,
          round(median(token_count)::DOUBLE, 6) AS median, round(stddev_samp(token_count), 6) AS std,
          min(token_count) AS min, max(token_count) AS max
        FROM lengths GROUP BY has_code_switch""",
    "turn_length_box": """
        SELECT has_code_switch, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          least(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1))::DOUBLE, q1) AS whisker_low,
          greatest(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1))::DOUBLE, q3) AS whisker_high,
          count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT has_code_switch, token_count AS x,
            quantile_cont(token_count::DOUBLE, 0.25) OVER w AS q1,
            quantile_cont(token_count::DOUBLE, 0.5) OVER w AS median,
            quantile_cont(token_count::DOUBLE, 0.75) OVER w AS q3
          FROM lengths WINDOW w AS (PARTITION BY has_code_switch))
        GROUP BY has_code_switch, q1, median, q3""",
    "mann_whitney": MANN_WHITNEY.format(
        x="token_count", first="has_code_switch = 'no'", second="has_code_switch = 'yes'",
        source="lengths",
    ),
    "mann_whitney_p": P_VALUE.format(source=MANN_WHITNEY.format(
        x="token_count", first="has_code_switch = 'no'", second="has_code_switch = 'yes'", source="lengths",
    ).replace(", 6)", ", 15)")),
    "switch_examples": """
        SELECT conv_pos, utt_idx, string_agg(token, ' ' ORDER BY i) AS tokens,
          string_agg(lang, ' ' ORDER BY i) AS labels FROM seq WHERE n > 1 GROUP BY ALL""",
    "switch_labels": "SELECT conv_pos, utt_idx, i, label FROM pairs",
    "prefix_contexts": """
        SELECT conv_pos, utt_idx, i, length(context) AS chars, md5(context) AS context_md5, label
        FROM (SELECT conv_pos, utt_idx, i, label, array_to_string(l[1:i + 1], ' ') AS context
          FROM pairs JOIN (SELECT conv_pos, utt_idx, list(token ORDER BY i) AS l FROM seq GROUP BY ALL)
            USING (conv_pos, utt_idx))""",
    "switch_share": """
        SELECT count(*) AS pairs, sum(label)::BIGINT AS switches, round(avg(label) * 100, 6) AS share
        FROM pairs""",
    "ngram_terms": """
        SELECT conv_pos, utt_idx, count(*) FILTER (NOT contains(term, ' ')) AS unigrams,
          count(*) FILTER (contains(term, ' ')) AS bigrams,
          sum(('0x' || substr(md5(term), 1, 10))::BIGINT * (pos + 1) % 1000000007)::BIGINT AS digest
        FROM events GROUP BY ALL""",
    "vocab_topk": "SELECT * FROM vocab",
    "vocab_heavy": "SELECT * FROM vocab",
    "idf_weights": "SELECT term, df, round(idf, 6) AS idf FROM weights",
    "tfidf": """
        SELECT conv_pos, utt_idx, term, tf, round(
          tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY conv_pos, utt_idx)), 4) AS weight
        FROM (SELECT conv_pos, utt_idx, term, idf, count(*) AS tf FROM hits GROUP BY ALL)""",
    "tfidf_norms": "SELECT conv_pos, utt_idx, i, round(norm, 4) AS norm FROM norms",
    "tfidf_mass": """
        SELECT term, round(sum(times * idf * rest), 4) AS mass
        FROM (SELECT conv_pos, utt_idx, pos, term, idf, count(*) AS times FROM hits GROUP BY ALL) h
        JOIN (SELECT conv_pos, utt_idx, i, sum(1 / norm) OVER (
                PARTITION BY conv_pos, utt_idx ORDER BY i DESC) AS rest FROM norms) r
          ON h.conv_pos = r.conv_pos AND h.utt_idx = r.utt_idx AND h.pos = r.i
        GROUP BY term""",
    "stratified_split": "SELECT * FROM split",
    "class_weights": """
        SELECT label, n, round(sum(n) OVER () / (2 * n), 6) AS weight
        FROM (SELECT label, count(*) AS n FROM split WHERE NOT is_test GROUP BY label)""",
    "clf_metrics": """
        SELECT round((tp + tn) / total, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
          round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM conf""",
    "roc_auc": f"""
        SELECT n1 AS positives, n2 AS negatives, round(u / (n1 * n2), 6) AS auc FROM (
        {MANN_WHITNEY.format(x='score', first='label = 1', second='label = 0', source='scores')})""",
    "clf_report": """
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
          round(f1, 6) AS f1, support FROM by_class
        UNION ALL SELECT 'accuracy', NULL, NULL, round(any_value(accuracy), 6), any_value(total)
          FROM by_class
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
          round(avg(f1), 6), any_value(total) FROM by_class
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
          round(sum(recall * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), any_value(total) FROM by_class""",
    "plan_strategy": "SELECT i, strategy, tone, strategy_name FROM plan",
    "plan_params": """
        SELECT i, topic, persona_a, persona_b, tone, switch_points
        FROM plan LEFT JOIN plan_points USING (i)""",
    "plan_prompts": f"SELECT i, strategy_name, topic, {strategy_prompt()} AS prompt FROM plan",
    "plan_batches": f"""
        SELECT b, n, language, topics, {batch_prompt()} AS prompt
        FROM batch_plan JOIN batch_topics USING (b)""",
    "stream_ingest": "SELECT * FROM parsed",
    "stream_cs_rate": f"""
        SELECT count(*) AS utterances, count(*) FILTER ({MIXED}) AS cs_utterances,
          {rate(f'count(*) FILTER ({MIXED})', 'count(*)')} AS cs_rate
        FROM conversations LEFT JOIN (SELECT a, b, {COUNTS} FROM turn_tok GROUP BY ALL)
          ON conv_id = a AND turn = b""",
}

ORACLE = {name: sql(final) for name, final in _FINAL.items()}
