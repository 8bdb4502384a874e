"""Tokenising, language tagging and per-utterance language profile.

A text is tokenised with one regex pass: a token is either the span from the
first to the last word character of a white-space separated word, or one edge
punctuation character. Words inside ``<ES>…</ES>`` are first prefixed with a
control character, so the same pass also yields them whole and recognisable.
Everything here is a narrow column expression. Tags depend on the word between white
space alone: ASCII words of an Arrow batch are tokenised by their bytes, and each
distinct other word goes through the regex once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from codemix.functions import batches as B, text as T

IN_SEGMENT = "\u0001"
SEGMENT_END = "\u0002"

# Letters and words that mark a token as Spanish, and the words
# that get a coarse part of speech.
SPANISH_LETTERS = "ñáéíóúü"
SPANISH_WORDS = [
    "el", "la", "los", "las", "un", "una", "de", "que", "y", "en",
    "por", "para", "con", "sin", "pero", "cuando", "donde", "como",
    "está", "están", "estoy", "mi", "tu", "su", "qué", "así", "muy",
]
DETERMINERS = ["the", "a", "an", "el", "la", "los", "las"]
VERBS = ["is", "are", "was", "were", "es", "está", "son"]

_BREAK = T.SPACE + IN_SEGMENT + SEGMENT_END
_TOKEN = (
    f"{IN_SEGMENT}[^{_BREAK}]+"
    f"|[{T.WORD}](?:[^{_BREAK}]*[{T.WORD}])?"
    f"|[{T.PUNCT}]"
)
_SEGMENT = r"<ES>([^\n]*?)</ES>"


def mark_segments(c: Column) -> Column:
    """Prefix every word of a Spanish segment with a control character.

    A segment counts only when it has no white space at its edges; a padded
    one stays in the text as written and is tokenised like any other words.
    """
    opened = F.regexp_replace(c, _SEGMENT, f"{IN_SEGMENT}$1{SEGMENT_END}")
    unpadded = F.regexp_replace(
        opened,
        f"{IN_SEGMENT}([{T.SPACE}][^{SEGMENT_END}]*|[^{SEGMENT_END}]*[{T.SPACE}]){SEGMENT_END}",
        "<ES>$1</ES>",
    )
    # \G continues from the previous word of the same segment.
    each_word = F.regexp_replace(
        unpadded,
        f"(?:{IN_SEGMENT}|\\G(?!^)[{T.SPACE}]+)([^{_BREAK}]+)",
        f" {IN_SEGMENT}$1",
    )
    return each_word


def _without_controls(c: Column) -> Column:
    return T.replace_all(c, [(IN_SEGMENT, ""), (SEGMENT_END, "")])


def prepare(c: Column, force_language: Column | None = None) -> Column:
    """Text ready for :func:`split_tokens`; marks are read only without a forced language."""
    may_hold_marks = F.contains(c, F.lit("<"))
    if force_language is not None:
        may_hold_marks = may_hold_marks & force_language.isNull()
    # The conditions look at the text as it came: an expression inside a
    # higher-order function is evaluated again wherever it is written.
    plain = _without_controls(T.drop_numbered_marks(c))
    return F.when(may_hold_marks, mark_segments(plain)).otherwise(plain)


def split_tokens(prepared: Column) -> Column:
    return F.regexp_extract_all(prepared, F.lit(_TOKEN), F.lit(0))


def count_tokens(prepared: Column) -> Column:
    """Number of tokens, punctuation included, without building them."""
    return F.regexp_count(prepared, F.lit(_TOKEN))


def has_tokens(prepared: Column, n: int) -> Column:
    """Whether there are so many tokens, without looking at the text behind them. What is matched is never given
    back, so that they are the tokens that :func:`split_tokens` finds."""
    return F.rlike(prepared, F.lit(f"^(?>(?s:.)*?(?:{_TOKEN})){{{n}}}"))


# What a token may be: the last two keep their language whatever is forced.
_ENGLISH, _SPANISH, _PUNCT, _IN_SEGMENT = range(4)
_LANGS = ["en", "es", "punct", "es"]
_SPANISH_SET = frozenset(SPANISH_WORDS)
_SPANISH_LETTER = re.compile(f"[{SPANISH_LETTERS}]")


@lru_cache(maxsize=1 << 16)
def _word_tokens(word: str, pattern: str) -> tuple[list[str], list[int]]:
    """Tokens of a text without white space, and what they are."""
    tokens, kinds = [], []
    for raw in T.python_pattern(pattern).findall(word):
        if raw[0] == IN_SEGMENT:
            kind = _IN_SEGMENT
        elif raw in T.PUNCT:
            kind = _PUNCT
        else:
            kind = _SPANISH if _SPANISH_LETTER.search(raw) or raw.lower() in _SPANISH_SET else _ENGLISH
        tokens.append(raw[1:] if kind == _IN_SEGMENT else raw)
        kinds.append(kind)
    return tokens, kinds


# What a byte is.
_OTHER, _WORD, _MARK, _ODD = range(4)
_BYTE = np.full(256, _OTHER, np.uint8)
_BYTE[[b for b in range(128) if chr(b).isalnum() or chr(b) == "_"]] = _WORD
_BYTE[[ord(c) for c in T.PUNCT if c.isascii()]] = _MARK
_BYTE[[ord(IN_SEGMENT), ord(SEGMENT_END), *range(128, 256)]] = _ODD
_ASCII_SPANISH = pa.array([w for w in SPANISH_WORDS if w.isascii()])


def _words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words between blanks start and end; how many started up to each byte."""
    there = data != ord(" ")
    first, last = there.copy(), there.copy()
    first[1:] &= ~there[:-1]
    last[:-1] &= ~there[1:]
    opens, closes = begin[:-1][begin[:-1] < len(data)], begin[1:][begin[1:] > 0] - 1
    first[opens], last[closes] = there[opens], there[closes]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, np.cumsum(first)


def _tag_part(texts: pa.Array, forced: pa.Array, pattern: str) -> pa.Array:
    there = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(there, T.OTHER_BLANKS)).as_py():
        there = pc.replace_substring_regex(there, T.OTHER_BLANKS, " ")
    data, begin = B.text_bytes(there)
    start, end, started = _words(data, begin)
    byte = _BYTE[data]
    odd = np.zeros(len(start), bool)
    odd[started[byte == _ODD] - 1] = True
    # of ASCII words the span from the first to the last word character, and marks outside it
    inside = np.flatnonzero(byte == _WORD)
    before = B.running(byte == _WORD)
    plain = np.flatnonzero(~odd & (before[end] > before[start]))
    low, high = np.full(len(start), len(data)), np.full(len(start), len(data))
    low[plain], high[plain] = inside[before[start[plain]]], inside[before[end[plain]] - 1]
    marks = np.flatnonzero(byte == _MARK)
    word = started[marks] - 1
    marks = marks[~odd[word] & ((marks < low[word]) | (marks > high[word]))]
    # each distinct other word by itself
    odd = np.flatnonzero(odd)
    number, found = B.distinct(B.cut(data, start[odd], end[odd] - start[odd]).cast(pa.binary()))
    tagged = [_word_tokens(w, pattern) for w in found]
    counts = np.array([len(tokens) for tokens, _ in tagged], np.int64)
    at = B.places(counts, number)
    further, bounds = B.text_bytes(pa.array([t for tokens, _ in tagged for t in tokens], pa.string()))
    # all of them in text order
    place = np.concatenate([low[plain], marks, np.repeat(start[odd], counts[number])])
    order = np.argsort(place, kind="stable")
    kinds = np.concatenate([
        np.full(len(plain), _ENGLISH), np.full(len(marks), _PUNCT),
        np.array([k for _, every in tagged for k in every], np.int64)[at],
    ])[order]
    length = np.concatenate([high[plain] + 1 - low[plain], np.ones(len(marks), np.int64), np.diff(bounds)[at]])[order]
    source = np.concatenate([low[plain], marks, len(data) + bounds[:-1][at]])[order]
    tokens = B.cut(np.concatenate([data, further]), source, length)
    asked = np.flatnonzero((kinds == _ENGLISH) & (length <= max(map(len, SPANISH_WORDS))))
    known = pc.is_in(pc.ascii_lower(tokens.take(pa.array(asked))), _ASCII_SPANISH).to_numpy(zero_copy_only=False)
    kinds[asked[known]] = _SPANISH
    lists = np.searchsorted(place[order], begin)
    # a forced language is a further kind
    language, languages = B.distinct(forced)
    is_forced = np.array([x is not None for x in languages], bool)[language]
    if is_forced.any():
        n = np.diff(lists)
        kinds = np.where(np.repeat(is_forced, n) & (kinds <= _SPANISH), np.repeat(language, n) + len(_LANGS), kinds)
    langs = pa.array([*_LANGS, *languages], pa.string()).take(pa.array(kinds))
    return B.lists_of(pa.StructArray.from_arrays([tokens, langs], ["token", "lang"]), lists, B.missing(texts))


def _tagged(texts: pa.Array, forced: pa.Array, patterns: pa.Array) -> pa.Array:
    pattern = patterns[0].as_py() if len(patterns) else ""
    return B.in_parts(lambda t, f: _tag_part(t, f, pattern), texts, forced)


def tag_prepared(prepared: Column, force_language: Column | None = None) -> Column:
    """``array<struct<token,lang>>`` in text order. A token that is Spanish by its mark or
    punctuation stays so; others have the forced language, if there is one."""
    force = F.lit(None) if force_language is None else force_language
    tagged = F.arrow_udf(_tagged, "array<struct<token:string,lang:string>>")
    return tagged(prepared, force.cast("string"), F.lit(_TOKEN))


def tag(c: Column, force_language: Column | None = None) -> Column:
    return tag_prepared(prepare(c, force_language), force_language)


def forced_language(strategy: Column) -> Column:
    """Conversations declared monolingual carry their language; others NULL."""
    return (
        F.when(strategy == "monolingual_spanish", "es")
        .when(strategy == "monolingual_english", "en")
    )


def clean_text(c: Column) -> Column:
    plain = T.drop_numbered_marks(c)
    unmarked = F.when(F.contains(c, F.lit("<")), F.regexp_replace(plain, _SEGMENT, "$1")).otherwise(plain)
    return T.collapse(unmarked)


def segments(c: Column) -> Column:
    """Texts of all marked segments, stripped."""
    return F.transform(F.regexp_extract_all(c, F.lit(_SEGMENT), F.lit(1)), T.strip)


def segment_words(c: Column) -> Column:
    """Distinct words of all marked segments, punctuation kept."""
    inner = F.regexp_extract_all(c, F.lit(_SEGMENT), F.lit(1))
    return F.array_distinct(T.words(F.array_join(inner, " ")))


def coarse_pos(tagged: Column) -> Column:
    def pos(t: Column) -> Column:
        word = F.lower(t["token"])
        return (
            F.when(t["lang"] == "punct", t["token"])
            # one look at a set for most tokens
            .when(~word.isin(DETERMINERS + VERBS), "NN")
            .when(word.isin(DETERMINERS), "DT")
            .when(word.isin(VERBS), "VB")
            .otherwise("NN")
        )

    return F.transform(tagged, pos)


def langs(tagged: Column) -> Column:
    return tagged["lang"]


def count_lang(tagged: Column, lang: str) -> Column:
    # array_remove is generated code; a filter with a lambda is interpreted.
    return F.size(langs(tagged)) - F.size(F.array_remove(langs(tagged), lang))


def count_words(tagged: Column) -> Column:
    """Tokens that are not punctuation."""
    return F.size(F.array_remove(langs(tagged), "punct"))


def switch_flag(n_es: Column, n_en: Column) -> Column:
    return F.when((n_es > 0) & (n_en > 0), "yes").otherwise("no")


def spanish_share(n_es: Column, n_en: Column) -> Column:
    """Spanish words in percent of the words with a language; 0 when there are none."""
    total = n_es + n_en
    return F.when(total > 0, n_es / total * 100).otherwise(F.lit(0.0))
