"""Personal data: identifiers in plain sight, and disguised ones by offset-preserving deobfuscation.

Plain identifiers come from four patterns, searched so that a text takes time in
proportion to its length. For the disguised ones a text is rewritten: homoglyphs and
other scripts' digits to ASCII, invisible characters to nothing, spelled digits
to digits, and disguises of @ and . to these. Every character of the rewritten
text knows the span of the source that it stands for, so that what the same patterns
find there is mapped back to source offsets. Such a span is added unless a plain one of
its kind covers it. Linear-time patterns tell beforehand which searches a text needs. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codemix.llm.common import bounded_batches

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A search that starts inside a run of digits would only find what starting before it does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(end, at + 1))
    return found


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    if len(digits) > 19:
        return False
    doubled = "0246813579"
    return sum(int(doubled[int(d)] if i % 2 else d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _is_phone(match: str) -> bool:
    return 8 <= sum(c.isdigit() for c in match) <= 15


def plain_spans(text: str, hints: dict[str, bool] | None = None) -> list[Span]:
    """Identifiers in plain sight, by kind and start. A failing match isn't tried again.

    ``hints`` name the searches that can't find anything.
    """
    hints = hints or {}
    found = _emails(text)
    if hints.get("ip", True):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    if hints.get("card", True):
        found += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return found


# ---- deobfuscation --------------------------------------------------------

#: Letters of other scripts that look like the ASCII letter they stand in front of.
_LOOKALIKES = {
    "a": "аα", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ν",
    "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑‒–—−", ".": "․。",
}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


@lru_cache(maxsize=1)
def _characters() -> dict[int, str]:
    """What single characters become: compatibility forms of ASCII, digits, lookalikes."""
    table = {}
    for point in range(0x80, 0x20000):
        c = chr(point)
        if unicodedata.category(c) == "Nd":
            table[point] = str(unicodedata.decimal(c))
        else:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and " " <= plain <= "~":
                table[point] = plain
    table.update({ord(c): ascii_one for ascii_one, others in _LOOKALIKES.items() for c in others})
    return table


_INVISIBLE_ONES = re.compile(f"[{_INVISIBLE}]")


_DIGIT = "(?:" + "|".join(_DIGITS) + ")"
# Blanks in front of a disguise are tried from the first on only, so that a search stays linear.
_BLANKS, _FIRST = r"\s+", r"(?<!\s)"
_OPEN, _CLOSE = rf"{_FIRST}\s*[\[({{<]\s*", r"\s*[\])}>]\s*"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|{_FIRST}{_BLANKS}dot{_BLANKS})"
_BETWEEN = r"(?:\s+(?:[,-]\s*){0,3}|(?:[,-]\s*){1,3})"
_AT = rf"{_OPEN}(?:at|@){_CLOSE}"
_RULES = re.compile(
    # a spelled "at" counts only where a disguised dot follows the next name
    rf"(?P<at>{_AT}|{_FIRST}{_BLANKS}at{_BLANKS}(?=[a-z0-9-]{{1,63}}{_DOT}[a-z0-9]))"
    rf"|(?P<dot>(?<=[a-z0-9]){_DOT}(?=[a-z0-9]))"
    rf"|(?P<digits>(?<![a-z0-9])(?:plus{_BLANKS})?{_DIGIT}(?:{_BETWEEN}{_DIGIT})+(?![a-z0-9]))",
    re.IGNORECASE,
)
# a digit word by itself, searched where one adjoins a dot, a plus or another digit
_SINGLE = re.compile(rf"(?<![a-z0-9])(?:plus{_BLANKS})?{_DIGIT}(?![a-z0-9])", re.IGNORECASE)
_RE2_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


@lru_cache(maxsize=1)
def _hints() -> dict[str, str]:
    """Patterns for Arrow's regular expressions, which take linear time. Where one has no
    match, the search of that name has none either."""
    strange = "".join(rf"\x{{{ord(c):x}}}" for c in sorted(map(chr, _characters()))) + "".join(
        rf"\x{{{ord(c):x}}}" for c in _INVISIBLE + "\u0130"
    )
    return {
        "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
        "card": r"[0-9](?:[ -]?[0-9]){15}",
        "strange": f"[{strange}]",
        "rules": rf"(?i)[\[({{<]{_RE2_BLANK}*(?:at|@|dot|\.)|{_RE2_BLANK}dot{_RE2_BLANK}"
                 rf"|{_DIGIT}(?:{_RE2_BLANK}|[,-])+{_DIGIT}",
        "single": rf"(?i)[0-9+](?:{_RE2_BLANK}|[().-])*(?:plus{_RE2_BLANK}+)?{_DIGIT}"
                  rf"|{_DIGIT}(?:{_RE2_BLANK}|[().-])*[0-9]|\.{_DIGIT}|{_DIGIT}\.{_DIGIT}",
    }


def hints_of(texts: list[str]) -> list[dict[str, bool]]:
    """For each text which searches may find something."""
    batch = pa.array(texts, pa.large_string())
    columns = {k: pc.match_substring_regex(batch, p).to_pylist() for k, p in _hints().items()}
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


_WORD = re.compile(rf"plus|{_DIGIT}", re.IGNORECASE)


class _Rewritten:
    """A text and, for each character, the span of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, pieces) -> bool:
        """Replace matches; ``pieces(match)`` gives (characters, start, end) in this text."""
        out, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[last:m.start()])
            starts += self.starts[last:m.start()]
            ends += self.ends[last:m.start()]
            for new, a, b in pieces(m):
                out.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            last = m.end()
        if not last:
            return False
        out.append(self.text[last:])
        starts += self.starts[last:]
        ends += self.ends[last:]
        self.text, self.starts, self.ends = "".join(out), starts, ends
        return True


def _disguise(m: re.Match) -> list[tuple[str, int, int]]:
    if m["at"]:
        return [("@", *m.span())]
    if m["dot"]:
        return [(".", *m.span())]
    return _spelled(m)


def _spelled(m: re.Match) -> list[tuple[str, int, int]]:
    words = []
    for w in _WORD.finditer(m.string, *m.span()):
        low = w[0].lower()
        words.append(("+" if low == "plus" else str(_DIGITS.index(low)), *w.span()))
    return words


def _at_source(rewritten: _Rewritten, hints: dict[str, bool], known: list[Span]) -> list[Span]:
    """What the patterns find, at source offsets, without what a known span of its kind covers."""
    # those of a kind don't overlap
    taken = {kind: ([], []) for kind in KINDS}
    for kind, a, b in sorted(known, key=lambda s: s[1]):
        taken[kind][0].append(a)
        taken[kind][1].append(b)
    added = []
    for kind, a, b in plain_spans(rewritten.text, hints):
        start, end = rewritten.starts[a], rewritten.ends[b - 1]
        before = bisect_right(taken[kind][0], start)
        if not before or taken[kind][1][before - 1] < end:
            added.append((kind, start, end))
    return added


def disguised_spans(text: str, plain: list[Span], hints: dict[str, bool]) -> list[Span]:
    """Identifiers that only the rewritten text shows, at source offsets."""
    if not hints["strange"] and not hints["rules"] and not hints["single"]:
        return []
    # one character for another moves nothing
    rewritten = _Rewritten(text.translate(_characters()) if hints["strange"] else text)
    changed = rewritten.text != text
    if hints["strange"]:
        changed |= rewritten.rewrite(_INVISIBLE_ONES, lambda m: [])
        hints = hints_of([rewritten.text])[0]
    if hints["rules"]:
        changed |= rewritten.rewrite(_RULES, _disguise)
        hints = hints_of([rewritten.text])[0]
    added = _at_source(rewritten, hints, plain) if changed else []
    # apart, as a digit more beside an identifier may also hide it
    if hints["single"] and rewritten.rewrite(_SINGLE, _spelled):
        more = _at_source(rewritten, hints_of([rewritten.text])[0], plain)
        added += set(more) - set(added)
    return added


def spans_of(texts) -> list[tuple[list[Span], list[Span]]]:
    """For each text the plain spans, and these with the disguised ones; both by kind as
    listed, then start. Null texts are empty."""
    texts = [t or "" for t in texts]
    out = []
    for text, hints in zip(texts, hints_of(texts)):
        plain = plain_spans(text, hints)
        added = disguised_spans(text, plain, hints)
        out.append((plain, sorted(plain + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    return spans_of([text])[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with each identifier replaced by its kind; overlapping ones go together."""
    if text is None:
        return None
    out, last, end_of_last = [], 0, -1
    for start, end, kind in sorted((a, b, k) for k, a, b in (all_spans(text)[1] if spans is None else spans)):
        if start >= end_of_last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = end_of_last = max(end, end_of_last)
    return "".join(out) + text[last:] if out else text


# ---- DataFrame operators --------------------------------------------------

def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the sorted spans of every row: counts of plain ones per kind, their
    digest, and all spans as text.

    Null texts are empty, null or repeated ids and repeated rows give a row each,
    other columns are ignored, an empty table gives none.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for plain, every in spans_of(texts):
            kinds = [kind for kind, _, _ in plain]
            rows.append((
                *map(kinds.count, KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every),
            ))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with identifiers in the texts replaced; null texts stay null."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        found = [every for _, every in spans_of(texts)]
        return pd.Series([redacted(t, spans) for t, spans in zip(texts, found)], dtype=object)

    return df.withColumn(text_col, replaced(F.col(text_col)))
