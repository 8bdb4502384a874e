"""Character classes and plain text expressions.

The classes are written out so that Java's regex engine agrees with Unicode
word/space/digit semantics; ``\\w`` and ``\\s`` are ASCII-only in Java.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE_NO_NEWLINE = r"\t\x0b-\r\x1c-\x20\x85\p{Z}"
# `\p{Z}` written out, for engines without Unicode's classes.
_Z = "\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space other than the blank.
OTHER_BLANKS = f"[\t-\r\x1c-\x1f\x85{_Z[1:]}]"

# Punctuation kept as tokens, and the characters ignored when
# two words are compared.
PUNCT = ".,!?;:¿¡"
EDGE_PUNCT = ".,!?¿¡;:"


@cache
def python_pattern(pattern: str) -> re.Pattern:
    """A pattern over these classes for Python, whose ``\\w`` is letters, numbers and the underscore."""
    return re.compile(pattern.replace(WORD, r"\w").replace(r"\p{Z}", _Z))


def squeeze(c: Column, space: str = SPACE) -> Column:
    """Runs of white space become one blank. Single blanks are no match, so that an ordinary text is only searched."""
    return F.regexp_replace(c, f"(?: (?=[{space}])|[{space}&&[^ ]])[{space}]*", " ")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` knows only blanks)."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(squeeze(c))


def words(c: Column) -> Column:
    """Words separated by white space; no empty strings."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def replace_all(c: Column, pairs) -> Column:
    """Apply replacements of fixed strings one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), new if isinstance(new, Column) else F.lit(new))
    return c


def drop_numbered_marks(c: Column) -> Column:
    without = F.regexp_replace(c, r"\[\p{Nd}+\]", "")
    return F.when(F.contains(c, F.lit("[")), without).otherwise(c)
