"""Plain identifiers against the patterns themselves, disguised ones at source offsets."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from codemix.llm import pii


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_pattern(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def make_texts():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    def card():
        d = digits(rng.choice([15, 16, 18]))
        return next(d + c for c in "0123456789" if luhn(d + c))
    parts = [
        lambda: rng.choice(["a", "a.b", "@", "a@", "x@y", "_%+-@a.b"]) + "@" + rng.choice(["b.c", "b", "b.c.d-e", ".x", "b..c", "é.c"]),
        lambda: ".".join(str(rng.choice([0, 7, 255, 256, 1000, "007"])) for _ in range(rng.randint(3, 9))),
        card, lambda: " ".join(card()[i:i + 4] for i in range(0, 16, 4)), lambda: "-".join(card()), lambda: digits(rng.randint(1, 25)),
        lambda: "+" + digits(2) + rng.choice([" (", ".", "--", ""]) + digits(rng.randint(1, 16)), lambda: "+1 (743) 555-3824",
        lambda: "é日", lambda: rng.choice([" ", "  ", "\n", "-", ".", "+", ""]), lambda: "word",
    ]
    return ["".join(rng.choice(parts)() + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 10))) for _ in range(1500)]


def test_plain_spans_equal_the_patterns():
    for text in make_texts():
        assert pii.plain_spans(text) == by_pattern(text), text


@pytest.mark.parametrize("text, kind, hidden", [
    ("write to john.doe [at] mail [dot] example.com now", "email", "john.doe [at] mail [dot] example.com"),
    ("é John at example dot com, please", "email", "John at example dot com"),
    ("jоhn@exаmple.com".replace("@", " (AT) "), "email", "jоhn (AT) exаmple.com"),
    ("mail ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jo​hn​@example.com", "email", "jo​hn​@example.com"),
    ("call plus one seven four three five five five three eight two four today", "phone",
     "plus one seven four three five five five three eight two four"),
    ("host 192[.]168[.]7[.]1 is", "ip", "192[.]168[.]7[.]1"),
    ("card four one one one one one one one one one one one one one one one.", "card",
     "four one one one one one one one one one one one one one one one"),
    ("card ٤111 1111 1111 1111", "card", "٤111 1111 1111 1111"),
])
def test_disguised(text, kind, hidden):
    plain, every = pii.all_spans(text)
    start = text.index(hidden)
    assert (kind, start, start + len(hidden)) in every
    assert all(s in every for s in plain)


@pytest.mark.parametrize("text", [
    "we met at noon and look at this. See the dot on it", "one two three", "at home dot", "",
    "look at example.com", "à la carte été Straße déjà", "seven of nine at one",
])
def test_no_identifier(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("text, hidden", [
    ("to alice.sm\u0456th@example.com!", "alice.sm\u0456th@example.com"),
    ("to bob@example.c\u043em!", "bob@example.c\u043em"), ("to bob@mail.example dot com!", "bob@mail.example dot com"),
    ("to al\u200bice@example.c\u200bom!", "al\u200bice@example.c\u200bom"),
])
def test_disguise_beside_a_plain_part(text, hidden):
    plain, every = pii.all_spans(text)
    start = text.index(hidden)
    assert plain and all(s in every for s in plain)
    assert ("email", start, start + len(hidden)) in every
    assert pii.redacted(text) == "to [EMAIL]!"
    assert every.count(("email", start, start + len(hidden))) == 1


@pytest.mark.parametrize("hidden, kind", [
    ("one nine two dot one six eight dot one dot one", "ip"), ("one two seven dot zero dot zero dot one", "ip"),
    ("192.168.one.1", "ip"), ("10 dot zero dot 0 [dot] five", "ip"), ("One.two.three.four", "ip"),
    ("+1 555 two 34 one 9876", "phone"), ("+one 743 555 3824", "phone"), ("plus one (seven four three) 555 3824", "phone"),
    ("4111 1111 1111 111 one", "card"), ("john    at \n   example     dot      com", "email"),
    ("john     [    at    ]     example     (   dot   )      com", "email"),
    ("plus     one    seven     four , three,    five five five three eight two four", "phone"),
])
def test_single_spelled_digits_and_wide_blanks(hidden, kind):
    text = f"see {hidden}, ok"
    plain, every = pii.all_spans(text)
    assert (kind, 4, 4 + len(hidden)) in every and all(s in every for s in plain)
    assert len(every) == len(set(every))


@pytest.mark.parametrize("text", [
    "one of 3 and two.", "chapter one 1.2 and seven", "+ one, 2 and three", "it is one.  Two of 10 plus three", "some one dot",
])
def test_spelled_digits_are_no_identifier(text):
    assert pii.all_spans(text) == ([], [])


def test_a_digit_word_beside_an_identifier_hides_nothing():
    text = "seven \u0664111 1111 1111 1111"
    assert ("card", 6, len(text)) in pii.all_spans(text)[1]


@pytest.mark.parametrize("unit", [
    "one 1 ", "1 one", "plus ", "plus 1", "one.", "at    ", "one    ,", "dot     ", "[    ", "a at    ", " " * 1000 + "at", " " * 1000 + "one -",
])
def test_wide_disguises_take_linear_time(unit):
    start = time.time()
    pii.all_spans(unit * (200_000 // len(unit)))
    assert time.time() - start < 20


def test_redaction():
    assert pii.redacted("mail a@b.c or +1 (743) 555-3824.") == "mail [EMAIL] or [PHONE]."
    assert pii.redacted("john at example dot com") == "[EMAIL]"
    assert pii.redacted("none") == "none" and pii.redacted(None) is None and pii.redacted("") == ""


@pytest.mark.parametrize("unit", ["a", "1", "@", "1.", "+1", "a@", "one ", " at ", "dot ", "( ", " ", "1 ", "[", "​"])
def test_long_texts_take_linear_time(unit):
    start = time.time()
    pii.all_spans(unit * (200_000 // len(unit)))
    assert time.time() - start < 20


def test_rows(docs):
    rows = list(enumerate(make_texts()[:300])) + [(1, None), (None, "a@b.c"), (7, "x@y.z"), (7, "x@y.z")]
    got = Counter(map(tuple, pii.find(docs(rows)).collect()))
    expected = Counter()
    for i, text in rows:
        base = by_pattern(text or "")
        kinds = Counter(k for k, _, _ in base)
        expected[(i, *(kinds[k] for k in pii.KINDS), hashlib.sha256(pii.joined(base).encode()).hexdigest(),
                  pii.joined(pii.all_spans(text)[1]))] += 1
    assert got == expected
    assert pii.find(docs([])).collect() == []
    left = pii.redact(docs(rows))
    assert left.columns == docs([]).columns and left.count() == len(rows)
