"""Collocations against plain counting, on every path; tries against dictionaries; against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codemix.llm import collocations as C, queries
from codemix.llm.double_array import DoubleArray
from oracle_check import difference, oracle_connection

SCHEMA = "text string, lang string, doc_id long, phrase string, f long, n long, word string, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(t, lang, 1, "p", 2, 3, "w", 0.5) for lang, t in rows], SCHEMA)


def plain(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    found = []
    for p, a in f.items():
        lang, words = p[0], p[1:]
        if len(words) == 1:
            continue
        inside = any(
            q[0] == lang and len(q) > len(p) and c >= a
            and any(q[1 + i:1 + i + len(words)] == words for i in range(len(q) - len(p) + 1)) for q, c in f.items()
        )
        if inside:
            continue
        score, cut = min(
            (1000 * a * n[lang] // (f[p[:1 + k]] * f[(lang, *words[k:])]), k) for k in range(1, len(words))
        )
        left, right = f[p[:1 + cut]], f[(lang, *words[cut:])]
        found.append((lang, -score, -a, " ".join(words).encode(), left, right, n[lang]))
    ranks, out = Counter(), []
    for lang, score, a, phrase, left, right, total in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def texts(seed, size=400):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "c3", "é", "É", " ", "x-y", "\x01", "中文", "z" * 300, "\U0001f600"]
    fixed = ["in the middle of it", "as a rule the", "a a a a a a a a"]
    rows = []
    for _ in range(size):
        parts = []
        for _ in range(draw.randrange(12)):
            parts.append(draw.choice(fixed) if draw.random() < 0.2 else draw.choice(words))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "\x0b", "?!"]))
        rows.append((draw.choice(["en", "en", "fr", None, "und", ""]), "".join(parts)))
    return rows + [("en", None), (None, None), ("de", ""), ("fr", " \t"), ("en", "the of " * 5000), ("xx", "...")]


@pytest.mark.parametrize("bounds", [{}, {"TRIE": 3}, {"_BLOCK": 50}, {"MAX_WORDS": 2}, {"MAX_PHRASES": 3}, {"BUCKETS": 5, "TRIE": 4}, {"MAX_PHRASES": 30, "TRIE": 9}])
def test_equals_plain(spark, table, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(C, name, value)
    rows = texts(1)
    got = sorted(map(tuple, C.mine(table(rows).repartition(5), least=6, top=25).collect()))
    assert got == plain(rows, 6, 5, 25) and len(got) > 30


@pytest.mark.parametrize("buckets", [7, 1 << 20])
def test_passes_do_not_grow_with_the_candidates(spark, table, monkeypatch, buckets):
    """Many candidates take one sparse count for a length, not a pass for each trie."""
    tries, walk = [], C._in_trie
    monkeypatch.setattr(C, "_in_trie", lambda *a: tries.append(1) or walk(*a))
    monkeypatch.setattr(C, "TRIE", 2)
    monkeypatch.setattr(C, "TRIES", 3)
    monkeypatch.setattr(C, "BUCKETS", buckets)
    rows = texts(3)
    got = sorted(map(tuple, C.mine(table(rows).repartition(4), least=6, top=50).collect()))
    assert got == plain(rows, 6, 5, 50) and len(tries) <= 3 * 3


def test_words_and_lengths(table):
    rows = texts(2, 200)
    assert sorted(map(tuple, C.mine(table(rows), least=4, longest=3, top=9).collect())) == plain(rows, 4, 3, 9)
    assert C.mine(table(rows), least=10**6).collect() == []
    assert C.mine(table([]), least=1).collect() == []


def test_large_products(spark):
    """Products of more than 64 bits."""
    big = 4_000_000_000_000
    phrases = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long"
    )
    totals = spark.createDataFrame([("en", 90 * big)], "lang string, n long")
    row = C.scored(phrases, totals).first()
    assert row.score == 1000 * (big - 7) * 90 * big // (big * (big + 1))


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    draw = np.random.default_rng(seed)
    symbols, length = int(draw.choice([2, 5, 400])), int(draw.integers(1, 5))
    rows = np.unique(draw.integers(1, symbols + 1, (int(draw.choice([1, 30, 3000])), length)), axis=0)
    draw.shuffle(rows)
    text = draw.integers(0, symbols + 1, 5000)
    text[1000:1000 + 3 * length] = np.tile(rows[0], 3)
    trie = DoubleArray(rows, symbols)
    want = Counter(tuple(text[i:i + length].tolist()) for i in range(len(text) - length + 1))
    assert trie.count(text, len(rows)).tolist() == [want[tuple(r)] for r in rows.tolist()]
    assert DoubleArray(np.zeros((0, length), int), symbols).count(text, 0).tolist() == []


def test_candidates_come_in_blocks():
    draw = np.random.default_rng(4)
    rows = np.unique(draw.integers(1, 6, (60, 3)), axis=0)
    frequent = set(map(tuple, rows.tolist()))
    want = sorted((*a, b[-1]) for a in frequent for b in frequent if a[1:] == b[:-1])
    for most in (1, 7, 10**6):
        assert sorted(tuple(r) for block in C.candidates(rows, most) for r in block.tolist()) == want


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf_dir):
    sql = oracle_connection(sf_dir).sql(queries.ORACLE["op13_collocations"])
    assert difference(queries.QUERIES["op13_collocations"](spark, sf_dir), sql) is None
