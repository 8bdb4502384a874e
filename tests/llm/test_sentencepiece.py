"""Ids and decoded texts must be the library's, for any text."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from codemix.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
EDGES = [
    None, "", " ", "  ", "a", "\x01 b", "a\x01b  c", "▁ ▁x", "日本語 é\n\n\tx", "\x00", "😀 😀", "aaaa" * 50,
    "the the " * 100, " " * 40, "x" + " " * 33 + "y", "​", "ab" * 500 + "日本" * 30, "<s> <unk> <0x41>",
]


def same(texts):
    for text, (n, ids, decoded) in zip(texts, S.Encoder(PATH).batch(pa.array(texts, pa.string()))):
        expected = LIBRARY.encode(text or "")
        assert (n, ids, decoded) == (len(expected), ",".join(map(str, expected)), LIBRARY.decode(expected)), text


def test_edges():
    same(EDGES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


@pytest.mark.parametrize("alphabet, size", [
    (list("abcdeiounstrhl"), 3000), (["in", "er", "the", "an", "  ", " "], 300),
    (list("abcdeiounstrhl ABC ée\n\t.,'日本😀▁\x010123456789"), 200), (list("aab"), 2000),
])
def test_random_texts(alphabet, size):
    rng = random.Random(size)
    same(["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(40)])


def test_the_bound_of_kept_parts(monkeypatch):
    monkeypatch.setattr(S, "CACHED", 5)
    monkeypatch.setattr(S, "_BLOCK", 20)
    encoder = S.Encoder(PATH)
    for text in EDGES * 2:
        expected = LIBRARY.encode(text or "")
        assert encoder.batch(pa.array([text], pa.string()))[0][1] == ",".join(map(str, expected))


def test_query_rows(docs):
    rows = list(enumerate(EDGES)) + [(None, "x y"), (1, "repeat"), (1, "repeat"), (99, "long words " * 20_000)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert Counter(map(tuple, S.digest(docs(rows), PATH).collect())) == Counter(expected)
    full = S.encode(docs(rows), PATH).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in full) == sorted((str(e[0]), e[1]) for e in expected)
    assert S.digest(docs([]), PATH).collect() == []
