"""Simple-8b words and token files: exact round trips, ids as the library has them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from codemix.llm import simple8b, token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
EDGES = [
    None, "", " ", "  ", "a", "it's we'll I'd 'tis", "x  y\n\nz \t", "end ", "end  ", "\n", "a\n b", "日本語 é", "\x01a\x1cb",
    "a\xa0b\xa0\xa0c", "<|endoftext|> a", "<| a", "12 34½ ²", "été ÀÉ", "a\x0bb\x85c", "don't  'S", "😀", "..." * 50, "  x",
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_words(values):
    words, escaped = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words, escaped, len(values)).tolist() == values


@pytest.mark.parametrize("values", [
    [0] * 1000, [1] * 61, [2**60 - 1, 2**60, 2**60 - 1], [], [0] * 119 + [7], list(range(70_000)),
])
def test_words_of_runs(values):
    words, escaped = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words, escaped, len(values)).tolist() == values
    if values == [0] * 1000:
        assert len(words) == 9  # 120 zeros in a word, the last one filled up


def same(texts):
    for text, ids in zip(texts, T.Encoder(PATH).batch(pa.array(texts, pa.string()))):
        assert ids.tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_ids_of_edges():
    same(EDGES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(
    st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sdtreéÉ.,!12\x01\x1c\xa0"))
), max_size=40), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    same(texts)


@pytest.mark.parametrize("small", [False, True])
def test_files(docs, monkeypatch, small):
    if small:  # many blocks and files; tasks of a local session run this process's module
        monkeypatch.setattr(T, "CACHED", 10)
    rng = random.Random(1)
    rows = list(enumerate(EDGES)) + [(-5, "negative"), (7, "again"), (7, "again"), (None, "no id"), (2**40, "word " * 60_000)]
    rows += [(1000 + i, " ".join(rng.choice(["ab", "cde", "É"]) for _ in range(rng.randint(0, 300)))) for i in range(400)]
    rng.shuffle(rows)
    got = T.round_trip(docs(rows), PATH).collect()
    assert len(got) == len(rows)
    expected = {}
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        expected.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i))


def test_blocks_and_broken_files():
    tokens = [np.array([5, 0]), np.array([2**63, 2**61, 0], np.uint64), np.array([0])]
    ids, back = T.unpack_block(memoryview(T.pack_block([3, None, -1], [t.astype(np.uint64) for t in tokens])))
    assert ids == [3, None, -1] and [t.tolist() for t in back] == [t.tolist() for t in tokens]
    with pytest.raises(ValueError):
        list(T.blocks_of(b"S8BTOK01 and then nothing that is a footer"))


def test_no_rows(docs):
    assert T.round_trip(docs([]), PATH).collect() == []


def test_reading_gives_up_the_encoded_parts():
    """A worker that reads files frees what it kept of the writing."""
    encoder = T.encoder_of(PATH)
    assert T.encoder_of(PATH) is encoder
    assert list(T.read_files(iter(()))) == [] and T.encoder_of(PATH) is not encoder
