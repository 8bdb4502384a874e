"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE on a blank and the text, B a SentencePiece model on the text, which puts
the blank in front itself, so that both cover the same bytes. Tokens are the rows of a
matrix whose columns are bytes; A · Bᵀ, made row by row, has an entry for each pair of tokens
that overlap, with the number of bytes they share. Where tokens of both end, the bytes are cut
into groups. Tokens by groups are a second pair of matrices, whose product links all tokens of a group.

Neither tokenizer makes a token across a blank between two other characters, so that texts are cut
there and each distinct part is aligned once by a worker; one product serves all new parts of a
batch. Counts of linked id pairs are taken over all documents by Spark, and joined back to each
document's distinct pairs.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from codemix.llm import csr, words
from codemix.llm.common import ROW, bounded_batches, keyed, written
from codemix.llm.token_files import _SPACE, Encoder

BLANK = "\u2581"
#: Parts that a Python worker keeps, about 500 bytes each.
CACHED = 200_000
#: Parts are aligned in blocks of about so many characters.
BLOCK = 1 << 18
#: Most distinct id pairs in a broadcast table; more are joined by shuffling.
MAX_BROADCAST = 1_000_000
_CUT = re.compile(r"(?<=\S)(?= \S)")


class ByteBpe(Encoder):
    """A's ids by the library; a special token's string is ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # an object of its own, as the setting is the object's
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        super().__init__(path, library)
        vocabulary = self.library.get_vocab()
        self.size = len(self.byte_lengths)
        byte_of = _byte_characters()
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            known = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        found = [np.frombuffer(ids, np.int32) for ids in self._ids(parts)]
        self.known = {}
        return found


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1
    characters are their own bytes, the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pieces:
    """B's ids by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.library.id_to_piece(i).replace(BLANK, " ")
            if " " in piece.lstrip(" "):
                raise ValueError("the model's pieces reach across blanks")
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.encode())

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts that each begin with the blank that the library adds."""
        return [np.array(ids, np.int32) for ids in self.library.encode([p[1:] for p in parts], num_threads=1)]


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array, and the place where each of its parts begins, and the end."""
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays], dtype=np.int64)]
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.int32)).astype(np.int64), offsets


class Alignment:
    """Tokens of a list of parts, their links and groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a_ends, self.b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        self.a_matrix, self.b_matrix = csr.intervals(self.a_ends), csr.intervals(self.b_ends)
        ends = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)
        self.groups = len(ends)
        self.a_group, self.b_group = np.searchsorted(ends, self.a_ends), np.searchsorted(ends, self.b_ends)
        self.a_groups = csr.one_each(self.a_group, self.groups)
        self.b_groups = csr.one_each(self.b_group, self.groups)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of A's and B's tokens that overlap, and the bytes they share. There are fewer than tokens."""
        blocks = list(csr.product(self.a_matrix, csr.transposed(self.b_matrix)))
        if not blocks:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(column) for column in zip(*blocks))

    def shared(self):
        """Blocks of the places of A's and B's tokens that have a group in common: the
        square of a group's tokens, so block by block and not for all at once."""
        for a, b, _ in csr.product(self.a_groups, csr.transposed(self.b_groups)):
            yield a, b

    def shared_counts(self) -> np.ndarray:
        """For each of A's tokens the number of B's tokens in its group."""
        ones = np.ones(len(self.b_group), np.int64)
        return csr.times_vector(self.a_groups, csr.times_vector(csr.transposed(self.b_groups), ones))


class Aligner:
    """Aligns batches of texts; keeps what it knows of parts, up to a bound."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.a_lengths = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b.bytes], np.int64)
        if self.a.size * self.b.size >= 1 << 40:
            raise ValueError("vocabularies are too large for keys of id pairs")
        self.place: dict[str, int] = {}
        #: Per part: tokens of A and B, groups, pairs within groups, links; -1 tokens where bytes differ.
        self.numbers = np.zeros((0, 5), np.int64)
        self.keys, self.key_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups = np.zeros(0, object)

    def _keep(self, parts: list[str]) -> None:
        """Forget all but some parts."""
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        self.numbers, self.groups = self.numbers[at], self.groups[at]
        self.keys, counts = words.ragged(at, self.key_ends, self.keys)
        self.key_ends = np.r_[0, np.cumsum(counts)]
        self.place = dict(zip(parts, range(len(parts))))

    def tokens(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """A's and B's tokens of each part, and whether the bytes of both are the part's."""
        a, b = self.a.encode(parts), self.b.encode(parts)
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        sizes, whole = np.array([len(r) for r in raw]), b"".join(raw)
        same = np.ones(len(parts), bool)
        for side, lengths, found in ((self.a, self.a_lengths, a), (self.b, self.b_lengths, b)):
            flat, at = _joined(found)
            fits = np.diff(np.r_[0, np.cumsum(lengths[flat])][at]) == sizes
            if not fits.all() or b"".join([side.bytes[i] for i in flat.tolist()]) != whole:
                same &= [b"".join([side.bytes[i] for i in ids.tolist()]) == r for ids, r in zip(found, raw)]
        return a, b, same

    def _learn(self, parts: list[str]) -> None:
        a, b, same = self.tokens(parts)
        none = np.zeros(0, np.int32)
        a_ids, a_at = _joined([x if ok else none for x, ok in zip(a, same)])
        b_ids, b_at = _joined([x if ok else none for x, ok in zip(b, same)])
        aligned = Alignment(a_ids, b_ids, self.a_lengths, self.b_lengths)
        left, right, _ = aligned.links()
        links = np.searchsorted(left, a_at)  # a part's links are those of its tokens of A
        group_at = np.r_[aligned.a_group, aligned.groups][a_at]
        shared = np.r_[0, np.cumsum(aligned.shared_counts())][a_at]
        numbers = np.stack([np.diff(a_at), np.diff(b_at), np.diff(group_at), np.diff(shared), np.diff(links)], axis=1)
        numbers[~same, 0] = -1
        self.numbers = np.concatenate([self.numbers, numbers])
        self.keys = np.concatenate([self.keys, a_ids[left] * self.b.size + b_ids[right]])
        self.key_ends = np.r_[self.key_ends, self.key_ends[-1] + links[1:]]
        self.groups = np.concatenate([self.groups, np.array(self._listed(aligned, a_ids, b_ids, group_at), object)])
        for p in parts:
            self.place[p] = len(self.place)

    @staticmethod
    def _listed(aligned: Alignment, a_ids: np.ndarray, b_ids: np.ndarray, group_at: np.ndarray) -> list[str]:
        """The groups of each part as text: decimal ids of A and of B."""
        every = np.arange(aligned.groups + 1)
        a_cut = np.searchsorted(aligned.a_group, every).tolist()
        b_cut = np.searchsorted(aligned.b_group, every).tolist()
        a, b = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        listed = [
            f"{a[i] if j - i == 1 else ','.join(a[i:j])}|{b[k] if m - k == 1 else ','.join(b[k:m])}"
            for i, j, k, m in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])
        ]
        cut = group_at.tolist()
        return [";".join(listed[i:j]) for i, j in zip(cut, cut[1:])]

    def parts(self, distinct: list[str]) -> np.ndarray:
        """The places of distinct parts in what is known."""
        new = [p for p in distinct if p not in self.place]
        if len(self.place) + len(new) > CACHED:
            self._keep([p for p in distinct if p in self.place])
        begin = 0
        while begin < len(new):
            end, size = begin, 0
            while end < len(new) and (end == begin or size + len(new[end]) <= BLOCK):
                size, end = size + len(new[end]), end + 1
            self._learn(new[begin:end])
            begin = end
        return np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The parts of a blank and each text; none of null and empty texts."""
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
        led = pc.if_else(empty, "", pc.binary_join_element_wise(" ", texts, "", null_handling="replace"))
        # single blanks between other characters are cut at once, texts with others one by one
        odd = pc.match_substring_regex(led, rf"[{_SPACE}][{_SPACE}]|[{_SPACE}]$|[\x01\x1c-\x1f]")
        marked = pc.replace_substring(pc.utf8_slice_codeunits(pc.if_else(odd, "", led), 1), " ", "\x01 ")
        lists = words.split(pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(" ", marked, "")), "\x01")
        if not pc.any(odd).as_py() and not pc.any(empty).as_py():
            return lists
        whole = odd.to_pylist()
        return pa.array([
            _CUT.split(text) if text and is_odd else (found if text else [])
            for text, is_odd, found in zip(led.to_pylist(), whole, lists.to_pylist())
        ], pa.list_(pa.string()))

    def batch(self, texts: pa.Array):
        """Per text: tokens of A and of B, groups, pairs within groups, links, and the groups
        as text; and the distinct id pairs with the number of their links, with offsets."""
        offsets, codes, distinct = words.distinct_parts(self.cut(texts))
        place = self.parts(words.strings(distinct))[codes]
        n = len(texts)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        bad = np.bincount(doc, self.numbers[place, 0] < 0, n) > 0
        place, doc = place[~bad[doc]], doc[~bad[doc]]
        numbers = np.stack([
            np.bincount(doc, self.numbers[place, k], n) for k in range(5)
        ], axis=1).astype(np.int64)
        cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
        texts_of = self.groups[place]
        groups = [";".join(texts_of[i:j].tolist()) for i, j in zip(cut, cut[1:])]
        flat, counts = words.ragged(place, self.key_ends, self.keys)
        key = (np.repeat(doc, counts) << 40) | flat
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        times = np.diff(np.r_[first, len(key)])
        key = key[first]
        bounds = np.searchsorted(key >> 40, np.arange(n + 1))
        return numbers, groups, key & ((1 << 40) - 1), times, bounds


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """A Python worker's aligner, which keeps what it has met from one task to the next."""
    return Aligner(a_path, b_path)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_shared", "n_links"]


def _documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Numbers, digest of groups, and distinct id pairs with their links of each keyed document."""
    target = pa.schema([
        (ROW, pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _NUMBERS],
        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
    ])

    def run(batches):
        aligner = aligner_of(a_path, b_path)
        for batch in batches:
            numbers, groups, pairs, times, bounds = aligner.batch(batch.column(2))
            ends = pa.array(bounds, pa.int32())
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *[pa.array(column) for column in numbers.T.copy()],
                pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs)),
                pa.ListArray.from_arrays(ends, pa.array(times)),
            ], schema=target)

    kinds = ", ".join(f"{c} long" for c in _NUMBERS)
    return docs.mapInArrow(
        run, f"{ROW} long, doc_id long, {kinds}, groups_sha256 string, pairs array<long>, times array<long>"
    )


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """Of every id pair (pair = a · ``b_size`` + b) the number of documents that hold it linked,
    and whether no other pair of the same A id has more."""
    counted = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / b_size)))
    return counted.select("pair", "docs", (F.col("docs") == most).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of tokens, groups and links of every text, and how usual its links are.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is the one of its A id
    that most documents hold, ties included), count_sum (documents per link, summed up),
    n_shared (pairs of tokens within a group) and groups_sha256. Texts that are null, empty or not given back by both
    tokenizers have no tokens: zeros and an empty digest. Null or repeated ids and repeated rows
    have rows of their own, and count as documents of their own; other columns are ignored; an
    empty table gives none.
    """
    bounded_batches(df.sparkSession, "4m")
    docs = keyed(df, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    found = written(_documents(docs, a_path, b_path), "alignment")
    counts = written(pair_counts(found, Pieces(b_path).size), "alignment-pairs")
    if counts.count() <= MAX_BROADCAST:
        counts = F.broadcast(counts)
    usual = found.select(ROW, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times")))).join(
        counts, "pair"
    ).groupBy(ROW).agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return found.join(usual, ROW, "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "n_shared", "groups_sha256"
    )


def links(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", shared: bool = False,
) -> DataFrame:
    """A row for each link: doc_id, places and ids of both tokens, and the bytes they share.

    With ``shared`` a row for each pair of tokens in a group instead, zero bytes where they don't
    overlap; the rows of a group are the square of its tokens. Cases as in ``align``; texts
    without tokens have no links.
    """
    bounded_batches(df.sparkSession, "4m")
    names = ["doc_id", "a_place", "b_place", "a", "b", "bytes"]

    def run(batches):
        aligner = aligner_of(a_path, b_path)
        for batch in batches:
            for doc, parts in zip(batch.column(0).to_pylist(), aligner.cut(batch.column(1)).to_pylist()):
                a, b, same = aligner.tokens(parts)
                if not parts or not same.all():
                    continue
                a, b = _joined(a)[0], _joined(b)[0]
                aligned = Alignment(a, b, aligner.a_lengths, aligner.b_lengths)
                a_from, b_from = np.r_[0, aligned.a_ends][:-1], np.r_[0, aligned.b_ends][:-1]
                for left, right in aligned.shared() if shared else [aligned.links()[:2]]:
                    common = np.minimum(aligned.a_ends[left], aligned.b_ends[right]) - np.maximum(a_from[left], b_from[right])
                    columns = [left, right, a[left], b[right], np.maximum(common, 0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(left), pa.int64()), *map(pa.array, columns)], names
                    )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))

