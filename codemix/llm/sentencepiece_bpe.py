"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised (a blank put in front, blanks to U+2581) and cut where no
piece of the vocabulary reaches across: between a character and a following
blank mark, and between any two characters that stand side by side in no piece.
No merge can cross such a cut, so the parts are encoded on their own, each distinct
part of a batch once.

All parts lie in one flat array of symbols. In a round every part finds its
best pair, the one whose piece has the highest score, and merges its occurrences
from the left, all at once, up to the first whose merge brings forth a pair that
is to be merged before the others. Then the array is compacted; parts without a
mergeable pair leave it. A pair's rank is found by binary search in the sorted
array of all pairs of pieces that make a piece. Symbols that are no piece go over
to the pieces of their bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codemix.llm import words
from codemix.llm.common import bounded_batches

BLANK = "\u2581"
#: Encoded parts that a Python worker keeps.
CACHED = 200_000
_NONE = np.iinfo(np.int64).max
#: Parts of a batch are encoded in blocks of about so many characters.
_BLOCK = 1 << 20


class Model:
    """Pieces, scores and pair ranks of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(size)]
        special = [processor.is_control(i) or processor.is_unknown(i) for i in range(size)]
        byte = [processor.is_byte(i) for i in range(size)]
        normal = [i for i in range(size) if not special[i] and not byte[i]]
        self.unknown = processor.unk_id()
        self.texts = [p.replace(BLANK, " ") for p in pieces]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if byte[i]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Symbols: a piece's id, or size + code point for a character that is no piece.
        self.size = size
        self.id_of = {pieces[i]: i for i in normal}
        self.char_id = np.arange(0x110000, dtype=np.int64) + size
        for i in normal:
            if len(pieces[i]) == 1:
                self.char_id[ord(pieces[i])] = i
        # Rank: 0 for the highest score; pieces of equal score share one.
        scores = np.array([processor.get_score(i) for i in normal])
        rank = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist()))
        keys, made, inside = [], [], set()
        symbol = lambda s: self.id_of.get(s, size + ord(s) if len(s) == 1 else None)
        self.base = size + 0x110000
        for i in normal:
            piece = pieces[i]
            inside.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append((rank[i], i))
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array([r for r, _ in made], np.int64)[order]
        self.made = np.array([p for _, p in made], np.int64)[order]
        self.beside = np.array(sorted(ord(a) * 0x110000 + ord(b) for a, b in inside), np.int64)
        self.crosses_blank = any(b == BLANK and a != BLANK for a, b in inside)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or -1."""
        wanted = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, place, -1)

    def _rank(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.ranks[place], _NONE)

    def _merged(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of flat symbol arrays; ``part`` numbers each symbol's part, ascending."""
        # place: where the pair of a symbol and the next one is in the table, or -1
        place = np.r_[self._find(symbols[:-1], symbols[1:]), -1]
        place[np.r_[part[:-1] != part[1:], True]] = -1
        rank = self._rank(place)
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            lengths = np.diff(np.r_[starts, len(part)])
            best = np.minimum.reduceat(rank, starts)
            if best.max() == _NONE:
                keep = np.repeat(best < _NONE, lengths)
                done.append((symbols[~keep], part[~keep]))
                symbols, part, place, rank, best = symbols[keep], part[keep], place[keep], rank[keep], best[best < _NONE]
                if not len(symbols):
                    break
                lengths = lengths[lengths > 0] if len(best) == len(lengths) else np.diff(
                    np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                )
            taken = self._leftmost(symbols, part, place, np.flatnonzero(rank == np.repeat(best, lengths)))
            symbols[taken] = self.made[place[taken]]
            keep = np.ones(len(symbols), bool)
            keep[taken + 1] = False
            symbols, part, place, rank = symbols[keep], part[keep], place[keep], rank[keep]
            # only the pairs at the new symbols have changed
            at = taken - np.arange(len(taken))
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            following = np.minimum(changed + 1, len(symbols) - 1)
            found = self._find(symbols[changed], symbols[following])
            found[(changed == following) | (part[changed] != part[following])] = -1
            place[changed], rank[changed] = found, self._rank(found)
        symbols = np.concatenate([s for s, _ in done]) if done else symbols
        part = np.concatenate([p for _, p in done]) if done else part
        order = np.argsort(part, kind="stable")
        return symbols[order], part[order]

    def _leftmost(self, symbols: np.ndarray, part: np.ndarray, place: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """The pairs that merging one by one from the left would merge next, as far as
        no merge brings forth a pair that goes before the rest of them."""
        every = np.arange(len(hit))
        hit_part, piece = part[hit], self.made[place[hit]]
        first = np.r_[True, hit_part[1:] != hit_part[:-1]]
        begin = np.maximum.accumulate(np.where(first, every, 0))
        # of overlapping pairs every other one counts
        chain = np.r_[False, np.diff(hit) == 1] & ~first
        even = (every - np.maximum.accumulate(np.where(chain, 0, every))) % 2 == 0
        other = piece != piece[begin]
        candidate = every[even | other]
        at, new, other = hit[candidate], piece[candidate], other[candidate]
        left = np.where(at > 0, symbols[at - 1], -1)
        touching = np.r_[False, np.diff(at) == 2]
        left[touching] = new[np.flatnonzero(touching) - 1]
        left[(at > 0) & (part[at - 1] != part[at])] = -1
        after = np.minimum(at + 2, len(symbols) - 1)
        right = np.where((at + 2 < len(symbols)) & (part[after] == part[at]), symbols[after], -1)
        own = self.ranks[place[at]]
        better = (self._rank(self._find(left, new)) <= own) | (self._rank(self._find(new, right)) <= own)
        # stop behind the first merge that brings forth a better pair, and before another
        # piece of the same score; the first pair of a part is always merged
        stops = np.cumsum(better | other)
        stops_before = stops - (better | other)
        head = np.r_[True, part[at][1:] != part[at][:-1]]
        base = stops_before[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        return at[(stops_before == base) & ~other]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; a part is a piece of normalised text between two cuts."""
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if not len(points):
            return [[] for _ in parts]
        # a word is cut further where no piece holds both neighbours
        pair = points[:-1] * 0x110000 + points[1:]
        place = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cut = np.r_[True, (self.beside[place] != pair) | (part[1:] != part[:-1])]
        section = np.cumsum(cut) - 1
        owner = part[cut]
        symbols, section = self._merged(self.char_id[points], section)
        ids, of = self._bytes(symbols, owner[section])
        ends = np.searchsorted(of, np.arange(len(parts)), side="right")
        return [a.tolist() for a in np.split(ids, ends[:-1])]

    def _bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes, or the unknown one."""
        strange = np.flatnonzero(symbols >= self.size)
        if not len(strange):
            return symbols, owner
        spelled = []
        for s in symbols[strange].tolist():
            raw = chr(s - self.size).encode("utf-8", "surrogatepass")
            spelled.append([self.bytes[b] for b in raw] if self.bytes else [self.unknown])
        counts = np.ones(len(symbols), np.int64)
        counts[strange] = [len(s) for s in spelled]
        out = np.repeat(symbols, counts)
        begin = np.cumsum(counts) - counts
        for at, ids in zip(begin[strange].tolist(), spelled):
            out[at:at + len(ids)] = ids
        return out, np.repeat(owner, counts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces become characters, as far as they are valid."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.texts[i] for i in ids])
        raw = bytearray()
        for i in ids:
            raw += bytes([self.byte_of[i]]) if i in self.byte_of else self.texts[i].encode()
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes batches of texts; keeps the parts it has met, up to a bound."""

    def __init__(self, path: str):
        self.model = load(path)
        if self.model.crosses_blank:
            raise ValueError("the model's pieces reach across blanks")
        self.known: dict[str, tuple[int, str, str]] = {}

    def parts(self, distinct: list[str]) -> list[tuple[int, str, str]]:
        """Of each part the number of ids, the ids as text, and the decoded text."""
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known = {p: self.known[p] for p in distinct if p in self.known}
        begin = 0
        while begin < len(new):
            end, size = begin, 0
            while end < len(new) and (end == begin or size + len(new[end]) <= _BLOCK):
                size, end = size + len(new[end]), end + 1
            for p, ids in zip(new[begin:end], self.model.encode_parts(new[begin:end])):
                self.known[p] = len(ids), ",".join(map(str, ids)), self.model.decode(ids)
            begin = end
        return [self.known[p] for p in distinct]

    def batch(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Per text the number of ids, the ids joined by commas, and the decoded text."""
        marked = pc.replace_substring(pc.binary_join_element_wise(
            BLANK, texts, "", null_handling="replace"
        ), " ", BLANK)
        # A part ends where a blank mark follows another character.
        cut = pc.replace_substring_regex(marked, f"([^{BLANK}])({BLANK})", "\\1\x01\\2")
        plain = pc.invert(pc.match_substring(marked, "\x01"))
        lists = words.split(pc.if_else(plain, cut, ""), "\x01")
        offsets, codes, distinct = words.distinct_parts(lists)
        # a text that holds the mark by which parts are split is a part of its own
        whole = marked.filter(pc.invert(plain)).to_pylist()
        encoded = self.parts(distinct.to_pylist() + whole)
        whole = iter(encoded[len(distinct):])
        out = []
        for i, (empty, is_plain) in enumerate(zip(
            pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0).to_pylist(), plain.to_pylist()
        )):
            mine = [encoded[c] for c in codes[offsets[i]:offsets[i + 1]].tolist()] if is_plain else [next(whole)]
            if empty:
                out.append((0, "", ""))
                continue
            counts, ids, decoded = zip(*mine)
            # the blank that was put in front goes again
            out.append((sum(counts), ",".join(ids), "".join(decoded)[1:]))
        return out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)

    def encode(batches):
        encoder = Encoder(path)
        target = pa.schema(fields)
        for batch in batches:
            rows = [row(*r) for r in encoder.batch(batch.column(1))]
            columns = [batch.column(0), *[list(c) for c in zip(*rows)]] if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
            )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [tuple(part.split()) for part in schema.split(", ")]
    fields = [pa.field(name, kinds[kind]) for name, kind in fields]
    return source.mapInArrow(encode, schema)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text of every text, row by row.

    Null texts are empty: no ids and an empty decoding. Null or repeated ids and
    repeated rows give a row each, other columns are ignored, an empty table none.
    """
    return _encoded(df, path, id_col, text_col, lambda n, ids, text: (n, _sha(ids), _sha(text)), SCHEMA)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of every text; cases as in ``digest``."""
    schema = "doc_id long, ids array<int>, decoded string"
    return _encoded(
        df, path, id_col, text_col,
        lambda n, ids, text: ([int(i) for i in ids.split(",")] if ids else [], text), schema,
    )
