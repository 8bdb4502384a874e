"""Token ids of texts in Simple-8b files, and those files read back.

Documents are range-partitioned and sorted by id; a task encodes its documents
with the tokenizers library and writes them to files of bounded size, so that the
files in the order of their names hold all documents in the order of their ids. A file
is a sequence of blocks, each with the ids, null marks and token counts of its documents
and the Simple-8b words of their tokens, and a footer with the offset of every block. A
manifest has the number of tokens of each file.

The tokenizer's pattern never makes a token of both sides of a blank or line end between two other
characters, or of a letter and a following full stop or comma, so that texts are cut in front of
these (and behind line ends) and each distinct part of a batch is encoded once. Texts with the string of a special token, or with one of the few
characters that Python alone takes for white space, go to the library whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codemix.llm import simple8b, words
from codemix.llm.common import bounded_batches, written
from codemix.llm.files import committed
from codemix.session import shared_folder, tasks_for

END = 0
MAGIC = b"S8BTOK01"
#: A block is closed at so many tokens, a file at so many bytes.
BLOCK_TOKENS = 1 << 18
FILE_BYTES = 64 << 20
#: Encoded parts that a Python worker keeps, about 200 bytes each.
CACHED = 700_000
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Parts of a text with longer white space: of a run before a word, the pattern leaves its
#: last character, and if that is a blank the word takes it.
_PARTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes batches of texts with the byte-level BPE of a tokenizers file."""

    def __init__(self, path: str, library=None):
        import json

        self.library = library or _tokenizer(path)
        spec = json.loads(self.library.to_str())
        step = spec["pre_tokenizer"]
        if spec["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"]:
            raise ValueError("only byte-level tokenizers with the usual pattern are known here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        # a byte-level token has one character for each byte
        vocabulary = self.library.get_vocab()
        self.byte_lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.byte_lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known = {p: self.known[p] for p in parts if p in self.known}
        # words with a blank in front stay apart when they are joined
        joinable = [len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in new]
        words_ = [p for p, joins in zip(new, joinable) if joins]
        for begin in range(0, len(words_), 1 << 15):
            self._learn_words(words_[begin:begin + (1 << 15)])
        rest = [p for p, joins in zip(new, joinable) if not joins]
        for part, encoded in zip(rest, self.library.encode_batch(rest, add_special_tokens=False)):
            self.known[part] = array("i", encoded.ids).tobytes()

    def _learn_words(self, some: list[str]) -> None:
        """Encode many words as a few texts; a token's bytes tell where each word ends."""
        texts = ["".join(some[i:i + 256]) for i in range(0, len(some), 256)]
        encoded = self.library.encode_batch(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in encoded])
        reached = np.cumsum(self.byte_lengths[ids])
        ends = np.cumsum([len(p.encode()) for p in some])
        last = np.searchsorted(reached, ends)
        if last[-1] != len(ids) - 1 or (reached[last] != ends).any():
            raise ValueError("the tokenizer makes tokens across blanks")
        raw, at = ids.tobytes(), 0
        for part, end in zip(some, (4 * (last + 1)).tolist()):
            self.known[part], at = raw[at:end], end

    def _ids(self, parts: list[str]) -> list[bytes]:
        self._learn(parts)
        return [self.known[p] for p in parts]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for null texts."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, r"[\x1c-\x1f]")
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        odd = pc.or_(whole, pc.match_substring_regex(texts, rf"[{_SPACE}][{_SPACE}]|\x01"))
        marked = pc.replace_substring(pc.if_else(odd, "", texts), " ", "\x01 ")
        marked = pc.replace_substring(marked, "\n", "\x01\n\x01")
        lists = words.split(pc.replace_substring_regex(marked, r"([a-z])([.,])", "\\1\x01\\2"), "\x01")
        offsets, codes, distinct = words.distinct_parts(lists)
        found = self._ids(words.strings(distinct))
        ends = np.cumsum([0, *map(len, found)]) // 4
        flat, counts = words.ragged(codes, ends, np.frombuffer(b"".join(found), np.int32))
        bounds = np.r_[0, np.cumsum(counts)][offsets]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if whole[i].as_py():
                ids = self.library.encode(text, add_special_tokens=False).ids
            else:
                cut = _PARTS.findall(text)
                found = dict(zip(distinct := list(dict.fromkeys(cut)), self._ids(distinct)))
                ids = np.frombuffer(b"".join([found[p] for p in cut]), np.int32)
            out[i] = np.array(ids, np.int32)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A Python worker's encoder, which keeps what it has met from one task to the next."""
    return Encoder(path)


# ---- files ----------------------------------------------------------------

def pack_block(ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    coded, escaped = simple8b.encode(flat)
    return b"".join([
        struct.pack("<4Q", len(ids), len(flat), len(coded), len(escaped)),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
        np.array([len(t) for t in tokens], "<u8").tobytes(), coded.astype("<u8").tobytes(),
        escaped.astype("<u8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
    ])


def unpack_block(data: memoryview) -> tuple[list[int | None], list[np.ndarray]]:
    docs, n, coded, escaped = struct.unpack_from("<4Q", data)
    at = 32
    columns = []
    for kind, size in (("<i8", docs), ("<u8", docs), ("<u8", coded), ("<u8", escaped), ("u1", docs)):
        columns.append(np.frombuffer(data, kind, size, at))
        at += columns[-1].nbytes
    ids, lengths, coded, escaped, null = columns
    flat = simple8b.decode(coded, escaped, n)
    bounds = np.r_[0, np.cumsum(lengths.astype(np.int64))]
    tokens = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return [None if gone else i for i, gone in zip(ids.tolist(), null.tolist())], tokens


def blocks_of(data: bytes):
    """The blocks of a file by its footer."""
    view = memoryview(data)
    n, magic = struct.unpack("<Q8s", view[-16:])
    if magic != MAGIC or bytes(view[:8]) != MAGIC:
        raise ValueError("not a whole token file")
    offsets = np.frombuffer(view, "<u8", n, len(view) - 16 - 8 * n).tolist()
    for offset in offsets:
        yield unpack_block(view[offset:])


def _groups(batches, encoder: Encoder, end: int):
    """(ids, token arrays) of one block after the other."""
    ids, tokens, size = [], [], 0
    for batch in batches:
        for i, found in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1))):
            ids.append(i)
            tokens.append(np.r_[found, end])
            size += len(found) + 1
            if size >= BLOCK_TOKENS:
                yield ids, tokens
                ids, tokens, size = [], [], 0
    if ids:
        yield ids, tokens


def write(
    df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
) -> DataFrame:
    """Write the tokens of all texts, ``end`` behind each, in the order of the ids.

    Returns the manifest: file, n_docs, n_tokens, and the tokens before the file. Null
    texts are empty; null ids come first; rows that share an id all stay, in the order of
    a hash of their texts; an empty table has no files.
    """
    bounded_batches(df.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange(tasks_for(source), *order).sortWithinPartitions(*order)

    def write_files(batches):
        encoder = encoder_of(path)
        groups = _groups(batches, encoder, end)
        group, number, task = next(groups, None), 0, TaskContext.get().partitionId()
        while group:
            name = f"part-{task:06d}-{number:04d}.s8b"
            offsets, docs, total = [], 0, 0
            with committed(folder, name) as stream:
                at = stream.write(MAGIC)
                while group and at < FILE_BYTES:
                    offsets.append(at)
                    docs, total = docs + len(group[0]), total + sum(map(len, group[1]))
                    at += stream.write(pack_block(*group))
                    group = next(groups, None)
                stream.write(np.array(offsets, "<u8").tobytes() + struct.pack("<Q8s", len(offsets), MAGIC))
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [docs], "n_tokens": [total]})

    manifest = written(ordered.mapInArrow(write_files, "file string, n_docs long, n_tokens long"), "tokens-manifest")
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(batches):
    """file, doc_id, at, n_tokens, ids_crc32 of the documents of whole files."""
    encoder_of.cache_clear()  # a worker that has written files needs its parts no more
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            at = 0
            for ids, tokens in blocks_of(data.as_buffer()):
                lengths = np.array([len(t) for t in tokens], np.int64)
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(starts),
                    pa.array(lengths), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                ], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, and ids_crc32 of the ids as
    little-endian unsigned 32-bit integers, from the files."""
    bounded_batches(spark)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)

    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(
        read_files, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(manifest.select("file", "before"), "file").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(df: DataFrame, path: str, **columns) -> DataFrame:
    """Write the table's tokens to the shared folder and read them back."""
    folder = shared_folder(df.sparkSession, "tokens")
    return read(df.sparkSession, folder, write(df, folder, path, **columns))
