"""Work on whole Arrow batches of texts and lists.

What depends on a value alone is done once per distinct value of a batch and gathered
from there: texts repeat their words, so a batch has far fewer of them than places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20  # longer batches are worked on in parts, which stay in the processor's caches


def starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in all of them, and the end."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0]


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, one after the other, and where each text begins, with the end."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    begin = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[begin[0]:begin[-1]], begin - begin[0]


def cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.StringArray:
    """The pieces of UTF-8 that begin at `start`."""
    begin = running(length)
    taken = data[np.repeat(start - begin[:-1], length) + np.arange(begin[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(taken))


def running(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def distinct(values: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """The number of each value, and the distinct ones. Bytes that are no UTF-8 are replaced."""
    coded = values.dictionary_encode(null_encoding="encode")
    found = coded.dictionary.cast(pa.binary()).to_pylist()
    return coded.indices.to_numpy(), [v if v is None else v.decode("utf-8", "replace") for v in found]


def places(counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of the results of `numbers`, one after the other, where number k has counts[k] of all."""
    n = counts[numbers]
    return np.repeat(running(counts)[numbers] - running(n)[:-1], n) + np.arange(n.sum())


def lists_of(values: pa.Array, begin: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    """Lists that begin at `begin`, which has the end too; NULL where `missing`."""
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values, mask=mask)


def missing(values: pa.Array) -> np.ndarray:
    return values.is_null().to_numpy(zero_copy_only=False)


def in_parts(work, *columns: pa.Array) -> pa.Array:
    """`work` on the columns of a batch, in parts of about BATCH_BYTES."""
    rows = len(columns[0])
    step = max(1, rows * BATCH_BYTES // max(BATCH_BYTES, sum(c.nbytes for c in columns)))
    if step >= rows:
        return work(*columns)
    return pa.concat_arrays([work(*[c.slice(i, step) for c in columns]) for i in range(0, rows, step)])
