"""Work on the distinct words of a batch of texts instead of on every word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def distinct_parts(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For lists of strings: the place where each list starts (and the end), a code
    for every string, and the distinct strings that the codes name."""
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets).astype(np.int64)
    coded = flat.dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def strings(array: pa.Array) -> list[str]:
    """All strings of an array at once, quicker than one by one."""
    return array.to_numpy(zero_copy_only=False).tolist()


def split(texts: pa.Array, separator: str) -> pa.ListArray:
    return pc.split_pattern(texts, separator)


def ragged(codes: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all codes in a row, and each code's number of values.

    Code c stands for values[offsets[c]:offsets[c + 1]].
    """
    counts = (offsets[1:] - offsets[:-1])[codes]
    ends = np.cumsum(counts)
    places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    places += np.repeat(offsets[:-1][codes] - (ends - counts), counts)
    return values[places], counts
