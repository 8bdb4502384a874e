"""Sparse 0-1 matrices in compressed rows, and their products row by row (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Products are made for blocks of rows with about so many terms.
TERMS = 1 << 20


class Csr(NamedTuple):
    """Row i has its ones in the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1


def intervals(ends: np.ndarray) -> Csr:
    """Rows that cover the columns from the end of the row before to their own end."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends].astype(np.int64), np.arange(total, dtype=np.int64), total)


def one_each(column: np.ndarray, columns: int) -> Csr:
    """Rows with a single one."""
    return Csr(np.arange(len(column) + 1, dtype=np.int64), column.astype(np.int64), columns)


def transposed(m: Csr) -> Csr:
    row = np.repeat(np.arange(m.rows, dtype=np.int64), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    return Csr(np.r_[0, np.cumsum(np.bincount(m.indices, minlength=m.columns))], row[order], m.rows)


def product(a: Csr, b: Csr, terms: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (row, column, value) of a · b, in order, for one block of a's rows after the other.

    Row i is the sum of b's rows in the places of a's row i. The terms of a block are
    listed, and equal places added up.
    """
    width = np.diff(b.indptr)
    cost = np.r_[0, np.cumsum(width[a.indices])][a.indptr]
    begin = 0
    while begin < a.rows:
        # at least one row, and as many as have so many terms together
        end = max(begin + 1, int(np.searchsorted(cost, cost[begin] + terms, side="right")) - 1)
        inner = a.indices[a.indptr[begin]:a.indptr[end]]
        counts = width[inner]
        row = np.repeat(np.arange(begin, end, dtype=np.int64), np.diff(cost[begin:end + 1]))
        place = np.arange(len(row), dtype=np.int64)
        place += np.repeat(b.indptr[inner] - (np.cumsum(counts) - counts), counts)
        key = row * b.columns + b.indices[place]
        if (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        key, value = key[first], np.diff(np.r_[first, len(key)])
        yield key // max(b.columns, 1), key % max(b.columns, 1), value
        begin = end


def times_vector(a: Csr, x: np.ndarray) -> np.ndarray:
    """a · x."""
    sums = np.r_[0, np.cumsum(x[a.indices])]
    return sums[a.indptr[1:]] - sums[a.indptr[:-1]]
