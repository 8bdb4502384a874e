"""Tries of equally long sequences as double arrays, walked from all positions of a text at once."""

from __future__ import annotations

import numpy as np

_ROUNDS = 8


class DoubleArray:
    """A trie of the rows of a matrix of symbols (1 to ``symbols``; 0 is no symbol).

    The child of state s by symbol c is base[s] + c if check there names s. The root's
    children are the symbols themselves. ``value`` has the row that a last state stands for.
    """

    def __init__(self, rows: np.ndarray, symbols: int):
        rows = np.asarray(rows, np.int64)
        self.length = rows.shape[1]
        size = symbols + 2
        self._size = size
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        self._draw = np.random.default_rng(len(rows))
        state = rows[:, 0] if len(rows) else np.zeros(0, np.int64)
        self.check[state] = 0
        new = np.r_[True, state[1:] != state[:-1]] if len(rows) else np.zeros(0, bool)
        for depth in range(1, self.length):
            # the distinct prefixes of one symbol more, and the state each comes from
            new = new | np.r_[True, rows[1:, depth] != rows[:-1, depth]] if len(rows) else new
            first = np.flatnonzero(new)
            child = self._place(state[first], rows[first, depth])
            state = child[np.cumsum(new) - 1]
        self.value = np.full(len(self.check), -1, np.int32)
        self.value[state] = order
        # a step from any state by any symbol stays inside
        pad = int(self.base.max(initial=0)) + size + 1 - len(self.check)
        if pad > 0:
            self.base, self.check, self.value = (
                np.r_[a, np.full(pad, fill, np.int32)] for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1))
            )

    def _grow(self, by: int) -> None:
        if len(self.check) + by > np.iinfo(np.int32).max - self._size:
            raise ValueError("too many sequences for one trie")
        self.base = np.r_[self.base, np.zeros(by, np.int32)]
        self.check = np.r_[self.check, np.full(by, -1, np.int32)]

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States for children, which lie parent by parent. Large families come first; all
        families of a size propose places at once, and those that meet nobody stay there."""
        if not len(parent):
            return parent
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        sizes = np.diff(np.r_[starts, len(parent)])
        child = np.zeros(len(parent), np.int64)
        classes = np.floor(np.log2(sizes)).astype(np.int64)
        self._grow(2 * len(parent) + self._size)
        for c in np.unique(classes)[::-1]:
            left, tries = np.flatnonzero(classes == c), 0
            while len(left):
                if tries == _ROUNDS:
                    self._grow(int(2 * sizes[left].sum()) + self._size)
                    tries = 0
                tries += 1
                base = self._draw.integers(0, len(self.check) - self._size, len(left))
                n = sizes[left]
                owner = np.repeat(np.arange(len(left)), n)
                mine = np.arange(len(owner)) + np.repeat(starts[left] - (np.cumsum(n) - n), n)
                slot = base[owner] + symbol[mine]
                taken = self.check[slot] >= 0
                once = np.zeros(len(slot), bool)
                once[np.unique(slot, return_index=True)[1]] = True
                good = np.ones(len(left), bool)
                good[owner[taken | ~once]] = False
                ok = good[owner]
                self.check[slot[ok]], child[mine[ok]] = parent[mine[ok]], slot[ok]
                self.base[parent[starts[left[good]]]] = base[good]
                left = left[~good]
        return child

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of a text of symbols from which a row occurs, and which row."""
        text = np.r_[text, np.zeros(self.length, text.dtype)]
        at = np.flatnonzero(self.check[text] == 0)
        state = text[at]
        for _ in range(1, self.length):
            at = at + 1
            following = self.base[state] + text[at]
            alive = self.check[following] == state
            at, state = at[alive], following[alive]
        return at - (self.length - 1), self.value[state]

    def count(self, text: np.ndarray, rows: int) -> np.ndarray:
        """How often each row occurs."""
        return np.bincount(self.occurrences(text)[1], minlength=rows)
