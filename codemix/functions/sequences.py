"""Expressions over the language sequence of one utterance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from codemix.functions import batches as B


def spoken(tagged: Column) -> Column:
    """Tokens with a language: English and Spanish, without punctuation."""
    return F.filter(tagged, lambda t: t["lang"].isin("en", "es"))


def changes(labels: Column) -> Column:
    """0/1 per pair of neighbours; an empty array below two labels."""
    n = F.size(labels)
    pairs = F.zip_with(
        F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: (a != b).cast("int"),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<int>"))


def _switches(labels: pa.Array) -> pa.Array:
    begin = B.starts(labels)
    number, found = B.distinct(labels.flatten())
    sizes = np.diff(begin)
    inside = np.ones(len(number), bool)
    inside[begin[1:][sizes > 0] - 1] = False  # the last of a list has no next one
    left = np.flatnonzero(inside)
    null = [i for i, label in enumerate(found) if label is None]
    unknown = np.isin(number[left], null) | np.isin(number[left + 1], null)
    changed = pa.array((number[left] != number[left + 1]).astype(np.int32), mask=unknown if null else None)
    return B.lists_of(changed, B.running(np.maximum(sizes - 1, 0)), np.zeros(len(labels), bool))


def switches(labels: Column) -> Column:
    """As :func:`changes`, by batches: for all pairs of a large table."""
    return F.arrow_udf(_switches, "array<int>")(labels)


def count_changes(labels: Column) -> Column:
    return F.size(F.array_remove(changes(labels), 0))


def first_change(labels: Column) -> Column:
    """1-based length of the first run; the number of labels when they never change."""
    at = F.array_position(changes(labels), 1)
    return F.when(at > 0, at).otherwise(F.size(labels)).cast("int")
