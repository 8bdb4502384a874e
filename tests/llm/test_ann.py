"""Neighbours against brute force: recall, exact scores, ties, unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemix.llm import ann, queries
from codemix.llm.common import table


def brute(rows, asked, k):
    """(query, rank) to (vec_id, score) of all usable vectors."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in [i for i in usable if asked(i)]:
        scores = [
            (-float(usable[q] @ v / (np.sqrt(usable[q] @ usable[q]) * np.sqrt(v @ v))), i)
            for i, v in usable.items() if i != q and len(v) == len(usable[q])
        ]
        # equal up to rounding counts as equal, so that the smaller id goes first
        scores.sort(key=lambda s: (round(s[0], 12), s[1]))
        out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores[:k])})
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, ids string")


def compare(got, expected):
    """The share of neighbours found; scores must be right for all that are returned."""
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert found.keys() == expected.keys() and len(found) == len(got)
    queries_ = {q for q, _ in found}
    right = 0
    for q in queries_:
        ours = {v[0] for (a, _), v in found.items() if a == q}
        theirs = {v[0] for (a, _), v in expected.items() if a == q}
        right += len(ours & theirs)
        scores = [found[q, r][1] for r in range(1, len(ours) + 1)]
        assert all(a >= b - 1e-12 for a, b in zip(scores, scores[1:]))
    return right / max(1, len(found)), found


@pytest.mark.parametrize("shard", [8192, 150])
def test_recall(spark, shard):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(int(i), (centres[i % 20] + rng.normal(size=16) * (0.3 if i % 2 else 2)).tolist()) for i in range(1500)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got = ann.nearest(make(spark, rows), F.col("vec_id") % 10 == 0, 5, shard_size=shard).collect()
    expected = brute(rows, lambda i: i % 10 == 0, 5)
    recall, found = compare(got, expected)
    assert recall >= 0.95
    by_id = {i: np.array(v, np.float64) for i, v in rows}
    for (q, _), (i, score) in found.items():
        a, b = by_id[q], by_id[i]
        assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_ties_repeats_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 300)]  # a third of all rows
    rows += [(i, np.float32(rng.normal(size=3)).tolist()) for i in range(40)]
    rows += [(400, [2.0, 0.0]), (410, [1.0, 1.0]), (420, [5.0])]  # few of their length
    rows += [(500, None), (510, []), (520, [0.0, 0.0, 0.0]), (530, [float("nan"), 1.0, 2.0]), (540, [float("inf"), 1.0, 0.0])]
    rows += [(550, [None, 1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (10, rows[210][1])]
    got = ann.nearest(make(spark, rows), F.col("vec_id") % 10 == 0).collect()
    recall, _ = compare(got, brute(rows, lambda i: i % 10 == 0, 5))
    assert recall == 1


def test_few_rows(spark):
    assert ann.nearest(make(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert ann.nearest(make(spark, [(2, [1.0])]), F.col("vec_id") % 2 == 0).collect() == []
    got = ann.nearest(make(spark, [(2, [1.0, 0.0]), (4, [0.0, 2.0]), (5, [1.0, 1.0])]), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(2, 1, 5), (2, 2, 4), (4, 1, 5), (4, 2, 2)]


def test_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    recall, _ = compare(queries.QUERIES["op3_nearest"](spark, folder).collect(), brute(rows, lambda i: i % 50 == 0, 5))
    assert recall >= 0.95
