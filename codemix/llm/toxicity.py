"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features are the distinct n-grams of 3 to 5 characters of a lower-cased text, by
hash. Over the labelled rows each gets its log-count ratio r, how much more
often toxic texts hold it than others; the features whose ratio is most certain
are kept. A logistic regression is fitted on them with r as a feature's value, so
that a weight is only a correction of naive Bayes. The classifier is fitted on a
bounded sample of the labelled rows, ``max_training_rows`` drawn by a hash of their
ids; all texts are scored, wholly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm.common import bounded_batches, unsigned_hash

ORDERS = (3, 4, 5)
BITS = 20
DIMENSIONS = 1 << BITS
FEATURES = 8192
MAX_TRAINING_ROWS = 8_000
LEAST_COUNT = 3
_CHUNK = 1 << 18
_PART = 1 << 14


def grams(text: str | None):
    """Hashes of the text's character n-grams in blocks; repeats are not removed."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    for begin in range(0, len(points), _CHUNK):
        block = points[begin:begin + _CHUNK + max(ORDERS) - 1]
        code = np.zeros(len(block), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(block) < n:
                break
            code = code[:len(block) - n + 1] * np.uint32(0x01000193) + block[n - 1:]
            if n in ORDERS:
                mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                mixed = mixed ^ (mixed >> np.uint32(15))
                # a block ends where the next begins
                yield (mixed & np.uint32(DIMENSIONS - 1))[:_CHUNK]


@dataclass
class Classifier:
    """place: for each hash the number of its feature, or -1; weights: ratio times weight."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, text: str | None) -> np.ndarray:
        """The sorted numbers of the text's features."""
        seen = np.zeros(len(self.weights) + 1, bool)
        for block in grams(text):
            seen[self.place[block]] = True
        return np.flatnonzero(seen[:-1])

    def score(self, text: str | None) -> float:
        margin = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -700, 700))))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, most: int,
) -> DataFrame:
    """(doc_id, text, label) of at most about ``most`` labelled rows that are not held out.

    A document with several labels has the largest; null ids and labels count as none.
    """
    label = F.col(label_col).cast("int")
    ids = labels.where(F.col(label_id).isNotNull() & label.isin(0, 1) & ~held_out(F.col(label_id)))
    ids = ids.groupBy(F.col(label_id).alias("doc_id")).agg(F.max(label).alias("label"))
    rows = ids.count()
    if rows > most:
        ids = ids.where(unsigned_hash(F.struct("doc_id", F.lit("sample"))) < most / rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the ids are bounded by the sample's size, 12 bytes each
    return texts.join(F.broadcast(ids), "doc_id")


def _count_grams(batches):
    counts = np.zeros((2, DIMENSIONS), np.int32)
    rows = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            seen = np.zeros(DIMENSIONS, bool)
            for block in grams(text):
                seen[block] = True
            counts[label] += seen
            rows[label] += 1
    if sum(rows):
        parts = range(DIMENSIONS // _PART)
        cut = lambda label: [counts[label, p * _PART:(p + 1) * _PART].tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([
            pa.array(parts, pa.int32()), pa.array(cut(0), pa.binary()), pa.array(cut(1), pa.binary()),
            pa.array([rows[0]] * len(parts), pa.int64()), pa.array([rows[1]] * len(parts), pa.int64()),
        ], ["part", "clean", "toxic", "n_clean", "n_toxic"])


def _ratios(frame: pd.DataFrame) -> pd.DataFrame:
    """Log-count ratio of each feature of a part and its distance from 0 in standard errors."""
    q, p = (sum(np.frombuffer(b, np.int32).astype(np.int64) for b in frame[c]) for c in ("clean", "toxic"))
    n_q, n_p = int(frame["n_clean"].sum()), int(frame["n_toxic"].sum())
    ratio = np.log((p + 1) / (n_p + 2)) - np.log((q + 1) / (n_q + 2))
    error = np.sqrt(1 / (p + 1) + 1 / (q + 1))
    kept = np.flatnonzero(p + q >= LEAST_COUNT)
    return pd.DataFrame({
        "feature": int(frame["part"].iloc[0]) * _PART + kept, "ratio": ratio[kept],
        "certainty": np.abs(ratio / error)[kept], "n_clean": n_q, "n_toxic": n_p,
    })


def _logistic(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int, sparsity: float):
    """Weights and bias of a logistic regression on rows of feature numbers.

    Accelerated proximal gradient steps; the penalty on absolute weights sets those of
    features without use to zero, whose chance hits would add up in long texts.
    """
    n = len(rows)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    value = ratio[flat]
    forward = lambda w: np.bincount(owner, value * w[flat], n)
    backward = lambda e: np.bincount(flat, value * e[owner], len(ratio))
    direction = np.ones(len(ratio))
    for _ in range(12):  # the largest curvature bounds the step
        direction = backward(forward(direction / (np.linalg.norm(direction) or 1.0)))
    step = 1 / (0.25 * (1.1 * np.linalg.norm(direction) / n + 1))
    bias = shift = float(np.log(labels.mean() / (1 - labels.mean())))
    weights = momentum = np.zeros(len(ratio))
    for k in range(rounds):
        margin = forward(momentum) + shift
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) / n
        moved = momentum - step * backward(error)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
        new_bias = shift - step * error.sum()
        pull = k / (k + 3)
        momentum, shift = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, bias


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label_col: str = "toxic", max_training_rows: int = MAX_TRAINING_ROWS,
    features: int = FEATURES, rounds: int = 500, sparsity: float = 3e-4,
) -> Classifier:
    """Fit on labelled rows that are not held out. Without any row of one class every
    text gets the share of toxic rows, a little less than a half if there are no rows."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_id, label_col, max_training_rows)
    counted = rows.select("text", "label").mapInArrow(
        _count_grams, "part int, clean binary, toxic binary, n_clean long, n_toxic long"
    )
    ratios = counted.groupBy("part").applyInPandas(
        _ratios, "feature long, ratio double, certainty double, n_clean long, n_toxic long"
    )
    best = ratios.orderBy(F.desc("certainty"), "feature").limit(features).collect()
    n_clean, n_toxic = (best[0].n_clean, best[0].n_toxic) if best else (0, 0)
    bias = float(np.log((n_toxic + 0.5) / (n_clean + 1)))
    if not n_clean or not n_toxic:
        return Classifier(np.full(DIMENSIONS, -1, np.int16), np.zeros(0), bias)
    best.sort(key=lambda r: r.feature)
    place = np.full(DIMENSIONS, -1, np.int16)
    place[[r.feature for r in best]] = np.arange(len(best))
    ratio = np.array([r.ratio for r in best])
    selection = Classifier(place, np.zeros(len(best)), 0.0)

    @F.pandas_udf("binary")
    def chosen(texts: pd.Series) -> pd.Series:
        return pd.Series([selection.present(t).astype(np.int16).tobytes() for t in texts])

    # at most about max_training_rows rows of 2 bytes per feature present
    sparse = rows.select("doc_id", "label", chosen("text").alias("present")).collect()
    sparse.sort(key=lambda r: (r.doc_id, r.present))
    found = [np.frombuffer(r.present, np.int16).astype(np.int32) for r in sparse]
    weights, bias = _logistic(found, np.array([r.label for r in sparse]), ratio, rounds, sparsity)
    return Classifier(place, weights * ratio, float(bias))


def _scorer(model: Classifier):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts count as empty and get the score of no features but the blank's;
    null ids are not held out; repeated ids and rows get a row each; other columns
    are ignored; an empty table gives none.
    """
    bounded_batches(df.sparkSession)
    scored = df.select(F.col(id_col).alias("doc_id"), _scorer(model)(F.col(text_col)).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def remove_toxic(df: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns.

    Null and empty texts are scored like others, by the classifier's constant alone; repeated rows
    stay or go together, and an empty table stays empty.
    """
    bounded_batches(df.sparkSession)
    return df.where(_scorer(model)(F.col(text_col)) < 0.5)
