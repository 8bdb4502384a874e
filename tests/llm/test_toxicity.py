"""Held-out accuracy, whole texts, and the features against a plain computation."""

import random
import zlib

import numpy as np

from codemix.llm import toxicity as T
from codemix.llm.common import table


def plain_grams(text):
    flat = " " + " ".join((text or "").lower().split()) + " "
    found = set()
    for n in T.ORDERS:
        for i in range(len(flat) - n + 1):
            code = 0
            for c in flat[i:i + n]:
                code = (code * 0x01000193 + ord(c)) & 0xFFFFFFFF
            mixed = ((code ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            found.add((mixed ^ (mixed >> 15)) & (T.DIMENSIONS - 1))
    return found


def test_grams_of_whole_texts(monkeypatch):
    monkeypatch.setattr(T, "_CHUNK", 7)
    for text in ["", None, "a", "Ab", "abc É日本😀\n x", "word " * 30]:
        got = set(np.concatenate([*T.grams(text), np.zeros(0, np.uint32)]).tolist())
        assert got == plain_grams(text)


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_learns_from_the_rows_that_are_not_held_out(docs, spark):
    rng = random.Random(8)
    syllables = ["ba", "do", "ki", "lu", "me", "na", "po", "ra", "su", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(rng.choice([5, 50, 600]))], rng.random() < 0.2
        if toxic:
            for w in rng.sample(["grumf", "zzyx", "vlort", "qwetch"], 2):
                words.insert(rng.randrange(len(words) + 1), w)
        rows.append((i, " ".join(words)))
        # labels of held-out rows are the wrong way round, so learning them would show
        labels.append((i, int(toxic) if not held(i) else 1 - int(toxic)))
    labels += [(5000, 1), (None, 1), (1, None)]
    label_rows = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text", "0 as score")
    rows += [(9000, None), (9001, ""), (None, "grumf vlort"), (0, rows[0][1]), (9002, "bado " * 20_000 + " grumf zzyx vlort")]
    model = T.fit(docs(rows), label_rows)
    got = T.score(docs(rows), model).collect()
    assert len(got) == len(rows)
    truth = {i: l if not held(i) else 1 - l for i, l in labels if i is not None and l is not None}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out) and len(out) > 100
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by_id[9000].score == by_id[9001].score and by_id[9000].predicted == 0
    assert by_id[9002].predicted == 1
    assert not by_id[None].held_out and all(r.held_out == held(r.doc_id) for r in got if r.doc_id is not None)
    for i in (3, 9002):
        text = dict(rows)[i]
        places = {int(model.place[g]) for g in plain_grams(text)} - {-1}
        margin = model.bias + sum(model.weights[p] for p in places)
        assert abs(by_id[i].score - 1 / (1 + np.exp(-margin))) < 1e-9
    kept = T.remove_toxic(docs(rows), model)
    assert kept.columns == docs([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    again = T.fit(docs(rows), label_rows)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_without_rows_of_both_classes(docs, spark):
    for labels in ([], [(1, 0)], [(1, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = T.fit(docs([(1, "a"), (2, None)]), frame)
        scores = {r.score for r in T.score(docs([(1, "a"), (2, None)]), model).collect()}
        assert len(scores) == 1
        if not labels:
            assert scores.pop() < 0.5
    assert T.score(docs([]), model).collect() == []


def test_the_bound_of_training_rows(docs, spark):
    rows = [(i, "x") for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    n = T.training_rows(docs(rows), labels, "doc_id", "text", "doc_id", "toxic", 300).count()
    assert 200 < n < 400


def test_held_out_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    labelled = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    rows = T.score(labelled, T.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.75 * sum(r.toxic for r in rows) and hits >= 0.9 * sum(r.predicted for r in rows)
