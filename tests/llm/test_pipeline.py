"""The pipeline against the stages' plain versions in a row, and cases of its input."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from codemix.llm import common, pii, toxicity
from test_decontam import plain as plain_decontamination
from test_simhash import least_reachable, plain_fingerprint

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def make(spark, folder, rows, labels, items, docs):
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def cases():
    rng = random.Random(11)
    syllables = ["ba", "do", "ki", "lu", "me", "na", "po", "ra", "su", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [word() for _ in range(rng.choice([8, 40, 120]))], rng.random() < 0.2
        if toxic:
            words[3:3] = ["grumf", "zzyx", "vlort"]
        elif rng.random() < 0.15:
            words[5:5] = rng.choice(items)[1].split()
        elif rng.random() < 0.2:
            words[4:4] = [rng.choice(["a.b@c.de", "+1 (743) 555-3824", "john at example dot com", "10.0.0.1"])]
        elif rows and rng.random() < 0.2:
            words = rng.choice(rows)[1].split(" ")
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows + [(1000, None), (1001, ""), (None, "no id here"), (1002, "long " * 30_000), (3, rows[3][1])], labels, items


def test_equals_the_plain_versions_in_a_row(spark, docs, tmp_path):
    rows, labels, items = cases()
    folder = make(spark, tmp_path, rows, labels, items, docs)
    got = corpus_pipeline.run(spark, folder).collect()

    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in rows if model.score(r[1]) < 0.5]
    assert 30 < len(rows) - len(left) < 150
    values = [(i, plain_fingerprint(t)) for i, t in left]
    heads, kept = set(), []
    for (i, t), head in sorted(zip(left, least_reachable(values, 2)), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if i == head and head not in heads:
            heads.add(head)
            kept.append((i, t))
    assert len(kept) < len(left) - 10
    clean = [r for r, verdict in zip(kept, plain_decontamination(kept, items)) if not verdict[-1]]
    assert len(clean) < len(kept) - 5
    expected = []
    for i, text in clean:
        ids = LIBRARY.encode(pii.redacted(text) or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        expected.append((i, len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_stages_keep_the_columns_and_personal_data_goes(spark, docs, tmp_path):
    rows, labels, items = cases()
    folder = make(spark, tmp_path, rows[:60], labels[:60], items, docs)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns, name
    for r in corpus_pipeline.without_personal_data(spark, table, folder).collect():
        assert pii.all_spans(r.text) == ([], []) and r.n_chars == (None if r.text is None else len(r.text))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_columns_named_like_a_key_stay(spark, docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST", most)
    rows, labels, items = cases()
    folder = make(spark, tmp_path, rows[:60], labels[:60], items, docs)
    table = spark.read.parquet(f"{folder}/documents.parquet").withColumns({
        "__row": F.crc32(F.col("text").cast("binary")), "__ROW_": F.col("n_chars"), "gone": F.lit("g"), "a.b": F.lit(3)
    }).drop("score")
    rest = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, folder)
        assert kept.columns == table.columns, name
        odd = ["__row", "__ROW_", "gone"]
        if name != "personal data":
            assert kept.select("doc_id", *odd).exceptAll(table.select("doc_id", *odd)).isEmpty() and 0 < kept.count() < rest


def test_an_empty_table(spark, docs, tmp_path):
    folder = make(spark, tmp_path, [], [], [], docs)
    assert corpus_pipeline.run(spark, folder).collect() == []
