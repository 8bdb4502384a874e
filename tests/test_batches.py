"""Tags, switches and terms by Arrow batches against plain expressions, on rows made here."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codemix.functions import batches as B, sequences as S, tagging as G, text as T
from codemix.operators import features as X, parse as P
from codemix.session import written

ODD = [*" \t\x0b\x1c\x85  　aBzñéÑß0٣_.,!?¿¡;:'\"-<>|\x01\x02日", "el", "LA", " que ", "İ", "Σ", "́"]


def texts(n=600, seed=3):
    rng = random.Random(seed)
    return [None, "", " "] + ["".join(rng.choices(ODD, k=rng.randrange(30))) for _ in range(n)]


def by_expressions(prepared):
    """The rules as column expressions on every token."""
    def tag(raw):
        spanish = raw.rlike(f"[{G.SPANISH_LETTERS}]") | F.lower(raw).isin(G.SPANISH_WORDS)
        lang = (
            F.when(raw.startswith(G.IN_SEGMENT), "es").when(raw.isin(list(T.PUNCT)), "punct")
            .when(F.col("force").isNotNull(), F.col("force")).when(spanish, "es").otherwise("en")
        )
        return F.struct(F.replace(raw, F.lit(G.IN_SEGMENT), F.lit("")).alias("token"), lang.alias("lang"))
    return F.transform(G.split_tokens(prepared), tag)


def test_tags_of_batches_are_those_of_the_rules(spark):
    rng = random.Random(4)
    rows = [(t, rng.choice([None, "es", "en"])) for t in texts()]
    df = spark.createDataFrame(rows, "t string, force string").repartition(3)
    for r in df.select("t", G.tag_prepared(F.col("t"), F.col("force")).alias("found"), by_expressions(F.col("t")).alias("rule")).collect():
        assert r.found == r.rule, r.t


def test_long_batches_are_cut_in_parts(monkeypatch):
    rows = pa.array(texts(), pa.string())
    none, pattern = pa.nulls(len(rows), pa.string()), pa.array([G._TOKEN] * len(rows))
    whole = G._tagged(rows, none, pattern)
    monkeypatch.setattr(B, "BATCH_BYTES", 200)
    assert G._tagged(rows, none, pattern).equals(whole)


def test_tagging_is_no_expression_per_token(spark, small):
    from codemix.sources import views as V

    plan = V.utterances(spark, small).select("tagged_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_switches_of_batches(spark):
    rows = [(None,), ([],), (["en"],), (["en", "es", "es", "en"],), (["en", None, "en"],), ([],), (["es", "en"],)]
    df = spark.createDataFrame(rows, "l array<string>").coalesce(1)
    for r in df.select(S.switches(F.col("l")).alias("found"), S.changes(F.col("l")).alias("rule")).collect():
        assert r.found == r.rule


def test_terms_of_batches(spark):
    rows = [
        (1, 0, ["El", "a", "don't", "ÑO", "x"]), (1, 1, []), (1, 2, None), (1, 3, ["ab", None, "cd", "e"]),
        (1, 4, ["one", "one", "one", "one"]), (1, 5, ["-", "ab"]),
    ]
    df = spark.createDataFrame(rows, "conv_pos long, utt_idx int, tokens array<string>").coalesce(1)
    got = {r.utt_idx: None if r.terms is None else [tuple(t) for t in r.terms] for r in X.located_terms(df).collect()}
    assert got == {
        0: [(0, "el"), (2, "don"), (3, "ño"), (2, "el don"), (3, "don ño")], 1: [], 2: None, 3: None,
        4: [(0, "one"), (1, "one"), (2, "one"), (1, "one one"), (2, "one one")], 5: [],
    }


def test_split_stores_its_hash_as_a_number(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(4000)], "k long, label int")
    kept = written(X.hashed(rows, ["k"]), "kept")
    assert dict(kept.dtypes)[X.HASH] == "bigint"
    split = X.stratified_split(kept, ["k"]).withColumn("h", X.split_hash("k")).collect()
    for label in range(3):
        hashes = sorted(r.h for r in split if r.label == label)
        assert {r.h for r in split if r.label == label and r.is_test} == set(hashes[:round(0.2 * len(hashes))])


@pytest.mark.parametrize("name", ["append_union", "assign_ids"])
def test_answers_are_parsed_once(spark, small, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "CONVERSACI" not in plan.split("== Physical Plan ==")[1]


def test_enough_tokens_are_those_that_are_counted(spark):
    rng = random.Random(12)
    texts = [None, "", "a b c", "abc d.f", "a,b", "¿a", "\u0001casa \u0001la, x", "a\nb\nc", "a...", " - - a b-c"]
    texts += ["".join(rng.choice("ab.,!é-\u0001 \n日") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        wrong = rows.where(~G.has_tokens(F.col("t"), n).eqNullSafe(G.count_tokens(F.col("t")) >= n))
        assert wrong.count() == 0


def test_answers_are_parsed_once_for_their_numbers(spark, monkeypatch):
    """What is numbered is read from tables that the numbering has stored."""
    stored, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, purpose: stored.append(purpose) or write(df, purpose))
    answers = spark.range(40).select((F.col("id") % 7).alias("batch_id"), F.col("id").cast("int").alias("segment"), F.udf(lambda x: x, "long")("id").alias("x"))
    numbered = P.assign_conversation_ids(answers, spark.range(0).select(F.col("id").alias("conversation_id")))
    single = P.assign_response_ids(answers.withColumnRenamed("batch_id", "response_id"), spark.range(3).select(F.col("id").alias("conversation_id")))
    assert stored == ["dialogues", "answers", "answer-numbers"]
    assert "PythonUDF" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.conversation_id for r in numbered.collect()) == list(range(40))
    assert {(r.response_id, r.conversation_id) for r in single.collect()} == {(k, k + 3) for k in range(7)}
