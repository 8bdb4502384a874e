"""Empty input, missing values, texts of odd characters."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codemix.functions import tagging as G, text as T
from codemix.operators import export as E, features as X, metrics as M, parse as P, repair as R, stats as A
from codemix.sources import dataset as D, views as V


@pytest.fixture(scope="module")
def nothing(spark, small):
    return spark.createDataFrame([], V.utterances(spark, small).schema)


STATS = [
    A.cs_rate_flag, A.cs_rate_true, A.corpus_stats, A.lang_token_share, A.switch_types,
    A.length_stats, A.cs_only_stats, A.final_split, A.topup_needed, R.metadata_recount,
    R.clean_report,
]


@pytest.mark.parametrize("operator", STATS, ids=lambda f: f.__name__)
def test_summaries_of_nothing(nothing, operator):
    rows = operator(nothing).collect()
    assert len(rows) == 1


ROWS = [
    A.conversation_summary, R.repair_by_strategy, R.clean_tags, R.retag, E.export_flat,
    D.flatten_tokens, D.nest, X.switch_examples, lambda u: X.vocabulary(X.term_events(X.switch_examples(u))),
    lambda u: A.first_switches(E.export_flat(u)), lambda u: A.turn_length_box(A.turn_lengths(E.export_flat(u))),
    lambda u: A.first_switch_hist(A.first_switches(E.export_flat(u))),
    lambda u: X.stratified_split(X.switch_pairs(X.switch_examples(u)), ["conv_pos", "utt_idx", "i"]),
]


@pytest.mark.parametrize("operator", ROWS)
def test_rows_of_nothing(nothing, operator):
    assert operator(nothing).count() == 0


def test_tests_of_nothing(spark, nothing):
    row = A.mann_whitney(A.turn_lengths(E.export_flat(nothing))).first()
    assert row.p_value is None
    none = spark.createDataFrame([], "label int, score double, prediction int")
    assert M.roc_auc(none).first().auc is None
    assert M.classification_report(none).count() == 5


def test_rank_sums_of_billions_of_rows(spark):
    ranked = spark.createDataFrame(
        [(4 * 10**9, 0, 4 * 10**9, 0), (0, 4 * 10**9, 4 * 10**9, 4 * 10**9)],
        "n_no long, n_yes long, n long, before long",
    )
    row = A.rank_test(ranked).first()
    assert row.u == 0 and row.z > 1e4 and row.p_value == 0.0


def test_keys_of_scores_never_decrease(spark):
    import random

    rng = random.Random(1)
    scores = sorted([0.0, 5e-324, 1e-320, 1.0] + [rng.random() * 10.0 ** -rng.randint(0, 320) for _ in range(3000)])
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, score double")
    keys = [r.k for r in rows.select("i", M.score_key(F.col("score")).alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) and len(set(keys)) > 2900


def test_rank_test_of_equal_lengths(spark):
    df = spark.createDataFrame([("no", 4), ("no", 4), ("yes", 4)], "has_code_switch string, token_count int")
    row = A.mann_whitney(df).first()
    assert row.u == 1.0 and row.sigma == 0.0 and row.z is None


def test_missing_fields(spark, nothing):
    u = spark.createDataFrame([(0, 0), (0, 1)], "conv_pos long, utt_idx int")
    for f in nothing.schema:
        if f.name not in u.columns:
            u = u.withColumn(f.name, F.lit(None).cast(f.dataType))
    assert R.retag_by_marks(u).filter("modified").count() == 0
    assert A.cs_rate_flag(u).first().cs_rate == 0.0
    assert E.export_flat(u).filter("has_code_switch = 'no' and spanish_percentage = '0.0'").count() == 2


def test_no_answer_holds_a_dialogue(spark):
    df = spark.createDataFrame(
        [(1, "s", "t", ""), (2, "s", "t", "\n\n:\n"), (3, "s", "t", None)],
        "response_id long, strategy string, topic string, raw_text string",
    )
    assert P.parse_responses(df).count() == 0
    assert P.speaker_map(df).count() == 0


SPACES = " \t\x0b\x0c\x1c\x85\u00a0\u2003\u3000"
ALPHABET = st.sampled_from(list("aBñé0_.,!?¿¡;:'\"-<>/|[]{}*$\\") + list(SPACES) + ["<ES>", "</ES>", "[7]"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=40))
def test_tokens_against_word_by_word_rules(spark, texts):
    """Without marks, joined tokens are the text minus white space and odd edge characters."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", G.tag(F.col("t"), F.lit("en")).alias("tt"), T.words(F.col("t")).alias("words"),
        G.clean_text(F.col("t")).alias("clean"),
    ).collect()
    for r in rows:
        assert r.words == r.t.split()
        assert r.clean == " ".join(r.clean.split())
        text = re.sub(r"\[\d+\]", "", r.t)
        for token, lang in r.tt:
            assert token and not any(c.isspace() for c in token)
            if lang == "punct":
                assert token in ".,!?;:¿¡"
            else:
                assert (token[0].isalnum() or token[0] == "_") and (token[-1].isalnum() or token[-1] == "_")
        cores = [t for t, lang in r.tt if lang != "punct"]
        has_word = [w for w in text.split() if any(c.isalnum() or c == "_" for c in w)]
        assert len(cores) == len(has_word)
        assert all(core in word for core, word in zip(cores, has_word))
        assert sum(c in ".,!?;:¿¡" for c in text) >= len(r.tt) - len(cores)
