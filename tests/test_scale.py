"""Hot keys, order without a global sort, and the shape of the plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codemix.operators import ordering as O, stats as A
from codemix.sources import views as V


def plan_of(df):
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().toString()


def test_running_totals_over_far_keys(spark):
    rng = random.Random(1)
    keys = sorted({rng.randrange(2**45) for _ in range(300)} | {0, 1, 2**16, 2**16 - 1, 2**32, 2**32 + 1})
    rows = [(k, rng.randint(0, 9)) for k in keys]
    expected, total = {}, 0
    for k, v in rows:
        expected[k], total = total, total + v
    rng.shuffle(rows)
    got = O.running_totals(spark.createDataFrame(rows, "k long, v long"), "k", "v").collect()
    assert {r.k: r.before for r in got} == expected


def test_ids_are_dense_with_a_hot_conversation(spark):
    sizes = {0: 3, 1: 1, 5: 4000, 70000: 2, 70001: 1, 2**33: 5}
    rows = [(c, i) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "conv_pos long, utt_idx int")
    got = sorted((r.conv_pos, r.utt_idx, r.id) for r in O.with_dense_id(df).collect())
    assert [g[2] for g in got] == list(range(len(rows)))


def test_ranked_values_merge_ties_and_skip_nulls(spark):
    values = [0.1] * 50 + [0.10000000001, 0.5, 0.5, 0.99, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = O.ranked_values(df, "x", F.floor(F.col("x") * 2.0**32), {"rows": F.count("*")}).collect()
    assert {r.x: (r.n, r.before) for r in rows} == {
        0.1: (50, 0), 0.10000000001: (1, 50), 0.5: (2, 51), 0.99: (1, 53),
    }


def test_rank_test_against_all_pairs(spark):
    rng = random.Random(4)
    no = [rng.choice([1, 1, 1, 2, 7, 90000]) for _ in range(120)]
    yes = [rng.choice([1, 2, 3, 70000]) for _ in range(80)]
    df = spark.createDataFrame(
        [("no", x) for x in no] + [("yes", x) for x in yes], "has_code_switch string, token_count int"
    )
    u = sum((a > b) + 0.5 * (a == b) for a in no for b in yes)
    assert A.mann_whitney(df).first().u == u


@pytest.mark.parametrize("shares", [[10.0, 20.0, 40.0], [1.0, 2.0], [5.0], [3.0] * 7 + [4.0, 9.5]])
def test_median_over_ranked_values(spark, shares):
    import statistics

    df = spark.createDataFrame([(s,) for s in shares], "share double")
    size = spark.createDataFrame([(len(shares),)], "n long")
    row = O.median(df, "share", F.floor(F.col("share") * 1e6), F.count("*"), size, "m").first()
    assert row.m == statistics.median(shares)


def test_scan_reads_only_what_is_needed(spark, small):
    plan = plan_of(A.corpus_stats(V.utterances(spark, small)))
    assert re.search(r"ReadSchema: struct<text:string>", plan)
    assert "PushedFilters: [IsNotNull(text)" in plan or "IsNotNull(text)" in plan


def test_tagging_and_repair_do_not_shuffle(spark, small):
    from codemix.operators import repair as R

    docs = V.lines(spark, small)
    repaired = R.retag(R.clean_tags(R.repair_by_strategy(V.utterances(spark, small))))
    for df in (docs, repaired):
        exchanges = re.findall(r"Exchange (\w+)", plan_of(df).split("== Physical Plan ==")[1])
        # Only the spreading of a scan that has fewer tasks than cores.
        assert set(exchanges) <= {"RoundRobinPartitioning"}


def test_text_is_tagged_once_per_pass(spark, small):
    for name in (
        "corpus_stats", "cs_rate_true", "clean_tags_tokens", "turn_length_stats", "switch_labels",
        "flatten_tokens", "first_switch_hist", "export_flat", "retag_marks", "vocab_topk",
    ):
        plan = plan_of(entry.queries()[name](spark, small)).split("== Physical Plan ==")[1]
        assert plan.count("(?:[^\\t-\\r") == 1, name


def test_large_scans_are_not_spread(spark, small):
    from codemix.session import spread

    many = spark.range(0, 1000, 1, 3 * spark.sparkContext.defaultParallelism)
    assert "RoundRobin" not in plan_of(spread(many))
    assert "RoundRobin" in plan_of(spread(spark.range(0, 10, 1, 1)))


def test_no_pairing_of_rows(spark, small):
    """No product of two tables; only rows next to a one-row total."""
    for name in ("export_flat", "first_switch", "mann_whitney", "roc_auc", "assign_ids", "tfidf_norms"):
        plan = plan_of(entry.queries()[name](spark, small))
        assert "CartesianProduct" not in plan, name
