"""Cases worked out by hand from the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codemix.functions import sequences as S, tagging as G
from codemix.operators import export as E, parse as P, repair as R, stats as A
from codemix.operators.tagging import with_profile


def tagged(spark, text, force=None):
    row = spark.createDataFrame([(text,)], "t string").select(
        G.tag(F.col("t"), None if force is None else F.lit(force)).alias("tt")
    ).first()
    return " ".join(f"{t.token}/{t.lang}" for t in row.tt)


def utterance(spark, original, strategy="free_generation", text=None):
    df = spark.createDataFrame(
        [(0, 0, original, text, strategy)],
        "conv_pos long, utt_idx int, original_text string, text string, strategy string",
    ).withColumn("tagged_tokens", G.tag(F.col("original_text")))
    df = df.withColumn("text", F.coalesce("text", G.clean_text(F.col("original_text"))))
    return with_profile(df)


def shown(row):
    return " ".join(f"{t.token}/{t.lang}" for t in row.tagged_tokens)


@pytest.mark.parametrize("text, expected", [
    ("Sounds good, <ES>gracias</ES> for picking that up.",
     "Sounds/en good/en ,/punct gracias/es for/en picking/en that/en up/en ./punct"),
    ("¿Cómo estás?", "¿/punct Cómo/es estás/es ?/punct"),
    ("<ES> hola </ES> friend ok", "ES/en hola/en ES/en friend/en ok/en"),
    ("foo<ES>bar baz?</ES>. El día (ok)",
     "foo/en bar/es baz?/es ./punct El/es día/es ok/en"),
    ("<ES></ES> one two three", "one/en two/en three/en"),
    ("<ES>a </ES> b <ES>c</ES>", "ES>a/en ES/en b/en c/es"),
    ("one [12] two", "one/en two/en"),
    ("Él está \"aquí\" — no, foo's!?", "Él/en está/es aquí/es no/en ,/punct foo's/en !/punct ?/punct"),
    ("", ""),
    ("  a b\t¿¡", "a/en b/en ¿/punct ¡/punct"),
    ("x\u0001y <ES>dos\u0002 tres</ES>", "xy/en dos/es tres/es"),
])
def test_mixed_tags(spark, text, expected):
    assert tagged(spark, text) == expected


@pytest.mark.parametrize("text, force, expected", [
    ("Tomorrow, sí.", "es", "Tomorrow/es ,/punct sí/es ./punct"),
    ("<ES>hola</ES> you", "en", "ES>hola</ES/en you/en"),
])
def test_forced_tags(spark, text, force, expected):
    assert tagged(spark, text, force) == expected


def test_profile_of_mixed(spark):
    row = utterance(spark, "Sounds good, <ES>gracias</ES> for picking that up.").first()
    assert row.tokens == 7 and row.has_code_switch == "yes"
    assert row.spanish_percentage == pytest.approx(100 / 7)
    assert row.pos_tags == ["NN", "NN", ",", "NN", "NN", "NN", "NN", "NN", "."]


def test_profile_of_one_language(spark):
    row = utterance(spark, "¿Cómo estás?").first()
    assert (row.tokens, row.spanish_percentage, row.has_code_switch) == (2, 100.0, "no")
    row = utterance(spark, "... !").first()
    assert (row.tokens, row.spanish_percentage, row.has_code_switch) == (0, 0.0, "no")


def test_switches_of_mixed(spark):
    labels = G.langs(S.spoken(F.col("tagged_tokens")))
    row = utterance(spark, "Sounds good, <ES>gracias</ES> for picking that up.").select(
        S.changes(labels).alias("c"), S.first_change(labels).alias("f"),
        S.count_changes(labels).alias("n"),
    ).first()
    assert (row.c, row.f, row.n) == ([0, 1, 1, 0, 0, 0], 2, 2)


@pytest.mark.parametrize("tags, first", [
    ("EN|EN|ES", 2), ("ES|ES", 2), ("ES", 1), ("ES|EN|ES", 1), ("", 1),
])
def test_first_switch(spark, tags, first):
    df = spark.createDataFrame([(1, tags, "yes")], "id long, pos_tags string, has_code_switch string")
    assert A.first_switches(df).first().switch_point == first


def test_repair_chain(spark):
    u = utterance(spark, "<ES> hola </ES> friend ok")
    cleaned = R.clean_tags(u)
    row = cleaned.first()
    assert shown(row) == "hola/en friend/en ok/en"
    assert (row.tokens, row.text, row.tokens_list) == (3, "hola friend ok", ["hola", "friend", "ok"])
    row = R.retag_by_marks(cleaned).first()
    assert shown(row) == "hola/es friend/en ok/en"
    assert row.modified and row.has_code_switch == "yes"
    assert row.spanish_percentage == pytest.approx(100 / 3)


def test_retag_matches_substrings_unless_exact(spark):
    u = utterance(spark, "<ES>casa</ES> a house")
    assert shown(R.retag_by_marks(u).first()) == "casa/es a/es house/en"
    assert shown(R.retag_by_marks(u, exact=True).first()) == "casa/es a/en house/en"


def test_retag_needs_marked_words(spark):
    for original in ("plain words here", "<ES></ES> el perro"):
        u = utterance(spark, original)
        row = R.retag_by_marks(u).first()
        assert not row.modified and shown(row) == shown(u.first())


def test_strategy_repair(spark):
    row = R.repair_by_strategy(utterance(spark, "el dog.", "monolingual_spanish")).first()
    assert shown(row) == "el/es dog/es ./punct"
    assert (row.has_code_switch, row.spanish_percentage) == ("no", 100.0)
    row = R.repair_by_strategy(utterance(spark, "el dog.", "monolingual_english")).first()
    assert shown(row) == "el/en dog/en ./punct"
    assert (row.has_code_switch, row.spanish_percentage) == ("no", 0.0)
    stale = utterance(spark, "el dog.", "minimal_switch").withColumns({
        "has_code_switch": F.lit("no"), "spanish_percentage": F.lit(7.0),
    })
    row = R.repair_by_strategy(stale).first()
    assert (row.has_code_switch, row.spanish_percentage) == ("yes", 50.0)
    row = R.repair_by_strategy(stale.withColumn("strategy", F.lit("role_based"))).first()
    assert (row.has_code_switch, row.spanish_percentage) == ("no", 7.0)


@pytest.mark.parametrize("text, cleaned, final", [
    ("la bolsa<. y", "la bolsa. y", "la bolsa. y"),
    ("un<o dos>", "uno dos", "un<o dos>"),
    ("fin<. no >  ES¿qué?", "fin. no ¿qué?", "fin. no > ES¿qué?"),
    ("<ES>hola</ES>  a", "hola a", "hola a"),
])
def test_text_cleaning(spark, text, cleaned, final):
    row = spark.createDataFrame([(text,)], "t string").select(
        R.clean_text(F.col("t")).alias("c"), R.final_text(F.col("t")).alias("f")
    ).first()
    assert (row.c, row.f) == (cleaned, final)


@pytest.mark.parametrize("token, cleaned", [
    ("ESPN", "PN"), ("ES", ""), ("<hola>", "hola"), ("ES<a>", "a"), ("es", "es"), ("<ES>", "ES"),
])
def test_token_cleaning(spark, token, cleaned):
    row = spark.createDataFrame([(token,)], "t string").select(R.clean_token(F.col("t")).alias("c"))
    assert row.first().c == cleaned


def response(spark, text, strategy="free_generation"):
    return spark.createDataFrame(
        [(1, strategy, "travel planning", text)],
        "response_id long, strategy string, topic string, raw_text string",
    )


def test_lines_kept_and_dropped(spark):
    text = (
        "note: x y z\nHi: ...\nA: ok\nA: okay\nNotebook: one two\nno colon here\n"
        "at 5:30 we met\n:no name\n**Ana**: fine [3] day {4}\nB: \n"
    )
    rows = P.speaker_lines(response(spark, text)).orderBy("line_no").collect()
    assert [(r.name, r.content) for r in rows] == [
        ("A", "okay"), ("at 5", "30 we met"), ("Ana", "fine  day"),
    ]


def test_three_names_become_two_speakers(spark):
    lines = ["Ana: one two three", "Ben: one two three", "Cara: one two three", "Ana: a b c"]
    rows = P.speaker_map(response(spark, "\n".join(lines))).collect()
    assert {r.name: r.speaker for r in rows} == {
        "Ana": "Speaker A", "Ben": "Speaker B", "Cara": "Speaker A",
    }


def test_rejected_utterances_do_not_count_for_later_names(spark):
    lines = ["Ana: one two three", "Ben: one two", "Ben: a b c", "Ana: a b c", "Cara: a b c"]
    rows = P.speaker_map(response(spark, "\n".join(lines))).collect()
    assert {r.name: r.speaker for r in rows}["Cara"] == "Speaker B"


def test_short_dialogues_are_rejected(spark):
    lines = [f"Ana: word number {i}" for i in range(8)]
    assert P.parse_responses(response(spark, "\n".join(lines[:7]))).count() == 0
    rows = P.parse_responses(response(spark, "\n".join(lines), "monolingual_spanish")).collect()
    assert sorted(r.utt_idx for r in rows) == list(range(8))
    assert {r.spanish_percentage for r in rows} == {100.0}


def test_batch_answer(spark):
    said = "\n".join(f"Speaker {'AB'[i % 2]}: hello, you {i}" for i in range(6))
    text = (
        f"intro\nSpeaker A: not in a dialogue\n---CONVERSATION 1---\n{said}\n"
        f"---Conversation 2---\nSpeaker A: too short\n---CONVERSACIÓN 3---\nsays Speaker B: x\n{said}\n"
        f"---conversación 4---\n{said}\n"
    )
    answers = spark.createDataFrame(
        [(7, "english", ["t1", "t2", "t3"], text)],
        "batch_id long, language string, topics array<string>, raw_text string",
    )
    conversations = P.batch_conversations(answers)
    assert [(r.segment, r.topic) for r in conversations.orderBy("segment").collect()] == [
        (1, "t1"), (3, "t3"),
    ]
    rows = P.batch_utterances(conversations).orderBy("segment", "utt_idx").collect()
    assert len(rows) == 12
    assert shown(rows[0]) == "hello,/en you/en 0/en" and rows[0].speaker == "Speaker A"
    assert (rows[0].tokens, rows[0].spanish_percentage) == (3, 0.0)


@pytest.mark.parametrize("cs, total, needed", [
    (30, 100, 3), (25, 100, 1), (24, 100, 1), (22, 100, 0), (20, 100, 0),
])
def test_topup(spark, cs, total, needed):
    rate = spark.createDataFrame([(cs, total)], "cs_utterances long, utterances long")
    assert A.topup_from(rate, 0.25).first().needed_conversations == needed


def lengths(spark, no, yes):
    rows = [("no", x) for x in no] + [("yes", x) for x in yes]
    return spark.createDataFrame(rows, "has_code_switch string, token_count int")


def test_mann_whitney(spark):
    row = A.mann_whitney(lengths(spark, [1, 2, 3], [2, 4])).first()
    assert (row.u, row.mean_u) == (1.5, 3.0)
    assert row.sigma ** 2 == pytest.approx(2.85)
    assert row.z == pytest.approx(0.592349, abs=1e-6)
    assert row.p_value == pytest.approx(0.553617, abs=1e-6)
    assert row.verdict == "not significant"


def test_mann_whitney_exact_without_ties(spark):
    # U = 0 is one of C(5, 2) = 10 equally likely splits, on either side.
    row = A.mann_whitney(lengths(spark, [1, 2, 3], [4, 5])).first()
    assert row.u == 0.0 and row.p_value == pytest.approx(0.2)


def test_error_function(spark):
    xs = [-0.4, 0.0, 1e-9, 0.3, 1.0, 1.9999, 2.0, 2.5, 4.0, 9.0, 26.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", A.erfc(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 6), (2, 3), (8, 3), (5, 5), (8, 30), (4, 60)])
def test_counted_distribution(spark, n1, n2):
    """The tail of U over all splits of distinct lengths, counted value by value."""
    rng = random.Random(n1 * 100 + n2)
    values = rng.sample(range(1000), n1 + n2)
    row = A.mann_whitney(lengths(spark, values[:n1], values[n1:])).first()
    ways = [[1] + [0] * (n1 * n2)] + [[0] * (n1 * n2 + 1) for _ in range(n1)]
    for position in range(n1 + n2):
        for k in range(min(n1, position + 1), 0, -1):
            shift = position - (k - 1)
            for u in range(shift, n1 * n2 + 1):
                ways[k][u] += ways[k - 1][u - shift]
    top = int(max(row.u, n1 * n2 - row.u))
    assert row.p_value == pytest.approx(min(1.0, 2 * sum(ways[n1][top:]) / math.comb(n1 + n2, n1)), rel=1e-12)


@pytest.mark.parametrize("value, text", [
    (6.25, "6.2"), (18.75, "18.8"), (31.25, "31.2"), (1.25, "1.2"), (0.05, "0.1"),
    (0.35, "0.3"), (100 / 7, "14.3"), (100.0, "100.0"), (0.0, "0.0"),
])
def test_one_decimal(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(
        E.one_decimal(F.col("x")).alias("s")
    ).first().s == text
    assert text == f"{value:.1f}"


@pytest.mark.parametrize("cell, n", [(None, 1), ("", 1), ("a|b", 2)])
def test_turn_length(spark, cell, n):
    df = spark.createDataFrame([(1, "no", cell)], "id long, has_code_switch string, tokens string")
    assert A.turn_lengths(df).first().token_count == n


def test_box_numbers(spark):
    row = A.turn_length_box(lengths(spark, [1, 2, 3, 4, 100], [])).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 4.0, 1)


def test_histogram_matches_numpy(spark):
    np = pytest.importorskip("numpy")
    for values in ([1, 2, 2, 5, 40], [3, 3, 3], [0, 1, 2, 3, 4], list(range(1, 14)) * 2):
        points = spark.createDataFrame([(v,) for v in values], "switch_point int")
        rows = A.first_switch_hist(points).orderBy("bin").collect()
        counts, edges = np.histogram(values, bins=20)
        assert [r.n for r in rows] == counts.tolist()
        assert [r.lower for r in rows] == pytest.approx(edges[:-1].tolist())
