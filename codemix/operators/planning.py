"""Planning tables for dialogue generation.

Random choices come from a hash of the row number and a name for the choice,
so a plan is the same on every run and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemix.functions import text as T
from codemix.operators.prompts import BATCH_PROMPTS, STRATEGY_PROMPTS

# Schedule limits, choices and topics.
MIXED_FIRST, MONOLINGUAL_FROM = 50, 132
MONOLINGUAL_SHARE = 0.95
TONES = ["casual", "formal", "emotional", "humorous"]
PERSONAS = [
    ("Mexican-American student", "Anglo roommate"),
    ("Dominican grandmother", "American granddaughter"),
    ("Colombian engineer", "Indian colleague"),
    ("Puerto Rican teacher", "Mixed-background parent"),
]
TOPICS = [
    "weekend plans", "family dinner", "work meeting", "shopping trip",
    "movie night", "cooking together", "travel planning", "school project",
    "sports event", "birthday party", "restaurant visit", "health concerns",
]
BATCH_TOPICS = [
    "weekend plans", "cooking dinner", "office meeting", "gym workout",
    "movie review", "book club", "grocery shopping", "car repair",
    "vacation planning", "birthday party", "home renovation", "pet care",
    "weather chat", "sports game", "restaurant visit", "doctor appointment",
    "school project", "job interview", "morning routine", "coffee break",
    "hiking trip", "music concert", "art museum", "beach day",
    "game night", "study session", "cleaning day", "garden work",
    "family dinner", "online shopping", "tech support", "road trip",
    "gardening tips", "cooking show", "fitness goals", "meditation session",
]
BATCH_SIZE = 5
SWITCH_POINTS, FIRST_POINT, LAST_POINT = 3, 10, 49


def uniform(row: Column, choice: str) -> Column:
    """Reproducible number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", row, F.lit(choice)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / 2.0**32


def choose(values: list, row: Column, choice: str) -> Column:
    index = F.floor(uniform(row, choice) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def sample(values: Column, n: Column | int, row: Column, choice: str) -> Column:
    """The `n` elements with the smallest hash, in hash order."""
    n = F.lit(n) if isinstance(n, int) else n
    keyed = F.transform(
        values,
        lambda v: F.struct(
            F.md5(F.concat_ws(":", row, v.cast("string"), F.lit(choice)).cast("binary")).alias("h"),
            v.alias("v"),
        ),
    )
    return F.slice(F.array_sort(keyed), F.lit(1), n)["v"]


def plan_strategies(rows: DataFrame) -> DataFrame:
    """`i, strategy, strategy_name, tone` for every conversation number `i`."""
    i = F.col("i")
    late = F.when(
        uniform(i, "monolingual") < MONOLINGUAL_SHARE,
        F.when(uniform(i, "language") < 0.5, 6).otherwise(7),
    ).otherwise(8)
    strategy = (
        F.when(i < MIXED_FIRST, i % 5 + 1)
        .when(i >= MONOLINGUAL_FROM, late)
        .otherwise(F.floor(uniform(i, "strategy") * 8) + 1)
        .cast("int")
    )
    s = F.col("strategy")
    name = (
        F.when(s == 1, F.lit("controlled_switch"))
        .when(s == 2, F.lit("role_based"))
        .when(s == 3, F.concat(F.lit("topic_variation_"), F.col("tone")))
        .when(s == 4, F.lit("back_translation"))
        .when(s == 5, F.lit("free_generation"))
        .when(s == 6, F.lit("monolingual_english"))
        .when(s == 7, F.lit("monolingual_spanish"))
        .otherwise("minimal_switch")
    )
    return (
        rows.withColumn("strategy", strategy)
        .withColumn("tone", F.when(s == 3, choose(TONES, i, "tone")))
        .withColumn("strategy_name", name)
    )


def plan_parameters(rows: DataFrame) -> DataFrame:
    """The plan with topic, personas and switch points where the strategy has them."""
    i, s = F.col("i"), F.col("strategy")
    points = sample(
        F.sequence(F.lit(FIRST_POINT), F.lit(LAST_POINT)), SWITCH_POINTS, i, "points"
    )
    return plan_strategies(rows).withColumns({
        "topic": choose(TOPICS, i, "topic"),
        "persona_a": F.when(s == 2, choose([a for a, _ in PERSONAS], i, "persona")),
        "persona_b": F.when(s == 2, choose([b for _, b in PERSONAS], i, "persona")),
        "switch_points": F.when(s == 1, F.array_sort(points)),
    })


def plan_prompts(rows: DataFrame) -> DataFrame:
    """The plan with a prompt for the strategies that have one, NULL for others."""
    prompt = F.lit(None).cast("string")
    for number, text in STRATEGY_PROMPTS.items():
        filled = T.replace_all(F.lit(text), [("{topic}", F.col("topic"))])
        prompt = F.when(F.col("strategy") == number, filled).otherwise(prompt)
    return plan_parameters(rows).withColumn("prompt", prompt)


def plan_batches(batches: DataFrame, needed: Column) -> DataFrame:
    """Topics, language and prompt for every batch number `b`, counted from 1.

    Batches hold five dialogues until `needed` is reached; the last one may
    hold fewer. Odd batches are English, even ones Spanish.
    """
    b = F.col("b")
    n = F.least(F.lit(BATCH_SIZE), needed - BATCH_SIZE * (b - 1)).cast("int")
    numbered = F.array_join(
        F.transform(
            "topics", lambda t, k: F.concat((k + 1).cast("string"), F.lit(". "), t)
        ), "\n",
    )
    prompts = {
        language: T.replace_all(
            F.lit(text), [("{n}", F.col("n").cast("string")), ("{topics}", F.col("numbered"))]
        )
        for language, text in BATCH_PROMPTS.items()
    }
    every_topic = F.array(*[F.lit(t) for t in BATCH_TOPICS])
    return (
        batches.withColumn("n", n).filter("n > 0")
        .withColumn("language", F.when(b % 2 == 1, "english").otherwise("spanish"))
        .withColumn("topics", sample(every_topic, F.col("n"), b, "topics"))
        .withColumn("numbered", numbered)
        .withColumn(
            "prompt",
            F.when(F.col("language") == "english", prompts["english"])
            .otherwise(prompts["spanish"]),
        )
        .drop("numbered")
    )
