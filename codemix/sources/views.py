"""Dialogue data derived from the `documents` and `conversations` tables.

Every document becomes one conversation, every non-blank line one utterance.
Two of three lines get a Spanish mark around their third and fourth word, one
of them padded with blanks. All of it is narrow: a document is one row, and
its lines stay in an array until they are needed as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix.functions import tagging as G, text as T
from codemix.operators.planning import BATCH_TOPICS, TOPICS
from codemix.operators.tagging import with_profile
from codemix.session import spread

STRATEGIES = [
    "controlled_switch", "role_based", "topic_variation_casual", "back_translation",
    "free_generation", "monolingual_english", "monolingual_spanish", "minimal_switch",
]
SEGMENT_LINES = 8


def pick(values: list, index: Column) -> Column:
    """Element of a constant list by 0-based index, wrapping around."""
    array = F.array(*[F.lit(v) for v in values])
    return F.element_at(array, (index % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def _plain_lines(text: Column) -> Column:
    """Non-blank lines, white space inside them collapsed."""
    blanks = T.squeeze(text, T.SPACE_NO_NEWLINE)
    lines = F.regexp_replace(blanks, " ?\n[ \n]*", "\n")
    return F.split(F.trim(lines, F.lit(" \n")), "\n")


def _mark(line: Column, index: Column) -> Column:
    third_fourth = r"^((?:[^ ]+ ){2})([^ ]+ [^ ]+)(?= )"
    return (
        F.when(index % 3 == 1, F.regexp_replace(line, third_fourth, "$1<ES>$2</ES>"))
        .when(index % 3 == 2, F.regexp_replace(line, third_fourth, "$1<ES> $2 </ES>"))
        .otherwise(line)
    )


def _has_line(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(f"[^{T.SPACE}]"))


def _labels(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "strategy": pick(STRATEGIES, F.col("doc_id")),
        "topic": pick(TOPICS, F.col("doc_id")),
    })


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, also for those without any utterance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return _labels(docs).select(
        F.col("doc_id").alias("conv_pos"), F.col("doc_id").alias("conversation_id"),
        "strategy", "topic",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conv_pos, utt_idx, original_text, strategy, topic`; `utt_idx` has no gaps."""
    docs = _labels(_has_line(documents(spark, sf_dir)))
    return docs.select(
        F.col("doc_id").alias("conv_pos"), "strategy", "topic",
        F.posexplode(_plain_lines(F.col("text"))).alias("utt_idx", "line"),
    ).select(
        "conv_pos", "utt_idx", _mark(F.col("line"), F.col("utt_idx")).alias("original_text"),
        "strategy", "topic",
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main table: lines tagged by the heuristic, with some tag debris in the text."""
    tagged = lines(spark, sf_dir).withColumn("tagged_tokens", G.tag(F.col("original_text")))
    return with_profile(tagged).select(
        "conv_pos",
        F.col("conv_pos").alias("conversation_id"),
        "utt_idx",
        F.when(F.col("utt_idx") % 2 == 0, "Speaker A").otherwise("Speaker B").alias("speaker"),
        F.concat(
            G.clean_text(F.col("original_text")),
            F.when(F.col("utt_idx") % 7 == 0, "<.")
            .when(F.col("utt_idx") % 7 == 3, " >").otherwise(""),
        ).alias("text"),
        "original_text", "tokens", "tagged_tokens", "tokens_list", "pos_tags",
        "has_code_switch", "spanish_percentage", "strategy", "topic",
    )


def responses_of(docs: DataFrame) -> DataFrame:
    """`response_id, strategy, topic, raw_text`: dialogue as a model would answer it."""
    doc_id = F.col("doc_id")
    name = lambda i: (
        F.when(doc_id % 3 == 0, F.when(i % 2 == 0, "Speaker A: ").otherwise("Speaker B: "))
        .when(doc_id % 3 == 1, F.when(i % 2 == 0, "**Speaker A:** ").otherwise("**Speaker B:** "))
        .otherwise(pick(["Ana: ", "Ben: ", "Cara: "], i))
    )
    ending = F.when(doc_id % 5 == 1, " [3]").when(doc_id % 5 == 2, " {7} **ok**").otherwise("")
    said = F.transform(
        _plain_lines(F.col("text")), lambda line, i: F.concat(name(i), _mark(line, i), ending)
    )
    opening = (
        F.when(doc_id % 5 == 0, "Note: generated [12]\n")
        .when(doc_id % 5 == 3, "Dora: ...\n\nHi\n")
        .otherwise("")
    )
    return _labels(_has_line(docs)).select(
        doc_id.alias("response_id"), "strategy", "topic",
        F.concat(opening, F.array_join(said, "\n")).alias("raw_text"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_of(documents(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`batch_id, language, topics, raw_text`: several monolingual dialogues per answer.

    Each document is one answer, cut into dialogues of eight lines. Every
    fourth answer has one dialogue more than it has topics.
    """
    doc_id = F.col("doc_id")
    docs = _has_line(documents(spark, sf_dir)).withColumns({
        "lines": _plain_lines(F.col("text")),
        "language": F.when(F.col("lang") == "es", "spanish").otherwise("english"),
    })
    docs = docs.withColumn(
        "n_segments", F.ceil(F.size("lines") / SEGMENT_LINES).cast("int")
    )
    marker = (
        F.when(F.col("language") == "spanish", "---CONVERSACIÓN ")
        .when(doc_id % 3 == 0, "---Conversation ").otherwise("---CONVERSATION ")
    )

    def dialogue(k: Column) -> Column:
        said = F.transform(
            F.slice("lines", k * SEGMENT_LINES + 1, SEGMENT_LINES),
            lambda line, i: F.concat(
                F.when(i % 2 == 0, "Speaker A: ").otherwise("Speaker B: "), line
            ),
        )
        return F.concat(
            marker, (k + 1).cast("string"), F.lit("---\n"), F.array_join(said, "\n"), F.lit("\n")
        )

    every = F.sequence(F.lit(0), F.col("n_segments") - 1)
    n_topics = F.col("n_segments") - F.when(doc_id % 4 == 0, 1).otherwise(0)
    return docs.select(
        doc_id.alias("batch_id"), "language",
        F.transform(
            F.slice(every, F.lit(1), n_topics), lambda k: pick(BATCH_TOPICS, doc_id + k)
        ).alias("topics"),
        F.concat(
            F.lit("Here are the dialogues.\n"), F.array_join(F.transform(every, dialogue), "")
        ).alias("raw_text"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the `conversations` table, tagged by the heuristic."""
    df = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return df.withColumn("tagged_tokens", G.tag(F.col("text")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every utterance, with many ties."""
    score = (F.col("conv_pos") * 31 + F.col("utt_idx") * 17) % 101 / 100.0
    return lines(spark, sf_dir).select(
        "conv_pos", "utt_idx",
        (F.col("conv_pos") % 2).cast("int").alias("label"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
    )
