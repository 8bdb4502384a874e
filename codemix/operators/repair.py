"""Repairs of tagged utterances. Every repair is narrow and maps utterances to utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemix.functions import tagging as G, text as T
from codemix.operators.tagging import with_new_profile
from codemix.session import with_computed
from codemix.sources.dataset import headers

# Literal replacements, applied in this order, and the
# strategies that are spot-checked.
CLEAN_PAIRS = [
    ("<ES>", ""), ("</ES>", ""),
    ("bolsa<.", "bolsa."), ("huevos<", "huevos"), ("Vamos<.", "Vamos."),
    ("<.", "."), ("< ", " "), (" >", " "), ("<", ""), (">", ""),
    ("ES¿", "¿"), ("ES¡", "¡"),
]
FINAL_TEXT_PAIRS = [
    ("<ES>", ""), ("</ES>", ""),
    ("bolsa<", "bolsa"), ("huevos<", "huevos"), ("Vamos<", "Vamos"),
    ("<.", "."), ("< ", " "),
]
CHECKED_STRATEGIES = ["monolingual_spanish", "monolingual_english", "minimal_switch"]


def repair_by_strategy(utterances: DataFrame) -> DataFrame:
    """Monolingual conversations get their language; minimal ones a new profile."""
    language = G.forced_language(F.col("strategy"))
    retagged = F.transform(
        "tagged_tokens",
        lambda t: F.struct(
            t["token"].alias("token"),
            F.when(t["lang"] == "punct", "punct").otherwise(language).alias("lang"),
        ),
    )
    profiled = with_new_profile(utterances, when=F.col("strategy") == "minimal_switch")
    return profiled.withColumns({
        "tagged_tokens": F.when(language.isNotNull(), retagged).otherwise(F.col("tagged_tokens")),
        "has_code_switch": F.when(language.isNotNull(), "no").otherwise(F.col("has_code_switch")),
        "spanish_percentage": F.when(language == "es", 100.0).when(language == "en", 0.0)
        .otherwise(F.col("spanish_percentage")),
    })


def metadata_recount(utterances: DataFrame) -> DataFrame:
    """One row of dataset totals."""
    switched = F.coalesce(F.col("has_code_switch") == "yes", F.lit(False))
    share = F.coalesce(F.col("spanish_percentage"), F.lit(0.0))
    return utterances.agg(
        F.count("*").alias("total_utterances"),
        F.coalesce(F.sum(F.col("tokens").cast("bigint")), F.lit(0)).alias("total_tokens"),
        F.count_if(switched).alias("code_switching_utterances"),
        F.count_if(~switched & (share == 100)).alias("monolingual_spanish_utterances"),
        F.count_if(~switched & (share == 0)).alias("monolingual_english_utterances"),
        F.count_if(switched).alias("mixed_bilingual_utterances"),
    )


def repair_provenance(conversations: DataFrame, utterances: DataFrame) -> DataFrame:
    """How many conversations and utterances the strategy repair rewrote."""
    monolingual = F.count_if(G.forced_language(F.col("strategy")).isNotNull())
    n_conversations = headers(conversations).agg(monolingual.alias("conversations_fixed"))
    n_utterances = utterances.agg(monolingual.alias("utterances_fixed"))
    return n_conversations.crossJoin(F.broadcast(n_utterances)).withColumn(
        "fix_method", F.lit("strategy-based-retagging")
    )


def repair_sample(conversations: DataFrame, utterances: DataFrame) -> DataFrame:
    """First conversation of each checked strategy and its first utterance, if any."""
    first = (
        headers(conversations).filter(F.col("strategy").isin(CHECKED_STRATEGIES))
        .groupBy("strategy")
        .agg(F.min(F.struct("conv_pos", "conversation_id")).alias("c"))
        .select("strategy", "c.conv_pos", "c.conversation_id")
    )
    openings = utterances.filter(F.col("utt_idx") == 0).select(
        "conv_pos", F.substring("text", 1, 100).alias("text"), "has_code_switch",
        "spanish_percentage", F.slice("tagged_tokens", 1, 10).alias("tagged_tokens"),
    )
    # At most one row per checked strategy, so the broadcast side has a fixed bound.
    hits = openings.join(F.broadcast(first.select("conv_pos")), "conv_pos", "left_semi")
    return first.join(F.broadcast(hits), "conv_pos", "left")


def clean_text(c: Column) -> Column:
    return T.collapse(T.replace_all(c, CLEAN_PAIRS))


def clean_token(token: Column) -> Column:
    """Without a leading `ES` and without angle brackets at the ends."""
    return F.trim(F.regexp_replace(token, "^ES", ""), F.lit("<>"))


def clean_tags(utterances: DataFrame) -> DataFrame:
    """Remove mark debris from text and tokens, then recount and profile.

    `pos_tags` are left as they are, even when tokens vanish.
    """
    tokens = F.filter(F.transform("tokens_list", clean_token), lambda t: t != "")
    pairs = F.transform(
        "_old",
        lambda t: F.struct(clean_token(t["token"]).alias("token"), t["lang"].alias("lang")),
    )
    cleaned = _renamed(utterances).withColumn(
        "tagged_tokens", F.filter(pairs, lambda t: t["token"] != "")
    ).drop("_old")
    return with_new_profile(
        cleaned.withColumns({
            "text": clean_text(F.col("text")),
            "tokens_list": tokens,
            "tokens": G.count_words(F.col("tagged_tokens")),
        })
    ).select(*utterances.columns)


def clean_report(utterances: DataFrame) -> DataFrame:
    """Changed texts, utterances, and the switch rate after the cleaning."""
    after = clean_tags(utterances.withColumn("old_text", F.col("text")))
    switched = F.count_if(F.col("has_code_switch") == "yes")
    return after.agg(
        F.count("*").alias("utterances"),
        F.count_if(F.col("old_text") != F.col("text")).alias("fixed"),
        switched.alias("code_switched"),
        F.when(F.count("*") > 0, switched / F.count("*") * 100).otherwise(0.0).alias("cs_rate"),
    )


def is_marked(token: Column, marked: Column, exact: bool = False) -> Column:
    """Does a token match one of the marked words?

    Equality ignores case and edge punctuation. Unless `exact`, a token also
    matches when it is part of a marked word or contains one, case-sensitively.
    """
    edge = F.lit(T.EDGE_PUNCT)
    core = F.trim(token, edge)

    def matches(word: Column) -> Column:
        same = F.lower(core) == F.lower(F.trim(word, edge))
        if exact:
            return same
        return F.contains(word, core) | F.contains(core, word) | same

    return F.exists(marked, matches)


def retag_by_marks(utterances: DataFrame, exact: bool = False) -> DataFrame:
    """Tag words again from the marks kept in `original_text`; adds `modified`."""
    marked = F.col("_marked")
    gate = F.contains(F.col("original_text"), F.lit("<ES>")) & (F.size(marked) > 0)
    retagged = F.transform(
        "_old",
        lambda t: F.struct(
            t["token"].alias("token"),
            F.when(t["lang"] == "punct", "punct")
            .when(is_marked(t["token"], marked, exact), "es")
            .otherwise("en").alias("lang"),
        ),
    )
    rows = _renamed(utterances).withColumn("_marked", G.segment_words(F.col("original_text")))
    rows = with_computed(
        rows, tagged_tokens=F.when(gate, retagged).otherwise(F.col("_old"))
    )
    modified = F.coalesce(F.col("tagged_tokens") != F.col("_old"), F.lit(False))
    rows = rows.withColumn("modified", modified)
    return with_new_profile(rows, when=F.col("modified")).select(*utterances.columns, "modified")


def final_text(c: Column) -> Column:
    """Second text cleaning; a lone `<` inside a word survives it."""
    return T.collapse(T.replace_all(c, FINAL_TEXT_PAIRS))


def retag(utterances: DataFrame, exact: bool = False) -> DataFrame:
    return retag_by_marks(utterances, exact).withColumn("text", final_text(F.col("text")))


def retag_examples(retagged: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` modified utterances in document order."""
    return (
        retagged.filter("modified").orderBy("conv_pos", "utt_idx").limit(n)
        .select(
            "conv_pos", "utt_idx", F.substring("original_text", 1, 80).alias("original_text"),
            "spanish_percentage", "has_code_switch",
        )
    )


def retag_counts(retagged: DataFrame) -> DataFrame:
    return retagged.agg(
        F.count("*").alias("utterances"), F.count_if("modified").alias("modified")
    )


def _renamed(utterances: DataFrame) -> DataFrame:
    return utterances.withColumnRenamed("tagged_tokens", "_old")
