"""Columns that follow from `tagged_tokens`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codemix.functions import tagging as G


def with_profile(tagged: DataFrame) -> DataFrame:
    """Everything a new utterance derives from its tags."""
    tt = F.col("tagged_tokens")
    n_es, n_en = G.count_lang(tt, "es"), G.count_lang(tt, "en")
    return tagged.withColumns({
        "tokens": G.count_words(tt),
        "tokens_list": tt["token"],
        "pos_tags": G.coarse_pos(tt),
        "has_code_switch": G.switch_flag(n_es, n_en),
        "spanish_percentage": G.spanish_share(n_es, n_en),
    })


def with_new_profile(df: DataFrame, when=None) -> DataFrame:
    """Recompute flag and Spanish share of an utterance that already has them.

    Rows without any English or Spanish word, and rows where `when` does not
    hold, keep their old values.
    """
    tt = F.col("tagged_tokens")
    n_es, n_en = G.count_lang(tt, "es"), G.count_lang(tt, "en")
    known = n_es + n_en > 0
    if when is not None:
        known = known & when
    return df.withColumns({
        "has_code_switch": F.when(known, G.switch_flag(n_es, n_en))
        .otherwise(F.col("has_code_switch")),
        "spanish_percentage": F.when(known, G.spanish_share(n_es, n_en))
        .otherwise(F.col("spanish_percentage")),
    })
