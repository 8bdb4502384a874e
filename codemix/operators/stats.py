"""Corpus statistics: conditional aggregates over utterances and over the export."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.functions import sequences as S, tagging as G
from codemix.operators.ordering import median, ranked_values
from codemix.session import with_computed, written
from codemix.sources.dataset import headers

# Targets, verdict limits and the sizes used by the top-up.
TARGET_RATE = (20.0, 30.0)
TARGET_TOKENS = 15000
TOPUP_RATE = 0.25
UTTERANCES_PER_CONVERSATION = 10
HISTOGRAM_BINS = 20
SIGNIFICANCE = 0.05


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def cs_rate_flag(utterances: DataFrame) -> DataFrame:
    switched, total = F.count_if(F.col("has_code_switch") == "yes"), F.count("*")
    return utterances.agg(
        _rate(switched, total).alias("cs_rate"), switched.alias("cs_utterances"),
        total.alias("utterances"),
    )


def _languages(utterances: DataFrame) -> DataFrame:
    tt = F.col("tagged_tokens")
    return utterances.select(
        G.count_lang(tt, "es").alias("n_es"), G.count_lang(tt, "en").alias("n_en")
    )


def cs_rate_true(utterances: DataFrame) -> DataFrame:
    """Mixed and monolingual utterances by their tags, not by the stored flag."""
    es, en = F.col("n_es") > 0, F.col("n_en") > 0
    total = F.count("*")
    mixed, only_es, only_en = F.count_if(es & en), F.count_if(es & ~en), F.count_if(en & ~es)
    return _languages(utterances).agg(
        total.alias("utterances"), mixed.alias("mixed"),
        only_es.alias("spanish_only"), only_en.alias("english_only"),
        _rate(mixed, total).alias("mixed_share"),
        _rate(only_es, total).alias("spanish_share"),
        _rate(only_en, total).alias("english_share"),
    )


def corpus_stats(utterances: DataFrame) -> DataFrame:
    """The full analysis in one row and one pass."""
    u = utterances.select(S.spoken(F.col("tagged_tokens"))["lang"].alias("labels")).select(
        (F.size("labels") - F.size(F.array_remove("labels", "es"))).cast("bigint").alias("n_es"),
        (F.size("labels") - F.size(F.array_remove("labels", "en"))).cast("bigint").alias("n_en"),
        S.count_changes(F.col("labels")).alias("changes"),
    )
    length = F.col("n_es") + F.col("n_en")
    mixed = (F.col("n_es") > 0) & (F.col("n_en") > 0)
    spoken_length = F.when(length > 0, length)
    return u.agg(
        F.count("*").alias("utterances"),
        F.count_if(mixed).alias("code_switched"),
        F.count_if((F.col("n_en") > 0) & ~mixed).alias("pure_english"),
        F.count_if((F.col("n_es") > 0) & ~mixed).alias("pure_spanish"),
        F.coalesce(F.sum("n_en"), F.lit(0)).alias("english_tokens"),
        F.coalesce(F.sum("n_es"), F.lit(0)).alias("spanish_tokens"),
        F.count_if(mixed & (F.col("changes") >= 2)).alias("intrasentential"),
        F.count_if(mixed & (F.col("changes") < 2)).alias("intersentential"),
        _rate(F.count_if(mixed), F.count("*")).alias("cs_rate"),
        F.avg(spoken_length).alias("mean_length"),
        F.percentile(spoken_length, 0.5).alias("median_length"),
        F.min(spoken_length).alias("min_length"),
        F.max(spoken_length).alias("max_length"),
    )


def lang_token_share(utterances: DataFrame) -> DataFrame:
    sums = _languages(utterances).agg(
        F.coalesce(F.sum("n_en"), F.lit(0)).alias("english_tokens"),
        F.coalesce(F.sum("n_es"), F.lit(0)).alias("spanish_tokens"),
    )
    both = F.col("english_tokens") + F.col("spanish_tokens")
    return sums.withColumns({
        "english_share": F.when(both > 0, F.col("english_tokens") / both * 100),
        "spanish_share": F.when(both > 0, F.col("spanish_tokens") / both * 100),
    })


def switch_types(utterances: DataFrame) -> DataFrame:
    """Switched utterances with one change, and with two or more."""
    n = utterances.select(
        S.count_changes(S.spoken(F.col("tagged_tokens"))["lang"]).alias("n")
    )
    sums = n.agg(
        F.count_if(F.col("n") == 1).alias("intersentential"),
        F.count_if(F.col("n") >= 2).alias("intrasentential"),
    )
    both = F.col("intersentential") + F.col("intrasentential")
    return sums.withColumns({
        "intersentential_share": F.when(both > 0, F.col("intersentential") / both * 100),
        "intrasentential_share": F.when(both > 0, F.col("intrasentential") / both * 100),
    })


def length_stats(utterances: DataFrame) -> DataFrame:
    """Over utterances with at least one English or Spanish word.

    Lengths repeat a lot, so the exact median works on few distinct values.
    """
    n = F.col("n_es") + F.col("n_en")
    lengths = _languages(utterances).select(F.when(n > 0, n).cast("bigint").alias("length"))
    return lengths.agg(
        F.count("length").alias("n"), F.avg("length").alias("mean"),
        F.percentile("length", 0.5).alias("median"),
        F.min("length").alias("min"), F.max("length").alias("max"),
    )


def cs_only_stats(utterances: DataFrame) -> DataFrame:
    """Length and Spanish share of the mixed utterances only.

    Utterances are merged to one row per pair of language counts first. Shares
    take many distinct values, so their median goes over the ranked values.
    """
    counts = with_computed(
        _languages(utterances), es=F.col("n_es").cast("bigint"), en=F.col("n_en").cast("bigint")
    )
    # stored, as the summary and the levels of the median go over it: texts are tagged once
    rows = written(counts.groupBy(F.col("es").alias("n_es"), F.col("en").alias("n_en")).agg(
        F.count("*").alias("rows")
    ), "language-counts")
    mixed = rows.filter((F.col("n_es") > 0) & (F.col("n_en") > 0)).select(
        (F.col("n_es") + F.col("n_en")).alias("length"),
        (F.col("n_es") / (F.col("n_es") + F.col("n_en")) * 100).alias("share"), "rows",
    )
    n = F.col("rows")
    summary = mixed.agg(
        F.sum(n).alias("n"), (F.sum(F.col("length") * n) / F.sum(n)).alias("mean"),
        F.percentile("length", 0.5, n).alias("median"),
        F.min("length").alias("min"), F.max("length").alias("max"),
        (F.sum(F.col("share") * n) / F.sum(n)).alias("mean_share"),
        F.min("share").alias("min_share"), F.max("share").alias("max_share"),
    )
    middle = median(
        mixed, "share", F.floor(F.col("share") * 1e6), F.sum(n), summary.select("n"),
        "median_share",
    )
    return summary.crossJoin(F.broadcast(middle))


def target_check(utterances: DataFrame, metadata: DataFrame) -> DataFrame:
    """Is the switch rate inside the target, and is the corpus large enough?

    The token total is read from the metadata row, not counted again.
    """
    rate = cs_rate_true(utterances).select(F.col("mixed_share").alias("cs_rate"))
    tokens = metadata.select("total_tokens")
    return rate.crossJoin(F.broadcast(tokens)).withColumns({
        "rate_in_target": F.col("cs_rate").between(*TARGET_RATE),
        "enough_tokens": F.col("total_tokens") >= TARGET_TOKENS,
    })


def final_split(utterances: DataFrame) -> DataFrame:
    """By flag first, then by a Spanish share of 100 or 0; the rest only in the total."""
    switched = F.col("has_code_switch") == "yes"
    share = F.coalesce(F.col("spanish_percentage"), F.lit(0.0))
    total = F.count("*")
    parts = {
        "code_switched": F.count_if(switched),
        "spanish_only": F.count_if(~switched & (share == 100)),
        "english_only": F.count_if(~switched & (share == 0)),
    }
    return utterances.agg(
        total.alias("utterances"),
        *[c.alias(name) for name, c in parts.items()],
        *[_rate(c, total).alias(f"{name}_share") for name, c in parts.items()],
    )


def conversation_summary(utterances: DataFrame) -> DataFrame:
    """Per conversation; the Spanish share is fixed for monolingual strategies."""
    language = G.forced_language(F.col("strategy"))
    return (
        utterances.groupBy("conv_pos", "strategy").agg(
            F.count("*").alias("utterances"),
            F.sum(F.col("tokens").cast("bigint")).alias("tokens"),
            F.count_if(F.col("has_code_switch") == "yes").alias("cs_utterances"),
            F.avg("spanish_percentage").alias("avg_spanish"),
        )
        .withColumn(
            "avg_spanish",
            F.when(language == "en", 0.0).when(language == "es", 100.0)
            .otherwise(F.col("avg_spanish")),
        )
    )


def topup_needed(utterances: DataFrame, target: float = TOPUP_RATE) -> DataFrame:
    """Monolingual conversations still needed to reach the target switch rate."""
    return topup_from(cs_rate_flag(utterances), target)


def topup_from(rate: DataFrame, target: float = TOPUP_RATE) -> DataFrame:
    missing = F.col("cs_utterances") / F.lit(target) - F.col("utterances")
    conversations = (missing / UTTERANCES_PER_CONVERSATION).cast("bigint") + 1
    return rate.select(
        F.greatest(conversations, F.lit(0).cast("bigint")).alias("needed_conversations"),
        "cs_utterances", "utterances",
    )


def dataset_totals(conversations: DataFrame, utterances: DataFrame) -> DataFrame:
    """The totals kept in the metadata, with the time of the count."""
    n = headers(conversations).agg(F.count("*").alias("total_conversations"))
    sums = utterances.agg(
        F.count("*").alias("total_utterances"),
        F.coalesce(F.sum(F.col("tokens").cast("bigint")), F.lit(0)).alias("total_tokens"),
    )
    return n.crossJoin(F.broadcast(sums)).withColumn("last_updated", F.current_timestamp())


# ---- over the export ------------------------------------------------------

def first_switches(export: DataFrame) -> DataFrame:
    """Position of the first change of every switched row."""
    tags = F.split("pos_tags", "[|]")
    rows = with_computed(export.select("id", "pos_tags", "has_code_switch"),
                         _switched=F.col("has_code_switch") == "yes")
    return rows.filter("_switched").select("id", S.first_change(tags).alias("switch_point"))


def first_switch_stats(points: DataFrame) -> DataFrame:
    x = F.col("switch_point")
    summary = points.agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"),
        F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return summary.withColumn(
        "verdict",
        F.when(F.col("mean") < 5, "early").when(F.col("mean") < 10, "middle").otherwise("late"),
    )


def first_switch_hist(points: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the minimum to the maximum; the last one is closed.

    Rows are merged to one per distinct position first, so the window over all
    of them is small. A value belongs to the bin whose lower edge is the last
    one not above it. Bins without rows are listed with 0.
    """
    everything = Window.partitionBy()
    counts = points.groupBy("switch_point").agg(F.count("*").alias("n")).withColumns({
        "low": F.min("switch_point").over(everything).cast("double"),
        "high": F.max("switch_point").over(everything).cast("double"),
    })
    single = F.col("low") == F.col("high")
    counts = counts.select(
        "switch_point", "n",
        F.when(single, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(single, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    step = (F.col("high") - F.col("low")) / bins
    reached = F.filter(
        F.sequence(F.lit(1), F.lit(bins - 1)),
        lambda i: i * step + F.col("low") <= F.col("switch_point"),
    )
    filled = counts.groupBy("low", "high", F.size(reached).alias("bin")).agg(F.sum("n").alias("n"))
    one_row = filled.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found")
    )
    return one_row.select(
        "low", "high", "found", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "bin",
        (F.col("bin") * step + F.col("low")).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.col("high"))
        .otherwise((F.col("bin") + 1) * step + F.col("low")).alias("upper"),
        F.coalesce(F.col("found")[F.col("bin")], F.lit(0)).alias("n"),
    )


def export_lang_share(export: DataFrame) -> DataFrame:
    """Language totals from the piped tags."""
    tags = F.split(F.coalesce("pos_tags", F.lit("nan")), "[|]")
    count = lambda tag: (F.size(tags) - F.size(F.array_remove(tags, tag))).cast("bigint")
    sums = export.agg(
        F.coalesce(F.sum(count("EN")), F.lit(0)).alias("english"),
        F.coalesce(F.sum(count("ES")), F.lit(0)).alias("spanish"),
    )
    both = F.col("english") + F.col("spanish")
    return sums.withColumns({
        "total": both,
        "english_share": F.when(both > 0, F.col("english") / both * 100),
        "spanish_share": F.when(both > 0, F.col("spanish") / both * 100),
    })


def turn_lengths(export: DataFrame) -> DataFrame:
    """Pieces of the piped tokens; an empty cell counts as one."""
    pieces = F.size(F.split(F.coalesce("tokens", F.lit("nan")), "[|]"))
    return export.select("id", "has_code_switch", pieces.alias("token_count"))


def _flagged(lengths: DataFrame) -> DataFrame:
    rows = with_computed(lengths, _known=F.col("has_code_switch").isin("yes", "no"))
    return rows.filter("_known").drop("_known")


def _length_counts(lengths: DataFrame) -> DataFrame:
    """One row per flag and distinct length: all later steps work on these."""
    return (
        _flagged(lengths).groupBy("has_code_switch", "token_count").agg(F.count("*").alias("n"))
    )


def turn_length_stats(lengths: DataFrame) -> DataFrame:
    x = F.col("token_count")
    return (
        _flagged(lengths).groupBy("has_code_switch").agg(
            F.count("*").alias("n"), F.avg(x).alias("mean"),
            F.percentile(x, 0.5).alias("median"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        )
    )


def turn_length_box(lengths: DataFrame) -> DataFrame:
    """Quartiles, whiskers (extreme points within 1.5 IQR) and outliers per flag."""
    counts = _length_counts(lengths)
    x = F.col("token_count")
    quartiles = counts.groupBy("has_code_switch").agg(
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")
    ).select(
        "has_code_switch", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    above_low = x >= F.col("q1") - 1.5 * iqr
    below_high = x <= F.col("q3") + 1.5 * iqr
    box = counts.join(F.broadcast(quartiles), "has_code_switch").groupBy(
        "has_code_switch", "q1", "median", "q3"
    ).agg(
        F.min(F.when(above_low, x)).alias("whisker_low"),
        F.max(F.when(below_high, x)).alias("whisker_high"),
        F.sum(F.when(above_low & below_high, 0).otherwise(F.col("n"))).alias("outliers"),
    )
    return box.withColumns({
        "whisker_low": F.least(F.col("whisker_low").cast("double"), "q1"),
        "whisker_high": F.greatest(F.col("whisker_high").cast("double"), "q3"),
    })


def mann_whitney(lengths: DataFrame) -> DataFrame:
    """Two-sided rank test of the lengths, `no` against `yes`, in one row.

    The rows are merged to one per distinct length before they are ranked.
    """
    ranked = ranked_values(
        lengths, "token_count", F.col("token_count"),
        {
            "n_no": F.count_if(F.col("has_code_switch") == "no"),
            "n_yes": F.count_if(F.col("has_code_switch") == "yes"),
        },
    )
    return rank_test(ranked)


def rank_sums(ranked: DataFrame) -> DataFrame:
    """Sizes, U of the first sample, tie term; `ranked` has `n_no, n_yes, n, before`."""
    n = F.col("n").cast("double")
    mid_rank = F.col("before") + (n + 1) / 2
    return ranked.agg(
        F.sum("n_no").alias("n1"), F.sum("n_yes").alias("n2"),
        F.sum(mid_rank * F.col("n_no")).alias("r1"),
        F.sum(n * n * n - n).alias("ties"),
    ).withColumn("u1", F.col("r1") - F.col("n1").cast("double") * (F.col("n1") + 1) / 2)


def rank_test(ranked: DataFrame) -> DataFrame:
    n = F.col("n1").cast("double") + F.col("n2")
    product = F.col("n1").cast("double") * F.col("n2")
    tested = rank_sums(ranked).withColumns({
        "mean_u": product / 2,
        "sigma": F.sqrt(
            product / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
        ),
    }).withColumn(
        "z",
        F.try_divide(
            F.greatest(F.col("u1"), product - F.col("u1")) - F.col("mean_u") - 0.5, F.col("sigma")
        ),
    )
    return tested.withColumn("p_value", _p_value()).select(
        "n1", "n2", F.col("u1").alias("u"), "mean_u", "sigma", "z", "p_value",
        F.when(F.col("p_value") < SIGNIFICANCE, "significant").otherwise("not significant")
        .alias("verdict"),
    )


#: Terms of the error function's series and levels of its continued fraction, which meet at _NEAR.
_SERIES, _FRACTION, _NEAR = 60, 100, 2.0
#: The largest smaller sample whose distribution of U is counted.
_COUNTED = 8


def erfc(x: Column) -> Column:
    """The complementary error function of numbers from about -2 on, to some 14 digits.

    Near zero 1 - erf by its series of positive terms, farther off the continued fraction.
    """
    half, steps = 2 * x * x, lambda n: F.sequence(F.lit(1), F.lit(n))
    tail = F.aggregate(
        steps(_SERIES), F.lit(1.0), lambda s, k: F.lit(1.0) + half / (2 * (_SERIES + 1 - k) + 1).cast("double") * s
    )
    near = 1 - 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * tail
    below = F.aggregate(steps(_FRACTION), x, lambda f, k: x + (_FRACTION + 1 - k).cast("double") / 2 / f)
    return F.when(x < _NEAR, near).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * below))


def _splits(small: Column, large: Column) -> Column:
    """How many splits of the ranks have U = 0, 1, ...: the coefficients of a Gaussian binomial.

    Going from i - 1 to i values in the smaller sample multiplies by 1 - q^(large + i)
    and divides by 1 - q^i, each a pass over the array. Whole numbers of 38 digits.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    zero, size = whole(F.lit(0)), (small * large + 1).cast("int")
    at = lambda a, j: F.coalesce(F.get(a, j.cast("int")), zero)

    def step(ways: Column, i: Column) -> Column:
        less = F.transform(ways, lambda x, j: whole(x - F.when(j >= large + i, at(ways, j - large - i)).otherwise(zero)))
        return F.aggregate(less, F.array().cast("array<decimal(38,0)>"), lambda done, x: F.concat(
            done, F.array(whole(x + F.when(F.size(done) >= i, at(done, F.size(done) - i)).otherwise(zero)))
        ))

    one = F.transform(F.sequence(F.lit(1), size), lambda j: F.when(j == 1, whole(F.lit(1))).otherwise(zero))
    return F.aggregate(F.sequence(F.lit(1), small.cast("int")), one, step)


def _p_value() -> Column:
    """Two-sided, of one row with `n1, n2, u1, z, ties`; NULL without two samples.

    Without ties and with at most eight values in a sample the distribution of
    U is counted exactly, otherwise the normal approximation is used.
    """
    n1, n2 = F.col("n1"), F.col("n2")
    ways = _splits(F.least(n1, n2), F.greatest(n1, n2))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    top = F.greatest(F.col("u1"), n1 * n2 - F.col("u1")).cast("int")
    ends = F.transform(F.array(ways), lambda w: 2 * add(F.slice(w, top + 1, F.size(w) - top)) / add(w))[0]
    counted = (F.least(n1, n2) <= _COUNTED) & ~(F.col("ties") > 0)
    p = F.when(counted, ends).otherwise(erfc(F.col("z") / math.sqrt(2)))
    return F.when((n1 > 0) & (n2 > 0), F.when(p.isNotNull(), F.least(p, F.lit(1.0))))
