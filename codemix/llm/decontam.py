"""Benchmark decontamination: windows of test words searched in training texts.

Every item of a benchmark gives the windows of ``WINDOW`` consecutive words, or
one window of all its words when it has fewer. They form a table of normalised
n-grams with the items each belongs to, which is broadcast when its counted size
allows it, and joined by shuffling otherwise. The words of a document are laid
beside the following ones, so that one row holds a window; its hash is looked up
in the table and the words of a hit are compared one by one. A document's row
runs along as the window at position -1, so that one pass over the texts yields
hits and counts.

Everything is made of DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.llm.common import ROW, ascii_lower, keyed, with_key, without_rows

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated when at least one in so many of its words is hit.
SHARE = 20
#: Most n-grams in a broadcast table, and most bytes of them and their items' ids.
MAX_BROADCAST = 1_000_000
MAX_BROADCAST_BYTES = 200_000_000
#: What a row or an id takes besides.
_ROW_BYTES = 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _window_columns(size: int) -> list[str]:
    return [f"w{j}" for j in range(size)]


def _gram(names: list[str]) -> Column:
    return F.concat_ws(" ", *names)


def ngrams(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (n, gram, hash, item), n the number of words. Null ids are no items."""
    tokens = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    return tokens.select("item", "words", n.alias("n"), F.explode(starts).alias("at")).select(
        "item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("gram")
    ).distinct().withColumn("hash", F.xxhash64("gram"))


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, key: str | None = None,
) -> DataFrame:
    """Hits of windows in every document.

    One row per input row: doc_id, n_words, and ``hits``, the sorted array of
    (first word, words) structs, and ``items``, the sorted ids whose windows occur.
    Null and empty texts have no words, null or repeated ids and repeated rows keep
    their own results, and other columns are ignored. Empty tables give no hits.
    """
    grams = ngrams(items, item_col, item_text, window)
    # a gram counts with each of its items, so the sum is no less than the table
    size = F.octet_length("gram") + F.octet_length("item") + F.lit(_ROW_BYTES).cast("long")
    counted = grams.groupBy("n").agg(F.count("*").alias("grams"), F.sum(size).alias("bytes")).collect()
    sizes = {r["n"]: r["grams"] for r in counted}
    small = sum(sizes.values()) <= MAX_BROADCAST and sum(r["bytes"] for r in counted) <= MAX_BROADCAST_BYTES
    longest = max(sizes, default=1)
    names = _window_columns(longest)

    tokens = keyed(docs, key, doc_id=F.col(id_col), words=words(F.col(text_col)))
    following = [F.slice("words", j + 1, F.greatest(F.size("words") - j, F.lit(0))).alias(w) for j, w in enumerate(names)]
    beside = tokens.select(ROW, "doc_id", F.size("words").alias("n_words"), F.arrays_zip(*following).alias("beside"))
    rows = beside.select(ROW, "doc_id", "n_words", F.posexplode_outer("beside").alias("at", "w")).select(
        ROW, "doc_id", "n_words", F.coalesce("at", F.lit(0)).alias("at"), "w.*"
    )
    # A window of n words exists where n words follow.
    looked = F.array(*[
        F.when(F.col(names[n - 1]).isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(_gram(names[:n])).alias("hash")))
        for n in sorted(sizes)
    ]) if sizes else F.array(F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("hash")))
    if len(sizes) == 1:
        n = next(iter(sizes))
        keys = rows.withColumn("n", F.lit(n)).withColumn(
            "hash", F.when(F.col(names[n - 1]).isNotNull(), F.xxhash64(_gram(names[:n])))
        )
    else:
        keys = rows.select("*", F.explode(looked).alias("key")).select("*", "key.n", "key.hash")
    wanted = grams.groupBy("n", "gram", "hash").agg(F.sort_array(F.collect_set("item")).alias("found"))
    if small:
        wanted = F.broadcast(wanted)
    same_words = _gram(names) if len(sizes) == 1 else F.array_join(F.slice(F.array(*names), 1, F.col("k.n")), " ")
    joined = keys.alias("k").join(
        wanted.alias("g"),
        (F.col("k.hash") == F.col("g.hash")) & (F.col("k.n") == F.col("g.n")) & (same_words == F.col("g.gram")),
        "left",
    ).where(F.col("gram").isNotNull() | (F.col("at") == 0))
    hits = joined.select(
        ROW, "doc_id", "n_words", "found",
        F.when(F.col("gram").isNotNull(), F.struct("at", F.col("g.n").alias("n"))).alias("hit"),
    )
    # Many hits of a text name the same items: each distinct list counts once.
    return hits.groupBy(ROW).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("hit")).alias("hits"), F.collect_set("found").alias("found"),
    ).withColumn("items", F.array_sort(F.array_distinct(F.flatten("found")))).drop("found")


def hit_words(hits: Column) -> Column:
    """The number of words inside any hit: the lengths of the hits' union."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        hits, start,
        lambda s, h: F.struct(
            F.greatest(s["end"], h["at"] + h["n"]).alias("end"),
            (s["n"] + F.greatest(h["at"] + h["n"] - F.greatest(s["end"], h["at"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    ).cast("long")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def report(scanned: DataFrame) -> DataFrame:
    """Words, hit words and items of every document, and whether it is contaminated."""
    counted = scanned.withColumn("n_hit", hit_words(F.col("hits")))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """The rows of a table that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay, repeated rows stay or go together, and an empty table stays empty.
    """
    rows, key = with_key(docs, "decontamination-rows")
    found = scan(rows, items, key=key, **columns)
    return without_rows(rows, key, found.where(contaminated(hit_words(F.col("hits")), F.col("n_words"))), "decontamination-gone")
