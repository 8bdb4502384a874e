"""Phrase collocations: frequent phrases counted with broadcast tries, scored by their weakest cut.

Texts are cut into pieces at punctuation and line ends, and pieces into words; everything is done
for each language. A first pass counts words. A second one writes the texts as numbers of
frequent words, 0 for what ends a phrase, so that the later ones read little.

Phrases grow word by word. The candidates of k words are those whose first and last k - 1 words
are frequent phrases and whose hash is that of ``least`` such places of the texts, which no frequent
phrase can miss; they form double-array tries of bounded size, which are broadcast. A task
walks them from all positions of its texts at once, level by level, counts the last states it
reaches, and Spark sums the counts of all tasks. For two words every pair of frequent words is a
candidate: that trie is complete, its states are word · words + word without any table, and
the states that a text reaches are counted sparsely. So they are for more words where the candidates
would take more than a few tries: the trie of the frequent phrases of a word less is walked, and
where one follows another a word before it, the state row · words + word is counted. The passes
over the texts are thus a fixed number, whatever the number of candidates.

Frequent words and phrases are counted before they are collected for the tries. Beyond the
bounds, phrases of every length are counted by shuffling them instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codemix.llm.common import ascii_lower, bounded_batches, written
from codemix.llm.double_array import DoubleArray

LEAST = 100
LONGEST = 5
TOP = 2000
NO_LANGUAGE = "und"
#: Most frequent words, and bytes of them, and most frequent phrases of a length that are collected.
MAX_WORDS = 2_000_000
MAX_WORD_BYTES = 64 << 20
MAX_PHRASES = 3_000_000
#: Most candidates in a trie, and most tries for a length; each trie is a pass over the numbered texts.
TRIE = 500_000
TRIES = 8
#: Buckets of hashes of candidates.
BUCKETS = 1 << 20
#: Pairs or positions that a task gathers before it counts them.
_BLOCK = 1 << 20
_BREAKS = "[.,;:!?\\x0A-\\x0D]"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower case, a line end for every separator of pieces, a blank for a tab.
_TABLE = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 9 + b" ")


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of all words of some texts in a row, and the distinct words; a piece ends with
    a line end, which is no word."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    raw = b"\n".join(pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist())
    raw = raw.translate(_TABLE).replace(b"\n", b" \n ")
    whole = pa.Array.from_buffers(
        pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)]
    )
    coded = pc.split_pattern(whole, " ").flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    return codes[codes != blank] if blank >= 0 else codes, coded.dictionary


def _by_language(batch: pa.RecordBatch):
    langs = pc.fill_null(batch.column(0), NO_LANGUAGE)
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.column(1).filter(pc.equal(langs, lang))


def _source(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    bounded_batches(df.sparkSession, "4m")
    return df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def word_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, f) over all texts, and a row with a null word for all words of a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches):
        for batch in batches:
            for lang, texts in _by_language(batch):
                codes, distinct = _words(texts)
                f = np.bincount(codes, minlength=len(distinct))
                word = pc.not_equal(distinct, "\n").to_numpy(zero_copy_only=False) & (f > 0)
                f = f[word]
                names = pa.concat_arrays([distinct.filter(pa.array(word)).cast(pa.string()), pa.array([None], pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), names, pa.array(np.r_[f, f.sum()])], schema=schema
                )

    rows = _source(df, lang_col, text_col).mapInArrow(run, "lang string, word string, f long")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(source: DataFrame, words: dict[str, tuple[int, pa.Array]]) -> DataFrame:
    """Texts as numbers of frequent words; runs of zeros are one zero, and a word without a
    frequent neighbour is one too, as no phrase holds it."""
    shared = source.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            found = [np.zeros(1, np.int32)]
            for lang, texts in _by_language(batch):
                if lang not in shared.value:
                    continue
                first, known = shared.value[lang]
                codes, distinct = _words(texts)
                place = pc.fill_null(pc.index_in(distinct.cast(pa.string()), known), -first)
                found += [(place.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(first))[codes], found[0]]
            x = np.concatenate(found)
            beside = np.r_[False, x[:-1] > 0] | np.r_[x[1:] > 0, False]
            x = np.where(beside, x, 0)
            x = x[(x > 0) | np.r_[True, x[:-1] > 0]]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))], ["x"]
            )

    return written(source.mapInArrow(run, "x array<int>"), "phrases-numbered")


def _arrays(batches):
    """The numbered texts of a task in blocks, a zero behind each."""
    kept, size = [], 0
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        kept, size = [*kept, x, np.zeros(1, np.int32)], size + len(x)
        if size >= _BLOCK:
            yield np.concatenate(kept)
            kept, size = [], 0
    if kept:
        yield np.concatenate(kept)


def _counted(numbered: DataFrame, run, least: int) -> DataFrame:
    """Frequent (key, f) from the counts of all tasks."""
    rows = numbered.mapInArrow(run, "key long, f long")
    return rows.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _rows(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(f.astype(np.int64))], ["key", "f"])


def _pairs(numbered: DataFrame, words: int, least: int) -> DataFrame:
    """Frequent pairs: the key is the state first · (words + 1) + second of the complete trie."""
    def run(batches):
        for x in _arrays(batches):
            both = (x[:-1] > 0) & (x[1:] > 0)
            yield _rows(*np.unique(x[:-1][both].astype(np.int64) * (words + 1) + x[1:][both], return_counts=True))

    return _counted(numbered, run, least)


def _in_trie(numbered: DataFrame, candidates: np.ndarray, words: int, least: int) -> DataFrame:
    """Frequent candidates: the key is the row of the matrix."""
    trie = numbered.sparkSession.sparkContext.broadcast(DoubleArray(candidates, words))
    n = len(candidates)

    def run(batches):
        total = np.zeros(n, np.int64)
        for x in _arrays(batches):
            total += trie.value.count(x, n)
        reached = np.flatnonzero(total)
        yield _rows(reached, total[reached])

    return _counted(numbered, run, least)


def _bucket(head: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a frequent phrase, by its row, and the word behind it."""
    mixed = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(24)).astype(np.int64) % buckets


def _full_buckets(numbered: DataFrame, frequent: np.ndarray, words: int, least: int) -> np.ndarray:
    """Which buckets have ``least`` places or more where a frequent phrase follows one a word
    before it: a flag for each."""
    trie = numbered.sparkSession.sparkContext.broadcast(DoubleArray(frequent, words))
    length, buckets = frequent.shape[1], BUCKETS

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for x in _arrays(batches):
            at, row = trie.value.occurrences(x)
            follows = np.flatnonzero(np.diff(at) == 1)
            total += np.bincount(_bucket(row[follows], x[at[follows] + length], buckets), minlength=buckets)
        reached = np.flatnonzero(total)
        yield _rows(reached, total[reached])

    full = np.zeros(buckets, bool)
    # at most as many rows as there are buckets
    full[_counted(numbered, run, least).toArrow().column(0).to_numpy()] = True
    return full


def _extended(numbered: DataFrame, frequent: np.ndarray, words: int, least: int, full: np.ndarray | None) -> DataFrame:
    """Frequent phrases of a word more, counted where a frequent phrase follows one a word before
    it: the key is the row of the first · (words + 1) + the last word."""
    trie = numbered.sparkSession.sparkContext.broadcast(DoubleArray(frequent, words))
    length = frequent.shape[1]

    def run(batches):
        for x in _arrays(batches):
            at, row = trie.value.occurrences(x)
            follows = np.flatnonzero(np.diff(at) == 1)
            head, last = row[follows].astype(np.int64), x[at[follows] + length].astype(np.int64)
            if full is not None:
                likely = full[_bucket(head, last, len(full))]
                head, last = head[likely], last[likely]
            yield _rows(*np.unique(head * (words + 1) + last, return_counts=True))

    return _counted(numbered, run, least)


def _overlaps(frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the sorted matrix the range of rows that begin with its last words but one."""
    n = len(frequent)
    # a number for every distinct sequence of k - 1 words, in the order of the first ones
    both = np.concatenate([frequent[:, :-1], frequent[:, 1:]])
    number = np.unique(both, axis=0, return_inverse=True)[1].reshape(-1)
    head, tail = number[:n], number[n:]
    return np.searchsorted(head, tail, side="left"), np.searchsorted(head, tail, side="right")


def candidates(frequent: np.ndarray, most: int, full: np.ndarray | None = None):
    """Blocks of at most about ``most`` sequences whose first and last words but one are rows
    of the sorted matrix, and whose buckets are full."""
    n = len(frequent)
    low, high = _overlaps(frequent)
    ends = np.cumsum(high - low)
    begin = 0
    while begin < n:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        counts = (high - low)[begin:end]
        left = np.repeat(np.arange(begin, end), counts)
        right = np.arange(counts.sum()) + np.repeat(low[begin:end] - (np.cumsum(counts) - counts), counts)
        if full is not None:
            likely = full[_bucket(left, frequent[right, -1], len(full))]
            left, right = left[likely], right[likely]
        if len(left):
            yield np.concatenate([frequent[left], frequent[right, -1:]], axis=1)
        begin = end


def _gathered(blocks, most: int):
    """Small blocks of rows put together up to a size."""
    kept, size = [], 0
    for block in blocks:
        if kept and size + len(block) > most:
            yield np.concatenate(kept)
            kept, size = [], 0
        kept.append(block)
        size += len(block)
    if kept:
        yield np.concatenate(kept)


def _sorted(rows: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(rows.T[::-1])
    return rows[order], f[order]


def _by_tries(source: DataFrame, frequent_words: DataFrame, least: int, longest: int) -> DataFrame | None:
    """(lang, k, phrase, f) of all frequent phrases of two words and more; None beyond the bounds."""
    spark = source.sparkSession
    size = frequent_words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if size[0] > MAX_WORDS or size[1] > MAX_WORD_BYTES:
        return None
    listed = frequent_words.select("lang", "word").orderBy("lang", "word").toArrow()
    langs, names = listed.column(0).to_pylist(), listed.column(1).to_pylist()
    total, words, first = len(names), {}, 0
    for lang in dict.fromkeys(langs):
        n = langs.count(lang)
        words[lang] = first + 1, pa.array(names[first:first + n], pa.string())
        first += n
    numbered = _numbered(source, words)

    def collected(found: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
        found = written(found, "phrases-found")
        if found.count() > MAX_PHRASES:
            return None
        table = found.toArrow()
        return table.column(0).to_numpy(), table.column(1).to_numpy()

    levels, rows, spelled = [], None, pa.array(names, pa.string())
    for k in range(2, longest + 1):
        if k == 2:
            found = collected(_pairs(numbered, total, least))
            if found is None:
                return None
            rows, f = np.stack([found[0] // (total + 1), found[0] % (total + 1)], axis=1), found[1]
        else:
            parts, counts, size = [], [], 0
            low, high = _overlaps(rows)
            # buckets that get many times ``least`` places on the average leave nothing out
            crowded = int(f.sum()) > BUCKETS * least
            many = int((high - low).sum()) > TRIES * TRIE
            full = None if many and crowded else _full_buckets(numbered, rows, total, least)
            if many:
                found = collected(_extended(numbered, rows, total, least, full))
                if found is None:
                    return None
                parts = [np.concatenate([rows[found[0] // (total + 1)], found[0][:, None] % (total + 1)], axis=1)]
                counts = [found[1]]
            for block in () if many else _gathered(candidates(rows, TRIE, full), TRIE):
                found = collected(_in_trie(numbered, block, total, least))
                size += MAX_PHRASES + 1 if found is None else len(found[0])
                if size > MAX_PHRASES:
                    return None
                parts, counts = [*parts, block[found[0]]], [*counts, found[1]]
            rows = np.concatenate(parts) if parts else np.zeros((0, k), np.int64)
            f = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        rows, f = _sorted(rows, f)
        if not len(rows):
            break
        columns = [spelled.take(pa.array(rows[:, j] - 1)) for j in range(k)]
        levels.append(pa.table({
            "lang": pa.array(langs, pa.string()).take(pa.array(rows[:, 0] - 1)), "k": pa.array(np.full(len(rows), k, np.int32)),
            "phrase": pc.binary_join_element_wise(*columns, " "), "f": pa.array(f.astype(np.int64)),
        }))
    if not levels:
        return spark.createDataFrame([], "lang string, k int, phrase string, f long")
    return spark.createDataFrame(pa.concat_tables(levels))


def _by_shuffle(source: DataFrame, least: int, longest: int) -> DataFrame:
    """The same, counted by shuffling all phrases of each length."""
    pieces = F.split(ascii_lower(F.coalesce("text", F.lit(""))), _BREAKS, -1)
    words = source.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.explode(pieces).alias("piece")).select(
        "lang", F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("words")
    )
    levels = None
    for k in range(2, longest + 1):
        places = F.sequence(F.lit(1), F.size("words") - k + 1)
        phrases = words.where(F.size("words") >= k).select("lang", "words", F.explode(places).alias("at")).select(
            "lang", F.lit(k).alias("k"), F.array_join(F.slice("words", F.col("at"), F.lit(k)), " ").alias("phrase")
        )
        counted = phrases.groupBy("lang", "k", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)
        levels = counted if levels is None else levels.union(counted)
    return levels


def _exact(c: str) -> Column:
    """Products of three counts fit into 38 digits."""
    return F.col(c).cast("decimal(18,0)")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of frequent phrases (lang, k, phrase, f), single
    words among them, without those inside a longer one that is as frequent."""
    longer = phrases.where("k > 1")
    cuts = longer.select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"),
        F.expr("substring_index(phrase, ' ', cut - k)").alias("tail"),
    )
    part = lambda of, f: phrases.select("lang", F.col("phrase").alias(of), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    score = F.expr(
        "(1000 * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    )
    weakest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("w")
    ).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")
    # a phrase inside a longer one that is as frequent is inside one of a word more that is
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    held = longer.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("held")
    )
    return weakest.join(held, ["lang", "phrase"], "left").where("held is null or held < a").drop("held")


def mine(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``longest`` words and occur ``least`` times or more. Null texts are empty; a null
    language is ``und``; repeated rows count each time; ids and other columns are ignored; texts without a frequent phrase
    and empty tables give no rows. Equal scores go by frequency, then by the phrase's bytes.
    """
    source = _source(df, lang_col, text_col)
    counted = written(
        word_counts(source).where(F.col("word").isNull() | (F.col("f") >= least)), "phrases-words"
    )
    frequent = counted.where(F.col("word").isNotNull())
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    longer = _by_tries(source, frequent, least, longest)
    if longer is None:
        longer = _by_shuffle(source, least, longest)
    words = frequent.select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f")
    phrases = written(words.union(longer.select("lang", F.col("k").cast("int"), "phrase", "f")), "phrases-frequent")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(phrases, totals).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
