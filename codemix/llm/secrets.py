"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings.

One pass over the texts yields the matches of every pattern with the lengths of
the gaps before them; running sums of those give offsets in code points.
Candidate strings, runs of at least ``WINDOW`` characters of an encoding's
alphabet that hold a digit and a letter, go on character by character: the
Shannon entropy of a window is log2(W) - S / W with S the sum of c * log2(c) over
the counts c of its characters, and a step of the window changes S only by the
character that enters and the one that leaves. Both counts come from a frame over
equal characters, so a window costs the same whatever its length. The class of
characters, and with it the threshold, is that of the window: hex inside a section
of hex digits, as behind a name, else base64. Windows above the threshold that neither an allowed
part of the candidate nor a pattern's match overlaps are reported, for each class those that adjoin as one span.

Everything is made of DataFrame operations; windows run inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.llm.common import ROW, keyed, written

ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
WINDOW = 20
_ALPHABET = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_ALPHABET}){_ALPHABET}{{{WINDOW},}}"

BASE_KINDS = ["assign", "access", "hex"]
#: Added kinds with the sections of a candidate that their windows lie in and the least entropy in bits.
CLASSES = {
    "entropy_hex": (
        rf"(?<![0-9A-Fa-f])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{{{WINDOW},}}", 2.8
    ),
    "entropy_base64": (".+", 3.75),
}
KINDS = [*BASE_KINDS, *CLASSES]
#: Whole candidates that are no secrets: UUIDs, alphabets, a documented sample key, paths and names.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)^abcdefghijkl[m-z]*(abcdefghijkl[m-z]*)?(0123456789)?[+/_=-]*$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
    # no repeated group: Java's regular expressions recurse for each repetition
    r"^(?!.*[/_-]{2})/?[a-z]+[/_-][a-z/_-]*[0-9]{0,4}$",
]
#: Parts of candidates that are no secrets: alphabets, placeholders, integrity hashes. What is left
#: of the candidate is scored. A window with five x in it is below the thresholds anyway.
ALLOWED_PARTS = [
    r"(?i:abcdefghijkl[m-z]*|0123456789|example|placeholder)",
    r"^sha256-(?:[0-9A-Fa-f]{64}|[A-Za-z0-9+/]{43}=?)",
    r"^sha384-(?:[0-9A-Fa-f]{96}|[A-Za-z0-9+/]{64})",
    r"^sha512-(?:[0-9A-Fa-f]{128}|[A-Za-z0-9+/]{86}={0,2})",
]


def _matches(text: Column, pattern: str, present: Column, group: int = 0) -> Column:
    """Matches of a pattern; texts without a part that every match has are not searched."""
    none = F.array().cast("array<string>")
    return F.when(present, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def _found(kind: str, matches: Column, gaps: Column, value: Column) -> Column:
    """Structs of one kind. The last gap follows the last match and has no match."""
    return F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"), value.alias("v")),
        lambda x, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("k"),
            F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"),
            x["v"].alias("value"),
        ),
    )


def _pattern_matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each match, and one with a null kind for a text without any."""
    docs = keyed(df, doc_id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")))
    text, low = F.col("text"), F.lower("text")
    words = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    named = F.lit(False)
    for word in words:
        named = named | low.contains(word)
    always = F.lit(True)
    docs = docs.select(
        "*", _matches(text, ASSIGN, named).alias("assign"),
        _matches(text, ACCESS, text.contains("AKIA")).alias("access"),
        _matches(text, HEX, always).alias("hex"), _matches(text, CANDIDATE, always).alias("candidate"),
    )
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    arrays = []
    for kind, pattern in patterns.items():
        matches = F.col(kind)
        gaps = F.split(text, pattern, -1)
        value = matches
        if kind == "assign":
            value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        found = _found(kind, matches, gaps, value)
        arrays.append(F.when(F.size(matches) > 0, found))
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,len:int,value:string>>")
    return docs.select(
        ROW, "doc_id", F.inline_outer(F.concat(*[F.coalesce(a, none) for a in arrays]))
    )


def _weight(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def _marks(value: Column, pattern: str) -> Column:
    """For each character whether it is part of a match: x if so, a dot if not."""
    parts = F.arrays_zip(
        F.split(value, pattern, -1).alias("gap"),
        F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("match"),
    )
    marks = F.transform(parts, lambda p: F.concat(
        F.repeat(F.lit("."), F.char_length(p["gap"])),
        F.repeat(F.lit("x"), F.coalesce(F.char_length(p["match"]), F.lit(0))),
    ))
    return F.split(F.array_join(marks, ""), "")


def _entropy_windows(candidates: DataFrame) -> DataFrame:
    """The windows above the threshold of their class, without those that hold an allowed part."""
    value = F.col("value")
    suspects = candidates.where(
        value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & ~value.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    )
    characters = suspects.select(
        ROW, "doc_id", "k", "start", F.posexplode(F.arrays_zip(
            F.split(value, "").alias("ch"), _marks(value, CLASSES["entropy_hex"][0]).alias("hex"),
            _marks(value, "|".join(ALLOWED_PARTS)).alias("allowed"),
        )).alias("i", "at"),
    ).select(
        ROW, "doc_id", "k", "start", "i", F.col("at.ch").alias("ch"),
        (F.col("at.hex") == "x").alias("hex"), (F.col("at.allowed") == "x").alias("allowed"),
    )
    same = Window.partitionBy(ROW, "k", "ch").orderBy("i")
    entering = F.count("*").over(same.rangeBetween(1 - WINDOW, 0))
    leaving = F.count("*").over(same.rangeBetween(0, WINDOW - 1))
    steps = characters.select(
        "*", (_weight(entering) - _weight(entering - 1)).alias("gain"),
        (_weight(leaving) - _weight(leaving - 1)).alias("loss"),
    )
    along = Window.partitionBy(ROW, "k").orderBy("i")
    total = F.sum("gain").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(
        F.sum("loss").over(along.rowsBetween(Window.unboundedPreceding, -WINDOW)), F.lit(0.0)
    )
    entropy = F.log2(F.lit(float(WINDOW))) - total / WINDOW
    window = along.rowsBetween(1 - WINDOW, 0)
    kind = F.when(F.min("hex").over(window), F.lit("entropy_hex")).otherwise(F.lit("entropy_base64"))
    least = F.lit(None).cast("double")
    for name, (_, bits) in CLASSES.items():
        least = F.when(F.col("kind") == name, F.lit(bits)).otherwise(least)
    return (
        steps.select("*", entropy.alias("entropy"), kind.alias("kind"), F.max("allowed").over(window).alias("touched"))
        .where((F.col("i") >= WINDOW - 1) & ~F.col("touched") & (F.col("entropy") >= least))
        .select(
            ROW, "doc_id", (F.col("start") + F.col("i") - WINDOW + 1).alias("start"),
            (F.col("start") + F.col("i") + 1).alias("end"), "kind",
        )
    )


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text: doc_id, kind, start, end per row of the input.

    A row of the result has the input row's key and the array ``spans`` of (start,
    order of kind, kind, end), sorted; offsets count code points, ends exclusive.
    A null or empty text has no span, a null or repeated id or a repeated row
    keeps its own result, extra columns are ignored, an empty table gives none. A text is
    searched whole; its candidates' characters, a row each, are sorted in one task.
    """
    # stored, as several parts of the plan go on from it and the texts should be searched once
    found = written(_pattern_matches(df, id_col, text_col), "secrets").repartition(F.col(ROW))
    running = Window.partitionBy(ROW, "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running)).withColumn(
        "start", F.col("end") - F.col("len")
    )
    # A failing match is dropped after the search: it has used up its characters.
    base = placed.where("kind is null or kind != 'candidate'").select(
        ROW, "doc_id", "start", "end",
        F.when((F.col("kind") != "assign") | (F.char_length("value") >= 8), F.col("kind")).alias("kind"),
    )
    texts = placed.where("kind = 'candidate'")
    added = _entropy_windows(texts)
    # Every text needs a row, also when all it has are candidates below the threshold.
    bare = texts.select(
        ROW, "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("kind", "string"))]
    )
    spans = base.unionByName(added).unionByName(bare)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    is_base = F.col("kind").isin(BASE_KINDS)
    along = Window.partitionBy(ROW).orderBy(F.col("start").asc_nulls_first(), F.col("kind"))
    ended = F.max(F.when(is_base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    # the spans behind, as a frame that grows: one that shrinks is summed up anew for every row
    back = Window.partitionBy(ROW).orderBy(F.col("start").desc_nulls_last(), F.col("kind").desc())
    begins = F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (
        begins.isNull() | (begins >= F.col("end"))
    )
    spans = spans.withColumn("kind", F.when(is_base | free, F.col("kind")))
    # windows that adjoin or overlap make one span; each match of a pattern is its own
    group = Window.partitionBy(ROW, "kind").orderBy("start")
    apart = is_base | F.coalesce(F.col("start") > F.lag("end").over(group), F.lit(True))
    spans = spans.withColumn("apart", apart.cast("int")).withColumn(
        "group", F.sum("apart").over(group.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy(ROW, "kind", "group").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end")
    ).withColumn("order", order)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "order", "kind", "end"))
    return spans.groupBy(ROW).agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per pattern, a digest of the patterns' spans, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
