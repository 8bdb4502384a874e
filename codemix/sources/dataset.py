"""Reading and writing the dataset as JSON, JSON lines, CSV and parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix import schema
from codemix.session import with_computed
from codemix.sources import ranges

# A JSON line holds at most this many utterances; a longer conversation goes
# on in further lines, so no task ever gathers a whole one.
LINE_UTTERANCES = 4096
#: What a stored utterance has; those of a table without some of the last three go without them.
_STORED = [
    "speaker", "text", "original_text", "tokens", "tagged_tokens", "tokens_list", "pos_tags", "has_code_switch",
    "spanish_percentage",
]
_LISTS = {"tagged_tokens", "tokens_list", "pos_tags"}


def _pairs(stored: Column) -> Column:
    """Two-element arrays to structs; anything else is dropped as malformed."""
    return F.transform(
        F.filter(stored, lambda t: F.size(t) == 2),
        lambda t: F.struct(t[0].alias("token"), t[1].alias("lang")),
    )


def _stored(tagged: Column) -> Column:
    return F.transform(tagged, lambda t: F.array(t["token"], t["lang"]))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document `{metadata, conversations}` in one row, read by one task.

    For small documents; :func:`read_document_conversations` reads one of any size by many tasks.
    """
    return spark.read.schema(schema.DOCUMENT).option("multiLine", True).json(path)


def document_metadata(document: DataFrame) -> DataFrame:
    return document.select("metadata.*")


def document_conversations(document: DataFrame) -> DataFrame:
    """One row per conversation with its position and its utterance array."""
    return document.select(F.posexplode("conversations").alias("conv_pos", "c")).select(
        F.col("conv_pos").cast("bigint").alias("conv_pos"), F.lit(0).cast("bigint").alias("part"),
        "c.*",
    )


def read_document_conversations(spark: SparkSession, path: str) -> DataFrame:
    """The conversations of one JSON document as of :func:`document_conversations`, read by as
    many tasks as the file has splits; a conversation is read by one."""
    elements = ranges.json_elements(spark, path, "conversations")
    return elements.select(
        F.col("position").cast("bigint").alias("conv_pos"), F.lit(0).cast("bigint").alias("part"),
        F.from_json("element", schema.STORED_CONVERSATION).alias("c"),
    ).select("conv_pos", "part", "c.*")


def read_document_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of one JSON document, without reading its conversations into one row."""
    return ranges.json_object(spark, path, "metadata").select(
        F.from_json("element", schema.METADATA).alias("m")
    ).select("m.*")


def headers(conversations: DataFrame) -> DataFrame:
    """One row per conversation: of one that goes on in further lines only the first."""
    if "part" not in conversations.columns:
        return conversations
    return conversations.filter(F.coalesce("part", F.lit(0)) == 0)


def flatten(conversations: DataFrame) -> DataFrame:
    """Utterance rows in canonical form; `utt_idx` is the place in the conversation.

    Lines of other writers have no `part`: each is a whole conversation.
    """
    there = conversations.schema["utterances"].dataType.elementType.names
    stored = [
        _pairs(F.col("u.tagged_tokens")).alias(c) if c == "tagged_tokens" else F.col(f"u.{c}")
        for c in _STORED if c in there or c not in _LISTS
    ]
    return conversations.select(
        "conv_pos", F.coalesce("part", F.lit(0)).alias("part"), "conversation_id", "strategy", "topic",
        F.posexplode("utterances").alias("place", "u"),
    ).select(
        "conv_pos", "conversation_id",
        (F.col("part") * LINE_UTTERANCES + F.col("place")).cast("int").alias("utt_idx"),
        *stored, "strategy", "topic",
    )


def flatten_tokens(utterances: DataFrame) -> DataFrame:
    """One row per token."""
    rows = with_computed(
        utterances.select("conv_pos", "utt_idx", "tagged_tokens"), tagged=F.col("tagged_tokens")
    )
    return rows.select(
        "conv_pos", "utt_idx", F.posexplode("tagged").alias("pos", "t")
    ).select("conv_pos", "utt_idx", "pos", "t.token", "t.lang")


def nest(utterances: DataFrame, packed: bool = False) -> DataFrame:
    """Conversation lines with their utterances in order. The lists of tokens make up most of what is
    shuffled: drop those columns first if the lines are read without them, or have them `packed` on the way.
    """
    names = [c for c in _STORED if c in utterances.columns or c not in _LISTS]
    lists = [c for c in names if packed and c in _LISTS]
    others = [c for c in names if c not in lists]
    stored = [_stored(F.col(c)).alias(c) if c == "tagged_tokens" else F.col(c) for c in others]
    in_order = F.array_sort(F.collect_list("u"))
    if lists:
        parts = _parts(lists)
        stored += [x.alias(f"{name}_{kind}") for name, c in parts.items() for kind, x in _as_text(name, c, parts)]
        # two steps: an expression inside a higher-order function is evaluated again wherever it is written
        read = F.transform(in_order, lambda u: F.struct(
            *[u[c].alias(c) for c in others], *[_of_text(u, name).alias(f"_{name}") for name in parts],
            *([u["tokens_list_same"].alias("same")] if _SAME <= parts.keys() else []),
        ))
        nested = F.transform(read, lambda u: F.struct(*[_whole(u, c, parts).alias(c) if c in lists else u[c].alias(c) for c in names]))
    else:
        nested = F.transform(in_order, lambda u: u.dropFields("utt_idx"))
    row = utterances.select(
        "conv_pos", F.floor(F.col("utt_idx") / LINE_UTTERANCES).alias("part"),
        "conversation_id", "strategy", "topic", F.struct("utt_idx", *stored).alias("u"),
    )
    return row.groupBy("conv_pos", "part").agg(
        F.any_value("conversation_id").alias("conversation_id"),
        F.any_value("strategy").alias("strategy"), F.any_value("topic").alias("topic"),
        nested.alias("utterances"),
    )


_SEPARATOR = "\u0001"
_SAME = {"token", "tokens_list"}


def _parts(lists: list[str]) -> dict[str, Column]:
    """The lists of strings that the stored lists are made of."""
    parts = {}
    for c in lists:
        parts |= {"token": F.col(c)["token"], "lang": F.col(c)["lang"]} if c == "tagged_tokens" else {c: F.col(c)}
    return parts


def _as_text(name: str, c: Column, parts: dict[str, Column]):
    """A list joined to one text, or as it is where it can't be split again. As an array every string takes 16 bytes or more.
    A list that repeats the tokens is left out."""
    text = F.array_join(c, _SEPARATOR)
    fits = F.coalesce(F.split(text, _SEPARATOR) == c, F.lit(False))
    if name == "tokens_list" and _SAME <= parts.keys():
        same = F.coalesce(parts["token"] == c, F.lit(False))
        return ("same", same), ("text", F.when(~same & fits, text)), ("raw", F.when(~same & ~fits, c))
    return ("text", F.when(fits, text)), ("raw", F.when(~fits, c))


def _of_text(u: Column, name: str) -> Column:
    return F.coalesce(F.split(u[f"{name}_text"], _SEPARATOR), u[f"{name}_raw"])


def _whole(u: Column, name: str, parts: dict[str, Column]) -> Column:
    if name == "tagged_tokens":
        return F.zip_with(u["_token"], u["_lang"], lambda token, lang: F.array(token, lang))
    if name == "tokens_list" and _SAME <= parts.keys():
        return F.when(u["same"], u["_token"]).otherwise(u["_tokens_list"])
    return u[f"_{name}"]


def write_conversations(
    utterances: DataFrame, path: str, conversations: DataFrame | None = None, compression: str | None = None,
) -> None:
    """JSON lines, UTF-8, non-ASCII characters kept; plain unless a `compression` that Spark knows is named.

    `conversations` has the headers; those without any utterance get a line too.
    """
    lines = nest(utterances, packed=True)
    if conversations is not None:
        header = headers(conversations).select("conv_pos", "conversation_id", "strategy", "topic")
        empty = header.join(utterances.select("conv_pos").distinct(), "conv_pos", "left_anti")
        none = F.array().cast(lines.schema["utterances"].dataType)
        lines = lines.unionByName(
            empty.withColumns({"part": F.lit(0).cast("bigint"), "utterances": none})
        )
    lines.write.mode("overwrite").json(path, compression=compression)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CONVERSATION_LINE).json(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """The one metadata row, next to the conversations."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.METADATA).json(path)


def write_export(export: DataFrame, path: str) -> None:
    """CSV with header, quotes only where needed and doubled inside; blanks at edges stay."""
    export.write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Empty cells come back as NULL. A file is read by as many tasks as it has splits, also
    if its cells hold line ends."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.EXPORT.fields)
    cells = F.from_csv("record", columns, {
        "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    })
    return ranges.csv_records(spark, path).select(cells.alias("row")).select("row.*")


def output_path(path: str, step: str) -> str:
    """Path of a step's output: `data.json` and `fixed` give `data_fixed.json`."""
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_{step}.{ending}" if dot and "/" not in ending else f"{path}_{step}"
