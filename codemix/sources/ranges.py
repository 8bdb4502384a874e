"""One large JSON document or CSV file read by many tasks.

Spark cuts a file at any separator, also inside a quoted cell or a string. What a piece means
depends on all before it, but only through little: whether it begins inside quotes, and how
many objects are open. Each piece is judged for both beginnings at once; sums over a split and
then over the splits of a file tell which of them holds. Pieces of a record are put together by
the record's number, so no task needs more than one split or one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codemix.operators import prefix_sums as P
from codemix.session import written

_BLOCK = ["file", "block"]


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """`value, file, block, at`: pieces between separators, the start of the split they were read
    in, and their order in it."""
    return spark.read.text(path, lineSep=separator).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )


def _in_block() -> Window:
    return Window.partitionBy(*_BLOCK).orderBy("at")


def _before(value: Column) -> Column:
    """The sum of the rows before in the split."""
    return F.coalesce(F.sum(value).over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _blocks_before(value: Column) -> Column:
    """The sum of the file's splits before: one row per split."""
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(along), F.lit(0))


def _number_of(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def _odd(c: Column) -> Column:
    return c % 2 == 1


def _counted(batches):
    """Lines with `odd` (as the number of quotes before in the split) and the records begun up to
    the line, if the split begins `outside` quotes, and if `inside`. A task reads a split in order."""
    split, carried = None, [0, 0, 0]
    for batch in batches:
        if not len(batch):
            continue
        block, quotes = (batch.column(c).to_numpy() for c in ("block", "quotes"))
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
        begin, here = np.r_[0, cuts, len(batch)], (batch.column("file")[0].as_py(), block[0])
        if here != split:
            carried = [0, 0, 0]

        def running(values, k):
            sums = P.running(values, begin).astype(np.int64)
            sums[:begin[1]] += carried[k]
            return sums

        up_to = running(quotes, 0)
        odd = (up_to - quotes) % 2 == 1
        outside, inside = running(~odd, 1), running(odd, 2)
        split, carried = (batch.column("file")[-1].as_py(), block[-1]), [up_to[-1], outside[-1], inside[-1]]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(odd), pa.array(outside), pa.array(inside)],
            [*batch.schema.names, "odd", "outside", "inside"],
        )


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """`file, number, record`: the records of CSV files whose quoted cells may hold line ends.

    A line begins a record if the quotes before it are even in number, and is a whole one if its own are, too:
    only lines of other records are shuffled. Blank records and, with `header`, the first of each file are left out.
    """
    lines = _pieces(spark, path, "\n").withColumn("quotes", _number_of(F.col("value"), '"'))
    lines = lines.mapInArrow(
        _counted, "value string, file string, block long, at long, quotes int, odd boolean, outside long, inside long"
    )
    lines = written(lines, "csv-lines")
    blocks = lines.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.max("outside").alias("outside"), F.max("inside").alias("inside")
    ).withColumn("open", _odd(_blocks_before(F.col("quotes"))))
    begun = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    blocks = blocks.select(*_BLOCK, "open", _blocks_before(begun).alias("begun"))
    # one row per split
    numbered = lines.join(F.broadcast(blocks), _BLOCK).select(
        "file", "block", "at", "value", (F.col("begun") + begun).alias("number"),
        ((F.col("odd") == F.col("open")) & ~_odd(F.col("quotes"))).alias("whole"),
    )
    record = lambda c: F.regexp_replace(c, r"\r$", "").alias("record")
    records = numbered.filter("whole").select("file", "number", record(F.col("value"))).unionByName(
        numbered.filter(~F.col("whole")).groupBy("file", "number").agg(
            F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines")
        ).select("file", "number", record(F.array_join("lines.value", "\n")))
    )
    return records.filter((F.col("record") != "") & (F.col("number") > (1 if header else 0)))


def _json_groups(spark: SparkSession, path: str) -> DataFrame:
    """`file, number, text, opened, closed`: the document cut behind every `}` that leaves two open
    levels or fewer; the levels open before and after."""
    escaped = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = _pieces(spark, path, "}").withColumn("plain", escaped).withColumn("quotes", _number_of(F.col("plain"), '"'))

    def judged(inside: bool) -> Column:
        """The change of open levels, and whether the piece's `}` closes one."""
        text = F.concat(F.lit('"'), F.col("plain")) if inside else F.col("plain")
        bare = F.regexp_replace(F.regexp_replace(text, r'"[^"]*"', ""), r'"[^"]*$', "")
        closes = (F.col("quotes") + int(inside)) % 2 == 0
        change = _number_of(bare, "{[") - _number_of(bare, "]") - closes.cast("int")
        return F.struct(change.alias("change"), closes.alias("closes"))

    pieces = pieces.select("value", *_BLOCK, "at", "quotes", judged(False).alias("j0"), judged(True).alias("j1"))
    pieces = pieces.withColumn("odd", _odd(_before(F.col("quotes"))))
    # by what the split begins with, no more by what the piece does
    pieces = pieces.select(
        "value", *_BLOCK, "at", "quotes", F.when(F.col("odd"), F.col("j1")).otherwise(F.col("j0")).alias("outside"),
        F.when(F.col("odd"), F.col("j0")).otherwise(F.col("j1")).alias("inside"),
    ).withColumns({"before_outside": _before(F.col("outside.change")), "before_inside": _before(F.col("inside.change"))})
    pieces = written(pieces, "json-pieces")

    def either(outside: str, inside: str) -> Column:
        return F.when(F.col("open"), F.col(inside)).otherwise(F.col(outside))

    blocks = pieces.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.sum("outside.change").alias("outside"), F.sum("inside.change").alias("inside")
    ).withColumn("open", _odd(_blocks_before(F.col("quotes"))))
    blocks = blocks.select(*_BLOCK, "open", _blocks_before(either("outside", "inside")).alias("levels"))
    opened = F.col("levels") + either("before_outside", "before_inside")
    known = pieces.join(blocks, _BLOCK).select(
        "value", *_BLOCK, "at", opened.alias("opened"), (opened + either("outside.change", "inside.change")).alias("closed"),
        either("outside.closes", "inside.closes").alias("closes"),
    ).withColumn("ends", F.col("closes") & (F.col("closed") <= 2))
    ended = known.groupBy(*_BLOCK).agg(F.count_if("ends").alias("n")).select(*_BLOCK, _blocks_before(F.col("n")).alias("earlier"))
    numbered = known.withColumn("here", _before(F.col("ends").cast("int"))).join(ended, _BLOCK).withColumn(
        "number", F.col("earlier") + F.col("here")
    )
    groups = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value", "opened", "closed"))).alias("pieces"),
        F.bool_or("ends").alias("whole"),
    ).filter("whole")
    return groups.select(
        "file", "number", F.concat(F.array_join("pieces.value", "}"), F.lit("}")).alias("text"),
        F.col("pieces")[0]["opened"].alias("opened"), F.element_at("pieces", -1)["closed"].alias("closed"),
    )


def _opening(key: str, bracket: str) -> str:
    return rf'"{key}"\s*:\s*\{bracket}'


def _turns() -> Column:
    """A group that doesn't go on in the container of the one before."""
    return (F.col("opened") < 2) | F.regexp_extract("text", r"^[^{]*", 0).rlike(r"[\[\]]")


def json_elements(spark: SparkSession, path: str, key: str) -> DataFrame:
    """`file, position, element`: the objects of the array under a key of the document, as text.

    One row per object, so that is what a task holds at least. Other things than objects in
    the array are left out and have no position.
    """
    groups = written(_json_groups(spark, path), "json-groups")
    turns = groups.filter((F.col("closed") < 2) | _turns())
    pattern = _opening(key, "[")
    arrays = turns.select(
        "file", F.col("number").alias("first"),
        ((F.col("closed") == 2) & F.col("text").rlike(pattern + r"\s*\{")).alias("wanted"),
        F.lead("number").over(Window.partitionBy("file").orderBy("number")).alias("until"),
    ).filter("wanted")
    inside = F.col("until").isNull() | (F.col("number") < F.col("until"))
    # a row per array under that key: one in a document
    rows = groups.filter("closed = 2").join(F.broadcast(arrays), "file").filter((F.col("number") >= F.col("first")) & inside)
    text = F.when(F.col("number") == F.col("first"), F.regexp_replace("text", r"(?s)^.*?" + pattern + r"\s*", "")).otherwise(
        F.regexp_replace("text", r"^[^{]*", "")
    )
    return rows.select("file", (F.col("number") - F.col("first")).alias("position"), text.alias("element"))


def json_object(spark: SparkSession, path: str, key: str) -> DataFrame:
    """`file, element`: the object under a key of the document, as text. It is small: one row holds it."""
    groups = written(_json_groups(spark, path), "json-groups")
    pattern = _opening(key, "{")
    begins = groups.filter(_turns() & F.col("text").rlike(pattern)).groupBy("file").agg(F.min("number").alias("first"))
    ends = groups.filter("closed < 2").join(F.broadcast(begins), "file").filter("number >= first").groupBy("file", "first").agg(
        F.min("number").alias("last")
    )
    rows = groups.join(F.broadcast(ends), "file").filter("number between first and last")
    return rows.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda g: g["text"]), "").alias("text")
    ).select("file", F.regexp_replace("text", r"(?s)^.*?" + pattern, "{").alias("element"))
