"""Sharding by sampled splitters: equal bytes, bounded work per range, dense slots.

Every record has the key (hash of the text, id, row), which no two records
share, and a size. A size-weighted sample of the keys gives quantiles, the
splitters of consecutive key ranges; the ranges' sizes are then summed over all
records. A shard boundary lies in one range. Such a range is overfull when it is
larger than the tolerance: it is sampled and subdivided again until it is not, or
until it is one record. Equal texts have neighbouring keys, so a group stays in
one shard unless a boundary has to cut it; a group of any size can be cut.

Only splitters and range sums reach the driver, a fixed number of them. The records themselves,
texts and all, then go to their shards in one exchange and are written there, a folder per shard;
sizes and checksums are those of the texts read back. Everything is made of DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from codemix.llm.common import ROW, keyed, remove, unsigned_hash, written
from codemix.session import drop_at_exit, shared_folder, tasks_for

LAW = "bytes"
KEY = ["h", "id", ROW]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _size(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("long")


def _key(id_col: str, text_col: str) -> dict[str, Column]:
    return {
        "id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
        "h": F.xxhash64(_text(F.col(text_col))),
    }


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Size, crc and key of every record, without its text, to find the boundaries by. Null texts are empty."""
    text = _text(F.col(text_col))
    return keyed(
        df, doc_id=F.col(id_col), size=_size(text), text_crc32=F.crc32(text.cast("binary")), **_key(id_col, text_col),
    )


def _range_of(keys: list[tuple]) -> Column:
    """The number of a record's range, found by binary search in the sorted splitters.

    Range i holds the keys from splitter i - 1 up to, but without, splitter i.
    """
    if not keys:
        return F.lit(0)
    splitters = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key)]) for key in keys
    ])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(keys).bit_length()))])
    key = F.struct(*KEY)
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(keys)) & (F.get(splitters, at + step - 1) <= key), at + step
        ).otherwise(at),
    )


def _sampled(records: DataFrame, keys: list[tuple], sizes: dict[int, int], ranges: int, sample: int, seed: int) -> list[tuple]:
    """New splitters: quantiles of a sample of each named range.

    A record is drawn by its share of its range's bytes. One larger than
    bytes / sample is always drawn and counts as its size, so about ``sample``
    records are drawn of each range, whatever the input's size.
    """
    step = F.get(
        F.array(*[F.lit(sizes.get(i, 0) / sample) for i in range(len(keys) + 1)]), F.col("range")
    )
    drawn = records.withColumn("range", _range_of(keys)).where(F.col("range").isin(list(sizes))).where(
        unsigned_hash(F.struct(*KEY, F.lit(seed))) * step < F.col("size")
    ).select("range", *KEY, F.greatest(F.col("size"), step).alias("weight"))
    whole = Window.partitionBy("range")
    ordered = whole.orderBy(*KEY)
    before = F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0.0)) * ranges / F.sum("weight").over(whole))
    placed = drawn.withColumn("part", part)
    first = placed.withColumn("last", F.lag("part", 1, 0).over(ordered)).where("part > last")
    return [tuple(r) for r in first.select(*KEY).collect()]


def _sums(records: DataFrame, keys: list[tuple]) -> list[int]:
    rows = records.groupBy(_range_of(keys).alias("range")).agg(F.sum("size").alias("size"))
    sums = {r["range"]: r["size"] for r in rows.collect()}
    return [sums.get(i, 0) for i in range(len(keys) + 1)]


def boundaries(
    records: DataFrame, total: int, shards: int, tolerance: float,
    ranges: int = 128, sample: int = 2048, rounds: int = 12,
) -> list[tuple]:
    """The splitters between shards, each off its exact place by less than the
    tolerance's share of a shard, or by one record."""
    allowed = tolerance * total / shards
    keys, overfull = [], {0: total}
    for seed in range(rounds):
        new = _sampled(records, keys, overfull, ranges, sample, seed)
        keys = sorted({*keys, *new})
        sums = _sums(records, keys)
        chosen, overfull, start, i = [], {}, 0, 0
        for s in range(1, shards):
            target = s * total / shards
            while i < len(keys) and start + sums[i] <= target:
                start, i = start + sums[i], i + 1
            near, far = target - start, start + sums[i] - target
            if min(near, far) > allowed:
                overfull[i] = sums[i]
            edge = i - 1 if near <= far else i
            chosen.append(keys[edge] if 0 <= edge < len(keys) else None)
        if not overfull or not new:  # without new keys each range left is one record or ties
            break
        # only the edges of overfull ranges and the boundaries are needed further on
        kept = sorted({k for k in chosen if k} | {k for i in overfull for k in keys[max(i - 1, 0):i + 1]})
        overfull = {kept.index(keys[i - 1]) + 1 if i else 0: size for i, size in overfull.items()}
        keys = kept
    else:
        raise RuntimeError(f"ranges are still overfull after {rounds} rounds: {sorted(overfull.values())[-3:]} bytes")
    return sorted({k for k in chosen if k})


def place(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
    tolerance: float = 0.001,
) -> tuple[DataFrame, str]:
    """Put all records, whole, into ``shards`` key ranges of nearly equal bytes and write them there.

    Returns the records read back, as record (all their columns), shard and slot (dense from 0
    within a shard, in key order), and the folder that holds them, a folder per shard in it. The
    folder goes when the application ends.
    """
    spark = df.sparkSession
    records = written(slim(df, id_col, text_col), "shard-keys")
    total = records.agg(F.sum("size")).first()[0] or 0
    keys = boundaries(records, total, shards, tolerance) if total else []

    # Slots: sort once, number each task's rows, and add the tasks' totals.
    order = ["shard", *KEY]
    placed = keyed(df, record=F.struct("*"), **_key(id_col, text_col)).withColumn("shard", _range_of(keys))
    ordered = placed.repartitionByRange(tasks_for(df), *order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()
    ).select("record", "place", "shard")
    path = shared_folder(spark, "shards")
    ordered.write.partitionBy("shard").parquet(path)
    drop_at_exit(spark, path)
    schema = StructType([
        StructField("record", ordered.schema["record"].dataType), StructField("place", LongType()), StructField("shard", IntegerType()),
    ])
    back = spark.read.schema(schema).parquet(path).withColumn("task", F.shiftrightunsigned("place", 33))
    parts = back.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "shard", "task",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"),
    )
    # One row per task and shard.
    return back.join(F.broadcast(offsets), ["shard", "task"]).select(
        "record", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot")
    ), path


def shard(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
    tolerance: float = 0.001,
) -> DataFrame:
    """Put all records, by id and text, into shards as of :func:`place`, and describe them as read back.

    Returns doc_id, size, text_crc32, law, shard, slot (dense from 0 within a
    shard, in key order) and grown_shard (null under this law). Null texts count
    as empty, null and repeated ids and repeated rows each keep their own record,
    extra columns are ignored, and an empty table gives no rows. With fewer
    records than shards some shards stay empty.
    """
    two = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed, _ = place(two, shards=shards, tolerance=tolerance)
    text = _text(F.col("record.text"))
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), _size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write the records themselves, one folder per shard; null and repeated ids each keep their own record.

    The columns ``shard`` and ``slot`` are added; if the table has such columns, these keep their names
    and the added ones get an underscore behind theirs.
    """
    taken = {c.lower() for c in df.columns}
    shard_as, slot_as = (n if n not in taken else n + "_" * next(k for k in range(1, 99) if n + "_" * k not in taken) for n in ("shard", "slot"))
    placed, folder = place(df, id_col, text_col, **options)
    placed.select("record.*", F.col("shard").alias(shard_as), F.col("slot").alias(slot_as)).write.partitionBy(shard_as).parquet(path)
    remove(df.sparkSession, folder)
