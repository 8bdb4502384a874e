"""What the operators share: tables, row keys, intermediate tables, ASCII lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix.session import remove, stored, written

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most keys of rows that are broadcast to leave them out; more are joined by shuffling.
MAX_BROADCAST = 1_000_000


def keyed(df: DataFrame, key: str | None = None, **columns: Column) -> DataFrame:
    """The given columns and a key per row, so that ids may be null or repeated.

    The key names the partition and place of a row in its scan, so use it in one
    pass only, or give the name of a column that holds the rows' keys.
    """
    row = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    return df.select(row.alias(ROW), *[c.alias(name) for name, c in columns.items()])


def with_key(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The table stored with a key per row, under a name that no column has."""
    name = ROW
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id()), purpose), name


def without_rows(rows: DataFrame, key: str, gone: DataFrame, purpose: str) -> DataFrame:
    """The keyed rows but those whose keys ``gone`` has in its column ``ROW``; without the key."""
    gone = written(gone.select(F.col(ROW).alias(key)), purpose)
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").drop(key)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def unsigned_hash(c: Column) -> Column:
    """A number from 0 up to 1 that depends on the value only."""
    return F.shiftrightunsigned(F.xxhash64(c), 11) / F.lit(float(1 << 53))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand texts to Python in batches bounded by their bytes, as some are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


__all__ = ["ROW", "ascii_lower", "bounded_batches", "keyed", "remove", "stored", "table", "unsigned_hash", "with_key", "without_rows", "written"]
