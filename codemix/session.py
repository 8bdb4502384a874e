"""Session helpers: shared working folder, input parallelism, a planning barrier."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. A temporary
    folder of this machine is used only by a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, f"codemix-{purpose}-{uuid.uuid4().hex}")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    files, place = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    files, place = _files(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's JVM ends, however it does unless it is killed."""
    files, place = _files(spark, path)
    files.deleteOnExit(place)


def stored(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder; the table read back, and its folder.

    The folder goes when the application ends: until then a result may read it again.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.parquet(path), path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For intermediate results that several later passes read: they are computed
    once, survive the loss of executors, and stay columnar.
    """
    return stored(df, purpose)[0]


def tasks_for(df: DataFrame, bytes_per_task: int = 256 << 20) -> int:
    """Tasks for an exchange that adaptive execution can't split: as many as Spark is set to, and
    more where the input, as stored, is so large that each would get more bytes than that."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return tasks if size >= 1 << 60 else max(tasks, size // bytes_per_task)  # a source that knows no size says 2^63


def spread(df: DataFrame) -> DataFrame:
    """Spread a small scan over all cores.

    Tagging is CPU-bound, and a scan of a few small files gives fewer tasks
    than cores. A scan that already has several tasks per core is left alone,
    so a large input is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 3 * cores:
        return df
    return df.repartition(cores)


def with_computed(df: DataFrame, **columns) -> DataFrame:
    """Add expensive columns so that they are evaluated once per row.

    A filter on a plain projection is pushed below it with a copy of the
    whole expression; nothing is pushed below a generator's own output.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
