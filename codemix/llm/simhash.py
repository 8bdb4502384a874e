"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a
text's word shingles. Fingerprints within d bits agree in all but d of their
blocks; with d + 2 blocks they share at least one pair of blocks, and so one of the
keys made of two blocks. Distinct fingerprints are joined on those keys and
verified by their distance. A key with more than ``BUCKET`` fingerprints isn't
paired up: each of its fingerprints is instead listed once under every mask of d
bits, where all that agree outside the mask are within d bits of each other and
are linked to the least, so that the work stays in proportion to the rows and no
link between components is lost. Components come from those links, on distinct
fingerprints; copies of a text meet in one row before any join.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm.common import ROW, bounded_batches, keyed, with_key, without_rows, written
from codemix.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
BITS = 64
#: Most fingerprints of a key that are compared pair by pair.
BUCKET = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 18


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a null text or one without words."""
    # Words lie between blanks and the characters 9 to 13, as bytes.split has it.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at:at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit numbers of the same bits."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return fingerprint(F.col(text_col))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(distance: int) -> list[int]:
    """Masks of two of the ``distance`` + 2 blocks: close pairs agree under one at least."""
    blocks = distance + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [a | b for a, b in combinations(block, 2)]


def bit_masks(distance: int) -> list[int]:
    """Masks of all bits but ``distance``: equality under one means at most that distance."""
    everything = (1 << BITS) - 1
    return [everything ^ sum(1 << b for b in bits) for bits in combinations(range(BITS), distance)]


def _under(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask with the bits that the mask shows."""
    listed = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return distinct.select("fp", F.posexplode(listed).alias("mask", "bits")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key")
    )


def close_links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join all pairs within
    ``distance`` bits into the components that these pairs make."""
    keys = _under(distinct, block_masks(distance))
    sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keys.join(sizes, ["mask", "key"]), "simhash-keys")
    small = shared.where(F.col("size") <= bucket)
    pairs = (
        small.select("mask", "key", F.col("fp").alias("a"))
        .join(small.select("mask", "key", F.col("fp").alias("b")), ["mask", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    large = shared.where(F.col("size") > bucket).select("fp").distinct()
    under = _under(large, bit_masks(distance))
    least = under.groupBy("mask", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z")
    stars = under.join(least, ["mask", "key"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    distance: int = DISTANCE, bucket: int = BUCKET, key: str | None = None,
) -> DataFrame:
    """The row key (``key``, if the table has one), doc_id, fp, component_id and keeper of every row.

    component_id is the least id of the texts that links reach, the own included;
    keeper is the key of the row that stands for them, the one with that id. Null
    and empty texts have fingerprint 0 and are linked like others. Rows with null
    ids take part; if all of a component have none, its id is null. Rows that repeat
    an id each have their own fingerprint. Empty tables give no rows.
    """
    docs = keyed(df, key, doc_id=F.col(id_col), text=F.col(text_col))
    docs = written(docs.select(ROW, "doc_id", fingerprints(df, "text", shingle).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(ROW).alias("row")))
    distinct = written(docs.groupBy("fp").agg(first.alias("first")), "simhash-fps")
    nodes = connected_components(close_links(distinct.select("fp"), distance, bucket))
    labelled = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    heads = labelled.groupBy("component").agg(F.min("first").alias("head"))
    heads = labelled.select("fp", "component").join(heads, "component").select(
        "fp", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("keeper")
    )
    return docs.join(heads, "fp").select(ROW, "doc_id", "fp", "component_id", "keeper")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of a table without the near-copies: of each component the row
    with the least id stays, and of rows that repeat it one. All columns stay, whatever their
    names; nulls and empty tables are as in ``near_duplicates``."""
    rows, key = with_key(df, "simhash-rows")
    found = near_duplicates(rows, id_col, text_col, key=key, **options)
    return without_rows(rows, key, found.where(F.col(ROW) != F.col("keeper")), "simhash-gone")
