"""Shards: equal bytes, dense slots, whole results, hot groups."""

import random
import zlib
from collections import defaultdict

from codemix.llm import sharding


def check(rows, result, shards=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in result) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots, size = defaultdict(list), defaultdict(int)
    for r in result:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_equal_bytes_although_one_text_holds_a_third(docs):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400) + str(i)) for i in range(4000)]
    rows += [(5000 + i, "the same text" * 10) for i in range(2000)]
    size = check(rows, sharding.shard(docs(rows)).collect())
    mean = sum(size.values()) / 8
    assert max(size.values()) - min(size.values()) <= 2 * (0.001 * mean + 412)


def test_nulls_ties_repeats_and_one_large_record(docs):
    rows = [(None, None), (1, ""), (1, ""), (None, None), (2, "é" * 100_000), (3, "a"), (3, "b")]
    check(rows, sharding.shard(docs(rows)).collect())


def test_no_rows(docs):
    assert sharding.shard(docs([])).collect() == []


def test_same_result_again(docs):
    rows = [(i, str(i) * (i % 50)) for i in range(500)]
    one, two = (sorted(map(tuple, sharding.shard(docs(rows)).collect()), key=str) for _ in range(2))
    assert one == two


def test_written_shards_hold_the_records(docs, tmp_path, spark):
    rows = [(i, str(i) * 5) for i in range(100)]
    sharding.write_shards(docs(rows), f"{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert {r.shard for r in back.collect()} == {0, 1, 2}


def test_columns_named_shard_and_slot_stay(docs, tmp_path, spark):
    from pyspark.sql import functions as F

    rows = [(i, str(i) * 5) for i in range(40)]
    table = docs(rows).withColumns({"shard": F.lit("mine"), "Slot": F.lit(7), "slot_": F.lit(8)})
    sharding.write_shards(table, f"{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert len(back) == 40 and {(r.shard, r.Slot, r.slot_) for r in back} == {("mine", 7, 8)}
    assert {r.shard_ for r in back} == {0, 1, 2} and {r.slot__ for r in back} >= {0, 1}


def test_texts_go_to_their_shards_whatever_the_ids(docs, tmp_path, spark):
    rows = [(None, "no id")] * 3 + [(1, "one"), (1, "one"), (1, "uno"), (2, None), (None, None)] + [(i, str(i) * 9) for i in range(9, 60)]
    sharding.write_shards(docs(rows), f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    described = sharding.shard(docs(rows), shards=4).collect()
    assert sorted((r.shard, r.slot, zlib.crc32((r.text or "").encode())) for r in back) == sorted(
        (r.shard, r.slot, r.text_crc32) for r in described
    )


def plain(rows, shards):
    """The placement worked out in one piece: texts in the order of their hashes, cut where the bytes are nearest."""
    order = sorted(rows, key=lambda r: r["key"])
    sizes = [r["size"] for r in order]
    total, sums = sum(sizes), [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    return order, [min(range(len(sums)), key=lambda i: abs(sums[i] - k * total / shards)) for k in range(1, shards)], sums


def test_placement_against_a_plain_one(spark, docs):
    """Key order is kept, equal texts stay together, and each boundary is as near as the tolerance says."""
    rng = random.Random(3)
    rows = [(i, "w" * rng.randint(0, 300) + str(rng.randrange(900))) for i in range(3000)]
    records = sharding.slim(docs(rows), "doc_id", "text").collect()
    listed = [{"key": tuple(r[k] for k in sharding.KEY), "size": r["size"], "doc_id": r["doc_id"]} for r in records]
    order, exact, sums = plain(listed, 8)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs(rows)).collect()}
    assert [got[r["doc_id"]] for r in order] == sorted(got.values())
    total = sums[-1]
    shards = [got[r["doc_id"]][0] for r in order]
    for k in range(1, 8):
        edge = sum(s < k for s in shards)
        largest = max(r["size"] for r in listed)
        assert abs(sums[edge] - sums[exact[k - 1]]) <= 0.001 * total / 8 + largest
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t].add(got[i][0])
    assert sum(len(s) > 1 for s in by_text.values()) <= 7 and all(max(s) - min(s) <= 1 for s in by_text.values())
