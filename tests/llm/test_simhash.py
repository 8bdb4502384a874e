"""Fingerprints and components against brute force."""

import random
import re

import pytest
import xxhash

from codemix.llm import simhash
from codemix.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(values, distance):
    """values: (id, fingerprint); the least id within reach of each."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(values):
        for j, (_, b) in enumerate(values[:i]):
            if (a ^ b).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(values):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(root(i)) for i in range(len(values))]


def cases():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ab", "x y", "日本"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))]
        rows.append((10 * i, rng.choice([" ", "\n", " \t"]).join(words)))
        for k in range(rng.randint(0, 3)):
            changed = list(words)
            if changed:
                changed[rng.randrange(len(changed))] = "other"
            rows.append((10 * i + k + 1, " ".join(changed)))
    return rows + [(rows[5][0], rows[5][1]), (None, rows[8][1]), (None, None), (9999, ""), (9998, " a " * 30_000)]


def test_fingerprints_and_components(docs):
    rows = cases()
    got = sorted(map(tuple, simhash.digest(simhash.near_duplicates(docs(rows))).collect()), key=str)
    values = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(values, least_reachable(values, 2))]
    assert got == sorted(expected, key=str)
    assert len({c for _, _, c in expected}) < len(rows) - 20


@pytest.mark.parametrize("bucket", [256, 3])
def test_links_of_crowded_keys(spark, bucket):
    """A crowd around one fingerprint and a chain of two-bit steps."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)}
    values |= {rng.getrandbits(64) for _ in range(30)}
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        chain ^= 3 << b
        values.add(chain)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bucket)
    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    label = {r.node: r.component for r in connected_components(links).collect()}
    expected = least_reachable(list(zip(signed, values)), 2)
    assert [label.get(v, v) for v in signed] == expected


def test_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, None)]
    label = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert label == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_one_of_each_group_stays(docs, spark, tmp_path):
    rows = cases()
    docs(rows).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    kept = simhash.keep_one_of_each(table)
    assert kept.columns == table.columns
    values = [(i, plain_fingerprint(t)) for i, t in rows]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted({c for c in least_reachable(values, 2)})


def test_no_rows(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
