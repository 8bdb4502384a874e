"""Windows of benchmark items in documents, against a plain scan and SQL."""

import hashlib
import random
import re
from collections import Counter

from codemix.llm import decontam, queries
from oracle_check import difference, oracle_connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        if item is not None and w:
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i:i + n])]
        yield (
            doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w),
        )


def run(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as n")
    return decontam.scan(docs(rows), bench), bench


def cases():
    rng = random.Random(3)
    vocabulary = ["Ab", "c", "dé", "É", "9x", "the", "of", "K", "𝒳"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([1, 2, 12, 13, 14, 30, 40, 40])]
    items += [(9, items[5][1]), (10, None), (11, ""), (12, "!? -"), (None, "the of the of the of")]
    rows = []
    for i in range(150):
        text = some(rng.randint(0, 60))
        item = rng.choice(items[:9])[1].split()
        if rng.random() < 0.6:
            start = rng.randint(0, len(item))
            text[5:5] = [x.upper() if x.isascii() else x for x in item[start:start + rng.randint(1, 40)]] * rng.randint(1, 3)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    rows += [(0, rows[0][1]), (None, rows[1][1]), (500, None), (501, ""), (502, "... \x00"), (503, "Ab c " * 20_000)]
    return rows, items


def test_equals_a_plain_scan(spark, docs):
    rows, items = cases()
    for chosen in (items, items[3:8]):
        found, _ = run(spark, docs, rows, chosen)
        assert Counter(map(tuple, decontam.report(found).collect())) == Counter(plain(rows, chosen))


def test_the_join_that_does_not_broadcast_gives_the_same(spark, docs, monkeypatch):
    rows, items = cases()
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    found, _ = run(spark, docs, rows, items)
    assert Counter(map(tuple, decontam.report(found).collect())) == Counter(plain(rows, items))


def test_few_long_ngrams_are_not_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", 1_000_000, raising=False)
    long = " ".join("\u5b57" * 2000 + str(i) for i in range(40))
    rows, items = [(1, "a " + long), (2, "a b"), (3, None)], [(1, long), (2, long)]
    found, _ = run(spark, docs, rows, items)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan(found)
    assert Counter(map(tuple, decontam.report(found).collect())) == Counter(plain(rows, items))
    found, _ = run(spark, docs, rows, [(1, "a b")])
    assert "strategy=broadcast" in plan(found)


def test_empty_tables(spark, docs):
    found, _ = run(spark, docs, [(1, "a b")], [])
    assert [r.n_hit for r in decontam.report(found).collect()] == [0]
    found, _ = run(spark, docs, [], [(1, "a b")])
    assert decontam.report(found).collect() == []


def test_contaminated_documents_go_and_the_others_keep_their_columns(spark, docs, tmp_path):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, "clean words"), (3, None), (None, text), (4, text + " other" * 2000)]
    _, bench = run(spark, docs, rows, [(1, text)])
    docs(rows).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    left = decontam.remove_contaminated(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {2, 3, 4}


def test_equals_sql(spark, small):
    sql = oracle_connection(small).sql(queries.ORACLE["op6_decontamination"])
    assert difference(queries.QUERIES["op6_decontamination"](spark, small), sql) is None
