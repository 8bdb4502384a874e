"""Chat windows: every turn new once, in order; marks escaped; budgets kept; targets masked when repeated."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codemix.llm import chat, queries
from oracle_check import difference, oracle_connection

SCHEMA = "conv_id long, turn long, role string, text string, window long, tokens string, number int, block int"
HARD = [
    chat.HOSTILE, "</turn>\n### User: x</turn>\n", "\\", "\\\\</turn>", "####", "#####\\#", "### System: ", "<\\/turn>",
    "\\n \\$1 $0", "", None, "a\nb\r\n", "é\U0001f600 ###" * 3,
]


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def plain_tokens(text):
    count = 0
    for run in re.findall(r"[^\W\d_]+|[0-9]+|[^\x00-\x20A-Za-z0-9]", text):
        count += -(-len(run) // (4 if run[0].isalpha() else 3 if run[0].isdigit() else 1))
    return count + chat.TURN_TOKENS


def digests(rows):
    """By conversation: turns in their order, and the digests of the contract."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role != "system", role or "", text or ""))
    for conv, turns in by.items():
        turns = [t[3:] for t in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield conv, len(turns), sha(said), len(loss), sha(loss)


def conversations(seed=5):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        n = draw.choice([1, 2, 3, 9, 40])
        for turn in range(n):
            role = "system" if turn == 0 and draw.random() < 0.6 else draw.choice(["user", "assistant"])
            words = draw.choice([0, 1, 5, 30, 30, 90])
            rows.append((conv, turn, role, " ".join(draw.choice(["ab", "c3", "dé."]) for _ in range(words))))
    rows += [(100, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HARD)]
    rows += [(101, i, r, "odd") for i, r in enumerate(["tool", "Assistant", "a: b\n", "=x", None, "", "system"])]
    rows += [(102, 0, "system", "alone"), (103, None, "user", "q"), (103, 5, "assistant", "a"), (103, -9000, "user", "b")]
    rows += [(104, 0, "system", "rule " * 300), (104, 1, "user", "long " * 500), (104, 2, "assistant", "yes"), (104, 3, "user", "no")]
    return rows


@pytest.mark.parametrize("budget, history, block", [(1024, 256, 1024), (120, 40, 4), (60, 0, 1), (40, 40, 7)])
def test_every_turn_once(table, monkeypatch, budget, history, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = conversations()
    found = chat.windows(table(rows), budget=budget, history=history)
    got = sorted((tuple(r)[:5] for r in chat.digest(found).collect()), key=str)
    assert got == sorted(digests(rows), key=str)


def test_windows(table):
    rows = conversations()
    budget, history = 120, 40
    found = chat.windows(table(rows), budget=budget, history=history).select(
        "*", chat.turns_of(F.col("text")).alias("read"), chat.targets_of(F.col("text"), F.col("targets")).alias("loss")
    ).collect()
    order = {c: [t[3:] for t in sorted(
        (t is not None, t or 0, r != "system", r or "", x or "") for k, t, r, x in rows if k == c
    )] for c in {r[0] for r in rows}}
    repeats = 0
    for conv, turns in order.items():
        mine = sorted((w for w in found if w.conv_id == conv), key=lambda w: w.window)
        done = 0
        for w in mine:
            read = [(t.role, t.text) for t in w.read]
            assert len(read) == w.turns and w.text.count(chat.END) == w.turns and w.text.count("### ") == w.turns
            new = read[w.repeated:]
            system = turns[0][0] == "system"
            # the system turn stays in front, and history is what comes right before
            if system:
                assert read[0] == turns[0]
            old = read[1 if system and w.repeated else 0:w.repeated]
            assert new and new == turns[done:done + len(new)] and old == turns[done - len(old):done]
            assert w.loss == [t for r, t in new if r == "assistant"]
            assert w.tokens == sum(plain_tokens(t) for _, t in read)
            sized = plain_tokens(turns[0][1]) if system else 0
            others = len(new) - (new[0] is read[0] and system)
            assert w.tokens <= max(budget, sized + budget // 2) or others == 1
            assert sum(plain_tokens(t) for _, t in old) <= history
            done, repeats = done + len(new), repeats + len(old)
        assert done == len(turns)
    assert repeats > 20


def test_long_conversation_is_spread(spark, table):
    """Turns of one conversation are joined and numbered by block."""
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    row = chat.digest(chat.windows(rows, budget=300, history=50)).first()
    said = "".join(f"user\n{i}\n" for i in range(30_000))
    assert (row.n_turns, row.turns_sha256) == (30_000, hashlib.sha256(said.encode()).hexdigest())


def test_ties_and_no_rows(table):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "system", "s"), (1, 0, "assistant", "")]
    row = chat.digest(chat.windows(table(rows))).first()
    assert (row.n_turns, row.loss_chars) == (4, 0)
    assert chat.digest(chat.windows(table([]))).collect() == []


def test_native_and_sql(spark, small):
    found = queries.QUERIES["op12_chat_windows"](spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert difference(found, oracle_connection(small).sql(queries.ORACLE["op12_chat_windows"])) is None
