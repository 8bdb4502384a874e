"""Documents and CSV files cut at every possible place: the same rows as of one task."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from codemix import schema
from codemix.sources import dataset as D, ranges

HARD = ['}', '{"', '"conversations": [{', "\\", '\\"', "a\nb", "é }", "[]{}", '}}"{', "", "\\\\}", "\r\n", '"', "x" * 50]


@pytest.fixture
def splits(spark):
    """Cut files into splits of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
    yield cut
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def document(seed, conversations=30):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(HARD + ["hola ", "friend "]) for _ in range(draw.randrange(5)))
    rows = [{
        "conversation_id": i, "strategy": text(), "topic": draw.choice([None, text()]),
        "utterances": [
            {"speaker": "A", "text": text(), "tokens": k, "tagged_tokens": [[text(), "es"], ["x", "en"]], "extra": {"deep": {"er": [{}]}}}
            for k in range(draw.randrange(4))
        ],
    } for i in range(conversations)]
    metadata = {"generation_method": text(), "fixes_applied": {"utterances_fixed": 3, "fix_method": text()}, "total_tokens": 5}
    return metadata, rows


@pytest.mark.parametrize("order", ["metadata first", "metadata last", "others between"])
@pytest.mark.parametrize("indent, size", [(None, 40), (2, 97), (None, 1 << 20)])
def test_document_equals_the_one_of_one_task(spark, splits, tmp_path, order, indent, size):
    metadata, rows = document(size)
    parts = {"metadata": metadata, "conversations": rows}
    if order == "metadata last":
        parts = {"conversations": rows, "metadata": metadata}
    if order == "others between":
        parts = {"more": [{"a": 1}, {"b": [2]}], "n": 1.5, "metadata": metadata, "k": [], "conversations": rows, "z": [{"c": {}}], "y": {"q": {}}}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(parts, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    whole = D.read_document(spark, str(path))
    expected = {r.conv_pos: r for r in D.document_conversations(whole).collect()}
    about = D.document_metadata(whole).collect()
    splits(size)
    assert size > 1000 or spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 8
    found = D.read_document_conversations(spark, str(path)).collect()
    assert len(found) == len(rows) and {r.conv_pos: r for r in found} == expected
    assert D.read_document_metadata(spark, str(path)).collect() == about


@pytest.mark.parametrize("text", ['{"conversations": []}', "{}", '{"metadata": {}, "conversations": null}\n', ""])
def test_documents_without_conversations(spark, tmp_path, text):
    (tmp_path / "doc.json").write_text(text)
    assert D.read_document_conversations(spark, str(tmp_path / "doc.json")).collect() == []
    assert len(D.read_document_metadata(spark, str(tmp_path / "doc.json")).collect()) == ("metadata" in text)


@pytest.mark.parametrize("size", [13, 50, 1 << 20])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_csv_equals_the_one_of_one_task(spark, splits, tmp_path, size, line_end):
    draw = random.Random(size)
    names = [f.name for f in schema.EXPORT.fields]
    (tmp_path / "csv").mkdir()
    for part in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=line_end)
        writer.writerow(names)
        for i in range(12 * part):
            cell = lambda: "".join(draw.choice(["a", " ", ",", '"', "\n", '""', "é", "\n\n"]) for _ in range(draw.randrange(6)))
            writer.writerow([i, part, 3, *[cell() for _ in range(8)]])
        (tmp_path / "csv" / f"part-{part}.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    expected = spark.read.csv(
        str(tmp_path / "csv"), schema=schema.EXPORT, header=True, multiLine=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).collect()
    splits(size)
    found = D.read_export(spark, str(tmp_path / "csv"))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected)) and len(expected) == 36


def test_records_keep_their_order(spark, splits, tmp_path):
    rows = [f'{i},"line {i}\n""quoted"", and\n\nmore"' for i in range(40)]
    (tmp_path / "x.csv").write_text("\n".join(["h", *rows, ""]))
    splits(30)
    found = ranges.csv_records(spark, str(tmp_path / "x.csv")).orderBy("number").collect()
    assert [r.record for r in found] == rows
    assert ranges.csv_records(spark, str(tmp_path / "x.csv"), header=False).count() == 41


def test_lines_are_numbered_without_shuffling_them(spark, tmp_path, monkeypatch):
    plans, write = [], ranges.written
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranges, "written", lambda df, purpose: plans.append(plan_of(df)) or write(df, purpose))
    (tmp_path / "a.csv").write_text('h\nx,1\n"two\nlines",2\n"a ""b""",3\n\nlast,4\n', encoding="utf-8")
    records = ranges.csv_records(spark, str(tmp_path))
    assert sorted(r.record for r in records.collect()) == ['"a ""b""",3', '"two\nlines",2', "last,4", "x,1"]
    assert len(plans) == 1 and "Exchange" not in plans[0]
