"""Streams over arriving files: same result as batch, exactly once, resumable."""

import shutil

import pytest
from pyspark.sql import functions as F

from codemix.operators.parse import parse_responses
from codemix.sources import views as V
from codemix.streaming import ingest as I


def arrive(df, folder, part, parts):
    """Let a share of the rows arrive as new files."""
    df.filter(F.col("doc_id") % parts == part).write.mode("append").parquet(str(folder))


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_ingest_resumes_and_equals_batch(spark, small, tmp_path):
    docs = documents(spark, small)
    inbox, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 3).parquet(str(inbox))
        I.start_ingest(V.responses_of(stream), sink, checkpoint).awaitTermination()

    arrive(docs, inbox, 0, 3)
    run()
    first = spark.read.parquet(sink).count()
    arrive(docs, inbox, 1, 3)
    arrive(docs, inbox, 2, 3)
    run()
    run()  # nothing new has arrived
    stored = spark.read.parquet(sink).drop("ingest")
    expected = parse_responses(V.responses_of(docs))
    assert 0 < first < stored.count() == expected.count()
    assert stored.select(expected.columns).exceptAll(expected).count() == 0


def test_replayed_batch_replaces_its_rows(spark, small, tmp_path):
    """A batch that failed after writing is run again under the same number."""
    docs = documents(spark, small)
    inbox, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    arrive(docs, inbox, 0, 4)
    leftover = parse_responses(V.responses_of(docs.filter("doc_id % 4 = 1")))
    leftover.write.parquet(f"{sink}/ingest=0")
    stream = spark.readStream.schema(docs.schema).parquet(str(inbox))
    I.start_ingest(V.responses_of(stream), sink, checkpoint).awaitTermination()
    expected = parse_responses(V.responses_of(docs.filter("doc_id % 4 = 0")))
    assert spark.read.parquet(sink).count() == expected.count()


def test_answers_delivered_again_change_nothing(spark, small, tmp_path):
    docs = documents(spark, small)
    inbox, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(str(inbox))
        I.start_ingest(
            V.responses_of(stream), sink, checkpoint, totals_path=str(tmp_path / "totals")
        ).awaitTermination()
        return spark.read.json(str(tmp_path / "totals")).first()

    arrive(docs, inbox, 0, 2)
    first = run()
    arrive(docs, inbox, 0, 2)
    arrive(docs, inbox, 0, 2)
    second = run()
    expected = parse_responses(V.responses_of(docs.filter("doc_id % 2 = 0")))
    assert spark.read.parquet(sink).count() == expected.count() == first.total_utterances
    assert (first.total_conversations, first.total_tokens) == (second.total_conversations, second.total_tokens)
    assert first.total_conversations == expected.select("response_id").distinct().count()
    assert second.last_updated > first.last_updated


def test_answers_without_an_id_are_set_apart(spark, small, tmp_path):
    documents(spark, small).limit(60).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    inbox, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    answers = V.responses_of(docs)
    answers = answers.withColumn("response_id", F.when(F.crc32(F.col("raw_text").cast("binary")) % 3 > 0, F.col("response_id")))
    lost = answers.filter("response_id is null")
    for _ in range(2):
        answers.write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(answers.schema).parquet(str(inbox))
        I.start_ingest(stream, sink, checkpoint).awaitTermination()
    stored = spark.read.parquet(sink)
    assert stored.filter("response_id is null").count() == 0
    assert stored.count() == parse_responses(answers.filter("response_id is not null")).count()
    apart = spark.read.parquet(I.nameless(sink))
    assert lost.count() > 1 and apart.count() == 2 * lost.count()
    assert apart.select(lost.columns).exceptAll(lost.union(lost)).isEmpty()


@pytest.mark.parametrize("lost", ["record", "half a record", "commit", "half the data"])
def test_a_micro_batch_that_died_is_run_again(spark, small, tmp_path, lost):
    """A crash between the data and the record, in the record's write, behind it, or in the data's write."""
    docs = documents(spark, small)
    inbox, sink, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    arrive(docs, inbox, 0, 2)

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(str(inbox))
        I.start_ingest(V.responses_of(stream), str(sink), str(checkpoint)).awaitTermination()
        return I.read_sink(spark, str(sink))

    record = tmp_path / "out-log" / "number-0"
    if lost == "half the data":
        (sink / "ingest=0" / "_temporary" / "0").mkdir(parents=True)
        (sink / "ingest=0" / "_temporary" / "0" / "part-0.parquet").write_bytes(b"PAR1 cut off")
        assert I.read_sink(spark, str(sink)) is None
    else:
        run()
        (checkpoint / "commits" / "0").unlink()
        (checkpoint / "commits" / ".0.crc").unlink()
        if lost != "commit":
            shutil.rmtree(record)
            assert I.read_sink(spark, str(sink)) is None
        if lost == "half a record":
            (record / "_temporary" / "0").mkdir(parents=True)
    expected = parse_responses(V.responses_of(docs.filter("doc_id % 2 = 0")))
    again = run()
    assert again.count() == expected.count() > 0
    assert again.select(expected.columns).exceptAll(expected).count() == 0
    last = I.last_commit(spark, str(sink))
    assert (last.number, last.batch, last.total_utterances) == (0, 0, expected.count())
    arrive(docs, inbox, 1, 2)
    arrive(docs, inbox, 0, 2)
    assert run().count() == parse_responses(V.responses_of(docs)).count()


def test_a_new_stream_leaves_out_what_is_stored(spark, small, tmp_path):
    docs = documents(spark, small)
    sink = str(tmp_path / "out")
    for part in range(3):  # a stream of its own each time, with ids that overlap
        inbox = tmp_path / f"in{part}"
        arrive(docs, inbox, part, 3)
        arrive(docs, inbox, 0, 3)
        stream = spark.readStream.schema(docs.schema).parquet(str(inbox))
        I.start_ingest(V.responses_of(stream), sink, str(tmp_path / f"check{part}")).awaitTermination()
    expected = parse_responses(V.responses_of(docs))
    last = I.last_commit(spark, sink)
    assert I.read_sink(spark, sink).count() == expected.count() == last.total_utterances
    assert last.total_conversations == expected.select("response_id").distinct().count()
    assert last.cs_utterances == expected.filter("has_code_switch = 'yes'").count()


def test_a_micro_batch_reads_no_stored_rows(spark, small, tmp_path, monkeypatch):
    """Ids are kept as the stream's state and totals in the log: the sink is not read."""
    docs = documents(spark, small)
    inbox, sink = tmp_path / "in", str(tmp_path / "out")
    for part in range(3):
        arrive(docs.coalesce(1), inbox, part, 3)
    monkeypatch.setattr(I, "read_sink", None)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    I.start_ingest(V.responses_of(stream), sink, str(tmp_path / "check"), target=1e-9).awaitTermination()
    monkeypatch.undo()
    assert I.last_commit(spark, sink).number == 2
    assert I.read_sink(spark, sink).count() == parse_responses(V.responses_of(docs)).count()


def test_the_stream_ends_at_the_target(spark, small, tmp_path):
    docs = documents(spark, small)
    for part in range(4):
        arrive(docs.coalesce(1), tmp_path / "in", part, 4)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    # any rate is at or below this target, so the first micro-batch reaches it
    I.ingest_until(V.responses_of(stream), sink, str(tmp_path / "check"), target=1.0, seconds=1.0)
    stored = I.read_sink(spark, sink)
    assert [r.ingest for r in stored.select("ingest").distinct().collect()] == [0]
    assert I.needed(stored, 1.0) == 0


def test_running_rate_ends_at_the_batch_answer(spark, small, tmp_path):
    turns = spark.read.parquet(f"{small}/conversations.parquet").withColumn("doc_id", F.col("conv_id"))
    inbox = tmp_path / "in"
    for part in range(4):
        arrive(turns, inbox, part, 4)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    sink = str(tmp_path / "rate")
    I.start_rate(stream, sink, str(tmp_path / "check")).awaitTermination()
    rates = spark.read.parquet(sink)
    assert rates.count() == 1  # earlier rows are gone
    assert I.latest(rates).collect() == I.rate_of(turns).collect()
    needed = I.still_needed(I.latest(rates), 0.25).first().needed_conversations
    assert needed >= 0


def test_shared_folder_comes_from_the_session(spark):
    from codemix.session import shared_folder

    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(base)
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
