"""Answers arriving as a stream: parse and append, and keep the switch rate.

The sink has a subfolder of utterances per micro-batch and a log beside it. A record of the
log is written once the data of its micro-batch is whole, and readers go by the last record: what
lies behind it is the rest of a micro-batch that died and will be run again. A record carries
the totals up to it, so that nobody has to count the sink.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import Future

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codemix.functions import tagging as G
from codemix.operators.parse import parse_responses
from codemix.operators.stats import cs_rate_flag, dataset_totals, topup_from
from codemix.session import children, remove, stored, with_computed


ALL_THERE_IS = {"availableNow": True}

#: A record: its number, which is the sink's subfolder; the stream and its micro-batch; the first
#: number of that stream; totals up to and with it; the schema of the stored rows.
RECORD = (
    "number long, run string, batch long, run_from long, total_conversations long, "
    "total_utterances long, total_tokens long, cs_utterances long, schema string"
)


def log_of(sink: str) -> str:
    """The folder of the log, beside the sink."""
    return sink.rstrip("/") + "-log"


def nameless(sink: str) -> str:
    """The folder of answers without a `response_id`, beside the sink."""
    return sink.rstrip("/") + "-without-id"


def last_commit(spark: SparkSession, sink: str) -> Row | None:
    """The last whole record of the log. Names are listed, and one record is read."""
    log = log_of(sink)
    numbers = sorted((int(n.removeprefix("number-")) for n in children(spark, log) if n.startswith("number-")), reverse=True)
    for number in numbers:  # the last one may be the rest of a write that died
        record = spark.read.schema(RECORD).json(os.path.join(log, f"number-{number}")).first()
        if record is not None:
            return record
    return None


def read_sink(spark: SparkSession, sink: str) -> DataFrame | None:
    """The stored utterances of all micro-batches in the log, with their number as `ingest`; None before the first."""
    last = last_commit(spark, sink)
    if last is None:
        return None
    schema = StructType.fromJson(json.loads(last.schema))
    return spark.read.schema(schema).parquet(sink).filter(F.col("ingest") <= last.number)


def totals(sink: DataFrame) -> DataFrame:
    """Totals of the stored answers, with the time of the count."""
    return dataset_totals(sink.select("response_id").distinct(), sink)


def needed(sink: DataFrame, target: float) -> int:
    """Conversations that the stored answers still need for the target rate."""
    return topup_from(cs_rate_flag(sink), target).first().needed_conversations


def _needed_after(spark: SparkSession, record: Row, target: float) -> int:
    """The same by a record."""
    rate = spark.createDataFrame([(record.cs_utterances, record.total_utterances)], "cs_utterances long, utterances long")
    return topup_from(rate, target).first().needed_conversations


def _reached(spark: SparkSession, record: Row | None, target: float | None) -> bool:
    return (
        target is not None and record is not None and record.total_utterances > 0
        and _needed_after(spark, record, target) == 0
    )


def _own_counts(utterances: DataFrame) -> Row:
    """Counts of one micro-batch, whose answers are in no other."""
    rate = cs_rate_flag(utterances).select("cs_utterances")
    return totals(utterances).drop("last_updated").crossJoin(F.broadcast(rate)).first()


def start_ingest(
    responses: DataFrame, sink: str, checkpoint: str, totals_path: str | None = None,
    target: float | None = None, trigger: dict = ALL_THERE_IS,
) -> StreamingQuery:
    """Parse every micro-batch of answers and append its utterances to `sink`.

    Exactly once by `response_id`: the stream keeps the ids it has seen as its state, so an
    answer that is delivered again is not stored again, and what a micro-batch reads doesn't grow with the
    sink. (For more ids than fit in the executors' memory set Spark's RocksDB state store.) A
    stream with a new checkpoint leaves out the ids that earlier streams have stored. Of answers
    with one id in a micro-batch any one counts. A micro-batch counts once its record is in the
    log; one that died before is run again and replaces its own subfolder. One writer at a time.

    Answers without a `response_id` can't be told from one another: all of them are set
    apart, as they arrived, in a subfolder of `nameless(sink)` per micro-batch, and are not
    parsed, stored or counted. With `totals_path` the totals are saved after every micro-batch; with `target`
    nothing more is stored once the switch rate has come down to it.
    """
    named = F.col("response_id").isNotNull()
    run: Future[str] = Future()

    def append(batch: DataFrame, batch_id: int) -> None:
        spark, me = batch.sparkSession, run.result()
        last = last_commit(spark, sink)
        mine = last is not None and last.run == me
        # done before the stream died, or nothing more is wanted: only the state goes on
        if mine and batch_id <= last.batch or _reached(spark, last, target):
            batch.write.format("noop").mode("overwrite").save()
            return
        number = 0 if last is None else last.number + 1
        run_from = last.run_from if mine else number
        folder = os.path.join(sink, f"ingest={number}")
        # one pass over the micro-batch and its state
        answers, answers_at = stored(batch, "ingest-answers")
        new = answers.filter(named)
        if run_from > 0:
            earlier = read_sink(spark, sink).filter(F.col("ingest") < run_from)
            new = new.join(earlier.select("response_id").distinct(), "response_id", "left_anti")
        apart = answers.filter(~named)
        if not apart.isEmpty():
            apart.write.mode("overwrite").parquet(os.path.join(nameless(sink), f"ingest={number}"))
        parsed = parse_responses(new)
        parsed.write.mode("overwrite").parquet(folder)
        own = _own_counts(spark.read.schema(parsed.schema).parquet(folder)).asDict()
        sums = {c: n + (last[c] if last is not None else 0) for c, n in own.items()}
        record = {
            "number": number, "run": me, "batch": batch_id, "run_from": run_from, **sums, "schema": parsed.schema.json(),
        }
        names = StructType.fromDDL(RECORD).names
        row = spark.createDataFrame([tuple(record[n] for n in names)], RECORD).coalesce(1)
        row.write.mode("overwrite").json(os.path.join(log_of(sink), f"number-{number}"))
        if totals_path is not None:
            kept = row.select("total_conversations", "total_utterances", "total_tokens", F.current_timestamp().alias("last_updated"))
            kept.write.mode("overwrite").json(totals_path)
        remove(spark, answers_at)

    # keys of the state are ids; answers without one go past it
    seen_once = responses.filter(named).dropDuplicates(["response_id"]).unionByName(responses.filter(~named))
    query = (
        seen_once.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
    run.set_result(str(query.id))  # that of the checkpoint, whoever starts it
    return query


def ingest_until(
    responses: DataFrame, sink: str, checkpoint: str, target: float, seconds: float = 5.0, **options
) -> None:
    """Store answers until the target rate is reached or the stream ends; then stop it."""
    query = start_ingest(responses, sink, checkpoint, target=target, **options)
    spark = responses.sparkSession
    while not query.awaitTermination(seconds):
        if _reached(spark, last_commit(spark, sink), target):
            query.stop()


def rate_of(texts: DataFrame) -> DataFrame:
    """Running counts and switch rate of tagged texts; works on batch and stream."""
    tagged = with_computed(texts, tagged_tokens=G.tag(F.col("text")))
    tt = F.col("tagged_tokens")
    flag = G.switch_flag(G.count_lang(tt, "es"), G.count_lang(tt, "en"))
    switched, total = F.count_if(flag == "yes"), F.count("*")
    return tagged.groupBy().agg(
        total.alias("utterances"), switched.alias("cs_utterances"),
        F.when(total > 0, switched / total * 100).otherwise(0.0).alias("cs_rate"),
    )


def start_rate(
    texts: DataFrame, sink: str, checkpoint: str, trigger: dict = ALL_THERE_IS
) -> StreamingQuery:
    """Keep the running rate: one row, written again after every micro-batch.

    The earlier row goes once the new one is there; a reader may see both.
    """

    def keep(row: DataFrame, batch_id: int) -> None:
        spark, name = row.sparkSession, f"after={batch_id}"
        row.coalesce(1).write.mode("overwrite").parquet(os.path.join(sink, name))
        for other in children(spark, sink):  # one, or the rest of a write that died
            if other.startswith("after=") and other != name:
                remove(spark, os.path.join(sink, other))

    return (
        rate_of(texts).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def latest(rates: DataFrame) -> DataFrame:
    """The last of the kept rates."""
    row = F.struct(*[c for c in rates.columns if c != "after"])
    return rates.agg(F.max_by(row, "after").alias("r")).select("r.*")


def still_needed(rate: DataFrame, target: float) -> DataFrame:
    """Resume or stop: conversations still missing for the target rate."""
    return topup_from(rate, target)
