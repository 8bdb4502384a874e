"""Files: the JSON document, JSON lines in parts, CSV."""

import json

import pytest
from pyspark.sql import functions as F

from codemix import schema
from codemix.operators import export as E, parse as P, repair as R, stats as A
from codemix.sources import dataset as D

DOCUMENT = {
    "metadata": {"generation_method": "hybrid_tagged", "total_tokens": 20000},
    "conversations": [
        {"conversation_id": 3, "strategy": "minimal_switch", "topic": "movie night", "utterances": [
            {"speaker": "Speaker A", "text": "hola, friend", "original_text": "<ES>hola,</ES> friend",
             "tokens": 2, "tagged_tokens": [["hola,", "es"], ["friend", "en"], ["odd"], ["?", "punct"]],
             "tokens_list": ["hola,", "friend"], "pos_tags": ["NN", "NN"], "has_code_switch": "yes",
             "spanish_percentage": 50.0},
            {"text": "año \"x\"\nnext", "tagged_tokens": [["año", "es"], ["zz", "fr"]]},
        ]},
        {"conversation_id": 4, "topic": "work meeting", "utterances": []},
        {"utterances": [{"speaker": "Speaker B"}]},
    ],
}


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "data.json"
    path.write_text(json.dumps(DOCUMENT, indent=2, ensure_ascii=False), encoding="utf-8")
    return D.read_document(spark, str(path))


def test_document_is_flattened(document):
    conversations = D.document_conversations(document)
    assert conversations.count() == 3
    rows = D.flatten(conversations).orderBy("conv_pos", "utt_idx").collect()
    assert [(r.conv_pos, r.utt_idx, r.conversation_id) for r in rows] == [
        (0, 0, 3), (0, 1, 3), (2, 0, None),
    ]
    assert [(t.token, t.lang) for t in rows[0].tagged_tokens] == [
        ("hola,", "es"), ("friend", "en"), ("?", "punct"),
    ]
    assert set(schema.UTTERANCE_COLUMNS) == set(rows[0].asDict())


def test_metadata_is_taken_from_the_document(document):
    u = D.flatten(D.document_conversations(document))
    row = A.target_check(u, D.document_metadata(document)).first()
    assert row.total_tokens == 20000 and row.enough_tokens
    assert row.cs_rate == pytest.approx(100 / 3) and not row.rate_in_target


def test_metadata_round_trip(spark, document, tmp_path):
    D.write_metadata(D.document_metadata(document), str(tmp_path / "m"))
    assert D.read_metadata(spark, str(tmp_path / "m")).collect() == D.document_metadata(document).collect()


def test_defaults_of_the_export(document):
    rows = E.export_flat(D.flatten(D.document_conversations(document))).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1, 2]
    assert (rows[0].tokens, rows[0].pos_tags, rows[0].spanish_percentage) == ("hola,|friend", "ES|EN", "50.0")
    assert (rows[1].tokens, rows[1].pos_tags, rows[1].speaker) == ("año|zz", "ES|UNK", "Unknown")
    last = rows[2]
    assert (last.conversation_id, last.generation_strategy, last.topic) == (0, "unknown", "general")
    assert (last.utterance, last.has_code_switch, last.spanish_percentage) == ("", "no", "0.0")


def test_strategies_count_conversations(document):
    rows = E.strategy_counts(D.document_conversations(document)).collect()
    assert [tuple(r) for r in rows] == [("minimal_switch", 1), ("unknown", 2)]


def test_csv_keeps_quotes_and_newlines(spark, document, tmp_path):
    export = E.export_flat(D.flatten(D.document_conversations(document)))
    D.write_export(export, str(tmp_path / "csv"))
    back = {r.id: r for r in D.read_export(spark, str(tmp_path / "csv")).collect()}
    assert back[1].utterance == 'año "x"\nnext'
    assert back[2].utterance is None and back[2].tokens is None
    assert back[0].tokens == "hola,|friend"


def test_long_conversations_go_on_in_further_lines(spark, tmp_path):
    n = D.LINE_UTTERANCES * 2 + 5
    u = spark.range(n).select(
        F.lit(9).cast("bigint").alias("conv_pos"), F.lit(1).cast("bigint").alias("conversation_id"),
        F.col("id").cast("int").alias("utt_idx"), F.lit("Speaker A").alias("speaker"),
        F.concat(F.lit("text "), "id").alias("text"), F.lit("o").alias("original_text"),
        F.lit(1).alias("tokens"),
        F.array(F.struct(F.lit("ñ").alias("token"), F.lit("es").alias("lang"))).alias("tagged_tokens"),
        F.array(F.lit("ñ")).alias("tokens_list"), F.array(F.lit("NN")).alias("pos_tags"),
        F.lit("no").alias("has_code_switch"), F.lit(100.0).alias("spanish_percentage"),
        F.lit("free_generation").alias("strategy"), F.lit("t").alias("topic"),
    )
    D.write_conversations(u.repartition(5), str(tmp_path / "lines"))
    lines = D.read_conversations(spark, str(tmp_path / "lines"))
    assert sorted(r.part for r in lines.select("part").collect()) == [0, 1, 2]
    back = D.flatten(lines)
    assert back.select(u.columns).exceptAll(u).count() == 0 and back.count() == n


def test_a_long_conversation_counts_once(spark, tmp_path):
    one = spark.range(9000).select(
        F.lit(9).cast("bigint").alias("conv_pos"), F.lit(1).cast("bigint").alias("conversation_id"),
        F.col("id").cast("int").alias("utt_idx"), F.lit("Speaker A").alias("speaker"),
        F.lit("t").alias("text"), F.lit("t").alias("original_text"), F.lit(1).alias("tokens"),
        F.array(F.struct(F.lit("t").alias("token"), F.lit("es").alias("lang"))).alias("tagged_tokens"),
        F.array(F.lit("t")).alias("tokens_list"), F.array(F.lit("NN")).alias("pos_tags"),
        F.lit("no").alias("has_code_switch"), F.lit(100.0).alias("spanish_percentage"),
        F.lit("monolingual_spanish").alias("strategy"), F.lit("t").alias("topic"),
    )
    D.write_conversations(one, str(tmp_path / "lines"))
    back = D.read_conversations(spark, str(tmp_path / "lines"))
    assert back.count() == 3
    assert [tuple(r) for r in E.strategy_counts(back).collect()] == [("monolingual_spanish", 1)]
    assert A.dataset_totals(back, D.flatten(back)).first().total_conversations == 1
    row = R.repair_provenance(back, D.flatten(back)).first()
    assert (row.conversations_fixed, row.utterances_fixed) == (1, 9000)


def test_empty_conversations_are_written(spark, document, tmp_path):
    conversations = D.document_conversations(document)
    D.write_conversations(D.flatten(conversations), str(tmp_path / "lines"), conversations)
    back = D.read_conversations(spark, str(tmp_path / "lines"))
    assert [tuple(r) for r in E.strategy_counts(back).collect()] == [("minimal_switch", 1), ("unknown", 2)]
    assert D.flatten(back).count() == 3
    assert {(r.conversation_id, r.topic) for r in back.collect()} == {(3, "movie night"), (4, "work meeting"), (None, None)}


def test_lines_of_other_writers_have_no_part(spark, tmp_path):
    line = {"conv_pos": 1, "conversation_id": 1, "utterances": [{"text": "a"}, {"text": "b"}]}
    (tmp_path / "x.json").write_text(json.dumps(line))
    back = D.read_conversations(spark, str(tmp_path / "x.json"))
    assert sorted(r.utt_idx for r in D.flatten(back).collect()) == [0, 1]
    assert [tuple(r) for r in E.strategy_counts(back).collect()] == [("unknown", 1)]


def test_csv_keeps_blanks_at_edges(spark, document, tmp_path):
    export = E.export_flat(D.flatten(D.document_conversations(document)))
    export = export.withColumn("utterance", F.lit("  lead and trail  ")).withColumn("topic", F.lit(" t"))
    D.write_export(export, str(tmp_path / "csv"))
    rows = D.read_export(spark, str(tmp_path / "csv")).collect()
    assert {(r.utterance, r.topic) for r in rows} == {("  lead and trail  ", " t")}


def test_append_and_export_lose_no_row(spark, document):
    existing = D.flatten(D.document_conversations(document))
    single = spark.createDataFrame(
        [(70, 0, "x"), (70, 1, "y"), (8, 0, "z")], "response_id long, utt_idx int, text string"
    )
    headers = D.document_conversations(document).select("conversation_id", "conv_pos")
    single = P.assign_response_ids(single, headers)
    batch = P.assign_conversation_ids(
        spark.createDataFrame([(4, 1), (4, 2)], "batch_id long, segment int"),
        headers.unionByName(single.select("conversation_id", "conv_pos")),
    )
    rows = batch.crossJoin(spark.range(2)).select(
        "conv_pos", "conversation_id", F.col("id").cast("int").alias("utt_idx"), F.lit("b").alias("text")
    )
    both = P.append_utterances(P.append_utterances(existing, single.drop("response_id")), rows)
    out = E.export_flat(both).orderBy("id").collect()
    assert both.count() == 10 and [r.id for r in out] == list(range(10))
    assert [r.conversation_id for r in out] == [3, 3, 0, 5, 6, 6, 7, 7, 8, 8]
    with pytest.raises(Exception, match="NULL"):
        E.export_flat(both.withColumn("conv_pos", F.lit(None).cast("bigint"))).collect()


def test_first_conversation_is_chosen_even_without_utterances(spark, document):
    conversations = D.document_conversations(document).select(
        "conv_pos", "conversation_id", F.lit("minimal_switch").alias("strategy")
    )
    later_only = D.flatten(D.document_conversations(document)).filter("conv_pos > 0")
    row = R.repair_sample(conversations, later_only).first()
    assert row.conv_pos == 0 and row.text is None


def test_provenance_counts_empty_conversations(spark):
    conversations = spark.createDataFrame(
        [(0, "monolingual_spanish"), (1, "monolingual_english"), (2, "role_based")],
        "conv_pos long, strategy string",
    )
    utterances = spark.createDataFrame([(0, "monolingual_spanish")] * 3, "conv_pos long, strategy string")
    row = R.repair_provenance(conversations, utterances).first()
    assert (row.conversations_fixed, row.utterances_fixed) == (2, 3)


def test_new_ids_follow_the_existing_ones(spark):
    batches = spark.createDataFrame([(5, 2), (5, 1), (2, 4), (900000, 1)], "batch_id long, segment int")
    existing = spark.createDataFrame([(17,), (40,)], "conversation_id long")
    rows = P.assign_conversation_ids(batches, existing).orderBy("conversation_id").collect()
    assert [(r.conversation_id, r.batch_id, r.segment) for r in rows] == [
        (41, 2, 4), (42, 5, 1), (43, 5, 2), (44, 900000, 1),
    ]
    none = existing.limit(0)
    assert P.assign_conversation_ids(batches, none).agg(F.min("conversation_id")).first()[0] == 0


@pytest.mark.parametrize("path, expected", [
    ("data/set.json", "data/set_fixed.json"), ("data/set", "data/set_fixed"),
    ("data.v2/set", "data.v2/set_fixed"),
])
def test_output_names(path, expected):
    assert D.output_path(path, "fixed") == expected


def test_lines_are_those_of_the_json_writer(spark, tmp_path):
    """Quotes, line ends, nulls, equal places and missing columns; lists are shuffled as text."""
    pair = "array<struct<token:string,lang:string>>"
    rows = [
        (1, 0, 11, "A", 'say "hi"\n', "ñ\\u0001 é", 2, [("a", "en"), (None, "es")], ["a"], None, "yes", 33.3, "s", "t"),
        (1, 1, 11, "B", "abc d", None, None, None, None, ["NN"], None, None, "s", "t"),
        (1, 1, 11, "B", "abc", None, None, [], [], [], None, 0.1, "s", "t"),
        (1, 2, 11, "B", "", "", 0, [("a\x01b", "en"), ("", "es")], ["a\x01b", ""], ["", ""], "no", 0.1, "s", "t"),
        (1, 3, 11, "B", "", "", 0, [("a", "en"), None, ("", "")], ["a", None, ""], ["x", None], "no", 0.1, "s", "t"),
        (1, 4, 11, "B", "", "", 0, [("", "en")], ["other", "", ""], [""], "no", 0.1, "s", "t"),
        (None, 0, None, None, None, None, None, None, None, None, None, None, None, None),
        (3, 5000, 13, "A", "late", "late", 1, [("late", "en")], ["late"], ["NN"], "no", 1e-9, None, None),
    ]
    u = spark.createDataFrame(rows, (
        "conv_pos long, utt_idx int, conversation_id long, speaker string, text string, original_text string, tokens int, "
        f"tagged_tokens {pair}, tokens_list array<string>, pos_tags array<string>, has_code_switch string, spanish_percentage double, strategy string, topic string"
    ))
    for k, table in enumerate((u, u.drop("tokens_list", "pos_tags"))):
        D.nest(table).write.json(f"{tmp_path}/{k}-expected")
        D.write_conversations(table, f"{tmp_path}/{k}-got", compression="gzip")
        lines = [sorted(r.value for r in spark.read.text(f"{tmp_path}/{k}-{kind}").collect()) for kind in ("got", "expected")]
        assert lines[0] == lines[1] and len(lines[0]) == 3


def test_lists_are_written_from_packed_ones(spark, tmp_path, monkeypatch):
    seen, nest = [], D.nest
    monkeypatch.setattr(D, "nest", lambda u, packed=False: seen.append(packed) or nest(u, packed))
    u = spark.range(3).selectExpr(
        "id AS conv_pos", "0 AS utt_idx", "id AS conversation_id", "'s' AS strategy", "'t' AS topic", "'A' AS speaker", "'x' AS text",
        "'x' AS original_text", "1 AS tokens", "array(struct('x' AS token, 'en' AS lang)) AS tagged_tokens", "array('x') AS tokens_list",
        "array('NN') AS pos_tags", "'no' AS has_code_switch", "0.0D AS spanish_percentage",
    )
    D.write_conversations(u, f"{tmp_path}/lines")
    assert seen == [True]
    assert nest(u, packed=True).schema.simpleString() == nest(u).schema.simpleString()
    assert sorted(nest(u, packed=True).collect()) == sorted(nest(u).collect())
