"""Types of the dataset, the utterance table and its flat export."""

from __future__ import annotations

from pyspark.sql import types as t

TAGGED = t.ArrayType(
    t.StructType([
        t.StructField("token", t.StringType()),
        t.StructField("lang", t.StringType()),
    ])
)

METADATA = t.StructType([
    t.StructField("generation_method", t.StringType()),
    t.StructField("generation_date", t.StringType()),
    t.StructField("last_updated", t.StringType()),
    t.StructField("total_conversations", t.LongType()),
    t.StructField("total_utterances", t.LongType()),
    t.StructField("total_tokens", t.LongType()),
    t.StructField("code_switching_utterances", t.LongType()),
    t.StructField("monolingual_spanish_utterances", t.LongType()),
    t.StructField("monolingual_english_utterances", t.LongType()),
    t.StructField("mixed_bilingual_utterances", t.LongType()),
    t.StructField("fixes_applied", t.StructType([
        t.StructField("conversations_fixed", t.LongType()),
        t.StructField("utterances_fixed", t.LongType()),
        t.StructField("fix_method", t.StringType()),
    ])),
])

# On disk a tagged token is a two-element array.
STORED_UTTERANCE = t.StructType([
    t.StructField("speaker", t.StringType()),
    t.StructField("text", t.StringType()),
    t.StructField("original_text", t.StringType()),
    t.StructField("tokens", t.IntegerType()),
    t.StructField("tagged_tokens", t.ArrayType(t.ArrayType(t.StringType()))),
    t.StructField("tokens_list", t.ArrayType(t.StringType())),
    t.StructField("pos_tags", t.ArrayType(t.StringType())),
    t.StructField("has_code_switch", t.StringType()),
    t.StructField("spanish_percentage", t.DoubleType()),
])

STORED_CONVERSATION = t.StructType([
    t.StructField("conversation_id", t.LongType()),
    t.StructField("strategy", t.StringType()),
    t.StructField("topic", t.StringType()),
    t.StructField("utterances", t.ArrayType(STORED_UTTERANCE)),
])

DOCUMENT = t.StructType([
    t.StructField("metadata", METADATA),
    t.StructField("conversations", t.ArrayType(STORED_CONVERSATION)),
])

# One JSON line. A conversation longer than one line may hold goes on in
# further lines with the next `part`.
CONVERSATION_LINE = t.StructType(
    [t.StructField("conv_pos", t.LongType()), t.StructField("part", t.LongType())]
    + STORED_CONVERSATION.fields
)

UTTERANCE_COLUMNS = [
    "conv_pos", "conversation_id", "utt_idx", "speaker", "text", "original_text",
    "tokens", "tagged_tokens", "tokens_list", "pos_tags", "has_code_switch",
    "spanish_percentage", "strategy", "topic",
]

EXPORT = t.StructType([
    t.StructField("id", t.LongType()),
    t.StructField("conversation_id", t.LongType()),
    t.StructField("utterance_id", t.IntegerType()),
    t.StructField("speaker", t.StringType()),
    t.StructField("utterance", t.StringType()),
    t.StructField("tokens", t.StringType()),
    t.StructField("pos_tags", t.StringType()),
    t.StructField("has_code_switch", t.StringType()),
    t.StructField("spanish_percentage", t.StringType()),
    t.StructField("generation_strategy", t.StringType()),
    t.StructField("topic", t.StringType()),
])
