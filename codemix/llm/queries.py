"""The registered queries of the subpackage, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from codemix.llm import (
    alignment, ann, chat, collocations, decontam, oracle, pii, secrets, sentencepiece_bpe, sharding, simhash, token_files, toxicity,
    warc,
)
from codemix.llm.common import table


def op1_token_files(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(table(spark, sf_dir, "documents"), path)


def op2_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.digest(table(spark, sf_dir, "documents"), path)


def op6_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.report(found)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


def op12_chat_windows(spark, sf_dir):
    return chat.digest(chat.windows(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_files": op1_token_files,
    "op2_simhash": op2_simhash,
    "op3_nearest": op3_nearest,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_secret_scan": op10_secret_scan,
    "op11_alignment": op11_alignment,
    "op12_chat_windows": op12_chat_windows,
    "op13_collocations": op13_collocations,
}
ORACLE: dict[str, str] = {
    "op6_decontamination": oracle.DECONTAMINATION,
    "op8_warc": oracle.WARC,
    "op12_chat_windows": oracle.CHAT,
    "op13_collocations": oracle.COLLOCATIONS,
}
