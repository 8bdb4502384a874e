"""A training corpus from documents: without toxic texts, near-copies, benchmark passages
and personal data, as SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and a stored table of documents, and returns
the table that the next one gets once it is written. All but the last return the columns
of the documents. Null and empty texts are documents like others: no stage but the
near-copies' can reject them, of which one stays. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codemix.llm import decontam, pii, sentencepiece_bpe, simhash, toxicity
from codemix.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labels of these documents and rejects some of them."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints the document with the least id stays."""
    return simhash.keep_one_of_each(docs, shingle=3, distance=2)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts are replaced by their kind; n_chars follows the text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast("long"))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoding of every text, as digests."""
    return sentencepiece_bpe.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("sentencepiece", encoded),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
