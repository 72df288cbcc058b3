"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet
into the shared folder and reads them again for the next. All but the last return the columns of documents.

Defined results, in every stage: null text is treated as empty, and stays null until line_dedup, after which it is empty; n_chars
is the length of the text as it is now; a null source is a source of its own; null ids are one id, the largest; an empty
table gives an empty one; columns that documents doesn't have are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.plans.durable import remove, shared_folder

from . import lines, mixing, quality, similar, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as it is now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, scores at least 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality.keep_good(docs, quality.fit(docs, labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    return _documents(lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the least id."""
    return _documents(similar.one_of_each(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return _documents(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids."""
    out = tokens.encode(docs.select("doc_id", "lang", "source", "text"), then=_without_text, schema="doc_id long, lang string, source string, ids array<int>")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _without_text(batches, _):
    for batch in batches:
        yield batch.select(["doc_id", "lang", "source", "ids"])


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier's and the encoder's results can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder is removed as soon as the next one's is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
