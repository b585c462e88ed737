"""The corpus pipeline: quality, near duplicates, secrets, the mix of sources, and tokens, in this order.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents. Stages of near duplicates take five words and a similarity of 0.8.

Cases, by stage. A null or empty text: gets the score of a text without words, which decides whether it stays; is no near
duplicate of anything; has no secrets; has size 0 in the mix, is drawn by its source's share and takes no words; has no
tokens. Very long texts are read whole. Rows that repeat a document: one is kept by near duplicates. Ties: the smallest
doc_id of a group stays. A null doc_id: scored; a copy of a row with an id goes, and of equal ones without, one stays. A null
source is a source of its own. Labels for other documents, or none at all: see sparkwright/llm/quality.py. An empty table
gives an empty table. Further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import bpe, mixing, quality, secrets
from sparkwright.llm.neardup import NearDup
from sparkwright.llm.shared import fresh, shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; the others go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return NearDup(shingle=5, percent=80).keep(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars counted again where the text has changed."""
    old = fresh(docs, "old_text")
    out = secrets.redact(docs.withColumn(old, F.col("text")), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    changed = ~F.col("text").eqNullSafe(F.col(old))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the sources' target weights ask, none, once or up to three times."""
    return mixing.apply(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether these decode to the text."""
    out = bpe.round_trip(docs.select("doc_id", "text", "lang", "source", "n_chars"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("whole"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: Network, sketches and draws are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
