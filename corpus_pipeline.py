"""A training corpus from `documents`: stages that each read what the one before has written.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Documents that the quality
classifier rejects go; of near duplicates (SimHash fingerprints of three-word shingles within two bits) one stays; secrets
that are no widely copied examples are masked; each document is there as often as the mix takes it; the last stage encodes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, mixing, quality, secrets, simhash
from lettermill.llm.common import checkpointed, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.masked(docs, F.col("source"), F.struct("source", "lang"))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: Compression, XXH64 fingerprints and byte-pair merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each other stage's are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
