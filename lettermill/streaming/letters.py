"""Preprocess and score letters as they arrive.

Both steps are stateless projections, so a stream needs no watermark and keeps
no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.domain import DEFAULT, Domain
from lettermill.operators.classifier import TrainedClassifier, predict
from lettermill.operators.features import raw_features
from lettermill.operators.preprocess import preprocess_letters
from lettermill.sources.letters import LETTERS


def stream_letters(spark: SparkSession, path: str, kind: str = "parquet", schema: str = LETTERS) -> DataFrame:
    """New files of a folder as a stream of letters."""
    return spark.readStream.schema(schema).format(kind).load(path)


def preprocess_stream(letters: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    return preprocess_letters(letters, domain)


def score_stream(classifier: TrainedClassifier, letters: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    return predict(classifier, raw_features(letters, classifier.vector_source, domain=domain))
