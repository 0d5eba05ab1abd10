"""Classifier inputs: a dense vector, eight scaled features, class weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.functions import text
from lettermill.operators.preprocess import FEATURE_NAMES, handcrafted_features
from lettermill.operators.termspace import TermSpace, add_learnt_vectors


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per handcrafted feature."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]


def add_vectors(
    letters: DataFrame,
    source: str | TermSpace = "hashing",
    size: int = 128,
    text_col: str = "guarantee_letter_text",
    packed: bool = False,
) -> DataFrame:
    """Add `embedding`, an array<double> per letter; packed: hashed counts as a sparse vector, some four times smaller.

    `source` names a column with supplied vectors, or is a space fitted to cleaned texts, or "hashing" for
    L2-normalised hashed word counts, which need no fitting and no shuffle.
    """
    if isinstance(source, TermSpace):
        cleaned = letters.withColumn("_cleaned", text.clean_text(F.col(text_col)))
        return add_learnt_vectors(cleaned, source, "_cleaned", "embedding").drop("_cleaned")
    if source in letters.columns:
        return letters.withColumn("embedding", F.col(source).cast("array<double>"))
    if source != "hashing":
        raise ValueError(f"no vector column {source!r}")
    # Outer whitespace is in no token, so the text is not trimmed.
    words = text.tokens(F.coalesce(F.col(text_col), F.lit("")))
    worded = letters.withColumn("_words", _buckets(size)(words))
    buckets = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_words", outputCol="_hashed")
    hashed = buckets.transform(worded)
    normal = Normalizer(p=2.0, inputCol="_hashed", outputCol="_normal").transform(hashed)
    return normal.withColumn("embedding", F.col("_normal") if packed else vector_to_array("_normal")).drop("_words", "_hashed", "_normal")


def _buckets(size: int) -> Callable[[Column], Column]:
    """The buckets of arrays of words: the first 32 bits of a word's md5 modulo size; each word of a batch is hashed once."""

    @F.arrow_udf("array<string>")
    def buckets(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        hashed = [int.from_bytes(md5(w, usedforsecurity=False).digest()[:4], "big") % size for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, pa.array([str(h) for h in hashed], pa.string()).take(coded.indices))

    return buckets


def embedding_array(features: DataFrame) -> Column:
    """The embedding as an array, whether it is packed or not."""
    packed = isinstance(features.schema["embedding"].dataType, VectorUDT)
    return vector_to_array("embedding") if packed else F.col("embedding")


def raw_features(
    letters: DataFrame,
    source: str | TermSpace = "hashing",
    size: int = 128,
    domain: Domain = DEFAULT,
    key: str = "letter_id",
    packed: bool = False,
) -> DataFrame:
    """Key, class, embedding (see `add_vectors`) and the eight unscaled features; texts are dropped."""
    keep = [c for c in (key, "class", "origin", "split") if c in letters.columns]
    with_vectors = add_vectors(letters, source, size, packed=packed)
    return handcrafted_features(with_vectors, domain).select(*keep, "embedding", *FEATURE_NAMES)


def fit_scaler(features: DataFrame) -> Scaler:
    """One aggregation; a single row of sixteen numbers reaches the driver.

    Parts of a deviation that are put together leave a rounding error, so a constant is known by its bounds.
    """
    same = lambda c: F.min(c) == F.max(c)
    row = features.agg(
        *[F.when(same(c), F.min(c).cast("double")).otherwise(F.avg(c)).alias(f"mean_{c}") for c in FEATURE_NAMES],
        *[F.when(same(c), 0.0).otherwise(F.stddev_pop(c)).alias(f"dev_{c}") for c in FEATURE_NAMES],
    ).first()
    return Scaler(
        tuple(float(row[f"mean_{c}"] or 0.0) for c in FEATURE_NAMES),
        tuple(float(row[f"dev_{c}"] or 0.0) for c in FEATURE_NAMES),
    )


def scaled(scaler: Scaler) -> list[Column]:
    """z-scores; a constant feature becomes 0."""
    out = []
    for name, mean, deviation in zip(FEATURE_NAMES, scaler.means, scaler.deviations):
        z = F.lit(0.0) if deviation == 0 else (F.col(name) - F.lit(mean)) / F.lit(deviation)
        out.append(z.alias(f"{name}_scaled"))
    return out


def feature_matrix(features: DataFrame, scaler: Scaler) -> DataFrame:
    """Add `features`: the embedding followed by the scaled features."""
    joined = F.concat(embedding_array(features), F.array(*scaled(scaler)))
    return features.withColumn("features", array_to_vector(joined))


def class_weights(df: DataFrame, label: str = "class") -> DataFrame:
    """Balanced weight n / (classes * n_c) per class: one row each."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes")).withColumn("one", F.lit(1))
    # One row is broadcast.
    joined = counts.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")
    return joined.select(label, "n", (F.col("all").cast("double") / (F.col("classes") * F.col("n"))).alias("weight"))
