"""Letter vectors learnt from the letters themselves: the leading singular vectors of the TF-IDF rows.

The decomposition needs the rows only in sums over letters: for a narrow block B of columns, W^T (W B) is added up
in tasks, and a matrix of terms by columns reaches the driver. Blocks start from a seeded random one, each next one is the last
product made orthogonal to all before it, and the best axes within their span are taken (a randomised block Krylov
method). It ends when the wanted axes are exact to `TOLERANCE`, or the blocks span all terms and nothing is left out.

The driver and every task hold the vocabulary times the columns of the blocks, which the caller bounds by the model's
number of terms; letters are never collected. Letters without a known term, or without text, have the zero vector.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.operators.storage import stored
from lettermill.operators.tfidf import TfidfModel, add_weights, fit_tfidf

# The functions run in tasks travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest error of an axis, relative to the variance of the first.
TOLERANCE = 1e-9
#: Columns of a block beyond the axes wanted, and cells of the rows that a task holds at a time.
SPARE_COLUMNS, CHUNK_CELLS = 8, 1 << 22
MOST_BLOCKS = 40


@dataclass(frozen=True)
class TermSpace:
    """axes: terms by size, orthonormal columns; variances: sum over letters of the squared coordinate; error: the
    largest |W^T W a - v a| of an axis, relative to the first variance."""

    model: TfidfModel
    axes: np.ndarray
    variances: tuple[float, ...]
    error: float

    @property
    def size(self) -> int:
        return self.axes.shape[1]


def _dense(rows: pd.DataFrame, terms: int) -> Iterator[np.ndarray]:
    """The rows (indices, values) as dense matrices of bounded size, in order."""
    step = max(1, CHUNK_CELLS // terms)
    for start in range(0, len(rows), step):
        part = rows.iloc[start : start + step]
        out = np.zeros((len(part), terms))
        places = np.repeat(np.arange(len(part)), [len(i) for i in part["indices"]])
        out[places, np.concatenate(part["indices"].to_numpy())] = np.concatenate(part["values"].to_numpy())
        yield out


def _sparse(letters: DataFrame, model: TfidfModel, text_col: str, *keep: str) -> DataFrame:
    """Indices and values of each letter's weights."""
    weighted = add_weights(letters.select(*keep, text_col), model, text_col)
    # The weights are sparse vectors as the counter makes them: their indices are never null.
    return weighted.withColumn("_v", F.unwrap_udt("tfidf")).select(*keep, F.col("_v.indices"), F.col("_v.values"))


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """W^T (W block) over all rows (indices, values) of W."""
    terms = len(block)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(block.shape)
        for batch in batches:
            for w in _dense(batch, terms):
                total += w.T @ (w @ block)
        yield pd.DataFrame({"term": np.arange(terms), "product": list(total)})

    parts = rows.mapInPandas(added, "term int, product array<double>")
    sums = parts.groupBy("term").agg(vector_to_array(Summarizer.sum(array_to_vector("product"))).alias("product"))
    out = np.zeros(block.shape)
    for row in sums.collect():
        out[row["term"]] = row["product"]
    return out


def _orthonormal(block: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A basis of what the block adds to the span of the orthonormal others."""
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):  # once more removes what rounding has left
        block = block - others @ (others.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    room = len(block) - others.shape[1]
    new = u[:, s > 1e-11 * max(scale, 1e-300)][:, :room]
    # Directions that are nearly lost to rounding are made orthogonal again.
    return np.linalg.qr(new - others @ (others.T @ new))[0]


def fit_term_space(
    letters: DataFrame, model: TfidfModel, size: int = 64, text_col: str = "text_cleaned", seed: int = 42
) -> TermSpace:
    """The `size` leading axes, or as many as there are terms; each has its greatest coordinate positive.

    Reruns agree up to the order in which doubles are added. Axes of equal variance may turn within their plane.
    """
    terms = len(model.terms)
    size = min(size, terms)
    rows, _ = stored(_sparse(letters, model, text_col))
    basis, images = np.zeros((terms, 0)), np.zeros((terms, 0))
    start = np.random.default_rng(seed).standard_normal((terms, min(terms, size + SPARE_COLUMNS)))
    block = _orthonormal(start, basis)
    for _ in range(MOST_BLOCKS):
        image = gram_product(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:size], turns[:, ::-1][:, :size]
        axes = basis @ turns
        error = float(np.linalg.norm(images @ turns - axes * values, axis=0).max() / max(values[0], 1e-300))
        block = _orthonormal(image, basis)
        if len(values) == size and error <= TOLERANCE or block.shape[1] == 0:
            break
    rows.unpersist()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return TermSpace(model, axes * signs, tuple(float(max(v, 0.0)) for v in values), error)


def add_learnt_vectors(
    letters: DataFrame, space: TermSpace, text_col: str = "text_cleaned", output_col: str = "learnt"
) -> DataFrame:
    """Add each letter's coordinates, an array<double>; a column of that name is replaced. Row-local."""
    axes = space.axes

    @F.pandas_udf("array<double>")
    def coordinates(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([v for w in _dense(rows, len(axes)) for v in w @ axes], dtype=object)

    weighted = add_weights(letters, space.model, text_col, output_col="_tfidf")
    pair = F.struct(F.unwrap_udt("_tfidf")["indices"].alias("indices"), F.unwrap_udt("_tfidf")["values"].alias("values"))
    return weighted.withColumn(output_col, coordinates(pair)).drop("_tfidf")


def learnt_space(
    letters: DataFrame, size: int = 64, max_features: int = 1000, text_col: str = "guarantee_letter_text"
) -> TermSpace:
    """Vocabulary and axes of raw letters, those of the training set as a rule."""
    cleaned = letters.select(text.clean_text(F.col(text_col)).alias("text_cleaned"))
    return fit_term_space(cleaned, fit_tfidf(cleaned, max_features), size)


def save_term_space(space: TermSpace, spark: SparkSession, path: str) -> None:
    """A row per term with its coordinates, and one row of what belongs to the whole: few rows, a file each."""
    model = space.model
    rows = zip(range(len(model.terms)), model.terms, model.term_counts, model.document_counts, space.axes.tolist())
    terms = spark.createDataFrame(list(rows), "position int, term string, term_count bigint, document_count bigint, axes array<double>")
    terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    about = [(model.documents, *model.ngram_range, list(space.variances), space.error)]
    whole = spark.createDataFrame(about, "documents bigint, low int, high int, variances array<double>, error double")
    whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_term_space(spark: SparkSession, path: str) -> TermSpace:
    rows = spark.read.parquet(f"{path}/terms").orderBy("position").collect()
    about = spark.read.parquet(f"{path}/about").first()
    columns = [tuple(r[c] for r in rows) for c in ("term", "term_count", "document_count")]
    model = TfidfModel(*columns, about["documents"], (about["low"], about["high"]))
    return TermSpace(model, np.array([r["axes"] for r in rows]), tuple(about["variances"]), about["error"])
