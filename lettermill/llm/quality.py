"""Quality classifier by compression: which of two dictionaries, good or bad text, shortens a text more.

A text is cut into pieces of a fixed number of bytes and each is compressed with both zstandard dictionaries, so long
texts keep the dictionaries' influence. The normalised difference (bad - good) / (bad + good) of the compressed sizes
becomes a probability by a logistic curve fitted on labelled rows that the dictionaries have not seen. The curve also
has the logarithm of the mean compressed share of the text's bytes and its square: both dictionaries shorten a text
that repeats itself equally well, so the difference alone says little there. Its offset is moved from the sample's
share of label 1 to that of all learnable labels.

Fitted on a bounded sample: `SAMPLE_ROWS` labelled rows of each label, of at most `SAMPLE_CHARS` characters each.
Null and empty texts get the share of label 1 (their sizes say nothing); repeated rows score alike; with fewer than
three rows of either label every text gets the share of label 1 among them (0.5 without any); very long texts are
compressed whole, piece by piece; an empty table gives no rows; other columns are ignored or, where rows are kept, stay,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lettermill.llm.common import held_out, labelled_sample, text_batches

SAMPLE_ROWS = 1_500
SAMPLE_CHARS = 20_000
PIECE_BYTES = 512
EXAMPLE_BYTES = 2_048
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Scores from here on are label 1.
GOOD_FROM = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries as bytes (or none), the curve's coefficients, and the share of label 1."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    share: float


class Differ:
    """Compressors of one task."""

    def __init__(self, good: bytes, bad: bytes, piece: int = PIECE_BYTES) -> None:
        self.piece = piece
        self.size_good, self.size_bad = self._sizer(good), self._sizer(bad)

    @staticmethod
    def _sizer(data: bytes):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        parameters = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, **parameters).compress
        return lambda piece: len(compress(piece))

    def sizes(self, text: str) -> tuple[float, float] | None:
        """Normalised difference of the two compressed sizes, and log of their mean's share of the bytes; None if empty."""
        data = text.encode()
        if not data:
            return None
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        good, bad = sum(map(self.size_good, pieces)), sum(map(self.size_bad, pieces))
        return (bad - good) / (bad + good), math.log((bad + good) / (2 * len(data)))


def features(sizes: tuple[float, float]) -> tuple[float, ...]:
    difference, share = sizes
    return (20 * difference, share, share * share, 1.0)


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients of P(y = 1) by Newton steps, with a small ridge against perfect separation."""
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(rows: list[tuple[int, str]], population: dict[int, int] | None = None) -> QualityModel:
    """rows: (label 0 or 1, text). Of each label every third text is kept from the dictionaries, for the curve.

    population: rows of each label that the sample stands for; by default the sample's own.
    """
    texts = {label: [text for found, text in rows if int(found) == label] for label in (0, 1)}
    n = {label: len(found) for label, found in texts.items()}
    real = population or n
    share = real.get(1, 0) / (real.get(0, 0) + real.get(1, 0)) if real.get(0, 0) + real.get(1, 0) else 0.5
    if min(n.values()) < 3:
        return QualityModel(b"", b"", (), share)
    dictionaries = {}
    for label, found in texts.items():
        learnt = [text.encode() for i, text in enumerate(found) if i % 3]
        pieces = [data[i : i + EXAMPLE_BYTES] for data in learnt for i in range(0, len(data), EXAMPLE_BYTES)]
        try:
            dictionaries[label] = zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few examples to train from: they are the dictionary
            dictionaries[label] = b"".join(pieces)[-DICTIONARY_BYTES:]
    differ = Differ(dictionaries[1], dictionaries[0])
    curve = [(features(sizes), label) for label, found in texts.items() for text in found[::3] if (sizes := differ.sizes(text))]
    y = np.array([float(label) for _, label in curve])
    beta = logistic_fit(np.array([x for x, _ in curve]), y)
    seen = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    kept = min(max(share, 1e-6), 1 - 1e-6)
    beta[-1] += math.log(kept / (1 - kept)) - math.log(seen / (1 - seen))
    return QualityModel(dictionaries[1], dictionaries[0], tuple(map(float, beta)), share)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> QualityModel:
    """labels: doc_id, quality (0 or 1). Held-out documents are never examples."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    sample, population = labelled_sample(docs, known, "quality", rows, max_chars)
    return fit(sample, population)


def score_texts(model: QualityModel, texts: list[str], differ: Differ | None) -> list[float]:
    out = []
    for text in texts:
        sizes = differ.sizes(text) if differ else None
        if sizes is None:
            out.append(model.share)
        else:
            z = sum(b * x for b, x in zip(model.curve, features(sizes), strict=True))
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
    return out


def with_scores(docs: DataFrame, model: QualityModel, name: str = "score", least: float | None = None) -> DataFrame:
    """All columns and the score under `name` (which must be new); least: only rows that score so much or more."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        differ = Differ(own.good, own.bad) if own.good else None
        for batch in batches:
            scores: list[float] = []
            for _, texts in text_batches(batch):
                scores += score_texts(own, texts, differ)
            out = batch.append_column(name, pa.array(scores, pa.float64()))
            yield out if least is None else out.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_scores(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    """Documents, with all their columns, that score `good_from` or more."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, fit_quality(docs, labels), name, good_from).drop(name)
