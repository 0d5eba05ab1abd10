"""Language identification: the nearest of several centroids per language, by cosine over TF-IDF weighted n-grams.

A text is lower-cased, letters stay and all else becomes one space; its 1- to 3-grams of code points are hashed to
`DIMENSIONS` counts, weighted by inverse document frequency and normalised. The learnt texts of a language are
clustered by spherical k-means, since a language has several styles. A text farther from every centroid than nearly
all learnt texts of the nearest language are from theirs is rejected (`und` in `language`); its nearest stays visible.

Fitted on a bounded sample: `SAMPLE_ROWS` rows of each language, of at most `SAMPLE_CHARS` characters each, and
`common.SAMPLE_TOTAL` rows in all. The model has CENTROIDS vectors for each language, 128 KB.
Null texts and texts without a letter are `und` with score 0; without any learnt language all are. Repeated rows are
judged alike; very long texts are counted whole, in parts; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import held_out, labelled_sample, text_batches

SAMPLE_ROWS = 500
SAMPLE_CHARS = 20_000
DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Share of the learnt texts of a language whose distance is still accepted.
ACCEPTED = 0.995
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray  # DIMENSIONS
    centroids: np.ndarray  # (languages x CENTROIDS, DIMENSIONS), unit vectors
    language_of: np.ndarray  # of each centroid
    least: np.ndarray  # smallest cosine that a language accepts


def letters_table() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: Code points counted at once, so that memory does not grow with a text.
PART = 1 << 20


def n_gram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashed counts of the whole text, or None if it has no letter."""
    counts = np.zeros(DIMENSIONS)
    tail = np.full(1, 32, np.uint32)  # what the next part's n-grams reach back to
    found = False
    for start in range(0, len(text), PART):
        part = text[start : start + PART].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        found = found or bool(is_letter.any())
        codes = np.where(is_letter, codes, np.uint32(32))
        old = len(tail)
        codes = np.concatenate([tail, codes, np.full(int(start + PART >= len(text)), 32, np.uint32)])
        keep = np.ones(len(codes), bool)
        keep[old:] = (codes[old:] != 32) | (codes[old - 1 : -1] != 32)  # one space for a run
        new = int(keep[old:].sum())
        codes = codes[keep]
        if not new:
            continue
        hashed = codes * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0xC2B2AE3D)
            own = hashed[-new:] if new < len(hashed) else hashed  # n-grams that end in this part
            counts += np.bincount(own >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
        tail = codes[-2:]
    return counts if found else None


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("...i,...i->...", rows, rows))[..., None], 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; the square root keeps one frequent n-gram from deciding."""
    return unit(np.sqrt(counts, dtype=np.float32) * idf).astype(np.float32, copy=False)


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the first seeds are the rows farthest from the seeds before them."""
    seeds = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(seeds) < min(k, len(rows)):
        nearest = (rows @ rows[seeds].T).max(axis=1)
        seeds.append(int(np.argmin(nearest)))
    centroids = rows[seeds]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        centroids = np.stack([unit(rows[own == c].mean(axis=0)) if (own == c).any() else centroids[c] for c in range(len(centroids))])
    return centroids


def fit(rows: list[tuple[str, str]]) -> LanguageModel | None:
    """rows: (language, text); None if no text has a letter."""
    letters = letters_table()
    # Only n-grams that occur are kept; the whole vectors of one language at a time.
    sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    seen, n = np.zeros(DIMENSIONS, np.int64), 0
    for language, text in rows:
        if (counts := n_gram_counts(text, letters)) is not None:
            at = np.flatnonzero(counts)
            sparse.setdefault(language, []).append((at.astype(np.int32), counts[at].astype(np.float32)))
            seen[at] += 1
            n += 1
    if not sparse:
        return None
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    languages = tuple(sorted(sparse))
    centroids, language_of, least = [], [], []
    for i, language in enumerate(languages):
        matrix = np.zeros((len(sparse[language]), DIMENSIONS), np.float32)
        for row, (at, counts) in zip(matrix, sparse.pop(language), strict=True):
            row[at] = counts
        own = weighted(matrix, idf)
        means = spherical_means(own, CENTROIDS)
        centroids.append(means)
        language_of += [i] * len(means)
        least.append(float(np.quantile((own @ means.T).max(axis=1), 1 - ACCEPTED)))
    return LanguageModel(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(language_of), np.array(least))


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> LanguageModel | None:
    """Learns from text and non-null lang of documents that are not held out."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull())
    return fit(labelled_sample(docs, known, "lang", rows, max_chars)[0])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, language (`und` if rejected), nearest (`und` only without letters) and score, the cosine."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, language string, nearest string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letters = sent.value, letters_table()
        for batch in batches:
            nearest = [UNKNOWN] * batch.num_rows
            language, score = list(nearest), [0.0] * batch.num_rows
            for start, all_texts in text_batches(batch):
                for low in range(0, len(all_texts), 256):
                    counts = {start + low + i: c for i, text in enumerate(all_texts[low : low + 256]) if own and (c := n_gram_counts(text, letters)) is not None}
                    if not counts:
                        continue
                    cosines = weighted(np.stack(list(counts.values())), own.idf) @ own.centroids.T
                    best = cosines.argmax(axis=1)
                    for row, centroid, cosine in zip(counts, best, cosines.max(axis=1), strict=True):
                        at = own.language_of[centroid]
                        nearest[row] = own.languages[at]
                        language[row] = own.languages[at] if cosine >= own.least[at] else UNKNOWN
                        score[row] = min(1.0, max(0.0, float(cosine)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(language), pa.array(nearest), pa.array(score, pa.float64())],
                names=["doc_id", "language", "nearest", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred (the nearest learnt language), score and rejected of every document."""
    found = identify(docs, fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("nearest").alias("lang_pred"), "score", (F.col("language") != F.col("nearest")).alias("rejected"))
