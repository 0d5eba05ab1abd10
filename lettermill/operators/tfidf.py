"""TF-IDF terms, weights and similar letters.

The fitted model is a bounded vocabulary on the driver. Weighting letters is
row-local from there on (MLlib's vectors, on the JVM), so no text and no
(letter, term) table is ever shuffled: only term counts and vector sums are.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import text, vectors
from lettermill.operators.storage import stored

# The functions run in tasks travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are compared at this many decimals: copies of a letter then tie
# and are ordered by their id, whatever the order of the additions was.
SCORE_DECIMALS = 9
#: Letters of a block that meets a block of targets.
LETTER_ROWS = 16_384
#: Scores that a task holds at a time, and groups of best letters that wait to be merged.
SCORE_CELLS, MOST_WAITING = 1 << 20, 16


@dataclass(frozen=True)
class TfidfModel:
    terms: tuple[str, ...]
    term_counts: tuple[int, ...]
    document_counts: tuple[int, ...]
    documents: int
    ngram_range: tuple[int, int]

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.documents) / (1 + df)) + 1 for df in self.document_counts]


def _with_ngrams(rows: DataFrame, words: str, low: int, high: int, output: str) -> DataFrame:
    """Replace an array of words by all its n-grams; one that would span a null word is left out.

    Level n is level n-1 zipped with the words n-1 places on, so the cost grows with the number of words alone. Each level
    is a projection of its own: within one, the planner would make the words and the lower levels anew for every use.
    """
    levels = [f"{output}_{n}" for n in range(1, high + 1)]
    rows = rows.withColumn(levels[0], F.col(words))
    for n in range(2, high + 1):
        later = F.slice(levels[0], F.lit(n), F.size(levels[0]))
        longer = F.zip_with(levels[n - 2], later, lambda a, b: F.concat(a, F.lit(" "), b))
        rows = rows.withColumn(levels[n - 1], longer)
    wanted = levels[low - 1 :]
    joined = F.col(wanted[0]) if len(wanted) == 1 else F.concat(*wanted)
    return rows.withColumn(output, F.filter(joined, lambda g: g.isNotNull())).drop(words, *levels)


def _only(words: Column, kept: list[str]) -> Column:
    """Words outside a set become null, which breaks the n-grams there."""
    return F.transform(words, lambda w: F.when(w.isin(kept), w))


def _most_frequent(rows: DataFrame, grams: str, k: int) -> list[tuple[str, int]]:
    """The k commonest terms of an array column with their occurrences."""
    counts = text.exploded(rows, [], F.col(grams), "term").groupBy("term").agg(F.count("*").alias("n"))
    return [(r["term"], r["n"]) for r in counts.orderBy(F.desc("n"), F.asc("term")).limit(k).collect()]


def _letter_counts(words: DataFrame, terms: list[str], low: int, high: int) -> dict[str, int]:
    """The letters that each of some terms occurs in: only these terms are told apart by letter."""
    rows = words if high == 1 else _known_ngrams(words, "words", terms, low, high, "grams")
    found = F.array_intersect(rows.columns[0], F.array(*[F.lit(t) for t in terms]))
    counts = text.exploded(rows, [], found, "term").groupBy("term").agg(F.count("*").alias("df"))
    return {r["term"]: r["df"] for r in counts.collect()}


def _known_ngrams(rows: DataFrame, words: str, terms: list[str], low: int, high: int, output: str) -> DataFrame:
    """Replace an array of words by the n-grams of the words that some terms consist of."""
    known = sorted({word for term in terms for word in term.split(" ")})
    return _with_ngrams(rows.withColumn(words, _only(F.col(words), known)), words, low, high, output)


def _vocabulary(words: DataFrame, k: int, low: int, high: int) -> list[tuple[str, int]]:
    """The k n-grams with the highest counts; ties go by the term.

    An n-gram is never more frequent than its rarest word, and never before its first word in the order of terms. So
    one that is to be placed before the k-th word either consists of words that are all more frequent than that, or is
    as frequent, begins with one of the first k words and comes before the k-th one as text. Counting those alone is
    exact, whatever the number of words that tie with the k-th one, and leaves a small part of the n-grams of the corpus.
    """
    if low > 1:
        return _most_frequent(_with_ngrams(words, "words", low, high, "grams"), "grams", k)

    room = max(10 * k, 1000)
    single = _most_frequent(words, "words", room + 1)
    if high == 1:
        return single[:k]
    if len(single) < k:  # every word is among the first k, and any n-gram may be
        longer = _most_frequent(_with_ngrams(words, "words", 2, high, "grams"), "grams", k)
        return sorted(single + longer, key=lambda t: (-t[1], t[0]))[:k]
    last, floor = single[k - 1]
    # The n-grams' other words are as frequent too; where not too many tie, that is a set.
    others = None if len(single) > room and single[-1][1] == floor else [t for t, n in single if n >= floor]
    if others is not None:
        words = words.withColumn("words", _only(F.col("words"), others))
    grams = _with_ngrams(words, "words", 2, high, "grams")
    if others is None:
        first, above = [t for t, _ in single[:k]], [t for t, n in single[:k] if n > floor]
        grams = grams.withColumn("grams", F.filter("grams", lambda g: _may_precede(g, first, above, last)))
    longer = _most_frequent(grams, "grams", k)
    return sorted(single[:k] + longer, key=lambda t: (-t[1], t[0]))[:k]


def _may_precede(gram: Column, first: list[str], above: list[str], last: str) -> Column:
    """Whether an n-gram may be placed before the word `last`; above: the words that are more frequent than it."""
    begins = F.substring_index(gram, " ", 1).isin(first) & (gram < last)
    if not above:
        return begins
    return begins | F.forall(F.split(gram, " "), lambda w: w.isin(above))


def _counted(letters: DataFrame, terms: list[str], low: int, high: int, text_col: str) -> DataFrame:
    """Add the vector of term counts; a null text has none."""
    worded = letters.withColumn("_words", text.tokens(F.coalesce(F.col(text_col), F.lit(""))))
    grams = _known_ngrams(worded, "_words", terms, low, high, "_grams")
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_counts")
    return counter.transform(grams).drop("_grams")


def fit_tfidf(
    letters: DataFrame,
    max_features: int = 100,
    ngram_range: tuple[int, int] = (1, 3),
    text_col: str = "text_cleaned",
) -> TfidfModel:
    """Choose the vocabulary and count the letters each term occurs in; the texts are cut into words once."""
    low, high = ngram_range
    words, size = stored(letters.select(text.tokens(F.col(text_col)).alias("words")))
    ranked = _vocabulary(words, max_features, low, high)
    terms = [t for t, _ in ranked]
    found = _letter_counts(words, terms, low, high) if terms else {}
    words.unpersist()
    return TfidfModel(
        tuple(terms),
        tuple(n for _, n in ranked),
        tuple(found[t] for t in terms),
        size,
        ngram_range,
    )


def add_weights(
    letters: DataFrame, model: TfidfModel, text_col: str = "text_cleaned", output_col: str = "tfidf"
) -> DataFrame:
    """Add the L2-normalised TF-IDF vector of each letter."""
    if not model.terms:
        raise ValueError("the corpus has no terms")
    counted = _counted(letters, list(model.terms), *model.ngram_range, text_col)
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(model.idf), inputCol="_counts", outputCol="_weighted"
    ).transform(counted)
    normal = Normalizer(p=2.0, inputCol="_weighted", outputCol=output_col).transform(weighted)
    return normal.drop("_counts", "_weighted")


def vocabulary(letters: DataFrame, model: TfidfModel) -> DataFrame:
    """The model's terms as rows."""
    rows = zip(model.terms, model.term_counts, model.document_counts, model.idf)
    return letters.sparkSession.createDataFrame(
        list(rows), "term string, term_count bigint, document_count bigint, idf double"
    )


def _by_term(weights: Column, model: TfidfModel) -> Column:
    names = F.array(*[F.lit(t) for t in model.terms])
    pairs = F.zip_with(names, weights, lambda t, w: F.struct(t.alias("term"), w.alias("weight")))
    return F.inline(pairs)


def weights(letters: DataFrame, model: TfidfModel, key: str = "letter_id") -> DataFrame:
    """Non-zero weights as (letter, term, weight) rows."""
    weighted = add_weights(letters.select(key, "text_cleaned"), model)
    return weighted.select(key, _by_term(vector_to_array("tfidf"), model)).where(F.col("weight") > 0)


def top_terms(letters: DataFrame, model: TfidfModel, k: int = 20) -> DataFrame:
    """Terms by mean weight over all letters, zeros included."""
    return top_of_sums(weight_sums(letters.withColumn("class", F.lit(None).cast("int")), model), model, k)


def top_terms_by_class(letters: DataFrame, model: TfidfModel, k: int = 10) -> DataFrame:
    """The same within each class, under the vocabulary and idf of the whole."""
    return top_of_sums_by_class(weight_sums(letters.where(F.col("class").isNotNull()), model), model, k)


def weight_sums(letters: DataFrame, model: TfidfModel) -> DataFrame:
    """Letters per class (or without one) and the sums of their weights: (class, n, sums), a row each, from one pass."""
    weighted = add_weights(letters.select("class", "text_cleaned"), model)
    return weighted.groupBy("class").agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("tfidf"))).alias("sums"))


def top_of_sums(sums: DataFrame, model: TfidfModel, k: int = 20) -> DataFrame:
    """`top_terms` of rows from `weight_sums`."""
    terms = sums.select("n", _by_term(F.col("sums"), model)).groupBy("term")
    means = terms.agg((F.sum("weight") / F.sum("n")).alias("mean_weight"))
    return means.orderBy(F.desc(F.round("mean_weight", 12)), F.asc("term")).limit(k)


def top_of_sums_by_class(sums: DataFrame, model: TfidfModel, k: int = 10) -> DataFrame:
    """`top_terms_by_class` of rows from `weight_sums`."""
    present = sums.where(F.col("class").isNotNull())
    terms = present.select("class", "n", _by_term(F.col("sums"), model))
    terms = terms.select("class", "term", (F.col("weight") / F.col("n")).alias("mean_weight"))
    order = Window.partitionBy("class").orderBy(F.desc(F.round("mean_weight", 12)), F.asc("term"))
    ranked = terms.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


def similar_letters(
    letters: DataFrame, model: TfidfModel, target_id: str, n: int = 5, key: str = "letter_id"
) -> DataFrame:
    """The n letters most like a target by cosine; letters without overlap score 0."""
    weighted = add_weights(letters.select(key, "text_cleaned"), model)
    found = weighted.where(F.col(key) == target_id).select(vector_to_array("tfidf").alias("v")).first()
    if found is None:
        raise ValueError(f"no letter {target_id}")
    score = vectors.dot(vector_to_array("tfidf"), vectors.double_array(found["v"]))
    others = weighted.where(F.col(key) != target_id)
    scored = others.select(key, F.round(score, SCORE_DECIMALS).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(n)


def similar_letters_batch(
    letters: DataFrame,
    targets: DataFrame,
    model: TfidfModel,
    n: int = 5,
    key: str = "letter_id",
    block_size: int = 1024,
) -> DataFrame:
    """The n letters most like each target: (target_id, key, similarity, position).

    A letter with the target's own key is left out. Targets are dealt into blocks of about `block_size` and letters into
    blocks of LETTER_ROWS; each block of the one meets each of the other in a task of its own, as one matrix product
    that gives exactly the n best letters of the block for a target. Nothing but two counts reaches the driver.
    """
    blocks = [math.ceil(df.count() / size) for df, size in ((letters, LETTER_ROWS), (targets, block_size))]
    corpus, wanted = counts_of(letters, model, key), counts_of(targets, model, key)
    if not all(blocks):
        return letters.sparkSession.createDataFrame([], _match_schema(corpus, key) + ", position int")
    own = lambda count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    lefts = wanted.select(every(blocks[0]).alias("a"), own(blocks[1]).alias("b"), F.lit(0).alias("side"), key, "counts")
    rights = corpus.select(own(blocks[0]).alias("a"), every(blocks[1]).alias("b"), F.lit(1).alias("side"), key, "counts")
    return best_of_tiles(lefts.unionByName(rights), model, n, key)


def best_of_tiles(rows: DataFrame, model: TfidfModel, n: int, key: str) -> DataFrame:
    """The n best letters for each target over all tiles in which they meet: (target_id, key, similarity, position).

    rows: a and b (a tile), side (0 target, 1 letter), key and counts of terms, which take half the disk of the
    weights that tasks make of them. A pair may meet in several tiles.
    """
    dealt = rows.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    matches = dealt.mapInPandas(_best_of_task(n, key, model.idf), _match_schema(rows, key))
    matches = matches.groupBy("target_id", key).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("target_id").orderBy(F.desc("similarity"), F.asc(key))
    return matches.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def vectors_of(letters: DataFrame, model: TfidfModel, key: str = "letter_id") -> DataFrame:
    """The key and the TF-IDF vector as an array."""
    weighted = add_weights(letters.select(key, "text_cleaned"), model)
    return weighted.select(key, vector_to_array("tfidf").alias("vector"))


def counts_of(letters: DataFrame, model: TfidfModel, key: str = "letter_id") -> DataFrame:
    """The key and the number of times that each term occurs, an array<int>."""
    counted = _counted(letters.select(key, "text_cleaned"), list(model.terms), *model.ngram_range, "text_cleaned")
    return counted.select(key, vector_to_array("_counts").cast("array<int>").alias("counts"))


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rows of `add_weights`, from rows of counts."""
    rows = counts * idf
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, lengths, out=rows, where=lengths > 0)


def _match_schema(corpus: DataFrame, key: str) -> str:
    kind = corpus.schema[key].dataType.simpleString()
    return f"target_id {kind}, {key} {kind}, similarity double"


def _best(ids, letter_vectors, target_ids, target_vectors, n: int, key: str) -> pd.DataFrame:
    """The n best of some letters per target; of equal scores the smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, letter_vectors = ids[order], letter_vectors[order]
    scores = np.round(letter_vectors @ target_vectors.T, SCORE_DECIMALS)
    scores[ids[:, None] == target_ids[None, :]] = -1.0
    cut = min(n, len(ids))
    floor = np.partition(scores, len(ids) - cut, axis=0)[len(ids) - cut]
    above, tie = scores > floor, scores == floor
    keep = above | (tie & (np.cumsum(tie, axis=0) <= cut - above.sum(axis=0)))
    row, column = np.nonzero(keep & (scores >= 0))
    return pd.DataFrame({"target_id": target_ids[column], key: ids[row], "similarity": scores[row, column] + 0.0})


def _first_n(pool: pd.DataFrame, n: int, key: str) -> pd.DataFrame:
    ordered = pool.sort_values(["target_id", "similarity", key], ascending=[True, False, True])
    return ordered.groupby("target_id", sort=False).head(n)


def _best_of_task(n: int, key: str, idf: list[float]):
    """A mapInPandas function over sorted rows of tiles: the n best letters per target of each tile.

    Scores are made for so many letters at a time that SCORE_CELLS of them are held, whatever the number of targets.
    """

    factors = np.array(idf)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, waiting, targets, kept = None, [], None, []
        for frame in frames:
            for (a, b, side), rows in frame.groupby(["a", "b", "side"], sort=False):
                if (a, b) != tile:
                    if kept:
                        yield _first_n(pd.concat(kept), n, key)
                    tile, waiting, targets, kept = (a, b), [], None, []
                ids, found = rows[key].to_numpy(), np.vstack(rows["counts"].to_numpy())
                if side == 0:
                    waiting.append((ids, found))
                elif waiting:
                    if targets is None:
                        targets = np.concatenate([i for i, _ in waiting]), weighted(np.concatenate([c for _, c in waiting]), factors)
                    step = max(1, SCORE_CELLS // len(targets[0]))
                    for start in range(0, len(ids), step):
                        part = slice(start, start + step)
                        kept.append(_best(ids[part], weighted(found[part], factors), *targets, n, key))
                        if len(kept) > MOST_WAITING:
                            kept = [_first_n(pd.concat(kept), n, key)]
        if kept:
            yield _first_n(pd.concat(kept), n, key)

    return best


def embedding_similarity(embeddings: DataFrame, target_id, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Cosine of every supplied vector to that of a target."""
    found = embeddings.where(F.col(key) == target_id).select(column).first()
    if found is None:
        raise ValueError(f"no vector {target_id}")
    score = vectors.cosine(F.col(column), vectors.double_array(found[column]))
    return embeddings.select(key, score.alias("similarity"))
