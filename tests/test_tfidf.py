import math
import re
from collections import Counter

import numpy as np
import pytest

from lettermill.operators import similar as sm
from lettermill.operators import tfidf as ti

TEXTS = [
    "the cat sat on the mat", "the cat sat", "a dog sat on the cat", "dog dog dog", "", "x",
    "the mat on the mat on the mat", "кот сидел на коврике", "кот сидел", "the cat sat on the mat",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), t, i % 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "letter_id string, text_cleaned string, class int").persist()


def by_hand(texts, k, high):
    """Vocabulary and weights by the definition, one text at a time."""
    counts = []
    for text in texts:
        words = re.findall(r"\w\w+", text.lower())
        counts.append(Counter(" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)))
    total = sum(counts, Counter())
    terms = [t for t, _ in sorted(total.items(), key=lambda tn: (-tn[1], tn[0]))[:k]]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in c for c in counts))) + 1 for t in terms}
    weights = []
    for c in counts:
        raw = {t: c[t] * idf[t] for t in terms if c[t]}
        length = math.sqrt(sum(w * w for w in raw.values()))
        weights.append({t: w / length for t, w in raw.items()})
    return terms, weights


@pytest.mark.parametrize("k, high", [(5, 3), (12, 3), (1000, 3), (4, 1), (3, 2)])
def test_weights_by_definition(corpus, k, high):
    terms, expected = by_hand(TEXTS, k, high)
    model = ti.fit_tfidf(corpus, k, (1, high))
    assert list(model.terms) == terms
    got = {(r.letter_id, r.term): r.weight for r in ti.weights(corpus, model).collect()}
    assert got == pytest.approx({(str(i), t): w for i, ws in enumerate(expected) for t, w in ws.items()})


def test_many_words_tied_at_the_border(spark):
    """More words share the last place than the pruning keeps."""
    texts = [f"w{i} w{i + 1}" for i in range(3000)]
    df = spark.createDataFrame([(str(i), t, 0) for i, t in enumerate(texts)], "letter_id string, text_cleaned string, class int")
    assert list(ti.fit_tfidf(df, 7, (1, 3)).terms) == by_hand(texts, 7, 3)[0]


@pytest.mark.parametrize("k", [1, 3, 8, 20, 40])
def test_ties_of_words_and_longer_terms(spark, k):
    """Thousands of words tie with the last place; some n-grams are placed before it by their count, some by their text."""
    texts = [f"w{i} w{i + 1}" for i in range(3000)] + ["aa bb cc"] * 3 + ["w0000 w0001 zz"] * 2 + ["ab w17 w18 w19"] * 2 + ["w2999 aa"]
    df = spark.createDataFrame([(str(i), t, 0) for i, t in enumerate(texts)], "letter_id string, text_cleaned string, class int")
    assert list(ti.fit_tfidf(df, k, (1, 3)).terms) == by_hand(texts, k, 3)[0]


def test_few_words_and_many_terms(spark):
    texts = ["aa bb aa bb cc", "aa cc bb", "cc cc cc cc"]
    df = spark.createDataFrame([(str(i), t, 0) for i, t in enumerate(texts)], "letter_id string, text_cleaned string, class int")
    for k in (2, 3, 4, 9, 50):
        assert list(ti.fit_tfidf(df, k, (1, 3)).terms) == by_hand(texts, k, 3)[0]


def test_mean_weights_count_the_zeros(corpus):
    terms, weights = by_hand(TEXTS, 6, 3)
    model = ti.fit_tfidf(corpus, 6, (1, 3))
    means = {t: sum(w.get(t, 0) for w in weights) / len(weights) for t in terms}
    got = {r.term: r.mean_weight for r in ti.top_terms(corpus, model, 6).collect()}
    assert got == pytest.approx(means)
    odd = [w for i, w in enumerate(weights) if i % 2]
    own = {r.term: r.mean_weight for r in ti.top_terms_by_class(corpus, model, 6).where("class = 1").collect()}
    assert own == pytest.approx({t: sum(w.get(t, 0) for w in odd) / len(odd) for t in terms})


def nearest_by_hand(texts, target, n):
    _, weights = by_hand(texts, 200, 1)
    scores = []
    for i, w in enumerate(weights):
        if i != target:
            scores.append((round(sum(v * weights[target].get(t, 0) for t, v in w.items()), 9), str(i)))
    return sorted(scores, key=lambda s: (-s[0], s[1]))[:n]


def test_similar_letters(corpus):
    model = ti.fit_tfidf(corpus, 200, (1, 1))
    got = [(r.similarity, r.letter_id) for r in ti.similar_letters(corpus, model, "0", 9).collect()]
    assert [i for _, i in got] == [i for _, i in nearest_by_hand(TEXTS, 0, 9)]
    assert got[0] == (1.0, "9") and got[-1][0] == 0.0
    with pytest.raises(ValueError):
        ti.similar_letters(corpus, model, "none")


@pytest.mark.parametrize("block_size, parts, letter_rows", [(1024, 1, 16384), (60, 5, 16384), (7, 5, 9), (59, 3, 1)])
def test_batch_equals_brute_force_with_copies(spark, monkeypatch, block_size, parts, letter_rows):
    """A third of the letters are copies of one text."""
    monkeypatch.setattr(ti, "LETTER_ROWS", letter_rows)
    texts = ["same words here"] * 20 + [f"word{i % 7} word{i % 5} here" for i in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "letter_id string, text_cleaned string")
    df = df.repartition(parts)
    model = ti.fit_tfidf(df, 200, (1, 1))
    found = ti.similar_letters_batch(df, df, model, 4, block_size=block_size).collect()
    for target in range(len(texts)):
        own = sorted((r.position, r.letter_id, r.similarity) for r in found if r.target_id == str(target))
        expected = nearest_by_hand(texts, target, 4)
        assert [i for _, i, _ in own] == [i for _, i in expected]
        assert [s for _, _, s in own] == pytest.approx([s for s, _ in expected])


def test_corpus_without_terms(spark):
    df = spark.createDataFrame([("1", ""), ("2", "a b")], "letter_id string, text_cleaned string")
    model = ti.fit_tfidf(df)
    assert model.terms == () and model.documents == 2
    with pytest.raises(ValueError):
        ti.add_weights(df, model)


def test_embedding_similarity(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = {r.vec_id: r.similarity for r in ti.embedding_similarity(df, 0).collect()}
    assert got == pytest.approx({0: 1.0, 1: math.sqrt(0.5), 2: 0.0})


def test_weighting_shuffles_no_text(corpus):
    model = ti.fit_tfidf(corpus, 10, (1, 3))
    plan = ti.add_weights(corpus, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def _random_letters(spark, n, words, seed):
    import random

    draw = random.Random(seed)
    texts = [" ".join(f"term{int(60 * draw.random() ** 2)}" for _ in range(words)) for _ in range(n)]
    texts[n // 2 :: 3] = [texts[0]] * len(texts[n // 2 :: 3])
    rows = [(f"{seed}_{i}", t) for i, t in enumerate([*texts, "", "?"])]
    return spark.createDataFrame(rows, "letter_id string, text_cleaned string").repartition(4)


@pytest.mark.parametrize("letter_rows, block_size", [(16384, 1024), (20, 7)])
def test_approximate_search_finds_nine_of_ten(spark, monkeypatch, letter_rows, block_size):
    monkeypatch.setattr(ti, "LETTER_ROWS", letter_rows)
    letters, targets = _random_letters(spark, 700, 12, 1), _random_letters(spark, 60, 12, 2)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    exact = ti.similar_letters_batch(letters, targets, model, 5).persist()
    found = sm.similar_letters_approximate(letters, targets, model, 5, block_size=block_size).persist()
    row = sm.recall(found, exact).first()
    assert row.places > 250 and row.recall >= 0.9
    # Every similarity is exact, and positions follow it.
    vectors = {r.letter_id: r.vector for r in ti.vectors_of(letters.unionByName(targets), model).collect()}
    seen = set()
    for r in found.collect():
        assert r.similarity == pytest.approx(sum(a * b for a, b in zip(vectors[r.target_id], vectors[r.letter_id])), abs=1e-8)
        assert (r.target_id, r.letter_id) not in seen and r.position <= 5
        seen.add((r.target_id, r.letter_id))


def test_approximate_search_of_no_letters(spark):
    letters = _random_letters(spark, 20, 5, 3)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    assert sm.similar_letters_approximate(letters.limit(0), letters, model).count() == 0
    assert sm.similar_letters_approximate(letters, letters.where("text_cleaned = '?'"), model).count() == 0
    assert ti.similar_letters_batch(letters, letters.limit(0), model).count() == 0


def test_batch_sends_nothing_through_the_driver(corpus):
    model = ti.fit_tfidf(corpus, 10, (1, 1))
    plan = ti.similar_letters_batch(corpus, corpus, model)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("cells", [1, 70, 1 << 20])
def test_a_task_holds_a_bounded_number_of_scores(spark, monkeypatch, cells):
    letters, targets = _random_letters(spark, 300, 12, 1), _random_letters(spark, 30, 12, 2)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    want = sorted(map(tuple, ti.similar_letters_batch(letters, targets, model, 5).collect()))
    parts = [ti.counts_of(df, model).selectExpr("0 AS a", "0 AS b", f"{side} AS side", "letter_id", "counts").toPandas() for side, df in enumerate((targets, letters))]
    held, own = [], ti._best
    monkeypatch.setattr(ti, "_best", lambda ids, v, t, *rest: held.append(len(ids) * len(t)) or own(ids, v, t, *rest))
    monkeypatch.setattr(ti, "SCORE_CELLS", cells)
    (got,) = ti._best_of_task(5, "letter_id", model.idf)(iter(parts))
    assert max(held) <= max(cells, len(parts[0]))
    place = got.groupby("target_id").cumcount() + 1
    assert sorted(zip(got["target_id"], got["letter_id"], got["similarity"], place)) == want


@pytest.mark.parametrize("most, sent", [(sm.MOST_SENT, 2), (5119, 0)])
def test_approximate_search_shuffles_vectors_once(spark, monkeypatch, most, sent):
    monkeypatch.setattr(sm, "MOST_SENT", most)
    letters, targets = _random_letters(spark, 60, 12, 1), _random_letters(spark, 10, 12, 2)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sm.similar_letters_approximate(letters, targets, model)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == sent
        assert {r.target_id for r in found.collect()} <= {r.letter_id for r in targets.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weights_are_made_from_the_counts_that_are_shuffled(spark):
    letters = _random_letters(spark, 200, 12, 1)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    joined = ti.counts_of(letters, model).join(ti.vectors_of(letters, model), "letter_id").collect()
    made = ti.weighted(np.array([r.counts for r in joined]), np.array(model.idf))
    assert len(joined) == 202 and np.abs(made - np.array([r.vector for r in joined])).max() < 1e-15 and not made.sum(axis=1).all()
    plan = ti.similar_letters_batch(letters, letters, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "counts#" in plan and "vector#" not in plan
