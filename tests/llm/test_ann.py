"""Nearest neighbours beside brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import ann


def _brute(ids, vectors, query, k):
    own = vectors[list(ids).index(query)]
    far = np.sqrt(((vectors - own) ** 2).sum(axis=1))
    far[np.array(ids) == query] = np.inf
    return [(ids[i], far[i]) for i in np.lexsort((ids, far))[:k] if np.isfinite(far[i])]


def _frame(spark, ids, vectors):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_exact_scores(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 10)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(3000, 16))
    if clusters:
        vectors += 6 * draw.normal(size=(clusters, 16))[draw.integers(0, clusters, 3000)]
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(3000)
    found = ann.search(_frame(spark, ids, vectors), F.col("vec_id") % 50 == 0).collect()
    assert len(found) == 600
    hits = 0
    for query in range(0, 3000, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [rank for rank, _, _ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        for _, v, s in mine:
            assert s == pytest.approx(np.sqrt(((vectors[v] - vectors[query]) ** 2).sum()), rel=1e-14)
        hits += len({v for _, v, _ in mine} & {v for v, _ in _brute(ids, vectors, query, 10)})
    assert hits / 600 >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    vectors = np.concatenate([np.ones((300, 4)), np.random.default_rng(2).normal(size=(40, 4))])
    found = ann.search(_frame(spark, range(340), vectors), F.col("vec_id") == 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)]


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]),
        (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 2.0, 3.0]), (0, [1.0, 0.5]), (9, []), (10, [float("inf"), 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("part", "v", "block", "rank", "score")})
    found = ann.search(df, F.col("vec_id") < 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (1, 1, 2), (1, 2, 0), (1, 3, 7), (2, 1, 1), (2, 2, 0), (2, 3, 7)]
    assert ann.search(df.limit(0), F.col("vec_id") < 3).count() == 0
    assert ann.search(df.where("vec_id in (3, 4, 5)"), F.col("vec_id") < 9).count() == 0


def test_parts_are_balanced_and_cut_few_edges():
    draw = np.random.default_rng(3)
    vectors = 5 * draw.normal(size=(8, 10))[np.arange(1600) % 8] + draw.normal(size=(1600, 10))
    neighbours = ann.nearest(vectors, 10)
    part = ann.balanced_parts(vectors, neighbours, 8)
    assert np.bincount(part).max() - np.bincount(part).min() <= 8
    assert (part[neighbours] == part[:, None]).mean() > 0.8


def test_router_finds_clusters():
    draw = np.random.default_rng(4)
    centres = 6 * draw.normal(size=(16, 12))
    make = lambda n: centres[np.arange(n) % 16] + draw.normal(size=(n, 12))
    router = ann.fit(make(1600), 16, 10)
    assert router.probes <= 6
    again = ann.fit(make(1600), 16, 10)
    assert again.w1.shape == router.w1.shape


def test_every_query_gets_its_number_even_from_nearly_empty_parts(spark):
    """All but a few of the rows are copies, which the router files under one part."""
    draw = np.random.default_rng(6)
    vectors = np.concatenate([np.tile(draw.normal(size=8), (900, 1)), draw.normal(size=(60, 8)) * 5])
    found = ann.search(_frame(spark, range(960), vectors), F.col("vec_id") % 20 == 0).collect()
    ranks = {}
    for r in found:
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert sorted(ranks) == list(range(0, 960, 20))
    assert all(sorted(x) == list(range(1, 11)) for x in ranks.values())


def test_visits_go_on_until_enough_rows_are_held():
    zero = np.zeros
    router = ann.Router(zero(2), 1.0, zero((2, 3)), zero(3), zero((3, 4)), np.array([4.0, 3.0, 2.0, 1.0]), 1)
    visit = lambda held, least: [len(p) for p in router.visited(zero((1, 2)), np.array(held), least)]
    assert visit([30, 1, 1, 1], 22) == [1]
    assert visit([5, 0, 20, 100], 22) == [3]
    assert visit([1, 1, 1, 1], 22) == [4]
