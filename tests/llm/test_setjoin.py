"""The set similarity join beside all pairs."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from lettermill.llm import setjoin
from tests.llm.helpers import AWKWARD, awkward, words


def slow_join(rows, n=5, least=85):
    """doc_id, size, smallest id reached over links, of every row."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if common and 100 * common >= least * (len(one) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least_id = {r: min((x for x in found if x is not None), default=None) for r, found in ids.items()}
    return sorted(((d, len(sets[i]), least_id[find(i)], d == least_id[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def joined(df, **more):
    return sorted(map(tuple, setjoin.near_duplicates(df, **more).collect()), key=repr)


def changed(draw, w, times):
    w = list(w)
    for _ in range(times):
        how, at = draw.integers(3), int(draw.integers(len(w)))
        w[at : at + (how != 1)] = [] if how == 2 else [f"new{draw.integers(10**9)}"]
    return w


def families(draw, n_families, size):
    """Texts at all similarities round the limit, chains, texts that share passages, and short ones."""
    texts, passage = [], [f"shared{i}" for i in range(60)]
    for f in range(n_families):
        base = [f"f{f}w{draw.integers(400)}" for _ in range(int(draw.integers(6, 220)))]
        if f % 3 == 0:
            base[3:3] = passage
        texts.append(base)
        for _ in range(int(draw.integers(0, size))):
            texts.append(changed(draw, texts[-1] if f % 2 else base, int(draw.integers(0, 1 + len(base) // 40))))
    return [" ".join(t) for t in texts] + ["a b c", "A B c", "a b c d", "a b c d e", "a b c d e f", "", " "]


def _df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_equals_all_pairs(spark):
    draw = np.random.default_rng(1)
    rows = [(7 * i % 1009, t) for i, t in enumerate(families(draw, 60, 7))]
    want = slow_join(rows)
    assert joined(_df(spark, rows)) == want
    assert len({r[2] for r in want}) < 0.6 * len(want)


def test_branching_blocks_and_centres(spark, monkeypatch):
    """Nodes of over a dozen sets are branched, and cut into blocks at the last depth."""
    monkeypatch.setattr(setjoin, "LEAF_ROWS", 12)
    draw = np.random.default_rng(2)
    texts = families(draw, 20, 4)
    hot = [f"hot{i}" for i in range(200)]
    texts += [" ".join(changed(draw, hot, int(draw.integers(1, 5)))) for _ in range(90)]  # 0.8 to 0.95 of each other
    texts += [" ".join(hot + [f"own{i}x{k}" for k in range(60)]) for i in range(40)]  # 0.6
    rows = list(enumerate(texts))
    assert joined(_df(spark, rows)) == slow_join(rows)


def test_links_grow_with_the_group_not_its_square():
    """A tile of near copies gives one link less than it has sets, and its sets are compared with few others."""
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    for size in (50, 400):
        texts = [" ".join(changed(draw, base, 2)) for _ in range(size)]
        sets = [setjoin.shingle_set(t) for t in texts]
        sketches = [(setjoin.minwise(s) >> np.uint64(24)).astype(np.uint8).tobytes() for s in sets]
        sids = [b"%06d" % i for i in range(size)]
        rows = setjoin.Rows(list(zip(sids, [len(s) for s in sets], sids, sketches, sets)))
        assert len(list(setjoin.Join(rows, None, 85).links())) == size - 1


def test_every_pair_at_the_limit_meets_in_a_tree(spark):
    """Pairs of exactly 85 in 100: all are linked."""
    texts = []
    for i in range(400):
        w = [f"p{i}w{k}" for k in range(104)]
        texts += [" ".join(w), " ".join(w[:89])]  # 85 of 100 shingles
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in setjoin.near_duplicates(_df(spark, rows)).collect()}
    assert all(found[i] == i - i % 2 for i in found)


def test_sql_gives_the_same(spark):
    draw = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(families(draw, 25, 5))] + [(3, "x y"), (None, "x y"), (None, None)]
    documents = _df(spark, rows).toPandas()  # noqa: F841
    assert sorted(duckdb.sql(setjoin.join_sql()).fetchall(), key=repr) == joined(_df(spark, rows))


def test_names_and_minima():
    assert len(setjoin.shingle_set("")) == 0
    assert setjoin.shingle_set("A b").tolist() == setjoin.shingle_set("a  B").tolist()
    assert len(setjoin.shingle_set("a b c d e f")) == 2
    assert len(setjoin.shingle_set("a " * 50)) == 1
    one = setjoin.shingle_set(" ".join(str(i) for i in range(70_000)))
    least = setjoin.minwise(one)
    assert (np.minimum(setjoin.minwise(one[:30_000]), setjoin.minwise(one[30_000:])) == least).all()
    with pytest.raises(ValueError):
        setjoin.near_duplicates(None, similarity=50)


def test_awkward_rows(spark):
    assert joined(awkward(spark)) == sorted(
        ((d, n, c, k) for d, n, c, k in _awkward_expected()), key=repr
    )
    assert setjoin.near_duplicates(awkward(spark).limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "  ")], "doc_id long, text string")
    assert joined(blank) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def _awkward_expected():
    rows = [(d, t) for d, t, _, _ in AWKWARD]
    blank = [(d, t) for d, t in rows if not words(t)]
    full = [(d, t) for d, t in rows if words(t)]
    return [(d, n, c, d == c) for d, n, c, _ in slow_join(full)] + [(d, 0, d, True) for d, _ in blank]


@pytest.mark.parametrize("copies", [3, 30])
def test_repeated_ids_and_copies(spark, copies):
    rows = [(9, "one two three four five six")] * copies + [(9, "other text of the same id, not alike at all")] + [(4, "ONE two three four five six")]
    assert joined(_df(spark, rows)) == slow_join(rows)
