"""Near duplicates beside all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from lettermill.llm import simhash
from lettermill.llm.components import connected
from tests.llm.helpers import AWKWARD, awkward, words


def slow_fingerprint(text, n=3):
    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found)] if len(found) < n else [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    """Smallest index reachable, over all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def _check(spark, values, radius=2):
    prints = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "doc_id long, fp binary")
    groups = {bytes(r.fp): r.component_id for r in simhash.grouped(prints, radius).collect()}
    assert [groups[v.to_bytes(8, "big")] for v in values] == slow_components(values, radius)


def test_links_within_the_radius_are_all_found(spark, monkeypatch):
    draw = np.random.default_rng(5)
    values = [int(x) for x in draw.integers(0, 2**63, 150)]
    for v in list(values[:60]):
        for bits in (1, 2, 3):
            flipped = v
            for b in draw.choice(64, bits, replace=False):
                flipped ^= 1 << int(b)
            values.append(flipped)
    values += [0, 1, 3, 7, 2**64 - 1, 2**64 - 2, values[0], values[0]]
    _check(spark, values)


def test_tiles_are_split_and_blocks_skipped(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEFT_ROWS", 20)
    monkeypatch.setattr(simhash, "RIGHT_ROWS", 30)
    draw = np.random.default_rng(6)
    # A ball of near copies round one value, and a chain of steps of two bits.
    base = int(draw.integers(0, 2**63))
    values = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (150, 2))]
    chain, steps = [base ^ 0xFFFF0000], draw.permutation(64)
    for i in range(0, 40, 2):
        chain.append(chain[-1] ^ (1 << int(steps[i])) ^ (1 << int(steps[i + 1])))
    _check(spark, values + chain)


def _roots(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        assert 0 < (a ^ b).bit_count() <= 2
        root[find(a)] = find(b)
    return find


@pytest.mark.parametrize("n, bits", [(900, 12), (700, 20), (1500, 11), (60, 64)])
def test_tile_joins_what_all_pairs_join(n, bits):
    draw = np.random.default_rng(1)
    left = np.unique(draw.integers(0, 2**bits - 1, n, np.uint64))
    draw.shuffle(left)
    tile = simhash.Tile(left, 2)
    pairs = [p for part in np.array_split(left, 3) for p in zip(*(x.tolist() for x in tile.meet(part)))]
    find = _roots(pairs)
    want = slow_components(left.tolist(), 2)
    mine = [find(x) for x in left.tolist()]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want)))
    assert len(pairs) == len(left) - len(set(want))  # a forest, no link more


@pytest.mark.parametrize("size", [500, 2000, 8000])
def test_links_grow_with_the_group_and_not_with_its_square(size):
    """Near copies, half of which visit from other cells."""
    draw = np.random.default_rng(2)
    flips = draw.permutation(2**13)[:size].astype(np.uint64)
    home, other = flips[: size // 2], flips[size // 2 :]
    tile = simhash.Tile(home, 2)
    inside, outside = tile.meet(home), tile.meet(other)
    assert len(inside[0]) < len(home)
    # A visitor's link for each group that it joins first, and at most one more.
    assert len(outside[0]) < len(other) + len(home)


def test_majority_and_shingles_equal_the_slow_fingerprint():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " \t".join("".join(draw.choice(list("abcXYZé"), 4)) for _ in range(n))
        assert int.from_bytes(simhash.simhash(text, 3), "big") == slow_fingerprint(text)


def test_awkward_rows(spark):
    found = simhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    prints = {slow_fingerprint(t) for _, t, _, _ in AWKWARD}
    assert {int.from_bytes(r.fp, "big") for r in found} == prints
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert by_id[1] == by_id[9] == 1
    assert by_id[2] == by_id[3] == by_id[4] == 2
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_one_of_each_keeps_one_of_a_group_and_all_columns(spark):
    base = [f"term{i}" for i in range(400)]
    near = [*base, "x"]
    assert (slow_fingerprint(" ".join(base)) ^ slow_fingerprint(" ".join(near))).bit_count() <= 2
    rows = [
        (5, " ".join(base)), (3, " ".join(base)), (4, " ".join(near)), (6, " ".join(f"other{i}" for i in range(120))),
        (3, " ".join(base)), (None, " ".join(base)), (None, None), (8, ""), (9, None), (10, "short text"),
    ]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "_rank": F.lit(2), "component_id": F.lit(3)})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 6, 8, 10]
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_equals_all_pairs(spark):
    """Families of texts with a few changed words, and ids that stand for several texts."""
    draw = np.random.default_rng(8)
    rows = []
    for f in range(40):
        base = [f"f{f}w{x}" for x in range(int(draw.integers(1, 900)))]
        for _ in range(4):
            copy = list(base)
            for at in draw.integers(0, len(base), int(draw.integers(0, 3))):
                copy[at] = f"new{draw.integers(0, 10**6)}"
            rows.append((int(draw.integers(0, 120)), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    group = slow_components([slow_fingerprint(t) for _, t in rows], 2)
    kept = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    of_kept = [group[rows.index(r)] for r in kept]
    assert sorted(of_kept) == sorted(set(group))  # one of each, none lost
    assert all(r[0] == min(i for (i, _), g in zip(rows, group) if g == own) for r, own in zip(kept, of_kept))


def test_texts_of_a_repeated_id_are_not_lost(spark):
    rows = [(1, "one text of this id"), (1, "another text of this id, unlike it"), (2, "a third text that is like neither of them")]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == sorted(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "cycles"])
def test_components(spark, shape):
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(300)],
        "cycles": [(i, i // 10 * 10 + (i + 1) % 10) for i in range(200)] + [(7, 7), (3, 4)],
    }[shape]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    if shape == "cycles":
        assert found == {i: i // 10 * 10 for i in range(200)}
    else:
        assert set(found.values()) == {0} and len(found) == 301
