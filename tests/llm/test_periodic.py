"""Periodic runs beside a comparison of all words at all distances."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lettermill.llm import periodic
from tests.llm.helpers import AWKWARD, awkward


def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_row(doc_id, text, plant):
    w = (text or "").encode().split()
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = slow_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    collapsed = b" ".join(x for k, x in enumerate(w) if k not in gone)
    of_best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *of_best, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(collapsed))


def periodic_text(draw):
    """Words of a few kinds: random, repeated phrases cut off anywhere, and repeated parts of the text before."""
    kinds, w, size = draw.choice([1, 2, 3, 5, 1000]), [], draw.choice([0, 10, 60, 300, 700])
    while len(w) < size:
        how = draw.random()
        if how < 0.4:
            w += [str(draw.randrange(kinds)) for _ in range(draw.randrange(1, 30))]
        elif how < 0.8 or len(w) < 6:
            phrase = [str(draw.randrange(kinds)) for _ in range(draw.choice([1, 2, 3, 5, 8, 9, 10, 11, 13, 17, 24, 25, 40, 64, 90]))]
            again = phrase * draw.randrange(2, 6)
            w += again[: len(again) - draw.randrange(len(phrase))]
        else:
            a = draw.randrange(len(w))
            w += w[a : a + draw.randrange(1, 80)] * draw.randrange(1, 5)
    return " ".join(w)


def test_runs_equal_all_distances():
    draw, seen = random.Random(3), 0
    for _ in range(60):
        texts = [periodic_text(draw) for _ in range(6)]
        for text, (n, runs, _) in zip(texts, periodic.collapse(texts, [None] * 6)):
            assert n == len(text.split())
            assert runs == slow_runs(text.split())
            seen += len(runs)
    assert seen > 150


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 23, 24, 25, 47, 48, 49, 96, 191, 193])
def test_every_period_is_found_from_three_times_on(period):
    phrase = [f"p{period}w{i}" for i in range(period)]
    before, after = [f"b{i}" for i in range(37)], [f"a{i}" for i in range(41)]
    for length in (max(24, 3 * period) - 1, max(24, 3 * period), 4 * period + 24):
        stretch = (phrase * (length // period + 1))[:length]
        (_, runs, _), (_, alone, _) = periodic.collapse([" ".join(before + stretch + after), " ".join(stretch)], [None, None])
        assert runs == ([(37, length, period)] if length >= max(24, 3 * period) else [])
        assert alone == [(0, length, period)] * len(runs)


def test_the_set_depends_on_nearby_words_alone():
    draw = np.random.default_rng(4)
    words = draw.integers(0, 50, 400)
    double = np.concatenate([words, draw.integers(0, 50, 77), words])
    for scale in (4, 8, 16):
        found = []
        for w in (words, double):
            names, size = periodic._mixed(w.astype(np.uint64) * periodic.MIX), 1
            while size < scale:
                ahead = np.concatenate([names[size:], np.full(size, periodic.NONE)])
                names, size = periodic._mixed(names * periodic.MIX + ahead), 2 * size
            names = names[: len(w) - scale + 1]
            found.append(set(periodic.synchronising_set(names, np.zeros(len(names), bool), scale).tolist()))
        one, two = found
        assert one == {i for i in two if i <= 400 - 2 * scale} == {i - 477 for i in two if i >= 477}
        places = sorted(one)
        assert max(np.diff(places)) <= scale


def test_rows_and_digests(spark):
    draw = random.Random(9)
    rows = [(i, periodic_text(draw)) for i in range(240)] + [(5, "again again"), (None, "a b " * 30), (6, None)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(240)) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    mine = periodic.run_digests(periodic.periodic_runs(df, periodic.planted))
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted((slow_row(i, t, True) for i, t in rows), key=repr)
    plain = periodic.run_digests(periodic.periodic_runs(df))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted((slow_row(i, t, False) for i, t in rows), key=repr)


def test_awkward_rows(spark):
    found = periodic.run_digests(periodic.periodic_runs(awkward(spark), periodic.planted)).collect()
    assert len(found) == len(AWKWARD)
    assert {tuple(r) for r in found if r.doc_id != 5} == {slow_row(i, t, True) for i, t, _, _ in AWKWARD if i != 5}
    assert periodic.periodic_runs(awkward(spark).limit(0)).count() == 0


def test_a_very_long_repetitive_text():
    text = " ".join(["x y z"] * 200_000)
    ((n, runs, kept),) = periodic.collapse([text], [None])
    assert (n, runs, kept) == (600_000, [(0, 600_000, 3)], "x y z")
