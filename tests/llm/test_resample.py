"""Importance resampling beside a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lettermill.llm import resample
from tests.llm.helpers import AWKWARD, awkward


def slow_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow_buckets(text, n):
    w = slow_words(text)
    return [zlib.crc32(f.encode()) % n for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def slow_resample(rows, target, n=10_000, least=20, percent=25, seed="7"):
    corpus, wanted = Counter(), Counter()
    for _, t in rows:
        corpus.update(slow_buckets(t, n))
    for t in target:
        wanted.update(slow_buckets(t, n))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + n) / ((corpus[b] + 1) * (t + n)))) for b in corpus}
    out = []
    for doc_id, text in rows:
        own = slow_buckets(text, n)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = [r for r in out if r[1] >= 2 * least - 1]
    order = sorted(enough, key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    for rank, r in enumerate(order[: percent * len(enough) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def texts(draw, n):
    common, rare = [f"c{i}" for i in range(40)], [f"Rare{i}é" for i in range(4000)]
    found = []
    for _ in range(n):
        size = int(draw.integers(0, 90))
        w = [common[int(40 * draw.random() ** 3)] if draw.random() < 0.7 else rare[draw.integers(4000)] for _ in range(size)]
        found.append("".join(x + str(draw.choice([" ", ", ", "\n", "_"])) for x in w))
    return found


def _frames(spark, rows, target):
    return (
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
        spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"),
    )


def _mine(found):
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("words, pairs, step", [(16_384, 65_536, 256), (5, 3, 7), (0, 0, 1)])
def test_equals_the_plain_version_whatever_the_head(spark, monkeypatch, words, pairs, step):
    monkeypatch.setattr(resample, "HEAD_WORDS", words)
    monkeypatch.setattr(resample, "HEAD_PAIRS", pairs)
    monkeypatch.setattr(resample, "SCORE_STEP", step)
    draw = np.random.default_rng(1)
    rows = [(3 * i % 701, t) for i, t in enumerate(texts(draw, 600))] + [(7, "x " * 25), (7, "x " * 25), (None, "y " * 30), (None, None)]
    target = [*texts(draw, 20), "c1 c2 c3 " * 30, None]
    assert _mine(resample.resampled(*_frames(spark, rows, target))) == slow_resample(rows, target)


def test_sql_gives_the_same(spark):
    draw = np.random.default_rng(2)
    rows, target = list(enumerate([*texts(draw, 300), None, "", "ÄÖ \x7f Z9"])), texts(draw, 10)
    docs, bench = _frames(spark, rows, target)
    documents, benchmark = docs.toPandas(), bench.toPandas()  # noqa: F841
    theirs = duckdb.sql(resample.resample_sql()).fetchall()
    assert sorted(theirs, key=repr) == _mine(resample.resampled(docs, bench)) == slow_resample(rows, target)


def test_draws_towards_the_target(spark):
    draw = np.random.default_rng(3)
    kinds = [[f"{k}{i}" for i in range(20)] for k in "ab"]
    text = lambda k: " ".join(kinds[k][j] for j in draw.integers(0, 20, 60))
    rows = [(i, text(i % 2)) for i in range(400)]
    found = resample.resampled(*_frames(spark, rows, [text(1) for _ in range(40)])).collect()
    taken = [r.doc_id % 2 for r in found if r.rank]
    assert len(taken) == 100 and np.mean(taken) > 0.8
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 101))


def test_heads_are_the_frequent_words(spark):
    docs = spark.createDataFrame([(i, f"hot cold w{i} " * 3 + "z" * 100) for i in range(50)], "doc_id long, text string").repartition(3)
    head = resample.vocabulary(docs, 100)
    assert {b"hot", b"cold"} <= set(list(head.number)[:2]) and b"z" * 100 not in head.number
    counts, own, pairs = head.features(["hot cold unseen", "", "cold hot cold"])
    assert counts.tolist() == [3, 0, 3]
    assert own.tolist() == [zlib.crc32(w) % 100 for w in (b"hot", b"cold", b"unseen", b"cold", b"hot", b"cold")]
    assert pairs.tolist() == [zlib.crc32(b"hot cold") % 100, zlib.crc32(b"cold unseen") % 100, -1, zlib.crc32(b"cold hot") % 100, zlib.crc32(b"hot cold") % 100, -1]


def test_awkward_rows(spark):
    target = spark.createDataFrame([("the quick brown fox", 1)], "text string, score long")
    rows = [(d, t) for d, t, _, _ in AWKWARD]
    assert _mine(resample.resampled(awkward(spark), target)) == slow_resample(rows, ["the quick brown fox"])
    assert _mine(resample.resampled(awkward(spark), target.limit(0))) == slow_resample(rows, [])
    assert resample.resampled(awkward(spark).limit(0), target).count() == 0
