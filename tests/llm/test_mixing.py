"""Mixing beside a plain version."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lettermill.llm import mixing
from tests.llm.helpers import AWKWARD, awkward, words


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; the excess of those above their bound is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, bounded = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in bounded]
        left = total - sum(bounded.values())
        shares = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s: most * sizes[s] for s in free if shares[s] > most * sizes[s] + 1e-9}
        if not over:
            return shares | bounded
        bounded |= over


def slow_mix(rows):
    sizes = [len(words(t)) for _, t, _ in rows]
    by_source = {}
    for size, (_, _, source) in zip(sizes, rows):
        by_source[source] = by_source.get(source, 0) + size
    targets = slow_targets(by_source)
    out = []
    for source, target in targets.items():
        own = [(i, s) for (i, _, x), s in zip(rows, sizes) if x == source]
        rate = min(3.0, target / by_source[source]) if by_source[source] else 0
        whole, p = int(rate), rate - int(rate)
        lack, order = target - whole * by_source[source], []
        for i, size in own:
            u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            order.append((u, -1 if i is None else i, size))
        upto = 0
        for _, i, size in sorted(order):
            upto += size
            chosen = size > 0 and p > 1e-12 and 2 * upto - size <= 2 * lack
            out.append((i, size, round(target, 6), (whole + chosen) * size))
    return sorted(out)


def _rows(n, seed=0):
    sources = ["big"] * 6 + ["mid", "mid", "tiny", None]
    return [(i, " ".join(["w"] * ((i * 7919 + seed) % 90)), sources[(i * 31) % 10]) for i in range(n)]


def _mine(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, round(r.target, 6), r.taken) for r in mixing.mixed(df).collect())


def test_equals_the_plain_version(spark):
    rows = _rows(700)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mine = mixing.mixed(df).collect()
    assert _mine(df) == slow_mix(rows)
    for source in ("big", "mid", "tiny", None):
        own = [r for r in mine if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=90)
        assert sum(r.size for r in own) == own[0].source_size
    assert all(r.taken <= 3 * r.size and r.copies <= 3 for r in mine)
    assert sum({r.source: r.target for r in mine}.values()) == pytest.approx(sum(r.size for r in mine))


def test_ranges_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(_rows(300, 5), "doc_id long, text string, source string")
    before = _mine(df)
    monkeypatch.setattr(mixing, "RANK_RANGES", 3)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    assert _mine(df) == before == slow_mix(_rows(300, 5))


def test_sql_gives_the_same(spark):
    documents = spark.createDataFrame(_rows(400, 3), "doc_id long, text string, source string").toPandas()  # noqa: F841
    theirs = duckdb.sql(mixing.mix_sql()).fetchall()
    mine = mixing.mixed(spark.createDataFrame(_rows(400, 3), "doc_id long, text string, source string"))
    got = mine.select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    assert sorted(map(tuple, got)) == sorted(theirs)


def test_weights_change_chances_within_a_source(spark):
    df = spark.createDataFrame([(i, "a b c d e", "s" if i % 2 else "t") for i in range(2000)], "doc_id long, text string, source string")
    # Source s has the second weight, so about half a copy of each document.
    heavy = F.when(F.col("doc_id") % 4 == 1, 1.8).otherwise(0.2)
    found = mixing.mixed(df, mixing.Mix(weights=(3, 1)), heavy).where("source = 's'").collect()
    taken = {k: sum(r.taken for r in found if r.doc_id % 4 == k) for k in (1, 3)}
    assert taken[1] > 5 * taken[3]
    mine = mixing.mixed(df, mixing.Mix(weights=(3, 1)), heavy).where("source = 't'").collect()
    assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)


def test_mixture_repeats_rows_as_decided(spark):
    df = spark.createDataFrame(_rows(500, 9), "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "_row": F.lit(1), "copies": F.lit(2)})
    copies = {r.doc_id: r.copies for r in mixing.mixed(df).collect() if r.copies}
    out = mixing.mixture(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies


def test_awkward_rows(spark):
    found = mixing.mixed(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert {r.doc_id: r.size for r in found}[5] == 60_000
    assert mixing.mixed(awkward(spark).limit(0)).count() == mixing.mixture(awkward(spark).limit(0)).count() == 0
    assert mixing.mixture(awkward(spark)).columns == awkward(spark).columns
    nothing = awkward(spark).where("text is null or text = ''")
    assert {r.taken for r in mixing.mixed(nothing).collect()} == {0} and mixing.mixture(nothing).count() == 0
