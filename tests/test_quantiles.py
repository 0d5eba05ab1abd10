import numpy as np
import pytest

from lettermill.operators import quantiles as qt
from tests.helpers import scattered

SCHEMA = "part string, class int, text_length int, num_words int"


def within(values, found, share, error):
    """Whether `found` may stand at that share of the sorted values, give or take the error."""
    values = np.asarray(values)
    return (values < found).mean() - error <= share <= (values <= found).mean() + error


@pytest.mark.parametrize("kind", ["even", "skewed", "ties"])
def test_merged_parts_stay_within_the_bound(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    sizes = {
        "even": lambda n: rng.integers(0, 10**6, n),
        "skewed": lambda n: (rng.pareto(0.7, n) * 10).clip(0, 2**31 - 1).astype(int),
        "ties": lambda n: np.where(rng.random(n) < 0.4, 7, rng.integers(0, 20, n)),
    }[kind](40_000)
    # One part holds a third of all letters, one a single letter.
    parts = ["hot" if i % 3 == 0 else "one" if i == 1 else f"p{i % 7}" for i in range(len(sizes))]
    rows = [(p, i % 2, int(s), int(s) % 100) for i, (p, s) in enumerate(zip(parts, sizes))]
    letters = scattered(spark.createDataFrame(rows, SCHEMA), 9)
    qt.size_sketches(letters, "part").write.parquet(str(tmp_path / "sketches"))
    saved = spark.read.parquet(str(tmp_path / "sketches"))
    assert saved.count() == 9 * 2 * 2 - 2
    found = qt.five_numbers(qt.merged(saved)).collect()
    assert len(found) == 4
    for row in found:
        column = 2 if row["measure"] == "text_length" else 3
        own = [r[column] for r in rows if r[1] == row["class"]]
        assert (row["n"], row["minimum"], row["maximum"]) == (len(own), min(own), max(own))
        for name in ("quartile_1", "median", "quartile_3"):
            assert row[name] in own and within(own, row[name], qt.SHARES[name], qt.rank_error())


def test_small_parts_are_exact(spark):
    rows = [("a", 0, i, None) for i in range(1, 102)] + [("b", None, 5, 5)]
    found = qt.five_numbers(qt.size_sketches(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r) for r in found] == [(0, "text_length", 101, 1, 26, 51, 76, 101)]


def test_no_letters(spark):
    none = qt.size_sketches(spark.createDataFrame([], SCHEMA), "part")
    assert qt.five_numbers(qt.merged(none)).count() == 0


def test_more_detail_is_closer():
    assert qt.rank_error(200) > qt.rank_error(800) > qt.rank_error(4000) and qt.rank_error() < 0.012
