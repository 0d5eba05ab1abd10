import itertools
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import metrics as mt
from lettermill.operators import significance as sg
from tests.helpers import rows


def predictions(spark, cells, scores=None):
    """cells: {(y, p): count}"""
    flat = [(y, p) for (y, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(flat, "y int, p int")


def test_all_metrics_of_known_counts(spark):
    row = mt.comprehensive_metrics(predictions(spark, {(0, 0): 5, (0, 1): 2, (1, 0): 3, (1, 1): 10})).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (5, 2, 3, 10)
    p0, r0, p1, r1 = 5 / 8, 5 / 7, 10 / 12, 10 / 13
    f0, f1 = 2 * p0 * r0 / (p0 + r0), 2 * p1 * r1 / (p1 + r1)
    assert row.accuracy == pytest.approx(15 / 20)
    assert row.precision_weighted == pytest.approx((7 * p0 + 13 * p1) / 20)
    assert row.f1_weighted == pytest.approx((7 * f0 + 13 * f1) / 20)
    assert row.f1_macro == pytest.approx((f0 + f1) / 2)
    assert row.mcc == pytest.approx((10 * 5 - 2 * 3) / math.sqrt(12 * 13 * 7 * 8))
    assert (row.specificity, row.sensitivity) == (pytest.approx(5 / 7), pytest.approx(10 / 13))
    assert (row.support_class_0, row.support_class_1) == (7, 13)


def test_one_class_only(spark):
    df = predictions(spark, {(1, 1): 4})
    row = mt.comprehensive_metrics(df).first()
    assert (row.accuracy, row.f1_macro, row.mcc) == (1.0, 1.0, 0.0)
    assert row.precision_class_0 is None and row.specificity is None
    assert mt.confusion_rates(df).first().true_positives is None
    assert rows(mt.confusion_matrix(df)) == [(1, 1, 4)]
    assert [r["class"] for r in mt.class_performance(df).collect()] == [1]
    scored = df.withColumn("score", F.lit(0.7))
    evaluated = mt.evaluation(scored, "score").first()
    assert evaluated.precision_class_0 == 0.0 and evaluated.mean_prob_class_1 == pytest.approx(0.7)
    assert mt.roc_auc(scored).first().roc_auc is None


def test_zero_denominators_are_zero(spark):
    row = mt.comprehensive_metrics(predictions(spark, {(0, 1): 3, (1, 1): 2})).first()
    assert (row.precision_class_0, row.recall_class_0, row.f1_class_0) == (0.0, 0.0, 0.0)
    assert mt.comprehensive_metrics(predictions(spark, {(0, 0): 1}).where("false")).count() == 0


def test_class_performance_counts(spark):
    got = {r["class"]: r for r in mt.class_performance(predictions(spark, {(0, 0): 5, (0, 1): 2, (1, 0): 3, (1, 1): 10})).collect()}
    assert (got[0].correct_predictions, got[0].missed_predictions, got[0].false_predictions) == (5, 2, 3)
    assert (got[1].true_count, got[1].predicted_count, got[1].total_samples) == (13, 12, 20)


def test_groups_and_weights(spark):
    df = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 1, 1), ("b", 0, 1, 2)], "g string, y int, p int, n bigint")
    got = {r.g: r.accuracy for r in mt.comprehensive_metrics(df, ["g"], "n").collect()}
    assert got == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("levels", [3, 50, 100000])
def test_auc_by_pairs(spark, levels):
    random = np.random.default_rng(levels)
    y = random.integers(0, 2, 600)
    score = np.round((y * 0.3 + random.random(600)) * levels) / levels
    df = spark.createDataFrame(list(zip(y.tolist(), score.tolist())), "y int, score double")
    one, zero = score[y == 1][:, None], score[y == 0][None, :]
    expected = ((one > zero) + 0.5 * (one == zero)).mean()
    row = mt.roc_auc(df).first()
    assert row.roc_auc == pytest.approx(expected)
    assert row.mean_prob_class_1 == pytest.approx(score.mean())
    flipped = mt.roc_auc(df.withColumn("score", 1 - F.col("score"))).first().roc_auc
    assert row.roc_auc + flipped == pytest.approx(1)


def pair(spark, differences):
    return spark.createDataFrame([(float(d), 0.0) for d in differences], "a double, b double")


def test_paired_t_against_a_table(spark):
    # t = 2.2622 is the two-sided 5 % point of nine degrees of freedom.
    assert sg.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert sg.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert sg.t_two_sided(0.0, 5) == pytest.approx(1.0)
    d = [1.0, 2.0, 3.0, 4.0]
    row = sg.significance(pair(spark, d)).first()
    assert row.statistic == pytest.approx(np.mean(d) / (np.std(d, ddof=1) / 2))
    assert row.p_value == pytest.approx(0.0305, abs=1e-4) and row.significant


def test_paired_t_without_spread_has_no_statistic(spark):
    row = sg.significance(pair(spark, [1.0, 1.0])).first()
    assert row.statistic is None and row.p_value is None


def test_signed_ranks_exact(spark):
    row = sg.significance(pair(spark, [1, 2, 3, 4, -5, 6, 7, 8]), "wilcoxon").first()
    assert row.statistic == 5.0
    # 10 of the 256 sign patterns have a rank sum of at most 5.
    assert row.p_value == pytest.approx(2 * 10 / 256)


def test_signed_ranks_with_ties_and_zeros(spark):
    row = sg.wilcoxon(pair(spark, [0, 1, 1, -1, 2, 2, -3, 0])).first()
    assert (row.n, row.zeros, row.w_plus, row.w_minus) == (6, 2, 13.0, 8.0)
    spread = math.sqrt((6 * 7 * 13 - (24 + 6) / 2) / 24)
    assert row.p_value == pytest.approx(math.erfc(abs(8 - 10.5) / spread / math.sqrt(2)))


def test_unknown_test_falls_back_with_a_warning(spark):
    df = pair(spark, [1.0, 2.0, 4.0])
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        row = sg.significance(df, "mcnemar").first()
    assert any("mcnemar" in str(w.message) for w in caught)
    assert row.test_type == "mcnemar" and row.statistic == sg.significance(df).first().statistic


def test_mcnemar(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 6 + [(1, 0, 1)] * 2 + [(0, 0, 0)] * 3, "y int, p int, q int")
    assert rows(sg.mcnemar(df)) == [(6, 2, 2.0)]


def enumerated(differences):
    """Two-sided p by all signs of the ranks."""
    sizes = np.abs([d for d in differences if d])
    ranks = [(sizes < s).sum() + ((sizes == s).sum() + 1) / 2 for s in sizes]
    w = min(sum(r for r, d in zip(ranks, [d for d in differences if d]) if sign * d > 0) for sign in (1, -1))
    sums = [sum(r for r, up in zip(ranks, signs) if up) for signs in itertools.product((0, 1), repeat=len(ranks))]
    return min(1.0, 2 * np.mean([s <= w for s in sums]))


@pytest.mark.parametrize(
    "differences", [[0, 1, 1, -1, 2, 2, -3, 0], [1, 2, 3, 4, -5, 6, 7, 8], [1] * 12, [-2, -2, -2, 5, 1, 1, 1, 1, 9, -9, 4, 4], [3], [1, -1]]
)
def test_signed_ranks_by_all_signs(spark, differences):
    row = sg.wilcoxon_exact(pair(spark, differences)).first()
    assert row.exact and row.n == sum(d != 0 for d in differences)
    assert row.p_value == pytest.approx(enumerated(differences), abs=1e-12)


def test_signed_ranks_of_no_and_of_many_differences(spark):
    none = sg.wilcoxon_exact(pair(spark, [0, 0])).first()
    assert (none.n, none.p_value, none.significant) == (0, 1.0, False)
    assert sg.wilcoxon_exact(pair(spark, [])).first().p_value == 1.0
    many = pair(spark, [(-1) ** i * (i % 40 + 1) for i in range(300)])
    exact, normal = sg.wilcoxon_exact(many).first(), sg.wilcoxon_exact(many, most=299).first()
    assert exact.exact and not normal.exact and normal.p_value == pytest.approx(sg.wilcoxon(many).first().p_value)
    assert exact.p_value == pytest.approx(normal.p_value, rel=0.05)


def test_even_throws():
    for n in (1, 2, 7, 30, 101, 400):
        for k in range(n + 1):
            want = min(1.0, 2 * sum(math.comb(n, j) for j in range(min(k, n - k) + 1)) / 2**n)
            assert sg.even_binomial_two_sided(k, n) == pytest.approx(want, rel=1e-10)
    # Far out and very large: the normal distribution is close.
    n = 10**10
    k = n // 2 - 98_000
    assert sg.even_binomial_two_sided(k, n) == pytest.approx(math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 4) / math.sqrt(2)), rel=1e-4)
    assert sg.even_binomial_two_sided(0, 5000) == 0.0 and sg.even_binomial_two_sided(0, 0) == 1.0


def test_mcnemar_with_p_values(spark):
    cases = [("a", 1, 1, 0)] * 6 + [("a", 1, 0, 1)] * 2 + [("a", 0, 0, 0)] * 3 + [("b", 1, 1, 1), ("b", None, 1, 0)]
    df = spark.createDataFrame(cases, "g string, y int, p int, q int")
    a, b = sg.mcnemar_p(df, ["g"]).orderBy("g").collect()
    assert (a.only_first, a.only_second, a.statistic) == (6, 2, 2.0)
    assert a.p_value == pytest.approx(2 * (1 + 8 + 28) / 256) and a.p_chi_square == pytest.approx(0.157299, abs=1e-6)
    assert (b.only_first, b.only_second, b.statistic, b.p_chi_square, b.p_value) == (0, 0, None, None, 1.0)
