import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lettermill.operators import classifier as clf
from lettermill.operators import newton
from lettermill.operators.preprocess import FEATURE_NAMES
from lettermill.operators.ranking import stratified_folds
from tests.helpers import scattered

WIDTH = 4


def raw(spark, n=300, seed=1, share=0.4):
    """Rows as `raw_features` gives them; a feature is constant."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(WIDTH)
        f = [float(rng.integers(0, 50)) for _ in FEATURE_NAMES]
        f[2] = 7.0
        y = int(v[0] + 0.05 * f[0] + rng.standard_normal() > np.quantile(rng.standard_normal(500), 1 - share) + 1.2)
        rows.append((f"k{i}", y, v.tolist(), *f))
    names = ", ".join(f"{c} double" for c in FEATURE_NAMES)
    return spark.createDataFrame(rows, f"letter_id string, class int, embedding array<double>, {names}")


@pytest.fixture(scope="module")
def dealt(spark):
    return stratified_folds(raw(spark)).persist()


def counts(df):
    return df.groupBy("fold", "class").agg(F.count("*").alias("n")).collect()


@pytest.mark.parametrize("leak_free", [False, True])
def test_same_coefficients_as_single_fits(dealt, leak_free):
    fits = clf.fit_folds(scattered(dealt, 6), counts(dealt), leak_free)
    assert sorted(fits) == [0, 1, 2, 3, 4] and all(f.converged for f in fits.values())
    for fold, fit in fits.items():
        inside = dealt.where(F.col("fold") != fold)
        scaler = clf.fit_scaler(inside if leak_free else dealt)
        assert np.allclose(fit.plan.shift[WIDTH:], scaler.means)
        spread = np.array([d or np.inf for d in scaler.deviations])
        assert np.allclose(fit.plan.scale[WIDTH:], spread)
        weight = F.element_at(F.array(*[F.lit(w) for w in fit.plan.weights]), F.col("class") + 1)
        rows = clf.feature_matrix(inside, scaler).select(F.col("class").cast("double").alias("label"), "features", weight.alias("w"))
        one = LogisticRegression(maxIter=2000, tol=1e-14, regParam=1 / fit.plan.rows, standardization=False, weightCol="w").fit(rows)
        assert np.allclose(one.coefficients.toArray(), fit.coefficients, atol=1e-6)
        assert one.intercept == pytest.approx(fit.intercept, abs=1e-6)
        right = one.transform(clf.feature_matrix(dealt.where(F.col("fold") == fold), scaler)).groupBy("class", "prediction").count().collect()
        assert fit.steps[-1].outside == tuple(
            sum(r["count"] for r in right if (r["class"], r["prediction"]) == cell) for cell in ((0, 0), (0, 1), (1, 0), (1, 1))
        )


def test_few_scans_and_a_falling_loss(spark, dealt, monkeypatch):
    seen, scan = [], newton._scan
    monkeypatch.setattr(newton, "_scan", lambda m, fits: seen.append(len(fits)) or scan(m, fits))
    fits = clf.fit_folds(dealt, counts(dealt))
    assert seen[0] == 5 and len(seen) <= 12 and len(seen) == max(len(f.steps) for f in fits.values())
    for fit in fits.values():
        # The loss and the penalty together never rise; the loss starts at ln 2.
        assert fit.steps[0].loss == pytest.approx(np.log(2)) and fit.steps[-1].loss < fit.steps[0].loss
        assert sum(fit.steps[0].inside) == fit.plan.rows


def test_far_features_need_halved_steps(spark):
    """Newton's first steps overshoot where margins are huge."""
    rng = np.random.default_rng(0)
    rows = [(0, int(v > 0), [float(1e4 * v), float(rng.standard_normal())]) for v in rng.standard_normal(200)]
    matrix = spark.createDataFrame(rows, "fold int, class int, x array<double>")
    plan = newton.Plan(1, {c: sum(r[1] == c for r in rows) for c in (0, 1)}, np.zeros(2), np.ones(2))
    (fit,) = newton.fit_together(matrix, [plan])
    assert np.isfinite(fit.weights).all() and fit.steps[-1].loss < 0.1
    assert fit.steps[-1].outside == (0, 0, 0, 0) and np.isnan(fit.steps[-1].val_loss)


def test_rows_of_one_class(spark):
    rows = [(i % 2, i % 2, [float(i)]) for i in range(10)]  # fold 0 holds class 0, fold 1 class 1
    matrix = spark.createDataFrame(rows, "fold int, class int, x array<double>")
    plans = [newton.Plan(0, {1: 5}, np.zeros(1), np.ones(1)), newton.Plan(1, {0: 5}, np.zeros(1), np.ones(1))]
    only_1, only_0 = newton.fit_together(matrix, plans)
    assert only_1.intercept == np.inf and only_1.steps[-1].outside == (0, 5, 0, 0)
    assert only_0.intercept == -np.inf and only_0.steps[-1].outside == (0, 0, 5, 0)


def test_curve(spark, dealt):
    train, test = dealt.where("fold < 3").drop("fold"), dealt.where("fold >= 3").drop("fold")
    curve, fit, _ = clf.held_out_curve(train, test)
    rows = curve.orderBy("iteration").collect()
    assert [r.iteration for r in rows] == list(range(len(fit.steps))) and len(rows) > 2
    assert rows[-1].accuracy == pytest.approx((fit.steps[-1].inside[0] + fit.steps[-1].inside[3]) / train.count())
    assert rows[-1].val_accuracy > rows[0].val_accuracy and rows[-1].val_loss < rows[0].val_loss
    none, _, _ = clf.held_out_curve(train, test.where("false"))
    assert none.where("val_loss IS NULL AND val_accuracy IS NULL AND accuracy IS NOT NULL").count() == none.count()


def test_folds_near_a_model_take_fewer_scans_to_the_same_weights(spark, dealt, monkeypatch):
    cold = clf.fit_folds(dealt, counts(dealt))
    seen, scan = [], newton._scan
    monkeypatch.setattr(newton, "_scan", lambda m, fits: seen.append(len(fits)) or scan(m, fits))
    warm = clf.fit_folds(dealt, counts(dealt), near=clf.train(dealt))
    assert len(seen) < max(len(f.steps) for f in cold.values()) and all(f.converged for f in warm.values())
    for fold, fit in cold.items():
        assert np.allclose(fit.weights, warm[fold].weights, atol=1e-7)
        assert fit.steps[-1].outside == warm[fold].steps[-1].outside
