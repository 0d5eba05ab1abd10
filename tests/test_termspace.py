import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from lettermill.operators import features as ft
from lettermill.operators import termspace as ts
from lettermill.operators import tfidf as ti
from lettermill.plans import inputs as inp
from tests.helpers import scattered

WORDS = [f"w{i:02d}" for i in range(60)]
SCHEMA = "letter_id int, text_cleaned string, learnt string"


def corpus(spark, n=400, seed=3):
    """Letters of a few themes, so that the variances fall off; the last two have no words."""
    rng = np.random.default_rng(seed)
    themes = rng.dirichlet(np.full(len(WORDS), 0.1), 6)
    texts = [" ".join(rng.choice(WORDS, 30, p=themes[i % 6])) for i in range(n)]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, "", None])], SCHEMA)


def matrix(letters, model):
    rows = ti.add_weights(letters, model).select("letter_id", vector_to_array("tfidf").alias("v")).orderBy("letter_id")
    return np.array([r["v"] for r in rows.collect()])


@pytest.mark.parametrize("size, terms", [(5, 60), (12, 60), (60, 60), (500, 40)])
def test_axes_equal_those_of_a_whole_decomposition(spark, size, terms):
    letters = corpus(spark)
    model = ti.fit_tfidf(letters, terms, (1, 1))
    space = ts.fit_term_space(scattered(letters, 5), model, size)
    kept = min(size, len(model.terms))
    assert space.size == kept and space.error < 1e-8
    assert np.abs(space.axes.T @ space.axes - np.eye(kept)).max() < 1e-9
    w = matrix(letters, model)
    _, s, vt = np.linalg.svd(w, full_matrices=True)
    assert np.allclose(space.variances, np.pad(s**2, (0, kept))[:kept], atol=1e-8)
    # An axis of a variance of its own is the same line.
    apart = [i for i in range(min(kept, 4)) if s[i] - s[i + 1] > 1e-3 and (i == 0 or s[i - 1] - s[i] > 1e-3)]
    assert apart and all(abs(space.axes[:, i] @ vt[i]) > 1 - 1e-8 for i in apart)


def test_coordinates_replace_a_column_and_keep_the_rest(spark):
    letters = corpus(spark)
    model = ti.fit_tfidf(letters, 60, (1, 1))
    space = ts.fit_term_space(letters, model, 7)
    out = ts.add_learnt_vectors(scattered(letters, 3), space)
    assert out.columns == ["letter_id", "text_cleaned", "learnt"]
    found = np.array([r["learnt"] for r in out.orderBy("letter_id").collect()])
    assert np.allclose(found, matrix(letters, model) @ space.axes, atol=1e-12)
    assert not found[-2:].any()
    assert np.allclose((found**2).sum(axis=0), space.variances)
    vectors = ft.add_vectors(out, "learnt", text_col="text_cleaned")
    assert vectors.schema["embedding"].dataType.simpleString() == "array<double>"


def test_one_text_many_times(spark):
    letters = spark.createDataFrame([(i, "aa bb bb", None) for i in range(50)], SCHEMA)
    space = ts.fit_term_space(letters, ti.fit_tfidf(letters, 10, (1, 1)), 2)
    assert space.variances == pytest.approx((50.0, 0.0), abs=1e-9)


def test_no_terms(spark):
    letters = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="no terms"):
        ts.fit_term_space(letters, ti.fit_tfidf(letters, 10, (1, 1)), 2)


def test_variance_on_the_given_documents(spark):
    letters = inp.documents(spark, "/root/testdata/sf0.001").selectExpr("letter_id", "lower(guarantee_letter_text) AS text_cleaned")
    model = ti.fit_tfidf(letters, 200, (1, 1))
    space = ts.fit_term_space(letters, model, 20)
    s = np.linalg.svd(matrix(letters, model), compute_uv=False)
    assert np.allclose(space.variances, s[:20] ** 2, rtol=1e-8)
    assert np.abs(space.axes.T @ space.axes - np.eye(20)).max() < 1e-6


def test_saved_and_as_a_source_of_vectors(spark, tmp_path):
    letters = corpus(spark).withColumnRenamed("text_cleaned", "guarantee_letter_text")
    space = ts.learnt_space(letters, 6, 50)
    ts.save_term_space(space, spark, str(tmp_path))
    again = ts.load_term_space(spark, str(tmp_path))
    assert again.model == space.model and again.variances == space.variances and (again.axes == space.axes).all()
    out = ft.raw_features(letters, again)
    assert "embedding" in out.columns and "_cleaned" not in out.columns
    assert {len(r["embedding"]) for r in out.collect()} == {6}
