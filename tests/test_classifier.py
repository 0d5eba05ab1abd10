import math

import pytest
from pyspark.sql import functions as F

from lettermill.operators import classifier as clf
from lettermill.operators import features as ft
from lettermill.operators.preprocess import FEATURE_NAMES
from lettermill.operators.synth import ratio_preserving_set
from lettermill.plans import experiments as ex
from lettermill.streaming.letters import preprocess_stream, score_stream, stream_letters
from lettermill.operators.preprocess import preprocess_letters
from tests.helpers import letters


@pytest.fixture(scope="module")
def made(spark):
    """Template letters: the classes are separable."""
    seed = letters(spark, [(str(i), "t", int(i % 3 > 0)) for i in range(9)])
    return ratio_preserving_set(seed, 309, seed=5).persist()


@pytest.fixture(scope="module")
def features(made):
    return ft.raw_features(made, size=16).persist()


@pytest.fixture(scope="module")
def trained(features):
    return clf.train(features)


def test_separable_letters_are_learnt(trained, features):
    row = clf.evaluate(trained, features).first()
    assert row.accuracy == 1.0 and 0 < row.mean_prob_class_1 < 1
    predicted = clf.predict(trained, features)
    assert predicted.where("abs(probability_0 + probability_1 - 1) > 1e-9").count() == 0


def test_forest(features):
    forest = clf.train(features, "random_forest")
    assert clf.evaluate(forest, features).first().accuracy == 1.0
    importance = clf.feature_importance(forest, features.sparkSession).toPandas()
    assert len(importance) == 16 + 8 and importance.importance.sum() == pytest.approx(1)


def test_forest_has_as_many_tasks_as_cores_whatever_the_partitions(spark, features, monkeypatch):
    tasks, fit = [], clf.RandomForestClassifier.fit
    monkeypatch.setattr(clf.RandomForestClassifier, "fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    forest = clf.train(features.repartition(40), "random_forest")
    assert tasks == [spark.sparkContext.defaultParallelism]
    assert forest.model.getNumTrees == clf.TREES and clf.evaluate(forest, features).first().accuracy == 1.0
    assert clf._forest_tasks(spark, 100 * clf.FOREST_TASK_ROWS + 1) == 101  # many rows are more tasks


@pytest.mark.parametrize("leak_free", [False, True])
def test_folds(features, leak_free):
    scores = clf.cross_validate(features, leak_free=leak_free, parallelism=3)
    got = scores.collect()
    assert sorted(r.fold for r in got) == [0, 1, 2, 3, 4] and all(0.9 < r.f1_weighted <= 1 for r in got)


def test_training_record(trained, features):
    scores = features.sparkSession.createDataFrame([(0, 0.8), (1, 1.0)], "fold int, f1_weighted double")
    row = clf.training_record(trained, features, scores).first()
    assert row.train_f1 == 1.0 and row.cv_f1_mean == pytest.approx(0.9) and row.cv_f1_std == pytest.approx(0.1)


def test_save_and_load(spark, trained, features, tmp_path):
    clf.save_classifier(trained, spark, str(tmp_path / "m"))
    loaded = clf.load_classifier(spark, str(tmp_path / "m"))
    assert (loaded.kind, loaded.scaler) == (trained.kind, trained.scaler)
    a, b = clf.predict(trained, features), clf.predict(loaded, features)
    assert a.exceptAll(b).count() == 0


def test_misuse_is_rejected(spark, features):
    with pytest.raises(ValueError):
        clf.train(features, "svm")
    with pytest.raises(ValueError):
        clf.train(features.where("false"))
    for call in (lambda: clf.predict(None, features), lambda: clf.feature_importance(None, spark), lambda: clf.save_classifier(None, spark, "x")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        ft.add_vectors(features, "absent")


def test_logistic_minimises_the_penalised_loss(spark):
    """The gradient of 0.5|w|^2 + sum of weighted losses vanishes at the fit."""
    rows = [(str(i), [math.sin(i), math.cos(3 * i)], int(math.sin(i) + 0.3 * math.cos(7 * i) > 0.2)) for i in range(120)]
    df = spark.createDataFrame(rows, "letter_id string, vector array<double>, class int").withColumn(
        "guarantee_letter_text", F.lit("t")
    )
    raw = ft.raw_features(df, "vector")
    model = clf.train(raw, "logistic", "vector")
    w, b = model.model.coefficients.toArray()[:2], model.model.intercept
    count = {c: sum(r[2] == c for r in rows) for c in (0, 1)}
    gradient = [w[0], w[1], 0.0]
    for _, x, c in rows:
        error = 1 / (1 + math.exp(-(w[0] * x[0] + w[1] * x[1] + b))) - c
        error *= 120 / (2 * count[c])
        gradient = [gradient[0] + error * x[0], gradient[1] + error * x[1], gradient[2] + error]
    assert all(abs(g) < 0.02 for g in gradient)
    assert clf.training_curve(model, spark).count() > 1


def test_scaler_uses_the_population_deviation(spark):
    rows = [tuple([i % 2, i, 5, i * i, 0, 1, 0, 0]) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in FEATURE_NAMES))
    scaler = ft.fit_scaler(df)
    frame = df.toPandas()
    assert scaler.deviations == pytest.approx(tuple(frame.std(ddof=0)))
    out = df.select(*ft.scaled(scaler)).toPandas()
    assert (out["length_scaled"] == 0).all()
    assert out["num_codes_scaled"].tolist() == pytest.approx(((frame.num_codes - 2.5) / frame.num_codes.std(ddof=0)).tolist())


def test_class_weights(spark):
    df = letters(spark, [(str(i), "t", int(i < 3)) for i in range(4)] + [("x", "t", None)])
    assert {r["class"]: r.weight for r in ft.class_weights(df).collect()} == {0: 2.0, 1: pytest.approx(4 / 6)}


def test_suite_saves_everything(spark, made, tmp_path):
    train, test = made.where("letter_id LIKE '%1'"), made.where("letter_id LIKE '%2'")
    path = str(tmp_path)
    data = ex.Prepared(train, test, parallelism=2)
    runs = (
        ex.baseline(data, folds=False)
        .unionByName(ex.synthetic_augmentation(data, (10, 20), folds=False))
        .unionByName(ex.generated_augmentation(data, None))
    )
    got = {r.run_id: r for r in runs.collect()}
    data.release()
    assert set(got) == {"baseline", "synthetic_10", "synthetic_20"}
    assert got["synthetic_20"].train_size == got["baseline"].train_size + 20
    assert all(0 <= r.f1_weighted <= 1 for r in got.values())
    sections = ex.run_analysis(train, test, path=path + "/analysis")
    saved = spark.read.json(path + "/analysis/quality_metrics").first()
    assert saved.total_samples == train.count()
    assert {"general_stats", "tfidf_top", "keyword_effectiveness"} <= set(sections)


def test_streams_give_the_batch_result(spark, made, trained, tmp_path):
    schema = "letter_id string, guarantee_letter_text string, class int"
    source = str(tmp_path / "in")
    made.repartition(3).write.parquet(source)
    stream = stream_letters(spark, source, schema=schema)

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    cleaned = drain(preprocess_stream(stream), "cleaned_letters")
    assert cleaned.exceptAll(preprocess_letters(made)).count() == 0 and cleaned.count() == made.count()
    scored = drain(score_stream(clf.train(ft.raw_features(made)), stream), "scored_letters")
    assert scored.where("prediction = class").count() == made.count()


def test_letters_that_experiments_share_are_fitted_and_stored_once(spark, made, monkeypatch):
    fitted, fit = [], ex.train
    monkeypatch.setattr(ex, "train", lambda rows, kind, source: fitted.append(kind) or fit(rows, kind, source))
    data = ex.Prepared(made.where("letter_id LIKE '%1'"), made.where("letter_id LIKE '%2'"))
    assert data.train.schema["embedding"].dataType.typeName() == "vectorudt" and data.train.storageLevel.useMemory
    runs = ex.baseline(data, folds=False).unionByName(ex.classifier_comparison(data, ("logistic",), folds=False)).collect()
    augmented = ex.synthetic_augmentation(data, (10,), folds=False).first()
    assert fitted == ["logistic", "logistic"]  # the letters alone, and with ten more
    assert [r.run_id for r in runs] == ["baseline", "logistic"] and runs[0].f1_weighted == runs[1].f1_weighted
    assert runs[0].train_size == data.train.count() == augmented.train_size - 10
    data.release()
