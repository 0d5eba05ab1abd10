"""Baseline, augmentation and classifier experiments as rows of runs.

The rows of a run need several passes (scaling, folds, fitting, scoring), so
their compact features are persisted once and the texts are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.operators.classifier import (
    KINDS,
    TrainedClassifier,
    cross_validate,
    evaluate,
    predict,
    save_classifier,
    side_by_side,
    train,
    training_record,
)
from lettermill.operators.features import raw_features
from lettermill.operators.requests import generated_set, generation_requests
from lettermill.operators.runs import best_runs, dashboard, matrix_of_run, results_table, run_summary, summary_lines
from lettermill.operators.synth import class_counts, ratio_preserving_set, split_size
from lettermill.operators.termspace import TermSpace, save_term_space
from lettermill.plans.analysis import load_and_analyze
from lettermill.sources.results import (
    write_analysis,
    write_letters_csv,
    write_predictions,
    write_report,
    write_results_table,
    write_runs,
)
from lettermill.sources.runstore import commit_runs

# Default numbers of added letters.
SYNTHETIC_SIZES = (50, 100, 200)
GENERATED_SIZES = (50, 100)

RUN_SCHEMA = (
    "run_id string, family string, size int, train_size bigint, test_size bigint, mean_quality double, "
    "real_synthetic_ratio double, tn bigint, fp bigint, fn bigint, tp bigint, "
    "accuracy double, f1_weighted double, precision_weighted double, recall_weighted double, "
    "precision_class_0 double, recall_class_0 double, f1_class_0 double, "
    "precision_class_1 double, recall_class_1 double, f1_class_1 double, mean_prob_class_1 double, "
    "train_accuracy double, train_precision double, train_recall double, train_f1 double, "
    "cv_f1_mean double, cv_f1_std double"
)


class Prepared:
    """Persisted features of the training and the test letters.

    `parallelism` is the number of fits that may run at the same time. What was fitted to the training letters alone is
    kept, so that experiments that share them fit a kind of classifier once.
    """

    def __init__(
        self,
        train_letters: DataFrame,
        test_letters: DataFrame,
        vectors: str | TermSpace = "hashing",
        domain: Domain = DEFAULT,
        parallelism: int = 1,
    ):
        self.source, self.domain, self.parallelism = vectors, domain, parallelism
        self.vectors = "learnt" if isinstance(vectors, TermSpace) else vectors
        self.train = self.features(train_letters).persist(StorageLevel.MEMORY_AND_DISK)
        self.test = self.features(test_letters).persist(StorageLevel.MEMORY_AND_DISK)
        self.train_size, self.test_size = self.train.count(), self.test.count()
        self.fitted: dict[tuple[str, bool], tuple[TrainedClassifier, dict]] = {}

    def features(self, letters: DataFrame) -> DataFrame:
        return raw_features(letters, self.source, domain=self.domain, packed=True)

    def fit(self, features: DataFrame, kind: str, folds: bool) -> tuple[TrainedClassifier, dict]:
        """The model of some rows, and its metrics on them, on folds and on the test letters."""
        if features is self.train and (kind, folds) in self.fitted:
            return self.fitted[kind, folds]
        model = train(features, kind, self.vectors)
        near = model if kind == "logistic" else None
        scores = cross_validate(features, kind, parallelism=self.parallelism, near=near) if folds else None
        metrics = training_record(model, features, scores).first().asDict()
        metrics |= evaluate(model, self.test, cells=True).first().asDict()
        if features is self.train:
            self.fitted[kind, folds] = model, metrics
        return model, metrics

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def _run(
    data: Prepared,
    features: DataFrame,
    run_id: str,
    family: str,
    size: int,
    kind: str,
    quality: float | None = None,
    folds: bool = True,
    model_path: str | None = None,
    added: int = 0,
) -> DataFrame:
    """Train, cross-validate and test once; the result is one row of metrics and the confusion matrix.

    With a path, the model (a learnt space beside it) and the tested letters' predictions and probabilities are saved there.
    added: rows of `features` beyond the training letters.
    """
    spark = features.sparkSession
    model, metrics = data.fit(features, kind, folds)
    if model_path is not None:
        save_classifier(model, spark, f"{model_path}/{run_id}_model")
        if isinstance(data.source, TermSpace):
            save_term_space(data.source, spark, f"{model_path}/{run_id}_space")
        write_predictions(predict(model, data.test), model_path, run_id)
    train_size = data.train_size + added
    row = {
        "run_id": run_id,
        "family": family,
        "size": size,
        "train_size": train_size,
        "real_synthetic_ratio": (train_size - size) / size if family == "synthetic" else None,
        "test_size": data.test_size,
        "mean_quality": quality,
        **metrics,
    }
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA)


def _together(rows: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], RUN_SCHEMA)


def baseline(data: Prepared, kind: str = "logistic", folds: bool = True, path: str | None = None) -> DataFrame:
    """Real letters only."""
    return _run(data, data.train, "baseline", "baseline", 0, kind, folds=folds, model_path=path)


def _with_extra(data: Prepared, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training letters' features and those of some more letters; these alone, which are persisted.

    The training letters are persisted already and are not copied for each size.
    """
    own = data.features(extra).persist(StorageLevel.MEMORY_AND_DISK)
    return data.train.unionByName(own, allowMissingColumns=True), own


def synthetic_augmentation(
    data: Prepared,
    sizes: Sequence[int] = SYNTHETIC_SIZES,
    kind: str = "logistic",
    folds: bool = True,
    path: str | None = None,
) -> DataFrame:
    """Real letters plus `size` template letters, for each size."""
    counts = class_counts(data.train)

    def one(size: int) -> DataFrame:
        extra = ratio_preserving_set(data.train, counts[0] + size, domain=data.domain, counts=counts)
        features, own = _with_extra(data, extra)
        row = _run(data, features, f"synthetic_{size}", "synthetic", size, kind, folds=folds, model_path=path, added=own.count())
        own.unpersist()
        return row

    rows = side_by_side([lambda s=s: one(s) for s in sizes], data.parallelism, data.train.sparkSession)
    return _together(rows, data.train.sparkSession)


def generated_augmentation(
    data: Prepared,
    responses: DataFrame | None,
    sizes: Sequence[int] = GENERATED_SIZES,
    kind: str = "logistic",
    folds: bool = True,
    path: str | None = None,
) -> DataFrame:
    """Real letters plus generated ones; no rows when there is no response table."""
    spark = data.train.sparkSession
    if responses is None:
        return _together([], spark)
    counts = class_counts(data.train)

    def one(size: int) -> DataFrame:
        requests = generation_requests(spark, split_size(size, counts, "truncate"), domain=data.domain)
        extra = generated_set(requests, responses, domain=data.domain).persist(StorageLevel.MEMORY_AND_DISK)
        quality = extra.agg(F.avg("quality_score")).first()[0]
        features, own = _with_extra(data, extra)
        row = _run(data, features, f"generated_{size}", "generated", size, kind, quality, folds, path, own.count())
        if path is not None:
            write_letters_csv(extra, f"{path}/generated_{size}_letters")
        own.unpersist()
        extra.unpersist()
        return row

    return _together(side_by_side([lambda s=s: one(s) for s in sizes], data.parallelism, data.train.sparkSession), spark)


def classifier_comparison(
    data: Prepared, kinds: Sequence[str] = KINDS, folds: bool = True, path: str | None = None
) -> DataFrame:
    """Each kind of classifier on the same letters."""

    def one(kind: str) -> DataFrame:
        return _run(data, data.train, kind, "classifier", 0, kind, folds=folds, model_path=path)

    rows = side_by_side([lambda k=k: one(k) for k in kinds], data.parallelism, data.train.sparkSession)
    return _together(rows, data.train.sparkSession)


def full_suite(
    train_letters: DataFrame,
    test_letters: DataFrame,
    responses: DataFrame | None = None,
    vectors: str | TermSpace = "hashing",
    domain: Domain = DEFAULT,
    folds: bool = True,
    path: str | None = None,
    run_label: str = "unlabelled",
    parallelism: int = 1,
) -> DataFrame:
    """The analysis and all four experiments; with `path`, analysis, models, predictions, table and report are saved."""
    data = _prepared(train_letters, test_letters, vectors, domain, path, run_label, parallelism)
    out = None if path is None else f"{path}/models_{run_label}"
    runs = _together(
        [
            baseline(data, folds=folds, path=out),
            synthetic_augmentation(data, folds=folds, path=out),
            generated_augmentation(data, responses, folds=folds, path=out),
            classifier_comparison(data, folds=folds, path=out),
        ],
        train_letters.sparkSession,
    )
    data.release()
    return _reported(runs, path, run_label)


def _prepared(
    train: DataFrame, test: DataFrame, vectors: str | TermSpace, domain: Domain, path: str | None, run_label: str, parallelism: int
) -> Prepared:
    """Features of both splits, after the analysis; the training letters that it keeps are read again for them."""
    if path is None:
        load_and_analyze(train, test, domain)
        return Prepared(train, test, vectors, domain, parallelism)
    letters = load_and_analyze(train, test, domain, f"{path}/analysis_{run_label}", keep=True)[0]
    data = Prepared(letters, test, vectors, domain, parallelism)
    letters.unpersist()
    return data


def _reported(runs: DataFrame, path: str | None, run_label: str) -> DataFrame:
    """The same runs; with `path`, they are saved with their table and report, and then committed."""
    if path is not None:
        write_runs(runs, path, run_label)
        write_results_table(results_table(runs), f"{path}/table_{run_label}")
        write_report(summary_lines(runs, run_label), f"{path}/report_{run_label}")
        commit_runs(runs, path, run_label)
    return runs


# --- the four ways of running it all: each starts with the analysis and ends with the report -----


def run_analysis(
    train_letters: DataFrame, test_letters: DataFrame, domain: Domain = DEFAULT, path: str | None = None
) -> dict[str, DataFrame]:
    """All sections of the analysis; with `path`, they are saved there."""
    return load_and_analyze(train_letters, test_letters, domain, path)[2]


def run_baseline(
    train_letters: DataFrame,
    test_letters: DataFrame,
    vectors: str | TermSpace = "hashing",
    domain: Domain = DEFAULT,
    path: str | None = None,
    run_label: str = "unlabelled",
    parallelism: int = 1,
) -> DataFrame:
    """Real letters only: its one run."""
    data = _prepared(train_letters, test_letters, vectors, domain, path, run_label, parallelism)
    runs = baseline(data, path=None if path is None else f"{path}/models_{run_label}")
    data.release()
    return _reported(runs, path, run_label)


def run_synthetic(
    train_letters: DataFrame,
    test_letters: DataFrame,
    sizes: Sequence[int] = SYNTHETIC_SIZES,
    vectors: str | TermSpace = "hashing",
    domain: Domain = DEFAULT,
    folds: bool = True,
    path: str | None = None,
    run_label: str = "unlabelled",
    parallelism: int = 1,
) -> DataFrame:
    """Baseline and template augmentation, summarised."""
    data = _prepared(train_letters, test_letters, vectors, domain, path, run_label, parallelism)
    out = None if path is None else f"{path}/models_{run_label}"
    runs = baseline(data, folds=folds, path=out).unionByName(synthetic_augmentation(data, sizes, folds=folds, path=out))
    data.release()
    return run_summary(_reported(runs, path, run_label))


def run_full(
    train_letters: DataFrame,
    test_letters: DataFrame,
    responses: DataFrame | None = None,
    vectors: str | TermSpace = "hashing",
    domain: Domain = DEFAULT,
    path: str | None = None,
    run_label: str = "unlabelled",
    parallelism: int = 1,
) -> DataFrame:
    """The full suite with the tables of its dashboard, summarised."""
    runs = full_suite(train_letters, test_letters, responses, vectors, domain, True, path, run_label, parallelism)
    if path is not None:
        write_analysis(dashboard(runs, matrix_of_run(best_runs(runs), "baseline")), f"{path}/dashboard_{run_label}")
    return run_summary(runs)
