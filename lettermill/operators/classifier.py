"""Training, scoring, saving and explaining the binary classifier (MLlib)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import newton
from lettermill.operators.features import Scaler, embedding_array, feature_matrix, fit_scaler
from lettermill.operators.metrics import comprehensive_metrics, confusion_cells, evaluation, metrics_from_cells
from lettermill.operators.preprocess import FEATURE_NAMES
from lettermill.operators.ranking import stratified_folds

# Fixed values of the two classifiers.
KINDS = ("logistic", "random_forest")
MAX_ITERATIONS = 1000
TOLERANCE = 1e-4
INVERSE_PENALTY = 1.0
TREES = 100
DEPTH = 10
SEED = 42
FOLDS = 5
#: Rows that one task of a forest's fit holds at most, unless there are fewer of these than cores.
FOREST_TASK_ROWS = 200_000

T = TypeVar("T")

SAVED = "classifier_type string, vector_source string, means array<double>, deviations array<double>"


@dataclass(frozen=True)
class TrainedClassifier:
    kind: str
    model: LogisticRegressionModel | RandomForestClassificationModel
    scaler: Scaler
    vector_source: str = "hashing"


def check_kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unsupported classifier type: {kind}")


def side_by_side(tasks: Sequence[Callable[[], T]], parallelism: int, spark: SparkSession) -> list[T]:
    """Run independent fits from that many driver threads.

    A fit is a chain of short jobs, so several of them share the cluster well
    as long as their cached rows fit together.
    """
    if parallelism <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(spark)
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inherit(task) for task in tasks])


def _label_counts(df: DataFrame, *by: str) -> list:
    """Rows per class (and fold): a handful of numbers."""
    return df.groupBy(*by, "class").agg(F.count("*").alias("n")).collect()


def _fit(matrix: DataFrame, kind: str, counts: dict[int, int]):
    """Fit on (class, features) with balanced class weights.

    The weights sum to n, so a penalty of 1/(C n) on the mean loss is the
    penalty of C on the summed loss.
    """
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("class") == label, F.lit(total / (len(counts) * n))).otherwise(weight)
    weighted = matrix.select(F.col("class").cast("double").alias("label"), "features", weight.alias("weight"))
    if kind == "logistic":
        estimator = LogisticRegression(
            maxIter=MAX_ITERATIONS,
            tol=TOLERANCE,
            regParam=1.0 / (INVERSE_PENALTY * total),
            elasticNetParam=0.0,
            standardization=False,
            weightCol="weight",
        )
    else:
        # The rows keep the nodes they have reached; recomputing them from the parent needs no checkpoint.
        estimator = RandomForestClassifier(
            numTrees=TREES,
            maxDepth=DEPTH,
            featureSubsetStrategy="sqrt",
            seed=SEED,
            weightCol="weight",
            cacheNodeIds=True,
            checkpointInterval=-1,
        )
        weighted = weighted.coalesce(_forest_tasks(matrix.sparkSession, total))
    return estimator.fit(weighted)


def _forest_tasks(spark: SparkSession, rows: int) -> int:
    """At each level a task makes and shuffles the counts of all open nodes, so there are no more tasks than are of use."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FOREST_TASK_ROWS))


def train(
    features: DataFrame, kind: str = "logistic", vector_source: str = "hashing"
) -> TrainedClassifier:
    """Fit scaler and classifier on rows from `raw_features`."""
    check_kind(kind)
    labelled = features.where(F.col("class").isNotNull())
    counts = {r["class"]: r["n"] for r in _label_counts(labelled)}
    if not counts:
        raise ValueError("no labelled rows to train on")
    scaler = fit_scaler(labelled)
    model = _fit(feature_matrix(labelled, scaler), kind, counts)
    return TrainedClassifier(kind, model, scaler, vector_source)


def predict(classifier: TrainedClassifier | None, features: DataFrame) -> DataFrame:
    """Add `prediction` and the probabilities of both classes."""
    if classifier is None:
        raise ValueError("the classifier must be trained before it can predict")
    scored = classifier.model.transform(feature_matrix(features, classifier.scaler))
    probability = vector_to_array("probability")
    return scored.select(
        *[c for c in features.columns if c not in ("embedding", *FEATURE_NAMES)],
        F.col("prediction").cast("int").alias("prediction"),
        F.get(probability, F.lit(0)).alias("probability_0"),
        F.get(probability, F.lit(1)).alias("probability_1"),
    )


def _judged(predictions: DataFrame) -> DataFrame:
    return predictions.withColumnsRenamed({"class": "y", "prediction": "p"})


def evaluate(classifier: TrainedClassifier, features: DataFrame, cells: bool = False) -> DataFrame:
    """One row of test metrics, with the four counts of the confusion matrix if asked for."""
    return evaluation(_judged(predict(classifier, features)), "probability_1", cells=cells)


def _fold_scalers(dealt: DataFrame) -> dict[int, Scaler]:
    """The scaler of each fold's training rows, from one aggregation: parts of the sums are put together."""
    parts = dealt.groupBy("fold").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in FEATURE_NAMES],
        *[F.var_pop(c).alias(f"var_{c}") for c in FEATURE_NAMES],
        *[g(c).alias(f"{n}_{c}") for c in FEATURE_NAMES for n, g in (("min", F.min), ("max", F.max))],
    ).collect()
    out = {}
    for left_out in {r["fold"] for r in parts}:
        inside = [r for r in parts if r["fold"] != left_out]
        n = np.array([[r["n"]] for r in inside], float)
        means = np.array([[r[f"mean_{c}"] or 0.0 for c in FEATURE_NAMES] for r in inside], float)
        variances = np.array([[r[f"var_{c}"] or 0.0 for c in FEATURE_NAMES] for r in inside], float)
        mean = (n * means).sum(axis=0) / n.sum()
        variance = (n * (variances + (means - mean) ** 2)).sum(axis=0) / n.sum()
        for i, c in enumerate(FEATURE_NAMES):
            bounds = {float(r[f"{b}_{c}"] or 0.0) for r in inside for b in ("min", "max")}
            if len(bounds) == 1:  # a constant, whatever rounding has left
                mean[i], variance[i] = bounds.pop(), 0.0
        out[left_out] = Scaler(tuple(mean.tolist()), tuple(np.sqrt(variance).tolist()))
    return out


def _plain(features: DataFrame) -> DataFrame:
    """Rows (fold, class, x) with the unscaled features behind the embedding; classes other than 0 and 1 have no part."""
    x = F.concat(embedding_array(features), F.array(*[F.col(c).cast("double") for c in FEATURE_NAMES]))
    return features.where(F.col("class").isin(0, 1)).select("fold", "class", x.alias("x"))


def _plan(left_out: int, counts: dict[int, int], scaler: Scaler, width: int) -> newton.Plan:
    """width: length of the embedding, which is not scaled. A constant feature becomes 0."""
    counts = {c: n for c, n in counts.items() if c in (0, 1)}
    spread = [d if d > 0 else np.inf for d in scaler.deviations]
    shift, scale = np.append(np.zeros(width), scaler.means), np.append(np.ones(width), spread)
    return newton.Plan(left_out, counts, shift, scale, INVERSE_PENALTY)


def _inside(counted: Sequence, fold: int) -> dict[int, int]:
    """Rows by class outside of a fold."""
    counts: dict[int, int] = {}
    for r in counted:
        if r["fold"] != fold:
            counts[r["class"]] = counts.get(r["class"], 0) + r["n"]
    return counts


def fit_folds(
    dealt: DataFrame, counted: Sequence, leak_free: bool = False, near: TrainedClassifier | None = None
) -> dict[int, newton.Fit]:
    """The logistic model that leaves out each fold, all of them fitted in the same scans.

    dealt: labelled rows of `raw_features` with their fold; counted: rows by fold and class; near: the model of all rows,
    from which fewer scans are needed.
    """
    folds = sorted({r["fold"] for r in counted})
    scalers = _fold_scalers(dealt) if leak_free else dict.fromkeys(folds, fit_scaler(dealt))
    width = _width(dealt)
    plans = [_plan(f, _inside(counted, f), scalers[f], width) for f in folds]
    start = None
    if near is not None and near.model.numClasses <= 2:
        start = np.append(near.model.coefficients.toArray(), near.model.intercept)
        start = start if np.isfinite(start).all() else None  # a model of one class has no finite intercept
    return dict(zip(folds, newton.fit_together(_plain(dealt), plans, start=start), strict=True))


def _width(features: DataFrame) -> int:
    return features.select(F.size(embedding_array(features)).alias("n")).first()["n"]


def held_out_curve(train_features: DataFrame, test_features: DataFrame) -> tuple[DataFrame, newton.Fit, Scaler]:
    """Loss, accuracy, precision and recall of each step on the training rows, val_ on the test rows; and the fit."""
    columns = ["class", "embedding", *FEATURE_NAMES]
    parts = [df.where(F.col("class").isNotNull()).select(*columns, F.lit(i).alias("fold")) for i, df in enumerate((train_features, test_features))]
    both = parts[0].unionByName(parts[1]).persist(StorageLevel.MEMORY_AND_DISK)
    counts = _inside(_label_counts(both, "fold"), 1)
    if not counts:
        raise ValueError("no labelled rows to train on")
    inside = both.where(F.col("fold") == 0)
    scaler, width = fit_scaler(inside), _width(inside)
    (fit,) = newton.fit_together(_plain(both), [_plan(1, counts, scaler, width)])
    both.unpersist()
    return newton.steps_as_rows([fit], train_features).drop("model"), fit, scaler


def cross_validate(
    features: DataFrame,
    kind: str = "logistic",
    folds: int = FOLDS,
    leak_free: bool = False,
    key: str = "letter_id",
    parallelism: int = 1,
    near: TrainedClassifier | None = None,
) -> DataFrame:
    """Weighted F1 per stratified fold: (fold, f1_weighted).

    By default every fold sees features scaled over all rows; `leak_free`
    scales by the training rows of the fold alone. Logistic models of all folds
    are fitted and judged in the same scans, and `parallelism` is for forests;
    their held-out predictions are evaluated together in one aggregation.
    near: the model of all rows, if there is one; logistic folds start from it.
    """
    check_kind(kind)
    dealt = stratified_folds(features.where(F.col("class").isNotNull()), folds, SEED, key)
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    counted = _label_counts(dealt, "fold")
    dealt_folds = sorted({r["fold"] for r in counted})
    if len(dealt_folds) < 2:
        raise ValueError("too few labelled rows to cross-validate")
    spark = features.sparkSession
    if kind == "logistic":
        fits = fit_folds(dealt, counted, leak_free, near)
        dealt.unpersist()
        judged = [(fold, *fit.steps[-1].outside) for fold, fit in fits.items()]
        table = spark.createDataFrame(judged, "fold int, tn bigint, fp bigint, fn bigint, tp bigint")
        return metrics_from_cells(table).select("fold", "f1_weighted")
    scalers = _fold_scalers(dealt) if leak_free else dict.fromkeys(dealt_folds, fit_scaler(dealt))

    def held_out(fold: int) -> DataFrame:
        inside, outside = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        scaler = scalers[fold]
        model = _fit(feature_matrix(inside, scaler), kind, _inside(counted, fold))
        return predict(TrainedClassifier(kind, model, scaler), outside).select("fold", "class", "prediction")

    parts = side_by_side([lambda f=f: held_out(f) for f in dealt_folds], parallelism, spark)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # Four counts per fold are all that outlives the cached rows.
    cells = confusion_cells(_judged(union), by=["fold"])
    rows = cells.collect()
    dealt.unpersist()
    counted_cells = spark.createDataFrame(rows, cells.schema)
    return metrics_from_cells(counted_cells).select("fold", "f1_weighted")


def training_record(
    classifier: TrainedClassifier, features: DataFrame, folds: DataFrame | None = None
) -> DataFrame:
    """Metrics on the training rows, and mean and spread of the fold scores."""
    judged = _judged(predict(classifier, features))
    fitted = comprehensive_metrics(judged).select(
        F.lit(1).alias("one"),
        F.col("accuracy").alias("train_accuracy"),
        F.col("precision_weighted").alias("train_precision"),
        F.col("recall_weighted").alias("train_recall"),
        F.col("f1_weighted").alias("train_f1"),
    )
    if folds is None:
        return fitted.drop("one")
    spread = folds.agg(
        F.avg("f1_weighted").alias("cv_f1_mean"), F.stddev_pop("f1_weighted").alias("cv_f1_std")
    ).withColumn("one", F.lit(1))
    return fitted.join(F.broadcast(spread), "one").drop("one")


def feature_importance(classifier: TrainedClassifier | None, spark: SparkSession) -> DataFrame:
    """Coefficients of the logistic model, importances of the forest."""
    if classifier is None:
        raise ValueError("the classifier must be trained before its features can be ranked")
    values = classifier.model.coefficients if classifier.kind == "logistic" else classifier.model.featureImportances
    values = values.toArray()
    names = [f"embedding_{i}" for i in range(len(values) - len(FEATURE_NAMES))] + list(FEATURE_NAMES)
    rows = [(i, name, float(v)) for i, (name, v) in enumerate(zip(names, values))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def training_curve(classifier: TrainedClassifier, spark: SparkSession) -> DataFrame:
    """Loss per iteration of the logistic fit."""
    if classifier.kind != "logistic" or not classifier.model.hasSummary:
        return spark.createDataFrame([], "iteration int, loss double")
    history = classifier.model.summary.objectiveHistory
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "iteration int, loss double")


def save_classifier(classifier: TrainedClassifier | None, spark: SparkSession, path: str) -> None:
    """Write the model, and what is needed to feed it, below `path`."""
    if classifier is None:
        raise ValueError("the classifier must be trained before it can be saved")
    classifier.model.write().overwrite().save(f"{path}/model")
    about = [
        (
            classifier.kind,
            classifier.vector_source,
            list(classifier.scaler.means),
            list(classifier.scaler.deviations),
        )
    ]
    spark.createDataFrame(about, SAVED).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_classifier(spark: SparkSession, path: str) -> TrainedClassifier:
    about = spark.read.schema(SAVED).json(f"{path}/about").first()
    kind = about["classifier_type"] or "logistic"
    check_kind(kind)
    loader = LogisticRegressionModel if kind == "logistic" else RandomForestClassificationModel
    scaler = Scaler(tuple(about["means"]), tuple(about["deviations"]))
    return TrainedClassifier(kind, loader.load(f"{path}/model"), scaler, about["vector_source"])
