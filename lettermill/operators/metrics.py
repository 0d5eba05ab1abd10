"""Classification metrics of binary predictions (columns y, p and a score).

Every metric follows from the four cells of the confusion matrix, so a table of
predictions is reduced to one row of counts (one per group) by a single
aggregation, and everything else is arithmetic on that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.ranking import midranks

HEADLINE = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted")
CLASS_NAMES = ("Class 0", "Class 1")


def confusion_cells(
    predictions: DataFrame,
    by: Sequence[str] = (),
    weight: str | None = None,
    score: str | None = None,
) -> DataFrame:
    """tn, fp, fn, tp per group; `weight` holds a row's number of copies."""
    y, p = F.col("y"), F.col("p")
    one = F.lit(1) if weight is None else F.col(weight)

    def cell(truth: int, guess: int) -> Column:
        hit = (y == truth) & (p == guess)
        return F.coalesce(F.sum(F.when(hit, one)), F.lit(0)).cast("bigint")

    out = [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]
    if score is not None:
        out.append(F.avg(score).alias("mean_prob_class_1"))
    return predictions.groupBy(*by).agg(*out)


def _ratio(top: Column, bottom: Column) -> Column:
    """Top over bottom as a double, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def _class_rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    # 2PR/(P+R) written in counts: the same value, and 0 exactly when tp is 0.
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def metrics_from_cells(cells: DataFrame, absent: float | None = None) -> DataFrame:
    """All metrics of the four counts; an absent class gives `absent` per class."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    support = {0: tn + fp, 1: tp + fn}
    seen = {0: (tn + fp + fn) > 0, 1: (tp + fp + fn) > 0}
    rates = {0: _class_rates(tn, fn, fp), 1: _class_rates(tp, fp, fn)}
    labels = seen[0].cast("int") + seen[1].cast("int")
    both = seen[0] & seen[1]
    out = {"accuracy": (tn + tp).cast("double") / n}
    for i, name in enumerate(("precision", "recall", "f1")):
        zero, one = rates[0][i], rates[1][i]
        out[f"{name}_weighted"] = (zero * support[0] + one * support[1]) / n
        out[f"{name}_macro"] = (zero + one) / labels
    d = lambda a, b: (a + b).cast("double")
    root = F.sqrt(d(tp, fp) * d(tp, fn) * d(tn, fp) * d(tn, fn))
    product = tp.cast("double") * tn.cast("double") - fp.cast("double") * fn.cast("double")
    out["mcc"] = F.when(root == 0, F.lit(0.0)).otherwise(product / root)
    for label in (0, 1):
        for i, name in enumerate(("precision", "recall", "f1")):
            out[f"{name}_class_{label}"] = F.when(seen[label], rates[label][i]).otherwise(F.lit(absent).cast("double"))
        out[f"support_class_{label}"] = F.when(seen[label], support[label])
    out["specificity"] = F.when(both, _ratio(tn, tn + fp))
    out["sensitivity"] = F.when(both, _ratio(tp, tp + fn))
    return cells.where(n > 0).withColumns(out)


def comprehensive_metrics(predictions: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return metrics_from_cells(confusion_cells(predictions, by, weight))


def evaluation(predictions: DataFrame, score: str, by: Sequence[str] = (), cells: bool = False) -> DataFrame:
    """The record of a classifier's test run; an absent class scores 0. cells: also tn, fp, fn and tp."""
    rows = metrics_from_cells(confusion_cells(predictions, by, score=score), absent=0.0)
    per_class = [f"{m}_class_{c}" for c in (0, 1) for m in ("precision", "recall", "f1")]
    counts = ("tn", "fp", "fn", "tp") if cells else ()
    return rows.select(*by, *counts, *HEADLINE, *per_class, "mean_prob_class_1")


def confusion_rates(predictions: DataFrame) -> DataFrame:
    """The four counts, specificity and sensitivity; nulls unless both classes occur."""
    rows = comprehensive_metrics(predictions)
    both = F.col("specificity").isNotNull()
    return rows.select(
        F.when(both, F.col("tn")).alias("true_negatives"),
        F.when(both, F.col("fp")).alias("false_positives"),
        F.when(both, F.col("fn")).alias("false_negatives"),
        F.when(both, F.col("tp")).alias("true_positives"),
        "specificity",
        "sensitivity",
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """The matrix as (y, p, count) rows over the labels that occur."""
    cells = confusion_cells(predictions)
    seen_0 = (F.col("tn") + F.col("fp") + F.col("fn")) > 0
    seen_1 = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    places = [(0, 0, "tn", seen_0), (0, 1, "fp", seen_0 & seen_1), (1, 0, "fn", seen_0 & seen_1), (1, 1, "tp", seen_1)]
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(c).alias("count"), shown.alias("shown"))
            for y, p, c, shown in places
        ]
    )
    return cells.select(F.inline(rows)).where("shown").drop("shown")


def class_performance(predictions: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """One row per class: distributions, rates, and its three kinds of outcome."""
    rows = comprehensive_metrics(predictions)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    parts = []
    for label, (hit, missed, wrong) in {0: (tn, fp, fn), 1: (tp, fn, fp)}.items():
        parts.append(
            F.struct(
                F.lit(label).alias("class"),
                F.lit(names[label]).alias("name"),
                (hit + missed).alias("true_count"),
                (hit + wrong).alias("predicted_count"),
                F.col(f"precision_class_{label}").alias("precision"),
                F.col(f"recall_class_{label}").alias("recall"),
                F.col(f"f1_class_{label}").alias("f1_score"),
                F.col(f"support_class_{label}").alias("support"),
                hit.alias("correct_predictions"),
                missed.alias("missed_predictions"),
                wrong.alias("false_predictions"),
                (tn + fp + fn + tp).alias("total_samples"),
            )
        )
    return rows.select(F.inline(F.array(*parts))).where(F.col("precision").isNotNull())


def roc_auc(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Exact area under the ROC curve with ties; null when one class is absent."""
    numeric = predictions.where(F.col("y").isNotNull()).select("y", F.col(score).cast("double").alias("score"))
    ranked = midranks(numeric, "score", {"positives": F.sum(F.col("y").cast("bigint"))})
    totals = ranked.agg(
        F.sum(F.col("positives") * F.col("midrank")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("n0"),
        F.sum(F.col("n") * F.col("score")).alias("score_sum"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    area = (F.col("rank_sum") - n1 * (n1 + 1) / 2) / (n1 * n0)
    return totals.select(
        F.when((n1 > 0) & (n0 > 0), area).alias("roc_auc"),
        (F.col("score_sum") / (n1 + n0)).alias("mean_prob_class_1"),
    )
