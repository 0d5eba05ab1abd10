"""Comparison and presentation of experiment runs.

A run is one row: run_id, family (baseline, synthetic, generated, classifier),
size (added letters), train_size, test_size and the metrics. There are as many
rows as experiments, so windows over all of them are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.operators.metrics import HEADLINE

# Titles of tables and reports.
FAMILY_TITLES = (
    ("baseline", "Базовая модель (только реальные данные)"),
    ("synthetic", "Шаблонные синтетические данные"),
    ("generated", "LLM синтетические данные"),
)
REPORT_TITLE = "# Отчет по экспериментам классификации страховых писем"
REPORT_DATE = "Дата проведения: "
REPORT_SECTION = "## Сводка результатов"
REPORT_BASELINE = "**Базовая модель (только реальные данные):**"
REPORT_SYNTHETIC = "**Лучший результат с синтетическими данными:**"
REPORT_GENERATED = "**Лучший результат с LLM данными:**"
REPORT_SYNTHETIC_SIZE = "- Размер синтетической выборки: "
REPORT_GENERATED_SIZE = "- Размер LLM выборки: "
REPORT_IMPROVEMENT = "- Улучшение: +"
REPORT_QUALITY = "- Средняя оценка качества: "
NO_RESULTS = "No experiment results available"
# End of the fixed values.


def compare_runs(runs: DataFrame, metrics: Sequence[str] = HEADLINE) -> DataFrame:
    """Chosen metrics (0 where missing) and sizes, best weighted F1 first."""
    present = set(runs.columns)
    chosen = [
        (F.coalesce(F.col(m), F.lit(0.0)) if m in present else F.lit(0.0)).alias(m) for m in metrics
    ]
    table = runs.select("run_id", *chosen, "train_size", "size")
    if "f1_weighted" in metrics:
        table = table.orderBy(F.desc("f1_weighted"), F.asc("run_id"))
    return table


def sorted_by_metric(runs: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    return runs.orderBy(F.desc(metric), F.asc("run_id"))


def ablation_series(runs: DataFrame, metric: str = "f1_weighted", family: str = "synthetic") -> DataFrame:
    """(size, value) with the improvement over the baseline in percent, by size."""
    own = runs.where(F.col("family") == family)
    base = _baseline(runs, [metric])
    joined = _beside(own, base)
    change = F.when(F.col(f"base_{metric}") > 0, (F.col(metric) - F.col(f"base_{metric}")) / F.col(f"base_{metric}") * 100)
    return joined.select("size", F.col(metric).alias("value"), change.alias("improvement_percent")).orderBy("size")


def best_runs(runs: DataFrame) -> DataFrame:
    """The run with the best weighted F1 of each family; the smaller wins a tie."""
    order = Window.partitionBy("family").orderBy(F.desc("f1_weighted"), F.asc("size"), F.asc("run_id"))
    return runs.withColumn("_position", F.row_number().over(order)).where("_position = 1").drop("_position")


def _baseline(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: the baseline run's metrics under base_ names."""
    best = best_runs(runs.where(F.col("family") == "baseline"))
    return best.select(F.lit(1).alias("_one"), *[F.col(m).alias(f"base_{m}") for m in metrics])


def _beside(runs: DataFrame, base: DataFrame) -> DataFrame:
    """Put the single baseline row beside every run."""
    return runs.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one", "left").drop("_one")


def improvements(runs: DataFrame, metrics: Sequence[str] = HEADLINE) -> DataFrame:
    """Per run and metric: absolute and relative change against the baseline.

    Metrics whose baseline is not above zero are left out.
    """
    others = runs.where(F.col("family") != "baseline")
    joined = _beside(others, _baseline(runs, metrics))
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"base_{m}").alias("baseline_value"),
                F.col(m).alias("value"),
            )
            for m in metrics
        ]
    )
    change = F.col("value") - F.col("baseline_value")
    return (
        joined.select("run_id", "family", "size", F.inline(rows))
        .where((F.col("baseline_value") > 0) & F.col("value").isNotNull())
        .select(
            "run_id",
            "family",
            "size",
            "metric",
            change.alias("absolute_improvement"),
            (change / F.col("baseline_value") * 100).alias("relative_improvement"),
            (F.col("value") > F.col("baseline_value")).alias("is_better"),
        )
    )


def level(percent: Column) -> Column:
    return (
        F.when(percent > 5, "significant")
        .when(percent > 1, "moderate")
        .when(percent > 0, "slight")
        .otherwise("none_or_negative")
    )


def improvement_levels(runs: DataFrame) -> DataFrame:
    """Overall improvement (weighted F1, 0 where undefined) and its level."""
    others = runs.where(F.col("family") != "baseline")
    joined = _beside(others, _baseline(runs, ["f1_weighted"]))
    base = F.col("base_f1_weighted")
    percent = F.coalesce(F.when(base > 0, (F.col("f1_weighted") - base) / base * 100), F.lit(0.0))
    return joined.select("run_id", percent.alias("overall_improvement")).withColumn(
        "improvement_level", level(F.col("overall_improvement"))
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Best run per family beside the baseline; a family without runs has no row."""
    best = _beside(best_runs(runs), _baseline(runs, ["f1_weighted"]))
    base = F.col("base_f1_weighted")
    quality = F.col("mean_quality") if "mean_quality" in runs.columns else F.lit(None).cast("double")
    return best.select(
        "family",
        "run_id",
        "size",
        "f1_weighted",
        "accuracy",
        F.when(base > 0, (F.col("f1_weighted") - base) / base * 100).alias("improvement_percent"),
        quality.alias("mean_quality"),
    )


def results_table(runs: DataFrame) -> DataFrame:
    """One row per baseline, synthetic and generated run under a readable label."""
    label = None
    for family, title in FAMILY_TITLES:
        shown = F.lit(title) if family == "baseline" else F.concat(F.lit(title + " ("), F.col("size").cast("string"), F.lit(")"))
        hit = F.col("family") == family
        label = F.when(hit, shown) if label is None else label.when(hit, shown)
    place = F.array_position(F.array(*[F.lit(f) for f, _ in FAMILY_TITLES]), F.col("family"))
    known = runs.where(F.col("family").isin([f for f, _ in FAMILY_TITLES]))
    table = known.select(
        label.alias("experiment"),
        "train_size",
        F.col("size").alias("synthetic_size"),
        "accuracy",
        F.col("f1_weighted").alias("f1"),
        F.col("precision_weighted").alias("precision"),
        F.col("recall_weighted").alias("recall"),
        place.alias("_place"),
    )
    return table.orderBy("_place", "synthetic_size").drop("_place")


def metric_series(runs: DataFrame, metrics: Sequence[str] = HEADLINE) -> DataFrame:
    """Long form (run_id, metric, value) for bar charts."""
    present = [m for m in metrics if m in runs.columns]
    long = runs.select("run_id", *present).unpivot("run_id", present, "metric", "value")
    return long.where(F.col("value").isNotNull())


def dashboard(runs: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the three dashboard charts."""
    best = best_runs(runs.where(F.col("family").isin("baseline", "synthetic", "generated")))
    return {
        "metrics_comparison": metric_series(best),
        "synthetic_ablation": ablation_series(runs).select("size", "value"),
        "baseline_confusion_matrix": cells,
    }


def matrix_of_run(runs: DataFrame, family: str) -> DataFrame:
    """The confusion matrix (y, p, count) that a family's run carries."""
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(p).alias("p"), F.col(c).alias("count")) for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return runs.where(F.col("family") == family).select(F.inline(cells))


def summary_lines(runs: DataFrame, run_label: str) -> DataFrame:
    """The report as (line_number, line): one section per family that has runs; one line if there is none."""
    if runs.isEmpty():
        return runs.sparkSession.createDataFrame([(0, NO_RESULTS)], "line_number int, line string")
    summary = run_summary(runs)
    three = lambda c: F.format_string("%.3f", F.col(c))
    whole = lambda c: F.col(c).cast("string")
    sections = {
        "baseline": [
            F.lit(REPORT_BASELINE),
            F.concat(F.lit("- F1-score: "), three("f1_weighted")),
            F.concat(F.lit("- Accuracy: "), three("accuracy")),
            F.lit(""),
        ],
        "synthetic": [
            F.lit(REPORT_SYNTHETIC),
            F.concat(F.lit(REPORT_SYNTHETIC_SIZE), whole("size")),
            F.concat(F.lit("- F1-score: "), three("f1_weighted")),
            F.concat(F.lit(REPORT_IMPROVEMENT), F.format_string("%.1f", F.col("improvement_percent")), F.lit("%")),
            F.lit(""),
        ],
        "generated": [
            F.lit(REPORT_GENERATED),
            F.concat(F.lit(REPORT_GENERATED_SIZE), whole("size")),
            F.concat(F.lit("- F1-score: "), three("f1_weighted")),
            F.concat(F.lit(REPORT_QUALITY), three("mean_quality")),
            F.lit(""),
        ],
    }
    lines, place = F.array().cast("array<string>"), F.lit(0)
    for i, (family, texts) in enumerate(sections.items()):
        hit = F.col("family") == family
        lines = F.when(hit, F.array(*texts)).otherwise(lines)
        place = F.when(hit, F.lit(10 * (i + 1))).otherwise(place)
    body = summary.where(F.col("family").isin(list(sections))).select(
        place.alias("place"), F.posexplode(lines).alias("offset", "line")
    )
    head = [REPORT_TITLE, REPORT_DATE + run_label, "", REPORT_SECTION, ""]
    spark = runs.sparkSession
    head_rows = spark.createDataFrame([(i, t) for i, t in enumerate(head)], "line_number int, line string")
    return head_rows.unionByName(body.select((F.col("place") + F.col("offset")).alias("line_number"), "line"))
