import pytest
from pyspark.sql import functions as F

from lettermill.operators import runs as rn
from lettermill.sources import results as sink
from tests.helpers import rows

SCHEMA = (
    "run_id string, family string, size int, train_size bigint, accuracy double, f1_weighted double, "
    "precision_weighted double, recall_weighted double, mean_quality double"
)


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [
            ("baseline", "baseline", 0, 100, 0.8, 0.5, 0.0, 0.5, None),
            ("synthetic_100", "synthetic", 100, 200, 0.8, 0.6, 0.5, 0.6, None),
            ("synthetic_50", "synthetic", 50, 150, 0.7, 0.6, 0.5, 0.6, None),
            ("generated_50", "generated", 50, 150, 0.9, 0.503, 0.5, None, 0.91),
        ],
        SCHEMA,
    )


def test_comparison_is_sorted_and_fills_gaps(runs):
    table = rn.compare_runs(runs, ["f1_weighted", "recall_weighted", "absent"])
    assert rows(table) == [
        ("synthetic_100", 0.6, 0.6, 0.0, 200, 100),
        ("synthetic_50", 0.6, 0.6, 0.0, 150, 50),
        ("generated_50", 0.503, 0.0, 0.0, 150, 50),
        ("baseline", 0.5, 0.5, 0.0, 100, 0),
    ]


def test_the_smaller_run_wins_a_tie(runs):
    assert {r.family: r.run_id for r in rn.best_runs(runs).collect()}["synthetic"] == "synthetic_50"


def test_improvements_skip_a_zero_baseline_and_missing_values(runs):
    got = rn.improvements(runs).collect()
    assert {r.metric for r in got} == {"accuracy", "f1_weighted", "recall_weighted"}
    assert not [r for r in got if r.run_id == "generated_50" and r.metric == "recall_weighted"]
    best = next(r for r in got if r.run_id == "synthetic_50" and r.metric == "f1_weighted")
    assert best.relative_improvement == pytest.approx(20) and best.is_better


def test_levels(runs, spark):
    got = {r.run_id: r.improvement_level for r in rn.improvement_levels(runs).collect()}
    assert got == {"synthetic_100": "significant", "synthetic_50": "significant", "generated_50": "slight"}
    values = spark.createDataFrame([(5.1,), (5.0,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in values.select(rn.level(F.col("x"))).collect()] == ["significant", "moderate", "slight", "none_or_negative"]


def test_empty_families_give_no_rows(runs):
    only = runs.where("family = 'baseline'")
    assert rn.run_summary(only).count() == 1
    assert rn.ablation_series(only).count() == 0
    assert rn.improvements(only).count() == 0
    assert rn.results_table(runs.where("false")).count() == 0


def test_tables_and_series(runs):
    assert [r.experiment for r in rn.results_table(runs).collect()] == [
        "Базовая модель (только реальные данные)",
        "Шаблонные синтетические данные (50)",
        "Шаблонные синтетические данные (100)",
        "LLM синтетические данные (50)",
    ]
    assert [r.size for r in rn.ablation_series(runs).collect()] == [50, 100]
    assert rn.metric_series(runs).count() == 15
    assert rn.sorted_by_metric(runs).first().run_id == "synthetic_100"


def test_report(runs, spark, tmp_path):
    sink.write_report(rn.summary_lines(runs, "20240101_000000"), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report"), wholetext=True).collect()][0].split("\n")
    assert lines[:5] == [rn.REPORT_TITLE, rn.REPORT_DATE + "20240101_000000", "", rn.REPORT_SECTION, ""]
    assert lines[5:8] == [rn.REPORT_BASELINE, "- F1-score: 0.500", "- Accuracy: 0.800"]
    assert "- Улучшение: +20.0%" in lines and "- Средняя оценка качества: 0.910" in lines


def test_latest_run(runs, spark, tmp_path):
    schema = "run_id string, f1_weighted double"
    sink.write_runs(runs.where("family = 'baseline'"), str(tmp_path), "b")
    sink.write_runs(runs, str(tmp_path), "a")
    found = sink.latest_runs(spark, str(tmp_path), schema)
    assert found.count() == 4 and {r.experiment for r in found.collect()} == {"a"}


def test_no_runs_give_one_line(runs):
    assert [r.line for r in rn.summary_lines(runs.where("false"), "x").collect()] == [rn.NO_RESULTS]


def test_matrix_of_a_run(spark):
    table = spark.createDataFrame([("baseline", 5, 1, 2, 7), ("synthetic", 0, 0, 0, 1)], "family string, tn long, fp long, fn long, tp long")
    assert rows(rn.matrix_of_run(table, "baseline"), "y", "p") == [(0, 0, 5), (0, 1, 1), (1, 0, 2), (1, 1, 7)]


def test_predictions_are_kept_by_run(spark, tmp_path):
    found = spark.createDataFrame([("a", 1, 0.25, 0.75)], "letter_id string, prediction int, probability_0 double, probability_1 double")
    for run in ("baseline", "synthetic_50"):
        sink.write_predictions(found, str(tmp_path), run)
    read = sink.read_predictions(spark, str(tmp_path))
    assert sorted((r.run_id, r.letter_id, r.probability_1) for r in read.collect()) == [("baseline", "a", 0.75), ("synthetic_50", "a", 0.75)]
