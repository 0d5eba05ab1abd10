import pandas as pd
import pytest
from pyspark.sql import functions as F

from lettermill.operators import profile as pf
from lettermill.operators.preprocess import preprocess_letters
from lettermill.plans import analysis
from tests.helpers import letters, rows, scattered

CODE = "F10.11.12.3.456"
OTHER = "F20.11.12.3.456"
ROWS = [
    ("1", f"Согаз: {CODE} {CODE} {OTHER}", 1),
    ("2", f"Ингосстрах: {OTHER}", 1),
    ("3", "Согаз, диагноз", 1),
    ("4", "Согаз согласно программе", 0),
    ("5", f"РЕСО {CODE} диагноз", 0),
    ("6", "", 0),
    ("7", None, None),
]


@pytest.fixture(scope="module")
def prepared(spark):
    return preprocess_letters(letters(spark, ROWS)).persist()


def test_quality_counts_contradictions(prepared):
    row = pf.data_quality(prepared).first()
    assert (row.total_samples, row.missing_texts, row.empty_texts) == (7, 1, 1)
    assert (row.class_1_without_codes, row.class_0_with_codes, row.potential_labeling_errors) == (1, 1, 2)
    assert rows(pf.label_contradictions(prepared).select("letter_id", "problem"), "letter_id") == [
        ("3", "class_1_without_codes"),
        ("5", "class_0_with_codes"),
    ]
    assert rows(pf.missing_or_empty(prepared).select("letter_id", "problem"), "letter_id") == [("6", "empty"), ("7", "missing")]


def test_quality_without_optional_columns(spark):
    row = pf.data_quality(letters(spark, ROWS).drop("class")).first()
    assert row.avg_text_length is None and "class_1_without_codes" not in row.asDict()


def test_counts_drop_nulls(prepared):
    assert rows(pf.value_counts(prepared, "class")) == [(0, 3), (1, 3)]
    assert rows(pf.class_distribution(prepared)) == [(0, 3, 50.0), (1, 3, 50.0)]
    shares = pf.class_shares(prepared).first()
    assert (shares.total, shares.imbalance_ratio) == (7, 1.0)


def test_class_sections(prepared):
    frame = prepared.toPandas()
    for row in pf.class_profile(prepared).collect():
        own = frame[frame["class"] == row["class"]]
        assert row.sample_count == len(own)
        assert row.has_service_codes_ratio == pytest.approx(own.has_service_codes.mean())
        assert row.length_std == pytest.approx(own.text_length.std())
    differences = pf.class_differences(prepared).first()
    assert differences.class_0_with_codes == pytest.approx(1 / 3)
    assert differences.class_1_with_codes == pytest.approx(2 / 3)
    scopes = {r.scope: r.sample_count for r in pf.general_statistics(prepared).collect()}
    assert scopes == {"overall": 7, "0": 3, "1": 3}


def test_no_differences_unless_both_classes_occur(prepared):
    assert pf.class_differences(prepared.where("class = 1")).count() == 0


def test_company_section(prepared):
    got = {r.insurance_company: (r.sample_count, r.class_0, r.class_1) for r in pf.company_profile(prepared).collect()}
    assert got == {"Согаз": (3, 1, 2), "Ингосстрах": (1, 0, 1), "Другая": (3, 2, 0)}


def test_code_sections(prepared):
    assert rows(pf.code_statistics(prepared)) == [(2, 5)]
    assert rows(pf.top_codes(prepared)) == [(CODE, 3), (OTHER, 2)]
    assert rows(pf.top_prefixes(prepared)) == [("F10", 3), ("F20", 2)]
    assert rows(pf.codes_per_letter(prepared)) == [(3, 5 / 3, 3)]
    assert rows(pf.codes_by_class(prepared), "class") == [(0, 1, 1), (1, 2, 4)]
    assert rows(pf.top_codes_by_class(prepared, 1).select("class", "code", "count"), "class") == [(0, CODE, 1), (1, CODE, 2)]


def test_code_sections_of_letters_without_codes(prepared):
    plain = prepared.where("num_service_codes = 0")
    assert rows(pf.code_statistics(plain)) == [(0, 0)]
    assert rows(pf.codes_by_class(plain), "class") == [(0, 0, 0), (1, 0, 0)]


def test_keywords(prepared):
    counts = pf.keyword_counts(prepared)
    assert rows(pf.keyword_frequency(counts), "keyword") == [(1, "диагноз", 2), (0, "согласно программе", 1)]
    purity = {r.keyword: (r.class_0_ratio, r.preferred_class) for r in pf.keyword_purity(counts).collect()}
    assert purity == {"диагноз": (0.5, 1), "согласно программе": (1.0, 0)}


def test_quantiles_equal_pandas(spark):
    values = [(str(i), "x" * ((i * 7) % 23), i % 2) for i in range(101)]
    prepared = preprocess_letters(letters(spark, values))
    frame = prepared.select("class", "text_length").toPandas()
    for row in pf.size_quantiles(prepared).where("measure = 'text_length'").collect():
        own = frame[frame["class"] == row["class"]].text_length
        expected = own.quantile([0, 0.25, 0.5, 0.75, 1]).tolist()
        assert [row.minimum, row.quartile_1, row.median, row.quartile_3, row.maximum] == pytest.approx(expected)


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_do_not_matter(prepared, n):
    for section in (pf.class_profile, pf.company_profile, pf.top_codes, pf.codes_by_class, pf.keyword_counts):
        a, b = section(prepared).toPandas(), section(scattered(prepared, n)).toPandas()
        order = list(a.columns)
        pd.testing.assert_frame_equal(
            a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True)
        )


def test_filters(prepared):
    assert pf.rows_of_class(prepared, 0).count() == 3
    assert pf.rows_of_company(prepared, "Согаз").count() == 3
    assert pf.letters_with_codes(prepared).count() == 3
    assert pf.distinct_values(prepared, "class").count() == 3
    assert rows(pf.mean_score(prepared.withColumn("quality_score", F.lit(0.5)))) == [(7, 0.5)]


def test_sections_of_keywords_and_weights_do_not_read_the_letters_again(spark, tmp_path, capsys):
    letters(spark, ROWS).write.parquet(f"{tmp_path}/letters")
    sections = analysis.letter_patterns(preprocess_letters(spark.read.parquet(f"{tmp_path}/letters")))
    capsys.readouterr()
    for name in ("keyword_frequency", "keyword_effectiveness", "tfidf_top", "tfidf_top_by_class"):
        sections[name].explain()
        assert "parquet" not in capsys.readouterr().out.lower()
    sections["general_stats"].explain()
    assert "parquet" in capsys.readouterr().out.lower()
