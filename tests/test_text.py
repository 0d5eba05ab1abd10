import re

import pytest
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT
from lettermill.functions import text as tx
from lettermill.operators.preprocess import FEATURE_NAMES, handcrafted_features, preprocess_letters
from tests.helpers import evaluated, letters, one_column


def test_whitespace_is_what_python_splits_at(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    df = one_column(spark, [f"a{chr(p)}b" for p in points])
    counts = evaluated(df, tx.raw_word_count(F.col("t")))
    assert counts == [len(f"a{chr(p)}b".split()) for p in points]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("", ""),
        ("  \n\t ", ""),
        ("a\n\nb", "a b"),
        (" a  b , c ; d ! ", "a b, c; d!"),
        ("a , , b", "a,, b"),
        (" , a", ", a"),
        ("x  y .", "x y."),
        ("Диагноз :\nОстрое  состояние .", "Диагноз: Острое состояние."),
    ],
)
def test_clean_text(spark, raw, expected):
    df = one_column(spark, [raw])
    assert evaluated(df, tx.clean_text(F.col("t"))) == [expected]


def test_word_count_and_length_of_cleaned_text(spark):
    values = ["", "a", "a b", "a, b c", "диагноз: х"]
    df = one_column(spark, values)
    assert evaluated(df, tx.word_count(F.col("t"))) == [len(v.split()) for v in values]
    assert evaluated(df, tx.text_length(F.col("t"))) == [len(v) for v in values]


def test_model_text_strips_the_edges_only(spark):
    values = [" a  b\n", " x ", "", "a\n b"]
    df = one_column(spark, [*values, None])
    assert evaluated(df, tx.model_text(F.col("t"))) == [v.strip() for v in values] + [""]


def test_codes_keep_order_and_duplicates(spark):
    text = "F10.11.12.3.456 и F99.98.97.6.543, F10.11.12.3.456; F1.2.3.4.5"
    df = one_column(spark, [text, "нет"])
    assert evaluated(df, tx.extract_codes(F.col("t")))[0] == re.findall(DEFAULT.code_pattern, text)
    assert evaluated(df, tx.count_codes(F.col("t"))) == [3, 0]
    assert evaluated(df, tx.has_codes(F.col("t"))) == [True, False]


def test_company_takes_the_first_declared_pattern(spark):
    values = ["ингосстрах и СоГаЗ", "АО ИнГосСтрах", "РЕСО", ""]
    df = one_column(spark, values)
    assert evaluated(df, tx.company(F.col("t"))) == ["Согаз", "Ингосстрах", "Другая", "Другая"]


def test_phrases_ignore_case_like_a_regex(spark):
    words = ["Диагноз", "ДИАГНОЗ", "диагно", "kK", "maſt", "ᲀода"]
    phrases = ["диагноз", "kk", "mast", "Вода"]
    df = one_column(spark, words)
    for phrase in phrases:
        found = evaluated(df, tx.contains_phrase(tx.fold_case(F.col("t")), phrase))
        assert found == [bool(re.search(re.escape(phrase), w, re.IGNORECASE)) for w in words], phrase


def test_diagnosis_pattern_also_matches_code_heads(spark):
    df = one_column(spark, ["J06.9 и K21, F10.11.12.3.456"])
    assert evaluated(df, tx.extract_diagnoses(F.col("t"))) == [["J06.9", "K21", "F10.11"]]


def test_preprocess_adds_ids_only_when_given(spark):
    df = letters(spark, [("1", "СОГАЗ\n\nкод F10.11.12.3.456 .", 1)])
    row = preprocess_letters(df).first()
    assert row.text_cleaned == "СОГАЗ код F10.11.12.3.456."
    assert (row.num_service_codes, row.has_service_codes, row.insurance_company) == (1, True, "Согаз")
    assert "parsed_service_ids" not in row.asDict()
    with_ids = preprocess_letters(df.withColumn("service_ids_list", F.lit("[1, 2]"))).first()
    assert with_ids.parsed_service_ids == [1, 2]


def test_handcrafted_features_use_the_raw_text(spark):
    df = letters(
        spark,
        [
            ("1", "Согаз\n\nНеобходимые исследования , приемы врача ДМС", 0),
            ("2", "Оплату следующих медицинских услуг: F10.11.12.3.456 F10.11.12.3.457 диагноз", 1),
            ("3", None, 1),
        ],
    )
    got = {r.letter_id: tuple(r[n] for n in FEATURE_NAMES) for r in handcrafted_features(df).collect()}
    first, second = (r[1] for r in df.where("letter_id < '3'").orderBy("letter_id").collect())
    assert got["1"] == (0, 0, len(first), len(first.split()), 1, 0, 3, 0)
    assert got["2"] == (1, 2, len(second), len(second.split()), 0, 0, 0, 3)
    assert got["3"] == (0,) * 8


def test_fixed_format_and_run_label(spark):
    df = one_column(spark, [0.12345, 1.0], kind="double")
    assert evaluated(df, tx.fixed_3(F.col("t"))) == ["0.123", "1.000"]
    label = df.select(tx.run_label(F.lit("2024-02-03 04:05:06").cast("timestamp"))).first()[0]
    assert label == "20240203_040506"
    assert re.fullmatch(r"\d{8}_\d{6}", df.select(tx.run_label()).first()[0])
