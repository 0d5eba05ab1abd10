"""Counts of many phrases beside those of one expression for each."""

import random

import pytest

from lettermill.domain import Domain
from lettermill.operators import phrases as ph
from lettermill.operators import profile as pf
from tests.helpers import rows

KEYWORD = ("keyword", "list_class", "count", "class_0_count", "class_1_count")


def _letters(spark, n=80):
    draw = random.Random(2)
    syllables = ["ab", "Ba", "АБ", "аб", " ", "a", "б", ", ", "ſ", "K"]
    texts = ["".join(draw.choice(syllables) for _ in range(draw.randrange(0, 30))) for _ in range(n)]
    data = [(str(i), t, (0, 1, None)[i % 3]) for i, t in enumerate(texts)] + [("null", None, 0)]
    return spark.createDataFrame(data, "letter_id string, text_cleaned string, class int").repartition(3)


def _lists(seed=4, n=60):
    draw = random.Random(seed)
    made = {"".join(draw.choice("abAаБ ,k") for _ in range(draw.randrange(1, 5))) for _ in range(n)}
    made = sorted(made)
    return made[::2], made[1::2]


def test_equals_one_expression_for_each_phrase(spark):
    zero, one = _lists()
    domain = Domain(class_0_phrases=tuple(zero), class_1_phrases=tuple(one))
    want = rows(pf.keyword_counts(_letters(spark), domain).select(*KEYWORD), "keyword", "list_class")
    phrases = spark.createDataFrame([(p, 0) for p in zero] + [(p, 1) for p in one], "keyword string, list_class int")
    assert rows(ph.keyword_counts(_letters(spark), phrases).select(*KEYWORD), "keyword", "list_class") == want
    assert any(r[2] for r in want) and any(r[3] != r[4] for r in want)


def test_overlapping_empty_null_and_repeated_phrases(spark):
    letters = spark.createDataFrame([("1", "ababab xaba", 1), ("2", "", 0), ("3", None, 1)], "letter_id string, text_cleaned string, class int")
    listed = [("aba", 0), ("ab", 1), ("BAB", 1), ("ab", 1), ("", 0), (None, 1), ("zz", 0)]
    phrases = spark.createDataFrame(listed, "keyword string, list_class int")
    found = {r.keyword: (r["count"], r.class_0_count, r.class_1_count) for r in ph.keyword_counts(letters, phrases).collect()}
    assert found == {"aba": (1, 0, 1), "ab": (1, 0, 1), "BAB": (1, 0, 1), "": (2, 1, 1), "zz": (0, 0, 0)}
    assert ph.keyword_counts(letters, phrases.limit(0)).count() == 0
    assert {r["count"] for r in ph.keyword_counts(letters.limit(0), phrases).collect()} == {0}
    assert ph.keyword_counts(letters.drop("class"), phrases).where("class_1_count > 0").count() == 0


def test_thousands_of_phrases_make_one_scan(spark):
    letters = _letters(spark)
    phrases = spark.createDataFrame([(f"phrase {i}", i % 2) for i in range(5000)], "keyword string, list_class int")
    counts = ph.keyword_counts(letters, phrases)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and counts.count() == 5000


def test_too_many_characters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ph, "MOST_CHARS", 10)
    with pytest.raises(ValueError):
        ph.keyword_counts(_letters(spark), spark.createDataFrame([("a long phrase", 0)], "keyword string, list_class int"))
