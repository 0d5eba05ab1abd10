import json
import re

import pytest
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT
from lettermill.operators import requests as rq
from lettermill.operators import synth as sy
from lettermill.sources import results as sink
from tests.helpers import letters, scattered

CODE = re.compile(DEFAULT.code_pattern)


@pytest.fixture(scope="module")
def real(spark):
    return letters(spark, [(str(i), "text", int(i % 4 > 0)) for i in range(162)]).persist()


@pytest.mark.parametrize("target", [100, 162, 163, 200, 500])
def test_ratio_preserving_sizes_sum_exactly(real, target):
    made = sy.ratio_preserving_set(real, target).collect()
    missing = max(0, target - 162)
    assert len(made) == missing
    zero = sum(r["class"] == 0 for r in made)
    assert zero == int(missing * (41 / 162))
    assert len({r.letter_id for r in made}) == missing


def test_letters_of_either_class(real):
    for row in sy.ratio_preserving_set(real, 1162).collect():
        codes = CODE.findall(row.guarantee_letter_text)
        assert (1 <= len(codes) <= 5) if row["class"] == 1 else not codes
        assert "{" not in row.guarantee_letter_text
        assert row.guarantee_letter_text.split("\n")[0] in DEFAULT.template_companies


def test_choices_reach_every_option(real):
    made = sy.ratio_preserving_set(real, 3162).where("class = 0").toPandas().guarantee_letter_text
    for service in DEFAULT.services:
        assert made.str.contains(service, regex=False).any()


@pytest.mark.parametrize("ratio, expected", [(0.5, 80), (0.25, 0), (0.6, 140)])
def test_balancing(spark, ratio, expected):
    df = letters(spark, [(str(i), "t", int(i < 120)) for i in range(160)])
    made = sy.balancing_set(df, ratio)
    assert made.count() == expected == max(0, int(120 * ratio / (1 - ratio)) - 40)
    assert made.where("class <> 0 OR letter_id NOT LIKE 'balance_0_%'").count() == 0


def test_balancing_rejects_bad_ratios_and_empty_input(real):
    with pytest.raises(ValueError):
        sy.balancing_set(real, 1.0)
    assert sy.balancing_set(real.where("false")).count() == 0


def test_truncating_split_can_fall_short():
    assert sy.split_size(50, (162, 44, 118), "truncate") == {0: 13, 1: 36}
    assert sy.split_size(50, (162, 44, 118)) == {0: 13, 1: 37}
    with pytest.raises(ValueError):
        sy.split_size(1, (1, 1, 0), "up")


def test_generation_is_reproducible_and_seeded(real):
    a, b = sy.ratio_preserving_set(real, 400), sy.ratio_preserving_set(scattered(real, 5), 400)
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(sy.ratio_preserving_set(real, 400, seed=7)).count() > 100


def test_code_counts_and_prefixes(spark):
    df = spark.range(500)
    fixed = df.select(sy.service_codes(F.col("id"), count=3).alias("c")).collect()
    assert all(len(r.c) == 3 and all(CODE.fullmatch(c) for c in r.c) for r in fixed)
    assert df.select(sy.service_codes(F.col("id"), count=0).alias("c")).first().c == []
    prefixed = df.select(sy.service_codes(F.col("id"), prefixes=DEFAULT.request_code_prefixes, most=4).alias("c")).collect()
    assert {len(r.c) for r in prefixed} == {1, 2, 3, 4}
    assert {c[:3] for r in prefixed for c in r.c} == set(DEFAULT.request_code_prefixes)


def test_shuffle_is_a_permutation(real):
    order = [r.letter_id for r in sy.seeded_shuffle(real).collect()]
    assert sorted(order) == sorted(r.letter_id for r in real.collect())
    assert order == [r.letter_id for r in sy.seeded_shuffle(scattered(real, 3)).collect()]
    assert order != [r.letter_id for r in sy.seeded_shuffle(real, 1).collect()]


def test_append(real):
    made = sy.ratio_preserving_set(real, 200)
    both = sy.append_synthetic(real.withColumn("extra", F.lit(1)), made)
    assert both.count() == 200 and both.where("origin = 'synthetic' AND extra IS NULL").count() == 38
    projected = sy.append_projected(real, made)
    assert projected.columns == real.columns and projected.where("letter_id IS NULL").count() == 38


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = letters(spark, [("1", 'СОГАЗ\n\nписьмо "в кавычках", да', 1), ("2", "a\\b", 0)])
    sink.write_letters_csv(df, str(tmp_path / "letters"))
    back = sink.read_letters_csv(spark, str(tmp_path / "letters"), sy.SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_responses_and_fallbacks(spark):
    answers = spark.createDataFrame(
        [
            ("0_0", '{"letter_text": "письмо", "quality_score": 0.9, "reasoning": "r"}'),
            ("0_1", '{"letter_text": "нет оценки", "reasoning": "r"}'),
            ("1_0", "{broken"),
        ],
        "request_id string, response string",
    )
    made = {r.letter_id: r for r in rq.generated_set(rq.generation_requests(spark, {0: 2, 1: 2}), answers).collect()}
    assert set(made) == {"synthetic_llm_0_0", "fallback_0_1", "fallback_1_0", "fallback_1_1"}
    assert made["synthetic_llm_0_0"].quality_score == 0.9
    for name in ("fallback_0_1", "fallback_1_0"):
        row = made[name]
        assert (row.quality_score, row.generation_method) == (0.8, "fallback")
        assert bool(CODE.search(row.guarantee_letter_text)) == (row["class"] == 1)
    assert rq.generated_set(rq.generation_requests(spark, {}), None).count() == 0


def test_requests_name_their_codes(spark):
    for row in rq.generation_requests(spark, {0: 20, 1: 20}).collect():
        assert row.company in row.user_prompt and "{" not in row.user_prompt
        assert (row.service_codes is None) == (row["class"] == 0)
        assert all(c in row.user_prompt for c in row.service_codes or [])


def test_generation_quality(spark):
    df = spark.createDataFrame(
        [(0, "без кодов", 0.5), (1, "F10.11.12.3.456", 0.7), (1, "нет", 0.9), (1, "F10.11.12.3.456", 0.9)],
        "class int, guarantee_letter_text string, quality_score double",
    )
    row = rq.generation_quality(df).first()
    assert (row.total_samples, row.min_quality_score, row.class_balance) == (4, 0.5, 0.25)
    assert row.class_1_code_presence == pytest.approx(2 / 3) and row.class_0_no_codes == 1.0
    assert rq.generation_quality(df.where("false")).count() == 0


def test_the_last_complete_response_of_a_request_wins(spark):
    import itertools

    whole = lambda text: json.dumps({"letter_text": text, "quality_score": 0.9, "reasoning": "r"})
    schema = "request_id string, response string, received int"
    parts = [
        [("a", whole("first"), 1), ("b", "{broken", 1), ("c", None, 1)],
        [("a", whole("second"), 2), ("b", whole("retried"), 2), ("b", whole("retried"), 2)],
        [("a", "{late and broken", 3), ("b", None, 4), ("c", "{broken", 2), (None, whole("lost"), 1), ("d", whole("x"), 1), ("d", whole("y"), 1)],
    ]
    want = {("a", whole("second")), ("b", whole("retried")), ("c", "{broken"), ("d", whole("y"))}
    frames = [spark.createDataFrame(p, schema) for p in parts]
    for order in itertools.permutations(frames):
        once = rq.merge_responses(*order)
        stepwise = rq.merge_responses(rq.merge_responses(order[0], order[1]), order[2])
        assert {(r.request_id, r.response) for r in once.collect()} == want
        assert {tuple(r) for r in once.collect()} == {tuple(r) for r in stepwise.collect()}
    asked = rq.add_requests(spark.createDataFrame([("a", 0), ("b", 1), ("e", 1)], "request_id string, class int"))
    repeated = frames[0].unionByName(frames[1]).unionByName(frames[2]).drop("received")
    made = rq.generated_set(asked, repeated).collect()
    assert sorted(r.letter_id for r in made) == ["fallback_e", "synthetic_llm_a", "synthetic_llm_b"]
