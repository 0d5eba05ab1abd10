"""How often texts are read and shuffled, by the plans; with the results that must stay the same."""

import re
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from checks import queries as q
from lettermill.functions import text as tx
from lettermill.operators import features as ft
from lettermill.operators import profile as pf
from lettermill.operators import tfidf as ti
from lettermill.operators.preprocess import preprocess_letters
from lettermill.plans import inputs as inp


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def star(spark, path, orders, lines):
    schemas = {n: inp.SCHEMAS[n] for n in ("orders", "lineitem")}
    spark.createDataFrame([(k, None, None) for k in orders], schemas["orders"]).write.parquet(f"{path}/orders.parquet")
    rows = [(o, p, s, i, 0.0, 0.0, "R") for i, (o, p, s) in enumerate(lines)]
    spark.createDataFrame(rows, schemas["lineitem"]).write.parquet(f"{path}/lineitem.parquet")


def test_letters_take_one_shuffle_and_no_join(spark, tmp_path):
    star(spark, str(tmp_path), [1], [(1, 5, 6)])
    plan = inp.letters(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_letters_of_shared_missing_and_unknown_order_keys(spark, tmp_path):
    star(spark, str(tmp_path), [1, 1, 2, None], [(1, 5, 6), (1, 5, 6), (1, 7, None), (3, 1, 1), (None, 9, 9)])
    rows = inp.orders_with_codes(spark, str(tmp_path)).collect()
    found = sorted((r["o_orderkey"] or 0, len(r["codes"]), r["low"], r["high"]) for r in rows)
    assert found == [(0, 0, None, None), (1, 3, 5, 7), (1, 3, 5, 7), (2, 0, None, None)]
    assert inp.letters(spark, str(tmp_path)).where(F.col("guarantee_letter_text").isNull()).count() == 1  # no key, no choice


def test_filters_clean_a_text_once(spark):
    rows = [("a", "СОГАЗ  ждёт"), ("b", "Ингосстрах F10.11.12.1.100"), ("c", None)]
    letters = spark.createDataFrame(rows, "letter_id string, guarantee_letter_text string")
    # Not a local table, whose rows the planner would work out itself.
    letters = preprocess_letters(letters.repartition(2))
    for kept, ids in ((pf.rows_of_company(letters, "Согаз"), ["a"]), (pf.letters_with_codes(letters), ["b"])):
        assert kept.columns == letters.columns
        assert len(re.findall(r"regexp_replace\(trim", optimized(kept))) == 1
        assert [r["letter_id"] for r in kept.select("letter_id").collect()] == ids


def test_variants_are_looked_for_in_two_ranges(spark):
    points = spark.range(1, 0x10000).where(~F.col("id").between(0xD800, 0xDFFF)).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    found = points.where(F.col("c").rlike(tx.ANY_VARIANT)).collect()
    assert sorted(r["c"] for r in found) == sorted(tx.VARIANTS)


def test_ngrams_are_made_of_words_looked_up_once(spark):
    rows = spark.createDataFrame([("a b c a b x b",), ("",), (None,), ("b a",)], "t string").repartition(2)
    words = rows.select(F.split("t", " ").alias("words"))
    grams = ti._known_ngrams(words, "words", ["a b c", "b"], 1, 3, "grams")
    assert optimized(grams).count("transform(") == 1
    found = sorted(sorted(r["grams"] or []) for r in grams.collect())
    first = ["a", "a", "a b", "a b", "a b c", "b", "b", "b", "b c", "b c a", "c", "c a", "c a b"]
    assert found == [[], [], first, ["a", "b", "b a"]]


def test_letters_of_a_term_are_counted_once_each(spark):
    rows = spark.createDataFrame([("aa bb aa bb",), ("bb aa cc",), ("bb cc bb cc",)], "text_cleaned string").repartition(2)
    model = ti.fit_tfidf(rows, max_features=5, ngram_range=(1, 2))
    assert list(zip(model.terms, model.term_counts, model.document_counts)) == [
        ("bb", 5, 3), ("aa", 3, 2), ("cc", 3, 2), ("aa bb", 2, 1), ("bb aa", 2, 2)
    ]


def test_sections_that_are_written_read_the_letters_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = [(str(i), f"СОГАЗ  письмо {i}", i % 2) for i in range(20)]
    letters = spark.createDataFrame(rows, "letter_id string, guarantee_letter_text string, class int")
    monkeypatch.setattr(q, "prepared", lambda *_: preprocess_letters(letters.mapInPandas(counted, letters.schema)))
    assert q.write_analysis_json(spark, "").count() > 0
    assert read.value == 20


def test_words_of_a_document_are_found_and_hashed_once(spark, tmp_path):
    texts = ["Foo bar foo", "\u00a0 été_9 \n", "", None, " - ", "x yy", "foo"]
    docs = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, inp.SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (0, 1, 0), (0, 0, 0)], inp.SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    found = q.document_vectors(spark, str(tmp_path))
    plan = optimized(found)
    assert plan.count("regexp_extract_all") == 1 and "md5" not in plan and "Join" not in plan
    bucket = lambda w: int(md5(w.encode()).hexdigest()[:8], 16) % 128
    expected = []
    for i, words in enumerate((["foo", "bar", "foo"], ["été_9"], [], [], [], ["yy"], ["foo"])):
        counts = Counter(bucket(w) for w in words)
        expected += [(str(i), 128, b, round(n / sum(m * m for m in counts.values()) ** 0.5, 6)) for b, n in counts.items()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_buckets_of_small_batches_and_of_no_rows(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4))) for i in range(50)], "i int, t string").coalesce(1)
    hashed = lambda df: df.select("i", ft._buckets(10)(tx.tokens(F.col("t"))).alias("b"))
    assert hashed(rows.where("i < 0")).collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = hashed(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.i: r.b for r in found} == {i: [str(int(md5(f"w{j}".encode()).hexdigest()[:8], 16) % 10) for j in range(i % 4)] for i in range(50)}
