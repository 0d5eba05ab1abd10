import pytest
from pyspark.sql import functions as F

from lettermill.operators import storage
from lettermill.operators import termspace as ts
from lettermill.operators import tfidf as ti
from lettermill.operators.preprocess import preprocess_letters
from lettermill.plans import analysis


def kept_now(spark):
    """Batches and memory and disk bytes of what is kept."""
    spark.sparkContext._jvm.System.gc()
    ids = {r for r in spark.sparkContext._jsc.getPersistentRDDs()}
    infos = {i.id(): i for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    return {r: (spark.sparkContext._jsc.getPersistentRDDs()[r].count(), infos[r].memSize(), infos[r].diskSize()) for r in ids if r in infos}


def letters(spark, n=3000):
    rows = spark.range(0, n, 1, 2).select(F.col("id").cast("string").alias("letter_id"), F.expr("concat('the word w', id % 50, ' w', id % 7)").alias("guarantee_letter_text"), (F.col("id") % 2).cast("int").alias("class"))
    return preprocess_letters(rows)


def test_rows_are_kept_on_disk_in_small_batches(spark):
    rows = spark.range(0, 3000, 1, 2).withColumn("text", F.expr("repeat('w', 100)"))
    before, setting = set(kept_now(spark)), spark.conf.get(storage.BATCH, None)
    kept, n = storage.stored(rows)
    (found,) = [v for k, v in kept_now(spark).items() if k not in before]
    assert n == 3000 and found[0] == 2 * -(-1500 // storage.BATCH_ROWS) and found[1] == 0 and found[2] > 0
    assert spark.conf.get(storage.BATCH, None) == setting
    assert kept.agg(F.sum("id")).first()[0] == sum(range(3000))
    kept.unpersist(True)


def test_the_setting_comes_back_when_the_rows_cannot_be_made(spark):
    spark.conf.set(storage.BATCH, "777")
    try:
        with pytest.raises(Exception, match="no such row"):
            storage.stored(spark.range(3).select(F.raise_error(F.lit("no such row")).alias("a")))
        assert spark.conf.get(storage.BATCH) == "777"
    finally:
        spark.conf.unset(storage.BATCH)
        spark.catalog.clearCache()


@pytest.mark.parametrize("fit", ["vocabulary", "space"])
def test_fits_keep_nothing_in_memory(spark, monkeypatch, fit):
    rows, seen, before = letters(spark), [], set(kept_now(spark))
    model = ti.fit_tfidf(rows, 20, (1, 1))
    module, name = (ti, "_vocabulary") if fit == "vocabulary" else (ts, "gram_product")
    own = getattr(module, name)

    def watched(*given):
        seen.append([v for k, v in kept_now(spark).items() if k not in before])
        return own(*given)

    monkeypatch.setattr(module, name, watched)
    again = ti.fit_tfidf(rows, 20, (1, 1)) if fit == "vocabulary" else ts.fit_term_space(rows, model, 4).model
    assert again == model
    ((batches, memory, disk),) = seen[0]
    assert batches >= 3000 / storage.BATCH_ROWS and memory == 0 and disk > 0


def test_the_analysis_keeps_letters_in_small_batches(spark):
    raw = letters(spark).select("letter_id", "guarantee_letter_text", "class")
    before = set(kept_now(spark))
    train, _, _ = analysis.load_and_analyze(raw, raw, keep=True)
    ((batches, memory, disk),) = [v for k, v in kept_now(spark).items() if k not in before]
    assert batches >= 3000 / storage.BATCH_ROWS and memory == 0 and disk > 0
    train.unpersist(True)
