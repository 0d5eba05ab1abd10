import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lettermill.operators import ranking as rk
from tests.helpers import scattered


def values(kind):
    random = np.random.default_rng(3)
    if kind == "hot":
        return np.concatenate([np.zeros(2000), random.normal(size=1000)])
    if kind == "tied":
        return random.integers(0, 5, 3000).astype(float)
    return random.normal(size=3000)


@pytest.mark.parametrize("kind", ["hot", "tied", "smooth"])
def test_midranks_equal_pandas(spark, kind):
    data = pd.DataFrame({"v": values(kind)})
    ranked = rk.midranks(spark.createDataFrame(data), "v").toPandas().set_index("v")
    expected = data.assign(rank=data.v.rank()).drop_duplicates().set_index("v")["rank"]
    assert len(ranked) == len(expected)
    assert (ranked["midrank"].reindex(expected.index) == expected).all()


def test_running_sums_of_empty_and_single_values(spark):
    empty = spark.createDataFrame([], "v double")
    assert rk.midranks(empty, "v").count() == 0
    single = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert rk.midranks(single, "v").select("n", "midrank").collect() == [(2, 1.5)]


def test_folds_are_stratified_and_stable(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("letter_id"), (F.col("id") % 10 == 0).cast("int").alias("class")
    )
    folds = rk.stratified_folds(df)
    sizes = folds.groupBy("class").pivot("fold").count().toPandas().set_index("class")
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    assert folds.count() == 5000
    again = rk.stratified_folds(scattered(df, 7))
    assert folds.exceptAll(again.select(folds.columns)).count() == 0


def test_folds_follow_the_global_order(spark):
    """The same folds as one sort per class would give."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("letter_id"), F.lit(1).alias("class"))
    got = rk.stratified_folds(df).toPandas().set_index("letter_id")["fold"]
    keyed = df.withColumn("k", rk.shuffle_key(42, F.col("letter_id"))).toPandas().sort_values(["k", "letter_id"])
    assert [got[i] for i in keyed.letter_id] == [i % 5 for i in range(3000)]
