"""Ranks and running sums over a whole table without one sorting task.

A window without partitions moves every row to one task. Here the values are
first counted, then cut into ranges of similar weight; a window runs inside
each range, and the totals of the ranges before it are added. The ranges come
from an approximate quantile sketch, which decides only how evenly the work is
spread: the result is exact for any cut.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.picks import shuffle_key


def _ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Inner borders between ranges: at most `ranges` numbers reach the driver."""
    points = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(column), points, 10 * ranges).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def running_sums(df: DataFrame, column: str, sums: dict[str, Column]) -> DataFrame:
    """Per distinct value: the sums at it (`name`) and before it (`name_before`).

    `column` is a double; rows where it is null are left out.
    """
    present = df.where(F.col(column).isNotNull())
    cuts = _cuts(present, column, _ranges(df))
    tallies = present.groupBy(column).agg(*[value.alias(name) for name, value in sums.items()])
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")],
        inputCol=column,
        outputCol="range",
    )
    placed = bucketizer.transform(tallies)

    inside = Window.partitionBy("range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"{n}_inside": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums})

    # Totals per range come from the same tallies, so the rows are counted once. The window without partitions and
    # the broadcast are bounded by the number of ranges.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("range")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums])
    )
    joined = local.join(F.broadcast(offsets), "range")
    return joined.select(
        column,
        *sums,
        *[(F.col(f"{n}_inside") + F.col(f"{n}_offset")).alias(f"{n}_before") for n in sums],
    )


def midranks(df: DataFrame, column: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct value its number of rows `n` and mean rank `midrank`."""
    ranked = running_sums(df, column, {"n": F.count("*"), **(sums or {})})
    return ranked.withColumn("midrank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def stratified_folds(
    df: DataFrame, folds: int = 5, seed: int = 42, key: str = "letter_id", label: str = "class"
) -> DataFrame:
    """Deal the rows of each class to folds in the order of a hash of the key.

    The fold follows from the row's position within its class. A class may hold
    most rows, so its order is cut into 4,096 ranges of the (uniform) hash, and
    only (class, range) counts are shared between tasks.
    """
    keyed = df.withColumn("shuffle_key", shuffle_key(seed, F.col(key)))
    keyed = keyed.withColumn("hash_range", F.substring("shuffle_key", 1, 3))
    within = Window.partitionBy(label, "hash_range").orderBy("shuffle_key", key)
    earlier = Window.partitionBy(label).orderBy("hash_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(label, "hash_range")
        .agg(F.count("*").alias("n"))
        .select(label, "hash_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    )
    positions = keyed.withColumn("position", F.row_number().over(within))
    # At most 4,096 rows per class.
    joined = positions.join(F.broadcast(offsets), [label, "hash_range"])
    fold = F.pmod(F.col("rows_before") + F.col("position") - 1, F.lit(folds)).cast("int")
    return joined.withColumn("fold", fold).drop("shuffle_key", "hash_range", "position", "rows_before")
