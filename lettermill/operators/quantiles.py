"""Five-number summaries from sketches that are saved per part and merged later.

A sketch is a binary column of a few kilobytes, whatever the number of letters behind it. Parts (days, sources, files)
are sketched once, saved with their counts, and any set of them is summarised without reading a letter again. Minimum
and maximum are exact; a quartile is a size that occurs, and its share of smaller letters is off by at most
`rank_error`. Sketches flip coins, so reruns may differ within that bound; `profile.size_quantiles` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items kept on a sketch's top level.
DETAIL = 800
SHARES = {"minimum": 0.0, "quartile_1": 0.25, "median": 0.5, "quartile_3": 0.75, "maximum": 1.0}


def rank_error(detail: int = DETAIL) -> float:
    """Bound on the error of a quantile's rank, as a share of all rows: twice the sketch's published error at 99 %.

    It is passed about once in 10**6 quantiles, however many parts were merged.
    """
    return 2 * 2.296 / detail**0.9021


def size_sketches(letters: DataFrame, *part: str, detail: int = DETAIL) -> DataFrame:
    """Count, least and greatest size, and sketch of length and words, by class and by the columns `part`.

    One aggregation, combined before the shuffle; letters without a class and sizes that are null have no part.
    """
    measures = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("size")) for c in ("text_length", "num_words")]
    )
    sizes = letters.where(F.col("class").isNotNull()).select(*part, "class", F.inline(measures)).where(F.col("size").isNotNull())
    return sizes.groupBy(*part, "class", "measure").agg(
        F.count("*").alias("n"),
        F.min("size").alias("minimum"),
        F.max("size").alias("maximum"),
        F.kll_sketch_agg_bigint("size", detail).alias("sketch"),
    )


def merged(sketches: DataFrame, *part: str, detail: int = DETAIL) -> DataFrame:
    """One row for each class, measure and value of the columns `part`, from all rows of sketches."""
    return sketches.groupBy(*part, "class", "measure").agg(
        F.sum("n").alias("n"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        F.kll_merge_agg_bigint("sketch", detail).alias("sketch"),
    )


def five_numbers(sketches: DataFrame) -> DataFrame:
    """The sketches replaced by the five numbers, bigints as the sizes are."""

    def at(name: str) -> Column:
        if name in ("minimum", "maximum"):
            return F.col(name)
        return F.kll_sketch_get_quantile_bigint("sketch", F.lit(SHARES[name])).alias(name)

    kept = [c for c in sketches.columns if c not in ("minimum", "maximum", "sketch")]
    return sketches.select(*kept, *[at(name) for name in SHARES])
