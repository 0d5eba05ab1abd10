"""Paired tests between two score columns.

The statistics are Spark aggregates. Only the p-value, taken once from the one
row they leave, needs functions that SQL lacks.
"""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lettermill.operators.ranking import midranks

# The p-value functions travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Differences equal at this many decimals share a rank.
DIFFERENCE_DECIMALS = 12
#: Differences up to which the distribution of tied signed ranks is worked out: its table has their square of places.
EXACT_DIFFERENCES = 1_000


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + step * d) or tiny)
        c = (1.0 + step / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15 and i > 0:
            break
    return front * (value - 1.0)


def t_two_sided(t: float, df: float) -> float:
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def signed_rank_exact(statistic: float, n: int) -> float:
    """Two-sided p of a signed-rank statistic without ties, for small n."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)


def signed_rank_ties_exact(statistic: float, ranks: list[tuple[int, int]]) -> float:
    """Two-sided p of the smaller rank sum, every sign being as likely; ranks: (twice a mean rank, how often).

    Doubled mean ranks are whole numbers, so the distribution of the sum is a table that each rank folds once.
    """
    chances = np.ones(1)
    for doubled, times in ranks:
        for _ in range(times):
            longer = np.zeros(len(chances) + doubled)
            longer[: len(chances)] += chances / 2
            longer[doubled:] += chances / 2
            chances = longer
    return min(1.0, 2 * float(chances[: round(2 * statistic) + 1].sum()))


def _log_half_binomial(k: int, n: int) -> float:
    """Logarithm of the chance of k in n even throws, without the cancellation of large factorials."""
    if k == 0 or k == n:
        return -n * math.log(2)

    def rest(m: int) -> float:  # ln m! beyond Stirling's formula
        if m < 30:
            return math.lgamma(m + 1) - (m + 0.5) * math.log(m) + m - 0.5 * math.log(2 * math.pi)
        return (1 - (1 - 2 / (7 * m * m)) / (30 * m * m)) / (12 * m)

    tilt = (n - 2 * k) / n
    bend = (1 - tilt) * math.log1p(-tilt) + (1 + tilt) * math.log1p(tilt)
    return rest(n) - rest(k) - rest(n - k) - 0.5 * math.log(2 * math.pi * k * ((n - k) / n)) - 0.5 * n * bend


def even_binomial_two_sided(k: int, n: int) -> float:
    """Two-sided p of k or n - k in n even throws."""
    k = min(k, n - k)
    if 2 * k >= n - 1:
        return 1.0
    total, term, place = 0.0, 1.0, k
    while place >= 0 and term > 1e-18 * total:
        # A chunk of the falling terms, each relative to that of k.
        places = np.arange(place, max(-1, place - 4096), -1, dtype="float64")
        ratios = np.cumprod(places / (n - places + 1)) * term
        total += term + float(ratios[:-1].sum())
        term, place = float(ratios[-1]), place - len(places)
    return min(1.0, 2 * total * math.exp(_log_half_binomial(k, n)))


@F.pandas_udf(DoubleType())
def _tied_signed_rank_p(statistic: pd.Series, ranks: pd.Series, exact: pd.Series) -> pd.Series:
    out = [
        signed_rank_ties_exact(w, sorted((r["doubled"], r["n"]) for r in rows)) if known else None
        for w, rows, known in zip(statistic, ranks, exact)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _even_binomial_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([even_binomial_two_sided(int(x), int(x + y)) for x, y in zip(b, c)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi_square_p(statistic: pd.Series) -> pd.Series:
    """One degree of freedom."""
    return pd.Series([None if pd.isna(s) else math.erfc(math.sqrt(s / 2)) for s in statistic], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else t_two_sided(a, b - 1) for a, b in zip(t, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def _signed_rank_p(w: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
    out = []
    for stat, score, count, small in zip(w, z, n, exact):
        if small:
            out.append(signed_rank_exact(stat, int(count)))
        else:
            out.append(None if pd.isna(score) else math.erfc(abs(score) / math.sqrt(2)))
    return pd.Series(out, dtype="float64")


def _finish(df: DataFrame, test: str) -> DataFrame:
    return df.withColumns({"significant": F.col("p_value") < 0.05, "test_type": F.lit(test)})


def paired_t(pairs: DataFrame, test: str = "paired_t") -> DataFrame:
    stats = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(F.col("a") - F.col("b")).alias("mean_difference"),
        F.stddev_samp(F.col("a") - F.col("b")).alias("sd"),
    )
    statistic = F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    with_stat = stats.withColumn("statistic", statistic)
    return _finish(with_stat.select("n", "statistic", _t_p("statistic", "n").alias("p_value")), test)


def difference_midranks(pairs: DataFrame) -> DataFrame:
    """Distinct absolute differences, zeros dropped, with counts and mean ranks."""
    difference = F.round(F.col("a") - F.col("b"), DIFFERENCE_DECIMALS)
    signed = pairs.select(difference.alias("difference")).where(F.col("difference") != 0)
    sized = signed.withColumn("size", F.abs("difference"))
    return midranks(sized, "size", {"positive": F.count_if(F.col("difference") > 0)})


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test: exact for up to 50 untied differences, else normal."""
    ranked = difference_midranks(pairs)
    n, ties = F.col("n").cast("double"), F.col("tie_sum")
    sums = ranked.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("positive") * F.col("midrank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("positive")) * F.col("midrank")).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("tie_sum"),
    )
    # One row each: the pairs that were compared, and the ranked ones.
    zeros = pairs.agg(F.count_if(F.round(F.col("a") - F.col("b"), DIFFERENCE_DECIMALS) == 0).alias("zeros"))
    one_row = F.lit(1).alias("one")
    joined = sums.select("*", one_row).join(F.broadcast(zeros.select("*", one_row)), "one")
    statistic = F.least("w_plus", "w_minus")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    ready = joined.withColumns(
        {
            "statistic": statistic,
            "z": F.when(spread > 0, (statistic - n * (n + 1) / 4) / spread),
            "exact": (F.col("n") <= 50) & (ties == 0) & (F.col("zeros") == 0),
        }
    )
    p = _signed_rank_p("statistic", "z", "n", "exact").alias("p_value")
    return _finish(ready.select("n", "zeros", "w_plus", "w_minus", "statistic", p), "wilcoxon")


def wilcoxon_exact(pairs: DataFrame, most: int = EXACT_DIFFERENCES) -> DataFrame:
    """Signed-rank test by the distribution of the ranks as they are, ties included; zero differences are dropped.

    Beyond `most` differences p is that of `wilcoxon`, which is the normal one, and `exact` is false. Without any
    difference p is 1. Only the ranks below `most` are gathered, so their number is bounded.
    """
    ranked = difference_midranks(pairs)
    rank = F.struct((2 * F.col("midrank")).cast("bigint").alias("doubled"), F.col("n").alias("n"))
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("positive") * F.col("midrank")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum((F.col("n") - F.col("positive")) * F.col("midrank")), F.lit(0.0)).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"),
        F.collect_list(F.when(F.col("n_before") < most, rank)).alias("ranks"),
    )
    n, statistic, exact = F.col("n").cast("double"), F.least("w_plus", "w_minus"), F.col("n") <= most
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.when(spread > 0, (statistic - n * (n + 1) / 4) / spread)
    ready = sums.select("n", "w_plus", "w_minus", statistic.alias("statistic"), "ranks", exact.alias("exact"), (z * z).alias("z2"))
    p = F.coalesce(_tied_signed_rank_p("statistic", "ranks", "exact"), _chi_square_p("z2")).alias("p_value")
    return _finish(ready.select("n", "w_plus", "w_minus", "statistic", "exact", p), "wilcoxon_exact")


def mcnemar_p(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """McNemar's counts, statistic and p-values (chi-square and exact) for each group; rows with a null have no part."""
    right_p, right_q = F.col("p") == F.col("y"), F.col("q") == F.col("y")
    counts = predictions.groupBy(*by).agg(
        F.count_if(right_p & ~right_q).alias("only_first"), F.count_if(~right_p & right_q).alias("only_second")
    )
    b, c = F.col("only_first").cast("double"), F.col("only_second").cast("double")
    tested = counts.withColumn("statistic", F.when(b + c > 0, (b - c) * (b - c) / (b + c)))
    return tested.withColumns(
        {"p_chi_square": _chi_square_p("statistic"), "p_value": _even_binomial_p("only_first", "only_second")}
    ).withColumn("significant", F.col("p_value") < 0.05)


def mcnemar(predictions: DataFrame) -> DataFrame:
    """(b-c)^2/(b+c) over the cases only one of two predictions (p, q) gets right."""
    right_p, right_q = F.col("p") == F.col("y"), F.col("q") == F.col("y")
    counts = predictions.agg(
        F.count_if(right_p & ~right_q).alias("only_first"), F.count_if(~right_p & right_q).alias("only_second")
    )
    b, c = F.col("only_first").cast("double"), F.col("only_second").cast("double")
    return counts.select("only_first", "only_second", F.when(b + c > 0, (b - c) * (b - c) / (b + c)).alias("statistic"))


def significance(pairs: DataFrame, test: str = "paired_t") -> DataFrame:
    """Statistic, p-value and verdict; an unknown test falls back to the paired t."""
    if test == "wilcoxon":
        return wilcoxon(pairs).select("n", "statistic", "p_value", "significant", "test_type")
    if test != "paired_t":
        warnings.warn(f"unknown test {test!r}: using the paired t-test", stacklevel=2)
    return paired_t(pairs, test)
