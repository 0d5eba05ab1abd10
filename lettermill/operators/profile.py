"""Data quality, class, company, code and keyword statistics.

All of these are hash aggregations with map-side partial results, so a class
or company that holds most of the rows costs no more than a small one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.functions import text

TEXT = "guarantee_letter_text"


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


# --- filters -----------------------------------------------------------------


def _where(letters: DataFrame, condition: Column) -> DataFrame:
    """Letters for which a condition on what is read off their texts holds.

    A plain filter is moved below the columns it names and works them out a second time, the cleaned text once for each
    use of it; the planner moves nothing below an explode.
    """
    return letters.select("*", F.explode_outer(F.array(condition)).alias("_holds")).where(F.col("_holds")).drop("_holds")


def rows_of_class(letters: DataFrame, label: int) -> DataFrame:
    return letters.where(F.col("class") == label)


def rows_of_company(letters: DataFrame, name: str) -> DataFrame:
    return _where(letters, F.col("insurance_company") == name)


def letters_with_codes(letters: DataFrame) -> DataFrame:
    return _where(letters, F.col("num_service_codes") > 0)


def missing_or_empty(letters: DataFrame) -> DataFrame:
    """Letters without text, told apart by `problem`."""
    problem = F.when(F.col(TEXT).isNull(), "missing").when(F.col(TEXT) == "", "empty")
    return letters.withColumn("problem", problem).where(F.col("problem").isNotNull())


def label_contradictions(letters: DataFrame) -> DataFrame:
    """Class 1 without codes, and class 0 with codes."""
    coded = F.col("has_service_codes")
    problem = F.when((F.col("class") == 1) & ~coded, "class_1_without_codes").when(
        (F.col("class") == 0) & coded, "class_0_with_codes"
    )
    return letters.withColumn("problem", problem).where(F.col("problem").isNotNull())


# --- counts ------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(column))


def counts_by_value(df: DataFrame, column: str) -> DataFrame:
    """The same counts, ordered by the value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(column)


def class_shares(letters: DataFrame) -> DataFrame:
    """Counts and percentages of both classes, and count 0 / count 1."""
    zero, one = F.count_if(F.col("class") == 0), F.count_if(F.col("class") == 1)
    counted = letters.agg(F.count("*").alias("total"), zero.alias("class_0"), one.alias("class_1"))
    return counted.select(
        "*",
        F.expr("try_divide(class_0 * 100.0D, total)").alias("class_0_percent"),
        F.expr("try_divide(class_1 * 100.0D, total)").alias("class_1_percent"),
        F.expr("try_divide(cast(class_0 as double), class_1)").alias("imbalance_ratio"),
    )


def class_distribution(df: DataFrame, column: str = "class") -> DataFrame:
    """Count and percentage per class: the data of a bar or pie chart."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    # The un-partitioned window sees one row per class.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(column, "count", (F.col("count") * F.lit(100.0) / total).alias("percent")).orderBy(column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


# --- quality -----------------------------------------------------------------


def data_quality(letters: DataFrame) -> DataFrame:
    """One record of counts and means; columns that are absent give nulls."""
    present = set(letters.columns)
    coded = F.col("has_service_codes")
    out = [
        F.count("*").alias("total_samples"),
        F.count_if(F.col(TEXT).isNull()).alias("missing_texts"),
        F.count_if(F.col(TEXT) == "").alias("empty_texts"),
        (F.avg("text_length") if "text_length" in present else F.lit(None).cast("double")).alias("avg_text_length"),
        (F.avg("num_words") if "num_words" in present else F.lit(None).cast("double")).alias("avg_words"),
    ]
    if {"class", "has_service_codes"} <= present:
        uncoded_1 = F.count_if((F.col("class") == 1) & ~coded)
        coded_0 = F.count_if((F.col("class") == 0) & coded)
        out += [
            uncoded_1.alias("class_1_without_codes"),
            coded_0.alias("class_0_with_codes"),
            (uncoded_1 + coded_0).alias("potential_labeling_errors"),
        ]
    return letters.agg(*out)


# --- class and company sections ----------------------------------------------


def general_statistics(letters: DataFrame) -> DataFrame:
    """Sample count and mean sizes; `scope` is "overall" or a class."""
    totals = letters.rollup("class").agg(
        F.grouping("class").alias("is_overall"),
        F.count("*").alias("sample_count"),
        F.avg("text_length").alias("avg_text_length"),
        F.avg("num_words").alias("avg_words"),
    )
    scope = F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("class").cast("string"))
    return totals.select(scope.alias("scope"), "sample_count", "avg_text_length", "avg_words").where(
        F.col("scope").isNotNull()
    )


def class_profile(letters: DataFrame) -> DataFrame:
    present = set(letters.columns)
    out = [F.count("*").alias("sample_count")]
    if "has_service_codes" in present:
        out.append(_share(F.col("has_service_codes")).alias("has_service_codes_ratio"))
    if "num_service_codes" in present:
        out.append(F.avg("num_service_codes").alias("avg_service_codes"))
    out += [
        F.avg("text_length").alias("length_mean"),
        F.stddev_samp("text_length").alias("length_std"),
        F.min("text_length").alias("length_min"),
        F.max("text_length").alias("length_max"),
    ]
    return letters.where(F.col("class").isNotNull()).groupBy("class").agg(*out)


def class_company_counts(letters: DataFrame) -> DataFrame:
    """Letters by class and company."""
    return letters.where(F.col("class").isNotNull()).groupBy("class", "insurance_company").agg(F.count("*").alias("count"))


def class_differences(letters: DataFrame) -> DataFrame:
    """Code share of either class and length of class 1 minus class 0.

    No row unless exactly two classes occur.
    """
    zero, one = F.col("class") == 0, F.col("class") == 1
    coded = F.col("has_service_codes").cast("double")
    length = F.col("text_length")
    stats = letters.agg(
        F.min("class").alias("lowest"),
        F.max("class").alias("highest"),
        F.count_if(F.col("class").isNotNull() & ~F.col("class").isin(0, 1)).alias("others"),
        F.avg(F.when(zero, coded)).alias("class_0_with_codes"),
        F.avg(F.when(one, coded)).alias("class_1_with_codes"),
        (F.avg(F.when(one, length)) - F.avg(F.when(zero, length))).alias("text_length_difference"),
    )
    two = (F.col("lowest") == 0) & (F.col("highest") == 1) & (F.col("others") == 0)
    return stats.where(two).select("class_0_with_codes", "class_1_with_codes", "text_length_difference")


def company_profile(letters: DataFrame) -> DataFrame:
    return letters.groupBy("insurance_company").agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("class") == 0).alias("class_0"),
        F.count_if(F.col("class") == 1).alias("class_1"),
        F.avg("text_length").alias("avg_text_length"),
        _share(F.col("has_service_codes")).alias("has_service_codes_ratio"),
    )


def size_quantiles(letters: DataFrame) -> DataFrame:
    """Exact five-number summaries of length and words by class.

    Rows are first counted per (class, size), so the percentile sees each size
    once, with its frequency: its state grows with the number of different
    sizes and not with the letters.
    """
    sizes = letters.where(F.col("class").isNotNull()).select(
        "class",
        F.explode(
            F.array(
                F.struct(F.lit("text_length").alias("measure"), F.col("text_length").alias("size")),
                F.struct(F.lit("num_words").alias("measure"), F.col("num_words").alias("size")),
            )
        ).alias("m"),
    )
    counted = sizes.groupBy("class", "m.measure", "m.size").agg(F.count("*").alias("n"))
    five = F.percentile("size", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("n")).alias("q")
    return (
        counted.groupBy("class", "measure")
        .agg(five)
        .select(
            "class",
            "measure",
            F.get("q", F.lit(0)).alias("minimum"),
            F.get("q", F.lit(1)).alias("quartile_1"),
            F.get("q", F.lit(2)).alias("median"),
            F.get("q", F.lit(3)).alias("quartile_3"),
            F.get("q", F.lit(4)).alias("maximum"),
        )
    )


# --- codes ---------------------------------------------------------------------


def exploded_codes(letters: DataFrame) -> DataFrame:
    """One row per code occurrence."""
    keep = [c for c in ("class",) if c in letters.columns]
    return text.exploded(letters, keep, F.col("service_codes_list"), "code")


def code_statistics(letters: DataFrame) -> DataFrame:
    # Counting per code first makes the distinct count a plain row count.
    per_code = exploded_codes(letters).groupBy("code").agg(F.count("*").alias("n"))
    return per_code.agg(
        F.count("*").alias("total_unique_codes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_code_occurrences"),
    )


def top_codes(letters: DataFrame, k: int = 10) -> DataFrame:
    counts = exploded_codes(letters).groupBy("code").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("code")).limit(k)


def top_prefixes(letters: DataFrame, k: int = 10, domain: Domain = DEFAULT) -> DataFrame:
    codes = exploded_codes(letters).where(F.length("code") >= domain.prefix_length)
    counts = codes.groupBy(text.code_prefix(F.col("code"), domain).alias("prefix")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("prefix")).limit(k)


def codes_per_letter(letters: DataFrame) -> DataFrame:
    n = F.col("num_service_codes")
    return letters.agg(
        F.count_if(n > 0).alias("letters_with_codes"),
        F.avg(F.when(n > 0, n)).alias("mean_codes"),
        F.max(n).alias("max_codes"),
    )


def codes_by_class(letters: DataFrame) -> DataFrame:
    """Different codes and occurrences per class; a class without codes has zeros."""
    # Letters without codes keep one row, with a null code, so that their class stays.
    codes = letters.where(F.col("class").isNotNull()).select("class", F.explode_outer("service_codes_list").alias("code"))
    per_code = codes.groupBy("class", "code").agg(F.count("code").alias("n"))
    return per_code.groupBy("class").agg(
        F.count("code").alias("unique_codes"), F.sum("n").alias("total_occurrences")
    )


def top_codes_by_class(letters: DataFrame, k: int = 5) -> DataFrame:
    # The filter on row_number is pushed below the shuffle as a group limit,
    # so a task sends at most k rows per class.
    counts = exploded_codes(letters.where(F.col("class").isNotNull())).groupBy("class", "code").agg(F.count("*").alias("count"))
    order = Window.partitionBy("class").orderBy(F.desc("count"), F.asc("code"))
    ranked = counts.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


# --- keywords ------------------------------------------------------------------


def _phrases(domain: Domain) -> list[tuple[str, int]]:
    return [(p, 0) for p in domain.class_0_phrases] + [(p, 1) for p in domain.class_1_phrases]


def keyword_counts(letters: DataFrame, domain: Domain = DEFAULT) -> DataFrame:
    """Letters per phrase: overall, and those of class 0 and class 1.

    One pass: the text is folded once and every phrase adds three conditional
    counts to the same aggregation, so nothing but one row is shuffled.
    """
    phrases = _phrases(domain)
    has_class = "class" in letters.columns
    folded = letters.select(
        *(["class"] if has_class else []), text.fold_case(F.col("text_cleaned")).alias("folded")
    )
    label = F.col("class") if has_class else F.lit(None).cast("int")
    hits = folded.select(
        label.alias("class"),
        *[text.contains_phrase(F.col("folded"), p).alias(f"hit_{i}") for i, (p, _) in enumerate(phrases)],
    )
    aggregates = []
    for i in range(len(phrases)):
        hit = F.col(f"hit_{i}")
        aggregates += [
            F.count_if(hit).alias(f"all_{i}"),
            F.count_if(hit & (F.col("class") == 0)).alias(f"zero_{i}"),
            F.count_if(hit & (F.col("class") == 1)).alias(f"one_{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(phrase).alias("keyword"),
                F.lit(owner).alias("list_class"),
                F.col(f"all_{i}").alias("count"),
                F.col(f"zero_{i}").alias("class_0_count"),
                F.col(f"one_{i}").alias("class_1_count"),
            )
            for i, (phrase, owner) in enumerate(phrases)
        ]
    )
    return hits.agg(*aggregates).select(F.inline(rows))


def keyword_frequency(counts: DataFrame) -> DataFrame:
    """Phrases seen at least once."""
    return counts.where(F.col("count") > 0).select("list_class", "keyword", "count")


def keyword_purity(counts: DataFrame) -> DataFrame:
    """How well a phrase tells the classes apart; a tie prefers class 1."""
    total = F.col("class_0_count") + F.col("class_1_count")
    scored = counts.withColumn("total_occurrences", total).where(F.col("total_occurrences") > 0)
    ratio = lambda c: F.col(c).cast("double") / F.col("total_occurrences")
    return scored.select(
        "list_class",
        "keyword",
        "total_occurrences",
        ratio("class_0_count").alias("class_0_ratio"),
        ratio("class_1_count").alias("class_1_ratio"),
        F.when(ratio("class_0_count") > ratio("class_1_count"), 0).otherwise(1).alias("preferred_class"),
    )


def mean_score(df: DataFrame, column: str = "quality_score") -> DataFrame:
    return df.agg(F.count(column).alias("scored"), F.avg(column).alias("mean_score"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
