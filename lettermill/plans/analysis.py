"""The analysis of a corpus: every section as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.operators import profile, tfidf
from lettermill.operators.preprocess import preprocess_letters
from lettermill.operators.storage import stored
from lettermill.sources.results import write_analysis


def letter_patterns(letters: DataFrame, domain: Domain = DEFAULT) -> dict[str, DataFrame]:
    """The six pattern sections of preprocessed letters.

    Fitting the TF-IDF vocabulary, looking for keywords and adding up weights run jobs, each of which serves two sections
    and leaves a few rows; all other sections are lazy.
    """
    model = tfidf.fit_tfidf(letters)
    keywords = _kept(profile.keyword_counts(letters, domain))
    sections = {
        "general_stats": profile.general_statistics(letters),
        "class_patterns": profile.class_profile(letters),
        "class_companies": profile.class_company_counts(letters),
        "class_differences": profile.class_differences(letters),
        "company_patterns": profile.company_profile(letters),
        "code_statistics": profile.code_statistics(letters),
        "code_top": profile.top_codes(letters),
        "code_prefixes": profile.top_prefixes(letters, domain=domain),
        "codes_per_letter": profile.codes_per_letter(letters),
        "codes_distribution": profile.counts_by_value(letters, "num_service_codes"),
        "codes_by_class": profile.codes_by_class(letters),
        "codes_top_by_class": profile.top_codes_by_class(letters),
        "keyword_frequency": profile.keyword_frequency(keywords),
        "keyword_effectiveness": profile.keyword_purity(keywords),
    }
    if model.terms:
        sections["tfidf_vocabulary"] = tfidf.vocabulary(letters, model)
        sums = _kept(tfidf.weight_sums(letters, model))
        sections["tfidf_top"] = tfidf.top_of_sums(sums, model)
        sections["tfidf_top_by_class"] = tfidf.top_of_sums_by_class(sums, model)
    return sections


def _kept(rows: DataFrame) -> DataFrame:
    """A row per phrase or class, computed once for all that read them."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def as_long(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, item, measure, value) rows.

    Text and class columns name the item; every numeric column becomes a row.
    """
    parts = []
    for name, df in sections.items():
        numeric = {"bigint", "int", "double"}
        labels = [c for c, t in df.dtypes if t == "string" or c in ("class", "list_class", "num_service_codes")]
        values = [c for c, t in df.dtypes if t in numeric and c not in labels]
        item = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in labels])
        flat = df.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in values])
        long = flat.unpivot("item", values, "measure", "value")
        parts.append(long.select(F.lit(name).alias("section"), "item", "measure", "value"))
    return profile.union_all(parts)


def load_and_analyze(
    train: DataFrame, test: DataFrame, domain: Domain = DEFAULT, path: str | None = None, keep: bool = False
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Preprocess both splits, analyse the training one, and save if asked.

    Saving evaluates some twenty sections, so the preprocessed letters are
    kept on the executors' disks meanwhile instead of being made anew for each.
    keep: they stay there for the caller, who releases them.
    """
    train, test = preprocess_letters(train, domain), preprocess_letters(test, domain)
    if path is not None or keep:
        train, _ = stored(train)
    sections = {
        "quality_metrics": profile.data_quality(train),
        "class_distribution": profile.value_counts(train, "class"),
        "company_distribution": profile.value_counts(train, "insurance_company"),
        "test_stats": test.agg(F.count("*").alias("total_samples")),
        **letter_patterns(train, domain),
    }
    if path is not None:
        write_analysis(sections, path)
        if not keep:
            train.unpersist()
    return train, test, sections
