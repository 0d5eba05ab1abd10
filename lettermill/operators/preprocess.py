"""Letters to preprocessed letters, and the handcrafted features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.functions import ids, text

FEATURE_NAMES = (
    "has_codes",
    "num_codes",
    "length",
    "words",
    "has_company_1",
    "has_company_2",
    "class_0_score",
    "class_1_score",
)


def preprocess_letters(
    letters: DataFrame, domain: Domain = DEFAULT, text_col: str = "guarantee_letter_text"
) -> DataFrame:
    """Add the cleaned text and everything read off it.

    `parsed_service_ids` appears only when the input has `service_ids_list`.
    Each step is its own projection so that the cleaned text and the code list
    are computed once per row.
    """
    out = letters.withColumn("text_cleaned", text.clean_text(F.col(text_col)))
    out = out.withColumn("service_codes_list", text.extract_codes(F.col("text_cleaned"), domain))
    cleaned = F.col("text_cleaned")
    derived = {
        "has_service_codes": F.size("service_codes_list") > 0,
        "num_service_codes": F.size("service_codes_list"),
        "insurance_company": text.company(cleaned, domain),
        "text_length": text.text_length(cleaned),
        "num_words": text.word_count(cleaned),
    }
    if "service_ids_list" in letters.columns:
        derived["parsed_service_ids"] = ids.parse_service_ids(F.col("service_ids_list"))
    return out.withColumns(derived)


def _hits(folded: Column, keywords) -> Column:
    total = F.lit(0)
    for keyword in keywords:
        total = total + folded.contains(keyword).cast("int")
    return total


def handcrafted_features(
    letters: DataFrame, domain: Domain = DEFAULT, text_col: str = "guarantee_letter_text"
) -> DataFrame:
    """Add the eight features of the raw text, one column each."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    first, second = domain.feature_companies
    out = letters.withColumn("num_codes", F.regexp_count(raw, F.lit(domain.code_pattern)))
    out = out.withColumn("lowered", F.lower(raw))
    lowered = F.col("lowered")
    return out.withColumns(
        {
            "has_codes": (F.col("num_codes") > 0).cast("int"),
            "length": F.length(raw),
            "words": text.raw_word_count(raw),
            "has_company_1": lowered.contains(first).cast("int"),
            "has_company_2": lowered.contains(second).cast("int"),
            "class_0_score": _hits(lowered, domain.feature_class_0),
            "class_1_score": _hits(lowered, domain.feature_class_1),
        }
    ).drop("lowered")
