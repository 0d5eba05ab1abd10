"""Row-wise text expressions (stateless, so they also work on streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain

# Exactly the code points that Python's str.split() takes as whitespace.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
NOT_WHITESPACE = r"[^\x09-\x0d\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]{2,}"


def _case_variants() -> tuple[str, str]:
    """Letters that share an upper case with another letter, and that letter.

    A case-insensitive match equates them although lower() keeps them apart.
    """
    variants, bases = [], []
    for point in range(0x80, 0x10000):
        char = chr(point)
        base = char.upper().lower()
        if len(char.upper()) == 1 and len(base) == 1 and char.lower() == char and base != char:
            variants.append(char)
            bases.append(base)
    return "".join(variants), "".join(bases)


VARIANTS, BASES = _case_variants()
# Most letters of a text lie outside of these two ranges, and only the others are compared with each variant.
ANY_VARIANT = f"[\\u00b5-\\u03f5\\u1c80-\\uffff&&[{VARIANTS}]]"


def clean_text(text: Column) -> Column:
    """Null to '', whitespace runs to one blank, no blank before , . ! ? ; :"""
    collapsed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", " "))
    return F.regexp_replace(collapsed, " ([,.!?;:])", "$1")


def model_text(text: Column) -> Column:
    """Null to '', and nothing but the outer whitespace removed."""
    edges = f"^{WHITESPACE}+|{WHITESPACE}+\\z"
    return F.regexp_replace(F.coalesce(text, F.lit("")), edges, "")


def has_codes(text: Column, domain: Domain = DEFAULT) -> Column:
    return text.rlike(domain.code_pattern)


def extract_codes(text: Column, domain: Domain = DEFAULT) -> Column:
    """All codes in order, non-overlapping, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(domain.code_pattern), F.lit(0))


def count_codes(text: Column, domain: Domain = DEFAULT) -> Column:
    return F.size(extract_codes(text, domain))


def extract_diagnoses(text: Column, domain: Domain = DEFAULT) -> Column:
    return F.regexp_extract_all(text, F.lit(domain.diagnosis_pattern), F.lit(0))


def code_prefix(code: Column, domain: Domain = DEFAULT) -> Column:
    return F.substring(code, 1, domain.prefix_length)


def company(text: Column, domain: Domain = DEFAULT) -> Column:
    """First pattern that matches, in the declared order."""
    result = None
    for name, pattern in domain.company_patterns:
        hit = text.rlike("(?iu)" + pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    if result is None:
        return F.lit(domain.other_company)
    return result.otherwise(domain.other_company)


def text_length(cleaned: Column) -> Column:
    return F.length(cleaned)


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text: its blanks are single and never at an edge."""
    blanks = F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    return F.when(cleaned == "", 0).otherwise(blanks + 1)


def raw_word_count(text: Column) -> Column:
    """Whitespace-separated words of a text that was not cleaned."""
    return F.regexp_count(text, F.lit(NOT_WHITESPACE + "+"))


def fold_case(text: Column) -> Column:
    """Text prepared for case-insensitive `contains`.

    The variant letters are rare, so the slower translate runs only on texts
    that hold one.
    """
    lowered = F.lower(text)
    return F.when(lowered.rlike(ANY_VARIANT), F.translate(lowered, VARIANTS, BASES)).otherwise(lowered)


def fold_literal(phrase: str) -> str:
    return phrase.lower().translate(str.maketrans(VARIANTS, BASES))


def contains_phrase(folded: Column, phrase: str) -> Column:
    """Case-insensitive test of a phrase on a text from `fold_case`."""
    return folded.contains(fold_literal(phrase))


def contains_lower(text: Column, keyword: str) -> Column:
    """Plain substring test on the lower-cased text."""
    return F.lower(text).contains(keyword)


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def exploded(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per item of an array.

    A plain explode makes the planner add a filter on the array's size, which
    evaluates the regular expressions behind the array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def fixed_3(value: Column) -> Column:
    """A metric printed with three decimals."""
    return F.format_string("%.3f", value)


def run_label(moment: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyyMMdd_HHmmss")
