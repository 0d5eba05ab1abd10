"""Synthetic letters from templates.

Rows come from distributed ranges, and every choice is a hash of the row's
index, so any number of letters is made in parallel and always the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.domain import DEFAULT, Domain
from lettermill.functions.picks import choose, hex_modulo, pick, row_hash, shuffle_key

ROWS_PER_TASK = 50_000
SCHEMA = "letter_id string, guarantee_letter_text string, class int"


def service_codes(
    index: Column,
    seed: int = 42,
    count: int | None = None,
    prefixes: tuple | None = None,
    most: int | None = None,
    domain: Domain = DEFAULT,
) -> Column:
    """An array of codes: `count` of them, or 1 to `most`.

    A code is a prefix (F10 to F99, or one of `prefixes`) and four numbers, all
    read from different digits of one hash.
    """
    most = domain.codes_per_letter if most is None else most
    size = F.lit(count) if count is not None else pick(seed, "codes", index, most).cast("int") + 1
    base = F.concat(index.cast("string"), F.lit(":"))
    hashes = F.transform(F.sequence(F.lit(1), size), lambda j: row_hash(seed, "code", F.concat(base, j.cast("string"))))

    def code(h: Column) -> Column:
        if prefixes is None:
            head = F.concat(F.lit("F"), (hex_modulo(h, 1, 6, 90) + 10).cast("string"))
        else:
            head = F.get(F.array(*[F.lit(p) for p in prefixes]), hex_modulo(h, 1, 6, len(prefixes)).cast("int"))
        numbers = (
            hex_modulo(h, 7, 6, 90) + 10,
            hex_modulo(h, 13, 6, 90) + 10,
            hex_modulo(h, 19, 6, 10),
            hex_modulo(h, 25, 6, 900) + 100,
        )
        return F.concat_ws(".", head, *[n.cast("string") for n in numbers])

    if count == 0:
        return F.array().cast("array<string>")
    return F.transform(hashes, code)


def fill(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def class_0_letter(index: Column, seed: int = 42, domain: Domain = DEFAULT) -> Column:
    """A general request."""
    return fill(
        choose(domain.class_0_templates, seed, "template", index),
        {
            "company": choose(domain.template_companies, seed, "company", index),
            "services": choose(domain.services, seed, "services", index),
            "patient_info": choose(domain.patient_info, seed, "patient_info", index),
            "patient_action": choose(domain.patient_actions, seed, "patient_action", index),
            "program_type": choose(domain.program_types, seed, "program_type", index),
        },
    )


def class_1_letter(index: Column, seed: int = 42, domain: Domain = DEFAULT) -> Column:
    """A request that names codes, one per line."""
    return fill(
        choose(domain.class_1_templates, seed, "template", index),
        {
            "company": choose(domain.template_companies, seed, "company", index),
            "service_codes": F.array_join(service_codes(index, seed, domain=domain), "\n"),
            "diagnosis": choose(domain.diagnoses, seed, "diagnosis", index),
            "patient_info": choose(domain.patient_info, seed, "patient_info", index),
        },
    )


def numbered(spark: SparkSession, count: int) -> DataFrame:
    """Rows 0 to count-1, with as many tasks as the count needs."""
    return spark.range(0, count, 1, max(1, -(-count // ROWS_PER_TASK)))


def _letters(spark: SparkSession, label: int, count: int, prefix: str, seed: int, domain: Domain) -> DataFrame:
    make = class_0_letter if label == 0 else class_1_letter
    index = F.concat(F.lit(f"{label}:"), F.col("id").cast("string"))
    return numbered(spark, count).select(
        F.concat(F.lit(f"{prefix}_{label}_"), F.col("id").cast("string")).alias("letter_id"),
        make(index, seed, domain).alias("guarantee_letter_text"),
        F.lit(label).alias("class"),
    )


def class_counts(letters: DataFrame) -> tuple[int, int, int]:
    """Rows, and those of class 0 and class 1 (one row reaches the driver)."""
    row = letters.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("class") == 0).alias("zero"),
        F.count_if(F.col("class") == 1).alias("one"),
    ).first()
    return row["n"], row["zero"], row["one"]


def split_size(size: int, counts: tuple[int, int, int], rounding: str = "remainder") -> dict[int, int]:
    """Letters per class in the proportions of the counted rows.

    "remainder" gives class 1 what class 0 leaves; "truncate" cuts both.
    """
    n, zero, one = counts
    if rounding not in ("remainder", "truncate"):
        raise ValueError(f"unknown rounding: {rounding}")
    share_0 = int(size * (zero / n)) if n else 0
    if rounding == "remainder":
        return {0: share_0, 1: size - share_0}
    return {0: share_0, 1: int(size * (one / n)) if n else 0}


def ratio_preserving_set(
    letters: DataFrame,
    target_size: int = 200,
    seed: int = 42,
    rounding: str = "remainder",
    domain: Domain = DEFAULT,
    counts: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Letters that bring the set to `target_size` and keep its class ratio; counts: of its classes, if known."""
    spark = letters.sparkSession
    counts = counts or class_counts(letters)
    missing = max(0, target_size - counts[0])
    if missing == 0:
        return spark.createDataFrame([], SCHEMA)
    sizes = split_size(missing, counts, rounding)
    parts = [_letters(spark, c, k, "synthetic", seed, domain) for c, k in sizes.items()]
    return parts[0].unionByName(parts[1])


def balancing_set(
    letters: DataFrame, balance_ratio: float = 0.5, seed: int = 42, domain: Domain = DEFAULT
) -> DataFrame:
    """Letters of the smaller class that raise it to the wanted share."""
    if not 0 < balance_ratio < 1:
        raise ValueError("balance_ratio must lie between 0 and 1")
    spark = letters.sparkSession
    _, zero, one = class_counts(letters)
    present = {label: k for label, k in ((0, zero), (1, one)) if k}
    if not present:
        return spark.createDataFrame([], SCHEMA)
    minority = min(present, key=lambda label: (present[label], label))
    majority_count = max(present.values())
    wanted = int(majority_count * balance_ratio / (1 - balance_ratio))
    extra = max(0, wanted - present[minority])
    if extra == 0:
        return spark.createDataFrame([], SCHEMA)
    return _letters(spark, minority, extra, "balance", seed, domain)


def seeded_shuffle(df: DataFrame, seed: int = 42, key: str = "letter_id") -> DataFrame:
    """A reproducible random order: a range-partitioned sort by a hash."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key)


def append_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both sets under one schema; columns of one side only become null."""
    return real.withColumn("origin", F.lit("real")).unionByName(
        synthetic.withColumn("origin", F.lit("synthetic")), allowMissingColumns=True
    )


def append_projected(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both sets, synthetic rows reduced to text and class."""
    return real.unionByName(synthetic.select("guarantee_letter_text", "class"), allowMissingColumns=True)
