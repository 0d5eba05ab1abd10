"""Small builders shared by the tests."""

from pyspark.sql import functions as F

LETTERS = "letter_id string, guarantee_letter_text string, class int"


def letters(spark, rows):
    return spark.createDataFrame(rows, LETTERS)


def one_column(spark, values, name="t", kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")


def evaluated(df, expression):
    """The expression's value per row, in the order of the values."""
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def scattered(df, n):
    return df.repartition(n).sortWithinPartitions(F.rand(n))
