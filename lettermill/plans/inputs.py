"""Letters, predictions, score pairs and runs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.domain import Domain
from lettermill.functions.picks import choose, pick
from lettermill.operators.metrics import confusion_cells, metrics_from_cells

SEED = 42

# Documents hold no service codes: e-mail addresses stand in for them.
DOCUMENTS = Domain(
    code_pattern=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    class_0_phrases=("the ", "and the", " of ", "license", "xyzzy never seen"),
    class_1_phrases=("le ", "und ", "de la", "@"),
)

LETTER_COMPANIES = ("СОГАЗ", "Ингосстрах", "СОГАЗ-Мед", "ИНГОССТРАХ", "РЕСО-Гарантия")
CODED_BODIES = (
    "Просим организовать оплату следующих медицинских услуг :\n{codes}\n\nДиагноз : Острое состояние .",
    "Оплатить  медицинские услуги по кодам:\n{codes}\n\nПо результатам экспертизы ; согласно медицинской документации",
    "Гарантируем оплату услуг:\n{codes}\n\nОплата будет осуществляться по полису ДМС !",
)
PLAIN_BODIES = (
    "Просим организовать необходимые исследования , согласно программе ДМС.",
    "Организовать приемы врача  в рамках программы ДМС .",
    "Необходимые лабораторные исследования в рамках стандартной программы ; предусмотренной договором",
)

# (run_id, family, added letters, score threshold)
RUNS = (
    ("baseline", "baseline", 0, 0.50),
    ("synthetic_50", "synthetic", 50, 0.40),
    ("synthetic_100", "synthetic", 100, 0.30),
    ("synthetic_200", "synthetic", 200, 0.60),
    ("generated_50", "generated", 50, 0.20),
    ("generated_100", "generated", 100, 0.70),
    ("logistic", "classifier", 0, 0.50),
    ("random_forest", "classifier", 0, 0.35),
)


# Columns of the given tables that are read; a given schema saves a job for each table.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_discount double, l_tax double, "
        "l_returnflag string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. `spark.lettermill.inputTasks` deals small tables of few splits out to so many tasks."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get("spark.lettermill.inputTasks", None)
    return rows.repartition(int(tasks)) if tasks else rows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as letters without a class; the company is the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return docs.select(
        F.col("doc_id").cast("string").alias("letter_id"),
        F.col("text").alias("guarantee_letter_text"),
        F.col("source").alias("company"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as letters; the class of an unlabelled one is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("class"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("letter_id"),
        F.col("text").alias("guarantee_letter_text"),
        "class",
        F.col("source").alias("company"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a class."""
    return documents(spark, sf_dir).where(F.col("class").isNotNull())


def orders_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with all its distinct codes, sorted, and the extreme part keys of its lines.

    Orders and lines are one table that is grouped once: repeated codes go before its only shuffle, and no join follows.
    """
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    numbers = (10 + part % 90, 10 + supp % 90, 10 + order % 90, line % 10, 100 + (part * 7) % 900)
    code = F.concat(F.lit("F"), F.concat_ws(".", *[n.cast("string") for n in numbers]))
    lines = table(spark, sf_dir, "lineitem").where(order.isNotNull())
    lines = lines.select(order.alias("o_orderkey"), code.alias("code"), part.alias("part"), F.lit(0).alias("orders"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("orders"))
    grouped = lines.unionByName(orders, allowMissingColumns=True).groupBy("o_orderkey").agg(
        F.sort_array(F.collect_set("code")).alias("codes"),
        F.min("part").alias("low"),
        F.max("part").alias("high"),
        F.sum("orders").alias("orders"),
    )
    # A key that several orders share is a row for each of them.
    one_each = F.explode(F.array_repeat(F.lit(0), F.col("orders").cast("int"))).alias("_")
    return grouped.where(F.col("orders") > 0).select("o_orderkey", "codes", "low", "high", one_each).drop("_")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter per order: company, body with or without codes, id list."""
    key = F.col("o_orderkey")
    picked = orders_with_codes(spark, sf_dir).select(
        key.cast("string").alias("letter_id"),
        (pick(SEED, "cls", key, 162) < 118).cast("int").alias("class"),
        (pick(SEED, "noise", key, 20) == 0).alias("flipped"),
        choose(LETTER_COMPANIES, SEED, "co", key).alias("name"),
        choose(CODED_BODIES, SEED, "tpl", key).alias("coded"),
        choose(PLAIN_BODIES, SEED, "tpl", key).alias("plain"),
        pick(SEED, "ids", key, 4).alias("id_form"),
        F.array_join("codes", "\n").alias("codes"),
        "low",
        "high",
    )
    with_codes = (F.col("class") == 1) != F.col("flipped")
    body = F.when(with_codes, F.replace("coded", F.lit("{codes}"), F.col("codes"))).otherwise(F.col("plain"))
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    id_list = (
        F.when(F.col("low").isNull(), F.lit(None))
        .when(F.col("id_form") == 0, F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]")))
        .when(F.col("id_form") == 1, low)
        .when(F.col("id_form") == 2, F.concat(F.lit("id "), low, F.lit("; "), high))
        .otherwise("[]")
    )
    return picked.select(
        "letter_id",
        F.concat(F.col("name"), F.lit("\n\n"), body).alias("guarantee_letter_text"),
        "class",
        id_list.alias("service_ids_list"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    code = F.format_string("F%d.%d", 10 + key % 90, 100 + (key * 7) % 900)
    return part.select(key.alias("service_id"), code.alias("ServiceCode"), F.col("p_name").alias("ServiceName"))


def split_of(key: Column) -> Column:
    """train for seven keys of ten, else test."""
    return F.when(pick(SEED, "split", key, 10) < 7, "train").otherwise("test")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (discount * 10 + tax > F.lit(0.6)).cast("int").alias("p"),
        (discount > F.lit(0.05)).cast("int").alias("q"),
        F.round(discount * 8 + tax * 2, 2).alias("score"),
    )


def predictions_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_discount", "l_tax")
    return lines.select(
        "l_suppkey",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10 + F.col("l_tax") > F.lit(0.6)).cast("int").alias("p"),
        (F.col("l_discount") > F.lit(0.05)).cast("int").alias("q"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two rules per supplier."""
    truth = F.col("l_returnflag") == "R"
    right = lambda rule: F.avg((rule == truth).cast("double"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey").agg(
        right(F.col("l_discount") > F.lit(0.05)).alias("a"), right(F.col("l_tax") > F.lit(0.04)).alias("b")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a binary class and the text of the document of the same id."""
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.join(docs, "vec_id", "left").select(
        F.col("vec_id").cast("string").alias("letter_id"),
        F.col("text").alias("guarantee_letter_text"),
        (F.col("label") >= 5).cast("int").alias("class"),
        F.col("embedding").cast("array<double>").alias("vector"),
        split_of(F.col("vec_id")).alias("split"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per threshold rule, all evaluated over one tally of the scores."""
    tallies = predictions(spark, sf_dir).groupBy("y", "score").agg(F.count("*").alias("n"))
    settings = F.array(
        *[
            F.struct(
                F.lit(run).alias("run_id"),
                F.lit(family).alias("family"),
                F.lit(size).alias("size"),
                F.lit(float(threshold)).alias("threshold"),
            )
            for run, family, size, threshold in RUNS
        ]
    )
    judged = tallies.select("y", "score", "n", F.inline(settings)).select(
        "run_id", "family", "size", "y", (F.col("score") > F.col("threshold")).cast("int").alias("p"), "n",
        (F.col("score") * F.col("n")).alias("score_sum"),
    )
    cells = confusion_cells(judged, ["run_id", "family", "size"], weight="n")
    quality = judged.groupBy("run_id").agg((F.sum("score_sum") / F.sum("n")).alias("quality"))
    rows = metrics_from_cells(cells.join(quality, "run_id"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return rows.withColumns(
        {
            "train_size": total + F.col("size"),
            "test_size": total,
            "mean_quality": F.when(F.col("family") == "generated", F.col("quality")),
        }
    ).drop("quality")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation requests and responses per order: good, broken, partial or absent."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("Письмо "), key.cast("string"), F.lit("\n"), F.col("o_orderpriority")).alias("letter_text"),
            ((pick(SEED, "quality", key, 1000)) / F.lit(1000.0)).alias("quality_score"),
            F.lit("as asked").alias("reasoning"),
        )
    )
    kind = pick(SEED, "kind", key, 10)
    response = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.substring(good, 1, 20))
        .when(kind == 2, F.lit('{"letter_text": "no score", "reasoning": "partial"}'))
        .otherwise(good)
    )
    return orders.select(
        key.cast("string").alias("request_id"),
        (pick(SEED, "cls", key, 162) < 118).cast("int").alias("class"),
        response.alias("response"),
    )
