"""Sinks of letters, analyses, run tables and reports, and the latest run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.sources.letters import CSV, EMPTY_WRITTEN, read_table


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names; without that setting, below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/lettermill-{uuid.uuid4().hex}"


def write_letters_csv(letters: DataFrame, path: str) -> None:
    letters.write.mode("overwrite").options(**CSV, emptyValue=EMPTY_WRITTEN).csv(path)


def read_letters_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_table(spark, path, schema, "csv")


def write_analysis(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder of typed rows per section."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_runs(runs: DataFrame, base: str, run_label: str) -> str:
    """Save the runs of one suite as base/experiment_<label>."""
    path = f"{base}/experiment_{run_label}"
    runs.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_predictions(predictions: DataFrame, base: str, run_id: str) -> None:
    """Predictions and probabilities of one run's tested letters, by run."""
    predictions.write.mode("overwrite").parquet(f"{base}/predictions/run_id={run_id}")


def read_predictions(spark: SparkSession, base: str) -> DataFrame:
    """Those of all saved runs, with a column run_id."""
    return spark.read.parquet(f"{base}/predictions")


def write_results_table(table: DataFrame, path: str) -> None:
    """A few rows, so one file."""
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """(line_number, line) rows as one text file in order."""
    lines.coalesce(1).sortWithinPartitions("line_number").select("line").write.mode("overwrite").text(path)


def latest_runs(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The runs of the suite that was written last."""
    found = (
        spark.read.schema(schema)
        .json(f"{base}/experiment_*")
        .select("*", F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_file"))
        .withColumn("experiment", F.regexp_extract("_file", "experiment_([^/]+)/", 1))
        .drop("_file")
    )
    newest = found.agg(F.max(F.struct("_written", "experiment")).alias("m")).select(F.col("m.experiment").alias("experiment"))
    # One row is broadcast.
    return found.join(F.broadcast(newest), "experiment").drop("_written")
