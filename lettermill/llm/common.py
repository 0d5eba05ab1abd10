"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch handed to Python at once; batches also end by size.
BATCH_CHARS = 1 << 21
#: Rows of all labels that a model is fitted on, at most.
SAMPLE_TOTAL = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the quarter of documents that nothing is learnt from (null ids count as learnable)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder in spark.checkpoint.dir; later steps start from there.

    Without that setting a local session gets a folder of its own; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lettermill-"))
    return df.checkpoint()


def text_batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    """Slices of the text column as (first row, texts) of at most BATCH_CHARS bytes or one text; null is empty."""
    texts = batch.column(column)
    start, size = 0, 0
    rows: list[str] = []
    for i in range(len(texts)):
        value = texts[i].as_py() or ""
        if rows and size + len(value) > BATCH_CHARS:
            yield start, rows
            start, size, rows = i, 0, []
        rows.append(value)
        size += len(value)
    if rows:
        yield start, rows


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, total: int = SAMPLE_TOTAL
) -> tuple[list[tuple], dict]:
    """(label, text) of at most `rows` documents of each label, for the driver, and the learnable ids of each label.

    labels: doc_id and one label for it. At most `total` rows are taken in all, shared out evenly where there are many
    labels (of more labels than that, the commonest). Only labelled ids are counted first; the share of ids that the
    sample needs is then chosen by hash, so the texts of no other rows leave their tasks, and they are read in one pass.
    Rows of over `max_chars` characters are no examples. The sample depends on ids alone and is the same in any
    partitioning.
    """
    # A repeated id has one label: the smallest.
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    known = known.where(~held_out())
    counted = known.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["_label"]: r["_n"] for r in counted.orderBy(F.desc("_n"), "_label").limit(total).collect()}
    if not counts:
        return [], {}
    rows = max(1, min(rows, total // len(counts)))
    order = F.xxhash64("doc_id", F.lit(17))
    # About 2 * rows ids of each label, whatever the number of documents.
    chosen = known.join(counted, "_label").where(F.pmod(order, F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * rows / F.col("_n")) * (1 << 30))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "_label")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.char_length("_text").between(1, max_chars))
    found = texts.join(F.broadcast(chosen), "_id")
    first = Window.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit(17)), "_id", "_text")
    found = found.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= rows)
    out = [(r["_label"], r["_place"], r["_text"]) for r in found.collect() if r["_label"] in counts]
    out.sort(key=lambda r: (str(r[0]), r[1]))
    return [(value, text) for value, _, text in out], counts
