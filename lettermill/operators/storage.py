"""Rows that several jobs read, kept on the executors' disks.

A task gathers rows that are kept into batches on its heap, 10,000 rows of any length by default, in buffers that double
as they grow. Letters may be long, so batches are small here; and kept rows stay out of the memory that tasks need.
"""

from __future__ import annotations

import threading

from pyspark import StorageLevel
from pyspark.sql import DataFrame

BATCH = "spark.sql.inMemoryColumnarStorage.batchSize"
#: Rows of a batch.
BATCH_ROWS = 256

_setting = threading.Lock()


def stored(rows: DataFrame) -> tuple[DataFrame, int]:
    """The same rows, made now and kept until the caller unpersists them, and their number."""
    conf = rows.sparkSession.conf
    with _setting:  # which setting holds, the one at `persist` or the one when rows are first read, depends on others
        before = conf.get(BATCH, None)
        conf.set(BATCH, str(BATCH_ROWS))
        try:
            kept = rows.persist(StorageLevel.DISK_ONLY)
            return kept, kept.count()
        finally:
            conf.unset(BATCH) if before is None else conf.set(BATCH, before)
