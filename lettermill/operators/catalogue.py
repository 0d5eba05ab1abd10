"""The service catalogue and its lookup.

No side is hinted to broadcast: the planner does it while the catalogue is
under spark.sql.autoBroadcastJoinThreshold, and sorts and merges, with skewed
partitions split at run time, beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def service_mapping(services: DataFrame, order: Column) -> DataFrame:
    """One row per service id; of duplicates the last one in `order` wins."""
    entry = F.struct(F.col("ServiceCode").alias("code"), F.col("ServiceName").alias("name"))
    latest = F.max_by(entry, order).alias("entry")
    return services.groupBy("service_id").agg(latest).select("service_id", "entry.code", "entry.name")


def resolve_services(letters: DataFrame, mapping: DataFrame, key: str = "letter_id") -> DataFrame:
    """The catalogue rows of each letter's ids, in the order of the ids.

    Only the key and the ids are shuffled, never the texts. Ids without a
    catalogue row stay, with null code and name.
    """
    wanted = letters.select(key, F.posexplode_outer("parsed_service_ids").alias("position", "service_id"))
    found = wanted.join(mapping, "service_id", "left")
    entry = F.struct("position", "service_id", "code", "name")
    collected = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), entry))).alias("services")
    )
    return collected
