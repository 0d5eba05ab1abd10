from pyspark.sql import functions as F

from lettermill.operators.catalogue import resolve_services, service_mapping
from tests.helpers import rows

SERVICES = "service_id bigint, ServiceCode string, ServiceName string, place int"


def test_the_last_duplicate_wins(spark):
    df = spark.createDataFrame([(1, "a", "old", 1), (1, "b", "new", 2), (2, "c", "only", 3)], SERVICES)
    assert rows(service_mapping(df, F.col("place")), "service_id") == [(1, "b", "new"), (2, "c", "only")]


def test_ids_resolve_in_order_and_unknown_ids_stay(spark):
    services = spark.createDataFrame([(1, "a", "one", 1), (2, "b", "two", 2)], SERVICES)
    letters = spark.createDataFrame([("x", [2, 9, 1, 2]), ("y", [])], "letter_id string, parsed_service_ids array<bigint>")
    mapping = service_mapping(services, F.col("place"))
    got = {r.letter_id: [(s.service_id, s.code) for s in r.services] for r in resolve_services(letters, mapping).collect()}
    assert got == {"x": [(2, "b"), (9, None), (1, "a"), (2, "b")], "y": []}


def test_one_id_in_every_letter_without_broadcast(spark):
    """The way taken when the catalogue is too large to broadcast."""
    services = spark.range(1, 50).selectExpr("id AS service_id", "'c' || id AS code", "'n' || id AS name")
    letters = spark.range(2000).select(
        F.col("id").cast("string").alias("letter_id"), F.array(F.lit(7), F.col("id") % 60).alias("parsed_service_ids")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = resolve_services(letters, services).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 2000
    for row in got:
        second = int(row.letter_id) % 60
        assert [s.code for s in row.services] == ["c7", f"c{second}" if 1 <= second < 50 else None]
