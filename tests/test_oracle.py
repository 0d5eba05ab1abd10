"""Every query with an SQL counterpart gives the same rows in both engines."""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"
# Ten pairs at this size get an exact p-value, which the SQL does not compute.
EXACT = {"wilcoxon_test"}
# Hundreds of fits: minutes each. `python -m checks.compare` runs them.
LONG = {"augmentation_experiment", "generated_experiment", "full_suite", "full_mode", "synthetic_mode"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


def test_registries_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(set(entry_points.oracle_sql()) - EXACT - LONG))
def test_same_rows(spark, oracle, name):
    mine = entry_points.queries()[name](spark, SF).toPandas()
    theirs = oracle.execute(entry_points.oracle_sql()[name]).df()
    spark.catalog.clearCache()
    assert difference(mine, theirs) is None
