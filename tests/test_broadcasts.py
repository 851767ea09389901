"""F2 to F10: tables that are exploded, or small only as files, are never collected on the driver to be broadcast."""

import pytest
from pyspark.sql import functions as F

from scorelake.plans import catalog, pages
from scorelake.sources.tables import dealt

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["nearest_staffs", "tall_items", "staff_symbols"])
def test_no_broadcast_of_points(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_no_broadcast_of_pixels(spark):
    plan = pages.line_masks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=merge)" in plan or "rightHint=(strategy=merge)" in plan


def test_rows_to_explode_are_dealt(spark):
    """a task makes a bounded number of rows, however few files the table has."""
    rows = dealt(spark.range(0, 100, 1, 1), "id", 1000, 10_000)
    assert rows.rdd.getNumPartitions() == 10 and rows.withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(1000)))).count() == 100_000
