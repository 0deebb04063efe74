"""Every registered query against its SQL twin in DuckDB."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def link():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, link, name):
    result = compare(spark, link, ROOT, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows-only")), result


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["nearest_grid", "nearest_kp", "box_stats", "hour_join", "visible_objects",
                                  "thin_min_distance", "panorama_bins", "bracket_merge", "params_by_mode"])
def test_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    physical = entry.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


@pytest.mark.parametrize("name", ["median_brightness_volume", "nearest_by_station", "stack_avg", "focus_laplacian",
                                  "box_stats"])
def test_partition_count_does_not_matter(spark, name):
    run = lambda: sorted(map(tuple, entry.queries()[name](spark, ROOT).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    seven = run()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == seven
