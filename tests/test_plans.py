"""What the physical plans of the reports must look like."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripmill.operators.mart import filter_by
from tripmill import session
from tripmill.operators import mart, reports, star, tiles
from tripmill.plans import layers, warehouse
from tripmill.plans.registry import QUERIES, TILES

WORDS = warehouse.WORDS


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gold(spark, sf_dir):
    return layers.gold(spark, sf_dir)


def scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


def test_year_filters_prune_partitions(gold):
    plan = physical(reports.fee_kpi(gold, (1998, 1)))
    fact = next(line for line in scans(plan) if "core_zone_fee" in line)
    assert "PartitionFilters: [isnotnull(year" in fact and "year" in fact.split("PartitionFilters")[1]
    assert "PushedFilters: [IsNotNull(core_zone_fee), GreaterThan(core_zone_fee,0.0)" in fact


def test_reports_read_only_their_columns(gold):
    plan = physical(reports.market_share(gold, WORDS))
    fact = next(line for line in scans(plan) if "year_month" in line)
    assert "ReadSchema: struct<service_id:int,year_month:string>" in fact


def test_aggregation_comes_before_the_joins(gold):
    plan = physical(tiles.build_tile(gold, WORDS, TILES["tile_district_taxi"]))
    # read from the leaves up: the fact scan, its aggregates, then the joins
    upward = plan.splitlines()[::-1]
    fact = next(i for i, line in enumerate(upward) if "FileScan" in line and "trips" in line)
    joins = [i for i, line in enumerate(upward) if "Join" in line]
    partial = [i for i, line in enumerate(upward) if "partial_sum(trips" in line]
    assert partial and fact < partial[0] < min(i for i in joins if i > fact)


def test_a_tile_joins_only_its_dimensions(gold):
    plan = physical(tiles.build_tile(gold, WORDS, TILES["tile_volume"]))
    assert plan.count("Join") == 1
    assert physical(mart.trip_mart(gold, WORDS)).count("Join") == 8
    assert physical(mart.trip_mart(gold, WORDS, ["trips", "fare"])).count("Join") == 0


def test_small_dimensions_are_broadcast_by_size_and_large_ones_are_not(spark, gold):
    whole = mart.trip_mart(gold, WORDS)
    assert "SortMergeJoin" not in physical(whole)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unhinted = mart.trip_mart(gold, WORDS)
        assert "SortMergeJoin" in physical(unhinted) and "Broadcast" not in physical(unhinted)
        assert unhinted.count() == gold["fact_trip"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan


def test_one_place_with_a_third_of_all_trips(spark, gold):
    hot = gold["fact_trip"].withColumn(
        "pickup_place_id", F.when(F.col("distance_mi") > 16, F.lit(3)).otherwise(F.col("pickup_place_id"))
    )
    skewed = {**gold, "fact_trip": hot}
    direct = (
        mart.trip_mart(skewed, WORDS, ["pickup_zone", "service_group"])
        .groupBy("pickup_zone", "service_group")
        .agg(F.count(F.lit(1)).alias("total_trips"))
    )
    top = reports.top_zones(skewed, WORDS, k=1_000)
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in direct.collect()}


def test_year_bounds_of_the_caller_hold_beside_year_month(spark):
    rows = spark.createDataFrame([("1997", "1997-07"), ("1998", "1998-02"), ("1998", "1998-05")], "year string, year_month string")
    found = filter_by(rows, ranges={"year": ("1998", "1998"), "year_month": ("1997-06", "1998-03")}).collect()
    assert [tuple(r) for r in found] == [("1998", "1998-02")]


def test_line_items_are_shuffled_by_their_order_alone(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(warehouse.derive_trips(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_suppkey" not in plan
    by_customer = plan.split("hashpartitioning(o_custkey")
    assert len(by_customer) == 2 and "l_orderkey" not in by_customer[1].split("hashpartitioning(c_custkey")[0]


def test_the_fact_is_a_map_while_operators_are_few(spark, sf_dir, gold, monkeypatch):
    unified = star.unify(layers.silver(spark, sf_dir), warehouse.MODEL)
    fact = lambda: star.fact_trip(unified, session.lookup(gold["dim_operator"]), warehouse.MODEL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fact()
        assert "SortMergeJoin" not in physical(few) and "hashpartitioning" not in physical(few)
        monkeypatch.setattr(session, "FEW_ROWS", 0)
        many = fact()
        assert "SortMergeJoin" in physical(many)
        assert few.exceptAll(many).count() == 0 and few.count() == many.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
