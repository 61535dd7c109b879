from __future__ import annotations

import math

from pyspark.sql import functions as F

from tripmill.operators.conform import align, cast_losses, conform, conform_variants
from tripmill.operators.contracts import CANONICAL_TYPES, FeedContract
from tripmill.plans.trips import BRONZE_SCHEMAS, CONTRACTS
from tripmill.sources.tables import overwrite_periods, read_periods

CONTRACT = FeedContract(
    "x",
    {
        "vendorid": "operator_code",
        "pick": "pickup_ts",
        "passenger_count": "passenger_count",
        "airport_fee": "airport_fee",
        "flag": "store_and_fwd_flag",
    },
    (2024, 1),
    2024,
)


def test_contracts_cover_the_canonical_columns():
    used = {name for contract in CONTRACTS.values() for name in contract.renames.values()}
    assert used == set(CANONICAL_TYPES) and len(CANONICAL_TYPES) == 36
    assert [len(c.renames) for c in CONTRACTS.values()] == [20, 20, 25, 7]
    for feed, contract in CONTRACTS.items():
        raw = {part.strip().split(" ")[0] for part in BRONZE_SCHEMAS[feed].split(",")}
        assert set(contract.renames) <= raw
        assert raw - set(contract.renames) == ({"ehail_fee"} if feed == "green" else set())


def test_case_is_folded_and_collisions_are_merged(spark):
    df = spark.createDataFrame(
        [(1, None, 5.0, "drop"), (2, 1.5, 9.0, "drop")],
        "VendorID bigint, Airport_fee double, airport_FEE double, other string",
    )
    rows = conform(df, CONTRACT).orderBy("operator_code").collect()
    assert [row.asDict() for row in rows] == [
        {"operator_code": "1", "airport_fee": 5.0},
        {"operator_code": "2", "airport_fee": 1.5},
    ]


def test_uncastable_values_become_null_and_are_counted(spark):
    df = spark.createDataFrame(
        [("2024-01-02 03:04:05", math.nan, "oops"), ("never", 3.7, "2.5"), (None, None, None)],
        "pick string, passenger_count double, airport_fee string",
    )
    rows = conform(df, CONTRACT).collect()
    assert [row["passenger_count"] for row in rows] == [None, 3, None]
    assert [row["airport_fee"] for row in rows] == [None, 2.5, None]
    lost = {row["column"]: row["lost"] for row in cast_losses(df, CONTRACT).collect()}
    assert lost == {"pickup_ts": 1, "passenger_count": 1, "airport_fee": 1}


def test_too_large_a_number_is_null_not_wrapped(spark):
    df = spark.createDataFrame([(2**40,), (7,)], "passenger_count bigint")
    assert [r[0] for r in conform(df, CONTRACT).collect()] == [None, 7]


def test_conform_twice_is_conform_once(spark):
    df = spark.createDataFrame([(" a ", " n ")], "vendorid string, flag string")
    once = align(conform(df, CONTRACT), CONTRACT)
    itself = FeedContract("x", {name: name for name in CONTRACT.columns}, (2024, 1), 2024)
    assert align(conform(once, itself), itself).collect() == once.collect()


def test_variants_union_in_any_order(spark):
    early = spark.createDataFrame([("a", 1)], "VENDORID string, passenger_count bigint")
    late = spark.createDataFrame([(2.0, " y ")], "passenger_count double, Flag string")
    one = conform_variants([early, late], CONTRACT)
    other = conform_variants([late, early], CONTRACT)
    assert one.columns == list(CONTRACT.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert {(r["passenger_count"], r["store_and_fwd_flag"]) for r in one.collect()} == {(1, None), (2, "Y")}


def test_old_files_read_null_in_a_column_that_joined_later(spark, tmp_path):
    path = f"{tmp_path}/table"
    small = FeedContract("x", {"vendorid": "operator_code"}, (2024, 1), 2024)
    first = spark.createDataFrame([("a", 2024, 1)], "operator_code string, year int, month int")
    second = spark.createDataFrame([("b", 9.0, 2024, 2)], "operator_code string, airport_fee double, year int, month int")
    overwrite_periods(first, path)
    overwrite_periods(second, path)
    assert read_periods(spark, path, small).count() == 2
    grown = read_periods(spark, path, CONTRACT).select("operator_code", "airport_fee", "month")
    assert {tuple(r) for r in grown.collect()} == {("a", None, 1), ("b", 9.0, 2)}


def test_projection_is_one_step_without_python(spark):
    df = spark.createDataFrame([(1.0, 2.0)], BRONZE_SCHEMAS["fhv"].split(",")[3] + ", sr_flag double")
    conformed = align(conform(df.withColumn("x", F.lit(1)), CONTRACTS["fhv"]), CONTRACTS["fhv"])
    plan = conformed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1 and "Python" not in plan
