from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripmill.operators import mart, star
from tripmill.operators.contracts import OperatorRule
from tripmill.plans.trips import MODEL, PLACES, WORDS
from tripmill.sources import tables


def decode(spark, values, rule, column="operator_code", type_name="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} {type_name}")
    text = star.operator_text(star.decode_operator(df.columns, rule, WORDS), WORDS)
    return [r[0] for r in df.orderBy("i").select(text).collect()]


def test_operator_decode(spark):
    metered = MODEL.operators["yellow"]
    assert decode(spark, ["1", "2.0", "6", None], metered) == ["CMT", "VERIFONE", "OUTRO", "OUTRO"]
    assert decode(spark, [" hv0003 ", None], MODEL.operators["fhvhv"]) == ["HV0003", "DESCONHECIDO"]
    assert decode(spark, ["x"], OperatorRule("elsewhere")) == ["DESCONHECIDO"]


def test_service_classification(spark):
    rows = [
        ("yellow", "1", 1),
        ("green", None, 2),
        ("fhvhv", "HV0003", 3),
        ("fhvhv", "HV0005", 4),
        ("fhvhv", "HV0004", 5),
        ("fhvhv", "HV9999", 6),
        ("fhvhv", None, 6),
        ("fhv", "HV0003", 7),
        ("unheard", "HV0003", 6),
    ]
    df = spark.createDataFrame(rows, "feed string, operator_code string, want int")
    found = df.select(star.classify_service(MODEL.services, MODEL.default_service).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in found.collect())


def test_region_group_covers_the_declared_ids():
    assert len(PLACES.core_ids) == len(set(PLACES.core_ids)) == 36
    assert len(PLACES.airport_ids) == 3 and len(PLACES.unknown_ids) == 2


def test_dense_keys_equal_a_sorted_list(spark):
    names = [f"B{i * 7919 % 5000:05d}" for i in range(5000)] + ["B00001"] * 5000 + ["é", "", "a", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "operator string").repartition(8)
    keyed = star.dense_keys(df, "operator", "operator_id")
    found = [(r["operator_id"], r["operator"]) for r in keyed.orderBy("operator_id").collect()]
    assert found == list(enumerate(sorted(set(names), key=lambda n: n.encode()), start=1))


def test_operator_ids_are_stable(spark):
    first = star.operator_dim(spark.createDataFrame([("m",), ("c",)], "operator string"))
    again = star.operator_dim(spark.createDataFrame([("a",), ("m",), ("z",), ("b",)], "operator string"), first)
    assert {r["operator"]: r["operator_id"] for r in again.collect()} == {"c": 1, "m": 2, "a": 3, "b": 4, "z": 5}
    unchanged = star.operator_dim(spark.createDataFrame([("c",)], "operator string"), again)
    assert unchanged.count() == 5


def silver_app(spark):
    rows = [("HV0003", 1, 2, 5.0), ("HV0003", None, 2, None)]
    df = spark.createDataFrame(rows, "operator_code string, pickup_place_id int, dropoff_place_id int, fare double")
    contract = MODEL.contracts["fhvhv"]
    have = set(df.columns)
    moment = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")
    df = df.withColumns({"pickup_ts": moment, "dropoff_ts": moment, "year": F.lit(2024), "month": F.lit(1)})
    have |= {"pickup_ts", "dropoff_ts"}
    return df, {n: F.lit(None).cast(contract.type_of(n)) for n in contract.columns if n not in have}


def test_unify_does_not_depend_on_order_or_absent_columns(spark):
    bare, absent = silver_app(spark)
    full = bare.withColumns(absent)
    dispatch = full.select(*MODEL.contracts["fhv"].columns[:5], "year", "month")
    for app in (bare, full):
        one = star.unify({"fhvhv": app, "fhv": dispatch}, MODEL)
        other = star.unify({"fhv": dispatch, "fhvhv": app}, MODEL)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    # a column that the table lacks and a null one give the same row ids
    ids = [{r[0] for r in star.unify({"fhvhv": app}, MODEL).select("trip_id").collect()} for app in (bare, full)]
    assert ids[0] == ids[1] and len(ids[0]) == 2


def test_fact_has_no_null_and_keeps_real_fares(spark):
    bare, _ = silver_app(spark)
    unified = star.unify({"fhvhv": bare}, MODEL)
    operators = star.operator_dim(unified.select("operator"))
    fact = star.fact_trip(unified, operators, MODEL)
    assert len(fact.columns) == 27
    rows = fact.orderBy("fare").collect()
    assert [(r["fare"], r["pickup_place_id"]) for r in rows] == [(0.0, 0), (5.0, 1)]
    assert all(value is not None for r in rows for value in r)
    unknown = star.fact_trip(unified, operators.limit(0), MODEL)
    assert {r["operator_id"] for r in unknown.collect()} == {0}


def test_published_versions(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "t")
    tables.publish(spark.range(3), root, "t")
    reader = tables.read_table(spark, root, "t")
    tables.publish(spark.range(5), root, "t")
    assert reader.count() == 3 and tables.read_table(spark, root, "t").count() == 5
    (tmp_path / "t" / "version=000009").mkdir()  # a write that never committed
    assert tables.read_table(spark, root, "t").count() == 5
    assert tables.publish(spark.range(1), root, "t").endswith("version=000010")


def test_unknown_mart_column_is_refused(spark):
    with pytest.raises(ValueError, match="nonsense"):
        mart.trip_mart({}, WORDS, ["nonsense"])


def test_labels_come_from_the_vocabulary(spark):
    english = replace(WORDS, yes="YES", no="NO")
    dim = star.status_dim(spark, english, "tip_status", "tipped")
    assert [tuple(r) for r in dim.orderBy("tip_status_id").collect()] == [(1, "YES"), (2, "NO")]
