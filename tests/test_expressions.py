from __future__ import annotations

import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tripmill.functions import band, clean_text, digest, flag, half_up, or_zero
from tripmill.operators.sampling import hash_sample
from tripmill.plans.trips import MODEL

PROPERTY = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
DISTANCES = {-0.5: 1, 0.0: 1, 0.99: 1, 1.0: 2, 3.0: 3, 5.0: 4, 10.0: 5, 20.0: 6, math.nan: 6}
HOURS = {0: 1, 5: 1, 6: 2, 9: 2, 10: 3, 12: 4, 14: 5, 17: 6, 20: 7, 23: 7}


def column(spark, values, type_name, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_distance_and_hour_bands(spark):
    found = column(spark, list(DISTANCES), "double", lambda v: band(v, MODEL.distance_cuts))
    assert found == list(DISTANCES.values())
    assert column(spark, list(HOURS), "int", lambda v: band(v, MODEL.hour_cuts)) == list(HOURS.values())


@PROPERTY
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=200))
def test_bands_are_total_and_monotone(spark, values):
    ordered = sorted(values)
    bands = column(spark, ordered, "double", lambda v: band(v, MODEL.distance_cuts))
    assert bands == sorted(bands) and set(bands) <= set(range(1, 7))


def test_flags_and_zeroes(spark):
    tips = [None, 0.0, -1.0, 0.01]
    assert column(spark, tips, "double", flag) == [2, 2, 2, 1]
    assert column(spark, [None, 2.0], "double", or_zero) == [0.0, 2.0]
    assert math.isnan(column(spark, [math.nan], "double", or_zero)[0])


def test_text_and_rounding(spark):
    assert column(spark, [" n ", "N", "", None], "string", clean_text) == ["N", "N", "", None]
    assert column(spark, [0.125, 2.5, 1.004], "double", lambda v: half_up(v, 2)) == [0.13, 2.5, 1.0]


def test_row_id_ignores_absent_columns_but_not_their_place(spark):
    df = spark.createDataFrame([("x", None), (None, "x")], "a string, b string").withColumn("c", F.lit(None).cast("int"))
    a, b, c = (F.col(name) for name in "abc")
    old = [r[0] for r in df.select(digest("f", [a, b])).collect()]
    grown = [r[0] for r in df.select(digest("f", [a, b, c])).collect()]
    assert old == grown and len(set(old)) == 2 and {len(row_id) for row_id in old} == {32}
    assert old != [r[0] for r in df.select(digest("g", [a, b])).collect()]


def test_hash_sample_is_the_exact_top(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    everything = sorted((r["key"], r["id"]) for r in df.collect())
    for rows in (1, 777, 20_000, 30_000):
        assert [(r["key"], r["id"]) for r in hash_sample(df, "key", rows).collect()] == everything[:rows]


def test_hash_sample_with_one_key_on_a_third_of_the_rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("0000")).otherwise(F.md5(F.col("id").cast("string")))
    df = spark.range(3_000).select(key.alias("key"), "id")
    expected = sorted((r["key"], r["id"]) for r in df.collect())[:1_200]
    assert sorted((r["key"], r["id"]) for r in hash_sample(df, "key", 1_200).collect()) == expected
