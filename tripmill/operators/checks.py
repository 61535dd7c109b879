"""Validation queries over the gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tripmill.operators.mart import Star


def row_counts(star: Star, tables: Sequence[str] | None = None) -> DataFrame:
    counts = [
        star[name].agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(name).alias("table_name"), "total_rows")
        for name in tables or star
    ]
    return reduce(lambda left, right: left.unionByName(right), counts)


def recent_months(star: Star, year: int) -> DataFrame:
    return (
        star["fact_trip"]
        .filter(F.col("year") == year)
        .groupBy("year_month")
        .agg(F.count(F.lit(1)).alias("total_trips"))
        .orderBy("year_month")
    )


def orphans(star: Star) -> DataFrame:
    """Place ids of the fact that the place dimension lacks, per role. Id 0 stands for a null
    place and is counted apart. Ids are counted first, so the joins see one row per id."""
    places = star["dim_place"].select("place_id")
    roles = []
    for role in ("pickup", "dropoff"):
        ids = star["fact_trip"].groupBy(F.col(f"{role}_place_id").alias("place_id")).agg(
            F.count(F.lit(1)).alias("trips")
        )
        lost = ids.join(places, "place_id", "left_anti")
        no_place = F.col("place_id") == 0
        roles.append(
            lost.agg(
                F.coalesce(F.sum(F.when(~no_place, F.col("trips"))), F.lit(0)).alias("orphan_trips"),
                F.coalesce(F.sum(F.when(no_place, F.col("trips"))), F.lit(0)).alias("no_place_trips"),
            ).select(F.lit(role).alias("role"), "orphan_trips", "no_place_trips")
        )
    return roles[0].unionByName(roles[1])
