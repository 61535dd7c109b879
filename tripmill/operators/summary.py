"""Additive summary of the fact: mergeable states per month and combination of keys.

A state is a count of trips and, per money measure, the sum of its amounts in cents and the number of rows that hold one.
States of different months, or of parts of one, merge by addition, so the summary is kept by the month like the fact, and
everything that is a sum, a count or a mean of these over any of the keys is answered from it (``mart.summarised``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import MONEY

KEYS = (
    "service_id",
    "pickup_place_id",
    "distance_band_id",
    "time_band_id",
    "tip_status_id",
    "congestion_status_id",
    "core_fee_status_id",
    "year_month",
    "year",
    "month",
)
MEASURES = ("fare", "tip", "tolls", "airport_fee", "congestion_fee", "core_zone_fee", "other_fees")


def cents_name(measure: str) -> str:
    return f"{measure}_cents"


def valued_name(measure: str) -> str:
    return f"{measure}_valued"


def summarise(fact: DataFrame) -> DataFrame:
    """One aggregate with map-side combine; NaN and amounts beyond the type have no part in a sum or a mean."""
    amount = lambda measure: F.col(measure).try_cast(MONEY)
    sums = [F.sum(amount(measure)).alias(cents_name(measure)) for measure in MEASURES]
    valued = [F.count(amount(measure)).alias(valued_name(measure)) for measure in MEASURES]
    return fact.groupBy(*KEYS).agg(F.sum("trips").alias("trips"), *sums, *valued)


def merge(states: DataFrame, *keys: str) -> DataFrame:
    """States of fewer keys out of states of more."""
    added = [name for name in states.columns if name == "trips" or name.endswith(("_cents", "_valued"))]
    return states.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in added))


def mean(measure: str) -> Column:
    return F.try_divide(F.col(cents_name(measure)).cast("double"), F.col(valued_name(measure)).cast("double"))
