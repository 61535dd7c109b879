"""The ten analytical reports. Each takes the star and joins only the dimensions it names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripmill.functions import half_up, share
from tripmill.operators.contracts import PlaceRules, Vocabulary
from tripmill.operators.mart import JOINS, Condition, Star, cents_part, join_dims, summarised, tipped_part, trips_part, valued_part
from tripmill.operators.sampling import hash_sample

SERVICE = tuple(join for join in JOINS if join.fact_key == "service_id")
INNER = "inner"
POSITIVE = 1  # of a status flag: the amount is above 0

Period = tuple[int, int]


def _tipped() -> Condition:
    return Condition(F.col("tip") > 0, F.col("tip_status_id") == POSITIVE)


def _total_trips() -> Column:
    return F.sum("trips").alias("total_trips")


def _mean() -> Column:
    """Mean of amounts in whole cents (each is rounded to cents before it is summed)."""
    return F.try_divide(F.sum("cents").cast("double"), F.sum("valued").cast("double"))


def _in_groups(words: Vocabulary, groups: Sequence[str] | None) -> Column:
    return F.col("service_group").isin(groups or [words.metered_group, words.app_group])


def _in_period(period: Period) -> Column:
    year, month = period
    return (F.col("year") == year) & (F.col("month") == month)


def market_share(star: Star, words: Vocabulary, groups: Sequence[str] | None = None) -> DataFrame:
    counts = (
        summarised(star, ["year_month", "service_group"], [trips_part()], how=INNER)
        .filter(_in_groups(words, groups))
        .groupBy("year_month", "service_group")
        .agg(_total_trips())
    )
    month_total = F.sum("total_trips").over(Window.partitionBy("year_month"))
    share_pct = half_up(share(F.col("total_trips"), month_total), 2)
    return counts.withColumn("share_pct", share_pct).orderBy("year_month", "service_group")


def top_zones(star: Star, words: Vocabulary, k: int = 20, groups: Sequence[str] | None = None) -> DataFrame:
    return (
        summarised(star, ["pickup_zone", "service_group"], [trips_part()], how=INNER)
        .filter(_in_groups(words, groups))
        .groupBy("pickup_zone", "service_group")
        .agg(_total_trips())
        .orderBy(F.desc("total_trips"), "pickup_zone", "service_group")
        .limit(k)
    )


def tip_probability(star: Star, words: Vocabulary, groups: Sequence[str] | None = None) -> DataFrame:
    counts = (
        summarised(star, ["service_group"], [trips_part(), tipped_part("tipped")], how=INNER)
        .filter(_in_groups(words, groups))
        .groupBy("service_group")
        .agg(_total_trips(), F.sum("tipped").alias("tipped_trips"))
    )
    return counts.withColumn("tipped_pct", half_up(share(F.col("tipped_trips"), F.col("total_trips")), 1))


def tip_mean_paid(star: Star, words: Vocabulary, groups: Sequence[str] | None = None) -> DataFrame:
    return (
        summarised(star, ["service_group"], [valued_part("tip", "valued"), cents_part("tip", "cents")], _tipped(), INNER)
        .filter(_in_groups(words, groups))
        .groupBy("service_group")
        .agg(half_up(_mean(), 2).alias("mean_tip"))
    )


def scatter_key() -> Column:
    """Order of the sample: a digest over whole-number and text forms, the same in any engine."""
    cents = [F.floor(F.col(name) * 100.0 + 0.5).cast("string") for name in ("fare", "tip", "distance_mi")]
    places = [F.col(name).cast("string") for name in ("pickup_place_id", "dropoff_place_id")]
    when = F.date_format("pickup_ts", "yyyy-MM-dd HH:mm:ss")
    return F.md5(F.concat_ws("|", when, *places, *cents))


def tip_scatter(
    star: Star,
    words: Vocabulary,
    year: int,
    rows: int = 50_000,
    fare: tuple[float, float] = (1, 200),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    chosen = (F.col("year") == year) & (F.col("tip") > 0) & F.col("fare").between(*fare)
    trips = join_dims(star, SERVICE, INNER, star["fact_trip"].filter(chosen)).filter(_in_groups(words, groups))
    keyed = trips.select("service_group", "fare", "tip", "distance_mi", scatter_key().alias("sample_key"))
    return hash_sample(keyed, "sample_key", rows).drop("sample_key")


def monthly_volume(star: Star) -> DataFrame:
    return (
        summarised(star, ["year_month", "service_group"], [trips_part()], how=INNER)
        .groupBy("year_month", "service_group")
        .agg(_total_trips())
        .orderBy("year_month", "service_group")
    )


def tip_by_era(star: Star, words: Vocabulary, during: tuple[str, str] = ("2020-03", "2021-06")) -> DataFrame:
    month = F.col("year_month")
    era = (
        F.when(month < during[0], words.era_before)
        .when(month.between(*during), words.era_during)
        .otherwise(words.era_after)
    )
    return (
        summarised(star, ["year_month", "service_group"], [valued_part("tip", "valued"), cents_part("tip", "cents")], _tipped(), INNER)
        .groupBy("year_month", "service_group")
        .agg(half_up(_mean(), 2).alias("mean_tip"))
        .withColumn("era", era)
        .orderBy("year_month", "service_group")
    )


def _inside_core(rule: str, places: PlaceRules, words: Vocabulary) -> Column:
    """Three readings of "core zone": by service zone, by district, or by region group."""
    if rule == "service_zone":
        return F.col("pickup_service_zone").isin(*places.core_service_zones)
    if rule == "district":
        return F.col("pickup_district") == places.home_district
    if rule == "region":
        return F.col("pickup_region_group") == words.region_core
    raise ValueError(f"unknown core rule: {rule}")


def _core_columns(rule: str) -> list[str]:
    columns = {"service_zone": "pickup_service_zone", "region": "pickup_region_group"}
    return list(dict.fromkeys(["pickup_district", columns.get(rule, "pickup_district")]))


def core_zone_volume(
    star: Star, words: Vocabulary, places: PlaceRules, period: Period, rule: str = "service_zone"
) -> DataFrame:
    trips = summarised(star, ["service_group", *_core_columns(rule)], [trips_part()], _in_period(period), INNER)
    label = F.when(_inside_core(rule, places, words), words.zone_core).otherwise(words.zone_outside)
    return (
        trips.filter(F.col("pickup_district") == places.home_district)
        .withColumn("core_zone", label)
        .groupBy("service_group", "core_zone")
        .agg(_total_trips())
    )


def fee_kpi(star: Star, period: Period) -> DataFrame:
    paid, flagged = F.col("core_zone_fee") > 0, F.col("core_fee_status_id") == POSITIVE
    charged = Condition(_in_period(period) & paid, _in_period(period) & flagged)
    return (
        summarised(star, ["service_group"], [valued_part("core_zone_fee", "valued"), cents_part("core_zone_fee", "cents")], charged, INNER)
        .groupBy("service_group")
        .agg(
            half_up(F.sum("cents").cast("double"), 2).alias("total_fee"),
            half_up(_mean(), 2).alias("mean_fee"),
        )
    )


def before_after(
    star: Star,
    words: Vocabulary,
    places: PlaceRules,
    before: tuple[str, Period],
    after: tuple[str, Period],
    rule: str = "district",
) -> DataFrame:
    """``before`` and ``after``: (label, (year, month))."""
    periods = _in_period(before[1]) | _in_period(after[1])
    trips = summarised(star, ["year", "month", *_core_columns(rule)], [trips_part()], periods, INNER)
    inside = F.when(_inside_core(rule, places, words), words.district_inside).otherwise(words.district_outside)
    return (
        trips.withColumn("period", F.when(_in_period(before[1]), before[0]).otherwise(after[0]))
        .withColumn("region", inside)
        .groupBy("period", "region")
        .agg(_total_trips())
    )
