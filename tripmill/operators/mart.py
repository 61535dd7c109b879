"""Denormalised mart over the star: only the dimensions that the wanted columns need are joined."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import MONEY
from tripmill.operators.contracts import Vocabulary
from tripmill.operators.summary import KEYS as SUMMARY_KEYS, cents_name, valued_name

Star = Mapping[str, DataFrame]
ALL = "ALL"
SUMMARY = "trip_summary"
YEAR_MONTH = re.compile(r"[0-9]{4}-[0-9]{2}")


@dataclass(frozen=True)
class DimJoin:
    """One role of a dimension: fact key, dimension key, mart column -> dimension column."""

    dim: str
    fact_key: str
    dim_key: str
    outputs: Mapping[str, str]


JOINS = (
    DimJoin("dim_service", "service_id", "service_id", {"service_group": "service_group"}),
    DimJoin("dim_operator", "operator_id", "operator_id", {"operator": "operator"}),
    DimJoin(
        "dim_place",
        "pickup_place_id",
        "place_id",
        {
            "pickup_district": "district",
            "pickup_zone": "zone",
            "pickup_service_zone": "service_zone",
            "pickup_region_group": "region_group",
        },
    ),
    DimJoin(
        "dim_place",
        "dropoff_place_id",
        "place_id",
        {"dropoff_district": "district", "dropoff_zone": "zone"},
    ),
    DimJoin(
        "dim_distance_band",
        "distance_band_id",
        "distance_band_id",
        {"distance_band": "distance_band", "distance_description": "distance_description"},
    ),
    DimJoin("dim_time_band", "time_band_id", "time_band_id", {"time_band": "time_band"}),
    DimJoin("dim_tip_status", "tip_status_id", "tip_status_id", {"tipped": "tipped"}),
    DimJoin(
        "dim_congestion_status",
        "congestion_status_id",
        "congestion_status_id",
        {"congestion_charged": "congestion_charged"},
    ),
    DimJoin(
        "dim_congestion_status",
        "core_fee_status_id",
        "congestion_status_id",
        {"core_fee_charged": "congestion_charged"},
    ),
)
FACT_COLUMNS = (
    "trip_id",
    "pickup_ts",
    "year_month",
    "duration_s",
    "distance_mi",
    "fare",
    "tip",
    "tolls",
    "improvement_fee",
    "airport_fee",
    "congestion_fee",
    "core_zone_fee",
    "fund_fee",
    "other_fees",
    "trips",
)
PERIOD_TEXT = ("year", "month")
# The core-zone fee has its own flag; it joins the mart only where it is asked for.
ON_REQUEST = ("core_fee_charged",)
MART_COLUMNS = (
    *FACT_COLUMNS,
    *PERIOD_TEXT,
    *(name for join in JOINS for name in join.outputs if name not in ON_REQUEST),
    "tip_flag",
)


def join_dims(star: Star, joins: Sequence[DimJoin], how: str = "left", fact: DataFrame | None = None) -> DataFrame:
    """Fact with the given dimension roles joined on.

    Dimensions are written tables, so the optimizer knows their size: it broadcasts those under
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joins a larger one.
    """
    joined = star["fact_trip"] if fact is None else fact
    for join in joins:
        role = f"{join.fact_key}__dim"
        dim = star[join.dim].select(
            F.col(join.dim_key).alias(role),
            *(F.col(source).alias(name) for name, source in join.outputs.items()),
        )
        joined = joined.join(dim, joined[join.fact_key] == dim[role], how).drop(role)
    return joined


def trip_mart(star: Star, words: Vocabulary, want: Sequence[str] = MART_COLUMNS) -> DataFrame:
    """Left join of the dimensions behind ``want``; year and month become text categories."""
    unknown = sorted(set(want) - {*MART_COLUMNS, *ON_REQUEST})
    if unknown:
        raise ValueError(f"not mart columns: {unknown}")
    needed = set(want) | ({"tipped"} if "tip_flag" in want else set())
    joined = join_dims(star, [join for join in JOINS if needed & set(join.outputs)])

    def output(name: str) -> Column:
        if name in PERIOD_TEXT:
            return F.col(name).cast("string").alias(name)
        if name == "tip_flag":
            return F.when(F.col("tipped") == words.yes, 1.0).otherwise(0.0).alias(name)
        return F.col(name)

    return joined.select(*(output(name) for name in want))


def as_text_period(df: DataFrame) -> DataFrame:
    """Year and month, where present, as text categories."""
    return df.withColumns({name: F.col(name).cast("string") for name in PERIOD_TEXT if name in df.columns})


@dataclass(frozen=True)
class Part:
    """A partial of an additive measure: how the fact gives it, and how the states of its summary do."""

    alias: str
    of_fact: Column
    of_summary: Column


@dataclass(frozen=True)
class Condition:
    """A condition in the columns of the fact, where the scan can apply it, and in the keys of the summary."""

    of_fact: Column
    of_summary: Column


def trips_part(alias: str = "trips") -> Part:
    """Rows of the fact, each of which is one trip."""
    return Part(alias, F.count(F.lit(1)), F.sum("trips"))


def tipped_part(alias: str) -> Part:
    """Trips with a tip, whose flag is a key of the summary."""
    flagged = F.sum(F.when(F.col("tip_status_id") == 1, F.col("trips")).otherwise(F.lit(0)))
    return Part(alias, F.count_if(F.col("tip") > 0), flagged)


def cents_part(measure: str, alias: str) -> Part:
    """Sum of the amounts, each in whole cents."""
    return Part(alias, F.sum(F.col(measure).try_cast(MONEY)), F.sum(cents_name(measure)))


def valued_part(measure: str, alias: str) -> Part:
    """Rows whose measure is an amount; NaN and amounts beyond the type have no part in a mean."""
    return Part(alias, F.count(F.col(measure).try_cast(MONEY)), F.sum(valued_name(measure)))


def summarised(
    star: Star,
    columns: Sequence[str],
    partials: Sequence[Part | Column],
    where: Column | Condition | None = None,
    how: str = "left",
) -> DataFrame:
    """``partials`` per combination of mart ``columns``, not yet merged where labels coincide.

    The fact is aggregated by its keys first and the dimensions are joined to that small result.
    So the join sees one row per key combination, however many trips share one, and no dimension
    needs to fit a broadcast. Where the star has a summary that holds all of the keys, and the partials are additive, the fact is
    not read at all. ``where`` is a condition on keys (periods and flags), or one for either source. Callers filter on the
    labels and aggregate the partials again.
    """
    joins = [join for join in JOINS if set(columns) & set(join.outputs)]
    own = [name for name in columns if not any(name in join.outputs for join in joins)]
    keys = dict.fromkeys([*own, *(join.fact_key for join in joins)])
    small = SUMMARY in star and all(isinstance(part, Part) for part in partials) and set(keys) <= set(SUMMARY_KEYS)
    source = star[SUMMARY] if small else star["fact_trip"]
    if isinstance(where, Condition):
        where = where.of_summary if small else where.of_fact
    chosen = source if where is None else source.filter(where)
    merged = [(part.of_summary if small else part.of_fact).alias(part.alias) if isinstance(part, Part) else part for part in partials]
    joined = join_dims(star, joins, how, chosen.groupBy(*keys).agg(*merged))
    wanted = {name for join in joins for name in join.outputs} - set(columns)
    return joined.drop(*wanted, *(key for key in keys if key not in columns))


def excluding(mart: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop the trips whose id is listed in a table of exclusions. Where both carry year and month, only the months that the
    list names meet it: the list's months come to the driver (one per month at most), the other months pass by, and the
    names of folders decide which is which."""
    listed = excluded.select("trip_id").distinct()
    if not {"trip_id", *PERIOD_TEXT} <= set(excluded.columns) or not set(PERIOD_TEXT) <= set(mart.columns):
        return mart.join(listed, "trip_id", "left_anti")
    months = sorted((int(row[0]), int(row[1])) for row in excluded.select(*PERIOD_TEXT).dropna().distinct().collect())
    named = reduce(lambda one, other: one | other, ((F.col("year") == y) & (F.col("month") == m) for y, m in months), F.lit(False))
    return mart.filter(~named).unionByName(mart.filter(named).join(listed, "trip_id", "left_anti"))


def _chosen(values: Sequence[str] | str | None) -> list[str] | None:
    """The values of a category filter; None for no filter."""
    if values is None or values == ALL or ALL in values:
        return None
    return [values] if isinstance(values, str) else list(values)


def period_condition(
    categories: Mapping[str, Sequence[str] | str | None] | None = None,
    ranges: Mapping[str, tuple[str | None, str | None]] | None = None,
) -> Column | None:
    """What dashboard filters say of the fact's year and month folders, as a condition on them, so that months outside are not
    opened: years and months by value, and a range of ``year_month``. It only repeats the filters, never replaces them."""
    conditions: list[Column] = []
    for name in PERIOD_TEXT:
        values = _chosen((categories or {}).get(name))
        if values is not None and all(value.isdigit() for value in values):
            conditions.append(F.col(name).isin(*map(int, values)))
    low, high = (ranges or {}).get("year_month", (None, None))
    number = F.col("year") * 100 + F.col("month")
    if low is not None and YEAR_MONTH.fullmatch(low):
        conditions.append(number >= int(low.replace("-", "")))
    if high is not None and YEAR_MONTH.fullmatch(high):
        conditions.append(number <= int(high.replace("-", "")))
    return reduce(lambda one, other: one & other, conditions) if conditions else None


def filter_by(
    df: DataFrame,
    categories: Mapping[str, Sequence[str] | str | None] | None = None,
    ranges: Mapping[str, tuple[str | None, str | None]] | None = None,
) -> DataFrame:
    """Dashboard filters. Category: a list of values; None, ALL or a list holding ALL means no filter.
    Range: inclusive bounds, None leaves a side open. A range of ``year_month`` bounds ``year`` too, by
    which the fact is partitioned, so months outside are not opened."""
    conditions: list[Column] = []
    if "year_month" in (ranges or {}) and "year" in df.columns:
        low, high = ranges["year_month"]
        if low is not None:
            conditions.append(F.col("year") >= low[:4])
        if high is not None:
            conditions.append(F.col("year") <= high[:4])
    for name, values in (categories or {}).items():
        chosen = _chosen(values)
        if chosen is not None:
            conditions.append(F.col(name).isin(*chosen))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            conditions.append(F.col(name) >= low)
        if high is not None:
            conditions.append(F.col(name) <= high)
    for condition in conditions:
        df = df.filter(condition)
    return df
