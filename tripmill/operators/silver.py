"""De-duplication, validity, reconciliation and the choice of periods to load."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import share
from tripmill.operators.contracts import PERIOD

SLICE, SLICE_ROWS = "slice__", 500_000


def dedup_with_counts(conformed: DataFrame) -> DataFrame:
    """Whole-row de-duplication that remembers how many copies each row stood for.

    A grouped count is combined on the map side first, so however many copies of one row
    exist, at most one per task crosses the single shuffle.
    """
    return conformed.groupBy(*conformed.columns).agg(F.count(F.lit(1)).alias("copies"))


def dedup_by_month(conformed: DataFrame) -> DataFrame:
    """The same rows, each month together, so that they are written by the month without a second shuffle.

    Rows are dealt by month and, in slices of about ``SLICE_ROWS``, by their hash: copies always meet. The largest month
    is counted first, in a scan of two columns. Raw rows cross the shuffle, so a row with very many copies is
    counted in one task, in one group.
    """
    largest = conformed.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64(*conformed.columns), F.lit(1 + largest // SLICE_ROWS)).alias(SLICE)
    dealt = conformed.select("*", own).repartition(*PERIOD, SLICE)
    return dealt.groupBy(*conformed.columns, SLICE).agg(F.count(F.lit(1)).alias("copies")).drop(SLICE)


def is_valid() -> Column:
    """Both times present, and the pickup inside the period of the file it came from.

    Compares data with the partition columns, so nothing could be pushed to the scan; the
    plain form keeps it in generated code.
    """
    pickup = F.col("pickup_ts")
    return (
        pickup.isNotNull()
        & F.col("dropoff_ts").isNotNull()
        & (F.year(pickup) == F.col("year"))
        & (F.month(pickup) == F.col("month"))
    )


def mark_valid(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.withColumn("accepted", is_valid())


def keep_valid(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.filter(is_valid()).drop("copies")


def stage_counts(marked: DataFrame, feed: str) -> DataFrame:
    """Raw, de-duplicated and clean rows per month. ``marked``: copies, accepted, year, month."""
    counts = marked.groupBy(*PERIOD).agg(
        F.sum("copies").alias("raw"),
        F.count(F.lit(1)).alias("dedup"),
        F.count_if("accepted").alias("clean"),
    )
    return counts.select(F.lit(feed).alias("feed"), *PERIOD, "raw", "dedup", "clean")


def removed_columns() -> list[Column]:
    removed = F.col("raw") - F.col("clean")
    return [
        removed.alias("removed"),
        share(removed, F.greatest(F.col("raw"), F.lit(1))).alias("removed_pct"),
    ]


def reconcile(marked: Mapping[str, DataFrame]) -> DataFrame:
    """Month, year and feed levels of the stage counts. Year and month are null on the levels
    above them. The roll-up only sees one row per feed and month."""
    months = [stage_counts(frame, feed) for feed, frame in marked.items()]
    levels = (
        reduce(lambda left, right: left.unionByName(right), months)
        .rollup("feed", *PERIOD)
        .agg(*(F.sum(stage).alias(stage) for stage in ("raw", "dedup", "clean")))
        .filter(F.col("feed").isNotNull())
    )
    return levels.select("feed", *PERIOD, "raw", "dedup", "clean", *removed_columns())


def pending_periods(candidates: DataFrame, loaded: DataFrame, full_load: bool = False) -> DataFrame:
    """Periods to process: all of them on a full load, else those not loaded yet."""
    wanted = candidates.select("feed", *PERIOD).distinct()
    if full_load:
        return wanted
    return wanted.join(loaded.select("feed", *PERIOD).distinct(), ["feed", *PERIOD], "left_anti")
