"""Landed, silver and gold tables of the warehouse binding, built once per session and data folder.

Reports read gold tables, not the raw data, here as on a cluster. The tables live in the shared
scratch folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tripmill.operators.conform import align, conform
from tripmill.operators.contracts import PERIOD
from tripmill.operators.silver import dedup_by_month, dedup_with_counts, mark_valid
from tripmill.plans import warehouse
from tripmill.plans.pipeline import Layout, load_silver, new_load_id, read_star, run_gold, with_summary
from tripmill.session import scratch_path
from tripmill.sources.tables import CODEC, read_silver

Layer = TypeVar("Layer")
_OPENED: dict[tuple[str, str, str], object] = {}


def _opened(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], Layer]) -> Layer:
    """What ``build`` returned for its fresh folder. Frames over written tables are plans, so
    opening a layer once saves listing its folders and reading schemas for every query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPENED:
        _OPENED[key] = build(scratch_path(spark, name))
    return _OPENED[key]


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip records of all feeds, one folder per feed."""

    def build(path: str) -> DataFrame:
        warehouse.derive_trips(spark, sf_dir).write.option("compression", CODEC).partitionBy("feed").parquet(path)
        return spark.read.parquet(path)

    return _opened(spark, sf_dir, "landed", build)


def raw_feed(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    return warehouse.raw_feed(landed(spark, sf_dir), feed)


def write_bronze(raw: DataFrame, path: str, gather: bool = True) -> None:
    """A feed in its own spelling, one folder a month. ``gather`` False saves a shuffle of all rows: every task of the scan
    brings each month a file, and silver's own shuffle gathers the months."""
    gathered = raw.hint("rebalance", *PERIOD) if gather else raw
    gathered.write.option("compression", CODEC).partitionBy(*PERIOD).parquet(path)


def conformed_feed(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    contract = warehouse.CONTRACTS[feed]
    return align(conform(raw_feed(spark, sf_dir, feed), contract), contract)


def marked_feeds(
    spark: SparkSession, sf_dir: str, dedup: Callable[[DataFrame], DataFrame] = dedup_with_counts
) -> dict[str, DataFrame]:
    """De-duplicated rows with copies and verdict, per feed, not yet written."""
    return {feed: mark_valid(dedup(conformed_feed(spark, sf_dir, feed))) for feed in warehouse.FEEDS}


def build_silver(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    load_silver(spark, Layout("", path, ""), marked_feeds(spark, sf_dir, dedup_by_month), new_load_id(), gather=False)
    contracts = warehouse.CONTRACTS.items()
    return {feed: read_silver(spark, f"{path}/{feed}", contract) for feed, contract in contracts}


def silver_tables(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """Root folder and frames of the silver tables."""
    return _opened(spark, sf_dir, "silver", lambda path: (path, build_silver(spark, sf_dir, path)))


def silver_root(spark: SparkSession, sf_dir: str) -> str:
    return silver_tables(spark, sf_dir)[0]


def silver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return silver_tables(spark, sf_dir)[1]


def build_gold(spark: SparkSession, sf_dir: str, silver_path: str, path: str) -> dict[str, DataFrame]:
    layout = Layout(bronze="", silver=silver_path, gold=path)
    run_gold(spark, layout, warehouse.MODEL, warehouse.zones(spark, sf_dir))
    return with_summary(read_star(spark, path), spark, path)


def star_and_summary(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = silver_root(spark, sf_dir)
    return _opened(spark, sf_dir, "gold", lambda path: build_gold(spark, sf_dir, root, path))


def gold(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star alone: what is asked of it is worked out from the fact."""
    return {name: df for name, df in star_and_summary(spark, sf_dir).items() if name != "trip_summary"}
