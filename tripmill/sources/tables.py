"""Silver and gold tables as plain Parquet folders."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripmill.operators.contracts import PERIOD, FeedContract
from tripmill.sources import ledger
from tripmill.sources.files import age, claim, delete, folder_names, path_exists
from tripmill.sources.ledger import LOAD

VERSION = "version="
CLAIM = "_CLAIMED"


# ---------------------------------------------------------------- silver


ACCEPTED = "accepted"
# Of the large tables: digests of hexadecimal digits take half the bytes that they take by default.
CODEC = "zstd"


def overwrite_periods(
    df: DataFrame, path: str, partition_by: Sequence[str] = PERIOD, gather: bool = True
) -> None:
    """Create the table, or replace just the partitions present in ``df``.

    ``gather`` shuffles by period first, so that each gets few files; adaptive execution splits a
    period that is far larger than the others, so no key needs a salt. Without it every task
    writes to every period it holds, which is right for one or a few periods.
    """
    gathered = df.hint("rebalance", *PERIOD) if gather else df
    (
        gathered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", CODEC)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_silver(marked: DataFrame, path: str, load_id: str, gather: bool = True) -> None:
    """Write de-duplicated rows with their verdict, below a folder of the load: the accepted ones of the loads that count are
    the silver table. Both sides of a month lie in its one partition, so a reload replaces the month whole. One job, and
    afterwards every stage count can be read off the written rows, which (unlike metrics gathered while writing) stay
    right when tasks are run again.

    ``gather`` False saves the second shuffle after the one that de-duplicates: right for a load of a few
    periods, where a file per task and period still has a good size.
    """
    overwrite_periods(marked.withColumn(LOAD, F.lit(load_id)), path, (LOAD, *PERIOD), gather)


def read_load(spark: SparkSession, path: str, load_id: str) -> DataFrame:
    """Verdict and copies of the rows of one load; reads two narrow columns of its own folder."""
    ddl = f"copies bigint, {ACCEPTED} boolean, {LOAD} string, year int, month int"
    return spark.read.schema(ddl).parquet(path).filter(F.col(LOAD) == load_id)


def read_silver(spark: SparkSession, path: str, contract: FeedContract, months: DataFrame | None = None) -> DataFrame:
    """Accepted rows of the loads that count, under the contract's current schema. Loads are read by the schema they were
    written with and lifted to it, so a column may join, leave or change its type between loads; no footer merging is needed. ``months`` (year, month) restricts the read to their folders.
    A table without a record of runs is read as it lies."""
    root, _, feed = path.rstrip("/").rpartition("/")
    if not ledger.has_runs(spark, root):
        rows = spark.read.schema(f"{contract.ddl}, {ACCEPTED} boolean").parquet(path)
        chosen = rows if months is None else rows.join(F.broadcast(months.select(*PERIOD)), list(PERIOD), "left_semi")
        return chosen.filter(ACCEPTED).select(*contract.columns, *PERIOD)
    current = ledger.current_months(spark, root).filter(F.col("feed") == feed)
    if months is not None:
        current = current.join(months.select(*PERIOD), list(PERIOD), "left_semi")
    parts = []
    for ddl, keys in (ledger.keys_by_schema(spark, root, current) or {None: []}).items():
        rows = spark.read.schema(f"{ddl or f'{contract.ddl}, {ACCEPTED} boolean'}, {LOAD} string").parquet(path)
        parts.append(lifted(ledger.in_folders(rows, keys, LOAD).filter(ACCEPTED), contract))
    return reduce(lambda left, right: left.unionByName(right), parts)


def lifted(rows: DataFrame, contract: FeedContract) -> DataFrame:
    """Rows of an older schema under the current contract: types widened by a lenient cast, absent columns null."""
    types = dict(rows.dtypes)

    def column(name: str) -> Column:
        wanted = contract.type_of(name)
        if name not in types:
            return F.lit(None).cast(wanted).alias(name)
        return F.col(name) if types[name] == wanted else F.col(name).try_cast(wanted).alias(name)

    return rows.select(*map(column, contract.columns), *PERIOD)


def read_periods(spark: SparkSession, path: str, contract: FeedContract) -> DataFrame:
    """A plain period-partitioned table under the contract's schema."""
    return spark.read.schema(contract.ddl).parquet(path)


def tolerant_silver(
    spark: SparkSession, root: str, contracts: Mapping[str, FeedContract], months: DataFrame | None = None
) -> tuple[dict[str, DataFrame], list[str]]:
    """Every feed that has a silver table, and the names of those that have none."""
    found, missing = {}, []
    for feed, contract in contracts.items():
        path = f"{root}/{feed}"
        if path_exists(spark, path):
            found[feed] = read_silver(spark, path, contract, months)
        else:
            missing.append(feed)
    if not found:
        raise FileNotFoundError(f"no silver table below {root}")
    return found, missing


def loaded_periods(spark: SparkSession, root: str, feeds: Sequence[str]) -> DataFrame:
    """Periods of which silver holds an accepted row, as the ledger has them; silver is not read. Tables without a record of
    runs are read as they lie, two narrow columns of them."""
    if not ledger.has_runs(spark, root):
        empty = spark.createDataFrame([], "feed string, year int, month int")
        lying = [feed for feed in feeds if path_exists(spark, f"{root}/{feed}")]
        ddl = f"{ACCEPTED} boolean, year int, month int"
        rows = [spark.read.schema(ddl).parquet(f"{root}/{feed}").filter(ACCEPTED).select(F.lit(feed).alias("feed"), *PERIOD) for feed in lying]
        return reduce(lambda left, right: left.unionByName(right), rows, empty).distinct()
    months = ledger.current_months(spark, root).filter(F.col("feed").isin(*feeds))
    return months.filter(F.col("clean") > 0).select("feed", *PERIOD)


# ---------------------------------------------------------------- gold


def _versions(spark: SparkSession, table_path: str) -> list[tuple[int, str]]:
    names = folder_names(spark, table_path)
    return sorted((int(name[len(VERSION):]), name) for name in names if name.startswith(VERSION))


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    """Path of the newest complete version: a version counts once its job has committed."""
    for _, name in reversed(_versions(spark, f"{root}/{table}")):
        path = f"{root}/{table}/{name}"
        if path_exists(spark, f"{path}/_SUCCESS"):
            return path
    return None


def next_version(spark: SparkSession, root: str, table: str) -> str:
    """Folder of a version that is this caller's alone: the number is claimed by creating a file, and whoever comes second takes
    the next one."""
    versions = _versions(spark, f"{root}/{table}")
    number = versions[-1][0] + 1 if versions else 1
    while not claim(spark, f"{root}/{table}/{VERSION}{number:06d}/{CLAIM}"):
        number += 1
    return f"{root}/{table}/{VERSION}{number:06d}"


def publish(
    df: DataFrame, root: str, table: str, partition_by: Sequence[str] = (), gather: bool = True
) -> str:
    """Write the next version of a table. Readers see the old version until this one has
    committed, and the new one after; nothing is replaced in place. ``gather`` False skips the
    shuffle by partition, for rows that already lie in partition order."""
    path = next_version(df.sparkSession, root, table)
    gathered = df.hint("rebalance", *partition_by) if gather else df
    gathered.write.mode("append").partitionBy(*partition_by).parquet(path)
    return path


def publish_after(
    spark: SparkSession,
    root: str,
    table: str,
    build: Callable[[DataFrame | None], DataFrame],
    patience: float = 600.0,
    pause: float = 0.5,
) -> str:
    """Write the version that follows the current one and is made from it by ``build`` (which gets None where there is none).

    Only who claims the next number builds on the current version; whoever finds it claimed waits for it and builds on what
    it brought, so of several writers none loses what another has added. A claim older than ``patience`` seconds without a
    version is taken for that of a writer that died, and passed over.
    """
    passed = 0
    while True:
        base = current_version(spark, root, table)
        number = max(passed, int(base.rpartition(VERSION)[2]) if base else 0) + 1
        path = f"{root}/{table}/{VERSION}{number:06d}"
        if claim(spark, f"{path}/{CLAIM}"):
            build(spark.read.parquet(base) if base else None).hint("rebalance").write.mode("append").parquet(path)
            return path
        if not path_exists(spark, f"{path}/_SUCCESS"):
            if age(spark, f"{path}/{CLAIM}") > patience:
                passed = number
            else:
                time.sleep(pause)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    path = current_version(spark, root, table)
    if path is None:
        raise FileNotFoundError(f"table {table} has no complete version below {root}")
    return spark.read.parquet(path)


def expire_versions(spark: SparkSession, root: str, table: str, keep: int) -> list[str]:
    """Delete all but the ``keep`` newest complete versions and what is newer than those; returns their folders."""
    names = [name for _, name in _versions(spark, f"{root}/{table}")]
    complete = [name for name in names if path_exists(spark, f"{root}/{table}/{name}/_SUCCESS")]
    if keep < 1 or len(complete) <= keep:
        return []
    old = names[: names.index(complete[-keep])]
    for name in old:
        delete(spark, f"{root}/{table}/{name}")
    return old


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
