"""What has been loaded: files by fingerprint, months by load, and the runs that count.

Every run writes its rows below a folder of its own in silver, then the files and months it took, and at the very end one
row to the table of runs. Only months of a run that has that row exist for readers, and of several such runs the last one
counts, so a run that dies between two feeds leaves everything as it was, and a reload replaces a month at once in all
feeds. The work of the next run is an anti-join on fingerprints (path, length, time of change): a late file, a replaced and a
removed one each make their month work again.

All tables here have one narrow row per file or month; silver itself is not read. What reaches the driver is one short
string per month of a feed, to prune the scan by folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.operators.contracts import PERIOD
from tripmill.sources.files import path_exists

KEY = ["feed", *PERIOD]
LOAD = "load_id"
FINGERPRINT = ["path", "length", "modified"]
FILES, PERIODS, RUNS, SCHEMAS = "load_files", "load_periods", "load_runs", "load_schemas"
STAGES = ("raw", "dedup", "clean")

FILE_DDL = f"path string, length bigint, modified timestamp, feed string, year int, month int, {LOAD} string"
PERIOD_DDL = f"feed string, year int, month int, raw bigint, dedup bigint, clean bigint, {LOAD} string"
SCHEMA_DDL = f"feed string, ddl string, {LOAD} string"
RUN_DDL = f"{LOAD} string, months bigint, clean bigint"


def _read(spark: SparkSession, silver: str, table: str, ddl: str) -> DataFrame:
    path = f"{silver}/{table}"
    return spark.read.schema(ddl).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], ddl)


def _append(df: DataFrame, silver: str, table: str) -> None:
    df.hint("rebalance").write.mode("append").parquet(f"{silver}/{table}")


def has_runs(spark: SparkSession, silver: str) -> bool:
    return path_exists(spark, f"{silver}/{RUNS}")


def begin(spark: SparkSession, silver: str, files: DataFrame, load_id: str) -> DataFrame:
    """Write down the files that a run is about to take, before it reads them: one listing serves the whole run, and a file that
    changes meanwhile is work again next time. Returns them as written."""
    columns = [*FINGERPRINT, *KEY]
    _append(files.select(*columns, F.lit(load_id).alias(LOAD)), silver, FILES)
    return _read(spark, silver, FILES, FILE_DDL).filter(F.col(LOAD) == load_id).select(*columns)


def schema_of(written: DataFrame) -> str:
    """The types that a load wrote, as a schema to read it by."""
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in written.schema.fields if field.name != LOAD)


def commit(spark: SparkSession, silver: str, months: DataFrame, load_id: str, schemas: Mapping[str, str] | None = None) -> None:
    """``months``: feed, year, month and stage counts of all that the run has written. ``schemas``: feed to the types it was
    written with, by which it will be read, whatever its contract says then. The run counts from here on."""
    if schemas:
        _append(spark.createDataFrame([(feed, ddl, load_id) for feed, ddl in schemas.items()], SCHEMA_DDL), silver, SCHEMAS)
    counts = (F.coalesce(stage, F.lit(0)).cast("bigint").alias(stage) for stage in STAGES)
    _append(months.select(*KEY, *counts, F.lit(load_id).alias(LOAD)), silver, PERIODS)
    own = _read(spark, silver, PERIODS, PERIOD_DDL).filter(F.col(LOAD) == load_id)
    total = own.agg(F.count(F.lit(1)).alias("months"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"))
    _append(total.select(F.lit(load_id).alias(LOAD), "months", "clean").coalesce(1), silver, RUNS)


def current_months(spark: SparkSession, silver: str) -> DataFrame:
    """The months of all feeds with the load that counts and its stage counts."""
    runs = _read(spark, silver, RUNS, RUN_DDL).select(LOAD)
    months = _read(spark, silver, PERIODS, PERIOD_DDL).join(runs, LOAD, "left_semi")
    last = months.groupBy(*KEY).agg(F.max_by(F.struct(LOAD, *STAGES), LOAD).alias("last"))
    return last.select(*KEY, "last.*")


def loaded_files(spark: SparkSession, silver: str) -> DataFrame:
    """The files behind the months that count."""
    current = current_months(spark, silver).select(*KEY, LOAD)
    return _read(spark, silver, FILES, FILE_DDL).join(current, [*KEY, LOAD], "left_semi").drop(LOAD)


def changed_months(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Months whose files are not those that were loaded. A month of which all files are gone is kept as it is."""
    both = [*KEY, *FINGERPRINT]
    fresh = files.join(loaded, both, "left_anti").select(*KEY)
    gone = loaded.join(files, both, "left_anti").select(*KEY).join(files.select(*KEY), KEY, "left_semi")
    return fresh.unionByName(gone).distinct()


def keys_by_schema(spark: SparkSession, silver: str, current: DataFrame) -> dict[str | None, list[str]]:
    """``folder_keys`` of months of one feed, apart by the schema of their load; None where a load has none on record."""
    schemas = _read(spark, silver, SCHEMAS, SCHEMA_DDL).dropDuplicates(["feed", LOAD])
    rows = current.join(schemas, ["feed", LOAD], "left").select(F.concat_ws("/", LOAD, *PERIOD), "ddl").collect()
    found: dict[str | None, list[str]] = {}
    for key, ddl in sorted(map(tuple, rows), key=lambda row: row[0]):
        found.setdefault(ddl, []).append(key)
    return found


def folder_keys(months: DataFrame, batch: str) -> list[str]:
    """One short string per month, ``batch/year/month``."""
    return sorted(row[0] for row in months.select(F.concat_ws("/", batch, *PERIOD)).collect())


def in_folders(df: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Rows of those folders; only partition columns are compared, so other folders are not opened."""
    return df.filter(F.concat_ws("/", batch, *PERIOD).isin(keys) if keys else F.lit(False))
