"""Zone lookup file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ZONE_SCHEMA = "place_id int, district string, zone string, service_zone string"
BROKEN = "broken_line"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true")
    # A line is broken or not whichever columns are asked for.
    return reader.option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", "false").csv(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header line; the schema is declared, so the file is read once."""
    return _read(spark, path, ZONE_SCHEMA)


def split_zones(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The zones whose line parses and names a place, and the lines that do not (path, line, reason)."""
    rows = _read(spark, path, f"{ZONE_SCHEMA}, {BROKEN} string")
    columns = [part.split()[0] for part in ZONE_SCHEMA.split(", ")]
    whole = F.col(BROKEN).isNull() & F.col("place_id").isNotNull()
    line = F.coalesce(F.col(BROKEN), F.concat_ws(",", *columns))
    reason = F.when(F.col(BROKEN).isNotNull(), "does not parse").otherwise("no place id")
    rejected = rows.filter(~whole).select(F.input_file_name().alias("path"), line.alias("line"), reason.alias("reason"))
    return rows.filter(whole).select(*columns), rejected
