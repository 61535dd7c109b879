"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# A narrow lookup table of no more rows takes some 100 MB in each executor.
FEW_ROWS = 1_000_000


def build_session(app: str = "tripmill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver does. On a cluster it is
    shipped or installed (README)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def lookup(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow written table to look up by: sent to every executor while its rows are few, whatever the broadcast threshold
    says of its bytes, so that the wide side of the join is not shuffled; a larger one is joined as Spark chooses."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= FEW_ROWS else table


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named in ``spark.checkpoint.dir``. Only in local mode a
    temporary folder stands in for an unset one; a cluster must name it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tripmill-")
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never reused, so nothing needs clearing first."""
    return f"{scratch_root(spark)}/tripmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
