"""Reading bronze files whose physical schema drifts from month to month, by Spark's own Parquet reader."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from tripmill.operators.contracts import PERIOD, FeedContract
from tripmill.sources.landing import ERROR_CHARS, rows_by_file, same_path

# What Spark says of files that it reached but cannot read, or whose schemas do not go together.
FORMAT_PROBLEMS = ("CANNOT_MERGE_SCHEMAS", "CANNOT_READ_FILE_FOOTER", "PARQUET_TYPE_", "PARQUET_COLUMN_")
AMBIGUOUS = "columns equal up to case need spark.sql.caseSensitive=true"


def _format_problem(failure: Exception) -> str | None:
    """What is wrong with the content of the files; None where they could not be reached."""
    cause = getattr(failure, "java_exception", None)
    if cause is None:
        text = str(failure)
        return text[:ERROR_CHARS] if any(word in text for word in FORMAT_PROBLEMS) else None
    told, name, message = False, "", ""
    while cause is not None:
        name, message = cause.getClass().getName(), cause.getMessage() or ""
        told |= any(word in message for word in FORMAT_PROBLEMS)
        cause = cause.getCause()
    unreached = name.startswith(("java.io.", "java.net.", "java.nio.")) and name != "java.io.EOFException"
    return f"{name.rsplit('.', 1)[-1]}: {message}"[:ERROR_CHARS] if told and not unreached else None


def _probing(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` that keeps spellings apart, so that they are seen."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.caseSensitive", "true")
    return session


def _schema(session: SparkSession, paths: Sequence[str], wanted: frozenset[str], folds_case: bool) -> StructType | str:
    """The wanted columns that files have in common types and spellings, or why they cannot be read as one. Spark merges
    the footers in a job."""
    try:
        found = session.read.options(mergeSchema=True, ignoreCorruptFiles=False).parquet(*paths).schema
    except (Py4JJavaError, PySparkException) as failure:
        problem = _format_problem(failure)
        if problem is None:  # one that can't be reached now is a crash, not a bad file
            raise
        return problem
    fields = sorted((f for f in found if f.name.lower() in wanted), key=lambda f: f.name)
    if folds_case and len({f.name.lower() for f in fields}) < len(fields):
        return AMBIGUOUS
    return StructType([StructField(f.name, f.dataType) for f in fields])


@dataclass(frozen=True)
class Inspection:
    """``variants``: paths by schema (as JSON). ``unreadable``: error by path. ``folders``: bytes by period folder that can be read
    whole."""

    variants: dict[str, list[str]]
    unreadable: dict[str, str]
    folders: dict[str, int]


def inspect(files: DataFrame, contract: FeedContract) -> Inspection:
    """Which files of a manifest cannot be read, and which can be read together. A period with an unreadable file is held back
    whole: were its other files loaded, it would count as loaded and never be completed.

    Broken files are those that a tolerant scan of the footers does not return. The folders that are left are halved until the
    footers of each part merge; months drift seldom, so v variants of n months take about v log n small jobs. Columns
    outside the contract do not tell variants apart in the end. The driver holds a path per period folder, and file paths
    only of folders whose own files disagree and of broken files.
    """
    spark = files.sparkSession
    session, wanted = _probing(spark), frozenset(contract.renames)
    folds_case = spark.conf.get("spark.sql.caseSensitive") != "true"

    def agreeing(paths: Iterable[str]) -> tuple[dict[str, list[str]], dict[str, str]]:
        together, refused = defaultdict(list), {}
        parts = [list(paths)]
        while parts:
            part = parts.pop()
            if not part:
                continue
            found = _schema(session, part, wanted, folds_case)
            if isinstance(found, StructType):
                together[found.json()] += part
            elif len(part) == 1:
                refused[part[0]] = found
            else:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
        return together, refused

    located = files.select("path", "length", *PERIOD, F.regexp_replace("path", r"/[^/]+$", "").alias("folder"))
    by_folder = located.groupBy("folder", *PERIOD).agg(F.sum("length").alias("length")).collect()
    folders = {row["folder"]: row["length"] for row in sorted(by_folder, key=lambda row: (row["year"], row["month"], row["folder"]))}
    if not folders:
        return Inspection({}, {}, {})
    seen = rows_by_file(spark, *folders).select("path")
    unseen = located.withColumn("key", same_path("path")).join(seen.withColumnRenamed("path", "key"), "key", "left_anti")
    _, unreadable = agreeing(row["path"] for row in unseen.select("path").collect())  # files without rows can be read

    def folder_of(path: str) -> str:
        return path.rpartition("/")[0]

    held_back = {folder_of(path) for path in unreadable}
    variants, disagreeing = agreeing(folder for folder in folders if folder not in held_back)
    if disagreeing:
        inside = defaultdict(list)
        for row in located.filter(F.col("folder").isin(*disagreeing)).select("folder", "path").collect():
            inside[row["folder"]].append(row["path"])
        for paths in inside.values():
            parts, refused = agreeing(sorted(paths))
            unreadable |= refused
            if not refused:
                for schema, some in parts.items():
                    variants[schema] += some
        held_back = {folder_of(path) for path in unreadable}
    return Inspection(dict(variants), unreadable, {f: size for f, size in folders.items() if f not in held_back})


def probed(files: DataFrame, contract: FeedContract) -> DataFrame:
    """``files`` (a manifest) with the ``error`` of those that cannot be read."""
    bad = list(inspect(files, contract).unreadable.items())
    errors = files.sparkSession.createDataFrame(bad, "path string, error string")
    return files.select("path", "length", "feed", *PERIOD).join(errors, "path", "left")


@dataclass(frozen=True)
class BronzeRead:
    """Frames of one feed, one per physical variant; the period folders and bytes they span; and
    the files that could not be read."""

    frames: list[DataFrame]
    periods: int
    size: int
    unreadable: list[tuple[str, str]]


def read_feed(spark: SparkSession, root: str, files: DataFrame, contract: FeedContract) -> BronzeRead:
    """One multi-path read per schema variant over the given manifest rows (see ``inspect``)."""
    found = inspect(files, contract)
    reader = spark.read.option("basePath", f"{root.rstrip('/')}/{contract.feed}")
    return BronzeRead(
        frames=[
            reader.schema(StructType.fromJson(json.loads(schema))).parquet(*sorted(paths))
            for schema, paths in sorted(found.variants.items())
        ],
        periods=len(found.folders),
        size=sum(found.folders.values()),
        unreadable=sorted(found.unreadable.items()),
    )
