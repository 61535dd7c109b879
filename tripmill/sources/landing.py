"""What should have landed, what has, and what failed. All frames, no driver loop over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripmill.operators.contracts import PERIOD, FeedContract

MIN_FILE_BYTES = 1024
ERROR_CHARS = 200
ABSENT_CODES = (403, 404)
OK, SKIP_EXISTS, SKIP_404, FAIL = "OK", "SKIP_EXISTS", "SKIP_404", "FAIL"
KEY = ["feed", *PERIOD]


def _padded_month() -> Column:
    return F.lpad(F.col("month").cast("string"), 2, "0")


def file_name() -> Column:
    year = F.col("year").cast("string")
    return F.concat(F.col("feed"), F.lit("_tripdata_"), year, F.lit("-"), _padded_month(), F.lit(".parquet"))


def storage_key() -> Column:
    year = F.col("year").cast("string")
    folder = F.concat(F.col("feed"), F.lit("/year="), year, F.lit("/month="), _padded_month(), F.lit("/"))
    return F.concat(folder, file_name())


def feed_ranges(spark: SparkSession, contracts: list[FeedContract]) -> DataFrame:
    rows = [(c.feed, *c.first_period, c.last_year) for c in contracts]
    return spark.createDataFrame(rows, "feed string, first_year int, first_month int, last_year int")


def calendar(ranges: DataFrame) -> DataFrame:
    """Every expected period of every feed, with its storage key.

    ``ranges``: feed, first_year, first_month, last_year (all of its last year is expected).
    """
    months = F.sequence(
        F.make_date("first_year", "first_month", F.lit(1)),
        F.make_date("last_year", F.lit(12), F.lit(1)),
        F.make_ym_interval(F.lit(0), F.lit(1)),
    )
    periods = ranges.select("feed", F.explode(months).alias("first_day"))
    dated = periods.select("feed", F.year("first_day").alias("year"), F.month("first_day").alias("month"))
    return dated.select(*KEY, storage_key().alias("storage_key"))


LAYOUT = r"/([^/]+)/year=(\d{4})/month=(\d{1,2})/[^/]+\.parquet$"
OUTSIDE, NO_PARQUET, TOO_SMALL, UNREADABLE, HELD_BACK = (
    "outside the layout", "no parquet file", "too small", "cannot be read", "held back with its month",
)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with size and time of change. File contents are not read; Spark leaves out
    files of zero bytes, which therefore count as not there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` that lie where a feed's month belongs, with their period."""
    return listing(spark, root).filter(F.col("path").rlike(LAYOUT)).select(
        "path",
        "length",
        "modified",
        F.regexp_extract("path", LAYOUT, 1).alias("feed"),
        F.regexp_extract("path", LAYOUT, 2).cast("int").alias("year"),
        F.regexp_extract("path", LAYOUT, 3).cast("int").alias("month"),
    )


def rows_by_file(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, rows) of the Parquet files below some folders that have rows and can be read, from their footers: a scan that asks
    for no column and passes over what is broken."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true")
    paths = reader.schema("no_such_column string").parquet(*roots).select(F.col("_metadata.file_path").alias("path"))
    return paths.groupBy(same_path("path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))


def same_path(name: str) -> Column:
    """One spelling for the paths of local files, which Spark's sources spell with one slash or three."""
    return F.regexp_replace(name, "^file:/+", "file:/")


def accounted(spark: SparkSession, root: str, feeds: list[str], taken: DataFrame) -> DataFrame:
    """Every file below ``root``: path, length, feed and period where it has them, rows where it can be read, and ``reason``, why
    it was not taken, null for those that were. ``taken``: the files behind the months that count (path, length, modified).
    A month below the minimum size is too small as a whole; a good file of a month with a bad one is held back with it."""
    part = lambda number: F.regexp_extract("path", LAYOUT, number)
    inside = F.col("path").rlike(LAYOUT) & part(1).isin(*feeds)
    files = listing(spark, root).select(
        same_path("path").alias("path"), "length", "modified", *(
            F.when(inside, value).alias(name) for name, value in (("feed", part(1)), ("year", part(2).cast("int")), ("month", part(3).cast("int")))
        ),
    )
    months = files.filter("feed is not null").groupBy(*KEY).agg(F.sum("length").alias("month_length"))
    loaded = taken.select(same_path("path").alias("path"), "length", "modified", F.lit(True).alias("loaded"))
    told = files.join(rows_by_file(spark, root), "path", "left").join(months, KEY, "left").join(loaded, ["path", "length", "modified"], "left")
    reason = (
        F.when(F.col("loaded"), None)
        .when(~F.col("path").endswith(".parquet"), NO_PARQUET)
        .when(F.col("feed").isNull(), OUTSIDE)
        .when(F.col("month_length") < MIN_FILE_BYTES, TOO_SMALL)
        .when(F.col("rows").isNull(), UNREADABLE)
        .otherwise(HELD_BACK)
    )
    return told.select("path", "length", *KEY, "rows", reason.alias("reason"))


def large_enough() -> Column:
    return F.col("length") >= MIN_FILE_BYTES


def present_periods(files: DataFrame) -> DataFrame:
    """Periods with data: size is summed first, so part files count together."""
    return files.groupBy(*KEY).agg(F.sum("length").alias("length"))


def gap(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Work list: expected periods without a file of acceptable size."""
    landed = present.filter(large_enough()).select(*KEY).distinct()
    return expected.join(landed, KEY, "left_anti")


def status(expected: DataFrame, present: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcome of one landing run for each expected period.

    ``present``: feed, year, month of the files there before the run. ``attempts``: feed, year,
    month, length, http_code, error; one row per period tried, each of the last three may be null.
    A file that is too small and one that could not be read are failures; one that the source
    says it does not have, or that nobody tried, is an absence.
    """
    existing = present.select(*KEY).distinct().withColumn("existed", F.lit(True))
    tried = attempts.select(*KEY, "length", "http_code", "error")
    too_small = F.concat(F.lit("file too small: "), F.col("length").cast("string"), F.lit(" bytes"))
    joined = expected.join(existing, KEY, "left").join(tried, KEY, "left")
    outcome = (
        F.when(F.col("existed"), SKIP_EXISTS)
        .when(F.col("http_code").isin(*ABSENT_CODES), SKIP_404)
        .when(F.col("error").isNotNull(), FAIL)
        .when(F.col("length").isNull(), SKIP_404)
        .when(large_enough(), OK)
        .otherwise(FAIL)
    )
    detail = F.when(F.col("status") == FAIL, F.substring(F.coalesce("error", too_small), 1, ERROR_CHARS))
    return joined.withColumn("status", outcome).select(
        *KEY,
        "storage_key",
        "status",
        F.when(F.col("status") == OK, F.col("length")).otherwise(F.lit(0)).alias("bytes"),
        detail.alias("error"),
    )


def status_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("feed", "status").agg(
        F.count(F.lit(1)).alias("periods"), F.sum("bytes").alias("total_bytes")
    )


def attempts(probed: DataFrame) -> DataFrame:
    """Landing attempts out of probed files (path, length, feed, year, month, error): one row per
    period, with the error of a file that could not be read, if there is one."""
    return probed.groupBy(*KEY).agg(
        F.sum("length").alias("length"), F.lit(None).cast("int").alias("http_code"), F.max("error").alias("error")
    )


def failures(statuses: DataFrame, source: str, attempt: Column) -> DataFrame:
    """Dead-letter rows of one run: the failed periods, by the url they are fetched from."""
    failed = statuses.filter(F.col("status") == FAIL)
    url = F.concat(F.lit(f"{source.rstrip('/')}/"), file_name())
    return failed.select(url.alias("url"), "feed", "storage_key", "error", attempt.alias("attempt"))


def latest_failures(recorded: DataFrame, attempt: list[str]) -> DataFrame:
    """Last write wins on ``url``.

    ``recorded``: url, feed, storage_key, error and the ``attempt`` columns that order them.
    ``max_by`` combines on the map side, so a url with very many failures is no hot spot, as it
    would be in a window.
    """
    record = F.struct("feed", "storage_key", F.substring("error", 1, ERROR_CHARS).alias("error"), *attempt)
    last = recorded.groupBy("url").agg(F.max_by(record, F.struct(*attempt)).alias("record"))
    return last.select("url", "record.*")


def pending_failures(latest: DataFrame, landed_keys: DataFrame) -> DataFrame:
    """Failures still open: those whose file has not landed since."""
    return latest.join(landed_keys.select("storage_key").distinct(), "storage_key", "left_anti").select(latest.columns)
