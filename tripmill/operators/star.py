"""Silver tables -> dimensions and fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tripmill.functions import band, clean_text, digest, first_match, flag, or_zero
from tripmill.operators.contracts import (
    CANONICAL_TYPES,
    PERIOD,
    OperatorRule,
    PlaceRules,
    ServiceRule,
    StarModel,
    Vocabulary,
)
from tripmill.session import scratch_root

# Measures whose null means 0 in the unified frame.
MEASURES = (
    "fare",
    "tip",
    "tolls",
    "congestion_fee",
    "airport_fee",
    "improvement_fee",
    "fund_fee",
    "sales_tax",
    "driver_pay",
    "distance_mi",
    "extra",
    "transit_tax",
    "core_zone_fee",
)
CARRIED = (
    "operator_code",
    "pickup_ts",
    "dropoff_ts",
    "pickup_place_id",
    "dropoff_place_id",
    "payment_type",
    "trip_seconds",
)


# ---------------------------------------------------------------- unify


def decode_operator(columns: Sequence[str], rule: OperatorRule, words: Vocabulary) -> Column:
    """Operator text of one feed: the column itself, or its codes decoded. Codes are compared
    as text, with or without the ``.0`` that a double-typed code leaves."""
    if rule.column not in columns:
        return F.lit(words.unknown_operator)
    text = F.col(rule.column)
    if rule.codes is None:
        return text
    cases = ((text.isin(code, f"{code}.0"), label) for code, label in rule.codes.items())
    return first_match(cases, words.other_operator)


def operator_text(operator: Column, words: Vocabulary) -> Column:
    return clean_text(F.coalesce(operator, F.lit(words.unknown_operator)))


def unify(silver: Mapping[str, DataFrame], model: StarModel) -> DataFrame:
    """One row shape for every feed: tag, operator, carried columns, measures with null as 0,
    row id. Feeds without a column get a typed null (or 0 for a measure)."""
    parts = []
    for feed, df in silver.items():
        present = set(df.columns)

        def column(name: str) -> Column:
            return F.col(name) if name in present else F.lit(None).cast(CANONICAL_TYPES[name])

        contract = model.contracts[feed]
        # Contract order, whatever columns the table has, so that an id depends on the row alone.
        identity = [*(F.col(part) for part in PERIOD), *(column(name) for name in contract.columns)]
        operator = decode_operator(df.columns, model.operators[feed], model.words)
        parts.append(
            df.select(
                F.lit(feed).alias("feed"),
                digest(feed, identity).alias("trip_id"),
                operator_text(operator, model.words).alias("operator"),
                *(column(name).alias(name) for name in CARRIED),
                *(or_zero(column(name)).alias(name) for name in MEASURES),
                *PERIOD,
            )
        )
    return reduce(lambda left, right: left.unionByName(right), parts)


def operator_names(silver: Mapping[str, DataFrame], model: StarModel) -> DataFrame:
    """Operator names in use. Reads one column per feed and decodes its distinct values only."""
    parts = []
    for feed, df in silver.items():
        rule = model.operators[feed]
        values = df.select(rule.column).distinct() if rule.column in df.columns else df.select(F.lit(None)).limit(1)
        name = operator_text(decode_operator(df.columns, rule, model.words), model.words)
        parts.append(values.select(name.alias("operator")))
    return reduce(lambda left, right: left.unionByName(right), parts).distinct()


# ---------------------------------------------------------------- derived columns


def duration_seconds() -> Column:
    """Reported trip time, else drop-off minus pickup. May be negative."""
    elapsed = F.unix_timestamp("dropoff_ts") - F.unix_timestamp("pickup_ts")
    return F.coalesce(F.col("trip_seconds"), elapsed).try_cast("int")


def classify_service(rules: Sequence[ServiceRule], default: int) -> Column:
    def condition(rule: ServiceRule) -> Column:
        feed = F.col("feed") == rule.feed
        return feed if rule.licence is None else feed & (F.col("operator_code") == rule.licence)

    return first_match(((condition(rule), rule.service_id) for rule in rules), default)


def distance_band(model: StarModel) -> Column:
    return band(F.col("distance_mi"), model.distance_cuts)


def time_band(model: StarModel) -> Column:
    return band(F.hour("pickup_ts"), model.hour_cuts)


# ---------------------------------------------------------------- dimensions


def literal_dim(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def service_dim(spark: SparkSession, words: Vocabulary) -> DataFrame:
    return literal_dim(spark, sorted(words.service_groups.items()), "service_id int, service_group string")


def distance_dim(spark: SparkSession, words: Vocabulary) -> DataFrame:
    ddl = "distance_band_id int, distance_band string, distance_description string"
    return literal_dim(spark, words.distance_bands, ddl)


def time_dim(spark: SparkSession, words: Vocabulary) -> DataFrame:
    return literal_dim(spark, words.time_bands, "time_band_id int, time_band string")


def status_dim(spark: SparkSession, words: Vocabulary, name: str, label: str) -> DataFrame:
    return literal_dim(spark, [(1, words.yes), (2, words.no)], f"{name}_id int, {label} string")


def place_dim(zones: DataFrame, rules: PlaceRules, words: Vocabulary) -> DataFrame:
    """``zones``: place_id, district, zone, service_zone as read."""
    cleaned = zones.select(
        F.col("place_id").cast("int").alias("place_id"),
        *(clean_text(F.col(name)).alias(name) for name in ("district", "zone", "service_zone")),
    )
    place = F.col("place_id")
    region = first_match(
        (
            (place.isin(*rules.airport_ids), words.region_airport),
            (place.isin(*rules.core_ids), words.region_core),
            (F.col("district") == rules.home_district, words.region_home),
            (place.isin(*rules.unknown_ids), words.region_unknown),
        ),
        words.region_other,
    )
    return cleaned.withColumn("region_group", region)


def dense_keys(names: DataFrame, text: str, key: str, after: int = 0) -> DataFrame:
    """Dense ids in text order, ``after`` + 1 onwards, without sorting everything in one task.

    Names are range partitioned, so their order across partitions is known; an id is the size of
    the partitions before plus the row number inside. Both uses must see the same ranges,
    hence the checkpoint. The window over partitions has one row per partition.
    """
    scratch_root(names.sparkSession)
    ranged = (
        names.select(text)
        .distinct()
        .repartitionByRange(text)
        .withColumn("part", F.spark_partition_id())
        .checkpoint()
    )
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(text))
    return ranged.join(F.broadcast(offsets), "part").select(
        (within + F.col("offset") + F.lit(after)).cast("int").alias(key), text
    )


def operator_dim(operators: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct operator names with stable ids: known names keep theirs, new ones follow in
    text order after the highest id."""
    if existing is None:
        return dense_keys(operators, "operator", "operator_id")
    fresh = operators.select("operator").distinct().join(existing, "operator", "left_anti")
    last = existing.agg(F.coalesce(F.max("operator_id"), F.lit(0)).alias("last")).first()["last"]
    added = dense_keys(fresh, "operator", "operator_id", after=last)
    return existing.select("operator_id", "operator").unionByName(added)


# ---------------------------------------------------------------- fact


def fact_trip(unified: DataFrame, operators: DataFrame, model: StarModel) -> DataFrame:
    """One row per silver row. Year and month are those of the pickup: silver keeps no other row.

    ``operators`` should be read from its written table and passed by ``lookup``: without it the optimizer joins by sort and
    merge above its broadcast threshold, which shuffles every trip by a name that a few operators share.
    """
    keyed = unified.join(operators.select("operator", "operator_id"), "operator", "left")
    words = model.words
    zero = F.lit(0)
    payment = F.when(F.col("payment_type") == model.cash_code, words.cash).otherwise(words.not_cash)
    return keyed.select(
        "trip_id",
        classify_service(model.services, model.default_service).alias("service_id"),
        F.coalesce("operator_id", zero).alias("operator_id"),
        F.coalesce("pickup_place_id", zero).alias("pickup_place_id"),
        F.coalesce("dropoff_place_id", zero).alias("dropoff_place_id"),
        distance_band(model).alias("distance_band_id"),
        time_band(model).alias("time_band_id"),
        flag(F.col("tip")).alias("tip_status_id"),
        flag(F.col("congestion_fee")).alias("congestion_status_id"),
        flag(F.col("core_zone_fee")).alias("core_fee_status_id"),
        "pickup_ts",
        F.coalesce(duration_seconds(), zero).alias("duration_s"),
        "distance_mi",
        "fare",
        "tip",
        "tolls",
        "improvement_fee",
        "airport_fee",
        "congestion_fee",
        "core_zone_fee",
        "fund_fee",
        (F.col("extra") + F.col("transit_tax") + F.col("sales_tax")).alias("other_fees"),
        F.lit(1).alias("trips"),
        payment.alias("payment_class"),
        F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0")).alias(
            "year_month"
        ),
        *PERIOD,
    )
