"""Binding for the driver's warehouse tables: order lines re-read as trips of four feeds.

A line item is a trip from the supplier's nation to the customer's nation. The customer's market
segment decides the feed. Each feed spells and types its raw columns in its own way, and the
derivation plants exact duplicates, missing times, period mismatches and missing places, so that
every step of the pipeline has work to do on real rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripmill.operators.contracts import (
    FeedContract,
    OperatorRule,
    PlaceRules,
    Rule,
    ServiceRule,
    StarModel,
    Vocabulary,
)
from tripmill.session import lookup

FEEDS = ("a", "b", "c", "d")
SEGMENT_FEED = {
    "AUTOMOBILE": "a",
    "BUILDING": "b",
    "FURNITURE": "c",
    "HOUSEHOLD": "c",
    "MACHINERY": "d",
}
FIRST_PERIOD, LAST_YEAR = (1995, 1), 2001

CONTRACTS = {
    "a": FeedContract(
        "a",
        {
            "vendor": "operator_code",
            "tp_pickup": "pickup_ts",
            "tp_dropoff": "dropoff_ts",
            "trip_distance": "distance_mi",
            "pu_place": "pickup_place_id",
            "do_place": "dropoff_place_id",
            "payment_type": "payment_type",
            "fare_amount": "fare",
            "tip_amount": "tip",
            "congestion": "congestion_fee",
            "core_fee": "core_zone_fee",
        },
        FIRST_PERIOD,
        LAST_YEAR,
    ),
    "b": FeedContract(
        "b",
        {
            "vendor": "operator_code",
            "lp_pickup": "pickup_ts",
            "lp_dropoff": "dropoff_ts",
            "trip_distance": "distance_mi",
            "pu_place": "pickup_place_id",
            "do_place": "dropoff_place_id",
            "payment_type": "payment_type",
            "fare_amount": "fare",
            "tip_amount": "tip",
            "congestion": "congestion_fee",
            "core_fee": "core_zone_fee",
        },
        FIRST_PERIOD,
        LAST_YEAR,
    ),
    "c": FeedContract(
        "c",
        {
            "licence": "operator_code",
            "pickup": "pickup_ts",
            "dropoff": "dropoff_ts",
            "miles": "distance_mi",
            "pu_place": "pickup_place_id",
            "do_place": "dropoff_place_id",
            "base_fare": "fare",
            "tips": "tip",
            "congestion": "congestion_fee",
            "core_fee": "core_zone_fee",
        },
        (1995, 2),
        LAST_YEAR,
    ),
    "d": FeedContract(
        "d",
        {
            "base_num": "dispatch_base",
            "pickup": "pickup_ts",
            "dropoff": "dropoff_ts",
            "miles": "distance_mi",
            "pu_place": "pickup_place_id",
            "do_place": "dropoff_place_id",
            "base_fare": "fare",
        },
        FIRST_PERIOD,
        LAST_YEAR,
    ),
}

PLACES = PlaceRules(
    airport_ids=(2, 9),
    core_ids=(3, 8, 13),
    home_district="ASIA",
    unknown_ids=(25,),
    core_service_zones=("INNER RING", "MIDDLE RING"),
)
WORDS = Vocabulary(
    service_groups={1: "TAXI", 2: "TAXI", 3: "APP", 4: "APP", 5: "APP", 6: "APP", 7: "APP"},
    distance_bands=(
        (1, "0-1 MILES", "UP TO 1 MILE"),
        (2, "1-3 MILES", "SHORT"),
        (3, "3-5 MILES", "MEDIUM"),
        (4, "5-10 MILES", "MEDIUM LONG"),
        (5, "10-20 MILES", "LONG"),
        (6, "20+ MILES", "VERY LONG"),
    ),
    time_bands=(
        (1, "OVERNIGHT"),
        (2, "AM PEAK"),
        (3, "MORNING"),
        (4, "MIDDAY"),
        (5, "AFTERNOON"),
        (6, "PM PEAK"),
        (7, "NIGHT"),
    ),
    yes="YES",
    no="NO",
    cash="CASH",
    not_cash="OTHER",
    unknown_operator="UNKNOWN",
    other_operator="OTHER",
    region_airport="AIRPORT",
    region_core="CORE",
    region_home="HOME OUTSIDE CORE",
    region_unknown="UNKNOWN",
    region_other="OTHER",
    era_before="BEFORE",
    era_during="DURING",
    era_after="AFTER",
    zone_core="CORE ZONE",
    zone_outside="OUTSIDE CORE",
    district_inside="INSIDE",
    district_outside="OUTSIDE",
)
OPERATORS = {
    "a": OperatorRule("operator_code", {"1": "CMT", "2": "VERIFONE"}),
    "b": OperatorRule("operator_code", {"1": "CMT", "2": "VERIFONE"}),
    "c": OperatorRule("operator_code"),
    "d": OperatorRule("dispatch_base"),
}
SERVICES = (
    ServiceRule(1, "a"),
    ServiceRule(2, "b"),
    ServiceRule(3, "c", "OP1"),
    ServiceRule(4, "c", "OP2"),
    ServiceRule(5, "c", "OP3"),
    ServiceRule(6, "c"),
    ServiceRule(7, "d"),
)
COMMON_RULES = (
    Rule("row_count", low=0),
    Rule("completeness", "pickup_ts", 0.99),
    Rule("completeness", "dropoff_ts", 0.99),
    Rule("completeness", "pickup_place_id", 0.95),
    Rule("completeness", "dropoff_place_id", 0.95),
    Rule("at_least", "distance_mi", 1.0),
    Rule("between", "fare", 1000.0, 100000.0),
)
QUALITY = {
    "a": (*COMMON_RULES, Rule("at_least", "tip", 0.0), Rule("between", "payment_type", 1, 2)),
    "b": (*COMMON_RULES, Rule("at_least", "tip", 0.0), Rule("at_least", "no_such_column", 0.0)),
    "c": (*COMMON_RULES, Rule("at_least", "tip", 0.01)),
    "d": COMMON_RULES[:5],
}
MODEL = StarModel(CONTRACTS, OPERATORS, SERVICES, PLACES, WORDS, QUALITY)

# Report parameters inside the range of the data.
SCATTER_YEAR = 1998
SCATTER_ROWS = 2_000
SCATTER_FARE = (1.0, 60_000.0)
ERA = ("1997-03", "1998-06")
FEE_PERIOD = (1998, 1)
COMPARED_PERIODS = (("DEC-1997", (1997, 12)), ("JAN-1998", (1998, 1)))
CORE_TILE_YEARS = ("1999", "2000", "2001")
MONEY = "decimal(18,2)"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _money(amount: float | Column) -> Column:
    return (F.lit(amount) if isinstance(amount, float) else amount).cast(MONEY)


def derive_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trip records: one row shape for all feeds, before each feed's own spelling."""
    lines = load(spark, sf_dir, "lineitem")
    # Orders meet their customers first, both narrow, so the line items are shuffled at most once, by their order.
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    orders = load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.select("o_orderkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    supplier = lookup(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        placed, F.col("l_orderkey") == F.col("o_orderkey")
    )
    copies = F.when(F.col("l_linenumber") == 7, 2).otherwise(1)
    planted = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    segment = F.col("c_mktsegment")
    feed = F.coalesce(*(F.when(segment == name, value) for name, value in SEGMENT_FEED.items()))
    pickup = F.col("l_shipdate") + F.make_dt_interval(
        F.lit(0), (F.col("l_partkey") % 24).cast("int"), (F.col("l_suppkey") % 60).cast("int"), F.lit(0)
    )
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_quantity").cast("int"), F.lit(0))
    price = _money(F.col("l_extendedprice"))
    charged = F.col("l_tax") >= 0.04
    file_year = F.year("l_shipdate") + F.when(
        (F.col("l_linenumber") == 6) & (F.col("l_partkey") % 9 == 0), 1
    ).otherwise(0)
    return planted.select(
        feed.alias("feed"),
        F.col("l_linenumber").alias("vendor"),
        F.concat(F.lit(" op"), (F.col("l_suppkey") % 4).cast("string"), F.lit(" ")).alias("licence"),
        F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("base_num"),
        pickup.alias("pickup"),
        F.when(F.col("l_partkey") % 50 != 0, pickup + minutes).alias("dropoff"),
        (F.col("l_quantity") / 2).alias("miles"),
        (F.col("s_nationkey") + 1).alias("pu_place"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") + 1).alias("do_place"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).alias("payment"),
        price.alias("fare"),
        _money(price * _money(F.col("l_discount"))).alias("tip"),
        F.when(charged, _money(2.75)).otherwise(_money(0.0)).alias("congestion"),
        F.when(charged & (F.col("l_linestatus") == "F"), _money(0.75)).otherwise(_money(0.0)).alias("core_fee"),
        file_year.alias("year"),
        F.month("l_shipdate").alias("month"),
    )


def raw_feed(trips: DataFrame, feed: str) -> DataFrame:
    """The rows of one feed under that feed's own column names and types."""
    rows = trips.filter(F.col("feed") == feed)
    pu, do = F.col("pu_place"), F.col("do_place")
    if feed == "a":
        columns = [
            F.col("vendor").cast("bigint").alias("Vendor"),
            F.col("pickup").alias("TP_Pickup"),
            F.col("dropoff").alias("TP_Dropoff"),
            F.col("miles").alias("Trip_Distance"),
            pu.cast("bigint").alias("PU_Place"),
            do.cast("bigint").alias("DO_Place"),
            F.col("payment").cast("bigint").alias("Payment_Type"),
            F.col("fare").cast("double").alias("Fare_Amount"),
            F.col("tip").cast("double").alias("Tip_Amount"),
            F.col("congestion").cast("double").alias("Congestion"),
            F.col("core_fee").cast("double").alias("Core_Fee"),
        ]
    elif feed == "b":
        columns = [
            F.col("vendor").cast("double").alias("VENDOR"),
            F.col("pickup").alias("LP_Pickup"),
            F.col("dropoff").alias("LP_Dropoff"),
            F.col("miles").cast("string").alias("trip_distance"),
            pu.cast("string").alias("pu_place"),
            do.cast("string").alias("do_place"),
            F.col("payment").cast("double").alias("payment_type"),
            F.col("fare").alias("fare_amount"),
            F.col("tip").alias("tip_amount"),
            F.col("congestion").cast("double").alias("CONGESTION"),
            F.col("core_fee").cast("double").alias("CORE_FEE"),
            F.col("licence").alias("ehail_fee"),
        ]
    elif feed == "c":
        columns = [
            F.col("licence").alias("Licence"),
            F.col("pickup").alias("Pickup"),
            F.col("dropoff").alias("Dropoff"),
            F.col("miles").cast("float").alias("Miles"),
            pu.alias("pu_place"),
            do.alias("do_place"),
            F.col("fare").cast("double").alias("base_fare"),
            F.col("tip").cast("double").alias("tips"),
            F.col("congestion").alias("congestion"),
            F.col("core_fee").alias("core_fee"),
        ]
    else:
        columns = [
            F.col("base_num").alias("Base_Num"),
            F.col("pickup").alias("pickup"),
            F.col("dropoff").alias("dropoff"),
            F.col("miles").alias("miles"),
            pu.cast("double").alias("PU_place"),
            do.cast("double").alias("DO_place"),
            F.col("fare").cast("double").alias("base_fare"),
        ]
    return rows.select(*columns, "year", "month")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones, regions as districts."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    ring = F.when(F.col("n_nationkey") < 8, " Inner Ring ").when(F.col("n_nationkey") < 16, "middle ring")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).alias("place_id"),
        F.initcap("r_name").alias("district"),
        F.concat(F.lit(" "), F.initcap("n_name")).alias("zone"),
        F.coalesce(ring, F.lit("Outer Ring")).alias("service_zone"),
    )
