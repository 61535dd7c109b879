"""Binding for the four public trip-record feeds: contracts, rules, labels.

The maps, id lists and labels below are fixed values: results depend on them being exactly these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmill.operators.contracts import (
    FeedContract,
    OperatorRule,
    PlaceRules,
    Rule,
    ServiceRule,
    StarModel,
    Vocabulary,
)
from tripmill.sources.landing import calendar, feed_ranges

LAST_YEAR = 2026

# Raw column -> canonical column.
YELLOW = FeedContract(
    "yellow",
    {
        "vendorid": "operator_code",
        "tpep_pickup_datetime": "pickup_ts",
        "tpep_dropoff_datetime": "dropoff_ts",
        "passenger_count": "passenger_count",
        "trip_distance": "distance_mi",
        "ratecodeid": "rate_code_id",
        "store_and_fwd_flag": "store_and_fwd_flag",
        "pulocationid": "pickup_place_id",
        "dolocationid": "dropoff_place_id",
        "payment_type": "payment_type",
        "fare_amount": "fare",
        "extra": "extra",
        "mta_tax": "transit_tax",
        "tip_amount": "tip",
        "tolls_amount": "tolls",
        "improvement_surcharge": "improvement_fee",
        "total_amount": "total",
        "congestion_surcharge": "congestion_fee",
        "airport_fee": "airport_fee",
        "cbd_congestion_fee": "core_zone_fee",
    },
    (2016, 1),
    LAST_YEAR,
)
GREEN = FeedContract(
    "green",
    {
        "vendorid": "operator_code",
        "lpep_pickup_datetime": "pickup_ts",
        "lpep_dropoff_datetime": "dropoff_ts",
        "passenger_count": "passenger_count",
        "trip_distance": "distance_mi",
        "ratecodeid": "rate_code_id",
        "store_and_fwd_flag": "store_and_fwd_flag",
        "pulocationid": "pickup_place_id",
        "dolocationid": "dropoff_place_id",
        "payment_type": "payment_type",
        "fare_amount": "fare",
        "extra": "extra",
        "mta_tax": "transit_tax",
        "tip_amount": "tip",
        "tolls_amount": "tolls",
        "improvement_surcharge": "improvement_fee",
        "total_amount": "total",
        "trip_type": "trip_type",
        "congestion_surcharge": "congestion_fee",
        "cbd_congestion_fee": "core_zone_fee",
    },
    (2016, 1),
    LAST_YEAR,
)
APP = FeedContract(
    "fhvhv",
    {
        "hvfhs_license_num": "operator_code",
        "dispatching_base_num": "dispatch_base",
        "originating_base_num": "origin_base",
        "request_datetime": "request_ts",
        "on_scene_datetime": "on_scene_ts",
        "pickup_datetime": "pickup_ts",
        "dropoff_datetime": "dropoff_ts",
        "pulocationid": "pickup_place_id",
        "dolocationid": "dropoff_place_id",
        "trip_miles": "distance_mi",
        "trip_time": "trip_seconds",
        "base_passenger_fare": "fare",
        "tolls": "tolls",
        "bcf": "fund_fee",
        "sales_tax": "sales_tax",
        "congestion_surcharge": "congestion_fee",
        "airport_fee": "airport_fee",
        "tips": "tip",
        "driver_pay": "driver_pay",
        "shared_request_flag": "shared_request_flag",
        "shared_match_flag": "shared_match_flag",
        "access_a_ride_flag": "access_a_ride_flag",
        "wav_request_flag": "wav_request_flag",
        "wav_match_flag": "wav_match_flag",
        "cbd_congestion_fee": "core_zone_fee",
    },
    (2019, 2),
    LAST_YEAR,
)
DISPATCH = FeedContract(
    "fhv",
    {
        "dispatching_base_num": "dispatch_base",
        "pickup_datetime": "pickup_ts",
        "dropoff_datetime": "dropoff_ts",
        "pulocationid": "pickup_place_id",
        "dolocationid": "dropoff_place_id",
        "sr_flag": "shared_ride_flag",
        "affiliated_base_number": "affiliate_base",
    },
    (2016, 1),
    LAST_YEAR,
)
CONTRACTS = {contract.feed: contract for contract in (YELLOW, GREEN, APP, DISPATCH)}

# Declared types of the raw files.
BRONZE_SCHEMAS = {
    "yellow": (
        "vendorid bigint, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
        "passenger_count double, trip_distance double, ratecodeid double, store_and_fwd_flag string, "
        "pulocationid bigint, dolocationid bigint, payment_type bigint, fare_amount double, extra double, "
        "mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
        "total_amount double, congestion_surcharge double, airport_fee double, cbd_congestion_fee double"
    ),
    "green": (
        "vendorid bigint, lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz, "
        "store_and_fwd_flag string, ratecodeid double, pulocationid bigint, dolocationid bigint, "
        "passenger_count double, trip_distance double, fare_amount double, extra double, mta_tax double, "
        "tip_amount double, tolls_amount double, ehail_fee double, improvement_surcharge double, "
        "total_amount double, payment_type double, trip_type double, congestion_surcharge double, "
        "cbd_congestion_fee double"
    ),
    "fhvhv": (
        "hvfhs_license_num string, dispatching_base_num string, originating_base_num string, "
        "request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, pickup_datetime timestamp_ntz, "
        "dropoff_datetime timestamp_ntz, pulocationid bigint, dolocationid bigint, trip_miles double, "
        "trip_time bigint, base_passenger_fare double, tolls double, bcf double, sales_tax double, "
        "congestion_surcharge double, airport_fee double, tips double, driver_pay double, "
        "shared_request_flag string, shared_match_flag string, access_a_ride_flag string, "
        "wav_request_flag string, wav_match_flag string, cbd_congestion_fee double"
    ),
    "fhv": (
        "dispatching_base_num string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, "
        "pulocationid double, dolocationid double, sr_flag double, affiliated_base_number string"
    ),
}

# Zone ids of the region groups.
PLACES = PlaceRules(
    airport_ids=(1, 132, 138),
    core_ids=(
        4, 12, 13, 45, 48, 50, 68, 79, 87, 88, 90, 100, 107, 113, 114, 125, 137, 144,
        148, 158, 161, 162, 163, 164, 170, 186, 209, 211, 224, 230, 231, 232, 233, 234, 246, 249,
    ),
    home_district="MANHATTAN",
    unknown_ids=(264, 265),
    core_service_zones=("YELLOW ZONE", "BORO ZONE"),
)

# The labels that results carry.
WORDS = Vocabulary(
    service_groups={
        1: "TAXI",
        2: "TAXI",
        3: "APLICATIVO DE TRANSPORTE",
        4: "APLICATIVO DE TRANSPORTE",
        5: "APLICATIVO DE TRANSPORTE",
        6: "APLICATIVO DE TRANSPORTE",
        7: "APLICATIVO DE TRANSPORTE",
    },
    distance_bands=(
        (1, "0-1 MILHAS", "ATE 1 MILHA"),
        (2, "1-3 MILHAS", "CURTA DISTANCIA"),
        (3, "3-5 MILHAS", "MEDIA DISTANCIA"),
        (4, "5-10 MILHAS", "MEDIA-LONGA DISTANCIA"),
        (5, "10-20 MILHAS", "LONGA DISTANCIA"),
        (6, "20+ MILHAS", "MUITO LONGA DISTANCIA"),
    ),
    time_bands=(
        (1, "MADRUGADA"),
        (2, "PICO MANHA"),
        (3, "MANHA"),
        (4, "ALMOCO"),
        (5, "TARDE"),
        (6, "PICO TARDE"),
        (7, "NOITE"),
    ),
    yes="SIM",
    no="NAO",
    cash="DINHEIRO",
    not_cash="DEMAIS",
    unknown_operator="DESCONHECIDO",
    other_operator="OUTRO",
    region_airport="AEROPORTO",
    region_core="MANHATTAN CBD",
    region_home="MANHATTAN SEM CBD",
    region_unknown="DESCONHECIDOS",
    region_other="OUTROS BAIRROS",
    era_before="PRE-PANDEMIA",
    era_during="DURANTE",
    era_after="POS-PANDEMIA",
    zone_core="CBD ZONE (BELOW 60TH)",
    zone_outside="FORA DO CBD",
    district_inside="DENTRO CBD",
    district_outside="FORA CBD",
)
SCATTER_YEAR = 2025
FEE_PERIOD = (2025, 1)
COMPARED_PERIODS = (("DEZ-2024", (2024, 12)), ("JAN-2025", (2025, 1)))
CORE_TILE_YEARS = ("2024", "2025", "2026")

METERED_CODES = {"1": "CMT", "2": "VERIFONE"}
OPERATORS = {
    "yellow": OperatorRule("operator_code", METERED_CODES),
    "green": OperatorRule("operator_code", METERED_CODES),
    "fhvhv": OperatorRule("operator_code"),
    "fhv": OperatorRule("dispatch_base"),
}
SERVICES = (
    ServiceRule(1, "yellow"),
    ServiceRule(2, "green"),
    ServiceRule(3, "fhvhv", "HV0003"),
    ServiceRule(4, "fhvhv", "HV0005"),
    ServiceRule(5, "fhvhv", "HV0004"),
    ServiceRule(6, "fhvhv"),
    ServiceRule(7, "fhv"),
)


def completeness_rules(place_fraction: float) -> tuple[Rule, ...]:
    return (
        Rule("row_count", low=0),
        Rule("completeness", "pickup_ts", 0.99),
        Rule("completeness", "dropoff_ts", 0.99),
        Rule("completeness", "pickup_place_id", place_fraction),
        Rule("completeness", "dropoff_place_id", place_fraction),
    )


METERED_RULES = (
    *completeness_rules(0.95),
    Rule("at_least", "fare", -50.0),
    Rule("at_least", "distance_mi", 0.0),
    Rule("at_least", "tip", 0.0),
    Rule("between", "total", -100.0, 50000.0),
)
QUALITY = {
    "yellow": (*METERED_RULES, Rule("between", "passenger_count", 0, 9)),
    "green": METERED_RULES,
    "fhvhv": (
        *completeness_rules(0.95),
        Rule("at_least", "distance_mi", 0.0),
        Rule("at_least", "tip", 0.0),
        Rule("at_least", "fare", -50.0),
        Rule("at_least", "trip_seconds", 0),
    ),
    "fhv": completeness_rules(0.90),
}

MODEL = StarModel(CONTRACTS, OPERATORS, SERVICES, PLACES, WORDS, QUALITY)


def expected_calendar(spark: SparkSession) -> DataFrame:
    return calendar(feed_ranges(spark, list(CONTRACTS.values())))
