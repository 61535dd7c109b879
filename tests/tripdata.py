"""Hand-written bronze files of the four trip feeds: three months, drifting schemas, dirty rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from tripmill.plans.trips import BRONZE_SCHEMAS

YELLOW = [name.strip().split(" ")[0] for name in BRONZE_SCHEMAS["yellow"].split(",")]
MONTHS = ((2024, 12), (2025, 1), (2025, 2))

ZONES_CSV = "\r\n".join(
    [
        '"LocationID","Borough","Zone","service_zone"',
        '1,"EWR","Airport One","EWR"',
        '4,"Manhattan","Alpha City","Yellow Zone"',
        '12,"Manhattan","Low Park","Yellow Zone"',
        '24,"Manhattan","High Hill","Boro Zone"',
        '56,"Queens","Twin Name","Boro Zone"',
        '57,"Queens","Twin Name","Boro Zone"',
        '61,"Brooklyn","North Heights","Boro Zone"',
        '132,"Queens","Airport Two","Airports"',
        '264,"Unknown","N/A","N/A"',
        '265,"N/A","Outside Area","N/A"',
        "",
    ]
)


def write_zones(path: Path) -> str:
    path.write_bytes(ZONES_CSV.encode())
    return str(path)


def metered(prefix: str, start: str, end: str, **values) -> dict:
    row = {
        "vendorid": 1,
        f"{prefix}_pickup_datetime": start,
        f"{prefix}_dropoff_datetime": end,
        "passenger_count": 1.0,
        "trip_distance": 2.5,
        "ratecodeid": 1.0,
        "store_and_fwd_flag": "N",
        "pulocationid": 4,
        "dolocationid": 56,
        "payment_type": 1,
        "fare_amount": 10.0,
        "extra": 1.0,
        "mta_tax": 0.5,
        "tip_amount": 2.0,
        "tolls_amount": 0.0,
        "improvement_surcharge": 0.3,
        "total_amount": 14.0,
        "congestion_surcharge": 2.5,
        "airport_fee": 0.0,
        "cbd_congestion_fee": 0.75,
    }
    return {**row, **values}


def app(start: str | None, end: str | None, **values) -> dict:
    row = {
        "hvfhs_license_num": "HV0003",
        "dispatching_base_num": "B01",
        "originating_base_num": "B01",
        "request_datetime": start,
        "on_scene_datetime": start,
        "pickup_datetime": start,
        "dropoff_datetime": end,
        "pulocationid": 12,
        "dolocationid": 61,
        "trip_miles": 4.0,
        "trip_time": 900,
        "base_passenger_fare": 20.0,
        "tolls": 0.0,
        "bcf": 0.5,
        "sales_tax": 1.5,
        "congestion_surcharge": 2.75,
        "airport_fee": 0.0,
        "tips": 0.0,
        "driver_pay": 15.0,
        "shared_request_flag": " n ",
        "shared_match_flag": "N",
        "access_a_ride_flag": "",
        "wav_request_flag": "N",
        "wav_match_flag": "N",
        "cbd_congestion_fee": 1.5,
    }
    return {**row, **values}


def dispatch(start: str, end: str, **values) -> dict:
    row = {
        "dispatching_base_num": "b00100",
        "pickup_datetime": start,
        "dropoff_datetime": end,
        "pulocationid": 57.0,
        "dolocationid": 266.0,
        "sr_flag": None,
        "affiliated_base_number": " b00200 ",
    }
    return {**row, **values}


def write_month(
    spark: SparkSession, root: Path, feed: str, period: tuple[int, int], rows: list[dict], **drift: str | None
) -> None:
    """One bronze file. ``drift``: column -> other type, or None to leave the column out."""
    year, month = period
    ddl = BRONZE_SCHEMAS[feed]
    types = dict(part.strip().split(" ") for part in ddl.split(","))
    texts = [{name: None if value is None else str(value) for name, value in row.items()} for row in rows]
    schema = ", ".join(f"{name} string" for name in types)
    frame = spark.createDataFrame([tuple(row.get(name) for name in types) for row in texts], schema)
    columns = []
    for name, declared in types.items():
        target = drift.get(name, declared)
        if target is not None:
            columns.append(F.col(name).cast("double").cast(target).alias(name) if target in ("bigint", "int") else F.col(name).cast(target).alias(name))
    frame.select(*columns).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/{feed}/year={year}/month={month:02d}"
    )


def write_bronze(spark: SparkSession, root: Path) -> None:
    """Known totals: see ``EXPECTED``."""
    ok = ("2024-12-05 05:10:00", "2024-12-05 05:25:00")
    write_month(
        spark,
        root,
        "yellow",
        (2024, 12),
        [
            metered("tpep", *ok),
            metered("tpep", *ok),  # exact copy
            metered("tpep", "2024-12-01 00:00:00", "2024-12-01 00:10:00", vendorid=2, payment_type=2, tip_amount=0.0),
            metered("tpep", "2025-01-01 00:00:00", "2025-01-01 00:10:00"),  # first moment after the month
            metered("tpep", "2024-12-09 10:00:00", None),
            metered("tpep", "2024-12-09 12:30:00", "2024-12-09 12:20:00", vendorid=6, trip_distance=None),
        ],
        passenger_count="bigint",
        cbd_congestion_fee=None,
    )
    write_month(
        spark,
        root,
        "yellow",
        (2025, 1),
        [
            metered("tpep", "2025-01-02 17:00:00", "2025-01-02 17:30:00", trip_distance=20.0),
            metered("tpep", "2025-01-03 20:00:00", "2025-01-03 20:30:00", pulocationid=None, trip_distance=-0.5),
        ],
    )
    write_month(
        spark,
        root,
        "yellow",
        (2025, 2),
        [metered("tpep", "2025-02-02 23:00:00", "2025-02-02 23:30:00", passenger_count=3, tip_amount=0.01)],
        passenger_count="int",
    )
    green = metered("lpep", "2025-01-04 06:00:00", "2025-01-04 06:20:00", ehail_fee=1.0, trip_type=1.0)
    write_month(spark, root, "green", (2025, 1), [green, {**green, "ehail_fee": 2.0}])  # differ in a dropped column
    write_month(
        spark,
        root,
        "fhvhv",
        (2025, 1),
        [
            app("2025-01-05 09:00:00", "2025-01-05 09:20:00"),
            app("2025-01-05 14:00:00", "2025-01-05 14:20:00", hvfhs_license_num="HV0005", trip_time=None, tips=3.0),
            app("2025-01-05 12:00:00", "2025-01-05 12:20:00", hvfhs_license_num="HV0004"),
            app("2025-01-05 12:00:00", "2025-01-05 12:20:00", hvfhs_license_num="hv9999", pulocationid=132),
            app(None, "2025-01-05 12:20:00"),
        ],
    )
    write_month(
        spark,
        root,
        "fhv",
        (2024, 12),
        [
            dispatch("2024-12-31 23:59:59", "2025-01-01 00:10:00"),
            dispatch("2024-12-30 10:00:00", "2024-12-30 10:10:00", dispatching_base_num="B00050", pulocationid=0),
        ],
    )


# feed -> raw, de-duplicated, clean rows over all months
EXPECTED = {"yellow": (9, 8, 6), "green": (2, 1, 1), "fhvhv": (5, 5, 4), "fhv": (2, 2, 2)}
