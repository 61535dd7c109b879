from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.plans.trips import CONTRACTS
from tripmill.sources import landing
from tripmill.sources.places import read_zones
from tripdata import write_zones

PERIOD_DDL = "feed string, year int, month int"


def test_calendar_and_keys(spark):
    rows = landing.calendar(landing.feed_ranges(spark, list(CONTRACTS.values())))
    counts = {r["feed"]: r["count"] for r in rows.groupBy("feed").count().collect()}
    assert counts == {"yellow": 132, "green": 132, "fhv": 132, "fhvhv": 95}
    first = rows.filter("feed = 'fhvhv'").orderBy("year", "month").first()
    assert first["storage_key"] == "fhvhv/year=2019/month=02/fhvhv_tripdata_2019-02.parquet"


def test_manifest_lists_without_reading(spark, tmp_path):
    folder = tmp_path / "yellow/year=2024/month=03"
    folder.mkdir(parents=True)
    (folder / "a.parquet").write_bytes(b"x" * 1023)
    (folder / "b.parquet").write_bytes(b"x")
    (folder / "notes.txt").write_bytes(b"x")
    (tmp_path / "stray.parquet").write_bytes(b"x")
    files = landing.manifest(spark, str(tmp_path))
    assert {(r["feed"], r["year"], r["month"], r["length"]) for r in files.collect()} == {
        ("yellow", 2024, 3, 1023),
        ("yellow", 2024, 3, 1),
    }
    assert landing.present_periods(files).first()["length"] == 1024
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("\n")[0]


def expected(spark, months):
    return spark.createDataFrame([("y", 2024, m) for m in months], PERIOD_DDL).withColumn(
        "storage_key", landing.storage_key()
    )


def test_status_of_every_outcome(spark):
    existing = spark.createDataFrame([("y", 2024, 1)], PERIOD_DDL)
    attempts = spark.createDataFrame(
        [
            ("y", 2024, 1, None, 500, "ignored, it existed"),
            ("y", 2024, 2, 1024, None, None),
            ("y", 2024, 3, 1023, None, None),
            ("y", 2024, 4, None, 404, "not found"),
            ("y", 2024, 5, None, 403, "forbidden"),
            ("y", 2024, 6, None, 500, "e" * 300),
        ],
        f"{PERIOD_DDL}, length bigint, http_code int, error string",
    )
    rows = landing.status(expected(spark, range(1, 8)), existing, attempts)
    found = {r["month"]: (r["status"], r["bytes"], r["error"]) for r in rows.collect()}
    assert found == {
        1: ("SKIP_EXISTS", 0, None),
        2: ("OK", 1024, None),
        3: ("FAIL", 0, "file too small: 1023 bytes"),
        4: ("SKIP_404", 0, None),
        5: ("SKIP_404", 0, None),
        6: ("FAIL", 0, "e" * 200),
        7: ("SKIP_404", 0, None),
    }
    summary = {r["status"]: (r["periods"], r["total_bytes"]) for r in landing.status_summary(rows).collect()}
    assert summary == {"SKIP_EXISTS": (1, 0), "OK": (1, 1024), "FAIL": (2, 0), "SKIP_404": (3, 0)}


def test_gap_includes_files_that_are_too_small(spark):
    present = spark.createDataFrame([("y", 2024, 1, 1024), ("y", 2024, 2, 1023)], f"{PERIOD_DDL}, length bigint")
    assert {r["month"] for r in landing.gap(expected(spark, (1, 2, 3)), present).collect()} == {2, 3}


def test_dead_letters(spark):
    third_on_one_url = [("hot", "y", f"k{i % 2}", "x" * 250, i) for i in range(1_000)]
    others = [(f"u{i}", "y", f"s{i}", "short", i) for i in range(20)]
    failures = spark.createDataFrame(
        third_on_one_url + others, "url string, feed string, storage_key string, error string, attempt int"
    )
    latest = landing.latest_failures(failures, ["attempt"])
    found = {r["url"]: r for r in latest.collect()}
    assert len(found) == 21 and found["hot"]["attempt"] == 999 and found["hot"]["storage_key"] == "k1"
    assert len(found["hot"]["error"]) == 200
    landed = spark.createDataFrame([("k1",), ("s3",), ("s3",)], "storage_key string")
    assert {r["url"] for r in landing.pending_failures(latest, landed).collect()} == {
        f"u{i}" for i in range(20) if i != 3
    }


def test_zone_file(spark, tmp_path):
    zones = read_zones(spark, write_zones(tmp_path / "zones.csv"))
    assert zones.count() == 10
    last = zones.filter("place_id = 265").first()
    assert tuple(last) == (265, "N/A", "Outside Area", "N/A")
    assert zones.filter(F.col("service_zone").contains("\r")).count() == 0


def test_every_file_is_accounted_for(spark, tmp_path):
    good = tmp_path / "yellow/year=2024/month=03"
    spark.range(5000).coalesce(1).write.parquet(str(good))
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/yellow/elsewhere")
    spark.range(3000).coalesce(1).write.parquet(f"{tmp_path}/yellow/year=2024/month=04")
    (tmp_path / "yellow/year=2024/month=04/broken.parquet").write_bytes(b"x" * 3000)
    (tmp_path / "yellow/year=2024/month=05").mkdir()
    (tmp_path / "yellow/year=2024/month=05/tiny.parquet").write_bytes(b"x")
    (tmp_path / "yellow/notes.txt").write_bytes(b"x")
    (tmp_path / "unknown/year=2024/month=05").mkdir(parents=True)
    (tmp_path / "unknown/year=2024/month=05/a.parquet").write_bytes(b"x" * 3000)
    taken = landing.manifest(spark, str(tmp_path)).filter("month = 3").select("path", "length", "modified")
    rows = landing.accounted(spark, str(tmp_path), ["yellow"], taken).collect()
    assert sorted(((r["reason"], r["month"], r["rows"]) for r in rows), key=str) == sorted([
        (None, 3, 5000), (landing.OUTSIDE, None, 4), (landing.HELD_BACK, 4, 3000), (landing.UNREADABLE, 4, None),
        (landing.TOO_SMALL, 5, None), (landing.NO_PARQUET, None, None), (landing.OUTSIDE, None, None),
    ], key=str)


def test_zone_lines_that_do_not_parse_are_kept_aside(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text('"LocationID","Borough","Zone","service_zone"\n1,"A","B","C"\nx,"A","B","C"\n,"A","B","C"\n2,"A","B"\n3,"D","E","F"\n')
    from tripmill.sources.places import split_zones

    zones, rejected = split_zones(spark, str(path))
    assert sorted(r["place_id"] for r in zones.collect()) == [1, 3]
    assert sorted((r["line"], r["reason"]) for r in rejected.collect()) == [
        ('2,"A","B"', "does not parse"), ("A,B,C", "no place id"), ('x,"A","B","C"', "does not parse"),
    ]
    assert rejected.count() == 3
