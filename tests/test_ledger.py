"""Load ledger, committed runs, the fact by the month, its summary, expiry and exclusive versions."""

from __future__ import annotations

import re
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tripdata
from tripmill.operators import mart, reports, summary, tiles
from tripmill.operators.contracts import PERIOD
from tripmill.operators.star import operator_dim
from tripmill.plans import pipeline, trips
from tripmill.sources import ledger, tables
from tripmill.sources.landing import manifest
from tripmill.sources.places import read_zones
from tripmill.sources.tables import read_silver

WORDS = trips.WORDS


def lake(path: Path) -> pipeline.Layout:
    return pipeline.Layout(f"{path}/bronze", f"{path}/silver", f"{path}/gold")


def months(frame):
    return sorted(tuple(r) for r in frame.select("feed", "year", "month").collect())


def row(day: str, hour: int = 10):
    return tripdata.dispatch(f"{day} {hour:02d}:00:00", f"{day} {hour:02d}:10:00")


def test_late_replaced_and_removed_files_are_work(spark, tmp_path):
    layout = lake(tmp_path)
    bronze = Path(layout.bronze)
    for month, day in ((11, "2024-11-05"), (12, "2024-12-05")):
        tripdata.write_month(spark, bronze, "fhv", (2024, month), [row(day)])
    pipeline.run_silver(spark, layout, trips.MODEL)
    work = lambda: months(ledger.changed_months(manifest(spark, layout.bronze), ledger.loaded_files(spark, layout.silver)))
    assert work() == [] and pipeline.run_silver(spark, layout, trips.MODEL).stages is None
    folder = next(bronze.glob("fhv/year=2024/month=*12*"))
    tripdata.write_month(spark, tmp_path / "elsewhere", "fhv", (2024, 12), [row("2024-12-06")])
    late = next((tmp_path / "elsewhere").rglob("*.parquet"))
    (folder / "late.parquet").write_bytes(late.read_bytes())
    assert work() == [("fhv", 2024, 12)]
    stages = pipeline.run_silver(spark, layout, trips.MODEL).stages.filter("month is not null").collect()
    assert [(r["year"], r["month"], r["clean"]) for r in stages] == [(2024, 12, 2)]
    assert read_silver(spark, f"{layout.silver}/fhv", trips.CONTRACTS["fhv"]).groupBy("month").count().count() == 2
    (folder / "late.parquet").unlink()
    assert work() == [("fhv", 2024, 12)]
    pipeline.run_silver(spark, layout, trips.MODEL)
    assert read_silver(spark, f"{layout.silver}/fhv", trips.CONTRACTS["fhv"]).count() == 2
    for old in folder.glob("*.parquet"):
        old.unlink()
    assert work() == []  # a month whose files are all gone stays


def test_a_run_that_stops_between_feeds_changes_nothing(spark, tmp_path, monkeypatch):
    layout = lake(tmp_path)
    tripdata.write_bronze(spark, Path(layout.bronze))
    zones = read_zones(spark, tripdata.write_zones(tmp_path / "zones.csv"))
    write, calls = pipeline.write_silver, []

    def stops(marked, path, load_id, gather=True):
        calls.append(path)
        if len(calls) == 3:
            raise RuntimeError("executor gone")
        write(marked, path, load_id, gather)

    monkeypatch.setattr(pipeline, "write_silver", stops)
    with pytest.raises(RuntimeError):
        pipeline.run_silver(spark, layout, trips.MODEL)
    assert months(ledger.current_months(spark, layout.silver)) == []
    monkeypatch.setattr(pipeline, "write_silver", write)
    pipeline.run_silver(spark, layout, trips.MODEL)
    pipeline.run_gold(spark, layout, trips.MODEL, zones)
    counts = lambda: {f: read_silver(spark, f"{layout.silver}/{f}", c).count() for f, c in trips.CONTRACTS.items()}
    before = counts()
    assert before == {feed: clean for feed, (_, _, clean) in tripdata.EXPECTED.items()}
    calls.clear()
    monkeypatch.setattr(pipeline, "write_silver", stops)
    with pytest.raises(RuntimeError):
        pipeline.run_silver(spark, layout, trips.MODEL, full_load=True)
    monkeypatch.setattr(pipeline, "write_silver", write)
    assert counts() == before and pipeline.run_gold(spark, layout, trips.MODEL, zones)["fact_trip"] == sum(before.values())
    assert pipeline.changed_inputs(spark, layout, rebuild=False).count() == 0


def fact_folders(layout) -> set[str]:
    return {str(p.relative_to(layout.gold)) for p in Path(layout.gold, "fact_trip").glob("batch=*/year=*/month=*")}


def test_one_month_load_writes_one_month_and_equals_a_rebuild(spark, tmp_path):
    layout = lake(tmp_path)
    bronze = Path(layout.bronze)
    tripdata.write_bronze(spark, bronze)
    zones = read_zones(spark, tripdata.write_zones(tmp_path / "zones.csv"))
    pipeline.run_silver(spark, layout, trips.MODEL)
    first = pipeline.run_gold(spark, layout, trips.MODEL, zones)
    before = fact_folders(layout)
    tripdata.write_month(spark, bronze, "fhv", (2025, 3), [{**row("2025-03-05"), "dispatching_base_num": "B00001"}])
    pipeline.run_silver(spark, layout, trips.MODEL)
    second = pipeline.run_gold(spark, layout, trips.MODEL, zones)
    added = fact_folders(layout) - before
    assert [re.sub("batch=[^/]*", "batch", name) for name in added] == ["fact_trip/batch/year=2025/month=3"]
    assert second["fact_trip"] == first["fact_trip"] + 1 and second["dim_operator"] == first["dim_operator"] + 1
    ids = lambda: {r["operator"]: r["operator_id"] for r in pipeline.read_star(spark, layout.gold)["dim_operator"].collect()}
    assert ids()["B00001"] == second["dim_operator"]  # appended, although first in text order
    delta = pipeline.read_star(spark, layout.gold)["fact_trip"]
    rows, states = sorted(map(str, delta.collect())), pipeline.read_months(spark, layout.gold, "trip_summary")
    summed = sorted(map(str, states.collect()))
    pipeline.run_gold(spark, layout, trips.MODEL, zones, rebuild=True)
    assert sorted(map(str, pipeline.read_star(spark, layout.gold)["fact_trip"].collect())) == rows
    assert sorted(map(str, pipeline.read_months(spark, layout.gold, "trip_summary").collect())) == summed
    gone = pipeline.expire(spark, layout, keep=1)
    assert any(name.startswith("fact_trip/batch=") for name in gone) and len({n.split("/")[1] for n in fact_folders(layout)}) == 1
    assert sorted(map(str, pipeline.read_star(spark, layout.gold)["fact_trip"].collect())) == rows
    assert pipeline.expire(spark, layout, keep=1) == []
    with pytest.raises(ValueError):
        pipeline.expire(spark, layout, keep=0)


def test_versions_are_claimed_by_one_writer(spark, tmp_path):
    root = str(tmp_path)
    taken = [tables.next_version(spark, root, "t") for _ in range(3)]
    assert len(set(taken)) == 3 and tables.current_version(spark, root, "t") is None
    path = tables.publish(spark.range(3), root, "t")
    assert path not in taken and tables.read_table(spark, root, "t").count() == 3


def test_writers_at_once_build_on_each_other(spark, tmp_path):
    root, bases = str(tmp_path), []

    def add(names):
        def build(known):
            bases.append(0 if known is None else known.count())
            time.sleep(1.0)
            return operator_dim(spark.createDataFrame([(n,) for n in names], "operator string"), known)

        tables.publish_after(spark, root, "dim_operator", build, pause=0.1)

    writers = [threading.Thread(target=add, args=(names,)) for names in (["B", "D"], ["A", "C", "D"])]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    found = tables.read_table(spark, root, "dim_operator").collect()
    assert sorted(r["operator_id"] for r in found) == [1, 2, 3, 4] and {r["operator"] for r in found} == set("ABCD")
    assert sorted(bases)[0] == 0 and sorted(bases)[1] in (2, 3)
    tables.next_version(spark, root, "dim_operator")  # a writer that dies
    tables.publish_after(spark, root, "dim_operator", lambda known: known, patience=0.2, pause=0.1)
    assert tables.read_table(spark, root, "dim_operator").count() == 4


@pytest.fixture(scope="module")
def stars(spark, sf_dir):
    from tripmill.plans import layers

    return layers.gold(spark, sf_dir), layers.star_and_summary(spark, sf_dir)


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "20000")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def folders_read(df) -> set[str]:
    return {name for name in ("trip_summary", "fact_trip") if any(f"/{name}/" in path for path in df.inputFiles())}


def test_additive_answers_read_the_summary_only(spark, stars):
    from tripmill.plans.registry import ADDITIVE

    star, both = stars
    for name, build in ADDITIVE.items():
        assert folders_read(build(both)) == {"trip_summary"}, name
        assert folders_read(build(star)) == {"fact_trip"}, name
    listed = mart.summarised(both, ["operator"], [mart.trips_part()])  # no key of the summary
    assert folders_read(listed) == {"fact_trip"}


def test_summary_merges_and_ignores_what_is_no_amount(spark):
    keys = {name: 1 for name in summary.KEYS if name != "year_month"}
    fact = spark.createDataFrame(
        [{**keys, "year_month": m, "trips": 1, **{x: float("nan") if x == "tip" and m == "2020-02" else 1.005 for x in summary.MEASURES}} for m in ("2020-01", "2020-02", "2020-02")]
    )
    merged = summary.merge(summary.summarise(fact), "service_id").select("trips", "tip_valued", "fare_valued", summary.mean("tip").alias("mean"))
    assert tuple(merged.first()) == (3, 1, 3, float(summary_cent()))


def summary_cent() -> float:
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(1.005)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_tile_filters_prune_folders(spark, stars):
    from tripmill.plans.registry import TILES
    from tripmill.plans.warehouse import WORDS as WAREHOUSE

    for star in stars:
        tile = tiles.build_tile(star, WAREHOUSE, TILES["tile_time_band"], {"month": ["1", "2"]}, {"year_month": ("1997-06", "1998-03")})
        filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(tile))
        assert any("199706" in f and "199803" in f and "month" in f for f in filters)


def test_period_condition_repeats_the_filters_only(spark):
    days = spark.createDataFrame([(y, m) for y in (1997, 1998) for m in range(1, 13)], "year int, month int")
    kept = lambda *a: days.filter(mart.period_condition(*a)).count()
    assert kept({"year": ["1998"]}) == 12 and kept({"month": "3"}) == 2
    assert kept(None, {"year_month": ("1997-11", "1998-02")}) == 4 and kept(None, {"year_month": (None, "1997-01")}) == 1
    assert mart.period_condition({"year": ["x"]}, {"year_month": ("1997", None)}) is None


def test_silver_reads_only_folders_that_count(spark, stars, sf_dir):
    from tripmill.plans import layers, warehouse

    root = layers.silver_root(spark, sf_dir)
    wanted = spark.createDataFrame([(1998, 3)], "year int, month int")
    part = read_silver(spark, f"{root}/c", warehouse.CONTRACTS["c"], wanted)
    assert {tuple(r) for r in part.select(*PERIOD).distinct().collect()} == {(1998, 3)}
    assert "load_id" in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(part))[0]
    whole = read_silver(spark, f"{root}/c", warehouse.CONTRACTS["c"])
    assert part.count() == whole.filter("year = 1998 and month = 3").count()
    assert reports.monthly_volume(stars[0]).count() > 0
    assert whole.agg(F.count("*")).first()[0] == layers.silver(spark, sf_dir)["c"].count()


def test_a_type_that_changes_between_loads_reads_right(spark, tmp_path):
    layout, contract = lake(tmp_path), trips.CONTRACTS["fhv"]
    names = {c: contract.type_of(c) for c in contract.columns}
    number = next(c for c, kind in names.items() if kind == "int")

    def load(month, value, kind, drop=()):
        columns = [F.lit(value).cast(kind).alias(c) if c == number else F.lit(None).cast(t).alias(c) for c, t in names.items() if c not in drop]
        rows = spark.range(1).select(*columns, F.lit(2024).alias("year"), F.lit(month).alias("month"), F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("accepted"))
        pipeline.load_silver(spark, layout, {"fhv": rows}, pipeline.new_load_id())

    load(1, 7, "int")
    load(2, 8.0, "double")
    load(3, "9", "string", drop=[c for c, kind in names.items() if kind == "timestamp_ntz"])
    found = read_silver(spark, f"{layout.silver}/fhv", contract)
    assert dict(found.dtypes)[number] == "int" and found.columns == [*contract.columns, *PERIOD]
    assert sorted((r["month"], r[number]) for r in found.collect()) == [(1, 7), (2, 8), (3, 9)]


def test_quality_states_merge_to_the_scorecard(spark, stars, sf_dir, tmp_path):
    from tripmill.operators import quality
    from tripmill.operators.contracts import Rule
    from tripmill.plans import layers, warehouse

    rows = layers.silver(spark, sf_dir)["a"]
    rules = [*warehouse.QUALITY["a"], Rule("at_least", "absent", 0), Rule("between", "fare", 0, 1)]
    card = sorted(map(tuple, quality.evaluate(rows, "a", rules).collect()))
    assert sorted(map(tuple, quality.score(quality.states(rows, rules, PERIOD), "a", rules).collect())) == card
    none = rows.filter("false")
    assert sorted(map(tuple, quality.score(quality.states(none, rules, PERIOD), "a", rules, columns=rows.columns).collect())) == sorted(
        map(tuple, quality.evaluate(none, "a", rules).collect())
    )


def test_a_load_measures_its_own_months_only(spark, tmp_path):
    layout = lake(tmp_path)
    bronze = Path(layout.bronze)
    tripdata.write_bronze(spark, bronze)
    pipeline.run_silver(spark, layout, trips.MODEL)
    card = sorted(map(tuple, pipeline.scored(spark, layout, trips.MODEL).collect()))
    states = lambda: spark.read.parquet(f"{layout.gold}/dq_states")
    before = states().count()
    tripdata.write_month(spark, bronze, "fhv", (2025, 3), [row("2025-03-05")])
    pipeline.run_silver(spark, layout, trips.MODEL)
    again = sorted(map(tuple, pipeline.scored(spark, layout, trips.MODEL).collect()))
    assert states().count() == before + len(trips.QUALITY["fhv"]) and len(again) == len(card) == 33
    assert states().filter("year = 2025 and month = 3").count() == len(trips.QUALITY["fhv"])
    months = pipeline.scored(spark, layout, trips.MODEL, PERIOD).filter("table_name = 'fhv'")
    assert months.count() == 2 * len(trips.QUALITY["fhv"])


def test_exclusions_with_months_meet_only_those(spark, stars):
    from tripmill.plans.warehouse import WORDS as WAREHOUSE

    whole = mart.trip_mart(stars[0], WAREHOUSE, ["trip_id", "fare", *PERIOD])
    listed = whole.filter("year = '1998' and month in ('2', '3')").limit(5).select("trip_id", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    left = mart.excluding(whole, listed)
    assert left.count() == whole.count() - 5 and mart.excluding(whole, listed.limit(0)).count() == whole.count()
    assert sorted(map(str, left.collect())) == sorted(map(str, mart.excluding(whole, listed.select("trip_id")).collect()))
    assert re.search(r"PartitionFilters: \[[^\]]*1998", plan(left))
