from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tripdata
from tripmill.operators import checks, mart, reports, tiles
from tripmill.operators.conform import conform, conform_variants
from tripmill.operators.contracts import PERIOD
from tripmill.plans import pipeline, trips
from tripmill.plans.original_names import register_original_views
from tripmill.sources.bronze import AMBIGUOUS, probed, read_feed
from tripmill.sources.landing import manifest
from tripmill.sources.places import read_zones
from tripmill.sources.tables import export_csv, loaded_periods, read_silver, tolerant_silver

WORDS = trips.WORDS
SOURCE = "https://files.example/trips"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    layout = pipeline.Layout(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    tripdata.write_bronze(spark, root / "bronze")
    zones = read_zones(spark, tripdata.write_zones(root / "zones.csv"))
    result = pipeline.run(spark, layout, trips.MODEL, trips.expected_calendar(spark), zones, SOURCE)
    return layout, zones, result


def fact_rows(spark, layout):
    fact = pipeline.read_star(spark, layout.gold)["fact_trip"]
    return sorted(map(tuple, fact.select(sorted(fact.columns)).collect()), key=repr)


def test_stage_counts(built):
    _, _, result = built
    feeds = result.silver.stages.filter("year is null")
    found = {row["feed"]: (row["raw"], row["dedup"], row["clean"]) for row in feeds.collect()}
    assert found == tripdata.EXPECTED
    months = result.silver.stages.filter("month is not null").collect()
    assert all(row["raw"] >= row["dedup"] >= row["clean"] for row in months)
    assert all(row["removed"] == row["raw"] - row["clean"] for row in months)
    assert all(not bad for bad in result.silver.unreadable.values())


def test_missing_periods_are_the_calendar_without_the_files(spark, built):
    _, _, result = built
    expected = trips.expected_calendar(spark)
    assert result.landing.gap.count() == expected.count() - 6
    # computed when asked for: by now silver holds every period but that of the tiny fixture files
    assert result.landing.pending.count() == 0
    assert expected.filter("feed = 'fhvhv'").agg(F.min(F.struct(*PERIOD))).first()[0] == (2019, 2)


def test_drifting_types_become_one_frame(spark, built):
    layout, _, _ = built
    contract = trips.CONTRACTS["yellow"]
    files = manifest(spark, layout.bronze).filter("feed = 'yellow'")
    read = read_feed(spark, layout.bronze, files, contract)
    assert len(read.frames) == 3 and read.periods == 3
    silver = read_silver(spark, f"{layout.silver}/yellow", contract)
    assert dict(silver.dtypes)["passenger_count"] == "int"
    by_month = {
        row["month"]: (row["passengers"], row["fees"])
        for row in silver.groupBy("month")
        .agg(F.max("passenger_count").alias("passengers"), F.count("core_zone_fee").alias("fees"))
        .collect()
    }
    assert by_month == {12: (1, 0), 1: (1, 2), 2: (3, 1)}


def test_text_is_cleaned(spark, built):
    layout, _, _ = built
    app = read_silver(spark, f"{layout.silver}/fhvhv", trips.CONTRACTS["fhvhv"])
    assert {tuple(r) for r in app.select("shared_request_flag", "access_a_ride_flag").distinct().collect()} == {("N", "")}


def test_gold_sizes(spark, built):
    layout, _, result = built
    sizes = {r["table_name"]: r["total_rows"] for r in checks.row_counts(pipeline.read_star(spark, layout.gold)).collect()}
    assert sizes == result.gold
    assert sizes["dim_service"] == 7 and sizes["dim_distance_band"] == 6 and sizes["dim_time_band"] == 7
    assert sizes["dim_place"] == 10 and sizes["dim_tip_status"] == sizes["dim_congestion_status"] == 2
    assert sizes["fact_trip"] == sum(clean for _, _, clean in tripdata.EXPECTED.values())


def test_fact_values(spark, built):
    layout, _, _ = built
    star = pipeline.read_star(spark, layout.gold)
    joined = star["fact_trip"].join(star["dim_operator"], "operator_id")
    rows = {
        (r["pickup_ts"].strftime("%m-%d %H"), r["operator"]): r
        for r in joined.collect()
    }
    first = rows["12-05 05", "CMT"]
    assert (first["service_id"], first["distance_band_id"], first["time_band_id"]) == (1, 2, 1)
    assert (first["duration_s"], first["other_fees"], first["payment_class"]) == (900, 1.5, "DEMAIS")
    assert (first["core_zone_fee"], first["core_fee_status_id"], first["congestion_status_id"]) == (0.0, 2, 1)
    cash = rows["12-01 00", "VERIFONE"]
    assert (cash["payment_class"], cash["tip_status_id"], cash["fare"]) == ("DINHEIRO", 2, 10.0)
    backwards = rows["12-09 12", "OUTRO"]
    assert (backwards["duration_s"], backwards["distance_mi"], backwards["distance_band_id"]) == (-600, 0.0, 1)
    assert rows["01-03 20", "CMT"]["pickup_place_id"] == 0
    assert rows["01-03 20", "CMT"]["distance_band_id"] == 1 and rows["01-03 20", "CMT"]["time_band_id"] == 7
    assert rows["01-02 17", "CMT"]["distance_band_id"] == 6 and rows["01-02 17", "CMT"]["time_band_id"] == 6
    assert [rows[key]["service_id"] for key in (("01-05 09", "HV0003"), ("01-05 14", "HV0005"), ("01-05 12", "HV0004"), ("01-05 12", "HV9999"))] == [3, 4, 5, 6]
    assert rows["01-05 14", "HV0005"]["duration_s"] == 1200 and rows["01-05 09", "HV0003"]["duration_s"] == 900
    assert rows["01-05 09", "HV0003"]["fund_fee"] == 0.5 and rows["01-05 09", "HV0003"]["other_fees"] == 1.5
    base = rows["12-31 23", "B00100"]
    assert (base["service_id"], base["dropoff_place_id"], base["fare"], base["payment_class"]) == (7, 266, 0.0, "DEMAIS")
    ids = [r["trip_id"] for r in rows.values()]
    assert len(set(ids)) == len(ids) == 13


def test_regions(spark, built):
    layout, _, _ = built
    place = pipeline.read_star(spark, layout.gold)["dim_place"]
    assert {r["place_id"]: r["region_group"] for r in place.collect()} == {
        1: "AEROPORTO",
        4: "MANHATTAN CBD",
        12: "MANHATTAN CBD",
        24: "MANHATTAN SEM CBD",
        56: "OUTROS BAIRROS",
        57: "OUTROS BAIRROS",
        61: "OUTROS BAIRROS",
        132: "AEROPORTO",
        264: "DESCONHECIDOS",
        265: "DESCONHECIDOS",
    }


def test_orphans_tell_unknown_ids_from_no_place(spark, built):
    layout, _, _ = built
    found = {r["role"]: (r["orphan_trips"], r["no_place_trips"]) for r in checks.orphans(pipeline.read_star(spark, layout.gold)).collect()}
    assert found == {"pickup": (0, 2), "dropoff": (2, 0)}


def test_second_run_changes_nothing(spark, built):
    layout, zones, first = built
    before = fact_rows(spark, layout)
    again = pipeline.run(spark, layout, trips.MODEL, trips.expected_calendar(spark), zones, SOURCE)
    assert again.silver.stages is None  # nothing pending
    assert fact_rows(spark, layout) == before
    full = pipeline.run(spark, layout, trips.MODEL, trips.expected_calendar(spark), zones, SOURCE, full_load=True)
    feeds = full.silver.stages.filter("year is null")
    assert {r["feed"]: (r["raw"], r["dedup"], r["clean"]) for r in feeds.collect()} == tripdata.EXPECTED
    assert fact_rows(spark, layout) == before
    assert full.gold == first.gold


def test_quality_does_not_block_unless_asked(spark, built):
    layout, _, result = built
    card = {(r["table_name"], r["rule"]): r["outcome"] for r in result.quality.collect()}
    assert len(card) == 33
    assert card["yellow", "distance_mi >= 0"] == "FAIL"
    assert card["green", "row_count > 0"] == "PASS"
    with pytest.raises(pipeline.QualityFailure):
        pipeline.run_quality(spark, layout, trips.MODEL, fail_on=frozenset({"FAIL"}))
    pipeline.run_quality(spark, layout, trips.MODEL, fail_on=frozenset({"ERROR"}))


def test_period_with_an_unreadable_file_waits_and_is_completed(spark, tmp_path):
    bronze = tmp_path / "bronze"
    row = tripdata.dispatch("2024-12-30 10:00:00", "2024-12-30 10:10:00")
    tripdata.write_month(spark, bronze, "fhv", (2024, 12), [row])
    (bronze / "fhv/year=2024/month=12/broken.parquet").write_bytes(b"PAR1 not really")
    (bronze / "fhv/year=2025/month=01").mkdir(parents=True)
    (bronze / "fhv/year=2025/month=01/broken.parquet").write_bytes(b"PAR" * 600)
    layout = pipeline.Layout(str(bronze), f"{tmp_path}/silver", f"{tmp_path}/gold")
    result = pipeline.run_silver(spark, layout, trips.MODEL)
    assert [path.rsplit("/", 3)[1:] for path, _ in sorted(result.unreadable["fhv"])] == [
        ["year=2024", "month=12", "broken.parquet"],
        ["year=2025", "month=01", "broken.parquet"],
    ]
    assert loaded_periods(spark, layout.silver, ["fhv"]).collect() == []  # held back, not loaded in part
    (bronze / "fhv/year=2024/month=12/broken.parquet").unlink()
    tripdata.write_month(spark, bronze, "fhv", (2025, 2), [row])
    small = bronze / "fhv/year=2025/month=03"
    small.mkdir(parents=True)
    (small / "small.parquet").write_bytes(b"PAR1PAR1")
    again = pipeline.run_silver(spark, layout, trips.MODEL)
    assert [path.rsplit("/", 1)[1] for path, _ in again.unreadable["fhv"]] == ["broken.parquet"]
    found = read_silver(spark, f"{layout.silver}/fhv", trips.CONTRACTS["fhv"])
    assert [(r["year"], r["month"]) for r in found.collect()] == [(2024, 12)]


def test_landing_tells_unreadable_from_absent_and_remembers_failures(spark, tmp_path):
    bronze = tmp_path / "bronze"
    layout = pipeline.Layout(str(bronze), f"{tmp_path}/silver", f"{tmp_path}/gold")
    rows = [tripdata.dispatch("2024-12-30 10:00:00", "2024-12-30 10:10:00")]
    tripdata.write_month(spark, bronze, "fhv", (2024, 12), rows)
    broken = bronze / "fhv/year=2025/month=01"
    broken.mkdir(parents=True)
    (broken / "fhv_tripdata_2025-01.parquet").write_bytes(b"x" * 2000)
    small = bronze / "fhv/year=2025/month=02"
    small.mkdir(parents=True)
    (small / "fhv_tripdata_2025-02.parquet").write_bytes(b"x" * 5)
    expected = trips.expected_calendar(spark)

    def outcomes(result):
        chosen = result.status.filter("feed = 'fhv' and storage_key rlike '2024-12|2025-0[123]'")
        return {(r["year"], r["month"]): (r["status"], (r["error"] or "")[:12]) for r in chosen.collect()}

    first = pipeline.run_landing(spark, layout, trips.MODEL, expected, SOURCE)
    found = outcomes(first)
    assert found[2024, 12] == ("OK", "") and found[2025, 3] == ("SKIP_404", "")
    assert found[2025, 1][0] == found[2025, 2][0] == "FAIL" and found[2025, 1][1] == "RuntimeExcep"
    urls = {r["url"].rsplit("/", 1)[1] for r in first.pending.collect()}
    assert urls == {"fhv_tripdata_2025-01.parquet", "fhv_tripdata_2025-02.parquet"}
    (broken / "fhv_tripdata_2025-01.parquet").unlink()
    tripdata.write_month(spark, bronze, "fhv", (2025, 1), rows)
    second = pipeline.run_landing(spark, layout, trips.MODEL, expected, SOURCE)
    assert outcomes(second)[2025, 1][0] == "OK"
    assert {r["storage_key"] for r in second.pending.collect()} == {
        "fhv/year=2025/month=02/fhv_tripdata_2025-02.parquet"
    }


def test_full_load_replaces_months_whole(spark, tmp_path):
    bronze = tmp_path / "bronze"
    layout = pipeline.Layout(str(bronze), f"{tmp_path}/silver", f"{tmp_path}/gold")
    good = tripdata.dispatch("2024-12-30 10:00:00", "2024-12-30 10:10:00")
    late = tripdata.dispatch("2025-03-30 10:00:00", "2025-03-30 10:10:00")  # of another month: rejected
    (folder := bronze / "fhv/year=2024/month=12").parent.mkdir(parents=True)
    for row, kept in ((good, 1), (late, 0), (good, 1)):
        for old in folder.glob("*"):
            old.unlink()
        tripdata.write_month(spark, bronze, "fhv", (2024, 12), [row])
        stages = pipeline.run_silver(spark, layout, trips.MODEL, full_load=True).stages.filter("year is null").first()
        found = read_silver(spark, f"{layout.silver}/fhv", trips.CONTRACTS["fhv"]).count()
        assert found == kept == stages["clean"]


def test_one_year_at_a_time_equals_one_run(spark, built, tmp_path):
    layout, _, _ = built
    apart = pipeline.Layout(layout.bronze, f"{tmp_path}/silver", f"{tmp_path}/gold")
    loads = [pipeline.run_silver(spark, apart, trips.MODEL, years=[y], audit_casts=True) for y in (2024, 2025)]
    for feed, contract in trips.CONTRACTS.items():
        whole = read_silver(spark, f"{layout.silver}/{feed}", contract)
        parts = read_silver(spark, f"{apart.silver}/{feed}", contract)
        assert whole.exceptAll(parts).count() == parts.exceptAll(whole).count() == 0
    assert all(r["lost"] == 0 for load in loads for r in load.losses.collect())


def test_names_equal_up_to_case_in_one_file(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1.0, None), (None, 2.0)], "Airport_fee double, airport_fee double")
        df.write.parquet(f"{tmp_path}/yellow/year=2024/month=01")
        files = manifest(spark, str(tmp_path))
        read = read_feed(spark, str(tmp_path), files, trips.CONTRACTS["yellow"])
        merged = conform(read.frames[0], trips.CONTRACTS["yellow"])
        assert sorted(r["airport_fee"] for r in merged.collect()) == [1.0, 2.0]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    refused = read_feed(spark, str(tmp_path), manifest(spark, str(tmp_path)), trips.CONTRACTS["yellow"])
    assert not refused.frames and "caseSensitive" in refused.unreadable[0][1]


def test_files_of_one_month_that_disagree_are_read_apart(spark, tmp_path):
    import pandas as pd

    contract = trips.CONTRACTS["yellow"]

    def write(month, name, **columns):
        folder = tmp_path / f"yellow/year=2024/month={month:02d}"
        folder.mkdir(parents=True, exist_ok=True)
        pd.DataFrame(columns).to_parquet(folder / f"{name}.parquet", index=False)

    for month in range(1, 7):  # types alternate, so no halving of the year agrees
        write(month, "a", VendorID=[1] if month % 2 else [1.0])
    write(2, "b", vendorid=[2], other=["x"])
    write(3, "none", VendorID=pd.Series([], dtype="int64"))  # no rows, yet readable
    write(4, "unrelated", other=[1])
    write(5, "broken", VendorID=[1])
    broken = tmp_path / "yellow/year=2024/month=05/broken.parquet"
    broken.write_bytes(broken.read_bytes()[:-30])
    write(6, "twice", VendorID=[1], vendorid=[2])
    files = manifest(spark, str(tmp_path))
    read = read_feed(spark, str(tmp_path), files, contract)
    assert {path.rsplit("/", 1)[1] for path, _ in read.unreadable} == {"broken.parquet", "twice.parquet"}
    assert dict((path.rsplit("/", 1)[1], error) for path, error in read.unreadable)["twice.parquet"] == AMBIGUOUS
    assert read.periods == 4  # months 5 and 6 wait
    kinds = sorted(str(sorted(f.name + " " + f.dataType.simpleString() for f in frame.schema if f.name not in PERIOD)) for frame in read.frames)
    assert kinds == ["['VendorID bigint']", "['VendorID double']", "['vendorid bigint']"]
    rows = conform_variants(read.frames, contract).select("month", "operator_code").collect()
    expected = [(1, "1"), (2, "1.0"), (2, "2"), (3, "1"), (4, "1.0"), (4, "None")]
    assert sorted((m, str(v)) for m, v in rows) == expected
    (strange := tmp_path / "green/year=2024/month=01").mkdir(parents=True)
    pd.DataFrame({"other": [1, 2]}).to_parquet(strange / "a.parquet", index=False)
    green = read_feed(spark, str(tmp_path), manifest(spark, str(tmp_path)).filter("feed = 'green'"), trips.CONTRACTS["green"])
    assert conform_variants(green.frames, trips.CONTRACTS["green"]).filter("operator_code is null").count() == 2
    errors = {r["path"].rsplit("/", 1)[1] for r in probed(files, contract).filter("error is not null").collect()}
    assert errors == {"broken.parquet", "twice.parquet"}


def test_a_file_that_is_gone_stops_the_run(spark, tmp_path):
    tripdata.write_month(spark, tmp_path, "fhv", (2024, 12), [tripdata.dispatch("2024-12-30 10:00:00", "2024-12-30 10:10:00")])
    files = manifest(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "month=12", "month=11"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_feed(spark, str(tmp_path), files, trips.CONTRACTS["fhv"])


def test_no_silver_at_all_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tolerant_silver(spark, str(tmp_path), trips.CONTRACTS)


def test_missing_feed_is_skipped(spark, built):
    layout, _, _ = built
    extra = {**trips.CONTRACTS, "never": trips.CONTRACTS["fhv"]}
    found, missing = tolerant_silver(spark, layout.silver, extra)
    assert missing == ["never"] and set(found) == set(trips.CONTRACTS)


def test_reports_on_the_trip_binding(spark, built):
    layout, _, _ = built
    star = pipeline.read_star(spark, layout.gold)
    share = {(r["year_month"], r["service_group"]): (r["total_trips"], r["share_pct"]) for r in reports.market_share(star, WORDS).collect()}
    assert share == {
        ("2024-12", "TAXI"): (3, 60.0),
        ("2024-12", "APLICATIVO DE TRANSPORTE"): (2, 40.0),
        ("2025-01", "TAXI"): (3, 42.86),
        ("2025-01", "APLICATIVO DE TRANSPORTE"): (4, 57.14),
        ("2025-02", "TAXI"): (1, 100.0),
    }
    kpi = reports.fee_kpi(star, trips.FEE_PERIOD).collect()
    assert {r["service_group"]: (r["total_fee"], r["mean_fee"]) for r in kpi} == {
        "TAXI": (2.25, 0.75),
        "APLICATIVO DE TRANSPORTE": (6.0, 1.5),
    }
    compared = reports.before_after(star, WORDS, trips.PLACES, *trips.COMPARED_PERIODS).collect()
    # The December trip with place id 0 has no row in the place dimension: the inner join drops it.
    assert {(r["period"], r["region"]): r["total_trips"] for r in compared} == {
        ("DEZ-2024", "DENTRO CBD"): 3,
        ("DEZ-2024", "FORA CBD"): 1,
        ("JAN-2025", "DENTRO CBD"): 5,
        ("JAN-2025", "FORA CBD"): 1,
    }
    by_rule = {
        rule: sorted(map(tuple, reports.core_zone_volume(star, WORDS, trips.PLACES, (2025, 1), rule).collect()))
        for rule in ("service_zone", "region", "district")
    }
    assert by_rule["service_zone"] == by_rule["region"] == by_rule["district"] == [
        ("APLICATIVO DE TRANSPORTE", "CBD ZONE (BELOW 60TH)", 3),
        ("TAXI", "CBD ZONE (BELOW 60TH)", 2),
    ]
    scatter = reports.tip_scatter(star, WORDS, trips.SCATTER_YEAR)
    assert scatter.count() == 5
    assert {r["era"] for r in reports.tip_by_era(star, WORDS).collect()} == {"POS-PANDEMIA"}


def test_every_tile_builds_and_filters_apply(spark, built, tmp_path):
    layout, _, _ = built
    star = pipeline.read_star(spark, layout.gold)
    board = tiles.dashboard_tiles(WORDS, trips.CORE_TILE_YEARS)
    assert len(board) == 11
    volume = tiles.build_tile(star, WORDS, board["tile_volume"], {"pickup_district": ["MANHATTAN"], "year": "2025", "month": mart.ALL})
    assert {tuple(r) for r in volume.collect()} == {
        ("2025-01", "TAXI", 2),
        ("2025-01", "APLICATIVO DE TRANSPORTE", 3),
        ("2025-02", "TAXI", 1),
    }
    core = tiles.build_tile(star, WORDS, board["tile_core_volume"], ranges={"year_month": ("2025-02", None)})
    assert [tuple(r) for r in core.collect()] == [("2025-02", "TAXI", 1)]
    tip = board["tile_tip_by_band_hour"]
    spread = tiles.heat_map(tiles.build_tile(star, WORDS, tip), tip, [label for _, label in WORDS.time_bands])
    assert spread.columns == ["distance_band", *(label for _, label in WORDS.time_bands)]
    assert spread.filter("distance_band = '1-3 MILHAS'").first()["NOITE"] == 0.01
    export_csv(volume, f"{tmp_path}/tile")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/tile").count() == 3


def test_exclusions_by_trip_id(spark, built):
    layout, _, _ = built
    star = pipeline.read_star(spark, layout.gold)
    whole = mart.trip_mart(star, WORDS)
    assert len(whole.columns) == 31
    gone = whole.select("trip_id").limit(2)
    assert mart.excluding(whole, gone).count() == whole.count() - 2
    assert mart.excluding(whole, gone.limit(0)).count() == whole.count()


def test_sql_under_original_names(spark, built):
    layout, _, _ = built
    register_original_views(pipeline.read_star(spark, layout.gold))
    rows = spark.sql(
        """
        select l.zona as zona_embarque, t.grupo_tipo_transporte, count(*) as total_corridas
        from fato_corrida f
        join dim_tipo_transporte t on f.id_tipo_transporte = t.id_tipo_transporte
        join dim_local l on f.id_local_embarque = l.id_local
        group by l.zona, t.grupo_tipo_transporte order by total_corridas desc, 1, 2 limit 2
        """
    ).collect()
    assert [tuple(r) for r in rows] == [("ALPHA CITY", "TAXI", 6), ("LOW PARK", "APLICATIVO DE TRANSPORTE", 3)]
    fact = spark.table("fato_corrida")
    assert len(fact.columns) == 26
    assert spark.sql("select sum(valor_gorjeta) > 0 from fato_corrida where ano_mes = '2025-01'").first()[0]
