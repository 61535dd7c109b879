from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tripmill.operators import silver
from tripmill.operators.silver import (
    dedup_by_month,
    dedup_with_counts,
    keep_valid,
    mark_valid,
    pending_periods,
    reconcile,
)
from tripmill.plans import layers
from tripmill.sources.tables import (
    loaded_periods,
    overwrite_periods,
    read_load,
    write_silver,
)

DDL = "id int, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, year int, month int"


def frame(spark, rows):
    texts = [(i, p, d, y, m) for i, p, d, y, m in rows]
    raw = spark.createDataFrame(texts, "id int, p string, d string, year int, month int")
    return raw.select("id", F.col("p").cast("timestamp_ntz").alias("pickup_ts"), F.col("d").cast("timestamp_ntz").alias("dropoff_ts"), "year", "month")


ROWS = [
    (1, "2024-01-01 00:00:00", "2024-01-01 00:01:00", 2024, 1),
    (1, "2024-01-01 00:00:00", "2024-01-01 00:01:00", 2024, 1),
    (2, "2024-01-31 23:59:59", "2024-02-01 00:01:00", 2024, 1),
    (3, "2024-02-01 00:00:00", "2024-02-01 00:01:00", 2024, 1),
    (4, "2023-01-05 00:00:00", "2023-01-05 00:01:00", 2024, 1),
    (5, None, "2024-01-01 00:01:00", 2024, 1),
    (5, None, "2024-01-01 00:01:00", 2024, 1),
    (6, "2024-02-10 00:00:00", None, 2024, 2),
    (7, "2024-02-10 00:00:00", "2024-02-10 00:00:00", 2024, 2),
]


def test_dedup_and_validity(spark):
    grouped = dedup_with_counts(frame(spark, ROWS))
    assert {r["id"]: r["copies"] for r in grouped.collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1}
    assert {r["id"] for r in keep_valid(grouped).collect()} == {1, 2, 7}


def test_reconcile_levels(spark):
    marked = mark_valid(dedup_with_counts(frame(spark, ROWS)))
    levels = {
        (r["feed"], r["year"], r["month"]): (r["raw"], r["dedup"], r["clean"], r["removed"], round(r["removed_pct"], 2))
        for r in reconcile({"x": marked, "empty": marked.limit(0)}).collect()
    }
    assert levels == {
        ("x", 2024, 1): (7, 5, 2, 5, 71.43),
        ("x", 2024, 2): (2, 2, 1, 1, 50.0),
        ("x", 2024, None): (9, 7, 3, 6, 66.67),
        ("x", None, None): (9, 7, 3, 6, 66.67),
    }


def test_a_third_of_all_rows_being_one_row(spark):
    copies = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("pickup_ts"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("dropoff_ts"),
        F.lit(2024).alias("year"),
        F.lit(1).alias("month"),
    )
    grouped = dedup_with_counts(copies)
    assert grouped.count() == 20_001 and grouped.agg(F.max("copies")).first()[0] == 10_000
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    # partial count below the only exchange: copies collapse before they are shuffled
    assert plan.count("Exchange") == 1 and "partial_count" in plan.split("Exchange")[1]


def test_pending_periods(spark):
    candidates = spark.createDataFrame([("x", 2024, 1), ("x", 2024, 1), ("x", 2024, 2), ("y", 2024, 1)], "feed string, year int, month int")
    loaded = spark.createDataFrame([("x", 2024, 1)], "feed string, year int, month int")
    incremental = {tuple(r) for r in pending_periods(candidates, loaded).collect()}
    assert incremental == {("x", 2024, 2), ("y", 2024, 1)}
    assert pending_periods(candidates, loaded, full_load=True).count() == 3


def test_overwrite_replaces_only_its_periods(spark, tmp_path):
    path = f"{tmp_path}/t"
    whole = frame(spark, ROWS)
    overwrite_periods(whole, path)
    overwrite_periods(whole.filter("month = 2").withColumn("id", F.col("id") + 100), path)
    overwrite_periods(whole.filter("month = 2").withColumn("id", F.col("id") + 100), path)
    written = sorted((r["id"], r["month"]) for r in spark.read.parquet(path).collect())
    assert written == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 1), (106, 2), (107, 2)]


def test_counts_of_a_load_come_from_what_it_wrote(spark, tmp_path):
    path = f"{tmp_path}/x"
    marked = mark_valid(dedup_with_counts(frame(spark, ROWS)))
    write_silver(marked, path, "first")
    write_silver(marked.filter("month = 2"), path, "second", gather=False)
    total = {r["feed"]: r["raw"] for r in reconcile({"x": read_load(spark, path, "second")}).filter("year is null").collect()}
    assert total == {"x": 2}
    assert {tuple(r) for r in loaded_periods(spark, str(tmp_path), ["x", "absent"]).collect()} == {("x", 2024, 1), ("x", 2024, 2)}
    assert loaded_periods(spark, str(tmp_path), ["absent"]).count() == 0


def test_scratch_folder_must_be_named_off_local_mode():
    from types import SimpleNamespace

    from tripmill.session import scratch_root

    conf = SimpleNamespace(get=lambda name: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(sparkContext=context))


@pytest.mark.parametrize("slice_rows", [1, 500_000])
def test_months_are_dealt_once_and_copies_meet(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(silver, "SLICE_ROWS", slice_rows)
    rows = frame(spark, ROWS).withColumn("fare", F.lit(0.0))
    odd = rows.withColumn("fare", F.lit(-0.0)).unionByName(rows.withColumn("year", F.lit(None).cast("int")))
    several = rows.unionByName(odd).unionByName(rows.withColumn("fare", F.lit(float("nan"))))
    dealt = dedup_by_month(several)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, dedup_with_counts(several).collect()))
    plan = mark_valid(dealt)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(year" in plan
    assert dedup_by_month(several.limit(0)).count() == 0


def test_months_lie_together_after_a_load(spark, tmp_path):
    rows = spark.range(4_000).select(F.col("id"), F.lit(2024).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    marked = dedup_by_month(rows.unionByName(rows).repartition(16)).withColumn("accepted", F.lit(True))
    write_silver(marked, f"{tmp_path}/x", "first", gather=False)
    files = list((tmp_path / "x").glob("load_id=first/year=*/month=*/*.parquet"))
    assert len(files) == 12 and all(".zstd." in f.name for f in files)
    assert read_load(spark, f"{tmp_path}/x", "first").filter("copies = 2").count() == 4_000


@pytest.mark.parametrize("gather, stages, count", [(False, 1, 36), (True, 2, 12)])
def test_bronze_is_written_compactly_and_without_a_shuffle_on_request(spark, tmp_path, gather, stages, count):
    ids = spark.range(0, 2_400, 1, 3)
    rows = ids.select("id", F.lit("x").alias("NAME"), F.lit(2024).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    context = spark.sparkContext
    context.setJobGroup("bronze", "")
    try:
        layers.write_bronze(rows, f"{tmp_path}/x", gather)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(job) for job in context.statusTracker().getJobIdsForGroup("bronze")]
    assert (len({stage for job in jobs for stage in job.stageIds}) == 1) == (stages == 1)
    files = list((tmp_path / "x").glob("year=2024/month=*/*.parquet"))
    assert len(files) == count and all(".zstd." in f.name for f in files)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/x").select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
