"""Hard negatives against brute force, and the tree's ranges against its rows."""

from __future__ import annotations

import math

import numpy as np

from tripmill.llm import hardneg

SHAPE = "vec_id bigint, embedding array<float>, label int"


def brute(rows, first=5):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((vec_id, label, [math.floor(256 * float(np.float32(v))) for v in vector]))
    found = []
    for n, (anchor, label, vector) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), i, other) for m, (i, other, v) in enumerate(used) if m != n and len(v) == len(vector)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, positive, _ in [s for s in scored if s[2] == label][:first]:
            fits = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:first]
            found += [(anchor, positive, rank, s[1], score, s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(found, key=repr)


def clustered(count, seed, dims=12):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((25, dims))
    rows = centres[dice.integers(0, 25, count)] + dice.standard_normal((count, dims)) * 0.3
    return [(i, [float(np.float32(v)) for v in row], int(dice.integers(0, 4))) for i, row in enumerate(rows)]


def mine(spark, rows, **settings):
    table = spark.createDataFrame(rows, SHAPE).repartition(6)
    return sorted((tuple(r) for r in hardneg.mined(table, **settings).collect()), key=repr)


def test_mining_equals_brute_force(spark):
    rows = clustered(1500, 1)
    rows += [(i, rows[3][1], 1) for i in range(1500, 1900)]  # one common vector, more than a leaf of equal rows
    rows += [(2000, None, 1), (2100, [float("nan")] * 12, 1), (2200, [None, *[1.0] * 11], 1), (2300, rows[5][1], None), (None, rows[0][1], 2), (None, None, None)]
    rows += [(2400, [0.0] * 12, 3), (2500, [1.0, 2.0], 1), (2501, [1.0, 2.5], 1), (2502, [1.0, 2.4], 2), (2600, [], 1), (100, rows[7][1], 0), (2700, rows[9][1], 77)]
    found = mine(spark, rows, leaf=64)
    assert found == brute(rows) and len(found) > 100


def test_large_components_and_first(spark):
    rows = [(100 * i, [1e30 * (i % 5), -3e20 * i, 7.25], i % 3) for i in range(12)]
    few = mine(spark, clustered(300, 4), first=2, leaf=32)
    assert few == brute(clustered(300, 4), first=2)
    assert len(mine(spark, rows)) > 0


def test_empty_and_extra_columns(spark):
    table = spark.createDataFrame([], SHAPE)
    assert hardneg.mining_query(table).collect() == []
    rows = clustered(250, 2)
    extra = spark.createDataFrame([(*r, "n", "k", "s") for r in rows], SHAPE + ", node string, key string, score string")
    assert sorted((tuple(r) for r in hardneg.mining_query(extra).collect()), key=repr) == brute(rows)


def test_ranges_hold_every_row_and_drop_siblings(spark):
    rows = hardneg.saved(hardneg.points(spark.createDataFrame(clustered(1200, 3), SHAPE)), "rows")
    levels, leaves = hardneg.grow(rows, 64)
    assert leaves.count() == 1200 and len(levels) >= 2
    top, placed = levels[0].toPandas().sort_values("split"), leaves.toPandas()
    centres, lift = np.array(top["vector"].tolist()), top["lift"].to_numpy()
    for child, low, high in zip(top["child"], top["low"], top["high"]):
        inside = placed[placed["node"].str.startswith(child + ".") | (placed["node"] == child)]
        far = hardneg.gaps(np.array(inside["vector"].tolist()), inside["lift"].to_numpy(), centres, lift)
        assert np.allclose(far.min(0), low[: len(centres)]) and np.allclose(far.max(0), high[: len(centres)])
    narrow = hardneg.F.array(hardneg.window_of(hardneg.F.lit(0), hardneg.F.lit(900_000), hardneg.F.lit(hardneg.BOUND)))
    queries = rows.filter("id % 50 = 0").select("key", hardneg.F.col("key").alias("row"), "label", "vector", narrow.alias("windows"))
    looked = hardneg.descend(queries, levels, False).count()
    assert looked < 0.5 * queries.count() * leaves.select("node").distinct().count()


def test_groups_larger_than_a_task_take_few_jobs(spark, monkeypatch):
    """The driver keeps something of every job, so there must not be more of them for a deeper tree."""
    monkeypatch.setattr(hardneg, "GROUP_BYTES", 150 * 12 * 8, raising=False)
    monkeypatch.setattr(hardneg, "ASKED", 5, raising=False)
    rows = clustered(900, 6) + [(i, clustered(1, 7)[0][1], i % 3) for i in range(900, 1300)]
    spark.sparkContext.setJobGroup("mining", "mining")
    found = mine(spark, rows, leaf=32)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mining"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == brute(rows) and jobs < 80
