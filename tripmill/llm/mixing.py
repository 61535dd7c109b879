"""Mixing sources to target weights by entropy balancing.

The rates closest to 1 in relative entropy that meet every source's token target, none above ``CAP``, are
``min(CAP, exp(lambda * size))`` with one multiplier per source. The multipliers solve the convex dual: Newton steps,
kept inside a bracket, each a grouped sum over all sources at once. The sums run over (source, size) with the
number of documents, so the documents themselves are read once. Sums are decimal, hence exact in any
order, and reruns agree.

Rates become copies by rounding a running total: documents of a source in order of size, copies being what the
rounded total gains at each; of several starts of that total the one nearest to the target counts. Copies differ from the rate by less than one, never exceed ``CAP``, and a source's
words differ from its target by about one of its longest documents at most. Places within one size
are counted in two levels (hash buckets, then inside a bucket), so a size that a third of all rows has
is no single task's.

Results by case: null text has size 0; a null source is a source of its own, the last; sources without words get target
0; an empty table gives no rows; rows that repeat an id, or have none, are rows of their own; columns of any other name pass
through ``mixed`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tripmill.llm.common import WORD, aside, saved
from tripmill.operators.star import dense_keys

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
UNIT = 1 << 20
ROUNDS, COARSE = 80, 1e-6
OFFSETS = 32


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, documents, target): weights by rank of the source, capped targets reshared."""
    totals = saved(
        cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")),
        "source-sizes",
    )
    ranks = dense_keys(totals.filter("source is not null"), "source", "rank")
    last = totals.filter("source is not null").count() + 1
    turn = F.pmod(F.coalesce("rank", F.lit(last)) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    weighed = saved(totals.join(ranks, "source", "left").withColumn("weight", weight).drop("rank"), "weights")
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= CAP * F.col("source_size")
        row = weighed.agg(
            F.count(F.when(full, 1)).alias("capped"),
            F.coalesce(F.sum(F.when(full, CAP * F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (share * words - float(row["held"])) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), (CAP * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", "documents", target.alias("target"))


def rate(multiplier: str = "multiplier"):
    """The tilted rate of a size; sources at their cap take everything ``CAP`` times."""
    tilt = F.least(F.col(multiplier) * F.col("size") / F.col("scale"), F.lit(math.log(CAP)))
    return F.when(F.col("full"), F.lit(float(CAP))).otherwise(F.exp(tilt))


def exact_sum(column):
    return F.sum(column.cast("decimal(28,8)")).cast("double")


def multipliers(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Newton on the dual, all sources at once; one row per source, and one number per round to the driver."""
    scale = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1.0))
    state = saved(
        targets.select(
            "source", "source_size", "target", scale.alias("scale"),
            (F.col("target") >= CAP * F.col("source_size")).alias("full"),
            F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ),
        "multipliers",
    )
    for _ in range(ROUNDS):
        tokens = F.col("n") * F.col("size") * rate()
        bend = F.when(rate() < CAP, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
        slopes = (
            cells.join(state.filter("not full").withColumnRenamed("source", "owner"), F.col("source").eqNullSafe(F.col("owner")))
            .groupBy("source")
            .agg(exact_sum(tokens).alias("tokens"), exact_sum(bend).alias("bend"))
            .withColumnRenamed("source", "owner")
        )
        miss = F.col("tokens") - F.col("target")
        moved = state.join(slopes, F.col("source").eqNullSafe(F.col("owner")), "left")
        moved = moved.withColumn("miss", F.coalesce(miss, F.lit(0.0))).withColumn("off", F.coalesce(F.abs(miss) / F.col("target"), F.lit(0.0)))
        moved = moved.withColumn("low", F.when(F.col("miss") < 0, F.col("multiplier")).otherwise(F.col("low")))
        moved = moved.withColumn("high", F.when(F.col("miss") > 0, F.col("multiplier")).otherwise(F.col("high")))
        step = F.when(F.col("bend") > 0, F.col("multiplier") - F.col("miss") / F.col("bend"))
        inside = step.isNotNull() & ((step > F.col("low")) | F.col("low").isNull()) & ((step < F.col("high")) | F.col("high").isNull())
        middle = (
            F.when(F.col("low").isNull(), F.col("high") * 2 - 1)
            .when(F.col("high").isNull(), F.col("low") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        settled = F.col("off") <= tolerance
        after = F.when(settled, F.col("multiplier")).when(inside, step).otherwise(middle)
        state = saved(
            moved.select("source", "source_size", "target", "scale", "full", after.alias("multiplier"), "low", "high", "off"), "multipliers"
        )
        off = state.agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
        state = state.drop("off")
    else:
        if off > COARSE:
            raise ArithmeticError(f"the rates miss a target by a share of {off} after {ROUNDS} rounds")
    return state.select("source", "source_size", "target", "scale", "full", "multiplier")


def with_best_offset(rated: DataFrame) -> DataFrame:
    """Where the running total of a source starts to be rounded is free: of ``OFFSETS`` starts, that whose words come
    nearest to the target. Worked out on (source, size), and added to ``total``."""
    starts = [k * UNIT // OFFSETS for k in range(OFFSETS)]
    words = [
        F.expr(f"sum(size * ((total + n * pace + {start}) div {UNIT} - (total + {start}) div {UNIT}))") for start in starts
    ]
    tries = [
        F.struct(F.abs(total - F.first("target")).alias("off"), F.lit(start).cast("bigint").alias("offset")) for total, start in zip(words, starts, strict=True)
    ]
    best = rated.groupBy("source").agg(F.array_min(F.array(*tries))["offset"].alias("offset")).withColumnRenamed("source", "owner")
    return (
        rated.join(best, F.col("source").eqNullSafe(F.col("owner")))
        .withColumn("total", F.col("total") + F.col("offset"))
        .drop("owner", "offset", "n")
    )


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row."""
    rows = saved(sized(docs), "sizes")
    cells = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    solved = multipliers(cells, source_targets(cells, weights, share)).withColumnRenamed("source", "owner")
    pace = F.round(rate() * UNIT).cast("bigint")
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        cells.join(solved, F.col("source").eqNullSafe(F.col("owner")))
        .withColumn("pace", pace)
        .withColumn("total", F.coalesce(F.sum(F.col("n") * F.col("pace")).over(before), F.lit(0)))
        .select("source", "size", "n", "source_size", "target", "pace", "total")
    )
    rated = with_best_offset(saved(rated, "rates"))
    buckets = max(1, math.isqrt(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = salted.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    starts = starts.join(
        rated.withColumnsRenamed({"source": "r_source", "size": "r_size"}),
        F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")),
    ).select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "start", "source_size", "target", "pace", "total"
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    placed = salted.withColumn("place", place).join(
        starts,
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")),
    )
    copies = F.expr(
        f"(total + pace * (start + place + 1)) div {UNIT} - (total + pace * (start + place)) div {UNIT}"
    )
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixing_query(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixed corpus: every row as often as it has copies, columns as given. A row is known by a digest of its id, text and
    source; rows equal in these share their copies as evenly as whole copies allow, numbered where they lie and then over
    their partitions, so a row that a third of the table repeats is no single task's."""
    hidden, back = aside(docs, "doc_id", "text", "source")
    keyed = hidden.withColumn("row_key", F.xxhash64("doc_id", "text", F.lit("source"), "source"))
    planned = plan(keyed.select(F.col("row_key").alias("doc_id"), "text", "source"), weights, share)
    spread = planned.groupBy(F.col("doc_id").alias("row_key")).agg(F.sum("copies").alias("all_copies"), F.count("*").alias("all_rows"))
    spread = saved(spread, "copies")
    # Keys grow with the documents, so those of single rows are never broadcast; repeated ones are joined apart, texts shuffled once.
    once = keyed.join(spread.filter("all_rows = 1").hint("merge"), "row_key").withColumn("times", F.col("all_copies"))
    repeated = saved(spread.filter("all_rows > 1"), "repeated-keys")
    more = saved(keyed.join(repeated, "row_key").withColumn("part", F.spark_partition_id()), "repeated-rows")
    counts = more.groupBy("row_key", "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("row_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("row_key", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("start"))
    turn = F.col("start") + F.row_number().over(Window.partitionBy("row_key", "part").orderBy("row_key"))
    more = more.join(counts, ["row_key", "part"]).withColumn("turn", turn)
    more = more.withColumn("times", F.expr("all_copies div all_rows + int(turn <= all_copies % all_rows)"))
    both = once.unionByName(more.drop("part", "start", "turn"))
    copied = both.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copied.select(*back)
