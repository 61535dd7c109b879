"""Bronze -> silver -> quality -> gold as plain function calls over tables."""

from __future__ import annotations

import time
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.operators import quality, star, summary
from tripmill.operators.conform import cast_losses, conform_variants
from tripmill.operators.contracts import PERIOD, StarModel
from tripmill.operators.silver import dedup_by_month, dedup_with_counts, mark_valid, reconcile, stage_counts
from tripmill.session import lookup
from tripmill.sources import landing, ledger
from tripmill.sources.bronze import probed, read_feed
from tripmill.sources.landing import KEY, manifest
from tripmill.sources.files import delete, folder_names, path_exists
from tripmill.sources.tables import (
    CODEC,
    current_version,
    expire_versions,
    loaded_periods,
    publish,
    publish_after,
    read_load,
    read_silver,
    read_table,
    tolerant_silver,
    write_silver,
)

DIMS = (
    "dim_service",
    "dim_operator",
    "dim_place",
    "dim_distance_band",
    "dim_time_band",
    "dim_tip_status",
    "dim_congestion_status",
)
TABLES = (*DIMS, "fact_trip")
# The fact and its summary lie in folders by build and month; the published table of months says which build counts.
MONTHS, FACT, SUMMARY, BATCH = "fact_months", "fact_trip", "trip_summary", "batch"


@dataclass(frozen=True)
class Layout:
    bronze: str
    silver: str
    gold: str


@dataclass(frozen=True)
class LandingResult:
    """``status``: outcome per expected period. ``gap``: periods still to fetch. ``pending``: the
    recorded failures whose file has not landed since."""

    status: DataFrame
    gap: DataFrame
    pending: DataFrame


@dataclass(frozen=True)
class SilverResult:
    """``stages``: month, year and feed level counts of this load. ``unreadable``: per feed, the
    (path, error) of files that were skipped. ``losses``: values lost to casts, when audited."""

    load_id: str
    stages: DataFrame | None
    unreadable: Mapping[str, list[tuple[str, str]]]
    losses: DataFrame | None


class QualityFailure(RuntimeError):
    pass


def new_load_id() -> str:
    return f"{time.time_ns():020d}"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def run_landing(
    spark: SparkSession, layout: Layout, model: StarModel, expected: DataFrame, source: str
) -> LandingResult:
    """Compare what lies in bronze with what should, and keep the table of failures up to date.

    Periods that silver already holds count as there before; the footers of the others are
    probed, so that a file that cannot be read is a failure and not an absence.
    """
    files = manifest(spark, layout.bronze)
    before = loaded_periods(spark, layout.silver, list(model.contracts))
    fresh = files.join(before, KEY, "left_anti")
    tried = _union([probed(fresh.filter(F.col("feed") == feed), c) for feed, c in model.contracts.items()])
    # One row per period; written, so that what follows does not probe the footers again.
    publish(landing.status(expected, before, landing.attempts(tried)), layout.gold, "landing_status")
    status = read_table(spark, layout.gold, "landing_status")
    letters = f"{layout.gold}/dead_letter"
    failed = landing.failures(status, source, F.lit(new_load_id()))
    failed.hint("rebalance").write.mode("append").parquet(letters)
    landed = status.filter(F.col("status").isin(landing.OK, landing.SKIP_EXISTS))
    latest = landing.latest_failures(spark.read.parquet(letters), ["attempt"])
    missing = expected.join(landed.select(*KEY), KEY, "left_anti")  # also what is there but failed
    return LandingResult(status, missing, landing.pending_failures(latest, landed))


def run_silver(
    spark: SparkSession,
    layout: Layout,
    model: StarModel,
    full_load: bool = False,
    years: Sequence[int] | None = None,
    audit_casts: bool = False,
    gather: bool = True,
) -> SilverResult:
    """One job per feed over all periods whose files are not those that were loaded (see ``ledger``). The run counts, in all
    feeds at once, when its last step has recorded it.

    ``years`` restricts the run: a full load of very many periods can go year by year, so that one
    shuffle never holds all of history. ``audit_casts`` counts lost values, in one more scan. ``gather`` False deals
    the rows by their hash alone when few periods are pending (see ``write_silver``).
    """
    load_id = new_load_id()
    files = manifest(spark, layout.bronze).filter(F.col("feed").isin(*model.contracts))
    if years is not None:
        files = files.filter(F.col("year").isin(*years))
    valid = landing.present_periods(files).filter(landing.large_enough())  # too small is a failure in landing
    work = files.join(valid.select(*KEY), KEY, "left_semi")
    if not full_load:
        changed = ledger.changed_months(work, ledger.loaded_files(spark, layout.silver))
        work = work.join(changed, KEY, "left_semi")
    work = ledger.begin(spark, layout.silver, work, load_id)
    written, unreadable, losses, months, schemas = {}, {}, [], [], {}
    for feed, contract in model.contracts.items():
        own = work.filter(F.col("feed") == feed)
        read = read_feed(spark, layout.bronze, own, contract)
        unreadable[feed] = read.unreadable
        if read.frames:
            path = f"{layout.silver}/{feed}"
            conformed = conform_variants(read.frames, contract)
            marked = mark_valid(dedup_by_month(conformed) if gather else dedup_with_counts(conformed))
            write_silver(marked, path, load_id, False)  # either way after one shuffle
            schemas[feed] = ledger.schema_of(marked)
            written[feed] = read_load(spark, path, load_id)
            losses += [cast_losses(frame, contract) for frame in read.frames]
            held = spark.createDataFrame([(path,) for path, _ in read.unreadable], "path string")
            waiting = own.join(held, "path", "left_semi").select(*KEY)
            taken = own.select(*KEY).distinct().join(waiting, KEY, "left_anti")
            months.append(taken.join(stage_counts(written[feed], feed), KEY, "left"))
    if months:
        ledger.commit(spark, layout.silver, _union(months), load_id, schemas)
    return SilverResult(
        load_id,
        reconcile(written) if written else None,
        unreadable,
        _union(losses).groupBy("feed", "column").agg(F.sum("lost").alias("lost")) if audit_casts and losses else None,
    )


def load_silver(spark: SparkSession, layout: Layout, marked: Mapping[str, DataFrame], load_id: str, gather: bool = True) -> None:
    """One committed load out of rows that are de-duplicated and judged already, whatever files they come from. ``gather`` False
    for rows whose months lie together already."""
    months, schemas = [], {}
    for feed, rows in marked.items():
        path = f"{layout.silver}/{feed}"
        write_silver(rows, path, load_id, gather)
        schemas[feed] = ledger.schema_of(rows)
        months.append(stage_counts(read_load(spark, path, load_id), feed))
    ledger.commit(spark, layout.silver, _union(months), load_id, schemas)


def run_rejects(spark: SparkSession, layout: Layout, model: StarModel) -> DataFrame:
    """The table of what bronze holds and silver does not, and why (see ``landing.accounted``), published anew."""
    taken = ledger.loaded_files(spark, layout.silver)
    files = landing.accounted(spark, layout.bronze, list(model.contracts), taken)
    publish(files.filter("reason is not null"), layout.gold, "rejected_files")
    return read_table(spark, layout.gold, "rejected_files")


def row_balance(spark: SparkSession, layout: Layout, model: StarModel) -> DataFrame:
    """Per feed every row of every readable file that lies in the feed's folder: raw = clean + removed + rejected."""
    files = landing.accounted(spark, layout.bronze, list(model.contracts), ledger.loaded_files(spark, layout.silver))
    folder = F.coalesce("feed", F.regexp_extract("path", f"/({'|'.join(model.contracts)})/", 1))
    loaded = F.col("reason").isNull()
    rows = files.groupBy(folder.alias("feed")).agg(
        F.sum("rows").alias("raw"), F.sum(F.when(~loaded, F.col("rows")).otherwise(0)).alias("rejected"), F.count_if(~loaded).alias("rejected_files")
    )
    clean = ledger.current_months(spark, layout.silver).groupBy("feed").agg(F.sum("clean").alias("clean"))
    joined = rows.join(clean, "feed", "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in ("raw", "rejected", "clean")})
    return joined.select("feed", "raw", "clean", (F.col("raw") - F.col("rejected") - F.col("clean")).alias("removed"), "rejected", "rejected_files")


STATE_DDL = (
    "table_name string, rules bigint, load_id string, year int, month int, "
    "rule string, rows bigint, filled bigint, bad bigint, least double"
)


def refresh_states(spark: SparkSession, layout: Layout, model: StarModel) -> DataFrame:
    """The quality states of every month that counts: those that are missing are measured and appended, so a load costs its own
    months. A month is known by its load and the rules it was measured by."""
    path = f"{layout.gold}/dq_states"

    def known() -> DataFrame:
        return spark.read.schema(STATE_DDL).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], STATE_DDL)

    current = ledger.current_months(spark, layout.silver).filter(F.col("clean") > 0)
    wanted = []
    for feed, contract in model.contracts.items():
        rules = model.quality.get(feed, ())
        if not rules or not path_exists(spark, f"{layout.silver}/{feed}"):
            continue
        mark = zlib.crc32("\n".join(rule.label for rule in rules).encode())
        months = current.filter(F.col("feed") == feed).select(F.lit(feed).alias("table_name"), F.lit(mark).cast("bigint").alias("rules"), ledger.LOAD, *PERIOD)
        wanted.append(months)
        fresh = months.join(known(), months.columns, "left_anti")
        if not fresh.isEmpty():
            rows = read_silver(spark, f"{layout.silver}/{feed}", contract, fresh)
            measured = quality.states(rows, rules, PERIOD).join(fresh, list(PERIOD))
            measured.select("table_name", "rules", ledger.LOAD, *PERIOD, "rule", *quality.STATE).hint("rebalance").write.mode("append").parquet(path)
    keys = ["table_name", "rules", ledger.LOAD, *PERIOD]
    states = known().dropDuplicates([*keys, "rule"])  # two runs may have measured a month at once
    return states.join(_union(wanted), keys, "left_semi") if wanted else states


def scored(spark: SparkSession, layout: Layout, model: StarModel, by: Sequence[str] = ()) -> DataFrame:
    """Scorecard of every table that exists, as a whole or per month, out of merged states."""
    found = refresh_states(spark, layout, model)
    cards = []
    for feed, contract in model.contracts.items():
        if model.quality.get(feed) and path_exists(spark, f"{layout.silver}/{feed}"):
            own = found.filter(F.col("table_name") == feed)
            cards.append(quality.score(own, feed, model.quality[feed], by, [*contract.columns, *PERIOD]))
    if not cards:
        raise FileNotFoundError(f"no silver table below {layout.silver}")
    return _union(cards)


def run_quality(
    spark: SparkSession, layout: Layout, model: StarModel, fail_on: frozenset[str] = frozenset()
) -> DataFrame:
    """Scorecard out of the months' states, appended to a table. Never blocks unless ``fail_on`` names outcomes that should."""
    path, run_id = f"{layout.gold}/dq_scorecard", new_load_id()
    card = scored(spark, layout, model).withColumn("run_id", F.lit(run_id))
    card.hint("rebalance").write.mode("append").parquet(path)
    latest = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    if fail_on:
        broken = latest.filter(F.col("outcome").isin(*fail_on)).select("table_name", "rule", "outcome")
        rows = [tuple(row) for row in broken.collect()]  # at most one row per declared rule
        if rows:
            raise QualityFailure(f"quality rules not met: {rows}")
    return latest


def fixed_dims(spark: SparkSession, model: StarModel, zones: DataFrame) -> dict[str, DataFrame]:
    """The six dimensions that do not depend on the trips."""
    words = model.words
    return {
        "dim_service": star.service_dim(spark, words),
        "dim_place": star.place_dim(zones, model.places, words),
        "dim_distance_band": star.distance_dim(spark, words),
        "dim_time_band": star.time_dim(spark, words),
        "dim_tip_status": star.status_dim(spark, words, "tip_status", "tipped"),
        "dim_congestion_status": star.status_dim(spark, words, "congestion_status", "congestion_charged"),
    }


def changed_inputs(spark: SparkSession, layout: Layout, rebuild: bool) -> DataFrame:
    """(year, month, inputs): the months whose loads, over all feeds, are not those that the fact was built from."""
    load = F.struct("feed", ledger.LOAD)
    months = ledger.current_months(spark, layout.silver).groupBy(*PERIOD).agg(F.array_sort(F.collect_list(load)).alias("inputs"))
    if rebuild or not current_version(spark, layout.gold, MONTHS):
        return months
    built = read_table(spark, layout.gold, MONTHS).select(*PERIOD, F.col("inputs").alias("built"))
    same = months.join(built, list(PERIOD)).filter(F.col("inputs") == F.col("built")).select(*PERIOD)
    return months.join(same, list(PERIOD), "left_anti")


def run_gold(
    spark: SparkSession,
    layout: Layout,
    model: StarModel,
    zones: DataFrame,
    gather_fact: bool = False,
    rebuild: bool = False,
    keep: int | None = None,
) -> dict[str, int]:
    """Publish a new version of every gold table; returns the rows that each has.

    The fact is rebuilt by the month: only months of which a load has changed are read from silver and written, with
    their summary, to folders of this build; operator names that they bring are appended to the dimension. The table of
    months, published last, says which build of each month counts, so readers see all of a run or nothing. ``rebuild``
    writes every month, for a changed model. ``keep`` expires all but that many versions.

    The dimensions are written first, so their size is known. While operators are few (``lookup``) the fact is
    a map over silver, written without any shuffle, since silver files already hold one period each. Above that the join is
    Spark's choice, by sort and merge with the skew handling of adaptive execution; ``gather_fact`` then gathers the rows by
    period before the write.
    """
    batch = f"b{new_load_id()}"
    work = publish(changed_inputs(spark, layout, rebuild).withColumn(BATCH, F.lit(batch)), layout.gold, "fact_work")
    work = spark.read.parquet(work)  # written: every step takes the same months
    silver, _ = tolerant_silver(spark, layout.silver, model.contracts, work)
    unified = star.unify(silver, model)
    written: dict[str, int] = {}
    for table, df in fixed_dims(spark, model, zones).items():
        written[table] = spark.read.parquet(publish(df, layout.gold, table)).count()  # from the file footers
    names = star.operator_names(silver, model)
    path = publish_after(spark, layout.gold, "dim_operator", lambda known: star.operator_dim(names, known))
    operators = spark.read.parquet(path)
    written["dim_operator"] = operators.count()
    fact = star.fact_trip(unified, lookup(operators, written["dim_operator"]), model).withColumn(BATCH, F.lit(batch))
    gathered = fact.hint("rebalance", *PERIOD) if gather_fact else fact
    gathered.write.mode("append").option("compression", CODEC).partitionBy(BATCH, *PERIOD).parquet(f"{layout.gold}/{FACT}")
    counts = spark.createDataFrame([], "year int, month int, n bigint")
    if batch_folder(spark, layout.gold, FACT, batch):
        new = _read_batches(spark, layout.gold, FACT).filter(F.col(BATCH) == batch)
        summed = summary.summarise(new).withColumn(BATCH, F.lit(batch))
        summed.hint("rebalance", *PERIOD).write.mode("append").partitionBy(BATCH, *PERIOD).parquet(f"{layout.gold}/{SUMMARY}")
        counts = new.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("n"))
    months = work.join(counts, list(PERIOD), "left").select(*PERIOD, "inputs", BATCH, F.coalesce("n", F.lit(0)).alias("n"))

    def with_others(before: DataFrame | None) -> DataFrame:
        return months if before is None else months.unionByName(before.join(work.select(*PERIOD), list(PERIOD), "left_anti"))

    path = publish_after(spark, layout.gold, MONTHS, with_others)
    written[FACT] = spark.read.parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if keep is not None:
        expire(spark, layout, keep)
    return written


def batch_folder(spark: SparkSession, gold: str, table: str, batch: str) -> bool:
    return f"{BATCH}={batch}" in folder_names(spark, f"{gold}/{table}")


def _read_batches(spark: SparkSession, gold: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{gold}/{table}")


def read_months(spark: SparkSession, gold: str, table: str) -> DataFrame:
    """The fact, or its summary: of every month the build that counts; other folders are not opened."""
    keys = ledger.folder_keys(read_table(spark, gold, MONTHS), BATCH)
    return ledger.in_folders(_read_batches(spark, gold, table), keys, BATCH).drop(BATCH)


def expire(spark: SparkSession, layout: Layout, keep: int) -> list[str]:
    """Delete all but the ``keep`` newest versions of the gold tables, and the builds of months and the loads of silver that none
    of them refers to. Returns the deleted folders. Readers that hold an older version lose it."""
    if keep < 1:
        raise ValueError("one version at least stays")
    gone = [f"{t}/{v}" for t in (*DIMS, "fact_work", MONTHS) for v in expire_versions(spark, layout.gold, t, keep)]
    kept = [v for v in folder_names(spark, f"{layout.gold}/{MONTHS}") if v.startswith("version=")]
    states = [spark.read.parquet(f"{layout.gold}/{MONTHS}/{v}") for v in kept if "_SUCCESS" in folder_names(spark, f"{layout.gold}/{MONTHS}/{v}")]
    months = _union(states)
    builds = {row[0] for row in months.select(BATCH).distinct().collect()}  # one per run at most
    for table in (FACT, SUMMARY):
        old = [name for name in folder_names(spark, f"{layout.gold}/{table}") if name.startswith(f"{BATCH}=") and name[len(BATCH) + 1 :] not in builds]
        gone += [f"{table}/{name}" for name in old]
        for name in old:
            delete(spark, f"{layout.gold}/{table}/{name}")
    used = months.select(F.explode("inputs").alias("input")).select("input.load_id")
    used = {row[0] for row in used.unionByName(ledger.current_months(spark, layout.silver).select(ledger.LOAD)).distinct().collect()}
    for feed in folder_names(spark, layout.silver):
        for name in folder_names(spark, f"{layout.silver}/{feed}"):
            if name.startswith(f"{ledger.LOAD}=") and name.partition("=")[2] not in used:
                delete(spark, f"{layout.silver}/{feed}/{name}")
                gone.append(f"{feed}/{name}")
    return gone


def read_star(spark: SparkSession, gold: str) -> dict[str, DataFrame]:
    return {**{table: read_table(spark, gold, table) for table in DIMS}, FACT: read_months(spark, gold, FACT)}


def with_summary(star_tables: Mapping[str, DataFrame], spark: SparkSession, gold: str) -> dict[str, DataFrame]:
    """The star with its summary, from which tiles and additive reports are then answered."""
    return {**star_tables, SUMMARY: read_months(spark, gold, SUMMARY)}


def register_views(star_tables: Mapping[str, DataFrame]) -> None:
    for name, df in star_tables.items():
        df.createOrReplaceTempView(name)


@dataclass(frozen=True)
class RunResult:
    landing: LandingResult
    silver: SilverResult
    quality: DataFrame
    gold: dict[str, int]


def run(
    spark: SparkSession,
    layout: Layout,
    model: StarModel,
    expected: DataFrame,
    zones: DataFrame,
    source: str,
    full_load: bool = False,
    fail_on: frozenset[str] = frozenset(),
) -> RunResult:
    """Landing, silver, quality (not blocking by default), gold. Safe to run again: a run that stopped anywhere has no effect on
    what readers see, and the next one takes the same work."""
    landed = run_landing(spark, layout, model, expected, source)
    silver = run_silver(spark, layout, model, full_load)
    card = run_quality(spark, layout, model, fail_on)
    gold = run_gold(spark, layout, model, zones)
    return RunResult(landed, silver, card, gold)
