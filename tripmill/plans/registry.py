"""Registered queries: every operator over the warehouse binding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripmill.operators import checks, conform, mart, quality, reports, silver, star, summary, tiles
from tripmill.operators.contracts import PERIOD
from tripmill.plans import layers, pipeline, warehouse
from tripmill.session import lookup, reachable, scratch_path
from tripmill.sources import files, landing, ledger, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL, WORDS, PLACES = warehouse.MODEL, warehouse.WORDS, warehouse.PLACES
KEY = ["feed", *PERIOD]
BYTES_PER_ROW = 8


def portable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, so that engines agree on types."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, whole):
            column = column.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _register(name: str, query: Query) -> None:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(query(spark, sf_dir))

    QUERIES[name] = run


def register(query: Query) -> Query:
    _register(query.__name__, query)
    return query


# ---------------------------------------------------------------- landing


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected range per feed, from the years the orders cover."""
    trips = layers.landed(spark, sf_dir)
    late = F.when(F.col("feed") == "c", 2).otherwise(1)
    spans = trips.groupBy("feed").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return spans.select("feed", "first_year", late.alias("first_month"), "last_year")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.calendar(_ranges(spark, sf_dir))


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per feed and month of the line items, its size a multiple of its rows."""
    rows = layers.landed(spark, sf_dir).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*KEY, (F.col("n") * BYTES_PER_ROW).alias("length"))


def _present_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods already there: months in which customers of the feed's segment placed urgent orders."""
    orders = warehouse.load(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    joined = orders.join(warehouse.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    segment = F.col("c_mktsegment")
    feed = F.coalesce(*(F.when(segment == name, value) for name, value in warehouse.SEGMENT_FEED.items()))
    dated = joined.filter(F.month("o_orderdate") <= 6)
    return dated.select(
        feed.alias("feed"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).distinct()


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as failed attempts on the period that the user id stands for."""
    events = warehouse.load(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    dated = events.select(
        F.element_at(F.array(*(F.lit(f) for f in warehouse.FEEDS)), (F.col("user_id") % 4 + 1).cast("int")).alias(
            "feed"
        ),
        (F.lit(1995) + F.col("user_id") % 8).cast("int").alias("year"),
        (F.col("user_id") % 12 + 1).cast("int").alias("month"),
        "ts",
        "event_id",
        F.concat(F.lit("source said "), F.repeat("props", 30)).alias("error"),
    )
    return dated.select(
        F.concat(F.lit("source/"), landing.file_name()).alias("url"),
        *KEY,
        landing.storage_key().alias("storage_key"),
        "error",
        "ts",
        "event_id",
    )


def _latest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.latest_failures(_failures(spark, sf_dir), ["ts", "event_id"])


@register
def landing_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir)


@register
def landing_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.gap(_calendar(spark, sf_dir), _arrived(spark, sf_dir))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = _arrived(spark, sf_dir).select(
        *KEY,
        "length",
        F.lit(None).cast("int").alias("http_code"),
        F.lit(None).cast("string").alias("error"),
    )
    return landing.status(_calendar(spark, sf_dir), _present_before(spark, sf_dir), arrived)


@register
def landing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@register
def landing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.status_summary(_status(spark, sf_dir))


@register
def dead_letter_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_failures(spark, sf_dir)


@register
def dead_letter_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = _arrived(spark, sf_dir).filter(landing.large_enough())
    return landing.pending_failures(
        _latest_failures(spark, sf_dir), arrived.select(landing.storage_key().alias("storage_key"))
    )


# ---------------------------------------------------------------- conform


def _conform_query(feed: str) -> Query:
    return lambda spark, sf_dir: layers.conformed_feed(spark, sf_dir, feed)


for _feed in warehouse.FEEDS:
    _register(f"conform_feed_{_feed}", _conform_query(_feed))


@register
def conform_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cleaned operator texts of every feed, with their rows."""
    texts = [
        layers.conformed_feed(spark, sf_dir, feed).select(F.lit(feed).alias("feed"), F.col(column).alias("text"))
        for feed, column in (("a", "operator_code"), ("b", "operator_code"), ("c", "operator_code"), ("d", "dispatch_base"))
    ]
    return reduce(DataFrame.unionByName, texts).groupBy("feed", "text").agg(F.count(F.lit(1)).alias("total_rows"))


@register
def drift_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed a in three spellings: the fee column appears in 1997, the payment type changes in 1999."""
    raw = layers.raw_feed(spark, sf_dir, "a")
    early = raw.filter("year < 1997").drop("Core_Fee")
    middle = raw.filter("year >= 1997 and year < 1999")
    late = raw.filter("year >= 1999").withColumn("Payment_Type", F.col("Payment_Type").cast("double"))
    return conform.conform_variants([early, middle, late], warehouse.CONTRACTS["a"])


@register
def cast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values lost to lenient casts when feed c is read as if its licence were a number."""
    raw = layers.raw_feed(spark, sf_dir, "c")
    misread = raw.withColumn("miles", F.concat(F.col("miles").cast("string"), F.col("licence")))
    return conform.cast_losses(misread, warehouse.CONTRACTS["c"])


# ---------------------------------------------------------------- silver


def _every_feed(frames: dict[str, DataFrame]) -> DataFrame:
    tagged = [frame.withColumn("feed", F.lit(feed)) for feed, frame in frames.items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tagged)


@register
def silver_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = {
        feed: silver.dedup_with_counts(layers.conformed_feed(spark, sf_dir, feed)) for feed in warehouse.FEEDS
    }
    return _every_feed(grouped)


@register
def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = {
        feed: silver.keep_valid(silver.dedup_with_counts(layers.conformed_feed(spark, sf_dir, feed)))
        for feed in warehouse.FEEDS
    }
    return _every_feed(clean)


@register
def silver_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.reconcile(layers.marked_feeds(spark, sf_dir))


@register
def silver_pending_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods with files but no accepted row, hence no silver partition."""
    loaded = tables.loaded_periods(spark, layers.silver_root(spark, sf_dir), warehouse.FEEDS)
    return silver.pending_periods(layers.landed(spark, sf_dir), loaded)


@register
def silver_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every feed, then write its 1998 again with fares doubled: only 1998 is replaced."""
    totals = []
    for feed, source in layers.silver(spark, sf_dir).items():
        path = scratch_path(spark, "overwrite")
        tables.overwrite_periods(source, path)
        tables.overwrite_periods(source.filter("year = 1998").withColumn("fare", F.col("fare") * 2), path)
        written = tables.read_periods(spark, path, warehouse.CONTRACTS[feed]).withColumn("feed", F.lit(feed))
        total = F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double")
        totals.append(written.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_rows"), total.alias("total_fare")))
    return reduce(DataFrame.unionByName, totals)


@register
def silver_schema_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed written before and after its fare joined the contract, in 1998: older files read it as null."""
    totals = []
    for feed, source in layers.silver(spark, sf_dir).items():
        path = scratch_path(spark, "growth")
        tables.overwrite_periods(source.filter("year < 1998").drop("fare"), path)
        tables.overwrite_periods(source.filter("year >= 1998"), path)
        grown = tables.read_periods(spark, path, warehouse.CONTRACTS[feed]).withColumn("feed", F.lit(feed))
        totals.append(grown.groupBy("feed", "year").agg(F.count(F.lit(1)).alias("total_rows"), F.count("fare").alias("fares")))
    return reduce(DataFrame.unionByName, totals)


@register
def silver_type_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed in two loads whose fares are whole numbers up to 1997 and amounts after; read together under today's contract."""
    layout = pipeline.Layout("", scratch_path(spark, "types"), "")
    judged = {
        feed: rows.withColumns({"copies": F.lit(1).cast("bigint"), "accepted": F.lit(True)})
        for feed, rows in layers.silver(spark, sf_dir).items()
    }
    early = {feed: rows.filter("year < 1998").withColumn("fare", F.floor("fare").cast("int")) for feed, rows in judged.items()}
    pipeline.load_silver(spark, layout, early, pipeline.new_load_id())
    pipeline.load_silver(spark, layout, {feed: rows.filter("year >= 1998") for feed, rows in judged.items()}, pipeline.new_load_id())
    read, _ = tables.tolerant_silver(spark, layout.silver, MODEL.contracts)
    fare = F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double").alias("total_fare")
    return _every_feed(read).groupBy("feed", "year").agg(F.count(F.lit(1)).alias("total_rows"), fare)


@register
def landing_to_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed run over written files: every feed in its own spelling, one folder a month, taken to
    silver in one load; raw, de-duplicated and clean rows of each level as silver holds them."""
    reachable(spark)
    lake = scratch_path(spark, "lake")
    layout = pipeline.Layout(f"{lake}/bronze", f"{lake}/silver", f"{lake}/gold")
    for feed in warehouse.FEEDS:
        layers.write_bronze(layers.raw_feed(spark, sf_dir, feed), f"{layout.bronze}/{feed}")
    return pipeline.run_silver(spark, layout, MODEL).stages


@register
def lake_run_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing, silver, gold twice over written files, one of them broken and repaired between the runs: per expected period
    what landing said each time, and the trips that silver and the fact have in the end."""
    reachable(spark)
    lake = scratch_path(spark, "lake")
    layout = pipeline.Layout(f"{lake}/bronze", f"{lake}/silver", f"{lake}/gold")
    for feed in warehouse.FEEDS:
        layers.write_bronze(layers.raw_feed(spark, sf_dir, feed), f"{layout.bronze}/{feed}", gather=False)
    expected, zones = _calendar(spark, sf_dir), warehouse.zones(spark, sf_dir)
    broken = f"{layout.bronze}/b/year=1998/month=3/broken.parquet"
    files.write_bytes(spark, broken, b"no table at all " * 200)
    first = pipeline.run(spark, layout, MODEL, expected, zones, "source").landing.status
    files.delete(spark, broken)
    second = pipeline.run(spark, layout, MODEL, expected, zones, "source").landing.status
    clean = ledger.current_months(spark, layout.silver).select(*KEY, "clean")
    trips = tables.read_table(spark, layout.gold, pipeline.MONTHS).select(*PERIOD, F.col("n").alias("month_trips"))
    told = first.select(*KEY, F.col("status").alias("first_status")).join(second.select(*KEY, F.col("status").alias("second_status")), KEY)
    joined = told.join(clean, KEY, "left").join(trips, list(PERIOD), "left")
    return joined.select(*KEY, "first_status", "second_status", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("clean", "month_trips")))


@register
def reject_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows landed: those of vendor 5 in feed d outside the layout, and March 1998 of feed b beside a broken file, so held
    back; what silver took, removed and left."""
    reachable(spark)
    lake = scratch_path(spark, "lake")
    layout = pipeline.Layout(f"{lake}/bronze", f"{lake}/silver", f"{lake}/gold")
    trips = layers.landed(spark, sf_dir)
    stray = F.expr("feed = 'd' and vendor = 5")
    for feed in warehouse.FEEDS:
        layers.write_bronze(warehouse.raw_feed(trips.filter(~stray), feed), f"{layout.bronze}/{feed}")
    warehouse.raw_feed(trips.filter(stray), "d").write.option("compression", tables.CODEC).parquet(f"{layout.bronze}/d/late")
    files.write_bytes(spark, f"{layout.bronze}/b/year=1998/month=3/broken.parquet", b"no table at all " * 200)
    pipeline.run_silver(spark, layout, MODEL)
    return pipeline.row_balance(spark, layout, MODEL).drop("rejected_files")


@register
def ledger_changed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work after a second listing of one file per feed, month and vendor: late files (vendor 6 in 1999), replaced ones (vendor 7 in
    every December) and files that are gone (vendor 5 in 2000). A load that never committed took them all and counts for nothing."""
    listed = layers.landed(spark, sf_dir).groupBy(*KEY, "vendor").agg((F.count(F.lit(1)) * BYTES_PER_ROW).alias("length"))
    path = F.concat_ws("/", *KEY, F.col("vendor").cast("string")).alias("path")
    replaced = F.when(F.expr("vendor = 7 and month = 12"), F.col("length") + BYTES_PER_ROW).otherwise(F.col("length"))
    modified = F.lit("2024-01-01").cast("timestamp").alias("modified")
    before = listed.filter("not (vendor = 6 and year = 1999)").select(path, "length", modified, *KEY)
    now = listed.filter("not (vendor = 5 and year = 2000)").select(path, replaced.alias("length"), modified, *KEY)
    root = scratch_path(spark, "ledger")
    taken = ledger.begin(spark, root, before, "1")
    rows = (F.sum("length") / BYTES_PER_ROW).cast("bigint")
    ledger.commit(spark, root, taken.groupBy(*KEY).agg(*(rows.alias(stage) for stage in ledger.STAGES)), "1")
    ledger.begin(spark, root, now, "2")
    return ledger.changed_months(now, ledger.loaded_files(spark, root))


@register
def gold_by_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver in two loads, the second with the whole of March 1998 of feed c, of which the first had the short trips; gold after
    each. Per month the trips and fares of the fact, and the build that wrote it."""
    lake = scratch_path(spark, "lake")
    layout = pipeline.Layout("", f"{lake}/silver", f"{lake}/gold")
    zones, late = warehouse.zones(spark, sf_dir), F.expr("year = 1998 and month = 3")
    judged = {
        feed: rows.withColumns({"copies": F.lit(1).cast("bigint"), "accepted": F.lit(True)})
        for feed, rows in layers.silver(spark, sf_dir).items()
    }
    early = {**judged, "c": judged["c"].filter(~late | (F.col("distance_mi") < 10))}
    pipeline.load_silver(spark, layout, early, pipeline.new_load_id())
    pipeline.run_gold(spark, layout, MODEL, zones)
    pipeline.load_silver(spark, layout, {"c": judged["c"].filter(late)}, pipeline.new_load_id())
    pipeline.run_gold(spark, layout, MODEL, zones)
    months = tables.read_table(spark, layout.gold, pipeline.MONTHS)
    first = months.agg(F.min(pipeline.BATCH)).first()[0]
    builds = months.select(*PERIOD, F.when(F.col(pipeline.BATCH) == first, 1).otherwise(2).alias("build"))
    fare = F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double").alias("total_fare")
    fact = pipeline.read_months(spark, layout.gold, pipeline.FACT).groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("total_trips"), fare)
    return fact.join(builds, list(PERIOD))


# ---------------------------------------------------------------- quality


@register
def dq_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scorecard(layers.silver(spark, sf_dir), MODEL.quality)


def _scored(by: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        layout = pipeline.Layout("", layers.silver_root(spark, sf_dir), scratch_path(spark, "quality"))
        return pipeline.scored(spark, layout, MODEL, by)

    return query


_register("dq_scorecard_merged", _scored(()))
_register("dq_scorecard_by_month", _scored(PERIOD))


# ---------------------------------------------------------------- star


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.unify(layers.silver(spark, sf_dir), MODEL)


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_trips"))


@register
def union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir).drop("trip_id")


@register
def operator_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_unified(spark, sf_dir), "feed", "operator_code", "operator")


@register
def service_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = star.classify_service(MODEL.services, MODEL.default_service)
    return _counted(_unified(spark, sf_dir).withColumn("service_id", service), "feed", "operator_code", "service_id")


@register
def distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = _unified(spark, sf_dir).withColumn("distance_band_id", star.distance_band(MODEL))
    return _counted(banded, "distance_mi", "distance_band_id")


@register
def time_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = _unified(spark, sf_dir).select(F.hour("pickup_ts").alias("hour"), star.time_band(MODEL).alias("time_band_id"))
    return _counted(banded, "hour", "time_band_id")


@register
def dim_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.operator_dim(star.operator_names(layers.silver(spark, sf_dir), MODEL))


@register
def dim_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.place_dim(warehouse.zones(spark, sf_dir), PLACES, WORDS)


def _used_dim(name: str, key: str) -> Query:
    """A literal dimension with the trips that refer to each of its rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        gold = layers.gold(spark, sf_dir)
        used = gold["fact_trip"].groupBy(key).agg(F.count(F.lit(1)).alias("total_trips"))
        joined = gold[name].join(used, key, "left")
        return joined.withColumn("total_trips", F.coalesce("total_trips", F.lit(0)))

    return query


for _name, _key in (
    ("dim_service", "service_id"),
    ("dim_distance_band", "distance_band_id"),
    ("dim_time_band", "time_band_id"),
    ("dim_tip_status", "tip_status_id"),
    ("dim_congestion_status", "congestion_status_id"),
):
    _register(_name, _used_dim(_name, _key))


@register
def fact_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    operators = lookup(layers.gold(spark, sf_dir)["dim_operator"])
    return star.fact_trip(_unified(spark, sf_dir), operators, MODEL).drop("trip_id")


@register
def trip_id_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many row ids as trips."""
    fact = layers.gold(spark, sf_dir)["fact_trip"]
    return fact.agg(F.count(F.lit(1)).alias("total_trips"), F.count_distinct("trip_id").alias("distinct_ids"))


# ---------------------------------------------------------------- mart


@register
def mart_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.trip_mart(layers.gold(spark, sf_dir), WORDS).drop("trip_id")


@register
def mart_trip_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips but those listed: here every trip of 20 miles or more with a fare over 90,000."""
    gold = layers.gold(spark, sf_dir)
    listed = gold["fact_trip"].filter("distance_mi >= 20 and fare > 90000").select("trip_id")
    kept = mart.excluding(mart.trip_mart(gold, WORDS, ["trip_id", "distance_band", "trips", "fare"]), listed)
    return kept.groupBy("distance_band").agg(
        F.sum("trips").alias("total_trips"), F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double").alias("total_fare")
    )


@register
def mart_trip_excluding_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a list that knows its months: trips of 1998 with a fare over 90,000. Other months are not joined."""
    gold = layers.gold(spark, sf_dir)
    listed = gold["fact_trip"].filter("year = 1998 and fare > 90000").select("trip_id", *PERIOD)
    whole = mart.trip_mart(gold, WORDS, ["trip_id", "distance_band", "trips", "fare", *PERIOD])
    return mart.excluding(whole, listed).groupBy("distance_band", "year").agg(
        F.sum("trips").alias("total_trips"), F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double").alias("total_fare")
    )


@register
def mart_core_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips by the two fee flags, which are apart: congestion and core zone."""
    labels = ["service_group", "congestion_charged", "core_fee_charged"]
    trips = mart.summarised(layers.gold(spark, sf_dir), labels, [F.sum("trips").alias("part")])
    return trips.groupBy(*labels).agg(F.sum("part").alias("total_trips"))


@register
def mart_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["service_group", "pickup_district", "pickup_zone", "year", "month", "year_month", "trips", "fare"]
    filtered = mart.filter_by(
        mart.trip_mart(layers.gold(spark, sf_dir), WORDS, wanted),
        categories={
            "service_group": [WORDS.app_group],
            "pickup_district": ["ASIA", "EUROPE"],
            "pickup_zone": mart.ALL,
            "year": ["1997", "1998"],
            "month": None,
        },
        ranges={"year_month": ("1997-06", "1998-03")},
    )
    return filtered.groupBy("service_group", "pickup_district", "pickup_zone", "year", "month").agg(
        F.sum("trips").alias("total_trips"), F.sum(F.col("fare").cast(warehouse.MONEY)).cast("double").alias("total_fare")
    )


# ---------------------------------------------------------------- reports


def _report(name: str, build: Callable[[mart.Star], DataFrame]) -> None:
    _register(name, lambda spark, sf_dir: build(layers.gold(spark, sf_dir)))


_report("r_market_share", lambda gold: reports.market_share(gold, WORDS))
_report("r_top_zones", lambda gold: reports.top_zones(gold, WORDS))
_report("r_tip_probability", lambda gold: reports.tip_probability(gold, WORDS))
_report("r_tip_mean_paid", lambda gold: reports.tip_mean_paid(gold, WORDS))
_report(
    "r_tip_scatter",
    lambda gold: reports.tip_scatter(
        gold, WORDS, warehouse.SCATTER_YEAR, warehouse.SCATTER_ROWS, warehouse.SCATTER_FARE
    ),
)
_report("r_monthly_volume", reports.monthly_volume)
_report("r_tip_by_era", lambda gold: reports.tip_by_era(gold, WORDS, warehouse.ERA))
_report(
    "r_core_zone_volume",
    lambda gold: reports.core_zone_volume(gold, WORDS, PLACES, warehouse.FEE_PERIOD),
)
_report("r_fee_kpi", lambda gold: reports.fee_kpi(gold, warehouse.FEE_PERIOD))
_report(
    "r_before_after",
    lambda gold: reports.before_after(gold, WORDS, PLACES, *warehouse.COMPARED_PERIODS),
)

for _rule in ("district", "region"):
    _report(
        f"r_core_zone_volume_{_rule}",
        lambda gold, rule=_rule: reports.core_zone_volume(gold, WORDS, PLACES, warehouse.FEE_PERIOD, rule),
    )
for _rule in ("service_zone", "region"):
    _report(
        f"r_before_after_{_rule}",
        lambda gold, rule=_rule: reports.before_after(gold, WORDS, PLACES, *warehouse.COMPARED_PERIODS, rule),
    )


# ---------------------------------------------------------------- tiles and checks

TILES = tiles.dashboard_tiles(WORDS, warehouse.CORE_TILE_YEARS)


def _tile(tile: tiles.Tile) -> Query:
    return lambda spark, sf_dir: tiles.build_tile(layers.gold(spark, sf_dir), WORDS, tile)


for _tile_name, _spec in TILES.items():
    _register(_tile_name, _tile(_spec))



@register
def tile_time_band_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile under dashboard-wide filters: metered trips from two districts, from mid 1997 to spring 1998."""
    return tiles.build_tile(
        layers.gold(spark, sf_dir),
        WORDS,
        TILES["tile_time_band"],
        categories={"service_group": [WORDS.metered_group], "pickup_district": ["ASIA", "EUROPE"]},
        ranges={"year_month": ("1997-06", "1998-03")},
    )


@register
def tile_tip_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tips by distance band (rows) and time band (columns)."""
    tile = TILES["tile_tip_by_band_hour"]
    gold = layers.gold(spark, sf_dir)
    # Seven labels of a fixed dimension.
    labels = [row["time_band"] for row in gold["dim_time_band"].orderBy("time_band_id").collect()]
    spread = tiles.heat_map(tiles.build_tile(gold, WORDS, tile), tile, labels)
    return spread.toDF(*(name.lower().replace(" ", "_") for name in spread.columns))


_report("check_row_counts", checks.row_counts)
_report("check_recent_months", lambda gold: checks.recent_months(gold, warehouse.SCATTER_YEAR))
_report("check_orphans", checks.orphans)


# ---------------------------------------------------------------- the same, out of the summary

ADDITIVE: dict[str, Callable[[mart.Star], DataFrame]] = {
    "r_market_share": lambda gold: reports.market_share(gold, WORDS),
    "r_top_zones": lambda gold: reports.top_zones(gold, WORDS),
    "r_tip_probability": lambda gold: reports.tip_probability(gold, WORDS),
    "r_tip_mean_paid": lambda gold: reports.tip_mean_paid(gold, WORDS),
    "r_monthly_volume": reports.monthly_volume,
    "r_tip_by_era": lambda gold: reports.tip_by_era(gold, WORDS, warehouse.ERA),
    "r_core_zone_volume": lambda gold: reports.core_zone_volume(gold, WORDS, PLACES, warehouse.FEE_PERIOD),
    "r_fee_kpi": lambda gold: reports.fee_kpi(gold, warehouse.FEE_PERIOD),
    "r_before_after": lambda gold: reports.before_after(gold, WORDS, PLACES, *warehouse.COMPARED_PERIODS),
    **{name: (lambda gold, tile=tile: tiles.build_tile(gold, WORDS, tile)) for name, tile in TILES.items()},
}


def _summary_query(build: Callable[[mart.Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(layers.star_and_summary(spark, sf_dir))


for _additive, _build in ADDITIVE.items():
    _register(f"summary_{_additive}", _summary_query(_build))


@register
def summary_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the months merged to years and services: trips, fare in cents, valued tips and their mean."""
    states = summary.merge(layers.star_and_summary(spark, sf_dir)[mart.SUMMARY], "year", "service_id")
    return states.select(
        "year", "service_id", F.col("trips").alias("total_trips"), F.col("fare_cents").alias("total_fare"),
        F.col("tip_valued").alias("valued_tips"), summary.mean("tip").alias("mean_tip"),
    )
