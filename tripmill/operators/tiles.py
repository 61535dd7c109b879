"""The eleven dashboard tiles, as data: categories x measure, with tile-scoped filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.operators.contracts import Vocabulary
from tripmill.operators.mart import Part, Star, as_text_period, cents_part, filter_by, period_condition, summarised, trips_part, valued_part


@dataclass(frozen=True)
class Tile:
    categories: tuple[str, ...]
    measure: str
    average: bool = False
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    sort: tuple[str, ...] = ()

    @property
    def value(self) -> str:
        return f"{'mean' if self.average else 'sum'}_{self.measure}"


def dashboard_tiles(words: Vocabulary, core_years: Sequence[str]) -> dict[str, Tile]:
    month, group = "year_month", "service_group"
    district, region = "pickup_district", "pickup_region_group"
    return {
        "tile_volume": Tile((month, group), "trips"),
        "tile_district_taxi": Tile((month, district), "trips", filters={group: [words.metered_group]}),
        "tile_district_app": Tile((month, district), "trips", filters={group: [words.app_group]}),
        "tile_time_band": Tile(("time_band", group), "trips"),
        "tile_tip_rate": Tile((month, group), "tip_flag", average=True),
        "tile_tip_mean": Tile((group,), "tip", average=True),
        "tile_tip_by_band_hour": Tile(("distance_band", "time_band"), "tip"),
        "tile_tip_by_band_region": Tile(("distance_band", region), "tip"),
        "tile_tip_era": Tile((month, group), "tip", average=True),
        "tile_region_mix": Tile((month, region), "trips", sort=(month,)),
        "tile_core_volume": Tile(
            (month, group),
            "trips",
            filters={region: [words.region_core], "year": list(core_years)},
            sort=(month,),
        ),
    }


def _partials(tile: Tile) -> list[Part]:
    """Per key combination: trips, or cents of a money measure, and the rows that a mean divides by. The tip flag follows from
    the joined label, so it needs no more than the trips."""
    if tile.measure in ("trips", "tip_flag"):
        return [Part("part", F.sum("trips"), F.sum("trips")), trips_part("rows")]
    return [cents_part(tile.measure, "part"), valued_part(tile.measure, "rows")]


def _total(tile: Tile, words: Vocabulary) -> Column:
    part = F.col("part")
    if tile.measure == "tip_flag":
        part = F.when(F.col("tipped") == words.yes, part).otherwise(F.lit(0))
    total = F.sum(part)
    if tile.average:
        return F.try_divide(total.cast("double"), F.sum("rows").cast("double"))
    return total if tile.measure in ("trips", "tip_flag") else total.cast("double")


def build_tile(
    star: Star,
    words: Vocabulary,
    tile: Tile,
    categories: Mapping[str, Sequence[str] | str | None] | None = None,
    ranges: Mapping[str, tuple[str | None, str | None]] | None = None,
) -> DataFrame:
    """A tile under the dashboard-wide filters (``categories``, ``ranges``) and its own. What they say of periods reaches the
    folders of the fact, or of its summary where the star has one."""
    used = [*tile.categories, *tile.filters, *(categories or {}), *(ranges or {})]
    if tile.measure == "tip_flag":
        used.append("tipped")
    periods = [period_condition(categories, ranges), period_condition(tile.filters)]
    where = reduce(lambda one, other: one & other, [each for each in periods if each is not None], F.lit(True))
    combinations = as_text_period(summarised(star, list(dict.fromkeys(used)), _partials(tile), where))
    chosen = filter_by(filter_by(combinations, categories, ranges), tile.filters)
    result = chosen.groupBy(*tile.categories).agg(_total(tile, words).alias(tile.value))
    return result.orderBy(*tile.sort, *tile.categories) if tile.sort else result


def heat_map(result: DataFrame, tile: Tile, columns: Sequence[str]) -> DataFrame:
    """Rows x columns layout of a two-category tile; ``columns`` lists the labels to spread."""
    row, column = tile.categories
    return result.groupBy(row).pivot(column, list(columns)).agg(F.first(tile.value))
