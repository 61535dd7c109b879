"""Specifications that the operators take as arguments. Pure data, no Spark objects."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

PERIOD = ("year", "month")

# Canonical column -> Spark type. Trip times carry no zone, hence timestamp_ntz.
CANONICAL_TYPES: Mapping[str, str] = {
    "operator_code": "string",
    "pickup_ts": "timestamp_ntz",
    "dropoff_ts": "timestamp_ntz",
    "request_ts": "timestamp_ntz",
    "on_scene_ts": "timestamp_ntz",
    "passenger_count": "int",
    "distance_mi": "double",
    "rate_code_id": "int",
    "store_and_fwd_flag": "string",
    "pickup_place_id": "int",
    "dropoff_place_id": "int",
    "payment_type": "int",
    "fare": "double",
    "extra": "double",
    "transit_tax": "double",
    "tip": "double",
    "tolls": "double",
    "improvement_fee": "double",
    "total": "double",
    "congestion_fee": "double",
    "airport_fee": "double",
    "core_zone_fee": "double",
    "fund_fee": "double",
    "sales_tax": "double",
    "trip_type": "int",
    "dispatch_base": "string",
    "origin_base": "string",
    "affiliate_base": "string",
    "trip_seconds": "bigint",
    "driver_pay": "double",
    "shared_request_flag": "string",
    "shared_match_flag": "string",
    "access_a_ride_flag": "string",
    "wav_request_flag": "string",
    "wav_match_flag": "string",
    "shared_ride_flag": "double",
}


@dataclass(frozen=True)
class FeedContract:
    """One feed: raw column (lower case) -> canonical column, and the months it covers."""

    feed: str
    renames: Mapping[str, str]
    first_period: tuple[int, int]
    last_year: int

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.renames.values()))

    def type_of(self, column: str) -> str:
        return CANONICAL_TYPES[column]

    @property
    def ddl(self) -> str:
        """Schema of the feed's silver table, period columns last."""
        typed = [f"{column} {self.type_of(column)}" for column in self.columns]
        return ", ".join([*typed, *(f"{part} int" for part in PERIOD)])


@dataclass(frozen=True)
class Rule:
    """One quality rule. ``kind`` is one of row_count, completeness, at_least, between."""

    kind: str
    column: str | None = None
    low: float = 0.0
    high: float | None = None

    @property
    def label(self) -> str:
        if self.kind == "row_count":
            return f"row_count > {self.low:g}"
        if self.kind == "completeness":
            return f"completeness {self.column} >= {self.low:g}"
        if self.kind == "at_least":
            return f"{self.column} >= {self.low:g}"
        return f"{self.column} between {self.low:g} and {self.high:g}"


@dataclass(frozen=True)
class OperatorRule:
    """Where a feed's operator name comes from: a column as it is, or codes to decode."""

    column: str
    codes: Mapping[str, str] | None = None


@dataclass(frozen=True)
class ServiceRule:
    """First match wins; ``licence`` None matches any operator code of the feed."""

    service_id: int
    feed: str
    licence: str | None = None


@dataclass(frozen=True)
class PlaceRules:
    """Region grouping, in order of precedence: airport, core, rest of the home district,
    unknown, other."""

    airport_ids: tuple[int, ...]
    core_ids: tuple[int, ...]
    home_district: str
    unknown_ids: tuple[int, ...]
    core_service_zones: tuple[str, ...]


@dataclass(frozen=True)
class Vocabulary:
    """Every label that reaches a result."""

    service_groups: Mapping[int, str]
    distance_bands: tuple[tuple[int, str, str], ...]
    time_bands: tuple[tuple[int, str], ...]
    yes: str
    no: str
    cash: str
    not_cash: str
    unknown_operator: str
    other_operator: str
    region_airport: str
    region_core: str
    region_home: str
    region_unknown: str
    region_other: str
    era_before: str
    era_during: str
    era_after: str
    zone_core: str
    zone_outside: str
    district_inside: str
    district_outside: str

    @property
    def metered_group(self) -> str:
        return self.service_groups[1]

    @property
    def app_group(self) -> str:
        return self.service_groups[3]


@dataclass(frozen=True)
class StarModel:
    """All that the gold layer needs to know about a set of feeds."""

    contracts: Mapping[str, FeedContract]
    operators: Mapping[str, OperatorRule]
    services: tuple[ServiceRule, ...]
    places: PlaceRules
    words: Vocabulary
    quality: Mapping[str, tuple[Rule, ...]] = field(default_factory=dict)
    default_service: int = 6
    distance_cuts: tuple[float, ...] = (1, 3, 5, 10, 20)
    hour_cuts: tuple[int, ...] = (6, 10, 12, 14, 17, 20)
    cash_code: int = 2
