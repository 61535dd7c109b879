"""Raw feed frame -> canonical, typed, aligned frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.functions import clean_text
from tripmill.operators.contracts import PERIOD, FeedContract


def _spellings(columns: Sequence[str]) -> dict[str, list[int]]:
    """Lower-case name -> positions of every column spelled that way up to case."""
    found: dict[str, list[int]] = {}
    for position, name in enumerate(columns):
        found.setdefault(name.lower(), []).append(position)
    return found


def _by_position(df: DataFrame) -> DataFrame:
    # Names equal up to case are ambiguous by name, so address columns by position.
    return df.toDF(*(f"c{position}" for position in range(len(df.columns))))


def _canonical(positions: Sequence[int], target: str) -> Column:
    """Lenient cast: what cannot be cast becomes null, under ANSI too. Several spellings of
    one column are merged, the first non-null value wins."""
    value = F.coalesce(*(F.col(f"c{position}").try_cast(target) for position in positions))
    return clean_text(value) if target == "string" else value


def conform(df: DataFrame, contract: FeedContract) -> DataFrame:
    """Fold case, rename, project to the contract, cast and normalise text in one projection.

    Columns that the frame lacks are left out (see ``align``); the period columns, which come
    from the path of the file, are kept.
    """
    found = _spellings(df.columns)
    columns = [
        _canonical(found[source], contract.type_of(name)).alias(name)
        for source, name in contract.renames.items()
        if source in found
    ]
    period = [F.col(f"c{found[part][0]}").cast("int").alias(part) for part in PERIOD if part in found]
    return _by_position(df).select(*columns, *period)


def align(df: DataFrame, contract: FeedContract) -> DataFrame:
    """Contract order, absent columns as typed nulls."""
    present = set(df.columns)
    columns = [
        F.col(name) if name in present else F.lit(None).cast(contract.type_of(name)).alias(name)
        for name in contract.columns
    ]
    return df.select(*columns, *(part for part in PERIOD if part in present))


def conform_variants(frames: Sequence[DataFrame], contract: FeedContract) -> DataFrame:
    """One frame out of several physical spellings of the same feed (schema drift)."""
    aligned = [align(conform(frame, contract), contract) for frame in frames]
    return reduce(lambda left, right: left.unionByName(right), aligned)


def cast_losses(df: DataFrame, contract: FeedContract) -> DataFrame:
    """Per contract column, how many values the lenient cast turned into null. One pass."""
    found = _spellings(df.columns)
    present = {source: name for source, name in contract.renames.items() if source in found}
    counts = []
    for source, name in present.items():
        lost = [
            F.col(f"c{position}").isNotNull()
            & F.col(f"c{position}").try_cast(contract.type_of(name)).isNull()
            for position in found[source]
        ]
        any_lost = reduce(lambda left, right: left | right, lost)
        counts.append(F.struct(F.lit(name).alias("column"), F.count_if(any_lost).alias("lost")))
    summary = _by_position(df).agg(F.array(*counts).alias("losses"))
    return summary.select(F.lit(contract.feed).alias("feed"), F.inline("losses"))
