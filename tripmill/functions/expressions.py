"""Column expressions shared by the operators. All are built-in Spark functions, so every
one of them stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Money is summed in exact cents: a sum of doubles depends on the order in which tasks finish.
MONEY = "decimal(18,2)"


def clean_text(text: Column) -> Column:
    return F.upper(F.trim(text))


def or_zero(measure: Column) -> Column:
    """Null becomes 0; NaN is left alone (``fillna`` would replace both)."""
    return F.coalesce(measure, F.lit(0.0))


def flag(amount: Column) -> Column:
    """1 when the amount is positive, else 2. Null counts as 0."""
    return F.when(or_zero(amount) > 0, 1).otherwise(2)


def first_match(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """One CASE expression: the value of the first condition that holds, else the default."""
    (condition, value), *rest = cases
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def band(value: Column, cuts: Sequence[float]) -> Column:
    """1-based band number: the first cut point above ``value``, or the last band.

    Null and NaN compare false with every cut point and so end in the last band.
    """
    return first_match(((value < cut, number) for number, cut in enumerate(cuts, start=1)), len(cuts) + 1)


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def digest(tag: str, columns: Sequence[Column]) -> Column:
    """128-bit row id in hex: two 64-bit hashes with different seeds.

    The hash skips nulls, so a mask of the columns that have a value is hashed along. Neither
    changes when a contract gains a column at its end that an old row does not have.
    """
    bits = (F.when(value.isNotNull(), 1 << bit).otherwise(0).cast("bigint") for bit, value in enumerate(columns))
    mask = reduce(lambda left, right: left.bitwiseOR(right), bits)
    halves = [F.xxhash64(F.lit(seed), F.lit(tag), mask, *columns) for seed in (1, 2)]
    return F.concat(*(_hex(half) for half in halves))


def half_up(value: Column, digits: int) -> Column:
    """Round half up on doubles with one fixed formula, so that other engines can repeat it."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def share(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part.cast("double") / whole.cast("double")
