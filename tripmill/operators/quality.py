"""Declarative quality rules: one aggregate per table, one result row per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.operators.contracts import Rule

PASS, FAIL, ERROR = "PASS", "FAIL", "ERROR"


def _violations(rule: Rule) -> Column:
    """Rows that break the rule. Nulls are the business of completeness, not of value rules;
    both bounds of a range are allowed values."""
    value = F.col(rule.column)
    bad = value < F.lit(rule.low)
    if rule.kind == "between":
        bad = bad | (value > F.lit(rule.high))
    return F.count_if(bad)


def _measure(rule: Rule) -> tuple[Column, Column]:
    """(metric, number of offending rows) of a rule, both aggregates."""
    rows = F.count(F.lit(1))
    if rule.kind == "row_count":
        return rows.cast("double"), F.lit(0).cast("bigint")
    if rule.kind == "completeness":
        present = F.count(F.col(rule.column))
        fraction = F.when(rows > 0, present.cast("double") / rows.cast("double"))
        return fraction, rows - present
    return F.min(F.col(rule.column)).cast("double"), _violations(rule)


def _passes(rule: Rule, metric: Column, bad_rows: Column) -> Column:
    if rule.kind == "row_count":
        return metric > F.lit(float(rule.low))
    if rule.kind == "completeness":
        # An empty table has no fraction; the row-count rule reports it.
        return F.coalesce(metric, F.lit(0.0)) >= F.lit(float(rule.low))
    return bad_rows == 0


def evaluate(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Scorecard of one table: table, rule, metric, bad_rows, outcome.

    ``metric`` is the row count, the fraction present or the minimum. A rule on a column that
    the table lacks is an ERROR row; the other rules are still evaluated.
    """
    known = set(df.columns)
    measures, entries = [], []
    for number, rule in enumerate(rules):
        if rule.column is not None and rule.column not in known:
            metric, bad_rows = F.lit(None).cast("double"), F.lit(None).cast("bigint")
            outcome = F.lit(ERROR)
        else:
            metric, bad_rows = F.col(f"m{number}"), F.col(f"b{number}")
            measured, counted = _measure(rule)
            measures += [measured.alias(f"m{number}"), counted.alias(f"b{number}")]
            outcome = F.when(_passes(rule, metric, bad_rows), PASS).otherwise(FAIL)
        entries.append(
            F.struct(
                F.lit(rule.label).alias("rule"),
                metric.alias("metric"),
                bad_rows.alias("bad_rows"),
                outcome.alias("outcome"),
            )
        )
    totals = df.agg(*(measures or [F.count(F.lit(1)).alias("rows")]))
    return totals.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def scorecard(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]]) -> DataFrame:
    parts = [evaluate(df, name, rules[name]) for name, df in tables.items() if rules.get(name)]
    return reduce(lambda left, right: left.unionByName(right), parts)


# ---------------------------------------------------------------- mergeable states

STATE = ("rows", "filled", "bad", "least")


def states(df: DataFrame, rules: Sequence[Rule], by: Sequence[str]) -> DataFrame:
    """Per group of ``by`` and rule what a score needs: rows, rows with a value, offending rows and the least value. One
    aggregate for all rules; states of disjoint groups merge by sum and minimum, so a table is scored, as a whole or by
    the month, without its rows. ``filled`` is null for a column that the table lacks."""
    known = set(df.columns)
    measures, entries = [F.count(F.lit(1)).alias("rows")], []
    for number, rule in enumerate(rules):
        if rule.kind == "row_count":
            parts = [F.col("rows"), F.lit(0), F.lit(None)]
        elif rule.column not in known:
            parts = [F.lit(None), F.lit(None), F.lit(None)]
        else:
            bad = F.lit(0) if rule.kind == "completeness" else _violations(rule)
            measures += [F.count(rule.column).alias(f"f{number}"), bad.alias(f"b{number}"), F.min(rule.column).alias(f"m{number}")]
            parts = [F.col(f"f{number}"), F.col(f"b{number}"), F.lit(None) if rule.kind == "completeness" else F.col(f"m{number}")]
        filled, bad, least = parts
        entries.append(
            F.struct(
                F.lit(rule.label).alias("rule"), F.col("rows").alias("rows"), filled.cast("bigint").alias("filled"),
                bad.cast("bigint").alias("bad"), least.cast("double").alias("least"),
            )
        )
    return df.groupBy(*by).agg(*measures).select(*by, F.inline(F.array(*entries)))


def score(found: DataFrame, table: str, rules: Sequence[Rule], by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The scorecard rows that ``evaluate`` gives, out of states, for the whole table or per group of ``by``. ``columns``: those
    of the table, which tell a rule on a missing column from one without rows where there are no states."""
    sums = [F.sum(name).alias(name) for name in ("rows", "filled", "bad")]
    merged = found.groupBy(*by, "rule").agg(*sums, F.min("least").alias("least"), F.count("filled").alias("measured"))
    if not by:  # a table without rows has rules all the same
        every = found.sparkSession.createDataFrame([(rule.label,) for rule in rules], "rule string").distinct()
        merged = every.join(merged, "rule", "left")
    rows, filled = F.coalesce("rows", F.lit(0)), F.coalesce("filled", F.lit(0))
    kinds = {kind: [rule for rule in rules if rule.kind == kind] for kind in ("row_count", "completeness")}
    named = {kind: F.col("rule").isin([rule.label for rule in some]) for kind, some in kinds.items()}
    absent = [rule.label for rule in rules if columns is not None and rule.column is not None and rule.column not in columns]
    missing = F.coalesce(F.col("measured") == 0, F.lit(False)) | F.col("rule").isin(absent)
    fraction = F.when(rows > 0, filled.cast("double") / rows.cast("double"))
    metric = F.when(named["row_count"], rows.cast("double")).when(named["completeness"], fraction).otherwise(F.col("least"))
    bad = F.when(named["row_count"], F.lit(0)).when(named["completeness"], rows - filled).otherwise(F.coalesce("bad", F.lit(0)))
    passes = F.lit(None).cast("boolean")
    for rule in rules:
        passes = F.when(F.col("rule") == rule.label, _passes(rule, F.col("metric"), F.col("bad_rows"))).otherwise(passes)
    told = merged.select(
        *by, "rule", F.when(~missing, metric).alias("metric"), F.when(~missing, bad).cast("bigint").alias("bad_rows"), missing.alias("missing")
    )
    outcome = F.when(F.col("missing"), ERROR).when(passes, PASS).otherwise(FAIL)
    return told.select(F.lit(table).alias("table_name"), *by, "rule", "metric", "bad_rows", outcome.alias("outcome"))
