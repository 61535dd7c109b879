from __future__ import annotations

import pytest

from tripmill.operators.contracts import Rule
from tripmill.operators.quality import evaluate, scorecard
from tripmill.plans.trips import QUALITY


def outcome(spark, values, type_name, rule):
    df = spark.createDataFrame([(v,) for v in values], f"c {type_name}")
    row = evaluate(df, "t", [rule]).first()
    return row["outcome"], row["bad_rows"]


def test_the_rule_sets_have_33_rules():
    assert {table: len(rules) for table, rules in QUALITY.items()} == {"yellow": 10, "green": 9, "fhvhv": 9, "fhv": 5}


@pytest.mark.parametrize(
    ("values", "rule", "expected"),
    [
        ([1.0] * 99 + [None], Rule("completeness", "c", 0.99), ("PASS", 1)),
        ([1.0] * 98 + [None] * 2, Rule("completeness", "c", 0.99), ("FAIL", 2)),
        ([1.0] * 19 + [None], Rule("completeness", "c", 0.95), ("PASS", 1)),
        ([1.0] * 18 + [None] * 2, Rule("completeness", "c", 0.95), ("FAIL", 2)),
        ([1.0] * 9 + [None], Rule("completeness", "c", 0.90), ("PASS", 1)),
        ([-50.0, None], Rule("at_least", "c", -50.0), ("PASS", 0)),
        ([-50.01, 1.0], Rule("at_least", "c", -50.0), ("FAIL", 1)),
        ([-0.01], Rule("at_least", "c", 0.0), ("FAIL", 1)),
        ([-100.0, 50000.0], Rule("between", "c", -100.0, 50000.0), ("PASS", 0)),
        ([-100.01, 50000.01], Rule("between", "c", -100.0, 50000.0), ("FAIL", 2)),
        ([0.0, 9.0], Rule("between", "c", 0, 9), ("PASS", 0)),
        ([10.0], Rule("between", "c", 0, 9), ("FAIL", 1)),
        ([1.0], Rule("row_count", low=0), ("PASS", 0)),
        ([], Rule("row_count", low=0), ("FAIL", 0)),
        ([], Rule("at_least", "c", 0.0), ("PASS", 0)),
        ([1.0], Rule("at_least", "absent", 0.0), ("ERROR", None)),
    ],
)
def test_rules(spark, values, rule, expected):
    assert outcome(spark, values, "double", rule) == expected


def test_one_aggregate_per_table(spark):
    df = spark.createDataFrame([(1.0, 2)], "c double, d int")
    rules = [Rule("row_count"), Rule("completeness", "c", 1.0), Rule("at_least", "d", 0), Rule("at_least", "no", 0)]
    card = scorecard({"t": df, "unruled": df}, {"t": rules})
    assert [tuple(r) for r in card.collect()] == [
        ("t", "row_count > 0", 1.0, 0, "PASS"),
        ("t", "completeness c >= 1", 1.0, 0, "PASS"),
        ("t", "d >= 0", 2.0, 0, "PASS"),
        ("t", "no >= 0", None, None, "ERROR"),
    ]
    assert card._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
