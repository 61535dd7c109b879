"""Line dedup against a plain loop."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from tripmill.llm import linedup

STRIP = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_loop(rows, least_chars=40, at_least=5):
    key = lambda line: line.strip(STRIP).translate(UPPER)
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    found = []
    for doc, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = holders.get(key(line), set()) - {None}
            if len(ids) < at_least or doc == max(ids):
                kept.append(line)
        found.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return found


COMMON = "this sentence stands at the head of very many pages here"
RARE = "four pages only share this line, which is one too few to go"


def rows():
    made = [(i, f"{COMMON}\nown words {i}\n  {COMMON.upper()}\r\n" + ("ÄÖ" + COMMON if i % 2 else "")) for i in range(40)]
    made += [(100 + i, RARE) for i in range(4)]
    made += [(200 + i, "x" * 39 + "\n" + "é" * 40) for i in range(6)]
    made += [(7, made[7][1]), (7, COMMON + "\nanother text of the id"), (300, None), (301, ""), (302, "\n\n"), (None, COMMON + "\n" + RARE), (None, None)]
    return made + [(400, "\n".join(f"line {i} " + "long " * 10 for i in range(3000))), *[(401 + k, "\n".join(f"line {i} " + "long " * 10 for i in range(2000))) for k in range(4)]]


def test_lines_equal_loop(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string").repartition(5)
    for batches, fanout in ((6, 3), (1, 2), (4, 2)):
        shown = linedup.judged(docs, batches=batches, fanout=fanout).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) h").collect()
        order = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(map(tuple, shown), key=order) == sorted(by_loop(rows()), key=order)


def test_table_keeps_its_columns(spark):
    extra = "places string, row string, t1 bigint, doc_id bigint, text string, n_lines string, h1 string, batch string, lines string, line string"
    docs = spark.createDataFrame([("p", "r", i, i, COMMON if i else None, "n", "h", "b", "l", "m") for i in range(8)], extra)
    found = {r["doc_id"]: r for r in linedup.drop_repeated_lines(docs).collect()}
    assert linedup.drop_repeated_lines(docs).columns == docs.columns
    assert [found[i]["text"] for i in range(8)] == [None, "", "", "", "", "", "", COMMON] and found[3]["n_lines"] == "n"
    assert linedup.line_query(docs.limit(0)).collect() == []


def test_runs_are_few_and_settled_keys_stay_out(spark):
    runs = linedup.LineRuns(at_least=2, fanout=2)
    batch = lambda *keys: spark.createDataFrame([(d, k, k) for d, k in keys], "doc_id bigint, h1 bigint, h2 bigint")
    runs.add(batch((9, 1), (8, 1), (9, 2)))
    runs.add(batch((7, 1), (7, 2), (6, 3)))
    assert [len(level) for level in runs.levels] == [0, 1]
    assert sorted(map(tuple, runs.runs()[0].collect())) == [(1, 1, 2, 9), (2, 2, 2, 9), (3, 3, 1, 6)]
    runs.add(batch((5, 1), (5, 3)))
    assert sorted(map(tuple, runs.levels[0][0].collect())) == [(3, 3, 1, 5)]
    assert sorted(map(tuple, runs.repeated().collect())) == [(1, 1, 9), (2, 2, 9), (3, 3, 6)]


def test_no_python_in_the_plan(spark, sf_dir):
    from tripmill.llm.common import table

    plan = linedup.line_query(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
