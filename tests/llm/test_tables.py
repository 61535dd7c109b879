"""Mixing, chat, licences, near-duplicates, outliers, embeddings, pipeline: against brute force and SQL."""

from __future__ import annotations

import itertools
import math
import os
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from oracle import connect, differences
from tripmill.llm import chat, dart, forest, licenses, mixing, outliers
from tripmill.llm.common import table
from tripmill.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(ORACLE[name]).df()) == []


# ---------------------------------------------------------------- mixing


def expected_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_ones, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_ones:
        share = {s: left * weight[s] / sum(weight[o] for o in open_ones) for s in open_ones}
        over = [s for s in open_ones if share[s] >= 2 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
            open_ones.discard(s)
    return target


def mixing_rows():
    random = np.random.default_rng(4)
    rows = [(i, " ".join("w" * int(n)), ["b", "a", "é", None][i % 4], "x") for i, n in enumerate(random.integers(0, 60, 600))]
    return rows + [(1000 + i, "same words here", "b", "x") for i in range(300)] + [(2000, None, "z", "x"), (2001, "", "z", "x"), (0, "w w", "b", "x")]


def test_mixing(spark):
    docs = spark.createDataFrame(mixing_rows(), "doc_id bigint, text string, source string, size string")
    found = mixing.plan(docs).toPandas()
    assert len(found) == docs.count()
    assert (found["size"] >= 0).all() and (found["taken"] <= 2 * found["size"]).all()
    sizes: dict = {}
    for _, text, source, _ in mixing_rows():
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = expected_targets(sizes)
    for (size, wanted), part in found.groupby(["source_size", "target"]):
        assert any(size == sizes[s] and wanted == pytest.approx(target[s]) for s in sizes)
        assert abs(part["taken"].sum() - wanted) <= 60
    again = mixing.plan(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert found.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    corpus = mixing.mixed(docs)
    assert corpus.columns == docs.columns and corpus.count() == found["copies"].sum()
    assert mixing.plan(docs.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "only") for i in range(40)] + [(100, "w " * 500, "other")], "doc_id bigint, text string, source string")
    rows = mixing.sized(docs)
    cells = rows.groupBy("source", "size").count().withColumnRenamed("count", "n")
    solved = mixing.multipliers(cells, mixing.source_targets(cells)).toPandas().set_index("source").loc["only"]
    size = np.arange(1, 41)
    rate = np.full(40, 2.0) if solved["full"] else np.minimum(2, np.exp(solved["multiplier"] * size / solved["scale"]))
    assert (rate * size).sum() == pytest.approx(solved["target"], rel=1e-6)


# ---------------------------------------------------------------- chat


AWKWARD = [
    (1, 0, "us\\n\ner<|", "a<|b\\<\\|c\n<|im_end|>\n<|im_start|>x\\"), (1, 1, None, None), (1, 1, "assistant", "<"),
    (1, 3, "assistant", "|im_end|>\n\u0000n"), (2, None, "assistant", ""), (3, 5, "user", "same"), (3, 5, "user", "same"),
]


def test_chat_of_awkward_rows(spark):
    turns = spark.createDataFrame([(*r, "x") for r in AWKWARD], "conv_id bigint, turn int, role string, text string, segments string")
    frame = pd.DataFrame(AWKWARD, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    database = duckdb.connect()
    database.execute("create view conversations as select conv_id, cast(turn as bigint) as turn, role, text from frame")
    wanted = database.execute(chat.ORACLE_SQL.replace("by turn,", "by turn nulls first,")).df()
    assert differences(chat.chat_query(turns).toPandas(), wanted) == []
    assert chat.chat_query(turns.limit(0)).collect()[0]["conv_id"] == -1


def test_reply_trees_rank_branches(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 0.0), (2, 1, 9, "user", "orphan", None)]
    tree = spark.createDataFrame(nodes, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    best = {r["conv_id"]: [s["text"] for s in r["segments"] if s["loss"]] for r in chat.formatted(tree).collect()}
    assert best == {1: ["good", "end"], 2: []}
    both = [[s["text"] for s in r["segments"] if s["loss"]] for r in chat.formatted(tree, top=2).filter("conv_id = 1").collect()]
    assert sorted(both) == [["bad"], ["good", "end"]]


def test_long_chain(spark):
    turns = spark.createDataFrame([(7, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(300)], "conv_id bigint, turn bigint, role string, text string")
    row = chat.chat_query(turns).filter("conv_id = 7").first()
    assert row["n_turns"] == 300 and row["loss_chars"] == sum(len(str(i)) for i in range(1, 300, 2))


def test_chat_is_native(spark, sf_dir):
    plan = QUERIES["op5_chat_trees"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- licences


def test_license_spellings(spark):
    mit = next(text for name, text in licenses.KNOWN if name == "MIT" and len(text) > 500)
    texts = [mit.upper(), "Copyright (c) 2020 Someone\n * " + mit.replace(", ", " ,  "), "(c) 2011 me\n© you", None, "", "licensed   UNDER the apache licence -- v 2.0", "Some prose.\nReleased under the MIT License.\nMore.", mit + " extra"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id bigint, text string, known string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(texts) + 1
    by = {r["doc_id"]: (r["license_id"], r["notices"]) for r in found}
    assert [by[i][0] for i in range(8)] == ["MIT", "MIT", None, None, None, "Apache-2.0", None, None]
    assert by[6][1] == "MIT" and licenses.scan(docs.limit(0)).count() == 0


BSD_THREE = """Copyright (c) 2015, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_license_whole_texts(spark):
    mit = next(text for name, text in licenses.KNOWN if name == "MIT" and len(text) > 500).split("\n", 1)[1]
    cases = [("MIT", mit), ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2014 Someone\n\n{mit}"), ("BSD-3-Clause", BSD_THREE), ("BSD-3-Clause", f"# BSD 3-Clause License\n\n{BSD_THREE}")]
    folder = Path(licenses.__file__).parent / "license_texts"
    ids = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"]
    for name in ids:
        text = (folder / f"{name}.txt").read_text()
        cases += [(name, text), (name, "// " + text.upper().replace("\n", "\n// "))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")
    assert [(r["doc_id"], r["license_id"]) for r in licenses.scan(docs).orderBy("doc_id").collect()] == [(i, n) for i, (n, _) in enumerate(cases)]
    own = spark.createDataFrame([("B", "My Own Terms."), ("A", "my own terms"), ("A", "my own terms"), ("C", None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, "* MY own, terms"), (2, mit), (3, "see\nMy own terms")], "doc_id bigint, text string")
    found = [(r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan(docs, own).orderBy("doc_id").collect()]
    assert found == [(1, "A", "A"), (2, None, None), (3, None, "A")]


# ---------------------------------------------------------------- near-duplicate documents


def runs(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def brute_classes(docs: dict, threshold=0.8) -> dict:
    sets = {i: runs(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            one, two = sorted((find(a), find(b)))
            root[two] = one
    return {i: find(i) for i in docs}


def near_copies():
    random = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, number = {}, 0
    for group in range(6):
        base = list(random.choice(vocabulary, 120))
        for copy in range(12 if group else 40):
            text = list(base)
            for at in random.integers(0, 120, copy % 5):
                text[at] = f"new{random.integers(0, 30)}"
            docs[number] = (" " if copy % 2 else "\n").join(text)
            number += 1
    for text in (None, "", " ", "a", "a", "a b", "b a", "same short text here", "same  short text here", "x " * 4000, "x " * 5000):
        docs[number] = text
        number += 1
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = near_copies()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id bigint, text string, class_id string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in dart.classes(frame).collect()}
    assert found == brute_classes(docs)
    kept = dart.keep_one(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(found.values())
    assert dart.classes(frame.limit(0)).count() == 0


def test_null_repeated_and_conflicting_ids(spark):
    long = [" ".join(f"{letter}{i}" for i in range(60)) for letter in "pqrstu"]
    near = long[1].replace("q59", "other")
    rows = [
        (1, long[0], "b"), (1, long[0], "a"), (1, long[0], "a"),  # one document, its least row stays
        (None, long[2], "n"), (None, long[3], "n"), (None, long[3] + " ", "m"), (None, None, "w"),
        (2, long[1], "x"), (3, long[4], "x"), (3, near, "x"),  # a text of 3 is a near copy of 2
        (4, long[5], "x"), (None, long[5], "x"), (5, None, "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    for turn in (frame, frame.orderBy(F.desc("text"), "source").coalesce(1)):
        kept = dart.keep_one(turn)
        assert kept.columns == frame.columns
        assert sorted(kept.collect(), key=str) == sorted(
            [(1, long[0], "a"), (None, long[2], "n"), (None, long[3], "n"), (None, None, "w"), (2, long[1], "x"), (3, long[4], "x"), (4, long[5], "x"), (5, None, "x")], key=str
        )
    found = [(r["doc_id"], r["kept"]) for r in dart.classes(frame).collect()]
    assert sorted(found, key=str) == sorted([(1, True), (None, True), (None, True), (None, True), (2, True), (3, True), (3, False), (4, True), (None, False), (5, True)], key=str)


def test_pruning_misses_less_than_the_bands():
    n, least = dart.COORDINATES, int((dart.SIMILARITY - dart.LESS) * dart.COORDINATES)
    tail = sum(math.comb(n, k) * dart.SIMILARITY**k * (1 - dart.SIMILARITY) ** (n - k) for k in range(least))
    assert tail < (1 - dart.SIMILARITY**dart.ROWS) ** dart.BANDS


def test_signatures_estimate_weighted_similarity():
    random = np.random.default_rng(2)
    element = np.arange(1, 301, dtype=np.uint64) * np.uint64(7919)
    one, two = random.integers(0, 6, 300).astype(float), random.integers(0, 6, 300).astype(float)
    owner = np.repeat([0, 1], 300)
    agree, rounds = 0, 40
    for shift in range(rounds):
        made = dart.signatures(np.tile(element + np.uint64(shift * 1_000_003), 2), np.concatenate([one, two]), owner, 2)
        agree += (made[0] == made[1]).mean() / rounds
    assert agree == pytest.approx(np.minimum(one, two).sum() / np.maximum(one, two).sum(), abs=0.03)


def test_repeated_elements_change_nothing():
    element = np.array([5, 9, 5, 5], np.uint64)
    both = dart.signatures(element, np.ones(4), np.zeros(4, int), 1), dart.signatures(element[:2], np.ones(2), np.zeros(2, int), 1)
    assert (both[0] == both[1]).all()


# ---------------------------------------------------------------- outliers


def test_base_statistics_equal_brute_force(spark, sf_dir):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").limit(120).collect()] + [None, "", "a a a a a a a a a a a a a a a a a a a a a", "x\nx\n \n \n#*$", "é ü\x85z " * 30]
    docs = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: r for r in outliers.judged(docs).collect()}
    for i, text in enumerate(texts):
        words, text = WORD.findall(text or ""), text or ""
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        row = found[i]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
        )
        assert row["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert outliers.judged(docs.limit(0)).count() == 0


def test_estimates_equal_numpy(spark):
    random = np.random.default_rng(6)
    x = np.concatenate([random.standard_normal((400, 5)), random.standard_normal((60, 5)) + 12])
    rows = spark.createDataFrame([("g", i % outliers.SALTS, [float(v) for v in row]) for i, row in enumerate(x)], "group string, salt int, x array<double>")
    found = outliers.estimates(rows).first()
    inverse = np.array(found["inverse"]).reshape(5, 5)
    gap = x - np.array(found["middle"])
    distance = (gap @ inverse * gap).sum(1)
    assert (distance[:400] <= outliers.CUTOFF).mean() > 0.99 and (distance[400:] > outliers.CUTOFF).all()
    nearest = np.argsort(distance)[: int(0.75 * len(x))]
    assert np.abs(x[nearest].mean(0) - np.array(found["middle"])).max() < 0.1


def test_every_statistic_can_reject(spark):
    random = np.random.default_rng(3)
    clean = random.standard_normal((600, 5)) * [0.8, 0.05, 0.0, 0.0, 0.0] + [5.6, 1.6, 0, 0, 0]
    rows = spark.createDataFrame([("g", i % outliers.SALTS, row.tolist()) for i, row in enumerate(clean)], "group string, salt int, x array<double>")
    found = outliers.estimates(rows).first()
    inverse, middle = np.array(found["inverse"]).reshape(5, 5), np.array(found["middle"])
    gap = lambda n, k, of, words: np.array([0, 0, 0, (k / (of + 4)) ** 0.5 if of else 0, words**0.5]) + [np.log(n) - 5.6, 0, 0, 0, 0]
    far = [gap(270, 50, 100, 0), gap(270, 80, 100, 0), gap(270, 9, 10, 0), gap(270, 50, 100, 0.29), gap(270, 0, 0, 0.29), np.array([0, np.log(1.6), 0, 0, 0])]
    for one in far:
        x = one + [5.6, 1.6, 0, 0, 0]
        assert (x - middle) @ inverse @ (x - middle) > outliers.CUTOFF
    x = gap(270, 1, 10, 0.02) + [5.6, 1.6, 0, 0, 0]
    assert (x - middle) @ inverse @ (x - middle) < outliers.CUTOFF
    assert (((clean - middle) @ inverse * (clean - middle)).sum(1) <= outliers.CUTOFF).mean() > 0.98


def test_estimate_has_settled(spark):
    random = np.random.default_rng(12)
    x = np.concatenate([random.standard_normal((300, 5)) * [1, 0.1, 0.3, 0.2, 0.2], random.standard_normal((90, 5)) * 0.2 + [2, 0.5, 1, 1, 1]])
    rows = spark.createDataFrame([("g", i % outliers.SALTS, row.tolist()) for i, row in enumerate(x)], "group string, salt int, x array<double>")
    found = outliers.estimates(rows).first()
    gap = x - np.array(found["middle"])
    distance = (gap @ np.array(found["inverse"]).reshape(5, 5) * gap).sum(1)
    near = x[distance <= np.sort(distance)[int(np.ceil(0.75 * len(x))) - 1] * 1.001]
    spread = outliers.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(outliers.FLOORS))
    assert np.linalg.slogdet(spread)[1] == pytest.approx(np.linalg.slogdet(np.linalg.inv(np.array(found["inverse"]).reshape(5, 5)))[1], abs=5e-3)
    assert (distance[300:] > outliers.CUTOFF).all()


def test_no_row_count_switches_the_rule(spark):
    random = np.random.default_rng(5)

    def rows(group, count, letters):
        return [(" ".join("".join(random.choice(list("abcdefghij"), random.integers(letters - 1, letters + 2))) for _ in range(random.integers(60, 200))), group) for _ in range(count)]

    big = rows("big", 300, 5)
    far = " ".join("".join(random.choice(list("abcdefghij"), 11)) for _ in range(100))
    seen = {}
    for count in (48, 49, 50, 51):
        texts = [*big, *rows("small", 51, 8)[:count], (far, "small")]
        docs = spark.createDataFrame([(i, t, "x", s) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
        seen[count] = {r["doc_id"]: r for r in outliers.judged(docs).collect()}
        kept = [r["kept"] for i, r in seen[count].items() if 300 <= i < 300 + count]
        assert np.mean(kept) > 0.9
    distances = [seen[c][300 + c]["distance"] for c in (48, 49, 50, 51)]
    assert max(distances) < 1.5 * min(distances)
    few = spark.createDataFrame([(i, t, "x", s) for i, (t, s) in enumerate([*big[:30], ("#$ " * 3 + "$%&*|<># " * 40 + " ".join(f"q{i}" for i in range(400)), "big")])], "doc_id bigint, text string, lang string, source string")
    assert {r["doc_id"]: r["distance"] is not None for r in outliers.judged(few).collect()} == dict.fromkeys(range(31), True)


# ---------------------------------------------------------------- embeddings


def embedding_rows():
    random = np.random.default_rng(8)
    rows, number = [], 0
    for label in (0, 1):
        for centre in random.standard_normal((40, 16)):
            for _ in range(random.integers(1, 9)):
                rows.append((number, [float(v) for v in centre + 0.05 * random.standard_normal(16)], label))
                number += 1
    same = [float(v) for v in random.standard_normal(16)]
    rows += [(number + i, same, 1) for i in range(30)] + [(number + 30, [2 * v for v in same], 1), (number + 31, same, None), (number + 32, same, 0)]
    number += 33
    strange = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *same[1:]], [None, *same[1:]], same[:8]]
    return rows + [(number + i, v, 1) for i, v in enumerate(strange)]


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rows = embedding_rows()
    for name, value in (("LEAF", 24), ("SAMPLE", 200), ("BLOCK", 16)):
        monkeypatch.setattr(forest, name, value)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, kept string")
    found = {r["vec_id"]: r for r in forest.near_duplicates(frame).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    links = {i: [j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.98 - 1e-12] for i in good}
    assert len(found) == len(rows)
    total = sum(len(x) for x in links.values())
    assert sum(r["n_links"] for r in found.values()) >= 0.95 * total
    assert all(r["n_links"] <= len(links.get(i, ())) for i, r in found.items())
    assert all(r["kept"] == (r["component_id"] == i) and r["component_id"] <= i for i, r in found.items())
    assert all(r["n_links"] == 0 and r["kept"] for i, r in found.items() if i not in good)
    assert forest.near_duplicates(frame.limit(0)).count() == 0


def test_large_embedding_groups_take_few_jobs(spark, monkeypatch):
    """Labels larger than a task's load, components larger than a count's, and as many jobs as for small ones but for the trees."""
    for name, value in (("LEAF", 24), ("SAMPLE", 200), ("BLOCK", 16), ("GROUP_BYTES", 128 * 80), ("COUNTED", 40)):
        monkeypatch.setattr(forest, name, value, raising=False)
    random = np.random.default_rng(9)
    points = [c + 0.05 * random.standard_normal(16) for c in random.standard_normal((60, 16)) for _ in range(4)]
    points += [np.eye(16)[0] + 0.02 * random.standard_normal(16) for _ in range(150)] + [np.eye(16)[1] * (1 + k) for k in range(170)]
    points += [np.cos(k / 50) * np.eye(16)[2] + np.sin(k / 50) * np.eye(16)[3] for k in range(314)]
    table = spark.createDataFrame([(i, [float(v) for v in p], i % 2 if i < 240 else 0) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>, label int")
    spark.sparkContext.setJobGroup("forest", "forest")
    found = {r["vec_id"]: r for r in forest.near_duplicates(table).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    x = np.array(points) / np.linalg.norm(points, axis=1, keepdims=True)
    label = np.array([i % 2 if i < 240 else 0 for i in range(len(points))])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    assert [found[i]["n_links"] for i in range(len(points))] == (near.sum(1) - 1).tolist()
    assert {found[i]["component_id"] for i in range(240, 390)} == {240} and {found[i]["component_id"] for i in range(560, 874)} == {560}
    assert jobs < 160


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, labels = docs.columns, table(spark, sf_dir, "labels").toPandas().set_index("doc_id")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            left = labels.loc[labels.index.isin([r["doc_id"] for r in docs.select("doc_id").collect()]), "quality"]
            assert left.mean() > 0.95 and len(left) > 0.8 * (labels["quality"] == 1).sum()
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            classes = brute_classes(texts)
            assert all(i == c for i, c in classes.items())  # no near copies are left
        if k == 3:
            mixed = docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
            assert mixed == 2
    assert docs.agg({"length": "sum"}).first()[0] > 0 and counts[0] >= counts[1] >= counts[2]


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id", "sequence_id").count() > 0
