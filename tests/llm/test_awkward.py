"""Null, repeated and conflicting ids, clashing columns, circles, hostile pages; forward passes against plain loops."""

from __future__ import annotations

import os
import re
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from tripmill.llm import chat, common, dart, extraction, forest, langid, licenses, mixing, quality
from tripmill.llm.common import table

MIT = "Released under the MIT License."


def order(row):
    return [(v is None, str(v)) for v in row]


# ---------------------------------------------------------------- embeddings


def test_embedding_ids_that_are_null_or_shared(spark):
    near, far = [1.0, 0.02, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, [1.0, 0.0, 0.0], 1), (None, far, 1), (5, near, 1), (5, [0.0, 1.0, 0.0], 1), (0, [1.0, 0.01, 0.0], 1), (7, far, 2), (7, far, 2)]
    found = forest.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(
        [(None, 2, 0, False), (None, 0, None, True), (5, 2, 0, False), (5, 0, 5, True), (0, 2, 0, True), (7, 1, 7, True), (7, 1, 7, True)], key=order
    )


def test_embedding_groups_that_no_plane_divides(spark, monkeypatch):
    for name, value in (("LEAF", 8), ("SAMPLE", 64), ("BLOCK", 16)):
        monkeypatch.setattr(forest, name, value)
    one_line = [(i, [1.0, 1e-9 * i], 1) for i in range(100)]
    spread = [(1000 + i, [float(np.cos(i)), float(np.sin(i))], 2) for i in range(100)]
    found = {r["vec_id"]: r for r in forest.near_duplicates(spark.createDataFrame(one_line + spread, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert all(found[i]["n_links"] == 99 and found[i]["component_id"] == 0 for i in range(100))
    assert all(found[1000 + i]["n_links"] == sum(np.cos(i - j) >= 0.98 for j in range(100)) - 1 for i in range(100))


# ---------------------------------------------------------------- pages


def test_article_parts_with_telling_names_stay(spark):
    words = "Words of the story go on. " * 10
    page = (
        f"<body><article><p>{words}</p><h2 id='related-work'>Related work</h2><p>{words}</p>"
        f"<section id='login'><p>How to log in today</p></section><p>{words}</p><p class='alert-level'>Level three</p></article>"
        "<div id='related'>other pages of ours</div></body>"
    )
    plain = " ".join(words.split())
    assert extraction.extract(page, {}) == f"{plain} Related work {plain} How to log in today {plain} Level three"


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a '" * 250_000, "<a '" * 250_000 + ">", "<main>x</main><div>" * 40_000, "<script" * 140_000, "<!--" * 250_000, "<b>" * 300_000 + "</i>" * 20_000, "&#" + "9" * 100_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    extraction.extract(page, {})
    assert time.perf_counter() - start < 6


def test_tokens_equal_a_plain_reading():
    tag = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    dice = np.random.default_rng(6)
    for _ in range(300):
        page = "".join(dice.choice(["<a ", "<b>", "</b>", "x", "<", ">", "'", '"', "=", " ", "<p id='q'>"], 14))
        expected, at, text = [], 0, ""
        while at < len(page):
            found = tag.match(page, at)
            if found:
                expected += [("text", "", text)] * bool(text) + [("close" if found.group(1) else "open", found.group(2).lower(), found.group(3))]
                text, at = "", found.end()
            else:
                text, at = text + page[at], at + 1
        assert extraction.tokens(page) == expected + [("text", "", text)] * bool(text)


# ---------------------------------------------------------------- licences


def test_notices_belong_to_their_row(spark):
    docs = spark.createDataFrame([(1, MIT), (1, "nothing here"), (None, f"x\n{MIT}"), (None, None), (2, ""), (3, f"{MIT}\n{MIT}"), (3, f"{MIT}\n{MIT}")], "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan(docs).collect()), key=order)
    assert found == sorted([(1, "MIT", "MIT"), (1, None, None), (None, None, "MIT"), (None, None, None), (2, None, None), (3, None, "MIT"), (3, None, "MIT")], key=order)
    assert licenses.scan(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- chat


def test_circles_and_repeated_nodes(spark):
    rows = [
        (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 2, 1, "assistant", "a", 0.0), (1, None, 1, "user", "no node", 0.0),
        (2, 1, 1, "assistant", "own parent", 0.0), (3, 1, 3, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (3, 3, 2, "user", "z", 0.0),
        (3, 4, 3, "assistant", "below a circle", 9.0), (3, 5, None, "assistant", "apart", 0.0),
    ]
    nodes = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    found = {r["conv_id"]: [s["text"] for s in r["segments"] if s["loss"]] for r in chat.format_trees(nodes).collect()}
    assert found == {1: ["a"], 3: ["apart"]}
    assert chat.format_trees(nodes.limit(0)).collect() == []


# ---------------------------------------------------------------- mixing and near-dedup


def mixed_rows():
    same = [(None, "copy of one row here", "b")] * 40
    return [(None, " ".join(f"w{i}" for i in range(n)), "b") for n in range(1, 30)] + same + [(7, "a b c", "a"), (7, "d e f g", "a"), (8, None, "a"), (9, "x " * 90, None)]


def test_mixed_delivers_what_the_plan_takes(spark):
    docs = spark.createDataFrame([(*r, "all", "plan", 1) for r in mixed_rows()], "doc_id bigint, text string, source string, all_rows string, plan_id string, copy int").repartition(6)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns and {r["all_rows"] for r in made.collect()} == {"all"}
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0))
    got = {r["source"]: r["s"] for r in made.groupBy("source").agg(F.sum(size).alias("s")).collect()}
    plan = mixing.plan(docs.select(F.xxhash64("doc_id", "text", F.lit("source"), "source").alias("doc_id"), "text", "source")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert sorted(got.values()) == sorted(r["t"] for r in plan)
    assert all(abs(r["t"] - r["target"]) <= 90 for r in plan)
    most = max(r["n"] for r in made.groupBy("doc_id", "text").agg(F.count("*").alias("n")).filter("text <> 'copy of one row here'").collect())
    assert most <= 2 and sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, made.collect()))


def test_near_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "k", "d", "l", "r"), (2, text, "k", "d", "l", "r"), (3, "other text", "k", "d", "l", "r"), (None, "third", "k", "d", "l", "r"), (None, None, "k", "d", "l", "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `key` string, digest string, lead string, row string")
    kept = dart.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=order) == sorted([rows[0], *rows[2:]], key=order)


# ---------------------------------------------------------------- language and quality


def test_held_out_is_never_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.limit(60).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    shown = langid.held_out_split(odd).filter("doc_id is null").select("held_out").collect()
    assert [r["held_out"] for r in shown] == [False] * 3
    assert odd.filter(common.residue("doc_id", 4) == 2).filter("doc_id is null").isEmpty()


def softsign(x):
    return x / (1 + np.abs(x))


def test_language_forward_pass_equals_a_plain_loop():
    net = langid.fresh(["aa", "bb", "cc"], 5, 3)
    dice = np.random.default_rng(1)
    for w in net.weights:
        w += dice.standard_normal(w.shape).astype(np.float32) * 0.5
    texts = ["", "a", "héllo wörld " * 30, "x" * 64, "y" * 65]
    raw, offsets = common.text_bytes(pa.array(texts))
    found = langid.predict(net, raw, offsets)
    gate = lambda x: 0.5 * (1 + softsign(x))
    hidden = 5
    for number, text in enumerate(texts):
        data, chances = text.encode(), []
        for begin in range(0, len(data), langid.WINDOW):
            window = data[begin : begin + langid.WINDOW]
            states = []
            for way, steps in ((0, range(len(window))), (1, reversed(range(len(window))))):
                state, kept = np.zeros(hidden), {}
                for t in steps:
                    drive = net.steps[way][:, window[t]]
                    again = net.loop[way] @ state
                    keep, reset = gate(drive[:hidden] + again[:hidden]), gate(drive[hidden : 2 * hidden] + again[hidden : 2 * hidden])
                    inner = again[2 * hidden :] + net.shift[way][:, 0]
                    candidate = softsign(drive[2 * hidden :] + reset * inner)
                    state = keep * state + (1 - keep) * candidate
                    kept[t] = state
                states.append(kept)
            for t in range(len(window)):
                scores = net.out @ np.concatenate([states[0][t], states[1][t]]) + net.bias[:, 0]
                chance = np.exp(scores - scores.max())
                chances.append(chance / chance.sum())
        expected = np.mean(chances, axis=0) if chances else np.zeros(3)
        assert np.allclose(found[number], expected, atol=1e-4)


def test_quality_scores_equal_a_plain_formula():
    dice = np.random.default_rng(2)
    width = quality.N_FEATURES
    ranker = quality.Ranker(dice.standard_normal(width), dice.random(width) + 0.5, dice.standard_normal(2 * width), 0.3)
    texts = ["Plain words, and more of them.", "", None, "### $$$ 1 2 3"]
    found = quality.marks(ranker, pa.array(texts))
    for text, score in zip(texts, found, strict=True):
        total = 0.0
        for k, value in enumerate(quality.features(text)):
            x = min(4.0, max(-4.0, (value - ranker.middle[k]) / ranker.spread[k]))
            total += ranker.weights[k] * x + ranker.weights[width + k] * x * x
        assert score == pytest.approx(1 / (1 + np.exp(-(total - 0.3 + np.log(quality.CUT / (1 - quality.CUT))))))


# ---------------------------------------------------------------- pipeline


def test_pipeline_with_awkward_rows(spark, sf_dir, tmp_path):
    source = table(spark, sf_dir, "documents")
    head = source.limit(120)
    odd = head.unionByName(head.limit(20)).unionByName(head.limit(20).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.unionByName(head.limit(10).withColumn("text", F.concat(F.lit("Other words in front. "), F.col("text"))))
    odd = odd.withColumns({"key": F.lit("k"), "all_rows": F.lit(1), "row_key": F.lit("r")})
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}-in")
        docs = spark.read.parquet(f"{tmp_path}/{name}-in")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert k == 4 or docs.columns == columns
        assert (docs.count() > 0) == (name == "odd")
