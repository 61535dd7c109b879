"""Document quality by Bradley-Terry pairwise ranking.

A pair is a text labelled 1 preferred to a text labelled 0. The score of a text is linear in its features, and the
probability that one is preferred to the other is the logistic function of the difference of their
scores; the weights minimise the logistic loss on feature differences, by Newton steps on a bounded sample. The threshold is
a quantile of the scores of all learning rows: the share of label 0 among them, over a histogram of ``BINS``. Scores are shifted so that
this quantile comes to ``CUT``, and squeezed into (0, 1).

Results by case: null, empty or wordless texts get the score of an empty text; labels other than 0 and 1 and null
labels aren't learnt from; where only one label (or none) occurs, every text scores ``CUT`` and is predicted 1;
repeated label rows of a document count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm.common import bounded_sample, filter_texts, map_texts, residue, saved

CUT = 0.7
BINS = 1 << 14
SYMBOLS = [ord(c) for c in "#*$%&<>"]
MARKS = [ord(c) for c in ".,;:?"]
UPPER, LOWER, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str | None) -> list[float]:
    """What the score sees: nothing but the whole text."""
    data = (text or "").encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    size = max(1.0, float(len(data)))
    words = data.split()
    n = len(words)
    each = max(1, n)
    kinds = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_lines = max(1, len(lines))
    share = count / size
    seen = share[share > 0]
    letters = count[UPPER].sum() + count[LOWER].sum() + count[128:].sum()
    return [
        share[SYMBOLS].sum(), share[124], share[33], share[MARKS].sum(), share[DIGIT].sum(), share[64] + share[47],
        count[UPPER].sum() / max(1.0, letters), letters / size, share[128:].sum(), share[10], share[40] + share[41] + share[91] + share[93] + share[123] + share[125],
        np.log1p(n) / 10, np.log1p(size / each) / 3, kinds / each, np.log1p(kinds) / 10, same / each, len(set(lines)) / n_lines,
        np.log1p(size / n_lines) / 10, float(-(seen * np.log2(seen)).sum()) / 8,
        max((words.count(w) for w in set(words[:1] + words[n // 2 : n // 2 + 1] + words[-1:])), default=0) / each,
        float(n < 20), share[ord("_")] + share[ord("=")] + share[ord("~")] + share[ord("\\")],
    ]


N_FEATURES = 22


def matrix(texts) -> np.ndarray:
    rows = [features(text) for text in texts]
    return np.array(rows).reshape(len(rows), N_FEATURES)


@dataclass
class Ranker:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        """Standardised, clipped and squared: a linear score of these may prefer a middle value."""
        x = np.clip((raw - self.middle) / self.spread, -4, 4)
        return np.concatenate([x, x * x], axis=1)

    def strength(self, raw: np.ndarray) -> np.ndarray:
        return self.expand(raw) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        shifted = self.strength(raw) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def fit(raw: np.ndarray, label: np.ndarray, share_of_bad: float, pairs: int = 40_000, decay: float = 1e-3, seed: int = 5) -> Ranker | None:
    """Newton on random preference pairs. ``share_of_bad``: label 0 among all learning rows, sampled or not."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    random = np.random.default_rng(seed)
    ranker = Ranker(raw.mean(0), raw.std(0) + 1e-6, np.zeros(2 * raw.shape[1]), 0.0)
    x = ranker.expand(raw)
    gap = x[good[random.integers(0, len(good), pairs)]] - x[bad[random.integers(0, len(bad), pairs)]]
    weights = ranker.weights
    for _ in range(12):
        chance = 1 / (1 + np.exp(-np.clip(gap @ weights, -30, 30)))
        slope = gap.T @ (chance - 1) / pairs + decay * weights
        bend = (gap * (chance * (1 - chance))[:, None]).T @ gap / pairs + decay * np.eye(len(weights))
        weights = weights - np.linalg.solve(bend, slope)
    ranker.weights = weights
    raw_score = x @ weights
    # quantile over the learning rows as they were before sampling
    weight = np.where(label == 1, (1 - share_of_bad) / len(good), share_of_bad / len(bad))
    order = np.argsort(raw_score, kind="stable")
    below = np.cumsum(weight[order])
    edge = min(int(np.searchsorted(below, share_of_bad)), len(order) - 1)
    after = min(edge + 1, len(order) - 1)
    ranker.threshold = float((raw_score[order[edge]] + raw_score[order[after]]) / 2)
    return ranker


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> Ranker | None:
    """Fit on the texts of the rows of ``labels`` (doc_id, quality). ``per_label`` bounds the sample: about so many rows
    of each label, by a hash of the id. The sample is drawn before the texts are read, so its broadcast
    is bounded too; features, not texts, reach the driver."""
    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen, counts = bounded_sample(known, "quality", "doc_id", per_label)
    if len(counts) < 2:
        return None
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def measure(frames):
        for frame in frames:
            yield pd.DataFrame({"quality": frame["quality"], "x": list(matrix(frame["text"]))})

    rows = sample.mapInPandas(measure, "quality int, x array<double>").orderBy("x", "quality").collect()
    if not rows:
        return None
    ranker = fit(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]), counts[0] / sum(counts.values()))
    if ranker:
        ranker.threshold = threshold(docs, known, ranker)
    return ranker


def threshold(docs: DataFrame, known: DataFrame, ranker: Ranker) -> float:
    """The score up to which as many of all learning rows lie as have label 0, half way to the next one. Scores, not texts,
    meet their labels; the counts of ``BINS`` bins at most reach the driver."""

    def work(columns, texts):
        return pa.RecordBatch.from_arrays([columns["doc_id"], pa.array(ranker.strength(matrix(texts.to_pylist())))], names=["doc_id", "strength"])

    scores = map_texts(docs, ["doc_id"], "doc_id bigint, strength double", work)
    rows = saved(scores.join(known, "doc_id").select("strength", "quality"), "learning-scores")
    low, high, bad = rows.agg(F.min("strength"), F.max("strength"), F.sum((F.col("quality") == 0).cast("bigint"))).first()
    width = max((high - low) / BINS, 1e-12)
    bins = rows.groupBy(F.floor((F.col("strength") - low) / width).alias("bin")).agg(F.count("*").alias("n"), F.min("strength").alias("low"), F.max("strength").alias("high"))
    found = bins.orderBy("bin").collect()
    edge = min(int(np.searchsorted(np.cumsum([r["n"] for r in found]), bad)), len(found) - 1)
    after = min(edge + 1, len(found) - 1)
    return (found[edge]["high"] + found[after]["low" if after > edge else "high"]) / 2


def marks(ranker: Ranker | None, texts: pa.Array) -> np.ndarray:
    return ranker.score(matrix(texts.to_pylist())) if ranker else np.full(len(texts), CUT)


def rate(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """(doc_id, score) of every whole text; no shuffle, one pass."""

    def work(columns, texts):
        return pa.RecordBatch.from_arrays([columns["doc_id"], pa.array(marks(ranker, texts))], names=["doc_id", "score"])

    return map_texts(docs, ["doc_id"], "doc_id bigint, score double", work)


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(residue("doc_id", 4) != 2)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = rate(docs, learn(docs, learning_labels(labels)))
    return scored.select(
        "doc_id",
        (residue("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted 1, all their columns, in one pass."""
    ranker = learn(docs, learning_labels(labels))
    return filter_texts(docs, lambda texts: marks(ranker, texts) >= CUT)
