"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by back-propagation through time, on windows of a bounded
sample of labelled rows. It labels every byte position of every whole text; a document's
probabilities are the mean over its positions. Texts are read in windows of ``WINDOW`` bytes, each
started from the zero state on both sides, so that memory doesn't depend on a text's length.

Results by case: null text or no letter gives ``und`` with score 0; an empty training set gives ``und`` for all;
repeated rows are judged alike; ties go to the first language by code point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tripmill.llm.common import bounded_sample, filter_texts, map_texts, residue, text_bytes

WINDOW = 64
CHUNK = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """``steps`` (2, 3H, 256): input table, ``loop`` (2, 3H, H): recurrent weights, ``shift`` (2, H, 1): bias of
    the candidate's recurrent part, ``out`` (C, 2H) and ``bias`` (C, 1): the position's label. First axis:
    direction. Rows of 3H: keep gate, reset gate, candidate. Softsign stands for tanh, and its half for
    the logistic gate: same shape, cheap without a transcendental function."""

    labels: list[str]
    steps: np.ndarray
    loop: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.steps, self.loop, self.shift, self.out, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Network:
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(
        labels, draw(2, 3 * hidden, 256), draw(2, 3 * hidden, hidden), np.zeros((2, hidden, 1), np.float32),
        draw(len(labels), 2 * hidden), np.zeros((len(labels), 1), np.float32),
    )


def softsign(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    np.abs(x, out=spare)
    spare += 1
    return np.divide(x, spare, out=x)


def run(net: Network, way: int, windows: np.ndarray, alive: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over windows (T, B); the backward one is stored in text order.
    ``alive`` (T, B) is 0 where a window is padded. ``tape`` receives what training needs."""
    hidden, (length, count) = net.loop.shape[2], windows.shape
    steps, loop, shift = net.steps[way], net.loop[way], net.shift[way]
    states = np.empty((length, hidden, count), np.float32)
    drive, again, spare = (np.empty((3 * hidden, count), np.float32) for _ in range(3))
    state = np.zeros((hidden, count), np.float32)
    for t in range(length) if way == 0 else range(length - 1, -1, -1):
        np.take(steps, windows[t], axis=1, out=drive, mode="clip")
        np.matmul(loop, state, out=again)
        gates, inner = drive[: 2 * hidden], again[2 * hidden :]
        gates += again[: 2 * hidden]
        softsign(gates, spare[: 2 * hidden])
        gates += 1
        gates *= 0.5
        inner += shift
        candidate = drive[2 * hidden :]
        candidate += np.multiply(gates[hidden:], inner, out=spare[:hidden])
        softsign(candidate, spare[:hidden])
        if tape is not None:
            tape.append((t, state.copy(), gates[:hidden].copy(), gates[hidden:].copy(), inner.copy(), candidate.copy()))
        after = states[t]
        np.subtract(state, candidate, out=after)
        after *= gates[:hidden]
        after += candidate
        after *= alive[t]
        state = after
    return states


def positions(net: Network, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label probabilities at every position, (T, C, B)."""
    hidden = net.loop.shape[2]
    scores = net.out[:, :hidden] @ left
    scores += net.out[:, hidden:] @ right
    scores += net.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, windows: np.ndarray, valid: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions of windows (B, T), and its gradient by back-propagation through time."""
    hidden = net.loop.shape[2]
    turned, alive = np.ascontiguousarray(windows.T).astype(np.intp), valid.T.astype(np.float32)
    tapes: list[list] = [[], []]
    left, right = (run(net, way, turned, alive, tapes[way]) for way in (0, 1))
    chance = positions(net, left, right)
    weight = (alive / alive.sum())[:, None, :]
    at = np.broadcast_to(target[None, None, :], (len(turned), 1, len(target)))
    picked = np.take_along_axis(chance, at, 1)
    loss = float(-(np.log(picked + 1e-12) * weight).sum())
    np.put_along_axis(chance, at, picked - 1, 1)
    miss = chance * weight
    both = np.concatenate([left, right], axis=1)
    d_out, d_bias = np.einsum("tcb,thb->ch", miss, both, optimize=True), miss.sum((0, 2))[:, None]
    pulled = net.out.T @ miss
    d_steps, d_loop, d_shift = np.zeros_like(net.steps), np.zeros_like(net.loop), np.zeros_like(net.shift)
    for way in (0, 1):
        mine = pulled[:, way * hidden : (way + 1) * hidden]
        d_drive = np.empty((len(turned), 3 * hidden, len(target)), np.float32)
        back = np.zeros((hidden, len(target)), np.float32)
        for t, before, keep, reset, inner, candidate in reversed(tapes[way]):
            back = (back + mine[t]) * alive[t]
            d_candidate = back * (1 - keep) * (1 - np.abs(candidate)) ** 2
            # a gate is half of one plus softsign, whose slope is (1 - |softsign|) squared
            d_keep = back * (before - candidate) * 0.5 * (1 - np.abs(2 * keep - 1)) ** 2
            d_reset = d_candidate * inner * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
            d_inner = d_candidate * reset
            d_again = np.concatenate([d_keep, d_reset, d_inner])
            d_drive[t] = np.concatenate([d_keep, d_reset, d_candidate])
            d_loop[way] += d_again @ before.T
            d_shift[way] += d_inner.sum(1, keepdims=True)
            back = back * keep + net.loop[way].T @ d_again
        one_hot = np.zeros((turned.size, 256), np.float32)
        one_hot[np.arange(turned.size), turned.ravel()] = 1
        d_steps[way] = d_drive.transpose(1, 0, 2).reshape(3 * hidden, -1) @ one_hot
    return loss, [d_steps, d_loop, d_shift, d_out.astype(np.float32), d_bias]


def train(labels: list[str], windows: np.ndarray, valid: np.ndarray, target: np.ndarray, hidden: int = 10, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on random batches in which every label is equally likely."""
    net, random = fresh(labels, hidden, seed), np.random.default_rng(seed)
    places = [np.flatnonzero(target == c) for c in range(len(labels))]
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        label = random.integers(0, len(labels), batch)
        rows = np.array([places[c][random.integers(0, len(places[c]))] for c in label])
        _, slopes = gradients(net, windows[rows], valid[rows], target[rows])
        scale = min(1.0, 5.0 / (np.sqrt(sum(float((g * g).sum()) for g in slopes)) + 1e-9))
        pace = rate * (1 - (step - 1) / steps)
        for w, g, m, v in zip(net.weights, slopes, first, second, strict=True):
            m += 0.1 * (g * scale - m)
            v += 0.01 * ((g * scale) ** 2 - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts of a batch end to end, which of their positions are real, and each window's text."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    length = np.minimum(sizes[owner] - start, WINDOW)
    at = (offsets[owner] + start)[:, None] + np.arange(WINDOW)
    valid = np.arange(WINDOW) < length[:, None]
    windows = np.where(valid, raw[np.minimum(at, max(len(raw) - 1, 0))], 0) if len(raw) else np.zeros((0, WINDOW), np.uint8)
    return windows.astype(np.uint8), valid, owner


def predict(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities of every text of a batch, (texts, labels); zeros for empty texts.
    Works through ``CHUNK`` windows at a time, so its memory is bounded."""
    texts = len(offsets) - 1
    total, seen = np.zeros((texts, len(net.labels))), np.zeros(texts)
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(texts), counts)
    start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    length = np.minimum(offsets[owner + 1] - start, WINDOW) if len(owner) else start
    spot = np.arange(WINDOW)
    for begin in range(0, len(owner), CHUNK):
        part = slice(begin, begin + CHUNK)
        alive = spot[:, None] < length[part]
        windows = np.where(alive, raw[np.minimum(start[part] + spot[:, None], len(raw) - 1)], 0).astype(np.intp)
        alive = alive.astype(np.float32)
        chance = positions(net, run(net, 0, windows, alive), run(net, 1, windows, alive))
        chance *= alive[:, None, :]
        pooled = chance.sum(0, dtype=np.float64).T
        np.add.at(total, owner[part], pooled)
        np.add.at(seen, owner[part], length[part])
    return total / np.maximum(seen, 1)[:, None]


def learn(labelled: DataFrame, per_language: int = 250, windows_per_text: int = 6, **training) -> Network | None:
    """Train on (doc_id, text, lang). ``per_language`` bounds the sample: about so many texts of each language,
    by a hash of the id, and ``windows_per_text`` evenly spaced windows of each. None where nothing is labelled."""
    known = labelled.filter("text is not null and lang is not null").select("doc_id", "lang", "text")
    sample, _ = bounded_sample(known, "lang", "doc_id", per_language)

    def pieces(frames):
        for frame in frames:
            rows = []
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                data = text.encode()
                spare = max(0, len(data) - WINDOW)
                starts = sorted({spare * i // max(1, windows_per_text - 1) for i in range(windows_per_text)})
                rows += [(lang, data[s : s + WINDOW]) for s in starts if any(ch.isalpha() for ch in text)]
            yield pd.DataFrame(rows, columns=["lang", "piece"])

    rows = sample.mapInPandas(pieces, "lang string, piece binary").orderBy("lang", "piece").collect()
    if not rows:
        return None
    labels = sorted({row["lang"] for row in rows})
    raw = np.frombuffer(b"".join(row["piece"] for row in rows), np.uint8)
    offsets = np.cumsum([0, *(len(row["piece"]) for row in rows)])
    windows, valid, owner = windows_of(raw, offsets)
    target = np.array([labels.index(rows[i]["lang"]) for i in owner])
    return train(labels, windows, valid, target, **training)


def judge(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of every text of a batch."""
    raw, offsets = text_bytes(texts)
    chance = predict(net, raw, offsets)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best = chance.argmax(1)
    score = np.clip(chance[np.arange(len(best)), best], 0.0, 1.0)
    names = np.array(net.labels, dtype=object)
    return np.where(lettered, names[best], UNKNOWN), np.where(lettered, score, 0.0)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every text; no shuffle, one pass."""
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def work(columns, texts):
        label, score = judge(net, texts)
        return pa.RecordBatch.from_arrays(
            [columns["doc_id"], pa.array(label, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
        )

    return map_texts(docs, ["doc_id"], "doc_id bigint, lang_pred string, score double", work)


def held_out_split(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", residue("doc_id", 5) == 0)


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    net = learn(docs.filter(residue("doc_id", 5) != 0))
    return held_out_split(identify(docs, net)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """The documents with a letter whose best language has a mean probability of ``min_score`` at least; all their
    columns, in the same pass. Without a labelled row nothing is learnt, and nothing passes."""
    net = learn(docs.filter(residue("doc_id", 5) != 0))
    if net is None:
        return docs.filter("false")

    def passes(texts):
        label, score = judge(net, texts)
        return (label != UNKNOWN) & (score >= min_score)

    return filter_texts(docs, passes)
