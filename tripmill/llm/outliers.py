"""Quality rules with robust multivariate outliers.

Base rules look at one text. Texts that pass are also held against their own language and source: a vector of
transformed statistics (length, word length, symbols, repeated lines, repeated words) is rejected when its
Mahalanobis distance from the minimum covariance determinant estimate is too large. The estimate has three starts (medians
and absolute deviations; the scatter of the directions in which the rows lie; mean and covariance of all rows) and takes
concentration steps from each: distances of all rows, the ``HALF`` nearest ones, their mean and covariance, until the
determinant no longer falls; the smallest determinant counts. Each step is two grouped aggregates with map-side combine
over all rows (a histogram of distances, then sums of products), so the group that holds a third of all rows is no single
task's; only the estimates, one small row per group, are inverted in Python. ``FLOORS`` are added to the variances:
statistics that are zero in the whole half would leave nothing to invert, and one symbol or repeated line would be
infinitely far; so they are a tolerance of about a fifth of lines or words.

The estimates are made for every language and source, every language, and all texts. What judges a text is its own group's
estimate drawn towards its language's, drawn towards that of all texts, drawn towards ``USUAL``: of n rows an estimate's
middle weighs n / (n + ``MIDDLE_ROWS``) and its covariance n / (n + ``SPREAD_ROWS``), whatever n is, and where middles
differ the rest of the gap counts as spread. So no count of rows switches the rule.

Results by case: null or wordless texts have no words and fail the base rules; null language or source is a group like
any other; a text alone in its group is mostly judged by its language, and alone in its table it is kept; repeated rows are
judged alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tripmill.llm.common import BASE, map_texts, mix, powers, saved, slices, text_bytes, word_hashes

WINDOW = 8
SYMBOLS = [ord(c) for c in "#*$%&|<>"]
MIN_WORDS, REPEAT_PERCENT = 20, 30
HALF = 0.75
SALTS = 64
# Chi-square with five degrees of freedom: the factor that makes the covariance of the nearest 75 % consistent, and
# its 0.999 quantile.
CONSISTENCY, CUTOFF = 1.412, 20.515
FLOORS = (0.05, 0.02, 0.05, 0.1, 0.1)
FALLEN = 1e-4  # a logarithm of the determinant that falls by less has settled
# Rows at which an estimate weighs half, and the spread of texts of any kind.
MIDDLE_ROWS, SPREAD_ROWS = 5, 50
USUAL = (1.0, 0.3, 0.15, 0.2, 0.2)
DIMENSIONS = len(FLOORS)
EVERYTHING = "*"
BASE_SCHEMA = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
)


def repeated_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside a run of ``WINDOW`` words that the text holds twice or more."""
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    runs = np.maximum(counts - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
    total = mix(owner.astype(np.uint64) + np.uint64(1))
    for step, factor in enumerate(powers(BASE, WINDOW + 1)[1:]):
        total = total + words[begin + step] * factor if len(begin) else total
    _, place, often = np.unique(mix(total), return_inverse=True, return_counts=True)
    starts = begin[often[place] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    return counts, covered[first[1:]] - covered[first[:-1]]


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """Per text: words, word characters, symbols, repeated lines, repeated words, lines. About a megabyte of texts
    is in work at once, as the hashing takes many times the room of its text."""
    raw, offsets = text_bytes(texts)
    rows = []
    for begin, end in slices(offsets):
        part, ends = raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        data = part.tobytes()
        for n_words, n_repeat, low, high in zip(*repeated_words(part, ends), ends, ends[1:], strict=False):
            text = data[low:high]
            lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
            points = len(text.translate(None, bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"))
            rows.append((n_words, points, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, len(lines)))
    return np.array(rows, np.int64).reshape(-1, 6)


def base_statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of every whole text; one pass, no shuffle."""
    keep = ["doc_id", "lang", "source"]
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def work(columns, texts):
        counts = [pa.array(column) for column in batch_statistics(texts).T]
        return pa.RecordBatch.from_arrays([*(columns[name] for name in keep), *counts], names=[*keep, *made])

    return map_texts(docs, keep, BASE_SCHEMA, work)


def with_vector(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = F.array(
        F.log(n.cast("double")),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4)),  # few lines say little
        F.sqrt(F.col("n_repeat_words") / n),
    )
    own = F.concat(F.lit("source "), F.to_json(F.struct("lang", "source")))
    wider = F.concat(F.lit("lang "), F.to_json(F.struct("lang")))
    return stats.withColumn("base_failed", failed).withColumn("x", vector).withColumn("own", own).withColumn("wider", wider)


def distance():
    """Squared Mahalanobis distance of ``x`` under ``middle`` and ``inverse`` (row by row)."""
    gaps = [F.col("x")[i] - F.col("middle")[i] for i in range(DIMENSIONS)]
    terms = [
        gaps[i] * gaps[j] * F.col("inverse")[i * DIMENSIONS + j] * F.lit(1.0 if i == j else 2.0)
        for i in range(DIMENSIONS)
        for j in range(i, DIMENSIONS)
    ]
    return sum(terms[1:], terms[0])


def held_against(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """Rows (group, salt, ...) with the one row of their group. A group is met in ``SALTS`` parts: the join's parts aren't
    those of a later sum by group, so that sum combines before it shuffles."""
    return rows.join(per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "salt"])


def nearest(measured: DataFrame) -> DataFrame:
    """The rows up to the distance that the nearest ``HALF`` of their group reach from their start, to a thousandth."""
    binned = measured.withColumn("bin", F.floor(F.log(F.col("distance") + 1e-6) * 1000))
    bins = binned.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("reached", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("group", "start")))
    limits = bins.filter(F.col("reached") >= HALF * F.col("all")).groupBy("group", "start").agg(F.min("bin").alias("limit"), F.first("all").alias("all"))
    limits = limits.groupBy("group").agg(F.collect_list(F.struct("start", "limit", "all")).alias("limits"))
    met = held_against(binned, limits).withColumn("own", F.filter("limits", lambda one: one["start"] == F.col("start"))[0])
    return met.filter(F.col("bin") <= F.col("own.limit")).withColumn("all", F.col("own.all"))


def covariance(n: float, sums, products) -> tuple[np.ndarray, np.ndarray]:
    middle, square = np.array(sums, float) / n, np.zeros((DIMENSIONS, DIMENSIONS))
    square[np.triu_indices(DIMENSIONS)] = np.array(products, float) / n
    return middle, square + np.triu(square, 1).T - np.outer(middle, middle)


ESTIMATE = "group string, start int, n bigint, middle array<double>, spread array<double>, inverse array<double>, logdet double, before double"


def inverted(frames):
    """Mean, covariance, its inverse and determinant of each group and start, from its sums."""
    floor = np.diag(np.square(FLOORS))
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            middle, spread = covariance(row.n, row.sums, row.products)
            spread = CONSISTENCY * spread + floor
            rows.append((row.group, row.start, row.all, middle.tolist(), spread.ravel().tolist(), np.linalg.inv(spread).ravel().tolist(), np.linalg.slogdet(spread)[1], row.before))
        yield pd.DataFrame(rows, columns=["group", "start", "n", "middle", "spread", "inverse", "logdet", "before"])


def started(frames):
    """The three starts of each group: scales alone, directions, all rows."""
    floor = np.diag(np.square(FLOORS))
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            scale = np.array(row.scale, float)
            _, direction = covariance(row.n, np.zeros(DIMENSIONS), row.signs)
            mean, whole = covariance(row.n, row.sums, row.products)
            directed = DIMENSIONS * direction * np.outer(scale, scale) + floor
            for start, (middle, spread) in enumerate([(row.middle, np.diag(scale**2)), (row.middle, directed), (mean, whole + floor)]):
                rows.append((row.group, start, row.n, list(middle), spread.ravel().tolist(), np.linalg.inv(spread).ravel().tolist(), float("inf"), float("inf")))
        yield pd.DataFrame(rows, columns=["group", "start", "n", "middle", "spread", "inverse", "logdet", "before"])


def estimates(rows: DataFrame) -> DataFrame:
    """(group, n, middle, spread, inverse) of (group, salt, x)."""
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    x = [F.col("x")[i] for i in range(DIMENSIONS)]
    halves = rows.groupBy("group").agg(F.array(*(F.percentile_approx(one, 0.5, 1000) for one in x)).alias("middle"))
    away = held_against(rows, halves).select("group", "middle", *(F.abs(x[i] - F.col("middle")[i]).alias(f"a{i}") for i in range(DIMENSIONS)))
    widths = away.groupBy("group").agg(F.first("middle").alias("middle"), *(F.percentile_approx(f"a{i}", 0.5, 1000).alias(f"a{i}") for i in range(DIMENSIONS)))
    scale = F.array(*(F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, F.lit(2.0)) + FLOORS[i] ** 2) for i in range(DIMENSIONS)))
    widths = saved(widths.select("group", "middle", scale.alias("scale")), "widths")
    away = held_against(rows, widths).select("group", "middle", "scale", "x", *((x[i] - F.col("middle")[i]).alias(f"a{i}") / F.col("scale")[i] for i in range(DIMENSIONS)))
    away = away.toDF("group", "middle", "scale", "x", *(f"u{i}" for i in range(DIMENSIONS)))
    norm = F.greatest(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, DIMENSIONS)), F.col("u0") * F.col("u0")), F.lit(1e-12))
    products = F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("products")
    signs = F.array(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}") / norm) for i, j in pairs)).alias("signs")
    sums = F.array(*(F.sum(one) for one in x)).alias("sums")
    first = away.groupBy("group").agg(F.first("middle").alias("middle"), F.first("scale").alias("scale"), F.count("*").alias("n"), sums, products, signs)
    current, steps = saved(first.mapInPandas(started, ESTIMATE), "estimate"), []
    while not current.isEmpty():
        starts = current.groupBy("group").agg(F.collect_list(F.struct("start", "middle", "inverse", "logdet")).alias("starts"))
        met = held_against(rows, starts).select("group", "salt", "x", F.explode("starts").alias("s")).select("group", "salt", "x", "s.*")
        near = nearest(met.select("group", "salt", "x", "start", "logdet", distance().alias("distance")))
        made = near.groupBy("group", "start").agg(F.count("*").alias("n"), F.first("all").alias("all"), F.first("logdet").alias("before"), sums, products)
        steps.append(saved(made.mapInPandas(inverted, ESTIMATE), "estimate"))
        current = steps[-1].filter(F.col("logdet") < F.col("before") - FALLEN)
    found = steps[0] if steps else current
    for step in steps[1:]:
        found = found.unionByName(step)
    best = found.groupBy("group").agg(F.min(F.struct("logdet", "start", "n", "middle", "spread", "inverse")).alias("best"))
    return best.select("group", "best.n", "best.middle", "best.spread", "best.inverse")


def drawn(estimate, towards):
    """(middle, covariance) of an estimate (n, middle, covariance) drawn towards another (middle, covariance)."""
    n, middle, spread = estimate
    near, wide = n / (n + MIDDLE_ROWS), n / (n + SPREAD_ROWS)
    gap = middle - towards[0]
    return near * middle + (1 - near) * towards[0], wide * spread + (1 - wide) * towards[1] + near * (1 - near) * np.outer(gap, gap)


def pooled(frames):
    """The estimate that judges each group, from those of its levels."""
    level = lambda n, middle, spread: (n, np.array(middle, float), np.array(spread, float).reshape(DIMENSIONS, DIMENSIONS))
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            whole = level(row.n2, row.middle2, row.spread2)
            judge = whole[1], np.diag(np.square(USUAL))
            for one in (whole, level(row.n1, row.middle1, row.spread1), level(row.n0, row.middle0, row.spread0)):
                judge = drawn(one, judge)
            rows.append((row.own, judge[0].tolist(), np.linalg.inv(judge[1]).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["own", "middle", "inverse"])


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its base statistics, ``base_failed``, ``distance`` (null where not measured) and ``kept``."""
    stats = saved(with_vector(base_statistics(docs)), "statistics")
    passed = stats.filter("not base_failed")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    grouped = passed.select(F.explode(F.array("own", "wider", F.lit(EVERYTHING))).alias("group"), salt, "x")
    found = saved(estimates(saved(grouped, "vectors")), "estimates")
    levels = passed.select("own", "wider").distinct().withColumn("all", F.lit(EVERYTHING))
    for k, name in enumerate(("own", "wider", "all")):
        levels = levels.join(found.select(F.col("group").alias(name), F.col("n").alias(f"n{k}"), F.col("middle").alias(f"middle{k}"), F.col("spread").alias(f"spread{k}")), name)
    judges = saved(levels.mapInPandas(pooled, "own string, middle array<double>, inverse array<double>"), "judges")
    own = stats.withColumn("salt", salt)
    met = own.join(judges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["own", "salt"], "left")
    measured = met.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return measured.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
