"""Near-duplicate documents by DartMinHash signatures and banded joins.

Every element (a run of five words) owns a random point process over weight and rank, drawn from its hash: in each
weight region (0, 1], (1, 2], (2, 4], ... darts arrive at exponential distances in rank, each with a place in
the region and one of ``COORDINATES`` coordinates. A set's darts are those whose place lies within the
element's weight. Each coordinate keeps its earliest dart; two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. Darts are thrown only up to the rank at which about k ln k + 2 k of them are expected, and
farther where a coordinate stayed empty, so a signature costs its elements once and few darts besides.

Documents link when the Jaccard similarity of their sets of runs is 0.8 or more; the query gives each
run the weight 1. (``weighting="count"`` weighs runs by how often they occur.) Copies of the same words are one
class before anything is joined. Then 26 bands of four coordinates: of the documents that share a band, the one with most
company is compared with all others, exactly, on the runs themselves. Documents that this leaves in
different components although they share a band are all compared in a second round, but for pairs that exact bounds
exclude. Runs are ordered by how many of these documents hold them. Similar documents share one of their first runs in that
order (the first fifth, as at least four fifths of each must be shared): pairs that share a rare one (``RARE`` documents at
most) are joined on it, and all other pairs can only share runs that are not rare, so a document with too many rare runs
meets nobody. (In both rounds pairs whose signatures agree in fewer than 60 of the 104 coordinates are left out too.) At a
similarity of 0.8 the bands miss 1.1 pairs in a million and the signatures 0.061; above it both fall fast.

Results by case: a text of one to four words has one run, all of them; null and wordless texts link with nothing; white
space apart, equal texts are one class; ties of company go to the smaller id. A document is an id with a text:
repeated rows of both are one document, of which ``keep_one`` keeps the least row; other texts of an id, and texts without
an id, are documents of their own, numbered by a hash of both from ``OWN_NUMBERS`` on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tripmill.llm.common import aside, components, map_texts, mix, saved, shingle_hashes, slices, text_bytes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 4
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
REGIONS = 40
RARE, REMEMBERED, LESS = 32, 500, 0.223
OWN_NUMBERS = 1 << 62
NEXT = mix(np.arange(1, 65, dtype=np.uint64))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def throw(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, limit: np.ndarray):
    """All darts of rank up to ``limit`` (of each owner): (owner, coordinate, rank, identity)."""
    made = []
    top = int(np.ceil(np.log2(max(1.0, float(weight.max(initial=1.0))))))
    for region in range(min(top, REGIONS) + 1):
        low, high = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0**region)
        here = np.flatnonzero(weight > low)
        seed = mix(element[here] + NEXT[region])
        rank = np.zeros(len(here))
        number = 0
        while len(here):
            number += 1
            h = mix(seed + NEXT[number % 64] + np.uint64(number))
            rank = rank - np.log(uniform(h)) / (high - low)
            inside = rank <= limit[owner[here]]
            here, seed, rank, h = here[inside], seed[inside], rank[inside], h[inside]
            other = mix(h + np.uint64(0x8CB92BA72F3D8DD7))
            landed = low + uniform(other) * (high - low) <= weight[here]
            name = mix(other + np.uint64(1))
            made.append((owner[here][landed], (name[landed] % np.uint64(COORDINATES)).astype(np.int64), rank[landed], name[landed]))
    return [np.concatenate(parts) for parts in zip(*made, strict=True)]


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """(count, COORDINATES) identities of the earliest darts; elements may repeat. Owners without elements: 0."""
    signature = np.zeros((count, COORDINATES), np.uint64)
    total = np.bincount(owner, weight, count)
    limit = np.where(total > 0, DARTS / np.maximum(total, 1e-300), 0.0)
    open_ones = total > 0
    while open_ones.any():
        use = open_ones[owner]
        who, coordinate, rank, name = throw(element[use], weight[use], owner[use], limit)
        slot = who * COORDINATES + coordinate
        best = np.full(count * COORDINATES, np.inf)
        np.minimum.at(best, slot, rank)
        earliest = rank == best[slot]
        np.maximum.at(signature.reshape(-1), slot[earliest], name[earliest])
        filled = np.isfinite(best).reshape(count, COORDINATES).sum(1)
        open_ones &= filled < COORDINATES
        signature[open_ones] = 0
        limit[open_ones] *= 2
    return signature


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Four 16-bit coordinates to a 64-bit band: the bands are the short signature too."""
    short = (signature >> np.uint64(48)).reshape(len(signature), BANDS, ROWS)
    shift = np.arange(ROWS, dtype=np.uint64) * np.uint64(16)
    return (short << shift).sum(axis=2, dtype=np.uint64).view(np.int64)


def text_digest(text: bytes) -> bytes:
    """Of the words of a text, white space apart; of the bytes of a text without words."""
    words = text.split()
    return blake2b(b" ".join(words) if words else text, digest_size=16, person=b"" if words else b"wordless").digest()


def sign_batch(texts: pa.Array, weighting: str) -> tuple[list, list]:
    """Digest, and bands, of every text; no bands for texts without words."""
    raw, offsets = text_bytes(texts)
    data = raw.tobytes()
    digests, bands = [], []
    for begin, end in slices(offsets):
        part = raw[offsets[begin] : offsets[end]]
        words, first = word_hashes(part, offsets[begin : end + 1] - offsets[begin])
        element, owner = shingle_hashes(words, first, SHINGLE)
        weight = np.ones(len(element))
        if weighting == "count" and len(element):
            order = np.lexsort((element, owner))
            element, owner = element[order], owner[order]
            new = np.ones(len(element), bool)
            new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            weight = np.diff(np.append(at, len(element))).astype(float)
            element, owner = element[at], owner[at]
        made = bands_of(signatures(element, weight, owner, end - begin))
        for i in range(begin, end):
            some = first[i - begin + 1] > first[i - begin]
            digests.append(text_digest(data[offsets[i] : offsets[i + 1]]))
            bands.append(made[i - begin].tolist() if some else None)
    return digests, bands


def sign(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """(doc_id, digest, bands) of every document; no shuffle."""

    def work(columns, texts):
        digests, bands = sign_batch(texts, weighting)
        return pa.RecordBatch.from_arrays(
            [columns["doc_id"], pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"]
        )

    return map_texts(docs, ["doc_id"], "doc_id bigint, digest binary, bands array<bigint>", work)


def runs(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    element, _ = shingle_hashes(*word_hashes(raw, np.array([0, len(raw)])), SHINGLE)
    return np.unique(element)


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / max(1, len(one) + len(two) - both)


def run_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, run): the set of runs of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = runs(text.encode()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc)), pa.array(found)], names=["doc_id", "run"])

    return texts.select("doc_id", "text").mapInArrow(each, "doc_id bigint, run bigint")


def open_pairs(mixed: DataFrame, texts: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): of the documents in ``mixed`` (key, band, doc_id, component), pairs of different components that may be similar.
    A pair is made in the first band that it shares, if its signatures agree enough."""
    rows = saved(run_rows(texts.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi")), "runs")
    often = rows.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") <= RARE)
    rare = saved(rows.join(often, "run"), "rare-runs")
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("size"))
    rares = rare.groupBy("doc_id").agg(F.count("*").alias("rares"))
    usable = F.col("size") - F.coalesce("rares", F.lit(0))
    bounds = saved(sizes.join(rares, "doc_id", "left").select("doc_id", "size", usable.alias("usable")), "bounds")
    named = mixed.select("doc_id", "component").distinct().join(bounds, "doc_id")

    order = Window.partitionBy("doc_id").orderBy("n", "run")
    first = rare.withColumn("place", F.row_number().over(order)).join(named, "doc_id")
    first = first.filter((F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1) & (F.col("n") > 1))
    size_fits = (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - 1e-9) & (F.col("ca") < F.col("cb"))
    first = saved(first.select("run", "doc_id", "component", "size"), "first-runs")
    left, right = (first.select(F.col("run").alias(f"k{s}"), F.col("doc_id").alias(s), F.col("component").alias(f"c{s}"), F.col("size").alias(f"s{s}")) for s in "ab")
    by_run = left.join(right, (F.col("ka") == F.col("kb")) & size_fits).select("a", "b")

    shared = mixed.join(bounds, "doc_id").filter(F.col("usable") >= threshold * F.col("size") - 1e-9)
    shared = saved(shared.join(signed.select("doc_id", "bands"), "doc_id"), "open-bands")
    left, right = (
        shared.select(
            F.col("key").alias(f"k{s}"), F.col("doc_id").alias(s), F.col("component").alias(f"c{s}"), F.col("size").alias(f"s{s}"),
            F.col("usable").alias(f"u{s}"), F.col("bands").alias(f"v{s}"), F.col("band").alias(f"n{s}"),
        )
        for s in "ab"
    )
    enough = F.least("ua", "ub") >= threshold / (1 + threshold) * (F.col("sa") + F.col("sb")) - 1e-9
    here = F.expr("array_position(zip_with(va, vb, (p, q) -> p = q), true) = na + 1")
    by_band = left.join(right, (F.col("ka") == F.col("kb")) & size_fits & enough & here & (same_coordinates("va", "vb") >= int((threshold - LESS) * COORDINATES))).select("a", "b")
    return by_run.unionByName(by_band).distinct()


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose sets of runs are similar enough. Each pair's texts meet in one row; a document with
    many partners is one side of an ordinary join, which adaptive execution splits."""
    texts = docs.select("doc_id", "text")
    met = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two")), "b")
        .select("a", "b", "one", "two")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            if doc not in known:
                if len(known) >= REMEMBERED:
                    known.pop(next(iter(known)))
                known[doc] = runs(text.as_py().encode())
            return known[doc]

        for batch in batches:
            ones, twos = batch.column("one"), batch.column("two")
            sides = enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            keep = [jaccard(of(a, ones[i]), of(b, twos[i])) >= threshold for i, (a, b) in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(check, "a bigint, b bigint")


def same_coordinates(one: str, two: str):
    """In how many coordinates two short signatures agree."""
    lanes = " + ".join(f"int(shiftrightunsigned(x, {16 * k}) & 65535 = 0)" for k in range(ROWS))
    return F.expr(f"aggregate(zip_with({one}, {two}, (p, q) -> p ^ q), 0, (n, x) -> n + {lanes})")


def agreement(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs whose short signatures agree in a share ``least`` of coordinates at least."""
    sides = pairs.join(signed.select(F.col("doc_id").alias("a"), F.col("bands").alias("one")), "a").join(
        signed.select(F.col("doc_id").alias("b"), F.col("bands").alias("two")), "b"
    )
    return sides.filter(same_coordinates("one", "two") >= int(least * COORDINATES)).select("a", "b")


def links(signed: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified links between class representatives (a, b), enough of them to connect all that are linked."""
    places = signed.select("doc_id", F.posexplode("bands").alias("band", "value"))
    keyed = places.select("doc_id", "band", F.xxhash64("band", "value").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = saved(keyed.join(sizes, "key"), "shared-bands")
    involved = docs.select("doc_id", "text").join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    involved = saved(involved, "involved-texts")  # all texts are shuffled once, and later only these
    company = shared.groupBy("doc_id").agg(F.sum("size").alias("company"))
    ranked = shared.join(company, "doc_id").select("key", "doc_id", "company")
    centre = ranked.groupBy("key").agg(F.max(F.struct("company", -F.col("doc_id"))).alias("top"))
    centre = centre.select("key", (-F.col("top.col2")).alias("centre"))
    first = shared.join(centre, "key").filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    first = saved(agreement(first, signed, threshold - LESS), "first-pairs")
    found = saved(verified(first, involved, threshold), "first-links")
    part = components(found)
    placed = saved(
        shared.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")),
        "placed-bands",
    )
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    mixed = saved(placed.join(split, "key"), "mixed-bands")
    rest = open_pairs(mixed, involved, signed, threshold)
    done = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = saved(agreement(rest.join(done, ["a", "b"], "left_anti"), signed, threshold - LESS), "second-pairs")
    return found.unionByName(verified(rest, involved, threshold))


def key_of(lead: str):
    """The number of a document: its id, or one of its own where it has none or is not the first text of its id."""
    own = F.lit(OWN_NUMBERS) + F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "digest").bitwiseAND(F.lit(OWN_NUMBERS - 1))
    return F.when(F.col("doc_id").isNull() | (F.col(lead).isNotNull() & (F.col("digest") != F.col(lead))), own).otherwise(F.col("doc_id"))


def conflicts(signed: DataFrame) -> DataFrame:
    """(doc_id, lead) of the ids that have several texts."""
    ends = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lead"), F.max("digest").alias("last"))
    return saved(ends.filter("lead <> last").select("doc_id", "lead"), "conflicts")


def keyed(docs: DataFrame, several: DataFrame) -> DataFrame:
    """The rows with their document's number, ``key``. Texts are digested only where the id is no number of its own."""
    shape = StructType([*docs.schema.fields, StructField("digest", BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_digest((text.as_py() or "").encode()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "digest"])

    plain = docs.filter("doc_id is not null").join(several, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
    rest = docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").join(several, "doc_id", "left_semi").select(docs.columns))
    rest = rest.mapInArrow(add, shape).join(several, "doc_id", "left").withColumn("key", key_of("lead"))
    return plain.select(*docs.columns, "key").unionByName(rest.select(*docs.columns, "key"))


def keyed_classes(docs: DataFrame, threshold: float, weighting: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, class_id, kept) of every document, (doc_id, key) of every row, and the ids of several texts."""
    first = saved(sign(docs, weighting), "signatures")
    several = conflicts(first)
    rows = first.join(several, "doc_id", "left").withColumn("key", key_of("lead"))
    signed = rows.select(F.col("key").alias("doc_id"), "digest", "bands")
    copies = saved(signed.filter("bands is not null").groupBy("digest").agg(F.min("doc_id").alias("twin")), "digests")
    named = saved(
        signed.join(copies, "digest", "left").groupBy("doc_id").agg(F.min(F.coalesce("twin", "doc_id")).alias("twin")), "twins"
    )
    heads = signed.filter("bands is not null").join(copies.select(F.col("twin").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads = saved(heads, "representatives")
    texts = keyed(docs.select("doc_id", "text"), several).select(F.col("key").alias("doc_id"), "text")
    part = saved(components(links(heads, texts, threshold)), "classes")
    joined = named.join(part.withColumnRenamed("node", "twin"), "twin", "left")
    found = joined.select(F.col("doc_id").alias("key"), F.coalesce("component", "twin").alias("class_id"))
    return found.withColumn("kept", F.col("key") == F.col("class_id")), rows.select("doc_id", "key"), several


def classes(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """(doc_id, class_id, kept) of every document: the class is named by its smallest number, an id where it holds one, and
    that document is kept."""
    found, rows, _ = keyed_classes(docs, threshold, weighting)
    own = rows.filter("doc_id is null or doc_id <> key").distinct().withColumn("own", F.lit(True))
    own = saved(own.withColumnRenamed("doc_id", "named"), "own-numbers")
    joined = found.join(own, "key", "left")
    return joined.select(F.when(F.col("own"), F.col("named")).otherwise(F.col("key")).alias("doc_id"), "class_id", "kept")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, and of every document that links with nothing; all their columns, whatever their names. Of rows
    that repeat an id with its text the least one, in the order of its columns, stays."""
    hidden, back = aside(docs, "doc_id", "text")
    found, rows, several = keyed_classes(hidden.select("doc_id", "text"), threshold, "set")
    kept = found.filter("kept").select("key")
    repeated = saved(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    # What is kept grows with the documents, so it is never broadcast: texts are shuffled once, at any size.
    chosen = keyed(hidden, several).join(kept.hint("merge"), "key", "left_semi")
    single = chosen.join(repeated, "key", "left_anti").select(hidden.columns)
    least = chosen.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*hidden.columns)).alias("row"))
    return single.unionByName(least.select("row.*")).select(*back)
