"""What the operators of this subpackage share: tables, cut lineage, words, samples, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tripmill.session import scratch_path

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BYTES_AT_ONCE = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: the frame as a table written to the shared scratch folder."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(df: DataFrame, *keep: str) -> tuple[DataFrame, list[Column]]:
    """The frame with all columns but ``keep`` under names of our own, so that none meets a working column, and the columns
    that bring it back."""
    names = {name: name if name in keep else f"aside_{i}" for i, name in enumerate(df.columns)}
    return df.select(*(F.col(f"`{name}`").alias(own) for name, own in names.items())), [F.col(own).alias(name) for name, own in names.items()]


def residue(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 where there is no id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) that depends on the row's key only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(df: DataFrame, by: str, key: str, cap: int) -> tuple[DataFrame, dict]:
    """About ``cap`` rows of every value of ``by`` (all, where there are fewer), chosen by a hash of
    ``key``, and the row count of each value. For training classifiers only. One row per class
    value reaches the driver."""
    counts = {row[by]: row["count"] for row in df.groupBy(by).count().collect()}
    chosen = F.lit(False)
    for value, count in sorted(counts.items()):
        chosen = F.when(F.col(by) == value, hash_share(key) < min(1.0, cap / count)).otherwise(chosen)
    return df.filter(chosen), counts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch of texts, and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BYTES_AT_ONCE`` bytes, one text at least."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES_AT_ONCE, "right")) - 1)
        yield begin, end
        begin = end


def by_the_megabyte(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``BYTES_AT_ONCE`` bytes of ``column`` at a time, one row at least; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for begin, end in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
        yield batch.slice(begin, end - begin)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a batch, in order, and the number of each text's first word."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACES[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    starts[begins] = solid[begins]  # texts lie end to end
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), first
    number = np.cumsum(starts) - 1
    place = np.arange(len(raw)) - at[np.maximum(number, 0)]
    place[~solid] = 0
    terms = BYTE_VALUES[raw] * powers(BASE, int(place.max()) + 1)[place]
    terms[~solid] = 0
    return mix(np.add.reduceat(terms, at)), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and which text each belongs to. A text of fewer words
    has one shingle, all of them; a text without words has none."""
    counts = np.diff(first)
    length = np.minimum(counts, size)
    runs = np.where(counts > 0, counts - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
    total = np.zeros(len(owner), np.uint64)
    for step, factor in enumerate(powers(BASE, size + 1)[1:]):
        inside = step < length[owner]
        total += np.where(inside, words[np.minimum(begin + step, len(words) - 1)] * factor, np.uint64(0)) if len(words) else total
    return mix(total), owner


def map_texts(df: DataFrame, keep: list[str], schema: str, work) -> DataFrame:
    """``work(columns, texts)`` over about a megabyte of texts at once; ``columns`` are the kept ones as Arrow arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_the_megabyte(batch):
                yield work({name: part.column(name) for name in keep}, part.column("text"))

    return df.select(*keep, "text").mapInArrow(run, schema)


def filter_texts(df: DataFrame, passes) -> DataFrame:
    """The rows for whose texts ``passes`` (an Arrow array of texts to a boolean array) holds, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_the_megabyte(batch):
                yield part.filter(pa.array(passes(part.column("text")), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def packed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with an array of floats or doubles as its bytes, which pass between Spark and Python as they are."""
    width = 4 if df.schema[name].dataType.elementType.simpleString() == "float" else 8
    schema = StructType([StructField(f.name, BinaryType() if f.name == name else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = batch.schema.get_field_index(name), batch.column(name)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]) * width
            made = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([made if k == at else other for k, other in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def unpacked(column: pa.Array | pa.ChunkedArray, number: str) -> np.ndarray:
    """A column of equally long packed arrays as rows of a matrix of ``number``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(number).reshape(len(column), -1)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, of batches that are sorted by it."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values, begin = batch.column(key).to_numpy(zero_copy_only=False), 0
        for end in [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]:
            if held and values[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last, begin = values[begin], end
    if held:
        yield pa.Table.from_batches(held)


def in_groups(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each value of ``key``, which is never null. Groups stream through sorted partitions, so that one of
    a few rows costs no more than they do; a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.Table] = []
        for table in grouped(batches, key):
            made.append(work(table))
            if sum(x.num_rows for x in made) >= 10_000 or len(made) >= 1_000:
                yield from pa.concat_tables(made).combine_chunks().to_batches(10_000)
                made = []
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches(10_000)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def tidied(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and broadcasts of steps that are over. It learns of them only when the driver collects
    its garbage, which a driver that has little to do puts off while their files pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): each linked node with the smallest
    node it can reach (node, component).

    Alternates the two star operations: every node hands its larger neighbours, then its smaller ones, to
    the smallest it knows, until nothing moves. Each is a grouped minimum with map-side combine
    and a join that adaptive execution splits where a node is hot; no adjacency list is gathered.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = saved(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 24)), F.lit(0))).first()

    before = state(stars)
    while True:
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(
                F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
            )).alias("e"))
            .select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        stars = saved(small, "stars")
        after = state(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
