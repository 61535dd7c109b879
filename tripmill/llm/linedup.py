"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

What is known of the lines so far lies in runs: tables of (hash, documents, holder), bucketed and sorted by hash, so a
join with a run reads it in place. Documents come in batches, those of the largest ids first. The keys of a batch are counted,
merge-anti-joined with the runs (a key that some run has already seen often enough is settled: its holder is known, and no
later count matters), and what is left becomes a run of level 0. Whenever a level has ``fanout`` runs they are compacted
into one run of the next level, so few runs are open at any time. The first batch that meets a key has its largest document;
a compacted count of ``at_least`` makes the key a repeated line, which stays in its holder only.

Lines are counted per document with map-side combine (documents of a key, then keys), so a line that a third of all
documents have is one row per task. Dropped lines are joined back by their place in the text: the widest group is the
lines of one text. Texts are shuffled once.

Results by case: a null or empty text is one empty line; a key is the stripped, ASCII-lower-cased line, compared by 128 bits of
hash; rows that share an id are one document, and what is its own is kept in all of them; rows without an id count for no
key, and lose the lines that others repeat; a document that loses all its lines has an empty text; an empty table gives
no rows; columns of any other name pass through unchanged.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.llm.common import saved
from tripmill.session import scratch_path

# What is stripped from a line, and how long and how frequent a repeated line is.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_CHARS, AT_LEAST = 40, 5
BATCHES, FANOUT = 6, 3


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def digest(prefix: str, *columns: Column) -> list[Column]:
    """128 bits as two columns, ``<prefix>1`` and ``<prefix>2``."""
    return [F.xxhash64(*columns).alias(f"{prefix}1"), F.xxhash64(F.lit(prefix), *columns).alias(f"{prefix}2")]


class LineRuns:
    """The runs, level by level. Batches must come in falling order of document ids."""

    def __init__(self, at_least: int = AT_LEAST, fanout: int = FANOUT):
        self.at_least, self.fanout = at_least, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def write(self, keys: DataFrame) -> DataFrame:
        """A run in the shared folder. The catalog needs its name only until it is opened."""
        spark = keys.sparkSession
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(spark, "line-run")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys.write.option("path", path).bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        run = spark.table(name)
        spark.sql(f"drop table {name}")
        return run

    def add(self, seen: DataFrame) -> None:
        """A batch of (doc_id, h1, h2)."""
        own = seen.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("holder"))
        for run in self.runs():
            settled = run.filter(F.col("docs") >= self.at_least).select("h1", "h2")
            own = own.join(settled, ["h1", "h2"], "left_anti")
        self.place(self.write(own), 0)

    def place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.place(self.write(merged(full)), level + 1)

    def repeated(self) -> DataFrame:
        """(h1, h2, holder) of the keys that enough documents have."""
        return merged(self.runs()).filter(F.col("docs") >= self.at_least).select("h1", "h2", "holder")


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: a key is once in each, so a merge join adds its counts. Not a union, whose bucketed columnar
    children Spark 4.1 takes for co-located although it lays their partitions end to end."""
    together = runs[0]
    for run in runs[1:]:
        other = run.withColumnsRenamed({"docs": "more_docs", "holder": "more_holder"})
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))
        joined = together.join(other, ["h1", "h2"], "full_outer")
        together = joined.select("h1", "h2", docs.alias("docs"), F.greatest("holder", "more_holder").alias("holder"))
    return together


def batch_of(docs: DataFrame, batches: int) -> Column:
    """The number of a document's batch, 0 for the largest ids; rows without an id are in the last."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    number = F.lit(batches - 1)
    for k in range(len(bounds or []) - 1, -1, -1):
        number = F.when(F.col("doc_id") > bounds[k], k).otherwise(number)
    return number.alias("batch")


def dropped_places(docs: DataFrame, least_chars: int, at_least: int, batches: int, fanout: int) -> DataFrame:
    """(t1, t2, places): where the lines to drop stand in the text of a row with that digest."""
    narrow = docs.select("doc_id", batch_of(docs, batches), *digest("t", F.col("doc_id"), F.col("text")), F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    keys = narrow.select("batch", "doc_id", "t1", "t2", "place", key_of(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    keys = keys.select("batch", "doc_id", "t1", "t2", "place", *digest("h", F.col("key")))
    path = scratch_path(docs.sparkSession, "line-keys")
    keys.write.partitionBy("batch").parquet(path)
    keys = docs.sparkSession.read.schema(keys.schema).parquet(path)
    runs = LineRuns(at_least, fanout)
    for number in range(batches):
        runs.add(keys.filter(F.col("batch") == number).select("doc_id", "h1", "h2"))
    repeated = saved(runs.repeated(), "repeated-lines")
    met = keys.join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return met.groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))


def judged(docs: DataFrame, least_chars: int = LEAST_CHARS, at_least: int = AT_LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): ``row`` has all columns of the table."""
    places = dropped_places(docs.select("doc_id", "text"), least_chars, at_least, batches, fanout)
    lined = docs.select(F.struct(*docs.columns).alias("row"), *digest("t", F.col("doc_id"), F.col("text")), text_lines(F.col("text")).alias("lines"))
    told = lined.join(places, ["t1", "t2"], "left")
    n_lines, n_dropped = F.size("lines"), F.coalesce(F.size("places"), F.lit(0))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), n_lines - 1), F.coalesce("places", F.array().cast("array<int>"))))
    kept = F.when(F.col("places").isNull(), F.array_join("lines", "\n")).when(n_dropped >= n_lines, F.lit(""))
    kept = kept.otherwise(F.array_join(F.transform(stay, lambda place: F.get("lines", place)), "\n"))
    return told.select("row", n_lines.cast("bigint").alias("n_lines"), n_dropped.cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The table with its columns, texts without their repeated lines; null texts stay null."""
    text = F.when(F.col("row")["text"].isNotNull(), F.col("kept_text")).alias("text")
    return judged(docs, **settings).select(*(text if name == "text" else F.col("row")[name].alias(name) for name in docs.columns))


def line_query(docs: DataFrame) -> DataFrame:
    found = judged(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with texts as (
  select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), places as (
  select row_id, doc_id, generate_subscripts(lines, 1) as place, unnest(lines) as line from texts
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from places
), repeated as (
  select key, max(doc_id) as holder from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select k.*, r.key is not null and k.doc_id is distinct from r.holder as dropped from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
from judged group by row_id, doc_id
"""
