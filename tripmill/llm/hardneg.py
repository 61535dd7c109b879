"""Hard negatives by a geometric near-neighbour access tree of hyperplanes.

Every inner node holds up to ``SPLITS`` split points; a row belongs to the nearest of them (a multiway hyperplane split). A
split point also stores, for each sibling subtree, the least and the largest distance from itself to the subtree's
rows. A search that only wants rows between two distances of its query (an annulus) drops each sibling whose stored range
misses, for some split point, the distances which the triangle inequality leaves open; what remains is followed, and
leaves are compared exactly. Nothing that can be in the annulus is dropped, so results are exact.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest length: all rows are then
equally long, and a score s lies at distance sqrt(|q|^2 + M^2 - 2 s) from the query. Best first rows are nearest ones, and
a window of scores is an annulus. A search takes two steps: every query goes down to one leaf, whose ``first`` best rows bound
each of its windows from below, and then the annuli run from the root.

Nodes of more rows than a task can hold (``GROUP_BYTES``) are grown in rounds: they choose split points from a bounded sample,
all of their rows are counted below them, and at last dealt to the groups at the ends, one task each, which grow the rest of
the tree there. Ranges are minima and maxima over every row. A search meets the groups that it can't rule out, with up to
``ASKED`` queries and all of a group's rows at once, and goes on through the group's own nodes and leaves in that task; each window's bound
rises with what has been found. So a tree takes few jobs, whatever its depth, and memory does not depend on the table; of tree and
rows only the top nodes, about a node for each task's load, reach the driver.

Results by case: rows with a null label, a null vector, or a null or non-finite component take no part; vectors are compared
with those of the same length only; a row without an id can be found, last of its ties, and is no anchor; rows that share an
id are rows of their own, and the anchors among them are mined each; products beyond 64 bits are held at their bounds;
an anchor with no row of its label, or no row in the window, gives no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripmill.llm.common import hash_share, in_groups, matrix, saved, tidied

# Fixed values of the contract.
SCALE, FIRST, LOW, HIGH = 256, 5, 80, 100
LEAF, SPLITS, CANDIDATES, SAMPLE, ROUNDS = 1024, 16, 48, 2048, 24
GROUP_BYTES, ASKED, AT_ONCE = 32 << 20, 1 << 14, 1024
EXACT, SINGLE = float(1 << 53), float(1 << 24)
BOUND = (1 << 63) - 1
SAME, OTHER = 1, 0

FOUND = "query bigint, tag bigint, score bigint, id bigint"
SPLIT = "node string, split int, vector array<double>, lift double, child string, low array<double>, high array<double>"
ROW = "key bigint, id bigint, label bigint, vector array<double>, lift double"
BELOW = f"grp string, kind int, key bigint, id bigint, label bigint, {SPLIT}"
LEAVES, POINTS, ABOVE = 0, 1, 2  # kinds of rows of a tree: rows in leaves, split points, ranges of a group seen from above


def numbers(table: pa.Table, name: str, missing: int = 0) -> np.ndarray:
    return table.column(name).fill_null(missing).to_numpy()


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers, exact; what exceeds 64 bits is held at the bound."""
    top = lambda x: float(np.abs(x).max(initial=0.0))
    if top(left) * top(right) * max(1, left.shape[1]) < EXACT:
        return (left @ right.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    exact = whole(left) @ whole(right).T
    return np.array([[min(max(v, -BOUND), BOUND) for v in row] for row in exact], np.int64).reshape(len(left), len(right))


def gaps(left: np.ndarray, lift_left: np.ndarray, right: np.ndarray, lift_right: np.ndarray) -> np.ndarray:
    """Distances of lifted rows."""
    inner = left @ right.T + lift_left[:, None] * lift_right[None, :]
    square = (left * left).sum(1) + lift_left**2
    other = (right * right).sum(1) + lift_right**2
    return np.sqrt(np.maximum(square[:, None] + other[None, :] - 2 * inner, 0.0))


def points(table: DataFrame) -> DataFrame:
    """The rows that take part, in whole numbers, with the label moved where the contract says so; a key per row."""
    raw = F.col("embedding").cast("array<double>")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    # floor of a double as a double: Spark's floor gives a bigint, which large components exceed
    whole = lambda v: F.when(F.abs(v * SCALE) < EXACT, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)
    used = table.select(F.col("vec_id").cast("bigint").alias("id"), label.alias("label"), raw.alias("vector"))
    used = used.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", number))
    used = used.select(F.monotonically_increasing_id().alias("key"), "id", "label", F.transform("vector", whole).alias("vector"))
    used = used.withColumn("square", F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v))
    used = saved(used, "points")  # written, so that keys stay
    most = used.agg(F.max("square")).first()[0] or 0.0
    return used.withColumn("lift", F.sqrt(F.greatest(F.lit(float(most)) - F.col("square"), F.lit(0.0)))).drop("square")


# ---------------------------------------------------------------- the tree


class Splits(NamedTuple):
    """The split points of a node; their children (none where no row is nearest), and the ranges from each child to all of them."""

    vector: np.ndarray
    lift: np.ndarray
    child: list[str | None]
    low: np.ndarray
    high: np.ndarray


class Tree(NamedTuple):
    """The split points above the groups, as (node, split, vector, lift, child, low, high); the nodes that no hyperplane divides and no
    task holds, with the number of groups they are cut into; and the groups' rows and split points (``BELOW``)."""

    top: list[dict]
    cut: dict[str, int]
    below: DataFrame


def choose(rows: np.ndarray, lift: np.ndarray) -> list[int]:
    """Split points of a group: of some distinct rows of its sample the first, then always the row farthest from those
    chosen; fewer where the sample has fewer distinct rows, and none where it has one."""
    _, distinct = np.unique(rows, axis=0, return_index=True)
    drawn = np.sort(np.random.default_rng(len(distinct)).permutation(np.sort(distinct))[:CANDIDATES])
    rows, lift = rows[drawn], lift[drawn]
    chosen, nearest = [0], np.full(len(rows), np.inf)
    while len(chosen) < SPLITS:
        last = chosen[-1:]
        nearest = np.minimum(nearest, gaps(rows, lift, rows[last], lift[last])[:, 0])
        nearest[(rows == rows[last]).all(1)] = 0.0
        farthest = int(nearest.argmax())
        if nearest[farthest] <= 0:
            break
        chosen.append(farthest)
    return drawn[chosen].tolist() if len(chosen) > 1 else []


def deal(vector: np.ndarray, lift: np.ndarray, top: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[str, np.ndarray]]:
    """(node, rows): where equally long rows end below the top nodes."""
    todo = [(str(vector.shape[1]), np.arange(len(vector)))]
    for node, rows in todo:
        if node not in top:
            yield node, rows
            continue
        near = gaps(vector[rows], lift[rows], *top[node]).argmin(1)
        todo += [(f"{node}.{k}", rows[near == k]) for k in np.unique(near)]


def dealt(rows: DataFrame, top: dict[str, tuple[np.ndarray, np.ndarray]], work, schema: str) -> DataFrame:
    """``work(batch, node, rows)`` on the rows of a batch, for every node they end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, made = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False), []
            for size in np.unique(sizes):
                part = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == size)))
                made += [work(part, node, some) for node, some in deal(matrix(part, "vector"), numbers(part, "lift"), top)]
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def above_groups(rows: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], dict[str, int]]:
    """Split points (vectors, lifts) by node, down to nodes that a task can hold; and the others' numbers of groups."""
    top: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    cut: dict[str, int] = {}
    holds = lambda node: max(1, GROUP_BYTES // (8 * max(1, int(node.split(".")[0]))))
    size = F.size("vector")
    counts = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).filter(F.col("n") * F.greatest("size", F.lit(1)) * 8 > GROUP_BYTES).collect()
    large = {str(r["size"]): r["n"] for r in counts if r["n"] > holds(str(r["size"]))}
    for _ in range(ROUNDS):
        if not large:
            break

        def draw(part: pa.Table, node: str, some: np.ndarray) -> pa.Table:
            some = some[numbers(part, "chance")[some] < SAMPLE / large[node]] if node in large else some[:0]
            return part.select(["key", "vector", "lift"]).take(pa.array(some)).add_column(0, "node", pa.array([node] * len(some), pa.string()))

        def pick(sample: pa.Table) -> pa.Table:
            sample = sample.sort_by("key")
            chosen = choose(matrix(sample, "vector"), numbers(sample, "lift"))
            return sample.select(["node", "vector", "lift"]).take(pa.array(chosen, pa.int64()))

        def count(part: pa.Table, node: str, some: np.ndarray) -> pa.Table:
            new = node.rpartition(".")[0] in large
            return pa.table({"node": pa.array([node] * new, pa.string()), "n": pa.array([len(some)] * new, pa.int64())})

        drawn = dealt(rows.withColumn("chance", hash_share("key")), top, draw, "node string, key bigint, vector array<double>, lift double")
        found: dict[str, list] = {}
        for row in in_groups(drawn, "node", pick, "node string, vector array<double>, lift double").collect():
            found.setdefault(row["node"], []).append(row)
        for node, n in large.items():
            if node in found:
                top[node] = (np.array([r["vector"] for r in found[node]], np.float64).reshape(len(found[node]), -1), np.array([r["lift"] for r in found[node]]))
            else:
                cut[node] = -(-n // holds(node))
        counted = dealt(rows, top, count, "node string, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
        large = {r["node"]: r["n"] for r in counted.collect() if r["n"] > holds(r["node"])}
    cut |= {node: -(-n // holds(node)) for node, n in large.items()}
    return top, cut


def grow_group(rows: pa.Table, leaf: int, top: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The rows of a group with their leaves, its split points with their subtrees, and the ranges of distances from every split point to
    that subtree; and the group's ranges as its nodes above see them."""
    rows = rows.sort_by("key")
    group, vector, lift = rows.column("grp")[0].as_py(), matrix(rows, "vector"), numbers(rows, "lift")
    root, _, part = group.partition("#")
    made: dict[str, list] = {name: [] for name in ("kind", "node", "split", "vector", "lift", "child", "low", "high")}
    place, names = np.empty(len(vector), np.int64), []

    def add(*values) -> None:
        for name, value in zip(made, values, strict=True):
            made[name].append(value)

    todo = [(root, np.arange(len(vector)))]
    for node, some in todo:
        drawn = some if len(some) <= SAMPLE else np.sort(np.random.default_rng(len(some)).permutation(some)[:SAMPLE])
        chosen = drawn[choose(vector[drawn], lift[drawn])] if len(some) > leaf and not part and node.count(".") < ROUNDS else []
        if not len(chosen):
            place[some] = len(names)
            names.append(node)
            continue
        far = gaps(vector[some], lift[some], vector[chosen], lift[chosen])
        near = far.argmin(1)
        for k, point in enumerate(chosen):
            inside = near == k
            there = bool(inside.any())
            add(POINTS, node, k, vector[point], lift[point], f"{node}.{k}" if there else None, far[inside].min(0) if there else None, far[inside].max(0) if there else None)
            if there:
                todo.append((f"{node}.{k}", some[inside]))
    child = root
    while child.rpartition(".")[0] in top:
        node, _, k = child.rpartition(".")
        far = gaps(vector, lift, *top[node])
        add(ABOVE, node, int(k), None, None, child, far.min(0), far.max(0))
        child = node
    some, types = len(made["kind"]), {"split": pa.int32(), "vector": pa.list_(pa.float64()), "lift": pa.float64(), "child": pa.string(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}
    whole = rows.select(["key", "id", "label", "vector", "lift"])
    leaves = {"grp": pa.array([group] * len(rows), pa.string()), "kind": pa.array(np.full(len(rows), LEAVES, np.int32)), **{name: whole.column(name) for name in ("key", "id", "label")}}
    leaves |= {"node": pa.array(names, pa.string()).take(pa.array(place)), "split": pa.nulls(len(rows), pa.int32()), "vector": whole.column("vector"), "lift": whole.column("lift")}
    leaves |= {name: pa.nulls(len(rows), types[name]) for name in ("child", "low", "high")}
    others = {"grp": pa.array([group] * some, pa.string()), "kind": pa.array(made["kind"], pa.int32()), **{name: pa.nulls(some, pa.int64()) for name in ("key", "id", "label")}}
    others |= {"node": pa.array(made["node"], pa.string()), **{name: pa.array(made[name], kind) for name, kind in types.items()}}
    return pa.concat_tables([pa.table(leaves).cast(pa.table(others).schema), pa.table(others)])


def plant(rows: DataFrame, leaf: int = LEAF) -> Tree:
    top, cut = above_groups(rows)

    def copy(part: pa.Table, node: str, some: np.ndarray) -> pa.Table:
        own = (numbers(part, "chance")[some] * cut.get(node, 1)).astype(int).tolist()
        names = pa.array([f"{node}#{k}" if node in cut else node for k in own], pa.string())
        return part.select(["key", "id", "label", "vector", "lift"]).take(pa.array(some)).add_column(0, "grp", names)

    placed = dealt(rows.withColumn("chance", hash_share("key")), top, copy, f"grp string, {ROW}")
    below = saved(in_groups(placed, "grp", lambda table: grow_group(table, leaf, top), BELOW), "tree")
    ranges: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in below.filter(F.col("kind") == ABOVE).select("child", "low", "high").collect() if top else []:
        low, high = ranges.get(row["child"], (np.inf, -np.inf))
        ranges[row["child"]] = (np.minimum(low, row["low"]), np.maximum(high, row["high"]))
    made = []
    for node, (vector, lift) in top.items():
        for k in range(len(lift)):
            child = f"{node}.{k}"
            low, high = (x.tolist() for x in ranges[child]) if child in ranges else (None, None)
            made.append({"node": node, "split": k, "vector": vector[k].tolist(), "lift": float(lift[k]), "child": child if child in ranges else None, "low": low, "high": high})
    return Tree(made, cut, below)


def grow(rows: DataFrame, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """The tree level by level (node, split, vector, lift, child, low, high), and its rows with their leaf ``node``."""
    tree = plant(rows, leaf)
    top = rows.sparkSession.createDataFrame(tree.top, SPLIT)
    points = tree.below.filter(F.col("kind") == POINTS).select(*top.columns).unionByName(top)
    level = F.size(F.split("node", "[.]"))
    deepest = points.agg(F.max(level)).first()[0] or 0
    return [points.filter(level == k + 1) for k in range(deepest)], tree.below.filter(F.col("kind") == LEAVES).select("key", "id", "label", "vector", "lift", "node", "grp")


# ---------------------------------------------------------------- the search


class Asked(NamedTuple):
    """Queries, with the least and largest score that any of their windows takes."""

    vector: np.ndarray
    low: np.ndarray
    high: np.ndarray


def split_points(rows: list[dict]) -> dict[str, Splits]:
    nodes: dict[str, list[dict]] = {}
    for row in sorted(rows, key=lambda row: row["split"]):
        nodes.setdefault(row["node"], []).append(row)
    found = {}
    for node, own in nodes.items():
        blank = [np.nan] * len(own)
        low, high = (np.array([row[name] or blank for row in own], np.float64) for name in ("low", "high"))
        found[node] = Splits(np.array([row["vector"] for row in own], np.float64).reshape(len(own), -1), np.array([row["lift"] for row in own]), [row["child"] for row in own], low, high)
    return found


def follow(asked: Asked, some: np.ndarray, splits: Splits, nearest: bool) -> np.ndarray:
    """Which subtrees queries go on to: the one of the nearest split point, or all whose ranges meet the annulus of a score
    from ``low`` to ``high``."""
    vector, there = asked.vector[some], np.array([child is not None for child in splits.child])
    length, centre = (vector * vector).sum(1), (splits.vector * splits.vector).sum(1) + splits.lift**2
    far = np.sqrt(np.maximum(length[:, None] + centre[None, :] - 2 * vector @ splits.vector.T, 0.0))
    keep = np.zeros(far.shape, bool)
    if nearest:
        keep[np.arange(len(far)), np.where(there, far, np.inf).argmin(1)] = True
        return keep
    reach = length + centre.max()
    distance = lambda score: np.sqrt(np.maximum(reach - 2 * score.astype(np.float64), 0.0))
    inner, outer = distance(asked.high[some]), np.where(asked.low[some] <= -BOUND, np.inf, distance(asked.low[some]))
    slack = 1e-6 * np.sqrt(reach)[:, None]
    least = np.maximum(far - outer[:, None], inner[:, None] - far) - slack
    most = far + outer[:, None] + slack
    for child in np.flatnonzero(there):
        keep[:, child] = ((splits.high[child][None, :] >= least) & (splits.low[child][None, :] <= most)).all(1)
    return keep


def walk(asked: Asked, root: str, tree: dict[str, Splits], nearest: bool) -> Iterator[tuple[str, np.ndarray]]:
    """(node, queries): where queries get to below the nodes of ``tree``."""
    todo = [(root, np.arange(len(asked.vector)))]
    for node, some in todo:
        if node not in tree:
            yield node, some
            continue
        keep = follow(asked, some, tree[node], nearest)
        todo += [(child, some[keep[:, k]]) for k, child in enumerate(tree[node].child) if child is not None and keep[:, k].any()]


def windows_of(queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every query: the query's row, the tag, and the least and largest score."""
    windows = queries.column("windows").combine_chunks()
    flat, owner = windows.flatten(), np.repeat(np.arange(len(windows)), windows.value_lengths().to_numpy(zero_copy_only=False))
    return owner, *(flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("tag", "low", "high"))


def asked_of(queries: pa.Table) -> Asked:
    owner, _, least, most = windows_of(queries)
    low, high = np.full(queries.num_rows, BOUND), np.full(queries.num_rows, -BOUND)
    np.minimum.at(low, owner, least)
    np.maximum.at(high, owner, most)
    return Asked(matrix(queries, "vector"), low, high)


def descended(queries: DataFrame, top: list[dict], nearest: bool, cut: dict[str, int]) -> DataFrame:
    """The queries for each node below ``top`` that they have to look into, with its name as ``grp``. ``top`` is sent to every task."""
    tree = split_points(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == size)))
                for node, some in walk(asked_of(part), str(size), tree, nearest):
                    for name in [f"{node}#{k}" for k in range(cut[node])] if node in cut else [node]:
                        yield from part.take(pa.array(some)).append_column("grp", pa.array([name] * len(some), pa.string())).to_batches()

    shape = ", ".join(f"{name} {kind}" for name, kind in queries.dtypes)
    return queries.mapInArrow(run, f"{shape}, grp string")


def descend(queries: DataFrame, levels: list[DataFrame], nearest: bool) -> DataFrame:
    """(key, node): the nodes below these levels that every query has to look into."""
    return descended(queries, [row.asDict() for level in levels for row in level.collect()], nearest, {}).select("key", F.col("grp").alias("node"))


class Best:
    """The ``first`` rows of every window, by score and id, of those seen so far; a window's least score rises with them."""

    def __init__(self, queries: pa.Table, first: int):
        self.first = first
        self.owner, self.tag, self.low, self.high = windows_of(queries)
        self.count = np.bincount(self.owner, minlength=queries.num_rows)
        self.begin = np.cumsum(self.count) - self.count
        self.kept = [np.zeros(0, np.int64)] * 4  # window, score, id, whether there is no id
        self.more: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def floor(self) -> np.ndarray:
        low = np.full(len(self.count), BOUND)
        np.minimum.at(low, self.owner, self.low)
        return low

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> bool:
        """Whether the least scores may have risen."""
        count = self.count[query]
        pair = np.repeat(np.arange(len(query)), count)
        window = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + self.begin[query[pair]]
        fits = (score[pair] >= self.low[window]) & (score[pair] <= self.high[window])
        window, pair = window[fits], pair[fits]
        self.more.append((window, score[pair], ids[pair], missing[pair]))
        self.waiting += len(window)
        if self.waiting < max(1 << 16, 4 * self.first * len(self.low)):
            return False
        self.settle()
        return True

    def settle(self) -> None:
        window, score, ids, missing = (np.concatenate([old, *new]) for old, *new in zip(self.kept, *self.more))
        order = np.lexsort((ids, missing, -score, window))
        window = window[order]
        starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])[: len(window)])
        rank = np.arange(len(window)) - np.repeat(starts, np.diff([*starts, len(window)]))
        last = order[rank == self.first - 1]
        order = order[rank < self.first]
        self.low[window[rank == self.first - 1]] = score[last]
        self.kept = [window[rank < self.first], score[order], ids[order], missing[order]]
        self.more, self.waiting = [], 0

    def table(self, keys: np.ndarray) -> pa.Table:
        self.settle()
        window, score, ids, missing = self.kept
        return pa.table({
            "query": pa.array(keys[self.owner[window]], pa.int64()), "tag": pa.array(self.tag[window], pa.int64()),
            "score": pa.array(score, pa.int64()), "id": pa.array(ids, pa.int64(), mask=missing.astype(bool)),
        })


def look(queries: pa.Table, rows: pa.Table, first: int, wanted: int) -> pa.Table:
    """Exact scores of queries with the rows of a group, in the leaves that their annuli meet, the nearest leaf before the others:
    the ``first`` of every window, by score and id."""
    best = Best(queries, first)
    if not queries.num_rows or not rows.num_rows:
        return best.table(np.zeros(0, np.int64))
    kind = numbers(rows, "kind")
    points, rows = rows.take(pa.array(np.flatnonzero(kind == POINTS))), rows.take(pa.array(np.flatnonzero(kind == LEAVES)))
    tree = split_points(points.select(["node", "split", "vector", "lift", "child", "low", "high"]).to_pylist())
    coded = rows.column("node").combine_chunks().dictionary_encode()
    place, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    ordered = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[ordered], np.arange(len(names) + 1))
    leaf = {name: ordered[ends[k] : ends[k + 1]] for k, name in enumerate(names)}
    root = rows.column("grp")[0].as_py().partition("#")[0]
    key, label, ids = numbers(rows, "key"), numbers(rows, "label"), numbers(rows, "id")
    missing = rows.column("id").is_null().to_numpy().astype(np.int64)
    asked_label, itself = numbers(queries, "label"), numbers(queries, "row", -1)
    left, right = matrix(queries, "vector"), matrix(rows, "vector")
    top = float(np.abs(left).max(initial=0.0)) * float(np.abs(right).max(initial=0.0)) * max(1, left.shape[1])
    number, most = (np.float32, SINGLE) if top < SINGLE else (np.float64, EXACT)  # whole numbers whose sums are exact
    asked, exact = asked_of(queries), top < EXACT
    if exact:
        left, right = left.astype(number), right.astype(number)

    def scan(some: np.ndarray, own: np.ndarray) -> None:
        for i in range(0, len(some), 4 * AT_ONCE):
            for j in range(0, len(own), 2 * AT_ONCE):
                q, r = some[i : i + 4 * AT_ONCE], own[j : j + 2 * AT_ONCE]
                score = left[q] @ right[r].T if exact else products(left[q], right[r])
                floor = np.clip(best.floor()[q], -most, most).astype(number) if exact else best.floor()[q]
                at = np.flatnonzero(score >= floor[:, None])
                a, b = np.divmod(at, len(r))
                fits = ((asked_label[q[a]] == label[r[b]]) == (wanted == SAME)) & (itself[q[a]] != key[r[b]])
                a, b, score = q[a[fits]], r[b[fits]], score.ravel()[at[fits]].astype(np.int64)
                best.add(a, score, ids[b], missing[b])

    def see(some: np.ndarray, own: np.ndarray) -> None:
        if wanted == SAME:
            for each in np.intersect1d(asked_label[some], label[own]):
                scan(some[asked_label[some] == each], own[label[own] == each])
        else:
            scan(some, own)

    done = {}
    for node, some in walk(asked, root, tree, True) if tree else []:
        see(some, leaf[node])
        done[node] = some
    best.settle()
    for node, some in walk(asked._replace(low=best.floor()), root, tree, False):
        if node in done:
            some = np.setdiff1d(some, done[node])
        see(some, leaf[node])
    return best.table(numbers(queries, "key"))


def best_of(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` rows of every (query, tag), ranked by score and id."""
    order = Window.partitionBy("query", "tag").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


def visit(queries: DataFrame, parts: int, tree: Tree, nearest: bool, first: int, wanted: int) -> DataFrame:
    """The best rows of every window in the groups of the nearest split points, or in all that its annulus meets."""
    asked = descended(queries, tree.top, nearest, tree.cut).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    rows = tree.below.filter(F.col("kind") != ABOVE).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    see = lambda q, r: look(q, r, first, wanted)
    return best_of(asked.groupBy("grp", "part").cogroup(rows.groupBy("grp", "part")).applyInArrow(see, FOUND), first)


def search(queries: DataFrame, tree: Tree, first: int, wanted: int) -> DataFrame:
    """(query, tag, score, id, rank): of every window the ``first`` rows of the same (or of another) label as the query. A query
    is (key, row, label, vector, windows), ``row`` the key of the row that is itself, a window (tag, low, high) in scores."""
    queries = saved(queries, "queries")
    parts = max(1, -(-queries.count() // ASKED))
    if tree.top:
        early = saved(visit(queries, parts, tree, True, first, wanted), "early")
        full = early.filter(F.col("rank") == first).select(F.col("query").alias("key"), "tag", "score")
        known = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("least"))
        raised = F.transform(
            "windows", lambda w: F.struct(w["tag"].alias("tag"), F.greatest(w["low"], F.coalesce(F.try_element_at("least", w["tag"]), w["low"])).alias("low"), w["high"].alias("high"))
        )
        queries = saved(queries.join(known, "key", "left").withColumn("windows", raised).drop("least"), "bounded-queries")
    tidied(queries.sparkSession)
    return visit(queries, parts, tree, False, first, wanted)


def window_of(tag: Column, low: Column, high: Column) -> Column:
    return F.struct(tag.cast("bigint").alias("tag"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def mined(table: DataFrame, anchors: Column | None = None, first: int = FIRST, low: int = LOW, high: int = HIGH, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchors``: which ids are anchors; negatives
    score from ``low`` to ``high`` hundredths of the positive."""
    rows = points(table)
    tree = plant(rows, leaf)
    chosen = F.coalesce(anchors if anchors is not None else F.col("id") % 100 == 0, F.lit(False))
    anchor = saved(rows.filter(chosen).select("key", F.col("key").alias("row"), F.col("id").alias("anchor_id"), "label", "vector"), "anchors")
    widest = F.array(window_of(F.lit(0), F.lit(-BOUND), F.lit(BOUND)))
    positives = search(anchor.select("key", "row", "label", "vector", widest.alias("windows")), tree, first, SAME)
    positives = saved(positives.select("query", F.col("rank").cast("bigint").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scaled = F.col("positive_score").cast("decimal(20,0)")
    floor = F.ceil(scaled * low / 100).cast("bigint")  # the least whole score of the window
    top = F.floor(scaled * high / 100).cast("bigint")
    windows = positives.groupBy(F.col("query").alias("key")).agg(F.collect_list(window_of(F.col("tag"), floor, top)).alias("windows"))
    negatives = search(anchor.select("key", "row", "label", "vector").join(windows, "key"), tree, first, OTHER)
    paired = negatives.select("query", "tag", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    paired = paired.join(positives, ["query", "tag"]).join(anchor.select(F.col("key").alias("query"), "anchor_id"), "query")
    return paired.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mining_query(embeddings: DataFrame) -> DataFrame:
    return mined(embeddings.select("vec_id", "embedding", "label"))


ORACLE_SQL = r"""
with used as (
  select row_number() over () as key, vec_id as id,
    case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.key as anchor, a.id as anchor_id, a.label = r.label as same, r.id,
    cast(list_inner_product(a.vector, r.vector) as bigint) as score
  from used a join used r on a.key <> r.key and len(a.vector) = len(r.vector) where a.id % 100 = 0
), positives as (
  select anchor, anchor_id, id as positive_id, score as positive_score,
    row_number() over (partition by anchor order by score desc, id) as place
  from scored where same qualify place <= 5
), negatives as (
  select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor, p.place order by s.score desc, s.id) as rank
  from positives p join scored s on p.anchor = s.anchor and not s.same
    and 100 * s.score between 80 * p.positive_score and 100 * p.positive_score
  qualify rank <= 5
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives
"""
