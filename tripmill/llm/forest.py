"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors of one label are split again and again by random hyperplanes at the median; rows near a hyperplane go to both
sides (``SPILL`` of the rows on either side), and ``TREES`` independent trees make up for what one tree separates.
Rows meet in leaves, are compared there exactly, and what hangs together in the leaves of all trees is united.

A label's rows are one group of every tree. A group that one task can hold (``GROUP_BYTES``) is grown to its leaves there, in
all trees at once where it is a whole label. Before that, a larger one is split in rounds: bounded samples fit the medians of
the next levels, all rows are counted in the new groups, and then dealt to them, one tree after the other, so that the copies
of one tree at a time are shuffled. Equal vectors are one class before anything is split, so a common vector is one row.

Trees only tell which rows hang together: a leaf hands on at most one edge per row, and rows that hang together already are
not compared again, so a dense group costs little more than its rows. Links are counted afterwards, once, with all rows of a
component, outside of which there are none: a component of up to ``COUNTED`` rows in one task, a larger one in blocks
around some of its rows, of which those too far apart for a link (by the triangle inequality of angles) don't meet.
The exact link counts of a dense component take time with the square of its size.

Results by case: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of another length than the partner's are not linked; rows that share an id, and rows without one, are
vectors of their own; a component is named by its smallest id, and by null where none of its rows has one, and the rows
that have the name of their component are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm.common import components, hash_share, in_groups, mix, packed, saved, tidied, unpacked
from tripmill.session import lookup

THRESHOLD = 0.98
TREES, SPILL, LEAF, SAMPLE, LEVELS, ROUNDS = 8, 0.06, 128, 2048, 4, 30
DENSE, BLOCK, TOGETHER = 0.02, 1024, 0.75
GROUP_BYTES, COUNTED = 40 << 20, 8192
PIVOTS, TOP_LEVELS, MARGIN = 64, 8, 1e-3

EDGES = "a bigint, b bigint"


class Settings(NamedTuple):
    """The values above as the driver has them, for its tasks."""

    threshold: float
    trees: int
    spill: float
    leaf: int
    levels: int
    rounds: int
    dense: float
    block: int
    together: float
    number: str


def settings(threshold: float, number: str) -> Settings:
    return Settings(threshold, TREES, SPILL, LEAF, LEVELS, ROUNDS, DENSE, BLOCK, TOGETHER, number)


# ---------------------------------------------------------------- vectors and hyperplanes


def direction(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed & ((1 << 63) - 1)).standard_normal(size)


def unit(rows) -> np.ndarray:
    """Rows at length 1, in double precision; the largest component is scaled first, so nothing overflows."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def rough(rows: np.ndarray) -> np.ndarray:
    """``unit`` in single precision: products are right to far less than ``MARGIN``."""
    made = np.empty(rows.shape, np.float32)
    for begin in range(0, len(rows), 8192):
        made[begin : begin + 8192] = unit(rows[begin : begin + 8192])
    return made


def seed_of(tree: int, level: int) -> int:
    return (tree * 1_000_003 + level * 7_919) & ((1 << 63) - 1)


def along(x: np.ndarray, tree: int, level: int) -> np.ndarray:
    """Where rows lie along the direction that a level of a tree is split by."""
    return x @ direction(seed_of(tree, level), x.shape[1]).astype(np.float32)


def bounds(values: np.ndarray, spill: float) -> tuple[float, float]:
    """The two projections between which rows go to both sides."""
    low, high = int((0.5 - spill) * (len(values) - 1)), math.ceil((0.5 + spill) * (len(values) - 1))
    ordered = np.partition(values, (low, high))
    return ordered[low], ordered[high]


# ---------------------------------------------------------------- what hangs together in a group


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest of those it hangs together with), after a and b were joined."""
    while True:
        one, two = label[a], label[b]
        if (one == two).all():
            return label
        label = label.copy()
        least = np.minimum(one, two)
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while not (label[label] == label).all():
            label = label[label]


def spread(near: np.ndarray) -> np.ndarray:
    """Each row's smallest of those it hangs together with, by a symmetric matrix of links (a row links with itself)."""
    label = near.argmax(1)
    while True:
        least = np.minimum(np.where(near, label, len(near)).min(1), label)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def join_links(label: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """The label after pairs that link, or hang together already by others, were joined: a pair's own link is looked at only while it is apart."""
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        link = (unit(raw[a[:16384]]) * unit(raw[b[:16384]])).sum(1) >= s.threshold
        label = union(label, a[:16384][link], b[:16384][link])
        a, b = a[16384:], b[16384:]
    return label


def by_pivots(label: np.ndarray, x: np.ndarray, raw: np.ndarray, rows: np.ndarray, s: Settings) -> np.ndarray:
    """Some rows are joined with all that they link with."""
    mine = x[rows]
    for pivot in range(0, len(rows), max(1, len(rows) // PIVOTS)):
        hit = rows[mine @ mine[pivot] >= s.threshold - MARGIN]
        hit = hit[label[hit] != label[rows[pivot]]]
        if len(hit):
            hit = hit[unit(raw[hit]) @ unit(raw[rows[pivot : pivot + 1]])[0] >= s.threshold]
            label = union(label, hit, np.full(len(hit), rows[pivot]))
    return label


def by_tiles(label: np.ndarray, x: np.ndarray, raw: np.ndarray, rows: np.ndarray, s: Settings) -> np.ndarray:
    """All rows of a large leaf are joined with what they link with; those that hang together already are not compared."""
    label = by_pivots(label, x, raw, rows, s)
    rows = rows[np.argsort(label[rows], kind="stable")]
    for i in range(0, len(rows), s.block):
        one = rows[i : i + s.block]
        for j in range(i, len(rows), s.block):
            two = rows[j : j + s.block]
            if (label[one] == label[one[0]]).all() and (label[two] == label[one[0]]).all():
                continue
            a, b = np.nonzero((x[one] @ x[two].T >= s.threshold - MARGIN) & (label[one][:, None] != label[two][None, :]))
            a, b = one[a], two[b]
            label = join_links(label, raw, a, b, s)
    return label


def linked(x: np.ndarray, raw: np.ndarray, rows: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of a leaf: its few pairs that may link, or rows that link with others, each with the first of those it hangs together with
    there."""
    mine = x[rows]
    at = np.flatnonzero(mine @ mine.T >= s.threshold - MARGIN)
    if len(at) == len(rows):
        return rows[:0], rows[:0]
    a, b = np.divmod(at, len(rows))
    if len(at) <= 4 * len(rows):
        return rows[a[a < b]], rows[b[a < b]]
    rows = rows[np.unique(a[a != b])]  # many: only the edges of a spanning forest
    exact = unit(raw[rows])
    exact = exact @ exact.T >= s.threshold
    np.fill_diagonal(exact, True)
    label = spread(exact)
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return rows[moved], rows[label[moved]]


def is_dense(x: np.ndarray, rows: np.ndarray, s: Settings) -> bool:
    """Whether more than ``DENSE`` of the pairs of a sample of rows link."""
    some = x[rows[:: max(1, len(rows) // 128)]]
    near = np.count_nonzero(some @ some.T >= s.threshold) - len(some)
    return near > s.dense * len(some) * (len(some) - 1)


def split(rows: np.ndarray, level: int, project, s: Settings) -> list[np.ndarray]:
    """Rows of a group in the branches of the next ``LEVELS`` levels; a branch of no more than a leaf is not split further."""
    parts = [rows]
    for step in range(level, level + s.levels):
        after = []
        for part in parts:
            if len(part) <= s.leaf:
                after.append(part)
                continue
            values = project(step)[part]
            low, high = bounds(values, s.spill)
            after += [part[values <= high], part[values >= low]]
        parts = after
    return parts


def compare(raw: np.ndarray, trees: range, level: int, s: Settings, whole: bool = False) -> np.ndarray:
    """Each row's smallest of those it hangs together with in the leaves of these trees, grown from ``level`` on; with ``whole``
    all rows are one leaf."""
    x, label = rough(raw), np.arange(len(raw))
    for tree in trees:
        columns: dict[int, np.ndarray] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def project(at: int) -> np.ndarray:
            if at not in columns:
                columns[at] = along(x, tree, at)
            return columns[at]

        todo, leaves = [(np.arange(len(raw)), level)], 0
        while todo:
            rows, at = todo.pop()
            leaf = whole or len(rows) <= s.leaf or at >= level + s.levels * s.rounds
            if (label[rows] == label[rows[0]]).all():
                continue
            if not leaf and is_dense(x, rows, s):
                leaf = len(rows) <= 2 * s.block
                if not leaf:
                    label = by_pivots(label, x, raw, rows, s)
                    if (label[rows] == label[rows[0]]).all():
                        continue
            if not leaf:
                parts = split(rows, at, project, s)
                leaf = max(map(len, parts)) > s.together * len(rows)
                if not leaf:
                    todo += [(part, at + s.levels) for part in parts]
            if leaf and len(rows) > 2 * s.block:
                label = by_tiles(label, x, raw, rows, s)
            elif leaf:
                found.append(linked(x, raw, rows, s))
            leaves += 2 - (leaf and len(rows) == len(raw))
        a, b = (np.concatenate(parts) for parts in zip(*found)) if found else (label[:0], label[:0])
        label = join_links(label, raw, a, b, s)
        if leaves <= 1:  # all rows were one leaf, as they would be in any other tree
            break
    return label


def edges_of(table: pa.Table, trees: range, level: int, s: Settings, whole: bool = False) -> pa.Table:
    label, ids = compare(unpacked(table.column("vector"), s.number), trees, level, s, whole), table.column("id").to_numpy()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[label[moved]], pa.int64())})


# ---------------------------------------------------------------- groups that no task can hold


class Top(NamedTuple):
    """How the groups that no task can hold are split: by group the level, and the bounds of ``low`` and ``high`` by node; and the
    number of blocks of those that no hyperplane divides."""

    splits: dict[int, tuple[int, np.ndarray, np.ndarray]]
    blocks: dict[int, int]


def group_of(above: int, branch: int) -> int:
    """A number for a branch of a group, or for a tree of a label."""
    return int(mix(np.array([above * 1_000_003 + branch & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def fit_group(x: np.ndarray, tree: int, level: int, levels: int, s: Settings) -> tuple[list[float], list[float]]:
    """Split bounds of the next levels below one group, from its sample: per inner node the two projections between
    which rows go to both sides. Empty bounds for a group whose rows stay together."""
    low, high = np.zeros(1 << levels, np.float32), np.zeros(1 << levels, np.float32)
    members = {1: np.arange(len(x))}
    values = [along(x, tree, level + step) for step in range(levels)]
    for node in range(1, 1 << levels):
        rows = members.pop(node)
        members[2 * node] = members[2 * node + 1] = rows
        if len(rows):
            mine = values[node.bit_length() - 1][rows]
            low[node], high[node] = bounds(mine, s.spill)
            members[2 * node], members[2 * node + 1] = rows[mine <= high[node]], rows[mine >= low[node]]
    if max(map(len, members.values())) > s.together * len(x):
        return [], []
    return low.tolist(), high.tolist()


def deal(x: np.ndarray, tree: int, start: int, top: Top) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, level, rows): the groups that rows of a label fall into in one tree."""
    todo = [(start, 0, np.arange(len(x)))]
    for group, level, rows in todo:
        if group not in top.splits:
            yield group, level, rows
            continue
        _, low, high = top.splits[group]
        levels, mine = len(low).bit_length() - 1, x[rows]
        values, at = [along(mine, tree, level + step) for step in range(levels)], {1: np.arange(len(rows))}
        for node in range(1, len(low)):
            part, place = at.pop(node), values[node.bit_length() - 1]
            at[2 * node], at[2 * node + 1] = part[place[part] <= high[node]], part[place[part] >= low[node]]
        todo += [(group_of(group, branch), level + levels, rows[part]) for branch, part in at.items() if len(part)]


def dealt(large: DataFrame, trees: range, top: Top, number: str, work, schema: str) -> DataFrame:
    """``work(batch, tree, group, level, rows)`` on the rows of each label of a batch, for every group they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families, place = np.unique(batch.column("family").to_numpy(), return_inverse=True)
            made: list[pa.RecordBatch] = []
            for k, family in enumerate(families.tolist()):
                part = batch.take(pa.array(np.flatnonzero(place == k)))
                x = rough(unpacked(part.column("vector"), number))
                for tree in trees:
                    for group, level, rows in deal(x, tree, group_of(family, tree), top):
                        made += work(part, tree, group, level, rows)
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return large.mapInArrow(run, schema)


def top_of(large: DataFrame, sizes: dict[int, int], most: dict[int, int], s: Settings) -> Top:
    """The splits above groups that a task can hold (``most`` rows, by label). Only bounds and counts of groups reach the driver,
    of which there are no more than a task's load fits into the table."""
    top, trees = Top({}, {}), range(s.trees)
    begun = {group_of(family, tree): (tree, 0, n, most[family]) for family, n in sizes.items() for tree in trees}
    for _ in range(s.rounds):
        if not begun:
            break
        levels = {group: min(TOP_LEVELS, math.ceil(math.log(n / cap) / math.log(1 / (0.5 + s.spill)))) for group, (_, _, n, cap) in begun.items()}
        share = {group: max(SAMPLE, min(cap, 256 << levels[group])) / n for group, (_, _, n, cap) in begun.items()}

        def draw(part: pa.RecordBatch, tree: int, group: int, level: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if group in share:
                some = part.take(pa.array(rows[part.column("chance").to_numpy()[rows] < share[group]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, group)), some.column("vector")], names=["grp", "vector"])

        def fit(table: pa.Table) -> pa.Table:
            group = table.column("grp")[0].as_py()
            tree, level, _, _ = begun[group]
            low, high = fit_group(rough(unpacked(table.column("vector"), s.number)), tree, level, levels[group], s)
            return pa.table({"grp": [group], "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64()))})

        def count(part: pa.RecordBatch, tree: int, group: int, level: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if group not in top.blocks:
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([tree], pa.int32()), pa.array([level], pa.int32()), part.column("family").slice(0, 1), pa.array([len(rows)])], names=["grp", "tree", "level", "family", "n"])

        drawn = dealt(large.withColumn("chance", hash_share("id")), trees, top, s.number, draw, "grp bigint, vector binary")
        fitted = {row["grp"]: row for row in in_groups(drawn, "grp", fit, "grp bigint, low array<double>, high array<double>").collect()}
        for group, (_, level, n, cap) in begun.items():
            if group in fitted and fitted[group]["low"]:
                top.splits[group] = (level, np.array(fitted[group]["low"], np.float32), np.array(fitted[group]["high"], np.float32))
            else:
                top.blocks[group] = math.ceil(2 * n / cap)
        counted = dealt(large, trees, top, s.number, count, "grp bigint, tree int, level int, family bigint, n bigint")
        counted = counted.groupBy("grp", "tree", "level", "family").agg(F.sum("n").alias("n"))
        begun = {r["grp"]: (r["tree"], r["level"], r["n"], most[r["family"]]) for r in counted.filter(F.col("n") > 1.5 * min(most.values())).collect() if r["n"] > 1.5 * most[r["family"]]}
    for group, (_, _, n, cap) in begun.items():  # what is left is compared block by block
        top.blocks[group] = math.ceil(2 * n / cap)
    return top


def in_blocks(part: pa.RecordBatch, group: int, rows: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(pair, rows): the pairs of blocks of a group that rows take part in."""
    own = mix(part.column("id").to_numpy().astype(np.uint64)[rows]) % np.uint64(blocks)
    for one in range(blocks):
        for two in range(one + (blocks > 1), blocks):
            yield group_of(group, one * blocks + two), rows[(own == one) | (own == two)]


def grow(vectors: DataFrame, s: Settings) -> DataFrame:
    """(a, b): rows of (id, family, vector) that hang together in some leaf, at most one edge per row and group of a tree."""
    sizes = vectors.groupBy("family", F.octet_length("vector").alias("width")).agg(F.count("*").alias("n")).filter(F.col("n") * F.col("width") > GROUP_BYTES).collect()
    sizes = {r["family"]: (r["n"], max(4 * s.leaf, GROUP_BYTES // r["width"])) for r in sizes}
    sizes = {family: (n, most) for family, (n, most) in sizes.items() if n > most}
    names = [F.lit(family) for family in sizes]
    small = vectors.filter(~F.col("family").isin(names)) if names else vectors
    parts = [saved(in_groups(small, "family", lambda table: edges_of(table, range(s.trees), 0, s), EDGES), "edges")]
    if sizes:
        large = vectors.filter(F.col("family").isin(names))
        top = top_of(large, {f: n for f, (n, _) in sizes.items()}, {f: most for f, (_, most) in sizes.items()}, s)

        def copy(part: pa.RecordBatch, tree: int, group: int, level: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            blocks = top.blocks.get(group, 0)
            for pair, some in in_blocks(part, group, rows, blocks) if blocks else [(group, rows)]:
                some = part.take(pa.array(some))
                extra = [pa.array(np.full(some.num_rows, pair)), pa.array(np.full(some.num_rows, -1 if blocks else level, np.int32))]
                yield pa.RecordBatch.from_arrays([*extra, some.column("id"), some.column("vector")], names=["grp", "level", "id", "vector"])

        for tree in range(s.trees):
            tidied(vectors.sparkSession)

            def meet(table: pa.Table, tree: int = tree) -> pa.Table:
                level = table.column("level")[0].as_py()
                return edges_of(table, range(tree, tree + 1), level, s, level < 0)

            copies = dealt(large, range(tree, tree + 1), top, s.number, copy, "grp bigint, level int, id bigint, vector binary")
            parts.append(saved(in_groups(copies, "grp", meet, EDGES), "edges"))
        tidied(vectors.sparkSession)
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    return edges


# ---------------------------------------------------------------- link counts


def counts_of(one: np.ndarray, two: np.ndarray, weight: np.ndarray, s: Settings) -> np.ndarray:
    """For each row of ``one`` the weight of the rows of ``two`` that it links with."""
    made = np.zeros(len(one), np.int64)
    for i in range(0, len(one), s.block):
        for j in range(0, len(two), s.block):
            near = one[i : i + s.block] @ two[j : j + s.block].T >= s.threshold
            if near.any():
                made[i : i + s.block] += (near.astype(np.float64) @ weight[j : j + s.block].astype(np.float64)).astype(np.int64)
    return made


def count_component(table: pa.Table, s: Settings) -> pa.Table:
    """(id, n): the partners of every row among its component's."""
    x, weight = unit(unpacked(table.column("vector"), s.number)), table.column("copies").to_numpy()
    return pa.table({"id": table.column("id"), "n": pa.array(counts_of(x, x, weight, s) - weight, pa.int64())})


def count_pair(table: pa.Table, s: Settings) -> pa.Table:
    """(id, n): the partners of the rows of two blocks in the other one, or of one block (side 2) in itself."""
    side = table.column("side").to_numpy()
    if side[0] == 2:
        return count_component(table, s)
    x, weight, made = unit(unpacked(table.column("vector"), s.number)), table.column("copies").to_numpy(), np.zeros(len(side), np.int64)
    for mine in (0, 1):
        made[side == mine] = counts_of(x[side == mine], x[side != mine], weight[side != mine], s)
    return pa.table({"id": table.column("id"), "n": pa.array(made, pa.int64())})


def count_large(members: DataFrame, sizes: dict[int, int], s: Settings) -> DataFrame:
    """(id, n) of components of more than ``COUNTED`` rows. Each row belongs to the nearest of some rows of its component; only these, their
    counts and the widest angles around them reach the driver, about one for ``COUNTED`` rows."""
    members = saved(members.withColumn("chance", hash_share("id")), "large-components")
    share = F.element_at(F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, 1 / min(n, COUNTED)))), F.col("component"))
    drawn: dict[int, list] = {}
    for row in members.filter(F.col("chance") < share).select("component", "vector").collect():
        drawn.setdefault(row["component"], []).append(np.frombuffer(row["vector"], s.number))
    centres = {component: unit(rows) for component, rows in drawn.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, block, angle = batch.column("component").to_numpy(), np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
            for each in np.unique(component).tolist():
                rows = np.flatnonzero(component == each)
                if each in centres:
                    cosine = unit(unpacked(batch.column("vector").take(pa.array(rows)), s.number)) @ centres[each].T
                    block[rows], angle[rows] = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(angle)], names=[*batch.schema.names, "block", "angle"])

    placed = saved(members.mapInArrow(place, "id bigint, copies bigint, component bigint, vector binary, chance double, block int, angle double"), "blocks")
    stats = placed.groupBy("component", "block").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()
    reach, cells, meets, pairs = math.acos(s.threshold) + 1e-6, {}, {}, 0
    for component in sizes:
        own = [(r["block"], math.ceil(r["n"] / COUNTED), r["angle"]) for r in stats if r["component"] == component]
        for i, (one, subs, wide) in enumerate(own):
            cells[component, one] = subs
            for two, others, width in own[i:]:
                apart = math.acos(min(1.0, max(-1.0, float(centres[component][one] @ centres[component][two])))) if component in centres else 0.0
                if one == two or apart <= wide + width + reach:
                    for p in range(subs):
                        for q in range(p if one == two else 0, others):
                            same = one == two and p == q
                            meets.setdefault((component, one, p), []).append((pairs, 2 if same else 0))
                            if not same:
                                meets.setdefault((component, two, q), []).append((pairs, 1))
                            pairs += 1

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, block, chance = (batch.column(name).to_numpy() for name in ("component", "block", "chance"))
            subs = np.array([cells[c, b] for c, b in zip(component.tolist(), block.tolist())])
            at = [(c, b, k) for c, b, k in zip(component.tolist(), block.tolist(), ((chance * (1 << 15) % 1) * subs).astype(int).tolist())]
            for cell in set(at):
                part = batch.take(pa.array([i for i, other in enumerate(at) if other == cell]))
                for pair, side in meets[cell]:
                    extra = [pa.array(np.full(part.num_rows, pair)), pa.array(np.full(part.num_rows, side, np.int32))]
                    yield pa.RecordBatch.from_arrays([*extra, part.column("id"), part.column("copies"), part.column("vector")], names=["pair", "side", "id", "copies", "vector"])

    copies = placed.mapInArrow(copy, "pair bigint, side int, id bigint, copies bigint, vector binary")
    return in_groups(copies, "pair", lambda table: count_pair(table, s), "id bigint, n bigint")


def link_counts(vectors: DataFrame, kinds: DataFrame, part: DataFrame, s: Settings) -> DataFrame:
    """(id, partners) of the rows of components (id, component): the copies of all classes that a class links with."""
    sizes = part.groupBy("component").agg(F.count("*").alias("size"))
    part = saved(part.join(sizes, "component").join(kinds.select("id", "copies"), "id"), "members")
    members = vectors.join(lookup(part), "id").select("id", "copies", "component", "vector", "size")
    small = members.filter(F.col("size") <= COUNTED).drop("size")
    counts = saved(in_groups(small, "component", lambda table: count_component(table, s), "id bigint, n bigint"), "counts")
    large = {r["component"]: r["size"] for r in part.filter(F.col("size") > COUNTED).select("component", "size").distinct().collect()}
    if large:
        more = count_large(members.filter(F.col("size") > COUNTED).drop("size"), large, s)
        counts = counts.unionByName(saved(more, "large-counts"))
    return counts.groupBy("id").agg(F.sum("n").alias("partners"))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label), one row for each of theirs."""
    vector = F.col("embedding") if dict(table.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = table.select("vec_id", "label", vector.alias("vector"))
    # neither null nor NaN is found, nothing is infinite, something is not 0; without lambdas, which take longer than the rest
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.array_contains("vector", F.lit(float("nan")).cast(rows.schema["vector"].dataType.elementType))
    usable = usable & (F.array_max("vector") < float("inf")) & (F.array_min("vector") > -float("inf")) & ((F.array_max("vector") != 0) | (F.array_min("vector") != 0))
    usable = F.coalesce(usable, F.lit(False))
    digests = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit("h2"), "label", "vector").alias("h2")]
    good = rows.filter(usable).select("vec_id", *digests, F.xxhash64("label", F.size("vector")).alias("family"), "vector")
    s = settings(threshold, "<f4" if good.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8")
    good = saved(packed(good, "vector").withColumn("id", F.monotonically_increasing_id()), "vectors")  # written, so that the numbers stay
    kinds = good.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    kinds, vectors = saved(kinds, "kinds"), good.select("id", "family", "vector")
    common = kinds.filter("copies > 1").select("h1", "h2", F.col("id").alias("first"))
    if not common.isEmpty():
        others = saved(good.select("id", "h1", "h2").join(lookup(common), ["h1", "h2"]).filter("id <> first").select("id"), "copies")
        vectors = saved(vectors.join(lookup(others), "id", "left_anti"), "distinct-vectors")
    part = components(grow(vectors, s)).select(F.col("node").alias("id"), "component")
    part = saved(part, "components")
    counts = link_counts(vectors, kinds, part, s)
    names = part.join(kinds.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("name"))
    named = part.join(names, "component").select("id", F.lit(True).alias("linked"), "name")
    judged = kinds.join(counts, "id", "left").join(named, "id", "left")
    judged = saved(judged.select(
        "h1", "h2", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")
    ), "judged")
    found = good.select("vec_id", "h1", "h2").join(judged, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
