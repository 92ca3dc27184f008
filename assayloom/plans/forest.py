"""Feature importance of a forest of regression trees, grown on Spark without keeping the trees.

Every feature is cut into at most ``BINS`` bins, and a tree draws its rows with Poisson(1) weights. Nodes
with more rows than one task should hold are split by histograms that all tasks count together, one job
for each level. What then hangs below them is shuffled by tree and node, and every such group grows its
subtree to the end, a level at a time. So a row passes each level of each tree once, and neither the driver nor a
task ever holds more than a group. Draws depend on the seed, the tree, the node and the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.ordered import even_cuts
from assayloom.operators.selection import vector_values_at_ranks
from assayloom.session import stored

BINS = 32
#: Bytes of binned features that one group may hold, and cells of the histograms in work at a time.
GROUP_BYTES, CELLS = 1 << 23, 1 << 18
#: Bytes of histograms that a task counts in one job.
JOB_BYTES = 1 << 26
#: A split must lower the squared error by this share of the node's own.
LEAST_GAIN = 1e-12


# --- bins --------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count or column.flatten().null_count:
        raise ValueError("features must not be null")
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes.min() != width or sizes.max() != width):
        raise ValueError(f"{width} names for {sizes[sizes != width][0]} features")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("features must be finite numbers")
    return flat.reshape(-1, width) + 0.0


def _few_values(width: int):
    """(pos, value) of positions with at most BINS values in the task; others give a null."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {p: np.zeros(0) for p in range(width)}
        many: list[int] = []
        for batch in batches:
            made = _matrix(batch.column(0), width)
            for pos in list(held):
                held[pos] = np.union1d(held[pos], made[:, pos])
                if len(held[pos]) > BINS:
                    many.append(pos)
                    del held[pos]
        pos = [p for p, own in held.items() for _ in own] + many
        value = [float(x) for own in held.values() for x in own] + [None] * len(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos, pa.int32()), pa.array(value, pa.float64())], ["pos", "value"])

    return values


def feature_cuts(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """Rising cuts of every position: a value's bin is the number of cuts below it. Positions with at most BINS
    values have a bin for each; others bins of equally many rows, and one for the least value."""
    few = vectors.select("v").mapInArrow(_few_values(width), "pos int, value double").groupBy("pos").agg(
        F.collect_set("value").alias("values"), F.bool_or(F.col("value").isNull()).alias("many"))
    own = {r["pos"]: sorted(r["values"]) for r in few.collect()
           if not r["many"] and len(r["values"]) <= BINS}
    cuts = {p: np.array(values[:-1]) for p, values in own.items()}
    if len(cuts) < width:
        ranked: dict[int, set] = {}
        for row in vector_values_at_ranks(vectors, "v", even_cuts(BINS - 1, 0)).select("pos", "value").collect():
            ranked.setdefault(row["pos"], set()).add(row["value"])
        cuts = {p: np.array(sorted(values)) for p, values in ranked.items()} | cuts
    return [cuts.get(p, np.zeros(0)) for p in range(width)]


def _binned(cuts: list[np.ndarray]):
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _matrix(batch.column(0), len(cuts))
            out = np.empty(made.shape, np.uint8)
            for pos, own in enumerate(cuts):
                out[:, pos] = np.searchsorted(own, made[:, pos], side="left")
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in out], pa.binary()), batch.column(1), batch.column(2)],
                ["b", "y", "row"])

    return bins


# --- draws -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, n + 1)) for n in range(16)])


def poisson_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, a function of seed, tree and row."""
    salt = _mixed(np.array([(seed << 20) + tree + 1], np.uint64))
    unit = (_mixed(_mixed(rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ salt)
            >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_POISSON, unit, side="right").astype(float)


def _subset(rng, nodes: int, width: int, k: int) -> np.ndarray:
    """k different positions for each node."""
    if k == width:
        return np.tile(np.arange(width), (nodes, 1))
    return rng.random((nodes, width), np.float32).argpartition(k - 1, axis=1)[:, :k]


# --- nodes that one group can hold --------------------------------------------------------------


def _best_splits(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best slot and bin of each node, and how much they lower the squared error. ``w`` and ``s`` hold weights and
    sums of the label by node, slot and bin."""
    wl, sl = w.cumsum(2)[:, :, :-1], s.cumsum(2)[:, :, :-1]
    total, label = w[:, 0].sum(1)[:, None, None], s[:, 0].sum(1)[:, None, None]
    wr = total - wl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sl**2 / wl + (label - sl) ** 2 / wr - label**2 / total
    gain[(wl <= 0) | (wr <= 0)] = -np.inf
    flat = gain.reshape(len(w), -1)
    best = flat.argmax(1)
    return best // wl.shape[2], best % wl.shape[2], flat[np.arange(len(w)), best]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, depth: int, rng) -> np.ndarray:
    """Squared error that each position takes away in a tree over these rows, grown ``depth`` levels."""
    width, gains = bins.shape[1], np.zeros(bins.shape[1])
    rows, sizes = np.arange(len(y)), np.array([len(y)])
    per_chunk, slots = max(1, CELLS // (k * BINS)), np.arange(k)
    for _ in range(depth):
        next_rows, next_sizes = [], []
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            # As many nodes as fit the histogram, and not many more rows than it has cells.
            begin = ends[first] - sizes[first]
            last = max(first + 1, min(first + per_chunk, np.searchsorted(ends, begin + CELLS // k)))
            own, count = rows[begin:ends[last - 1]], last - first
            node = np.repeat(np.arange(count), sizes[first:last])
            first = last
            weight = w[own]
            total = np.bincount(node, weight, count)
            label = y[own] - (np.bincount(node, weight * y[own], count) / total)[node]
            error = np.bincount(node, weight * label**2, count)
            chosen = _subset(rng, count, width, k)
            seen = bins[own[:, None], chosen[node]]
            cell = ((node[:, None] * k + slots) * BINS + seen).ravel()
            shape = (count, k, BINS)
            slot, cut, gain = _best_splits(
                np.bincount(cell, np.repeat(weight, k), count * k * BINS).reshape(shape),
                np.bincount(cell, np.repeat(weight * label, k), count * k * BINS).reshape(shape))
            split = gain > LEAST_GAIN * error
            np.add.at(gains, chosen[split, slot[split]], gain[split])
            right = seen[np.arange(len(own)), slot[node]] > cut[node]
            child = node * 2 + right
            many = np.bincount(child, minlength=2 * count)
            # A child is split further if its labels differ.
            low, high = np.full(2 * count, np.inf), np.full(2 * count, -np.inf)
            order = np.argsort(child, kind="stable")
            held = np.flatnonzero(many)
            starts = (np.cumsum(many) - many)[held]
            low[held] = np.minimum.reduceat(y[own][order], starts)
            high[held] = np.maximum.reduceat(y[own][order], starts)
            goes = np.repeat(split, 2) & (low < high)
            next_rows.append(own[order][goes[child[order]]])
            next_sizes.append(many[goes])
        rows, sizes = np.concatenate(next_rows), np.concatenate(next_sizes)
        if not len(sizes):
            break
    return gains


# --- nodes that all tasks split together --------------------------------------------------------


@dataclass
class _Tree:
    """The nodes near the root: a position and cut, or -1, and the number of the left child; the right one follows."""

    position: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])

    def places(self, bins: np.ndarray) -> np.ndarray:
        position, cut, left = np.array(self.position), np.array(self.cut), np.array(self.left)
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(max(self.depth)):
            inner = position[at] >= 0
            below = left[at] + (bins[every, position[at]] > cut[at])
            at = np.where(inner, below, at)
        return at

    def split(self, node: int, position: int, cut: int) -> tuple[int, int]:
        self.position[node], self.cut[node], self.left[node] = position, cut, len(self.left)
        for column, value in ((self.position, -1), (self.cut, 0), (self.left, 0), (self.depth, self.depth[node] + 1)):
            column += [value, value]
        return self.left[node], self.left[node] + 1


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, y, row = (batch.column(name) for name in ("b", "y", "row"))
    joined = b"".join(b.to_pylist())
    return (np.frombuffer(joined, np.uint8).reshape(-1, width), y.to_numpy(zero_copy_only=False),
            row.to_numpy(zero_copy_only=False))


def _counted(trees: dict[int, _Tree], wanted: dict[int, dict[int, np.ndarray]], width: int, k: int, seed: int):
    """A task's histograms of the wanted nodes, one row for each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(t, n): np.zeros((2, k * BINS)) for t, nodes in wanted.items() for n in nodes}
        for batch in batches:
            bins, y, row = _read(batch, width)
            for tree, nodes in wanted.items():
                weight, place = poisson_weights(row, tree, seed), trees[tree].places(bins)
                for node, chosen in nodes.items():
                    own = np.flatnonzero((place == node) & (weight > 0))
                    cell = (np.arange(k) * BINS + bins[own[:, None], chosen]).ravel()
                    sums[tree, node][0] += np.bincount(cell, np.repeat(weight[own], k), k * BINS)
                    sums[tree, node][1] += np.bincount(cell, np.repeat(weight[own] * y[own], k), k * BINS)
        for (tree, node), own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([own.tobytes()])],
                ["tree", "node", "sums"])

    return count


def _split_of(k: int):
    def best(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("sums").to_pylist())
        w, s = np.sum([np.frombuffer(p).reshape(2, 1, k, BINS) for p in parts], axis=0)
        slot, cut, gain = _best_splits(w, s)
        left = w[0, slot[0], : cut[0] + 1].sum()
        if not gain[0] > LEAST_GAIN * s[0, 0].sum() ** 2 / w[0, 0].sum():  # rounding, not a split
            gain[0] = 0.0
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "node": table.column("node").slice(0, 1),
            "slot": pa.array(slot.astype(np.int32)), "cut": pa.array(cut.astype(np.int32)), "gain": pa.array(gain),
            "left": pa.array([left]), "right": pa.array([w[0, 0].sum() - left]),
        })

    return best


def _grow_top(
    rows: DataFrame, trees: dict[int, _Tree], gains: np.ndarray, n: int, group_rows: int, k: int,
    max_depth: int, seed: int,
) -> dict[int, dict[int, int]]:
    """Splits nodes of more than ``group_rows`` rows, in place; by tree the nodes left, and their depths."""
    width, below = gains.shape[1], {t: {} for t in trees}
    open_nodes = [(t, 0) for t in trees]
    if n <= group_rows:
        return {t: {0: 0} for t in trees}
    per_job = max(1, JOB_BYTES // (2 * 8 * k * BINS))
    while open_nodes:
        job, open_nodes = open_nodes[:per_job], open_nodes[per_job:]
        wanted: dict[int, dict[int, np.ndarray]] = {}
        for tree, node in job:
            rng = np.random.default_rng([seed, tree, node])
            wanted.setdefault(tree, {})[node] = _subset(rng, 1, width, k)[0]
        found = rows.mapInArrow(
            _counted(trees, wanted, width, k, seed), "tree int, node int, sums binary"
        ).groupBy("tree", "node").applyInArrow(
            _split_of(k), "tree int, node int, slot int, cut int, gain double, left double, right double")
        for row in found.collect():
            tree, node = row["tree"], row["node"]
            if not row["gain"] > 0:
                continue
            position = int(wanted[tree][node][row["slot"]])
            gains[tree, position] += row["gain"]
            for child, weight in zip(trees[tree].split(node, position, row["cut"]), (row["left"], row["right"])):
                depth = trees[tree].depth[child]
                if depth < max_depth and weight > group_rows:
                    open_nodes.append((tree, child))
                elif depth < max_depth:
                    below[tree][child] = depth
    return below


def _dealt(trees: dict[int, _Tree], below: dict[int, dict[int, int]], width: int, seed: int):
    """The drawn rows of every node that is left, as one block for each tree, node and batch."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y, row = _read(batch, width)
            for tree, nodes in below.items():
                weight, place = poisson_weights(row, tree, seed), trees[tree].places(bins)
                parts = [(node, np.flatnonzero((place == node) & (weight > 0))) for node in nodes]
                parts = [(node, own) for node, own in parts if len(own)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([tree] * len(parts), pa.int32()), pa.array([n for n, _ in parts], pa.int32()),
                    pa.array([row[own].tobytes() for _, own in parts], pa.binary()),
                    pa.array([bins[own].tobytes() for _, own in parts], pa.binary()),
                    pa.array([y[own].tobytes() for _, own in parts], pa.binary()),
                    pa.array([weight[own].astype(np.uint8).tobytes() for _, own in parts], pa.binary()),
                ], ["tree", "node", "row", "b", "y", "w"])

    return deal


def _grown(below: dict[int, dict[int, int]], width: int, k: int, max_depth: int, seed: int):
    def subtree(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        joined = {c: b"".join(table.column(c).to_pylist()) for c in ("row", "b", "y", "w")}
        order = np.argsort(np.frombuffer(joined["row"], np.int64))
        gains = grow(
            np.frombuffer(joined["b"], np.uint8).reshape(-1, width)[order], np.frombuffer(joined["y"])[order],
            np.frombuffer(joined["w"], np.uint8)[order].astype(float), k, max_depth - below[tree][node],
            np.random.default_rng([seed, tree, node, 1]))
        held = np.flatnonzero(gains)
        return pa.table({"tree": pa.array(np.full(len(held), tree, np.int32)),
                         "pos": pa.array(held.astype(np.int32)), "gain": pa.array(gains[held])})

    return subtree


def forest_importances(
    rows: DataFrame, width: int, trees: int, max_depth: int, seed: int, group_rows: int | None = None,
) -> list[float]:
    """Importance of each position of ``v`` (array of doubles) for ``y``; they add up to 1.

    A split looks at a third of the positions (all, if there is one tree) and takes the best one. A tree's importances
    are the squared error that its splits by a position take away, over that of all of its splits; the forest's are
    their mean.
    ``group_rows`` is the largest node that one group grows (else as many rows as fit GROUP_BYTES).
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows are numbered once, and the numbers stored, so every pass draws the same ones.
    dealt = rows.select("v", "y").repartition(parts).withColumn("row", F.monotonically_increasing_id())
    vectors = stored(dealt, "vectors")
    n, mean, bad = vectors.agg(F.count("*"), F.avg("y"), F.count_if(F.isnan("y"))).first()
    if not n or bad:
        raise ValueError("a forest needs rows" if not n else "labels must be numbers")
    made = vectors.mapInArrow(_binned(feature_cuts(vectors, width)), "b binary, y double, row bigint")
    binned = stored(made.withColumn("y", F.col("y") - F.lit(mean)), "binned")
    k = width if trees == 1 else -(-width // 3)
    group_rows = group_rows or max(1, GROUP_BYTES // width)
    gains, top = np.zeros((trees, width)), {t: _Tree() for t in range(trees)}
    below = _grow_top(binned, top, gains, n, group_rows, k, max_depth, seed)
    blocks = binned.mapInArrow(
        _dealt(top, below, width, seed), "tree int, node int, row binary, b binary, y binary, w binary")
    grown = blocks.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(
        _grown(below, width, k, max_depth, seed), "tree int, pos int, gain double")
    # One number for each tree and position, whatever the rows.
    for row in grown.groupBy("tree", "pos").agg(F.sort_array(F.collect_list("gain")).alias("gains")).collect():
        gains[row["tree"], row["pos"]] += sum(row["gains"])
    totals = gains.sum(1)
    shares = gains[totals > 0] / totals[totals > 0, None]
    return (shares.mean(0) if len(shares) else np.zeros(width)).tolist()
