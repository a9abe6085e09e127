"""Gradient boosted trees as Spark jobs: binned rows, one grouped sum of gradients per level, early stop on AUC.

Features are cut into at most 256 bins once, and a narrow table (one byte per feature) is stored in blocks of rows,
a record each, so a pass moves whole arrays. A table that one task can hold is read by one task, which grows all trees
in one job. Otherwise each level of a tree is one job: tasks sum gradients and curvatures per (node, feature, bin), one
exchange adds these sums, and the best split of each (node, feature) comes back, so the driver sees a few hundred rows
per level, whatever the table holds. The sums are whole numbers, so they depend on the rows alone and not on how these
are dealt, nor on which of the two ways is taken.

The pass over the rows that finds a tree's first split also counts the validation rows in buckets of the score so
far: the AUC costs no pass of its own. Rounds end when it has not risen for ``patience`` rounds, and the trees up
to the best round stay. Sums of finished trees are stored with the rows every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, fresh_folder

BINS = 256
#: Added to each node's curvature; least curvature of a child; least gain of a split.
RIDGE, LEAST_CURVATURE, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Trees that are evaluated anew in each pass before their sum is stored.
SETTLE_ROUNDS = 4
#: Rows, with those that only measure, that one task holds and grows all trees from: width + 10 bytes each.
LOCAL_ROWS = 1 << 21
#: Buckets of the score in which validation rows are counted.
SCORE_BUCKETS = 64 * BINS
#: Tasks that add the sums of one level; there are at most some thousand of them, of 4 KB for each task before.
MERGING_TASKS = 8
#: Rows of a block, which are summed at once (the sums stay exact in double precision).
BATCH_ROWS = 1 << 14
#: Blocks that a reader of the table or an Arrow batch holds at once.
BLOCKS_AT_ONCE = 16
#: ``bins`` lie feature by feature, a byte for each row.
_ROW = "bins binary, label binary, valid binary, margin binary"
_PART = "node int, feature int, sums binary"
_SPLIT = "node int, feature int, bin int, gain double, left_g long, left_h long, g long, h long, sums binary"
_ARRAYS = {"feature": np.int32, "bin": np.int32, "value": np.float64, "gain": np.float64}
_GROWN = "feature binary, bin binary, value binary, gain binary, auc double"
NODE_SCHEMA = "tree int, node int, feature int, cut double, value double, gain double"


@dataclass
class Tree:
    """A binary tree in heap order over binned features; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after so many levels; ``bins`` has a row for each feature."""
        node = np.zeros(bins.shape[1], dtype=np.int64)
        for level in range(levels):
            node = self.step(bins, node, level)
        return node

    def step(self, bins: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """The nodes one level further down, for rows that stand in ``node`` of a level or ended above it."""
        n_rows, first, last = bins.shape[1], 2 ** level - 1, 2 ** (level + 1) - 1
        split = self.feature[first:last] >= 0
        if not split.any():
            return node
        if level == 0:
            return 1 + (bins[self.feature[0]] > self.bin[0])
        at = self.start(n_rows)[node]
        at += np.arange(n_rows)
        right = bins.ravel()[at] > self.bin[node]
        down = 2 * node + 1
        down += right
        here = self.feature >= 0
        return down if split.all() and not (self.feature[:first] < 0).any() else np.where(here[node], down, node)

    def start(self, n_rows: int) -> np.ndarray:
        """Where the bins of each node's feature begin in a block."""
        return np.maximum(self.feature, 0).astype(np.int64) * n_rows


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Borders of each feature's bins: all of its values if these are few, else quantiles of all rows."""
    levels = ", ".join(f"{i / (bins - 1):.6f}D" for i in range(bins))
    found = rows.agg(
        *[F.approx_count_distinct(c).alias(f"n_{i}") for i, c in enumerate(features)],
        *[F.expr(f"percentile_approx({c}, array({levels}), {40 * bins}) AS q_{i}") for i, c in enumerate(features)],
    ).first()
    few = [i for i in range(len(features)) if found[f"n_{i}"] <= bins // 2]
    values = rows.agg(*[F.collect_set(features[i]).alias(f"v_{i}") for i in few]).first() if few else None
    cuts = []
    for i in range(len(features)):
        known = np.unique(np.array((values[f"v_{i}"] if i in few else found[f"q_{i}"]) or [], dtype=np.float64))
        known = known[~np.isnan(known)]
        cuts.append(known[1:bins] if len(known) <= bins else known[1:][:: -(-len(known) // bins)])
    return cuts


@dataclass
class Block:
    """Binned rows; ``bins`` has a row for each feature."""

    bins: np.ndarray
    label: np.ndarray
    valid: np.ndarray
    margin: np.ndarray

    def record(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.bins.tobytes(), self.label.tobytes(), self.valid.tobytes(), self.margin.tobytes()

    def only(self, wanted: np.ndarray) -> Block:
        at = np.flatnonzero(wanted)
        return Block(np.take(self.bins, at, axis=1), self.label[at], self.valid[at], self.margin[at])

    def add(self, trees: list[Tree], depth: int) -> None:
        for tree in trees:
            self.margin += tree.value[tree.place(self.bins, depth)]


def _records(blocks: list[Block]) -> pa.RecordBatch:
    columns = zip(*[b.record() for b in blocks], strict=True)
    return pa.record_batch([pa.array(c, pa.binary()) for c in columns], names=[c.split()[0] for c in _ROW.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for bins, label, valid, margin in zip(*batch.columns, strict=True):
            yield Block(
                np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, -1), np.frombuffer(label.as_buffer(), np.bool_),
                np.frombuffer(valid.as_buffer(), np.bool_), np.frombuffer(margin.as_buffer(), np.float64).copy(),
            )


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Block] = []

        def joined() -> Block:
            return Block(
                np.concatenate([b.bins for b in waiting], axis=1), np.concatenate([b.label for b in waiting]),
                np.concatenate([b.valid for b in waiting]), np.zeros(sum(len(b.label) for b in waiting)),
            )

        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                if waiting and sum(len(b.label) for b in waiting) + batch.num_rows > BATCH_ROWS:
                    yield _records([joined()])
                    waiting.clear()
                bins = np.empty((len(cuts), batch.num_rows), dtype=np.uint8)
                for i, borders in enumerate(cuts):
                    values = batch.column(i).to_numpy(zero_copy_only=False)
                    bins[i] = np.searchsorted(borders, values, side="right")
                label, valid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "valid"))
                waiting.append(Block(bins, label, valid, np.empty(0)))
        if waiting:
            yield _records([joined()])

    return run


def _advance(width: int, trees: list[Tree], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, width):
            block.add(trees, depth)
            yield _records([block])

    return run


def probability_of(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def joint_features(n_bins: list[int]) -> list[list[int]]:
    """Features whose bins together number at most ``BINS``: they are summed as one and told apart afterwards."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for i in sorted(range(len(n_bins)), key=lambda i: -n_bins[i]):
        at = next((g for g, size in enumerate(sizes) if size * n_bins[i] <= BINS), None)
        if at is None:
            groups.append([i])
            sizes.append(n_bins[i])
        else:
            groups[at].append(i)
            sizes[at] *= n_bins[i]
    return groups


class Sums:
    """Sums of gradients and curvatures per (node, feature, bin) of one level, over blocks as they come."""

    def __init__(self, n_bins: list[int], level: int):
        self.n_bins, self.first_node, self.n_nodes = n_bins, 2 ** level - 1, 2 ** level
        self.groups = joint_features(n_bins)
        self.joint = np.zeros((2, len(self.groups), self.n_nodes * BINS), dtype=np.int64)
        self.seen = np.zeros(self.n_nodes, dtype=bool)

    def add(self, bins: np.ndarray, node: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """``node`` is where each row stands, numbered over the whole tree."""
        node = node - self.first_node
        self.seen[node] = True
        node *= BINS
        for g, features in enumerate(self.groups):
            code = bins[features[0]]
            for i in features[1:]:
                code = code * np.uint8(self.n_bins[i]) + bins[i]
            cell = node + code
            for k, values in enumerate((gradient, curvature)):
                self.joint[k, g] += np.bincount(cell, values, minlength=self.n_nodes * BINS).astype(np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(nodes with rows, their sums by feature and bin)."""
        nodes = np.flatnonzero(self.seen)
        sums = np.zeros((len(nodes), len(self.n_bins), BINS, 2), dtype=np.int64)
        for g, features in enumerate(self.groups):
            sizes = [self.n_bins[i] for i in features]
            joint = self.joint[:, g].reshape(2, self.n_nodes, BINS)[:, nodes, : int(np.prod(sizes))]
            joint = joint.reshape(2, len(nodes), *sizes)
            for place, i in enumerate(features):
                others = tuple(2 + k for k in range(len(features)) if k != place)
                sums[:, i, : self.n_bins[i]] = np.moveaxis(joint.sum(axis=others), 0, -1)
        return nodes + self.first_node, sums


def slopes(label: np.ndarray, chance: np.ndarray, weight: float, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row, as whole numbers of units."""
    scaled = np.where(label, weight, 1.0) * unit
    return np.rint((chance - label) * scaled), np.rint(chance * (1.0 - chance) * scaled)


def count_scores(counts: np.ndarray, rows: Block) -> None:
    """Adds rows to (other, positive) counts by bucket of the score."""
    bucket = np.minimum((probability_of(rows.margin) * SCORE_BUCKETS).astype(np.int64), SCORE_BUCKETS - 1)
    counts += np.bincount(2 * bucket + rows.label, minlength=2 * SCORE_BUCKETS).reshape(SCORE_BUCKETS, 2)


def _level_sums(n_bins: list[int], trees: list[Tree], depth: int, growing: Tree, level: int, weight: float, unit: float):
    """Sums per (node, feature, bin) of one task; at the first level also validation rows per score bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = Sums(n_bins, level), np.zeros((SCORE_BUCKETS, 2), dtype=np.int64)
        for block in _blocks(batches, len(n_bins)):
            block.add(trees, depth)
            if level == 0:
                count_scores(counts, block.only(block.valid))
            node = growing.place(block.bins, level)
            used = ~block.valid & (node >= sums.first_node)
            rows = block.only(used)
            sums.add(rows.bins, node[used], *slopes(rows.label, probability_of(rows.margin), weight, unit))
        nodes, values = sums.whole()
        parts = [(int(n), i, values[at, i].tobytes()) for at, n in enumerate(nodes) for i in range(len(n_bins))]
        chunks = counts.reshape(-1, BINS, 2)
        parts += [(-1, int(c), chunks[c].tobytes()) for c in np.flatnonzero(chunks.any(axis=(1, 2)))]
        if parts:
            node, feature, data = zip(*parts, strict=True)
            yield pa.record_batch(
                [pa.array(node, pa.int32()), pa.array(feature, pa.int32()), pa.array(data, pa.binary())],
                names=["node", "feature", "sums"],
            )

    return run


def best_splits(sums: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(bin, gain) of the best split of one feature in each of several nodes; bin -1 where none gains.

    Rows of bins up to the given one go left. Of equal gains the lowest bin.
    """
    total = sums.sum(axis=1)[:, None] / unit
    left = np.cumsum(sums, axis=1)[:, :-1] / unit
    right = total - left

    def worth(side):
        return side[..., 0] ** 2 / (side[..., 1] + RIDGE)

    gain = 0.5 * (worth(left) + worth(right) - worth(total))
    gain[(left[..., 1] < LEAST_CURVATURE) | (right[..., 1] < LEAST_CURVATURE)] = -np.inf
    at = gain.argmax(axis=1)
    best = gain[np.arange(len(at)), at]
    return np.where(best > LEAST_GAIN, at, -1), np.where(best > LEAST_GAIN, best, 0.0)


def _merged(unit: float):
    """Adds the tasks' sums of each (node, feature); as many are held as come to the task, each of 4 KB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple[int, int], int] = {}
        totals: list[np.ndarray] = []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, part in zip(keys, batch.column(2), strict=True):
                values = np.frombuffer(part.as_buffer(), dtype=np.int64)
                at = place.setdefault(key, len(totals))
                if at == len(totals):
                    totals.append(values.copy())
                else:
                    totals[at] += values
        if not totals:
            return
        node, feature = (np.array(column, dtype=np.int32) for column in zip(*place, strict=True))
        sums = np.stack(totals).reshape(-1, BINS, 2)
        table = split_table(node, feature, sums, unit)
        counts = pa.array(table.pop("sums"), pa.binary())
        yield pa.record_batch([*[pa.array(table[c]) for c in table], counts], names=[*table, "sums"])

    return run


def split_table(node: np.ndarray, feature: np.ndarray, sums: np.ndarray, unit: float) -> pd.DataFrame:
    """The rows of ``_SPLIT`` from the sums of each (node, feature); those of node -1, score buckets, come along."""
    bins, gain = best_splits(sums, unit)
    left = np.cumsum(sums, axis=1)[np.arange(len(sums)), bins]
    whole = sums.sum(axis=1)
    kept = pd.Series([total.tobytes() if n < 0 else None for n, total in zip(node, sums, strict=True)], dtype=object)
    columns = [
        node.astype(np.int32), feature.astype(np.int32), bins.astype(np.int32), gain, left[:, 0], left[:, 1], whole[:, 0],
        whole[:, 1], kept,
    ]
    return pd.DataFrame(dict(zip([c.split()[0] for c in _SPLIT.split(", ")], columns, strict=True)))


def bucket_auc(counts: np.ndarray) -> float | None:
    """Area under the ROC curve from (other, positive) counts by ascending score; rows of a bucket count as ties."""
    negative, positive = counts[:, 0], counts[:, 1]
    if not positive.sum() or not negative.sum():
        return None
    below = np.cumsum(negative) - negative
    wins = (positive * (below + 0.5 * negative)).sum()
    return float(wins / (positive.sum() * negative.sum()))


@dataclass
class BoostedTrees:
    """The trees up to the best round, as rows of ``NODE_SCHEMA``, with the validation AUC after each round run."""

    nodes: pd.DataFrame
    features: list[str]
    aucs: list[float] = field(default_factory=list)

    def probability(self, spark: SparkSession) -> Column:
        """Column of the positive class' probability; a value that is no number goes right at each node."""
        n_trees = int(self.nodes["tree"].max()) + 1 if len(self.nodes) else 0
        width = int(self.nodes["node"].max()) + 1 if len(self.nodes) else 1
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        feature, cut, value = np.full((n_trees, width), -1, np.int32), np.zeros((n_trees, width)), np.zeros((n_trees, width))
        for table, name in ((feature, "feature"), (cut, "cut"), (value, "value")):
            table[at] = self.nodes[name].to_numpy()
        shipped = spark.sparkContext.broadcast((feature, cut, value, (width + 1).bit_length() - 1))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            feature, cut, value, depth = shipped.value
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            flat, first, margin = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for t in range(len(feature)):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    place = feature[t][node]
                    right = ~(flat[first + np.maximum(place, 0)] < cut[t][node])
                    node = np.where(place < 0, node, 2 * node + 1 + right)
                margin += value[t][node]
            return pd.Series(probability_of(margin))

        return score(*self.features)

    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        gain = self.nodes[self.nodes["feature"] >= 0].groupby("feature")["gain"].sum()
        total = gain.sum() or 1.0
        return {name: float(gain.get(i, 0.0) / total) for i, name in enumerate(self.features)}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([*enumerate(self.features)], "place int, feature string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/features")
        spark.createDataFrame([*enumerate(self.aucs)], "round int, auc double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/aucs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        names = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        aucs = spark.read.parquet(f"{path}/aucs").orderBy("round").collect()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return BoostedTrees(nodes, [r["feature"] for r in names], [r["auc"] for r in aucs])


class _Rows:
    """The stored table of binned rows and the trees whose values its margins do not hold yet."""

    def __init__(self, rows: DataFrame, cuts: list[np.ndarray], depth: int):
        self.n_bins, self.depth, self.recent = [len(c) + 1 for c in cuts], depth, []
        # Jobs are many and small, so their plans are fixed beforehand; a record is a block of rows.
        self.spark = rows.sparkSession.newSession()
        for key, value in {
            "spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.sql.execution.arrow.maxRecordsPerBatch": BLOCKS_AT_ONCE,
            "spark.sql.parquet.columnarReaderBatchSize": BLOCKS_AT_ONCE,
        }.items():
            self.spark.conf.set(key, str(value))
        self.parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MERGING_TASKS)
        self.folder = None
        self._store(rows.mapInArrow(_binned(cuts), _ROW))

    def _store(self, rows: DataFrame) -> None:
        old, self.folder = self.folder, fresh_folder(self.spark, "boosting")
        rows.write.option("parquet.enable.dictionary", "false").parquet(self.folder)
        self.table = self.spark.read.schema(_ROW).parquet(self.folder)
        if old:
            discard(self.spark, old)

    def add(self, tree: Tree) -> None:
        self.recent.append(tree)
        if len(self.recent) == SETTLE_ROUNDS:
            self._store(self.table.mapInArrow(_advance(len(self.n_bins), self.recent, self.depth), _ROW))
            self.recent = []

    def splits(self, growing: Tree, level: int, weight: float, unit: float) -> pd.DataFrame:
        sums = _level_sums(self.n_bins, self.recent, self.depth, growing, level, weight, unit)
        parts = self.table.mapInArrow(sums, _PART)
        return parts.repartition(self.parts, "node", "feature").mapInArrow(_merged(unit), _SPLIT).toPandas()

    def boost(self, *how) -> tuple[list[Tree], list[float]]:
        return _boost(self, self.depth, *how)

    def close(self) -> None:
        discard(self.spark, self.folder)


class _FewRows(_Rows):
    """A stored table that one task reads and grows all trees from."""

    def boost(self, *how) -> tuple[list[Tree], list[float]]:
        grown = self.table.coalesce(1).mapInArrow(_boosted(self.n_bins, self.depth, how), _GROWN).collect()
        trees = [Tree(*[np.frombuffer(r[c], kind) for c, kind in _ARRAYS.items()]) for r in grown if r["feature"]]
        return trees, [r["auc"] for r in grown if r["auc"] is not None]


class _Held:
    """All rows of a table, those of training with their places in the tree that grows.

    Of two sister nodes only the one with fewer rows is summed; what their parent has besides is the other's.
    """

    def __init__(self, blocks: Iterator[Block], n_bins: list[int], depth: int):
        self.n_bins, self.depth, self.rows, self.checks = n_bins, depth, [], []
        for block in blocks:
            self.rows.append(block.only(~block.valid))
            self.checks.append(block.only(block.valid))

    def add(self, tree: Tree) -> None:
        for rows, node in zip(self.rows, self.nodes, strict=True):
            for level in range(self.level, self.depth):
                node = tree.step(rows.bins, node, level)
            rows.margin += tree.value[node]
        for rows in self.checks:
            rows.add([tree], self.depth)

    def splits(self, growing: Tree, level: int, weight: float, unit: float) -> pd.DataFrame:
        counts, first = np.zeros((SCORE_BUCKETS, 2), dtype=np.int64), 2 ** level - 1
        if level == 0:
            for rows in self.checks:
                count_scores(counts, rows)
            self.nodes = [np.zeros(len(rows.label), dtype=np.int64) for rows in self.rows]
            self.slopes = [slopes(rows.label, probability_of(rows.margin), weight, unit) for rows in self.rows]
        else:
            self.nodes = [growing.step(rows.bins, node, level - 1) for rows, node in zip(self.rows, self.nodes, strict=True)]
        self.level = level
        sizes = sum((np.bincount(node, minlength=2 * first + 1) for node in self.nodes), np.zeros(2 * first + 1, dtype=np.int64))
        summed = sizes > 0
        summed[:first] = False
        if level:
            left, right = np.arange(first, 2 * first + 1, 2), np.arange(first + 1, 2 * first + 1, 2)
            summed[np.where(sizes[left] > sizes[right], left, right)] = False
        sums = Sums(self.n_bins, level)
        for rows, node, (gradient, curvature) in zip(self.rows, self.nodes, self.slopes, strict=True):
            at = np.flatnonzero(summed[node])
            if len(at):
                sums.add(np.take(rows.bins, at, axis=1), node[at], gradient[at], curvature[at])
        found, values = sums.whole()
        dense = np.zeros((2 ** level, *values.shape[1:]), dtype=np.int64)
        dense[found - first] = values
        if level:
            rest = np.flatnonzero((sizes[first:] > 0) & ~summed[first:])
            dense[rest] = self.sums[rest // 2] - dense[rest ^ 1]
        self.sums = dense
        nodes = np.flatnonzero(sizes[first:]) + first
        values = dense[nodes - first]
        width, chunks = len(self.n_bins), counts.reshape(-1, BINS, 2)
        scored = np.flatnonzero(chunks.any(axis=(1, 2)))
        node = np.append(np.repeat(nodes, width), np.full(len(scored), -1))
        feature = np.append(np.tile(np.arange(width), len(nodes)), scored)
        whole = np.concatenate([values.reshape(-1, BINS, 2), chunks[scored]])
        return split_table(node, feature, whole, unit)


def _boosted(n_bins: list[int], depth: int, how: tuple):
    """Grows all trees from the rows of one task: a row for each tree, then one for each AUC."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(_blocks(batches, len(n_bins)), n_bins, depth)
        trees, aucs = _boost(held, depth, *how)
        rows = [{c: getattr(t, c).astype(kind).tobytes() for c, kind in _ARRAYS.items()} | {"auc": None} for t in trees]
        rows += [dict.fromkeys(_ARRAYS) | {"auc": a} for a in aucs]
        kinds = [*[(c, pa.binary()) for c in _ARRAYS], ("auc", pa.float64())]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return run


def _grow(rows: _Rows | _Held, found: pd.DataFrame, depth: int, rate: float, weight: float, unit: float) -> Tree:
    """One tree; ``found`` are the splits of its root."""
    tree = Tree.empty(depth)

    def leaf(node: int, g: int, h: int) -> None:
        tree.value[node] = -rate * (g / unit) / (h / unit + RIDGE)

    for level in range(depth):
        if level:
            found = rows.splits(tree, level, weight, unit)
        open_nodes = found[found["node"] >= 0]
        if level == 0 and len(open_nodes):
            leaf(0, *map(int, open_nodes.iloc[0][["g", "h"]]))
        best = open_nodes[open_nodes["bin"] >= 0].sort_values(["node", "gain", "feature"], ascending=[True, False, True])
        best = best.drop_duplicates("node")
        for row in best.itertuples():
            tree.feature[row.node], tree.bin[row.node], tree.gain[row.node] = row.feature, row.bin, row.gain
            leaf(2 * row.node + 1, row.left_g, row.left_h)
            leaf(2 * row.node + 2, row.g - row.left_g, row.h - row.left_h)
        if best.empty:
            break
    return tree


def _node_rows(trees: list[Tree], cuts: list[np.ndarray]) -> pd.DataFrame:
    rows = []
    for number, tree in enumerate(trees):
        reached = [0]
        while reached:
            node = reached.pop()
            feature = int(tree.feature[node])
            cut = float(cuts[feature][tree.bin[node]]) if feature >= 0 else 0.0
            rows.append((number, node, feature, cut, float(tree.value[node]), float(tree.gain[node])))
            if feature >= 0:
                reached += [2 * node + 2, 2 * node + 1]
    return pd.DataFrame(sorted(rows), columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def fit(
    rows: DataFrame, features: list[str], label: str, valid: str, rounds: int = 500, depth: int = 6, rate: float = 0.05,
    patience: int = 30,
) -> BoostedTrees:
    """Trees for a 0/1 label; rows marked ``valid`` only measure the AUC. Positives weigh others / positives.

    Null feature values count as no numbers, which lie right of every cut. Without both classes among the validation
    rows there is no AUC, and all rounds are run; when no split gains any more, rounds end. Reads ``rows`` four
    times: pass a stored table. A row without label is left out.
    """
    ready = rows.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, c in enumerate(features)],
        (F.col(label) == 1).alias("label"), F.coalesce(F.col(valid), F.lit(False)).alias("valid"),
    ).where("label is not null")
    used, positive = ~F.col("valid"), F.col("label")
    count = ready.agg(
        F.count_if(used & positive).alias("p"), F.count_if(used & ~positive).alias("n"), F.count_if("valid").alias("v")
    ).first()
    weight = count["n"] / count["p"] if count["p"] and count["n"] else 1.0
    n_rows = max(count["p"] + count["n"], 1)
    # Whole-number sums: exact in 64 bits over all rows and in double precision over one batch.
    bits = min(62 - n_rows.bit_length(), 52 - BATCH_ROWS.bit_length()) - max(int(np.ceil(np.log2(max(weight, 1.0)))), 0)
    unit = float(2 ** max(bits, 1))
    cuts = cut_points(ready.where("not valid"), [f"f{i}" for i in range(len(features))])
    few = n_rows + count["v"] <= LOCAL_ROWS
    state = (_FewRows if few else _Rows)(ready, cuts, depth)
    try:
        trees, aucs = state.boost(rate, weight, unit, rounds, patience)
    finally:
        state.close()
    return BoostedTrees(_node_rows(trees, cuts), list(features), aucs)


def _boost(
    state: _Rows | _Held, depth: int, rate: float, weight: float, unit: float, rounds: int, patience: int
) -> tuple[list[Tree], list[float]]:
    """The trees up to the best round, and the AUC after each round run."""
    trees: list[Tree] = []
    aucs: list[float] = []
    best = (-1.0, 0)
    while True:
        found = state.splits(Tree.empty(depth), 0, weight, unit)
        if trees and (auc := _auc(found)) is not None:
            aucs.append(auc)
            if auc > best[0]:
                best = (auc, len(trees))
            if len(trees) - best[1] >= patience:
                break
        if len(trees) == rounds:
            break
        tree = _grow(state, found, depth, rate, weight, unit)
        trees.append(tree)
        state.add(tree)
        if tree.feature[0] < 0:
            break
    return trees[: best[1] or len(trees)], aucs


def _auc(found: pd.DataFrame) -> float | None:
    counts = np.zeros((SCORE_BUCKETS // BINS, BINS, 2), dtype=np.int64)
    for row in found[found["node"] < 0].itertuples():
        counts[row.feature] = np.frombuffer(row.sums, dtype=np.int64).reshape(BINS, 2)
    return bucket_auc(counts.reshape(-1, 2))
