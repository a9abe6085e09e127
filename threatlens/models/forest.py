"""Random forest without a depth limit: trees are rows of a table, and the driver holds no node.

Each tree draws its rows with replacement by a hash of (row id, tree). A table that one task can hold is sent to all
executors and every task grows whole trees, one level of all nodes at a time and to any depth. A larger table stays
where it is: nodes with more rows than a task should hold are split by sums per (node, feature, bin), the frontier of
such nodes moves down one level per pass by a join of rows and splits, and the rows of a node meet in one task once
they are few. For scoring the driver relays the trees in groups of a bounded number of nodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .boosting import BINS, cut_points

#: Rows that one task grows to the end: a few hundred bytes each.
LOCAL_ROWS = 1 << 17
#: Trees whose drawn rows are on their way at once, where rows are sent.
TREES_AT_ONCE = 20
#: Nodes that are sent to all executors at once for scoring, 16 bytes each.
GROUP_NODES = 1 << 22
_ROWS = ["id", "key", "x", "label", "weight"]
_DRAWN = ["tree", "node", *_ROWS]
_DRAWN_SCHEMA = "tree int, node string, id string, key long, x array<double>, label int, weight double"
_TREE = "n_nodes long, feature binary, cut binary, left binary, gain binary"
_TREE_SCHEMA = f"tree int, {_TREE}"
_PART_SCHEMA = f"tree int, node string, {_TREE}"
_NODE_SCHEMA = "tree int, node int, feature int, cut double, left int"
_TOP_SCHEMA = "tree int, node string, feature int, cut double, gain double"
_BIN_SUMS = "tree int, node string, feature int, sums binary"
_SPLITS = "tree int, node string, feature int, cut double, gain double, valid boolean"
#: Chances of being drawn at most 0, 1, 2, ... times: Poisson with mean 1, which drawing with replacement comes to.
_UPTO = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
#: Increment and multipliers of the SplitMix64 generator.
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn into a tree, from the hash of its id."""
    z = keys.astype(np.uint64) + np.uint64((tree + 1) * _STEP + seed * 0x632BE5AB & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[1])
    return np.searchsorted(_UPTO, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")


def gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fall of the weighted Gini impurity, times weight, for (weight of class 0, of class 1) going left."""
    right = total - left

    def purity(side):
        whole = side.sum(axis=-1)
        return np.divide((side ** 2).sum(axis=-1), whole, out=np.zeros_like(whole), where=whole > 0)

    return purity(left) + purity(right) - purity(total)


@dataclass
class Level:
    """The nodes of one level: rows by node, their number, weight of each class, and the best split so far."""

    node: np.ndarray
    size: np.ndarray
    total: np.ndarray

    def __post_init__(self) -> None:
        count = len(self.size)
        self.gain, self.feature = np.full(count, -np.inf), np.full(count, -1)
        self.low, self.high = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)

    def try_features(self, asked: np.ndarray, feature: np.ndarray, held: np.ndarray, mass: np.ndarray, min_leaf: int) -> None:
        """Tries one feature in each asked node over all cuts between two of its values; keeps what is better."""
        rows = np.flatnonzero(asked[self.node])
        node = self.node[rows]
        rank = held[rows, feature[node]].astype(np.int64)
        order = np.argsort(node * (int(rank.max()) + 1) + rank, kind="stable")
        rank, upto = rank[order], np.cumsum(mass[rows[order]], axis=0)
        place = np.flatnonzero(np.diff(node, prepend=-1))  # where the rows of each asked node begin
        which = np.cumsum(np.diff(node, prepend=node[0]) > 0)
        before = np.where(place[:, None] > 0, upto[np.maximum(place - 1, 0)], 0.0)
        n_left = np.arange(1, len(node) + 1) - place[which]
        cuts = np.flatnonzero((node[:-1] == node[1:]) & (rank[:-1] < rank[1:]))
        cuts = cuts[(n_left[cuts] >= min_leaf) & (self.size[node[cuts]] - n_left[cuts] >= min_leaf)]
        if not len(cuts):
            return
        gain = gini_gain(upto[cuts] - before[which[cuts]], self.total[node[cuts]])
        first = np.flatnonzero(np.diff(which[cuts], prepend=-1))
        most = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(cuts))))
        best = np.flatnonzero(gain == most)
        best = best[np.unique(which[cuts[best]], return_index=True)[1]]
        best = best[gain[best] > self.gain[node[cuts[best]]]]
        at, mine = cuts[best], node[cuts[best]]
        self.gain[mine], self.feature[mine], self.low[mine], self.high[mine] = gain[best], feature[mine], rank[at], rank[at + 1]


def grow(
    ranks: np.ndarray, values: list[np.ndarray], label: np.ndarray, weight: np.ndarray, min_leaf: int, n_tried: int,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A whole tree: feature (-1 at a leaf), cut (at a leaf: share of class 1), left child, and gain per feature.

    ``ranks`` are places of the rows' values among the distinct ``values`` of each feature. The right child follows the
    left one; rows below the cut go left. A node looks at features in random order until ``n_tried`` that are not
    constant there have been tried and one gave a split. It is a leaf when its rows are of one class or none splits it.
    """
    mass = np.zeros((len(ranks), 2))
    mass[np.arange(len(ranks)), label] = weight
    rows, node, gains, levels, issued = np.arange(len(ranks)), np.zeros(len(ranks), dtype=np.int64), np.zeros(len(values)), [], 1
    while len(rows):
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        own = mass[rows]
        level = Level(node, np.diff(np.append(starts, len(rows))), np.add.reduceat(own, starts, axis=0))
        divisible = (level.total.min(axis=1) > 0) & (level.size >= 2 * min_leaf)
        if divisible.any():
            held = ranks[rows]
            varies = np.minimum.reduceat(held, starts, axis=0) < np.maximum.reduceat(held, starts, axis=0)
            turn = np.where(varies & divisible[:, None], rng.random(varies.shape), 2.0)
            n_turns, turns = (turn < 2.0).sum(axis=1), np.argsort(turn, axis=1)
            for step in range(len(values)):
                asked = (step < n_turns) & ((step < n_tried) | (level.feature < 0))
                if not asked.any():
                    break
                level.try_features(asked, turns[:, step], held, own, min_leaf)
        split = np.flatnonzero(level.feature >= 0)
        cut, left = level.total[:, 1] / level.total.sum(axis=1), np.full(len(starts), -1)
        left[split] = issued + 2 * np.arange(len(split))
        issued += 2 * len(split)
        for feature in np.unique(level.feature[split]):
            mine = split[level.feature[split] == feature]
            low, high = values[feature][level.low[mine]], values[feature][level.high[mine]]
            middle = low + (high - low) / 2
            cut[mine] = np.where(low < middle, middle, high)
            gains[feature] += level.gain[mine].sum()
        levels.append((level.feature, cut, left))
        goes_on = level.feature[node] >= 0
        rows, node = rows[goes_on], node[goes_on]
        number = np.cumsum(level.feature >= 0) - 1
        child = 2 * number[node] + (ranks[rows, level.feature[node]] >= level.high[node])
        order = np.argsort(child, kind="stable")
        rows, node = rows[order], child[order]
    feature, cut, left = (np.concatenate(part) for part in zip(*levels, strict=True))
    return feature.astype(np.int16), cut, left.astype(np.int32), gains


def ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of all values among the distinct ones of their column, and these."""
    ranks, values = np.empty(x.shape, dtype=np.int32), []
    for i in range(x.shape[1]):
        distinct, ranks[:, i] = np.unique(x[:, i], return_inverse=True)
        values.append(distinct)
    return ranks, values


def _row(tree: tuple) -> list:
    return [len(tree[0]), *[part.tobytes() for part in tree]]


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _whole_trees(shipped, min_leaf: int, n_tried: int, seed: int):
    """Grows each tree of a task from the rows that were sent to all."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ranks, values, label, weight = shipped.value
        for batch in batches:
            for tree in batch["id"]:
                times = draws(keys, int(tree), seed)
                rows = np.flatnonzero(times)
                if len(rows):
                    rng = np.random.default_rng([seed, int(tree), zlib.crc32(b"r")])
                    grown = grow(ranks[rows], values, label[rows], weight[rows] * times[rows], min_leaf, n_tried, rng)
                    yield _frame([(int(tree), *_row(grown))], _TREE_SCHEMA)

    return run


def _drawn(first: int, last: int, seed: int):
    """The rows of trees from ``first`` to ``last``, each with its weight times how often it was drawn."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for tree in range(first, last):
                times = draws(keys, tree, seed)
                rows = batch[times > 0]
                if len(rows):
                    yield rows.assign(tree=tree, node="r", weight=rows["weight"] * times[times > 0])[_DRAWN]

    return run


def _grow_group(min_leaf: int, n_tried: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, root = int(key[0]), key[1]
        rows = rows.sort_values(["key", "id"])
        rng = np.random.default_rng([seed, tree, zlib.crc32(root.encode())])
        ranks, values = ranked(np.stack(rows["x"].to_numpy()).astype(np.float64))
        grown = grow(ranks, values, rows["label"].to_numpy(), rows["weight"].to_numpy(), min_leaf, n_tried, rng)
        return _frame([(tree, root, *_row(grown))], _PART_SCHEMA)

    return run


def _bin_sums(cuts: list[np.ndarray]):
    """Rows and weight of each class per (tree, node, feature, bin) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            data = batch.to_pandas()
            x = np.stack(data["x"].to_numpy()) if len(data) else np.empty((0, len(cuts)))
            bins = np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1)
            for key, places in data.groupby(["tree", "node"]).indices.items():
                sums = totals.setdefault(key, np.zeros((len(cuts), BINS, 3)))
                label, weight = data["label"].to_numpy()[places], data["weight"].to_numpy()[places]
                for i in range(len(cuts)):
                    for k, values in enumerate((weight * (label == 0), weight * (label == 1), np.ones(len(places)))):
                        sums[i, :, k] += np.bincount(bins[places, i], values, minlength=BINS)
        rows = [(t, n, i, sums[i].tobytes()) for (t, n), sums in totals.items() for i in range(len(cuts))]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "node", "feature", "sums"]
            )

    return run


def _best_bins(cuts: list[np.ndarray], min_leaf: int):
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        tree, node, feature = key
        sums = np.sum([np.frombuffer(part).reshape(BINS, 3) for part in parts["sums"]], axis=0)
        left = np.cumsum(sums, axis=0)[: len(cuts[feature])]
        total = sums.sum(axis=0)
        gain = gini_gain(left[:, :2], total[:2])
        gain[(left[:, 2] < min_leaf) | (total[2] - left[:, 2] < min_leaf)] = -np.inf
        at = int(gain.argmax()) if len(gain) else -1
        valid = at >= 0 and np.isfinite(gain[at])
        row = (tree, node, feature, float(cuts[feature][at]) if valid else 0.0, float(gain[at]) if valid else 0.0, valid)
        return pd.DataFrame([row], columns=["tree", "node", "feature", "cut", "gain", "valid"])

    return run


def split_wide_nodes(
    frontier: DataFrame, wide: DataFrame, cuts: list[np.ndarray], min_leaf: int, n_tried: int, seed: int
) -> DataFrame:
    """The best split of each node of ``wide`` among its first ``n_tried`` features, in random order, that split it."""
    rows = frontier.join(wide.select("tree", "node"), ["tree", "node"], "left_semi").select(*_DRAWN)
    sums = rows.mapInArrow(_bin_sums(cuts), _BIN_SUMS)
    found = sums.groupBy("tree", "node", "feature").applyInPandas(_best_bins(cuts, min_leaf), _SPLITS).where("valid")
    order = F.xxhash64("tree", "node", "feature", F.lit(seed))
    each = F.array_sort(F.collect_list(F.struct(order.alias("order"), "gain", "feature", "cut")))
    tried = found.groupBy("tree", "node").agg(F.slice(each, 1, n_tried).alias("tried"))
    best = F.array_max(F.transform("tried", lambda s: F.struct(s["gain"], -s["feature"], s["cut"])))
    return tried.select("tree", "node", best.alias("b")).select(
        "tree", "node", (-F.col("b.col2")).alias("feature"), F.col("b.cut").alias("cut"), F.col("b.gain").alias("gain")
    )


def _joined(key: tuple, top: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """One tree from its nodes that were split where rows lay (``top``) and the parts below them."""
    splits = {r.node: r for r in top.itertuples() if r.feature >= 0}
    ends = {r.node: r.cut for r in top.itertuples() if r.feature < 0}
    parts = {r.node: r for r in parts.itertuples()}
    gains = sum((np.frombuffer(r.gain) for r in parts.values()), np.zeros(int(key[1])))
    slots, waiting = {"r": 0}, ["r"]
    while waiting:  # both children of a node get neighbouring slots
        name = waiting.pop()
        if name in splits:
            for side in "01":
                slots[name + side] = len(slots)
                waiting.append(name + side)
    count = len(slots)
    feature, cut, left = np.full(count, -1, np.int16), np.zeros(count), np.full(count, -1, np.int32)
    below = []
    for name, at in slots.items():
        if name in splits:
            feature[at], cut[at], left[at] = splits[name].feature, splits[name].cut, slots[name + "0"]
            gains[splits[name].feature] += splits[name].gain
        elif name in ends:
            cut[at] = ends[name]
        else:
            part = parts[name]
            f, c, c_left = np.frombuffer(part.feature, np.int16), np.frombuffer(part.cut), np.frombuffer(part.left, np.int32)
            moved = np.where(c_left >= 0, c_left + count - 1, -1).astype(np.int32)
            feature[at], cut[at], left[at] = f[0], c[0], moved[0]
            below.append((f[1:], c[1:], moved[1:]))
            count += len(f) - 1
    arrays = [np.concatenate([own, *rest]) for own, *rest in zip((feature, cut, left), *below, strict=True)]
    return _frame([(int(key[0]), *_row((*arrays, gains)))], _TREE_SCHEMA)


@dataclass
class RandomForest:
    """Trees as a stored table with one row of arrays per tree."""

    trees: DataFrame
    features: list[str]

    def nodes(self) -> DataFrame:
        """(tree, node, feature, cut, left): a leaf has feature -1 and its share of class 1 as cut."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    feature = np.frombuffer(r.feature, np.int16)
                    yield pd.DataFrame({
                        "tree": r.tree, "node": np.arange(len(feature)), "feature": feature,
                        "cut": np.frombuffer(r.cut), "left": np.frombuffer(r.left, np.int32),
                    })

        return self.trees.mapInPandas(run, _NODE_SCHEMA)

    def groups(self) -> list[tuple[int, int]]:
        """First and last number of the trees that are sent together."""
        groups, size = [], 0
        for tree, n_nodes in self.trees.select("tree", "n_nodes").orderBy("tree").collect():
            if not groups or size + n_nodes > GROUP_NODES:
                groups.append((tree, tree))
                size = 0
            groups[-1] = (groups[-1][0], tree)
            size += n_nodes
        return groups

    def with_probability(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the mean over the trees of the share of class 1 in the row's leaf; one pass per group of trees."""
        groups, n_trees, out = self.groups(), self.trees.count(), df
        if not groups:
            return df.withColumn(name, F.lit(None).cast("double"))
        for number, (first, last) in enumerate(groups):
            part = self._sum(df.sparkSession, first, last)
            out = out.withColumn(name, part if number == 0 else F.col(name) + part)
            if number + 1 < len(groups):
                out = settle(out, "forest-scores")
        return out.withColumn(name, F.col(name) / F.lit(float(n_trees)))

    def _sum(self, spark: SparkSession, first: int, last: int) -> Column:
        kinds = {"feature": np.int16, "cut": np.float64, "left": np.int32}
        rows = self.trees.where(F.col("tree").between(first, last)).orderBy("tree").select(*kinds).collect()
        shipped = spark.sparkContext.broadcast([[np.frombuffer(r[c], kind) for c, kind in kinds.items()] for r in rows])

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            total = np.zeros(len(x))
            for feature, cut, left in shipped.value:
                node, moving = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
                while len(moving := moving[feature[node[moving]] >= 0]):
                    at = node[moving]
                    node[moving] = left[at] + (x[moving, feature[at]] >= cut[at])
                total += cut[node]
            return pd.Series(total)

        return score(*[_number(c) for c in self.features])

    def importances(self) -> DataFrame:
        """(feature, importance): share of a feature in a tree's fall of impurity, mean over the trees that split."""
        names = self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                gains = [np.frombuffer(g) for g in batch["gain"]]
                shares = [g / g.sum() for g in gains if g.sum() > 0]
                yield pd.DataFrame({"feature": names, "share": np.sum(shares, axis=0) if shares else 0.0, "n": len(shares)})

        sums = self.trees.mapInPandas(run, "feature string, share double, n long").groupBy("feature").agg(
            F.sum("share").alias("share"), F.sum("n").alias("n")
        )
        return sums.select("feature", F.when(F.col("n") > 0, F.col("share") / F.col("n")).otherwise(0.0).alias("importance"))


def _number(column: str) -> Column:
    """Missing values count as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def fit(
    rows: DataFrame, id_col: str, features: list[str], label: str, n_trees: int = 300, min_leaf: int = 2, seed: int = 42,
    local_rows: int = LOCAL_ROWS,
) -> RandomForest:
    """Forest for a 0/1 label, classes balanced by weight, square root of the features tried at each node.

    Leaves hold at least ``min_leaf`` different rows; depth has no limit. Null and NaN values count as 0, rows without
    label are left out, rows that repeat an id are drawn alike. In nodes of more than ``local_rows`` rows cuts lie on
    borders of 256 bins of all rows; such a node is a leaf only if no border parts its rows. Without rows the forest
    has no trees. Pass a stored table.
    """
    x = F.array(*[_number(c) for c in features])
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    ready = settle(
        rows.where(F.col(label).isNotNull()).select(
            ids.alias("id"), F.xxhash64(ids).alias("key"), x.alias("x"), F.col(label).cast("int").alias("label")
        ), "forest-rows",
    )
    counts = ready.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    n_rows, positive = counts["n"], counts["p"]
    weight = F.when(F.col("label") == 1, n_rows / (2.0 * max(positive, 1))).otherwise(
        n_rows / (2.0 * max(n_rows - positive, 1))
    )
    ready = ready.withColumn("weight", weight)
    n_tried, spark = max(1, int(np.sqrt(len(features)))), rows.sparkSession
    if n_rows <= local_rows:
        held = ready.toPandas().sort_values(["key", "id"])
        found = [spark.createDataFrame([], _TREE_SCHEMA)]
        if n_rows:
            ranks, values = ranked(np.stack(held["x"].to_numpy()).astype(np.float64))
            arrays = (held["key"].to_numpy(), ranks, values, held["label"].to_numpy(), held["weight"].to_numpy())
            numbers = spark.range(0, n_trees, 1, min(n_trees, 4 * spark.sparkContext.defaultParallelism))
            grown = numbers.mapInPandas(
                _whole_trees(spark.sparkContext.broadcast(arrays), min_leaf, n_tried, seed), _TREE_SCHEMA
            )
            found = [settle(grown, "forest-trees")]
    else:
        flat = ready.select(*[F.col("x")[i].alias(f"f{i}") for i in range(len(features))])
        cuts = cut_points(flat, [f"f{i}" for i in range(len(features))])
        found = []
        for first in range(0, n_trees, TREES_AT_ONCE):
            drawn = ready.select(*_ROWS).mapInPandas(
                _drawn(first, min(first + TREES_AT_ONCE, n_trees), seed), _DRAWN_SCHEMA
            )
            found.append(_grow_where_rows_lie(drawn, cuts, min_leaf, n_tried, seed, local_rows))
    trees = found[0]
    for some in found[1:]:
        trees = trees.unionByName(some)
    return RandomForest(trees, list(features))


def _grow_where_rows_lie(
    drawn: DataFrame, cuts: list[np.ndarray], min_leaf: int, n_tried: int, seed: int, local_rows: int
) -> DataFrame:
    """A stored table of some whole trees, whose wide nodes are split level by level over the drawn rows."""
    frontier, small, tables = settle(drawn, "forest-frontier"), [], []
    while True:
        sizes = settle(
            frontier.groupBy("tree", "node").agg(
                F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
                F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)).alias("ones"),
                F.min("label").alias("low"), F.max("label").alias("high"),
            ), "forest-sizes",
        )
        wide = sizes.where((F.col("n") > local_rows) & (F.col("low") < F.col("high")))
        splits = settle(split_wide_nodes(frontier, wide, cuts, min_leaf, n_tried, seed), "forest-splits")
        ends = sizes.where(F.col("n") > local_rows).join(splits, ["tree", "node"], "left_anti").select(
            "tree", "node", F.lit(-1).alias("feature"), (F.col("ones") / F.col("weight")).alias("cut"), F.lit(0.0).alias("gain")
        )
        tables.append(settle(splits.select("tree", "node", "feature", "cut", "gain").unionByName(ends), "forest-top"))
        few = sizes.where(F.col("n") <= local_rows).select("tree", "node")
        small.append(frontier.join(few, ["tree", "node"], "left_semi").select(*_DRAWN))
        if splits.isEmpty():
            break
        moved = frontier.join(splits.select("tree", "node", "feature", "cut"), ["tree", "node"])
        side = F.when(F.get("x", F.col("feature")) < F.col("cut"), "0").otherwise("1")
        frontier = settle(moved.withColumn("node", F.concat("node", side)).select(*_DRAWN), "forest-frontier")
    few, top = small[0], tables[0]
    for more, table in zip(small[1:], tables[1:], strict=True):
        few, top = few.unionByName(more), top.unionByName(table)
    parts = settle(
        few.groupBy("tree", "node").applyInPandas(_grow_group(min_leaf, n_tried, seed), _PART_SCHEMA), "forest-parts"
    )
    width = F.lit(len(cuts)).alias("width")
    joined = top.withColumn("width", width).groupBy("tree", "width").cogroup(
        parts.withColumn("width", width).groupBy("tree", "width")
    ).applyInPandas(_joined, _TREE_SCHEMA)
    return settle(joined, "forest-trees")
