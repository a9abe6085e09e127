"""Isolation Forest (Liu, Ting, Zhou 2008) as Spark jobs.

Training draws a seeded sample per tree by hashing row ids and builds the trees in parallel, one
small group of at most a few hundred rows per tree. The forest is a table of nodes whose size depends
only on tree count and sample size, so it is shipped to the executors as a broadcast variable.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import round_even
from ..operators.ordered import exact_quantiles
from ..session import settle
from .scaler import as_dict, fit_scaler, scaled

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"
OVERSAMPLE = 2


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def build_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, left, right, path); a leaf points to itself."""
    nodes: list[tuple] = []
    waiting = [(0, points, 0)]
    issued = 1
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes.append((node, 0, 0.0, node, node, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        if cut >= high[feature]:  # rounding between two neighbouring numbers
            cut = float(low[feature])
        goes_left = rows[:, feature] <= cut
        left, right = issued, issued + 1
        issued += 2
        nodes.append((node, feature, cut, left, right, 0.0))
        waiting.append((left, rows[goes_left], depth + 1))
        waiting.append((right, rows[~goes_left], depth + 1))
    return nodes


def tree_samples(
    df: DataFrame, id_col: str, features: list[str], n_rows: int, n_trees: int, sample_size: int, seed: int
) -> DataFrame:
    """(tree, h, features): about twice the wanted sample per tree, chosen by hashes of (id, tree).

    A row falls into each tree by the same chance. One draw gives the number of its trees, and only the few rows that
    fall into any draw which: those whose hash with the row is least. What a row draws depends on its id and on the
    chance alone, at every table size.
    """
    chance = min(1.0, sample_size * OVERSAMPLE / max(n_rows, 1))
    base = df.select(F.col(id_col).cast("string").alias("id"), *features)
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    upto = np.cumsum([comb(n_trees, k) * chance ** k * (1.0 - chance) ** (n_trees - k) for k in range(n_trees)])
    n_drawn = F.size(F.filter(F.array(*map(F.lit, upto.tolist())), lambda border: border <= u))
    drawn = base.where(u >= F.lit(float(upto[0]))).withColumn("n_drawn", n_drawn)
    numbers = F.sequence(F.lit(0), F.lit(n_trees - 1))
    # The hash in the upper bits, the tree in the lower ones: numbers sort faster than structs. Most rows draw one.
    marked = F.transform(numbers, lambda t: F.shiftleft(F.shiftright(F.xxhash64("id", t, F.lit(seed + 1)), 20), 20) + t)
    several = F.transform(F.slice(F.sort_array(marked), 1, F.col("n_drawn")), lambda h: F.pmod(h, F.lit(1 << 20)).cast("int"))
    single = F.array(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n_trees)).cast("int"))
    trees = F.when(F.col("n_drawn") == 1, single).otherwise(several)
    return drawn.withColumn("tree", F.explode(trees)).drop("n_drawn").withColumn(
        "h", F.xxhash64("tree", "id", F.lit(seed + 2))
    )


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    features: list[str]
    scale: dict[str, tuple[float, float]]
    sample_size: int

    def raw_score(self, spark: SparkSession) -> Column:
        """Column of raw scores in [-1, 0); lower is more anomalous."""
        n_trees = int(self.nodes["tree"].max()) + 1
        width = int(self.nodes["node"].max()) + 1
        shape = (n_trees, width)
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        tables = {}
        for name, kind in (("feature", np.intp), ("cut", np.float64), ("left", np.intp), ("right", np.intp), ("path", np.float64)):
            table = np.zeros(shape, dtype=kind)
            table[at] = self.nodes[name].to_numpy()
            tables[name] = table
        # Left and right child of a node side by side.
        tables["child"] = np.stack([tables.pop("left"), tables.pop("right")], axis=2).reshape(n_trees, 2 * width)
        depth = max(1, int(np.ceil(np.log2(max(self.sample_size, 2)))))
        norm = average_path(self.sample_size) or 1.0
        shipped = spark.sparkContext.broadcast((tables, depth, norm))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            tables, depth, norm = shipped.value
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
            total, node = np.zeros(len(x)), np.zeros(len(x), dtype=np.intp)
            at, value, cut = np.empty_like(node), np.empty(len(x)), np.empty(len(x))
            for t in range(len(tables["feature"])):
                node[:] = 0
                for _ in range(depth):
                    np.take(tables["feature"][t], node, out=at, mode="clip")
                    at += first
                    np.take(flat, at, out=value, mode="clip")
                    np.take(tables["cut"][t], node, out=cut, mode="clip")
                    node *= 2
                    node += ~(value <= cut)
                    np.take(tables["child"][t], node, out=at, mode="clip")
                    node, at = at, node
                total += tables["path"][t][node]
            return pd.Series(-(2.0 ** (-(total / len(tables["feature"])) / norm)))

        return score(*[scaled(c, self.scale) for c in self.features])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, c, *map(float, self.scale[c]), self.sample_size) for i, c in enumerate(self.features)]
        spark.createDataFrame(
            rows, "place int, feature string, mean double, scale double, sample_size int"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        features = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        return IsolationForestModel(
            spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas(),
            [r["feature"] for r in features],
            {r["feature"]: (r["mean"], r["scale"]) for r in features},
            features[0]["sample_size"],
        )


def node_table(
    df: DataFrame, id_col: str, features: list[str], scale: dict, n_rows: int,
    n_trees: int = 200, sample_size: int = 256, seed: int = 42,
) -> DataFrame:
    """The forest as a table of nodes, one group of sampled rows per tree."""
    size = min(sample_size, n_rows)
    limit = int(np.ceil(np.log2(max(size, 2))))
    names = list(features)
    ready = df.select(id_col, *[scaled(c, scale).alias(c) for c in names])

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        picked = rows.sort_values(["h", "id"]).head(size)
        built = build_tree(picked[names].to_numpy(dtype=np.float64), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(built, columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    drawn = tree_samples(ready, id_col, names, n_rows, n_trees, size, seed)
    return drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def fit(
    df: DataFrame, id_col: str, features: list[str],
    n_trees: int = 200, sample_size: int = 256, seed: int = 42,
) -> IsolationForestModel:
    """Trains on all rows of ``df``; the driver receives the bounded node table only.

    Reads ``df`` three times (count, scale, sample): pass a stored table.
    """
    n_rows = df.count()
    if n_rows == 0:
        raise ValueError("no rows to train on")
    scale = as_dict(fit_scaler(df, features))
    nodes = node_table(df, id_col, features, scale, n_rows, n_trees, sample_size, seed).toPandas()
    # Trees that drew no row (tiny inputs) are left out.
    nodes["tree"] = nodes["tree"].rank(method="dense").astype("int32") - 1
    return IsolationForestModel(
        nodes.sort_values(["tree", "node"], ignore_index=True), list(features), scale, min(sample_size, n_rows)
    )


def score(df: DataFrame, model: IsolationForestModel, name: str = "raw_score") -> DataFrame:
    return df.withColumn(name, model.raw_score(df.sparkSession))


def flow_calibration(raw: str = "raw_score") -> Column:
    """Fixed calibration of the flow model."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(-0.3) - F.col(raw)) / F.lit(0.5)))


def user_calibration(scored: DataFrame, raw: str = "raw_score", name: str = "ml_score") -> DataFrame:
    """Between the 99th (score 0) and 1st (score 1) percentile of the raw scores, four decimals."""
    scored = settle(scored, "raw-scores")
    ends = exact_quantiles(scored, [raw], 0.01, 0.99).agg(
        F.struct(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    )
    scored = scored.withColumn("_ends", ends.scalar())
    low, high = F.col("_ends.low"), F.col("_ends.high")
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - F.col(raw)) / span))
    return scored.withColumn(name, round_even(value, 4)).drop("_ends")


def packet_calibration(scored: DataFrame, contamination: float = 0.05, raw: str = "raw_score") -> DataFrame:
    """threat_score = 1 - min-max, is_anomaly = below the contamination quantile."""
    scored = settle(scored, "raw-scores")
    ends = scored.agg(F.struct(F.min(raw).alias("lo"), F.max(raw).alias("hi")).alias("e"))
    cut = exact_quantiles(scored, [raw], contamination).select("quantile").scalar()
    scored = scored.withColumns({"_ends": ends.scalar(), "_cut": cut})
    lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    spread = F.when(hi > lo, (F.col(raw) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return scored.withColumns(
        {"threat_score": F.lit(1.0) - spread, "is_anomaly": (F.col(raw) < F.col("_cut")).cast("int")}
    ).drop("_ends", "_cut")
