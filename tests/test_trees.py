"""Boosted trees and the random forest against plain numpy versions."""

import threading
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatlens.catalog import queries
from threatlens.models import boosting, forest, trees

NAMES = ["a", "b", "c"]


def table(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.integers(0, 4, n).astype(float)})
    data["label"] = ((data["a"] * data["b"] + 0.3 * data["c"] + rng.normal(size=n) * 0.4) > 0.6).astype(int)
    data["is_valid"] = rng.random(n) < 0.25
    data.insert(0, "id", [f"r{i}" for i in range(n)])
    return data, spark.createDataFrame(data)


class PlainBooster:
    """Second-order boosting over all cuts, written out row by row."""

    def __init__(self, x, y, rounds, depth, rate, cuts):
        self.weight = (y == 0).sum() / (y == 1).sum()
        self.trees, margin = [], np.zeros(len(x))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            w = np.where(y == 1, self.weight, 1.0)
            tree = self.node(x, (p - y) * w, p * (1 - p) * w, np.arange(len(x)), depth, rate, cuts)
            self.trees.append(tree)
            margin += np.array([self.walk(tree, row) for row in x])

    def node(self, x, g, h, rows, depth, rate, cuts):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for feature in range(x.shape[1]) if depth else ():
            for cut in cuts[feature]:
                left = rows[x[rows, feature] < cut]
                gl, hl = g[left].sum(), h[left].sum()
                if hl < 1 or total_h - hl < 1:
                    continue
                gain = 0.5 * (gl ** 2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g ** 2 / (total_h + 1))
                if gain > best[0] + 1e-9:
                    best = (gain, feature, cut)
        if best[1] is None:
            return -rate * total_g / (total_h + 1)
        low = x[rows, best[1]] < best[2]
        return best[1], best[2], *[self.node(x, g, h, part, depth - 1, rate, cuts) for part in (rows[low], rows[~low])]

    def walk(self, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree


def test_same_trees_as_a_plain_booster(spark):
    data, rows = table(spark)
    model = boosting.fit(rows.repartition(5), NAMES, "label", "is_valid", rounds=4, depth=3, rate=0.3)
    train = data[~data["is_valid"]]
    cuts = boosting.cut_points(rows.where("not is_valid"), NAMES)
    plain = PlainBooster(train[NAMES].to_numpy(), train["label"].to_numpy(), 4, 3, 0.3, cuts)
    used = int(model.nodes["tree"].max()) + 1

    def nested(nodes, at=0):
        row = nodes.loc[at]
        if row["feature"] < 0:
            return pytest.approx(row["value"], abs=1e-5)
        return int(row["feature"]), row["cut"], nested(nodes, 2 * at + 1), nested(nodes, 2 * at + 2)

    for number in range(used):
        nodes = model.nodes[model.nodes["tree"] == number].set_index("node")
        assert plain.trees[number] == nested(nodes)
    x = data[NAMES].to_numpy()
    margin = np.array([sum(plain.walk(t, row) for t in plain.trees[:used]) for row in x])
    got = rows.withColumn("p", model.probability(spark)).toPandas().set_index("id")["p"].loc[data["id"]]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)), atol=1e-5)


def test_layout_does_not_matter_and_model_is_stored(spark, tmp_path):
    _, rows = table(spark, 300)
    first = boosting.fit(rows.repartition(1), NAMES, "label", "is_valid", rounds=3, depth=2)
    again = boosting.fit(rows.repartition(6), NAMES, "label", "is_valid", rounds=3, depth=2)
    pd.testing.assert_frame_equal(first.nodes, again.nodes)
    first.save(spark, str(tmp_path / "m"))
    back = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    pd.testing.assert_frame_equal(back.nodes, first.nodes, check_dtype=False)
    assert back.features == NAMES and back.aucs == first.aucs
    assert sum(first.importances().values()) == pytest.approx(1.0)


def test_one_task_grows_the_trees_of_many_jobs(spark, monkeypatch):
    data, rows = table(spark, 400, seed=5)
    rows = rows.unionByName(rows.where("a > 1")).withColumn("twin", F.col("c") * 2).repartition(3)

    def grown(group: str) -> tuple[boosting.BoostedTrees, int]:
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = boosting.fit(rows, [*NAMES, "twin"], "label", "is_valid", rounds=9, depth=4, rate=0.3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, n_few = grown("few-rows")
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    monkeypatch.setattr(boosting, "SETTLE_ROUNDS", 2)
    many, n_many = grown("many-rows")
    pd.testing.assert_frame_equal(few.nodes, many.nodes)
    assert few.aucs == many.aucs and n_few < 9 * 4 < n_many


def test_features_summed_as_one_are_told_apart():
    rng = np.random.default_rng(2)
    n_bins = [256, 1, 2, 16, 3, 8, 2]
    assert sorted(i for g in boosting.joint_features(n_bins) for i in g) == list(range(7))
    assert all(np.prod([n_bins[i] for i in g]) <= boosting.BINS for g in boosting.joint_features(n_bins))
    bins = np.stack([rng.integers(0, n, 500).astype(np.uint8) for n in n_bins])
    node, g, h = rng.integers(1, 3, 500), rng.integers(-50, 50, 500).astype(float), rng.integers(0, 9, 500).astype(float)
    sums = boosting.Sums(n_bins, 1)
    sums.add(bins[:, :300], node[:300], g[:300], h[:300])
    sums.add(bins[:, 300:], node[300:], g[300:], h[300:])
    nodes, found = sums.whole()
    assert list(nodes) == [1, 2]
    for at, i, b in [(0, 0, bins[0, 7]), (1, 3, 5), (0, 5, 0), (1, 6, 1), (0, 1, 0)]:
        mine = (node == nodes[at]) & (bins[i] == b)
        assert list(found[at, i, b]) == [g[mine].sum(), h[mine].sum()]


def test_halves_train_side_by_side(spark, monkeypatch):
    both, flows = threading.Barrier(2, timeout=60), spark.range(6).select(F.col("id").cast("string").alias("flow_id"))
    known = []

    def train_or_load(spark, path, half):
        both.wait()  # passed only if the other half is being trained as well
        known.append(sorted(r["flow_id"] for r in half.collect()))
        return known[-1]

    monkeypatch.setattr(queries.flow_agent, "train_or_load", train_or_load)
    monkeypatch.setattr(queries.flow_agent, "grade", lambda rest, art: rest.withColumn("known", F.lit(",".join(art))))
    out = queries.graded_apart(SimpleNamespace(spark=spark, stored=flows)).collect()
    assert sorted(r["flow_id"] for r in out) == list("012345") and sorted(sum(known, [])) == list("012345")
    assert all(r["flow_id"] not in r["known"].split(",") for r in out)


def test_stops_after_patience_and_keeps_the_best_round(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SETTLE_ROUNDS", 2)
    rng = np.random.default_rng(3)
    noise = pd.DataFrame({c: rng.normal(size=200) for c in NAMES})
    noise["label"], noise["is_valid"] = rng.integers(0, 2, 200), rng.random(200) < 0.4
    rows = spark.createDataFrame(noise)
    model = boosting.fit(rows, NAMES, "label", "is_valid", rounds=60, depth=2, rate=0.3, patience=3)
    best = int(np.argmax(model.aucs)) + 1
    assert len(model.aucs) == best + 3 < 60 and int(model.nodes["tree"].max()) + 1 == best
    valid = rows.where("is_valid").withColumn("p", model.probability(spark)).toPandas()
    p, y = valid["p"].to_numpy(), valid["label"].to_numpy()
    wins = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    assert model.aucs[best - 1] == pytest.approx(wins.mean(), abs=2e-3)


def test_boosting_edge_cases(spark):
    rows = spark.createDataFrame(
        [(1.0, None, 1, False), (2.0, 5.0, 0, False), (float("nan"), 1.0, 0, False), (3.0, 2.0, None, False)],
        "a double, b double, label int, is_valid boolean",
    )
    model = boosting.fit(rows, ["a", "b"], "label", "is_valid", rounds=3)
    assert model.aucs == [] and rows.withColumn("p", model.probability(spark)).where("p between 0 and 1").count() == 4
    one = boosting.fit(rows.where("label = 0"), ["a", "b"], "label", "is_valid", rounds=3)
    assert rows.withColumn("p", one.probability(spark)).where("p < 0.5").count() == 4
    none = boosting.fit(rows.limit(0), ["a", "b"], "label", "is_valid", rounds=3)
    assert rows.withColumn("p", none.probability(spark)).where("p = 0.5").count() == 4


def test_fit_gbt_learns(spark):
    _, rows = table(spark, 800)
    model = trees.fit_gbt(rows.drop("is_valid"), "id", NAMES, rounds=12, depth=3, rate=0.3)
    out = trees.probability(rows, model, "p").toPandas()
    assert out.loc[out["label"] == 1, "p"].mean() > out.loc[out["label"] == 0, "p"].mean() + 0.3


def chain(spark, n=400):
    """Labels alternate along one feature, so that every tree has to cut single values off."""
    return spark.createDataFrame([(f"r{i}", float(i), i % 2) for i in range(n)], "id string, a double, label int")


def depth_of(left, at=0):
    """Depth of the deepest leaf below a node."""
    deepest, waiting = 0, [(at, 0)]
    while waiting:
        node, depth = waiting.pop()
        deepest = max(deepest, depth)
        if left[node] >= 0:
            waiting += [(left[node], depth + 1), (left[node] + 1, depth + 1)]
    return deepest


def test_depth_has_no_limit(spark):
    x = np.arange(120, dtype=float)[:, None]
    label = (np.arange(120) % 2).astype(int)
    weight = 1.5 ** -np.arange(120.0)  # the cut of most gain is always the first one
    feature, cut, left, _ = forest.grow(*forest.ranked(x), label, weight, 1, 1, np.random.default_rng(0))
    assert depth_of(left) > 60 and len(feature) == 239 and set(cut[feature < 0]) == {0.0, 1.0}
    model = forest.fit(chain(spark), "id", ["a"], "label", n_trees=3, min_leaf=1)
    for tree in range(3):
        nodes = model.nodes().where(F.col("tree") == tree).orderBy("node").toPandas()
        assert depth_of(nodes["left"].to_numpy()) > 8


class PlainTree:
    """The same growth node by node with all features tried, for a table without ties in gain."""

    def __init__(self, x, label, weight, min_leaf):
        self.x, self.label, self.weight, self.min_leaf = x, label, weight, min_leaf

    def impurity(self, rows):
        mass = np.array([self.weight[rows][self.label[rows] == k].sum() for k in (0, 1)])
        return mass.sum() - (mass ** 2).sum() / mass.sum()

    def node(self, rows):
        best = None
        if len(set(self.label[rows])) == 2:
            for feature in range(self.x.shape[1]):
                values = np.unique(self.x[rows, feature])
                for low, high in zip(values[:-1], values[1:], strict=True):
                    below = rows[self.x[rows, feature] <= low]
                    above = rows[self.x[rows, feature] > low]
                    if min(len(below), len(above)) >= self.min_leaf:
                        gain = self.impurity(rows) - self.impurity(below) - self.impurity(above)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, feature, (low + high) / 2, below, above)
        if best is None:
            return float(self.weight[rows][self.label[rows] == 1].sum() / self.weight[rows].sum())
        return best[1], best[2], self.node(best[3]), self.node(best[4])


@pytest.mark.parametrize("seed,min_leaf", [(1, 1), (2, 2), (3, 5)])
def test_same_tree_as_a_plain_search(seed, min_leaf):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=150), rng.integers(0, 6, 150), np.ones(150)])
    label, weight = (x[:, 0] + rng.normal(size=150) > 0).astype(int), rng.random(150) + 0.5
    feature, cut, left, gains = forest.grow(*forest.ranked(x), label, weight, min_leaf, 3, rng)

    def nested(at=0):
        if feature[at] < 0:
            return pytest.approx(cut[at])
        return int(feature[at]), pytest.approx(cut[at]), nested(left[at]), nested(left[at] + 1)

    assert PlainTree(x, label, weight, min_leaf).node(np.arange(150)) == nested() and gains[2] == 0


def test_random_turns_try_more_features_until_one_splits():
    """One of thirty features varies enough for leaves of ten rows; each tree must find it at its root."""
    x = np.zeros((40, 30))
    x[:3, :29] = np.arange(1, 4)[:, None]
    x[:, 29] = np.arange(40)
    for seed in range(10):
        feature, *_ = forest.grow(*forest.ranked(x), (np.arange(40) > 19).astype(int), np.ones(40), 10, 1, np.random.default_rng(seed))
        assert feature[0] == 29


@pytest.mark.parametrize("local_rows", [1 << 17, 60])
def test_forest_learns_and_scores_as_its_nodes_say(spark, monkeypatch, local_rows):
    data, rows = table(spark, 400, seed=5)
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 5)
    monkeypatch.setattr(forest, "GROUP_NODES", 400)
    model = forest.fit(rows.repartition(4), "id", NAMES, "label", n_trees=8, local_rows=local_rows)
    nodes = model.nodes().toPandas()
    assert sorted(set(nodes["tree"])) == list(range(8)) and len(model.groups()) > 1
    by_tree = {t: part.sort_values("node").to_dict("list") for t, part in nodes.groupby("tree")}

    def leaf(tree, row):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] + int(row[NAMES[tree["feature"][at]]] >= tree["cut"][at])
        return tree["cut"][at]

    for tree in by_tree.values():  # every node but the root is the child of exactly one
        children = [c for n in tree["left"] if n >= 0 for c in (n, n + 1)]
        assert sorted(children) == list(range(1, len(tree["node"])))
    got = trees.probability(rows, model, "p").toPandas().set_index("id")
    for _, row in data.iloc[::17].iterrows():
        assert got.loc[row["id"], "p"] == pytest.approx(np.mean([leaf(t, row) for t in by_tree.values()]))
    assert got.loc[got["label"] == 1, "p"].mean() > got.loc[got["label"] == 0, "p"].mean() + 0.4
    shares = {r["feature"]: r["importance"] for r in model.importances().collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["a"] > shares["c"]


def test_wide_nodes_split_where_a_plain_search_does(spark):
    """With all features tried and few distinct values, a split by bins is that over all values."""
    rng = np.random.default_rng(2)
    data = pd.DataFrame({c: rng.integers(0, 9, 300).astype(float) for c in NAMES})
    data["label"] = ((data["a"] > 4) ^ (rng.random(300) < 0.1)).astype(int)
    frame = spark.createDataFrame([
        (0, "r", str(i), i, [r.a, r.b, r.c], int(r.label), 1.0) for i, r in enumerate(data.itertuples())
    ], forest._DRAWN_SCHEMA)
    cuts = boosting.cut_points(spark.createDataFrame(data), NAMES)
    got = forest.split_wide_nodes(frame, frame.select("tree", "node").distinct(), cuts, 2, 3, 1).collect()
    x = data[NAMES].to_numpy()
    want = PlainTree(x, data["label"].to_numpy(), np.ones(300), 2).node(np.arange(300))
    assert len(got) == 1 and got[0]["feature"] == want[0]
    assert ((x[:, want[0]] < got[0]["cut"]) == (x[:, want[0]] < want[1])).all()


def test_draws_are_poisson():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    times = forest.draws(keys, 3, 42)
    assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.02
    assert abs(np.corrcoef(times, forest.draws(keys, 4, 42))[0, 1]) < 0.03


def test_forest_edge_cases(spark):
    rows = chain(spark, 40)
    pure = forest.fit(rows.where("label = 1"), "id", ["a"], "label", n_trees=2)
    assert trees.probability(rows, pure, "p").where("p = 1").count() == 40
    none = forest.fit(rows.limit(0), "id", ["a"], "label", n_trees=2)
    assert trees.probability(rows, none, "p").where("p is null").count() == 40
    nulls = spark.createDataFrame([("x", None, 1), ("y", 2.0, 0), ("z", float("nan"), None)], "id string, a double, label int")
    assert trees.probability(nulls, forest.fit(nulls, "id", ["a"], "label", n_trees=4, min_leaf=1), "p").count() == 3
