"""Range-partitioned windows against brute force on random data with a hot key, ties and borders."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatlens.operators import ordered, sessions
from threatlens.streaming import live

PARTS = 7


def events(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else f"k{rng.randrange(4)}"
        rows.append((key, f"id{i}", rng.choice([0, 999, 1000, 1001, 2000, rng.randrange(6000)]), rng.randrange(4)))
    return rows


def order_of(row):
    import hashlib

    key, ident, at, _ = row
    return at, hashlib.md5(ident.encode()).hexdigest()[:2], ident


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, id string, at long, v int").repartition(3)


def test_rolling_counts_follow_row_order(spark):
    rows = events()
    widths = {"n": 700, "m": 50}
    got = {
        r["id"]: (r["n"], r["m"])
        for r in ordered.rolling_counts(frame(spark, rows), ["k"], "at", "id", widths, parts=PARTS).collect()
    }
    closed = {
        r["id"]: r["n"]
        for r in ordered.rolling_counts(
            frame(spark, rows), ["k"], "at", "id", {"n": 700}, include_left=True, parts=PARTS
        ).collect()
    }
    assert len(got) == len(rows)
    for row in rows:
        earlier = [r for r in rows if r[0] == row[0] and order_of(r) <= order_of(row)]
        assert got[row[1]] == (
            sum(r[2] > row[2] - 700 for r in earlier), sum(r[2] > row[2] - 50 for r in earlier)
        )
        assert closed[row[1]] == sum(r[2] >= row[2] - 700 for r in earlier)


def test_prefix_sums(spark):
    rows = events(seed=2)
    out = ordered.prefix_sums(
        frame(spark, rows), ["k"], "at", "id", {"s": F.col("v"), "c": F.lit(1)}, parts=PARTS
    ).collect()
    got = {r["id"]: (r["s"], r["c"]) for r in out}
    for row in rows:
        before = [r for r in rows if r[0] == row[0] and order_of(r) < order_of(row)]
        assert got[row[1]] == (sum(r[3] for r in before), len(before))


def test_rolling_max_level(spark):
    rows = events(seed=3)
    out = ordered.rolling_max_level(frame(spark, rows), "k", "at", "v", 3, 700, "m", parts=PARTS).collect()
    got = {r["id"]: r["m"] for r in out}
    for row in rows:
        assert got[row[1]] == max(
            r[3] for r in rows if r[0] == row[0] and row[2] - 700 < r[2] <= row[2]
        )


def test_order_of_input_does_not_matter(spark):
    rows = events(seed=4)
    a = ordered.rolling_counts(frame(spark, rows), ["k"], "at", "id", {"n": 700}, parts=PARTS)
    b = ordered.rolling_counts(
        frame(spark, rows[::-1]).repartition(7, "v"), ["k"], "at", "id", {"n": 700}, parts=PARTS
    )
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_session_numbers(spark):
    rows = events(seed=5)
    gap = 120
    got = {
        (r["k"], r["at"]): r["session_seq"]
        for r in sessions.session_numbers(frame(spark, rows), "k", "at", gap, PARTS).collect()
    }
    for key in {r[0] for r in rows}:
        number, last = 0, None
        for at in sorted({r[2] for r in rows if r[0] == key}):
            number += last is None or at - last > gap
            last = at
            assert got[(key, at)] == number


def test_cumulative_and_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.round(np.concatenate([rng.exponential(50, 300), np.full(150, 3.0), -rng.random(20)]), 3)
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": values[::-1] * 2}))
    got = {
        (r["column"], r["q"]): r["quantile"]
        for r in ordered.exact_quantiles(df, ["x", "y"], 0.01, 0.5, 0.9, 0.99).collect()
    }
    for q in (0.01, 0.5, 0.9, 0.99):
        assert abs(got[("x", q)] - np.percentile(values, 100 * q)) < 1e-9
        assert abs(got[("y", q)] - np.percentile(values * 2, 100 * q)) < 1e-9
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    cum = ordered.cumulative_by_value(counts, "x", ["n"], parts=PARTS, following=["n"]).orderBy(F.desc("x")).toPandas()
    assert (cum["cum_n"].to_numpy() == cum["n"].cumsum().to_numpy()).all()
    assert (cum["next_n"].to_numpy()[:-1] == cum["n"].to_numpy()[1:]).all() and pd.isna(cum["next_n"].iloc[-1])


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics_by_narrowing(spark, seed):
    """Small sketches and few values taken as they are, so that several rounds are needed; ties and nulls."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=4000), np.full(900, 0.25), rng.integers(0, 5, 1100).astype(float)])
    rng.shuffle(x)
    frame = pd.DataFrame({"c0": x, "c1": np.where(rng.random(len(x)) < 0.3, np.nan, np.exp(9 * x))})
    values = spark.createDataFrame(frame).select("c0", F.nanvl("c1", F.lit(None)).alias("c1")).repartition(6)
    ranks = {"c0": {0, 17, 3000, 5999, *rng.integers(0, 6000, 5).tolist()}, "c1": {0, 100, 2000}}
    counts = {"c0": 6000, "c1": int(frame["c1"].notna().sum())}
    got = ordered.order_statistics(values, ranks, counts, parts=20, few=30)
    for name, wanted in ranks.items():
        held = np.sort(frame[name].dropna().to_numpy())
        assert {r: got[name, r] for r in wanted} == {r: held[r] for r in wanted}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "x double, y double")
    assert ordered.exact_quantiles(df, ["x", "y"], 0.5).count() == 0


def test_cooldown_batch(spark):
    rng = random.Random(7)
    start = 1704067200
    seconds = {("a", "x"): [0, 10, 11, 21, 22, 33], ("b", "x"): sorted({rng.randrange(400) for _ in range(150)})}
    rows = [(ip, name, "HIGH", start + s) for (ip, name), ss in seconds.items() for s in ss]
    df = spark.createDataFrame(rows, "src_ip string, attack_name string, severity string, s long").select(
        "src_ip", "attack_name", "severity", F.timestamp_seconds("s").alias("alert_time"),
        *[F.lit(0.5).alias(c) for c in live.ALERT_SCORES],
    )
    got = sorted((r["src_ip"], int(r["t"]) - start) for r in live.cooled_batch(df).withColumn("t", F.unix_seconds("alert_time")).collect())
    want = []
    for (ip, _), ss in seconds.items():
        last = None
        for s in ss:
            if last is None or s - last > 10:
                want.append((ip, s))
                last = s
    assert got == sorted(want)


def test_settle_and_release(spark):
    import os

    from threatlens import session

    stored = session.settle(spark.range(5), "five")
    assert stored.count() == 5
    folder = session._session_folder(spark)
    assert os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)


def test_crowded_key_is_spread(spark):
    """All rows of one key within one hour, and one far outlier: partitions stay even."""
    rows = [("hot", f"id{i}", i * 1000, 1) for i in range(4000)] + [("hot", "far", 10**15, 1), ("b", "b", 5, 1)]
    df = frame(spark, rows)
    parts = ordered.ranged(df.select("k", "at"), [F.col("k"), F.col("at")], 8)
    assert parts.groupBy("k", ordered.PART).count().agg(F.max("count")).first()[0] < 1500
    got = {r["id"]: r["n"] for r in ordered.rolling_counts(df, ["k"], "at", "id", {"n": 5000}, parts=8).collect()}
    assert got["id3999"] == 5 and got["far"] == 1 and got["id2"] == 3
    values = spark.createDataFrame([(float(i) / 1e6, 1) for i in range(4000)] + [(1e300, 1)], "x double, n long")
    parts = ordered.ranged(values, [F.col("x")], 8)
    assert parts.groupBy(ordered.PART).count().agg(F.max("count")).first()[0] < 1500
    cum = ordered.cumulative_by_value(values, "x", ["n"], descending=False, parts=8)
    assert cum.where("x = 1e300").first()["cum_n"] == 4001


def test_edges_off_every_path_leave(spark):
    """Many dead ends on both sides: what is left is exactly the edges of whole paths."""
    import itertools

    from threatlens.operators.killchain import edges_on_paths

    rng = random.Random(4)
    edges = {(h, f"{h}-{rng.randrange(9)}", f"{h + 1}-{rng.randrange(9)}") for h in range(3) for _ in range(14)}
    edges |= {(h, f"{h}-dead{i}", f"{h + 1}-dead{i + h + 1}") for h in range(3) for i in range(0, 60, 7)}
    whole = [
        p for p in itertools.product(*[[e for e in edges if e[0] == h] for h in range(3)])
        if all(a[2] == b[1] for a, b in zip(p, p[1:], strict=False))
    ]
    got = edges_on_paths(spark.createDataFrame(sorted(edges), "hop int, src_ip string, dst_ip string"), 3)
    assert {tuple(r) for r in got.collect()} == {e for p in whole for e in p} and whole
