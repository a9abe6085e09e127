"""Model invariants, registered queries against their SQL, and streams against batches."""

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatlens.catalog.queries import QUERIES as CATALOG
from threatlens.models import iforest, scaler, trees
from threatlens.streaming import live

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"


def planted(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    x[:6] += 8
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf.insert(0, "id", [f"r{i}" for i in range(n)])
    return spark.createDataFrame(pdf)


def test_isolation_forest_finds_planted_rows(spark, tmp_path):
    df = planted(spark)
    model = iforest.fit(df, "id", ["a", "b", "c"], n_trees=50)
    again = iforest.fit(df.repartition(5), "id", ["a", "b", "c"], n_trees=50)
    pd.testing.assert_frame_equal(model.nodes[["tree", "node", "feature"]], again.nodes[["tree", "node", "feature"]])
    scored = iforest.packet_calibration(iforest.score(df, model), 0.05).toPandas().set_index("id")
    assert scored["raw_score"].between(-1, 0).all() and scored["threat_score"].between(0, 1).all()
    cut = scored["threat_score"].quantile(0.95)
    assert (scored.loc[[f"r{i}" for i in range(6)], "threat_score"] > cut).all()
    assert scored["is_anomaly"].sum() == 30
    model.save(spark, str(tmp_path / "m"))
    loaded = iforest.IsolationForestModel.load(spark, str(tmp_path / "m"))
    back = iforest.score(df, loaded).toPandas().set_index("id")["raw_score"]
    assert np.allclose(back.sort_index(), scored["raw_score"].sort_index())


def test_average_path_formula():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert abs(iforest.average_path(256) - 10.2448) < 1e-3


def test_scaler_constant_column(spark):
    df = planted(spark).withColumn("k", F.lit(4.0))
    out = scaler.apply_scaler(df, scaler.fit_scaler(df, ["a", "k"]), ["a", "k"]).toPandas()
    assert abs(out["a"].mean()) < 1e-9 and abs(out["a"].std(ddof=0) - 1) < 1e-9 and (out["k"] == 0).all()


def test_stratified_split_shares(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = trees.stratified_split(df, "id", "label", 0.2).groupBy("label").agg(F.avg(F.col("is_test").cast("int")).alias("s"))
    for r in split.collect():
        assert abs(r["s"] - 0.2) < 0.01


def test_entry_gives_rows(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and "predicted_category" in out.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


CHECKED = [
    "dedupe_flows", "join_ja3_mode", "swift_rolling_rate", "ueba_rules", "windows_event_rules", "sessionize",
    "asof_nearest_sessions", "co_occurrence_boost", "classify_category", "metrics_at_fpr", "feature_auroc",
    "killchain_paths", "stream_source_flows", "stream_alert_cooldown", "stream_counters", "stream_rate_window",
    "stratified_split", "top_threat_ips", "user_calibration", "importance_share", "full_run_decisions",
]


#: ALL_TWINS=1 runs every query next to its SQL.
TWINS = sorted(set(CATALOG) & set(contract.oracle_sql())) if os.environ.get("ALL_TWINS") else CHECKED


@pytest.mark.parametrize("name", TWINS)
def test_query_matches_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    names, _, want = compare.oracle_rows(compare.connect(SF), contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(names, want)


def test_live_parsing_defaults_and_malformed(spark):
    good = ["f1", "1.1.1.1", "2.2.2.2", "2024-01-01 00:00:00", "1", "2", "3", "4", "5", "DMZ", "True", "x", "80", "S", "h", "0.3", "0.4"]
    no_score = [*good[:15], "?", "0.4"]
    bad_port = [*good[:12], "http", *good[13:]]
    from threatlens.sources.readers import LIVE_SCHEMA

    df = spark.createDataFrame([good, no_score, bad_port], LIVE_SCHEMA)
    got = live.parse_live(df).select("packet_score", "behavior_score", "is_internal_src", "is_internal_dst").collect()
    assert [tuple(r) for r in got] == [(0.3, 0.4, True, False), (0.05, 0.05, True, False)]


def test_tree_draws_do_not_depend_on_table_size(spark):
    """Two sizes with the same share of rows per tree: a row is in the same trees."""
    small = spark.range(4000).select("id", F.rand(1).alias("a"))
    large = spark.range(8000).select("id", F.rand(1).alias("a"))
    picks = [
        {(r["id"], r["tree"]) for r in iforest.tree_samples(df, "id", ["a"], n, 6, size, 3).collect()}
        for df, n, size in ((small, 4000, 64), (large, 8000, 128))
    ]
    assert picks[0] == {p for p in picks[1] if int(p[0]) < 4000}


def test_train_or_load(spark, monkeypatch):
    from threatlens.catalog.queries import Tables
    from threatlens.plans import flow_agent
    from threatlens.session import fresh_folder

    flows = Tables(spark, SF).stored
    path = fresh_folder(spark, "artifacts-test")
    first = flow_agent.grade(flows, flow_agent.train_or_load(spark, path, flows, rounds=2, depth=3)).toPandas()
    monkeypatch.setattr(flow_agent, "train", None)  # a second call trains nothing
    again = flow_agent.grade(flows, flow_agent.train_or_load(spark, path, flows, rounds=2, depth=3)).toPandas()
    key = ["flow_id"]
    pd.testing.assert_frame_equal(first.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    with pytest.raises(TypeError):
        flow_agent.train_or_load(spark, path, flows, retrain=True)


def test_known_fingerprint_names_a_beacon(spark):
    from threatlens.catalog.queries import Tables
    from threatlens.operators import fusion as fu

    t = Tables(spark, SF)
    hit = t.flows.select("src_ip").distinct().withColumn("ind_ja3_c2_match", F.lit(1))
    kinds = fu.correlate(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores, ja3_signal=hit)
    assert {r[0] for r in kinds.select("predicted_category").distinct().collect()} == {"C2_BEACON"}


def test_contradictory_labels_count_once(spark):
    from threatlens.operators import evaluation as ev

    labels = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", None)], "flow_id string, is_attack boolean")
    scored = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "flow_id string, s double")
    assert sorted((r.flow_id, r.is_attack) for r in ev.join_labels(scored, labels).collect()) == [("a", True), ("b", False)]


def test_first_where_repeated(spark):
    from threatlens.operators import cleaning

    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "x"), ("b", 5, "z"), (None, 3, "n"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    got = sorted(map(tuple, cleaning.first_where_repeated(df, ["k"], ["at"]).collect()), key=str)
    assert got == sorted([("a", 1, "x"), ("b", 5, "z"), (None, 2, "m")], key=str)
    assert sorted(map(tuple, cleaning.first_per_key(df, ["k"], ["at"]).collect()), key=str) == got
    assert cleaning.first_where_repeated(df.where("k = 'b'"), ["k"], ["at"]).count() == 1


def test_composed_run(spark):
    from threatlens.catalog.queries import Tables
    from threatlens.plans import full_run

    t = Tables(spark, SF)
    tables = full_run.Tables(t.netflow, t.zeek, t.windows_events, t.ueba, t.hosts, t.flow_labels, t.tickets)
    out = full_run.run(tables, with_ja3=True, rounds=2, depth=3)
    assert out.responded.count() == t.flows.count() and out.threshold.first()[0] is not None


def test_threats_of_the_whole_table_are_graded(spark, monkeypatch):
    from threatlens.catalog import queries as Q
    from threatlens.plans import flow_agent

    t, train, asked = Q.Tables(spark, SF), flow_agent.train, []

    def short(flows, kind="both", **gbt):
        asked.append((gbt, {r[0] for r in flows.select("flow_id").collect()}))
        return train(flows, kind, rounds=2, depth=3)

    monkeypatch.setattr(flow_agent, "train", short)
    graded = Q.graded_apart(t)
    ids = sorted(r[0] for r in t.stored.select("flow_id").collect())
    assert sorted(r[0] for r in graded.select("flow_id").collect()) == ids
    assert [gbt for gbt, _ in asked] == [{}, {}]
    (_, one), (_, other) = asked
    assert one.isdisjoint(other) and one | other == set(ids) and one and other
