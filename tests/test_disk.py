"""What operators store and exchange on the way does not pile up on the disks, and slices give the rows of the whole."""

import os

import pytest
from pyspark.sql import functions as F

from threatlens import session
from threatlens.catalog import queries
from threatlens.operators import fusion, ordered
from threatlens.plans import full_run
from threatlens.streaming import live


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables of the driver's layout, with repeated flow ids, a hot source and null keys."""
    top = str(tmp_path_factory.mktemp("tables"))
    k = F.col("id")
    some = {
        "lineitem": spark.range(3000).select(
            F.when(k % 97 != 0, k % 700).alias("l_orderkey"), (k * 7 % 300).alias("l_partkey"),
            F.when(k % 3 == 0, F.lit(3)).otherwise(k * 13 % 60).alias("l_suppkey"), (k % 7 + 1).cast("int").alias("l_linenumber"),
            (k % 50).cast("double").alias("l_quantity"), (k * 37 % 90000).cast("double").alias("l_extendedprice"),
            (k % 10 / 100).alias("l_discount"), (k % 8 / 100).alias("l_tax"), F.lit("A").alias("l_returnflag"),
        ),
        "orders": spark.range(400).select(
            k.alias("o_orderkey"), (k % 40).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), (k * 1.5).alias("o_totalprice"),
        ),
        "events": spark.range(500).select(
            k.alias("event_id"), (k % 90).alias("user_id"), F.lit("error").alias("event_type"), (k % 60).cast("double").alias("value"),
        ),
        "supplier": spark.range(60).select(k.alias("s_suppkey")), "nation": spark.range(6).select(k.cast("int").alias("n_nationkey")),
    }
    for name, df in some.items():
        df.coalesce(2).write.parquet(f"{top}/{name}.parquet")
    return top


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def kept(spark):
    """Names of the stored tables."""
    top = session._session_folder(spark)
    return sorted(x.rsplit("-", 1)[0] for x in os.listdir(top)) if os.path.isdir(top) else []


def exchanged(spark):
    """Shuffle files that lie on the disks."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_settle_deletes_what_was_exchanged(spark):
    before = exchanged(spark)
    stored = session.settle(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count(), "counts")
    assert stored.count() == 50 and stored.agg(F.sum("count")).first()[0] == 5000
    session.settle(spark.range(5000).repartition(4, "id"), "dealt")
    left = spark.range(9).groupBy("id").count()
    assert left.count() == 9 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"  # other actions are left alone
    assert len({x.split("_")[1] for x in exchanged(spark) - before}) <= 2  # the exchanges of the last count alone


def test_parts_delete_what_they_stored(spark):
    session.release(spark)
    kept_before = session.settle(spark.range(3), "kept")
    parts = [lambda i=i: session.settle(spark.range(4), "passing").withColumn("part", F.lit(i)) for i in range(3)]
    out = session.settle_parts(spark, parts, "whole")
    assert out.count() == 12 and kept_before.count() == 3 and kept(spark) == ["kept", "whole"]
    with pytest.raises(ValueError):
        session.settle_parts(spark, [lambda: (session.settle(spark.range(4), "passing"), int("no"))], "broken")
    session.settle(spark.range(2), "later")
    assert kept(spark) == ["kept", "later", "whole"]


def test_rolling_max_level_in_slices(spark, monkeypatch):
    rows = [(None if i % 41 == 0 else f"k{i % 5}" if i % 3 else "hot", None if i % 43 == 0 else i * 37 % 900, i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, v int")
    whole = rows_of(ordered.rolling_max_level(df, "k", "at", "v", 3, 120, "m", parts=3))
    session.release(spark)
    monkeypatch.setattr(session, "SLICE_BYTES", 1500)
    assert len(session.sliced(session.settle(df, "all"), "k")) > 1
    out = ordered.rolling_max_level(df, "k", "at", "v", 3, 120, "m", parts=3)
    assert rows_of(out) == whole and kept(spark) == ["all", "levels"]


def test_fused_flows_in_slices(spark, folder, monkeypatch):
    t = queries.Tables(spark, folder)
    fused = fusion.correlate(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores)
    want, flows = rows_of(fused.select(*t.correlated.columns)), rows_of(t.flows)
    assert len(flows) == t.netflow.select("flow_id").distinct().count()
    session.release(spark)
    monkeypatch.setattr(session, "SLICE_BYTES", 6000)
    monkeypatch.setattr(queries, "SLICE_BYTES", 6000)
    t = queries.Tables(spark, folder)
    assert rows_of(t.flows) == flows and len(session.sliced(t.flows, "src_ip")) > 1
    assert rows_of(t.correlated) == want
    assert kept(spark) == ["behavior", "correlation", "flows", "packet"]


def test_full_run_hands_out_all_columns(spark, folder):
    t = queries.Tables(spark, folder)
    tables = full_run.Tables(t.netflow, t.zeek, t.windows_events, t.ueba, t.hosts, t.flow_labels, t.tickets)
    want = fusion.correlate(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores.where("false"))
    out = full_run.fuse_and_respond(t.flows, tables, t.flow_scores, t.packet_scores, t.results.where("false")).correlation
    assert set(out.columns) == set(want.columns) and rows_of(out) == rows_of(want)


def test_cooldown_makes_its_candidates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [("a", "x", "HIGH", f"2024-01-01 00:00:{s:02d}") for s in range(30)]
    found = spark.createDataFrame(rows, "src_ip string, attack_name string, severity string, at string").select(
        "src_ip", "attack_name", "severity", F.to_timestamp("at").alias("alert_time"), *[F.lit(0.5).alias(c) for c in live.ALERT_SCORES]
    )
    out = live.cooled_batch(found.mapInPandas(seen, live.ALERT_SCHEMA), 10)
    assert sorted(r["alert_time"].second for r in out.collect()) == [0, 11, 22] and made.value == 30
