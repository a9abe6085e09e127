"""Streams over several files, one per micro-batch and out of order, against their batch twins."""

import glob
import os
import random

from pyspark.sql import functions as F

from threatlens.session import fresh_folder
from threatlens.streaming import live

SCORED = (
    "src_ip string, attack_name string, live_severity string, s long, correlation_score double, flow_score double,"
    " behavior_score double, packet_score double"
)


def append(df, folder):
    """One more file, dated a minute after the one before, so that streams take the files in order."""
    path = folder.removeprefix("file://")
    before = set(glob.glob(f"{path}/*.parquet"))
    df.coalesce(1).write.mode("append").parquet(folder)
    for file in set(glob.glob(f"{path}/*.parquet")) - before:
        os.utime(file, times=(60 * len(before), 60 * len(before)))


def scored_rows(seed=3):
    rng = random.Random(seed)
    rows = [
        (f"10.0.0.{rng.randrange(3)}", rng.choice(["scan", "beacon", None]), "HIGH", 1704067200 + rng.randrange(1500),
         rng.random(), rng.random(), rng.random(), rng.random())
        for _ in range(500)
    ]
    # The flow that closes the stream is no alert.
    return sorted(rows, key=lambda r: r[3]), ("10.9.9.9", None, None, 1704067200 + 9000, 0.0, 0.0, 0.0, 0.0)


def test_cooldown_over_batches_out_of_order(spark):
    rows, last = scored_rows()
    folder = fresh_folder(spark, "files")
    chunks = [rows[:100], rows[150:300], rows[100:150], rows[400:], rows[300:400], [last]]
    for chunk in chunks:
        append(spark.createDataFrame(chunk, SCORED), folder)

    def stream(own):
        files = own.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(folder)
        return live.cooled_stream(files.withColumn("start_time", F.timestamp_seconds("s")).drop("s"), "20 minutes")

    got = live.run_to_table(stream, spark, "cooled-test", partitions=4)
    flows = spark.createDataFrame(rows, SCORED).withColumn("start_time", F.timestamp_seconds("s"))
    want = live.cooled_batch(live.alert_candidates(flows))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_emitted_jumps():
    import numpy as np

    rng = random.Random(1)
    times = sorted(rng.randrange(1000) for _ in range(200))
    want, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last > 30:
            want.append(i)
            last = t
    assert live.emitted(np.array(times), 30) == want
    assert live.emitted(np.array(times), 30, times[-1]) == []


def test_rate_windows_leave_the_state(spark):
    folder = fresh_folder(spark, "flows")
    base = 1704067200
    for chunk in ([0, 5, 61], [30, 119], [4000]):
        append(spark.createDataFrame([("a", base + s) for s in chunk], "src_ip string, s long"), folder)

    def stream(own):
        files = own.readStream.schema("src_ip string, s long").option("maxFilesPerTrigger", 1).parquet(folder)
        flows = files.select("src_ip", F.timestamp_seconds("s").alias("start_time"), F.lit("SWIFT").alias("segment"), F.lit(1433).alias("dst_port"))
        return live.rate_windows(flows)

    got = {r["s"] - base: r["n_queries"] for r in live.run_to_table(stream, spark, "rates-test", partitions=2).withColumn("s", F.unix_seconds("window_start")).collect()}
    times = [0, 5, 61, 30, 119]
    want = {s: sum(s <= t < s + 120 for t in times) for s in range(-120, 130, 10)}
    assert got == {s: n for s, n in want.items() if n}


LINES = "a string, b string, c string"


def put(path, data):
    with open(path, "ab") as file:
        file.write(data)


def test_growing_files_deliver_each_whole_line_once(spark, tmp_path, monkeypatch):
    """Appended lines, half a line and its rest, a new file and a restart, read in ranges of a few bytes."""
    from threatlens.sources import growing

    monkeypatch.setattr(growing, "RANGE_BYTES", 7)
    monkeypatch.setattr(growing, "BLOCK_BYTES", 5)
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()

    def step():
        stream = growing.follow_lines(spark, str(log), LINES)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted((r["a"], r["b"], r["c"]) for r in spark.read.schema(LINES).parquet(out).collect())

    put(log / "one.csv", b"1,x,y\n2,,z\nshort,line\n3,much longer than a range of bytes,z\r\n4,ha")
    want = [("1", "x", "y"), ("2", None, "z"), ("3", "much longer than a range of bytes", "z")]
    assert step() == want
    assert step() == want
    put(log / "one.csv", b"lf")
    put(log / "two.csv", b'5,"a, b",c\n\n')
    put(log / "_hidden", b"6,x,y\n")
    want.append(("5", "a, b", "c"))
    assert step() == want
    put(log / "one.csv", b"-line,\xc3\xa9\n7,x")
    want.append(("4", "half-line", "\u00e9"))
    assert step() == sorted(want)
    put(log / "one.csv", b",y\n1,2,3,4\n")
    want.append(("7", "x", "y"))
    assert step() == sorted(want)


def test_ranges_of_a_file_hold_each_line_once(tmp_path):
    from threatlens.sources import growing

    rng = random.Random(2)
    data = b"".join(b"x" * rng.randrange(12) + b"\n" for _ in range(200))
    put(tmp_path / "f", data + b"open end")
    store, path = growing.store_of(str(tmp_path / "f"))
    assert growing.whole_lines(store, path, len(data) + 8) == len(data)
    for size in (1, 2, 3, 10, 64, 5000):
        cuts = [*range(0, len(data), size), len(data)]
        ranges = [growing.LineRange(path, a, b, a == 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        got = [line for r in ranges for line in growing.lines_of(r, store, len(data))]
        assert got == data.split(b"\n")[:-1]


def test_header_is_left_out_and_shrunken_files_are_refused(spark, tmp_path):
    import pytest

    from threatlens.sources import growing

    put(tmp_path / "h.csv", b"a,b,c\n1,2,3\n")
    schema = spark.createDataFrame([], LINES).schema
    reader = growing.GrowingLines(schema, {"path": str(tmp_path / "h.csv"), "header": "true"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert [b.to_pylist() for p in parts for b in reader.read(p)] == [[{"a": "1", "b": "2", "c": "3"}]]
    (tmp_path / "h.csv").write_bytes(b"a\n")
    with pytest.raises(ValueError):
        reader.latestOffset()
    with pytest.raises(ValueError):
        reader.partitions(end, {path: 1 for path in end})
    nothing = growing.GrowingLines(schema, {"path": str(tmp_path / "absent")})
    assert nothing.latestOffset() == {} and nothing.partitions({}, {}) == []


def test_arrival_rates_are_those_of_the_rolling_count(spark):
    """Per arrival, over batches out of order; state holds no source that the watermark has left."""
    from pyspark.sql import Window

    from threatlens.operators import flow_features as ff

    rng = random.Random(11)
    base, rows = 1704067200, []
    for i in range(400):
        second = rng.randrange(900) if i % 3 else 300 + rng.randrange(3)
        rows.append((f"f{i}", f"10.0.0.{rng.choice([1, 1, 1, 2, 3])}", 1_000_000 * (base + second) + rng.choice([0, 0, 500_000])))
    rows.sort(key=lambda r: r[2])
    last = ("end", "10.9.9.9", 1_000_000 * (base + 9000))
    schema, folder = "flow_id string, src_ip string, us long", fresh_folder(spark, "files")
    for chunk in (rows[:90], rows[140:250], rows[90:140], rows[330:], rows[250:330], [last]):
        append(spark.createDataFrame(chunk, schema), folder)

    def flows(df):
        return df.withColumns({
            "start_time": F.timestamp_micros("us"), "segment": F.lit("SWIFT"), "dst_port": F.lit(1433),
        }).drop("us")

    def stream(own):
        files = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return live.arrival_rates(flows(files), "20 minutes")

    got = live.run_to_table(stream, spark, "arrivals-test", partitions=3)
    whole = flows(spark.createDataFrame(rows, schema))
    order = Window.partitionBy("src_ip", "start_time").orderBy(F.substring(F.md5("flow_id"), 1, 2), "flow_id")
    per_flow = whole.withColumn("k", F.row_number().over(order)).join(got, ["src_ip", "start_time"]).select(
        "flow_id", (F.col("count_2min") - F.col("n_arrivals") + F.col("k")).alias("count_2min")
    )
    want = ff.swift_rolling_counts(whole).select("flow_id", "count_2min")
    assert sorted(map(tuple, per_flow.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("src_ip = '10.9.9.9'").count() == 0


def test_trailing_state_is_cleared(spark):
    """After the watermark has left the last arrivals of a source, no state row of it is left."""
    from threatlens.session import stream_session

    base, schema, folder = 1704067200, "src_ip string, s long", fresh_folder(spark, "files")
    for chunk in ([("a", 0), ("b", 5), ("a", 60)], [("c", 4000)], [("c", 8000)], [("c", 12000)]):
        append(spark.createDataFrame([(ip, base + s) for ip, s in chunk], schema), folder)
    own = stream_session(spark, 2)
    files = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    flows = files.select("src_ip", F.timestamp_seconds("s").alias("start_time"), F.lit("SWIFT").alias("segment"), F.lit(1433).alias("dst_port"))
    query = (
        live.arrival_rates(flows).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", fresh_folder(spark, "state")).trigger(availableNow=True).start(fresh_folder(spark, "out"))
    )
    query.awaitTermination()
    # What is left belongs to the last source alone: its newest instant, and the one before with its timer.
    assert [op["operatorName"] for op in query.lastProgress["stateOperators"]]
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) <= 4


def test_keyed_list_compacts_and_is_safe_to_replay(spark):
    from threatlens.streaming.keyed_list import ROWS, KeyedList

    rng, path = random.Random(7), fresh_folder(spark, "list")
    known, history = {}, []
    kept = KeyedList(spark, path, compact_after=4)
    for batch in range(40):
        rows = [(f"s{rng.randrange(12)}", 10 * batch + rng.randrange(5), rng.random() < 0.7) for _ in range(rng.choice([0, 1, 4]))]
        history.append(dict(known))
        for ip, at, present in rows:
            if (at, not present) >= known.get(ip, (-1, False)):
                known[ip] = (at, not present)
        frame = spark.createDataFrame(rows, "src_ip string, s long, present boolean").select(
            "src_ip", F.timestamp_seconds("s").alias("time"), "present").coalesce(1)
        assert kept.add(batch, frame)
        assert kept.n_parts() <= 6
        if batch % 9 == 4:  # run again: nothing is added, and the list before the batch can still be read
            assert not kept.add(batch, frame)
            before = {(r["src_ip"], r["time"].timestamp()) for r in kept.members(before=batch).collect()}
            assert before == {(ip, at) for ip, (at, off) in history[-1].items() if not off}
    got = {(r["src_ip"], r["time"].timestamp()) for r in kept.members().collect()}
    assert got == {(ip, at) for ip, (at, off) in known.items() if not off}
    parts = os.listdir(f"{path.removeprefix('file://')}/parts")
    versions = [v for v in os.listdir(f"{path.removeprefix('file://')}/versions") if v.isdigit()]
    assert len(versions) == 2 and len(parts) <= 8
    torn = f"{path.removeprefix('file://')}/versions/{max(map(int, versions)) + 1}"
    with open(torn, "w") as file:
        file.write('{"batch": 4')
    assert {(r["src_ip"], r["time"].timestamp()) for r in KeyedList(spark, path).members().collect()} == got
    assert kept.add(40, spark.createDataFrame([], ROWS)) and kept.current()[1]["batch"] == 40


def test_unblocked_sources_leave_the_kept_list_and_may_come_back(spark):
    from threatlens.streaming.keyed_list import KeyedList

    path = fresh_folder(spark, "list")
    kept = KeyedList(spark, path)

    def rows(*values):
        return spark.createDataFrame(values, "src_ip string, s long").select("src_ip", F.timestamp_seconds("s").alias("t"))

    def names():
        return sorted(r["src_ip"] for r in kept.members().collect())

    kept.add(0, rows(("a", 10), ("b", 10)).select("src_ip", F.col("t").alias("time"), F.lit(True).alias("present")))
    live.unblock(spark, path, rows(("a", 20), ("b", 5)).withColumnRenamed("t", "unblock_time"))
    assert names() == ["b"]
    kept.add(1, rows(("a", 30)).select("src_ip", F.col("t").alias("time"), F.lit(True).alias("present")))
    assert names() == ["a", "b"]
