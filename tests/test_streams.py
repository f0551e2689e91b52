"""Streams: state and its expiry, limits and restarts of the topic, the committed table, lookups in a checkpoint."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyward.sources import topics
from tallyward.streaming import engine, features, packs
from tallyward.streaming import queries as streams

START = datetime(2024, 1, 1)
TX = "transaction_id bigint, user_id bigint, latitude double, longitude double, city string, transaction_ts timestamp"


def run(spark, folder, part, make):
    """One more part of a stream's input, taken to its end."""
    part.write.mode("append").parquet(f"{folder}/in")
    stream = make(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
    engine.to_batches(stream, f"{folder}/out", f"{folder}/check", empty_batches=False).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_ids_stay_themselves(spark):
    rows = [(2**53 + 1, 1, 42.0, -71.0, "a", START), (None, 1, 42.0, -71.0, "b", START + timedelta(minutes=1)), (2**53 + 3, 1, 42.0, -71.0, "c", START + timedelta(minutes=2)), (2**53 + 3, 2, 42.0, -71.0, "c", None)]
    got = streams.locations_of(spark.createDataFrame(rows, TX)).collect()
    assert sorted(((r.transaction_id, r.user_id, r.prev_city) for r in got), key=str) == sorted([(2**53 + 1, 1, None), (None, 1, "a"), (2**53 + 3, 1, "b"), (2**53 + 3, 2, None)], key=str)


@pytest.mark.parametrize("ttl_ms, prev", [(86_400_000, "a"), (500, None)])
def test_places_and_times_expire(spark, tmp_path, ttl_ms, prev):
    first = spark.createDataFrame([(1, 1, 42.0, -71.0, "a", START)], TX).withColumn("error_reason", F.lit(None).cast("string"))
    second = spark.createDataFrame([(2, 1, 42.0, -71.0, "b", START + timedelta(minutes=5))], TX).withColumn("error_reason", F.lit(None).cast("string"))
    make = lambda stream: features.with_history(stream, ttl_ms)
    run(spark, str(tmp_path), first, make)
    time.sleep(2)
    got = {r.transaction_id: (r.prev_city, r.velocity_15min) for r in run(spark, str(tmp_path), second, make).collect()}
    assert got == {1: (None, 1), 2: (prev, 2 if prev else 1)}


def test_history_counts_late_rows_and_passes_errors_by(spark, tmp_path):
    minute = lambda m: START + timedelta(minutes=m)
    rows = lambda *xs: spark.createDataFrame([(i, 1, 42.0, -71.0, c, minute(m), e) for i, c, m, e in xs], TX + ", error_reason string")
    run(spark, str(tmp_path), rows((1, "a", 0, None), (2, "b", 10, None), (3, "x", 11, "amount_negative"), (4, "c", 10, None)), features.with_history)
    got = run(spark, str(tmp_path), rows((5, "d", 15, None), (6, "late", 9, None), (7, "e", 26, None)), features.with_history)
    assert {r.transaction_id: (r.velocity_15min, r.prev_city) for r in got.collect()} == {1: (1, None), 2: (3, "a"), 3: (None, None), 4: (3, "b"), 6: (2, "c"), 5: (5, "late"), 7: (2, "d")}


def test_lookups_equal_the_streams_own_output(spark, tmp_path):
    tx = spark.createDataFrame([(i, i % 3, 42.0, -71.0, f"c{i}", START + timedelta(minutes=i)) for i in range(40)], TX)
    folder = str(tmp_path)
    tx.write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(tx.schema).parquet(f"{folder}/in")
    engine.to_batches(engine.place_stream(stream()), f"{folder}/places", f"{folder}/p", empty_batches=False).awaitTermination()
    engine.to_batches(engine.velocity_stream(stream()), f"{folder}/windows", f"{folder}/w", "update").awaitTermination()
    users = spark.createDataFrame([(0,), (1,), (2,), (77,)], "user_id bigint")
    assert {r.user_id: r.city for r in engine.last_places(spark, f"{folder}/p", users).collect()} == {0: "c39", 1: "c37", 2: "c38", 77: None}
    windows = engine.latest_windows(spark.read.parquet(f"{folder}/windows"))
    want = {r.user_id: r.n for r in windows.groupBy("user_id").agg(F.max_by("n", "window_end").alias("n")).collect()}
    assert {r.user_id: r.n for r in engine.last_counts(spark, f"{folder}/w", users).collect()} == want | {77: 0}


def test_places_of_many_users_are_one_state_row_a_group(spark, tmp_path):
    folder, n = str(tmp_path), 3000
    rows = lambda city, low: spark.range(n).select((F.col("id") + low).alias("transaction_id"), F.col("id").alias("user_id"), F.lit(42.0).alias("latitude"), F.lit(-71.0).alias("longitude"), F.concat(F.lit(city), F.col("id")).alias("city"), F.timestamp_seconds(F.col("id") + low).alias("transaction_ts"))
    run(spark, folder, rows("a", 0), engine.place_stream)
    got = run(spark, folder, rows("b", n).where("user_id % 2 = 0"), engine.place_stream).where(f"transaction_id >= {n}")
    assert {(r.user_id, r.prev_city, r.prev_at) for r in got.collect()} == {(i, f"a{i}", i * 1_000_000) for i in range(0, n, 2)}
    assert spark.read.format("statestore").option("path", f"{folder}/check").option("stateVarName", "place").load().count() <= packs.GROUPS < n
    found = engine.last_places(spark, f"{folder}/check", spark.range(n + 1).withColumnRenamed("id", "user_id")).collect()
    assert {r.user_id: r.city for r in found} == {i: f"{'ab'[i % 2 == 0]}{i}" for i in range(n)} | {n: None}


def test_histories_of_many_users_are_one_state_row_a_group(spark, tmp_path):
    folder, n = str(tmp_path), 3000
    rows = lambda city, minute: spark.range(n).select((F.col("id") + n * minute).alias("transaction_id"), F.col("id").alias("user_id"), F.lit(42.0).alias("latitude"), F.lit(-71.0).alias("longitude"), F.lit(city).alias("city"), F.timestamp_seconds(F.lit(60 * minute)).alias("transaction_ts"), F.when((F.col("id") % 5 == 0) & F.lit(minute == 1), "amount_negative").alias("error_reason"))
    run(spark, folder, rows("a", 0).unionAll(rows("b", 1)), features.with_history)
    got = run(spark, folder, rows("c", 16), features.with_history).where("city = 'c'").collect()
    assert {(r.user_id, r.velocity_15min, r.prev_city) for r in got} == {(i, 1 if i % 5 == 0 else 2, "a" if i % 5 == 0 else "b") for i in range(n)}
    assert spark.read.format("statestore").option("path", f"{folder}/check").option("stateVarName", "recent").load().count() <= packs.GROUPS < n


def test_scoring_knows_users_by_one_row(spark, tmp_path):
    tx = spark.createDataFrame([(i, u, d, 10.0, "a", 42.0, -71.0, "US", START + timedelta(hours=i), False, None) for i, u, d in [(1, 1, 11), (2, 1, 12), (3, 2, 21), (4, 3, 31), (5, 1, None)]], features.MESSAGE.replace("transaction_ts string", "transaction_ts timestamp"))
    base = spark.createDataFrame([(1, 8.0, 2.0), (None, 1.0, 1.0)], "user_id bigint, avg_amount double, stddev_amount double")
    trusted = spark.createDataFrame([(1, 11), (1, 11), (1, 13), (2, 21), (None, 31)], "user_id bigint, device_id bigint")
    known = features.known_users(base, trusted).localCheckpoint()
    got = run(spark, str(tmp_path), features.as_messages(tx), lambda stream: features.feature_stream(stream, known)).collect()
    assert {(r.transaction_id, r.is_new_device, r.user_avg_amount) for r in got} == {(1, False, 8.0), (2, True, 8.0), (3, False, 50.0), (4, True, 50.0), (5, False, 8.0)} and len(got) == 5


def test_windows_come_from_panes(spark, tmp_path):
    """State has a row a minute and user, not one for each of the 15 windows, and late rows count where they still may."""
    rng, folder, seen, mark = random.Random(7), str(tmp_path), [], None
    want, kind = {}, "user_id string, transaction_ts timestamp"
    for part in range(4):
        rows = [(rng.choice(["a", "b", None]), START + timedelta(minutes=40 * part - rng.choice([0, 0, 11, 22, 80]), seconds=rng.randrange(2400))) for _ in range(60)] + [("a", None)]
        for user, at in (r for r in rows if r[1]):
            first = at.replace(second=0) - timedelta(minutes=14)
            for start in (first + timedelta(minutes=m) for m in range(15)):
                if mark is None or start + timedelta(minutes=15) > mark:
                    want[user, start] = want.get((user, start), 0) + 1
        seen += [at for _, at in rows if at]
        mark = max(seen) - timedelta(minutes=10)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(kind).parquet(f"{folder}/in")
        engine.to_batches(engine.velocity_stream(stream), f"{folder}/out", f"{folder}/check", "update").awaitTermination()
    got = engine.latest_windows(spark.read.parquet(f"{folder}/out")).collect()
    assert {(r.user_id, r.window_start): r.n for r in got} == want and all(r.window_end - r.window_start == timedelta(minutes=15) for r in got)
    state = spark.read.format("statestore").option("path", f"{folder}/check").option("stateVarName", "panes").load()
    assert 1 <= state.count() <= 3  # one row a group; windows would be dozens
    panes = [r.pane for r in engine.held_rows(spark, f"{folder}/check", "panes", "user_id string, pane bigint, n bigint").collect()]
    assert min(panes) * 60 + 900 > (mark - datetime(1970, 1, 1)).total_seconds()  # what the watermark has passed is let go


def test_parts_come_one_a_trigger_and_whole(spark):
    tx = spark.range(0, 900, 1, 6).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.when(F.col("id") > 0, 900 - F.col("id"))).alias("transaction_ts"))
    folder = streams._in_turn(streams._ranged(tx, 250), lambda stream: stream)
    got = spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_ts").alias("low"), F.max("transaction_ts").alias("high")).orderBy("batch").collect()
    assert len(got) == 4 and sum(r.n for r in got) == 900 and max(r.n for r in got) <= 260
    assert all(a.high < b.low for a, b in zip(got, got[1:]))


def messages(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), F.col("id") % 17).alias("key"), F.col("id").cast("string").alias("value"))


def batches_of(path):
    return [json.load(open(f"{path}/batches/{f}")) for f in sorted(os.listdir(f"{path}/batches"))]


def test_topic_limits_and_restarts(spark, tmp_path):
    topic, table, check = (str(tmp_path / x) for x in ("topic", "table", "check"))
    start = lambda: engine.table_stream(topics.topic_stream(spark, topic, "g", 100), table, check)
    topics.append_to_topic(messages(spark, 0, 730), topic, partitions=5)
    running = start()
    while not os.path.isdir(f"{table}/batches") or len(os.listdir(f"{table}/batches")) < 2:
        time.sleep(0.1)
    running.stop()  # wherever it is by now
    topics.append_to_topic(messages(spark, 730, 900), topic, partitions=5)
    os.makedirs(f"{topic}/segment=000000009/partition=0")  # an append that has not been committed
    engine.stop_in_order([start()])
    engine.stop_in_order([start()])  # nothing new
    rows = [b["rows"] for b in batches_of(table)]
    assert max(rows) <= 100 and sum(rows) == 900 and len(rows) >= 9
    got = topics.committed(spark, table, "partition int, offset bigint, key string, value string").collect()
    assert sorted(int(r.value) for r in got) == list(range(900))
    by_part = {}
    for r in got:
        by_part.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(x) == list(range(len(x))) for x in by_part.values())


def test_topic_triggers_read_the_groups_they_need(spark, tmp_path, monkeypatch):
    for name, n in (("GROUP_ROWS", 50), ("SEGMENT_FILE_ROWS", 400), ("TASK_ROWS", 100)):
        monkeypatch.setattr(topics, name, n)
    path, read = str(tmp_path / "topic"), []
    topics.append_to_topic(messages(spark, 0, 3000), path, partitions=3)
    stream = topics.TopicStream({"path": path, "maxOffsetsPerTrigger": "150"})
    real = topics.pq.ParquetFile.read_row_groups
    monkeypatch.setattr(topics.pq.ParquetFile, "read_row_groups", lambda self, groups, **kw: read.append(len(groups)) or real(self, groups, **kw))
    at, got, tasks = stream.initialOffset(), [], []
    while (end := stream.latestOffset()) != at:
        planned = stream.partitions(at, end)
        tasks.append(len(planned))
        sizes = []
        for task in planned:
            rows = [int(v) for b in stream.read(task) for v in b.column("value").to_pylist()]
            sizes.append(len(rows))
            got += rows
        assert sum(sizes) <= 150 and max(sizes) <= 100
        at = end
    assert sorted(got) == list(range(3000)) and max(tasks) == 2  # not one for each partition
    assert sum(read) * 50 <= 3 * 3000  # a trigger's own groups, not whole files again and again


def test_committed_table_is_whole_or_nothing(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id bigint"
    topics.append_committed(spark.range(10).repartition(3), path, "first", rows_per_file=2)
    topics.append_committed(spark.range(10).repartition(3), path, "first")  # the same batch again
    assert sorted(r.id for r in topics.committed(spark, path, kind).collect()) == list(range(10))
    files = os.listdir(f"{path}/data")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="broken|aborted|WRITING_JOB_ABORTED"):
        topics.append_committed(bad, path, "second")
    assert topics.committed(spark, path, kind).count() == 10 and "first" in json.dumps(os.listdir(f"{path}/batches")) and len(os.listdir(f"{path}/batches")) == 1
    topics.append_committed(spark.range(10, 12), path, "second")
    assert topics.committed(spark, path, kind).count() == 12 and set(files) <= set(os.listdir(f"{path}/data"))
    assert topics.committed(spark, str(tmp_path / "none"), kind).count() == 0
