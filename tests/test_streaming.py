"""Streams against their batch forms."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.sources import upsert
from evidentia.streaming import status

EVENTS = [(1, ["whois", "ssl"], None, None), (1, ["whois", "ssl"], "whois", True), (1, ["whois", "ssl"], "ssl", True), (2, ["tech"], "tech", False), (3, ["tech", "ssl"], "ssl", True)]
SCHEMA = "scan_id long, requested array<string>, collector string, ok boolean"


def test_scan_states(spark):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    scans = events.select(events.scan_id.alias("id"), "requested").dropDuplicates(["id"]).union(spark.createDataFrame([(4, ["ssl"])], "id long, requested array<string>"))
    states = {r.id: r.status for r in status.scan_states(scans, events.filter("collector is not null").select("scan_id", "collector", "ok")).collect()}
    assert states == {1: "completed", 2: "partial", 3: "running", 4: "pending"}


def test_first_success(spark):
    tries = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, "y"), ("a", 3, True, "z"), ("b", 1, False, "p"), ("b", 2, False, "q"), ("b", 4, True, "late")], "s string, attempt int, ok boolean, result string")
    assert {r.s: (r.result, r.ok) for r in status.first_success(tries, "s").collect()} == {"a": ("y", True), "b": ("q", False)}


def test_scan_machine(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(EVENTS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    try:
        out = status.replay(spark, status.scan_machine(stream), "update", str(tmp_path / "out"))
        assert {r.scan_id: r.status for r in out.collect()} == {1: "completed", 2: "partial", 3: "running"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_failed_scan(spark):
    scans = spark.createDataFrame([(1, ["ssl"], "kapot"), (2, ["ssl"], None)], "id long, requested array<string>, error string")
    done = spark.createDataFrame([(1, "ssl", True), (2, "ssl", True)], "scan_id long, collector string, ok boolean")
    assert {r.id: r.status for r in status.scan_states(scans, done).collect()} == {1: "failed", 2: "completed"}


def test_scan_queue_keeps_errors_apart_and_stops(spark):
    rows = spark.createDataFrame([(k, k, 4 - k) for k in range(8)], "shop_id long, place long, divisor long")
    out = {r.shop_id: (r.status, r.result) for r in status.scan_queue(rows, lambda r: str(12 // r["divisor"]), abort_at=6).collect()}
    assert out == {0: ("ok", "3"), 1: ("ok", "4"), 2: ("ok", "6"), 3: ("ok", "12"), 4: ("error", "integer division or modulo by zero"), 5: ("ok", "-12")}
    assert status.scan_queue(rows.limit(0), lambda r: "").count() == 0


def test_fold_latest_over_several_batches_and_starts(spark, tmp_path):
    schema = "id long, shop_id long, is_online boolean, response_ms double, checked_at timestamp"

    def arrive(*rows):
        spark.createDataFrame([(i, shop, True, float(i), None) for i, shop, _ in rows], schema).drop("checked_at").join(
            spark.createDataFrame([(i, at) for i, _, at in rows], "id long, at long").selectExpr("id", "timestamp_seconds(at) AS checked_at"), "id"
        ).select("id", "shop_id", "is_online", "response_ms", "checked_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def folded():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {r.shop_id: r.id for r in status.fold_latest(spark, stream, str(tmp_path / "out")).collect()}

    arrive((1, 1, 10), (2, 2, 50))
    arrive((3, 1, 20), (4, 2, 40))
    arrive((5, 3, 5))
    assert folded() == {1: 3, 2: 2, 3: 5}
    assert folded() == {1: 3, 2: 2, 3: 5}
    arrive((6, 1, 15), (7, 3, 5))
    assert folded() == {1: 3, 2: 2, 3: 7}


# --- time-outs, repetitions, sessions and stored state


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


def _continued(spark, stream, folder):
    """What a query gives for what is new, from the state that it left."""
    rows = str(folder / f"rows-{len(list(folder.iterdir()))}")
    spark.createDataFrame([], stream.schema).write.parquet(rows)
    write = lambda batch, number: batch.write.mode("append").parquet(rows)
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)


def test_silent_scans_fail_and_are_forgotten(spark, tmp_path, rocks):
    schema = SCHEMA + ", at timestamp"
    batches = [
        [(1, ["whois", "ssl"], "whois", True, at(0)), (2, ["tech"], "tech", True, at(0)), (3, ["ssl"], None, None, at(5))],
        [(1, ["whois", "ssl"], None, None, at(30)), (4, ["ssl"], None, None, at(40))],
        [(5, ["ssl"], "ssl", True, at(200))],  # more than an hour after all others
        [(1, ["whois", "ssl"], "ssl", True, at(50)), (3, ["ssl"], "ssl", True, at(195)), (6, ["ssl"], "ssl", True, at(400))],  # the first is too late, the second begins anew
        [(7, ["ssl"], "ssl", True, at(800))],
    ]
    folder = str(tmp_path / "in")
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        states = status.timed_scan_machine(stream)
        seen = len(out)
        # replay keeps what earlier calls wrote only while its folder does: each call has one, all share the query's state.
        out += sorted((r.scan_id, r.status) for r in _continued(spark, states, tmp_path).collect())
        assert len(out) > seen
    assert out[:3] == [(1, "running"), (2, "completed"), (3, "pending")]
    assert [x for x in out if x[1] == "failed"] == [(1, "failed"), (3, "failed"), (4, "failed")]
    after = out[out.index((5, "completed")) :]
    assert (3, "completed") in after and (1, "completed") not in out and out.count((2, "completed")) == 1


def test_timed_states_of_tables(spark):
    scans = spark.createDataFrame([(1, ["a"], at(0)), (2, ["a"], at(0)), (3, ["a"], at(50)), (4, ["a", "b"], at(0))], "id long, requested array<string>, begun timestamp")
    done = spark.createDataFrame([(1, "a", True, at(1)), (4, "a", True, at(70))], "scan_id long, collector string, ok boolean, at timestamp")
    found = {r.id: r.status for r in status.timed_scan_states(scans, done, F.lit(at(100))).collect()}
    assert found == {1: "completed", 2: "failed", 3: "pending", 4: "running"}


def test_repeated_checks_count_once(spark, tmp_path):
    schema, folder = "id long, shop_id long, is_online boolean, response_ms double, checked_at timestamp", str(tmp_path / "in")
    first = [(k, k % 3, True, 1.0, at(k)) for k in range(20)]
    for rows in (first, [*first[5:9], (30, 1, False, 2.0, at(25))], [first[12], (30, 1, False, 2.0, at(25)), (31, 2, True, 3.0, at(26))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = status.replay(spark, status.distinct_checks(stream), "append", str(tmp_path / "out"))
    table = status.distinct_checks(spark.read.parquet(folder))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, table.collect())) and found.count() == 22


def test_sessions_and_time_left(spark, tmp_path):
    rows = [("a", at(m)) for m in (0, 10, 20, 51, 55)] + [("b", at(0))] + [("c", at(m)) for m in (0, 30, 100, 101)]
    sessions = sorted(map(tuple, status.work_sessions(spark.createDataFrame(rows, "job string, at timestamp"), "job", "at").collect()))
    assert sessions == [("a", at(0), at(20), 3), ("a", at(51), at(55), 2), ("b", at(0), at(0), 1), ("c", at(0), at(30), 2), ("c", at(100), at(101), 2)]
    frame = spark.createDataFrame(sessions, "job string, begun timestamp, ended timestamp, done long")
    left = {r.job: (r.done, r.left, r.elapsed, r.eta) for r in status.time_left(frame, "job", F.lit(10)).collect()}
    assert left["a"] == (5, 5, 1440.0, 1440.0) and left["b"] == (1, 9, 0.0, None) and left["c"][:2] == (4, 6)
    # The stream gives the same sessions, but for the last of each job, which is still open.
    for part in (rows[:6], rows[6:], [("z", at(900))], [("z", at(901))]):
        spark.createDataFrame(part, "job string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = status.replay(spark, status.work_sessions(stream, "job", "at"), "append", str(tmp_path / "out"))
    assert sorted(map(tuple, found.filter("job <> 'z'").collect())) == sessions


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def test_upsert_writes_touched_buckets_only_and_twice_the_same(spark, tmp_path):
    folder, schema = str(tmp_path / "shops"), "id long, name string, level int"
    put = lambda rows, number, **x: upsert.upsert(spark.createDataFrame(rows, schema), number, folder, "id", [], **x)
    put([(k, f"s{k}", 0) for k in range(200)], 0)
    before = files(folder)
    put([(7, "new", 1), (900, None, 2), (7, "older", 0)], 1)
    fresh = files(folder) - before
    assert before <= files(folder) and 1 <= len({f.split("/")[0] for f in fresh}) <= 2 and all("_batch=1" in f for f in fresh)
    rows = lambda: {r.id: (r.name, r.level) for r in upsert.stored(spark, folder, schema).collect()}
    wanted = {k: (f"s{k}", 0) for k in range(200)} | {7: ("older", 0), 900: (None, 2)}
    assert rows() == wanted
    put([(7, "new", 1), (900, None, 2), (7, "older", 0)], 1)
    assert rows() == wanted and upsert.stored(spark, folder, schema).count() == 201
    put([], 2)
    put([(None, "nobody", 1), (8, "acht", 8)], 3)
    assert rows() == wanted | {None: ("nobody", 1), 8: ("acht", 8)}
    assert {r.id for r in upsert.stored(spark, folder, schema, before=1).collect()} == set(range(200))


def test_upsert_keeps_the_later_row(spark, tmp_path):
    folder, schema = str(tmp_path / "checks"), "id long, at long, v string"
    for number, rows in enumerate([[(1, 5, "a"), (2, 5, "b")], [(1, 4, "late"), (2, 6, "c")], [(1, 5, "same time")]]):
        upsert.upsert(spark.createDataFrame(rows, schema), number, folder, "id", ["at"])
    assert {r.id: r.v for r in upsert.stored(spark, folder, schema).collect()} == {1: "same time", 2: "c"}
