"""A stream run to its end gives what a batch gives."""

from datetime import datetime, timedelta

import pandas as pd

from filelake.operators.duplicates import newest_per_key
from filelake.streaming.streams import _Heartbeats, append_new, arriving_files, expired_workers, latest_version, live_job_state, upsert_latest


def test_upsert_and_append(spark, tmp_path):
    rows = [(i % 3, i, f"s{i}") for i in range(12)]
    batch = spark.createDataFrame(rows, "job_id long, sequence long, status string")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = upsert_latest(stream(), str(tmp_path / "t"), ["job_id"], "sequence", "status", str(tmp_path / "c1"))
    q.awaitTermination()
    got = sorted(map(tuple, latest_version(spark, str(tmp_path / "t"), batch.schema).collect()))
    assert got == sorted(map(tuple, newest_per_key(batch, ["job_id"], "sequence", "status").select("job_id", "sequence", "status").collect()))
    append_new(stream(), str(tmp_path / "a"), "sequence", str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 12


def test_job_state(spark, tmp_path):
    batch = spark.createDataFrame([(i % 3, i, f"s{i}") for i in range(12)], "job_id long, sequence long, status string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = live_job_state(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == [(0, 4, "s9"), (1, 4, "s10"), (2, 4, "s11")]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"aaaa")
    q = arriving_files(spark, str(tmp_path / "f")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").first()["byte_length"] == 4


def test_expired_workers(spark, tmp_path):
    """Sessions told by timers: late beats join two sessions, a silent worker needs no beat of its own, nulls have a place."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    files = [
        [("a", at(0)), ("a", at(15)), ("b", at(0)), (None, at(3)), ("c", None)],  # two sessions of a, one of b
        [("a", at(8)), ("z", at(30))],  # the two are one
        [("z", at(100))],  # time goes on for a and b
        [("b", at(101)), ("b", at(102)), ("z", at(300))],
        [("z", at(301))],
    ]
    for i, rows in enumerate(files):
        own.createDataFrame(rows, "worker_id string, heartbeat_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    results = []
    for run in range(2):
        told = []
        for i in range(len(files)):  # files come one after another, each in a run of its own over the same checkpoint
            target = tmp_path / f"src{run}/{i}.parquet"
            target.parent.mkdir(exist_ok=True)
            next((tmp_path / f"in/{i}").glob("*.parquet")).rename(target) if run else target.write_bytes(next((tmp_path / f"in/{i}").glob("*.parquet")).read_bytes())
            stream = own.readStream.schema("worker_id string, heartbeat_at timestamp").parquet(str(target.parent))
            keep = lambda batch, n, told=told, i=i: told.extend((i, *r) for r in batch.collect())
            expired_workers(stream, timedelta(seconds=10), "40 seconds").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"log{run}")).trigger(availableNow=True).start().awaitTermination()
        results.append(sorted(told, key=str))
    assert results[0] == results[1]
    assert {x[1:] for x in results[0]} == {("a", at(15), 3), ("b", at(0), 1), (None, at(3), 1), ("z", at(30), 1), ("b", at(102), 2), ("z", at(100), 1)}
    assert {x[0] for x in results[0] if x[1] in ("a", None)} == {2}


def test_a_worker_has_one_timer():
    """However many sessions a worker has, one timer stands for them, and one call tells all that ended."""

    class Handle:
        held, timers = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    h, p = Handle(), _Heartbeats(timedelta(seconds=10))
    p.init(h)
    beats = pd.DataFrame({"at": [60_000_000 * i for i in range(1000, 0, -1)]})
    assert not list(p.handleInputRows(("w",), iter([beats[:400], beats[400:]]), Now(0)))
    assert h.timers == [70_000]
    told = list(p.handleExpiredTimer(("w",), Now(30_010_000), Now(h.timers.pop())))
    assert len(told) == 1 and told[0]["last"].tolist() == [60_000_000 * i for i in range(1, 501)] and h.timers == [501 * 60_000 + 10_000]
    list(p.handleInputRows(("w",), iter([pd.DataFrame({"at": [501 * 60_000_000 + 5_000_000, None]})]), Now(30_010_000)))
    assert h.timers == [501 * 60_000 + 15_000]
    told = list(p.handleExpiredTimer(("w",), Now(10**9), Now(h.timers.pop())))
    assert told[0]["beats"].sum() == 501 and not h.timers and h.held is None
