"""Structured Streaming variants: arriving files and event logs."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.duplicates import newest_per_key
from ..session import ship


def arriving_files(spark: SparkSession, root: str) -> DataFrame:
    """New files below root as they come: path, byte_length, modified_at, digest."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("length").alias("byte_length"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("digest"))


def arrivals_against(stream: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stream-static join: arrivals with known, whether the catalogue (digest, byte_length) has their content."""
    known = catalogue.select("digest", "byte_length").distinct().withColumn("known", F.lit(True))
    return stream.join(known, ["digest", "byte_length"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_submissions(stream: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def latest_version(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table that upsert_latest() keeps: of each bucket the version of the last batch that touched it, of
    those below `before` if that is given."""
    paths = [f"{path}/batch=*"] if before is None else [f"{path}/batch={i}" for i in range(before)]
    placed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
    rows = spark.read.option("basePath", path).schema(placed).parquet(*paths)
    last = rows.groupBy("_bucket").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["_bucket", "batch"], "left_semi").select(*schema.names)


def upsert_latest(stream: DataFrame, path: str, keys: list[str], at: str, tie: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep path as the table of each key's newest row, read by latest_version().

    Keys are dealt into buckets; a micro-batch reads and writes only the buckets it touches, as a partition of
    its own id, so repeating a batch after a failure gives the same table."""

    def merge(batch: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        own = newest_per_key(batch, keys, at, tie)
        if n:
            touched = own.select(bucket.alias("_b")).distinct()
            old = latest_version(batch.sparkSession, path, batch.schema, n).withColumn("_b", bucket)
            old = old.join(touched, "_b", "left_semi").drop("_b")
            own = newest_per_key(own.unionByName(old.select(*own.columns)), keys, at, tie)
        own.select(*batch.columns, bucket.alias("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key path has not; each micro-batch is a partition that repeating overwrites."""

    def append(batch: DataFrame, n: int) -> None:
        rows = batch.dropDuplicates([key])
        if n:
            old = batch.sparkSession.read.option("basePath", path).parquet(*[f"{path}/batch={i}" for i in range(n)])
            rows = rows.join(old.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fold(key, batches, state: GroupState):
    n, last, status = state.get if state.exists else (0, "", "")
    for pdf in batches:
        n += len(pdf)
        top = pdf.sort_values(["sequence"]).iloc[-1]
        mark = f"{int(top['sequence']):020d}"
        if mark >= last:
            last, status = mark, top["status"]
    state.update((n, last, status))
    yield pd.DataFrame({"job_id": [key[0]], "events": [n], "status": [status]})


def live_job_state(stream: DataFrame) -> DataFrame:
    """job_id, events, status after each micro-batch; the larger sequence wins over later arrival."""
    ship(stream.sparkSession)
    return stream.select("job_id", "sequence", "status").groupBy("job_id").applyInPandasWithState(_fold, "job_id long, events long, status string", "n long, last string, status string", "update", GroupStateTimeout.NoTimeout)


def stale_workers(stream: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of heartbeats that ended: worker_id, last_beat, beats."""
    s = stream.withWatermark("heartbeat_at", late).groupBy("worker_id", F.session_window("heartbeat_at", gap).alias("w"))
    return s.agg(F.max("heartbeat_at").alias("last_beat"), F.count("*").alias("beats")).drop("w")


class _Heartbeats(StatefulProcessor):
    """A worker's open sessions as one value of packed (first, last, beats), and one event-time timer, for the first end.

    Beats join a session that they lie within gap of, and may join two into one, so arrival in any order gives the
    same sessions. When the timer fires, all sessions that the watermark has reached are told at once, and the timer of
    the next is set: a worker costs one call a batch, however many sessions it has."""

    def __init__(self, gap: timedelta):
        # Sessions are held in microseconds, timers in milliseconds, rounded up: none is early.
        self.gap = int(gap / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _held(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return list(map(tuple, np.frombuffer(held[0], np.int64).reshape(-1, 3).tolist())) if held else []

    def _hold(self, sessions: list[tuple[int, int, int]]) -> None:
        self.open.update((np.array(sessions, np.int64).tobytes(),))

    def _fires(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def _first_end(self, sessions: list[tuple[int, int, int]]) -> int | None:
        return min((self._fires(b) for _, b, _ in sessions), default=None)

    def handleInputRows(self, key, rows, timerValues):
        new = np.sort(np.concatenate([pdf["at"].dropna().to_numpy(np.int64) for pdf in rows]))
        if not len(new):
            return
        held = self._held()
        cuts = np.flatnonzero(np.diff(new) >= self.gap) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(new)]])
        own = zip(new[begin].tolist(), new[end - 1].tolist(), (end - begin).tolist(), strict=True)
        merged: list[tuple[int, int, int]] = []
        for a, b, n in sorted([*held, *own]):
            if merged and a < merged[-1][1] + self.gap:
                c, d, m = merged[-1]
                merged[-1] = (c, max(b, d), m + n)
            else:
                merged.append((a, b, n))
        self._hold(merged)
        before, after = self._first_end(held), self._first_end(merged)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        ended = [x for x in held if self._fires(x[1]) <= at]
        rest = [x for x in held if self._fires(x[1]) > at]
        if rest:
            self._hold(rest)
            self.handle.registerTimer(self._first_end(rest))
        else:
            self.open.clear()
        if ended:
            yield pd.DataFrame({"worker_id": [key[0]] * len(ended), "last": [b for _, b, _ in ended], "beats": [n for _, _, n in ended]})

    def close(self) -> None:
        pass


def expired_workers(stream: DataFrame, gap: timedelta = timedelta(seconds=10), late: str = "1 minute") -> DataFrame:
    """worker_id, last_beat, beats of each session of heartbeats, told by a timer when the watermark reaches its end.

    A worker's silence is told without another beat of its own. State is a worker's open sessions, in
    one value; a replayed stream gives the same rows. Beats without a worker are those of one null worker, beats without
    a time do not count. The session needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider."""
    ship(stream.sparkSession)
    worker = stream.schema["worker_id"].dataType.simpleString()
    beats = stream.withWatermark("heartbeat_at", late).select("worker_id", "heartbeat_at", F.unix_micros("heartbeat_at").alias("at"))
    ended = beats.groupBy("worker_id").transformWithStateInPandas(_Heartbeats(gap), f"worker_id {worker}, last long, beats long", "append", "EventTime")
    return ended.select("worker_id", F.timestamp_micros("last").alias("last_beat"), "beats")
