"""Audit chains, job events, root events, and merging of tables by key."""

from __future__ import annotations

from functools import reduce

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .duplicates import newest_per_key

# Which job statuses may follow which.
TRANSITIONS = {"queued": "running paused cancelled", "running": "queued paused completed failed cancelled", "paused": "queued cancelled", "completed": "", "failed": "queued", "cancelled": ""}
GENESIS = "0" * 64


def entry_hash(previous: Column, *fields: Column) -> Column:
    parts = [F.coalesce(previous, F.lit(GENESIS))]
    for f in fields:
        parts += [F.lit("\0"), F.coalesce(f.cast("string"), F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, order, body, bytes of the body) in order of key and place; holds one key's place and last hash."""
    key, n, last = None, 0, None
    for batch in batches:
        sequence, previous, own = [], [], []
        for k, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if k != key:
                key, n, last = k, 0, None
            n += 1
            sequence.append(n)
            previous.append(last)
            last = hashlib.sha256((last or GENESIS).encode() + b"\0" + (body or b"")).hexdigest()
            own.append(last)
        made = [pa.array(sequence, pa.int32()), *batch.columns[1:3], pa.array(previous, pa.string()), pa.array(own, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["k", "sequence", "o", "b", "previous_hash", "entry_hash"])


def append_chain(events: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """Events with sequence (from 1 per key), previous_hash and entry_hash, each hash over the one before.

    A chain is sequential by nature: one task runs through a key's rows, sorted, and holds none of them."""
    ship(events.sparkSession)
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(body).alias("b"))
    rows = rows.repartition("k").sortWithinPartitions("k", "o", "b").withColumn("d", F.col("b").cast("string").cast("binary"))
    k, o, b = (T.StructField(f.name, f.dataType) for f in rows.schema.fields[:3])
    made = T.StructType([k, T.StructField("sequence", T.IntegerType()), o, b, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    out = rows.mapInArrow(_chained, made)
    return out.select(F.col("k").alias(key), "sequence", F.col("o").alias(order), F.col("b").alias(body), "previous_hash", "entry_hash")


def with_previous(chain: DataFrame, key: str) -> DataFrame:
    """Each entry with the hash of the one before, by an equi join (no one-task window)."""
    before = chain.select(key, (F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("prior_hash"))
    return chain.join(before, [key, "sequence"], "left")


def verify_chain(chain: DataFrame, key: str, body: str) -> DataFrame:
    """Per key: valid, entries_checked, first_invalid, reason. Sequence, link and hash are tried in that order."""
    linked = with_previous(chain, key)
    reason = (
        F.when((F.col("sequence") > 1) & F.col("prior_hash").isNull(), "sequence")
        .when(~F.col("previous_hash").eqNullSafe(F.col("prior_hash")), "link")
        .when(entry_hash(F.col("previous_hash"), F.col(body)) != F.col("entry_hash"), "hash")
    )
    bad = linked.withColumn("reason", reason).groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("sequence", "reason"))).alias("f"), F.max("sequence").alias("last"), F.min("sequence").alias("lo"))
    first = F.when(F.col("lo") != 1, F.struct(F.col("lo").alias("sequence"), F.lit("sequence").alias("reason"))).otherwise(F.col("f"))
    out = bad.withColumn("f", first)
    # Entries are counted up to the first that is invalid, and a gap is where the next one stands.
    below = chain.join(out.select(key, F.coalesce("f.sequence", F.col("last") + 1).alias("_stop")), key).where("sequence < _stop").groupBy(key).agg(F.count("*").alias("entries_checked"))
    return out.join(below, key, "left").select(key, F.col("f").isNull().alias("valid"), F.coalesce("entries_checked", F.lit(0)).alias("entries_checked"), F.col("f.sequence").alias("first_invalid"), F.col("f.reason").alias("reason"))


def audit_after(chain: DataFrame, after: int, n: int) -> DataFrame:
    return chain.where(F.col("sequence") > after).orderBy("sequence").limit(n)


def with_next_status(events: DataFrame) -> DataFrame:
    """Job events with the status they come from."""
    return events.withColumn("from_status", F.lag("status").over(Window.partitionBy("job_id").orderBy("occurred_at", "event_id")))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the one before (equal statuses are no transition)."""
    allowed = F.create_map(*[F.lit(x) for k, v in TRANSITIONS.items() for x in (k, v)])
    moved = with_next_status(events).where("from_status is not null and from_status <> status")
    return moved.where(~F.array_contains(F.split(F.element_at(allowed, F.col("from_status")), " "), F.col("status")))


def job_state(events: DataFrame) -> DataFrame:
    """Per job its latest status, events, and attempts (times it ran) and failures."""
    return events.groupBy("job_id").agg(F.max(F.struct("occurred_at", "event_id", "status"))["status"].alias("status"), F.count("*").alias("events"), F.count_if(F.col("status") == "running").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"))


def retry_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("job_id").agg(F.count_if(F.col("outcome").isin("failed", "lease-expired")).alias("retries"))


def lease_triage(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Running jobs whose lease is over, with next_status: cancelled, paused, failed (exhausted) or queued."""
    over = jobs.where("status = 'running'").where(F.col("lease_expires_at") <= as_of)
    return over.withColumn("next_status", F.when(F.col("cancel_requested"), "cancelled").when(F.col("pause_requested"), "paused").when(F.col("retries") + 1 >= F.col("maximum_attempts"), "failed").otherwise("queued"))


def dispatch_order(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place in their kind's queue, by priority, time and id.

    Jobs are numbered within the second they came in, seconds within their hour, hours within the kind's queue, and
    the counts before are added up: no task orders more than the jobs of a second, the seconds of an hour, or the
    hours of a kind, so one kind with nearly all jobs is numbered by many tasks."""
    never = F.lit(-(1 << 62))
    second = F.coalesce(F.floor(F.col("submitted_at").cast("timestamp").cast("double")), never)
    queued = jobs.where("status = 'queued'").withColumn("_second", second).withColumn("_hour", F.floor(F.col("_second") / 3600))
    queue = ["kind", "priority"]
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = queued.groupBy(*queue, "_hour", "_second").agg(F.count("*").alias("_n"))
    hours = seconds.groupBy(*queue, "_hour").agg(F.sum("_n").alias("_n")).withColumn("_by_hour", before(Window.partitionBy("kind").orderBy(F.desc("priority"), "_hour")))
    seconds = seconds.withColumn("_by_second", before(Window.partitionBy(*queue, "_hour").orderBy("_second")))
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])
    cells = seconds.join(hours, same(seconds, hours, [*queue, "_hour"])).select(*[seconds[c] for c in (*queue, "_second")], (F.col("_by_hour") + F.col("_by_second")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*queue, "_second").orderBy("submitted_at", "job_id"))
    numbered = queued.withColumn("_own", own)
    placed = numbered.join(cells, same(numbered, cells, [*queue, "_second"]))
    return placed.select(*[numbered[c] for c in jobs.columns], (F.col("_before") + F.col("_own")).cast("long").alias("place"))


def latest_heartbeat(beats: DataFrame) -> DataFrame:
    return newest_per_key(beats, ["worker_id"], "heartbeat_at", "status")


def worker_health(beats: DataFrame, as_of: Column, stale_seconds: int = 10) -> DataFrame:
    old = as_of.cast("timestamp").cast("double") - F.col("heartbeat_at").cast("timestamp").cast("double") > stale_seconds
    health = F.when(F.col("status") == "stopped", "offline").when(old, "stale").when(F.col("status") == "starting", "starting").otherwise("running")
    return latest_heartbeat(beats).withColumn("health", health)


def latest_root_event(events: DataFrame) -> DataFrame:
    return newest_per_key(events, ["root_id"], "occurred_at", "event_id")


def fold_roots(events: DataFrame) -> DataFrame:
    """root_id, status, approved_at, revoked_at: the last approval, revoked if a later event revokes it.
    Revocations of roots never approved are ignored; approving again revives."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("occurred_at", "event_id")))
    g = events.groupBy("root_id").agg(at("approve").alias("a"), at("revoke").alias("r")).where("a is not null")
    gone = F.coalesce(F.col("r") > F.col("a"), F.lit(False))
    return g.select("root_id", F.when(gone, "revoked").otherwise("approved").alias("status"), F.col("a.occurred_at").alias("approved_at"), F.when(gone, F.col("r.occurred_at")).alias("revoked_at"))


def insert_ignore(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(batch.dropDuplicates(key).join(target.select(*key), key, "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Last writer wins, by `at`, then `tie`."""
    return newest_per_key(target.unionByName(batch), key, at, tie)


def merge_max(target: DataFrame, batch: DataFrame, key: list[str], greatest: list[str] = (), known: list[str] = (), added: list[str] = ()) -> DataFrame:
    """One row per key: maxima, first known values (the target's, else the batch's), and sums."""
    both = target.withColumn("_o", F.lit(0)).unionByName(batch.withColumn("_o", F.lit(1)))
    return both.groupBy(*key).agg(*[F.max(c).alias(c) for c in greatest], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in known], *[F.sum(c).alias(c) for c in added])


def stage_status(updates: DataFrame) -> DataFrame:
    """Per scan and stage the furthest progress."""
    return updates.groupBy("scan_id", "stage").agg(F.max("completed").alias("completed"), F.max("total").alias("total"), F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("updated_at"))


def replace_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def idempotent(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): the first submission of each key; keys that came with several payloads.
    submissions: key, payload (canonical), submitted_at, job_id."""
    g = submissions.groupBy("key").agg(F.min(F.struct("submitted_at", "job_id", "payload")).alias("f"), F.count_distinct("payload").alias("payloads"), F.count("*").alias("n"))
    return g.select("key", F.col("f.job_id").alias("job_id"), F.col("f.payload").alias("payload"), "n"), g.where("payloads > 1").select("key", "payloads")
