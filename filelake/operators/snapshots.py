"""Snapshots: counters, latest scans, appending, and matching of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_counts(files: DataFrame) -> DataFrame:
    seen = F.col("observation_status") == "observed"
    is_file = F.col("entry_type") == "file"
    return files.groupBy("root_id", "scan_id").agg(
        F.count("*").alias("records"),
        F.count_if(seen & is_file).alias("files"),
        F.coalesce(F.sum(F.when(seen & is_file, F.col("byte_length"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("observation_status") == "skipped").alias("skipped"),
        F.count_if(F.col("observation_status") == "error").alias("errors"),
        F.count_if(seen & (F.col("entry_type") == "directory")).alias("directories"),
    )


def _latest(scans: DataFrame) -> DataFrame:
    rest = [c for c in scans.columns if c != "root_id"]
    top = scans.groupBy("root_id").agg(F.max(F.struct("started_at", "scan_id", *[c for c in rest if c not in ("started_at", "scan_id")])).alias("t"))
    return top.select("root_id", *[F.col("t")[c].alias(c) for c in rest])


def latest_scan(scans: DataFrame) -> DataFrame:
    """By start, then id, whatever the status."""
    return _latest(scans)


def latest_completed_scan(scans: DataFrame) -> DataFrame:
    return _latest(scans.where("status = 'completed'"))


def scan_summary(scans: DataFrame) -> DataFrame:
    """Retained scans per root and its latest."""
    return scans.groupBy("root_id").agg(F.count("*").alias("retained"), F.max(F.struct("started_at", "scan_id")).alias("t")).select("root_id", "retained", F.col("t.scan_id").alias("latest_scan"))


def append_snapshot(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch that are new by record_id, once each; appending them is idempotent."""
    return batch.dropDuplicates(["record_id"]).join(existing.select("record_id"), "record_id", "left_anti")


def matches_observation(expected: dict[str, Column], found: dict[str, Column]) -> Column:
    """Equal in all that was recorded: an expectation that is null holds."""
    out = F.lit(True)
    for k, e in expected.items():
        out = out & (e.isNull() | e.eqNullSafe(found[k]))
    return out


def dashboard(files: DataFrame, scans: DataFrame, roots: DataFrame) -> DataFrame:
    """Files and bytes in the latest completed scan of approved roots."""
    latest = latest_completed_scan(scans).join(roots.where("status = 'approved'").select("root_id"), "root_id", "left_semi")
    now = files.join(latest.select("root_id", "scan_id"), ["root_id", "scan_id"], "left_semi").where("observation_status = 'observed' and entry_type = 'file'")
    return now.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))


def analysis_status(files: DataFrame, hashes: DataFrame, understanding: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per scan: observed files, hashed, reused, understood, failed, needing review, open reviews."""
    f = files.where("observation_status = 'observed' and entry_type = 'file'").groupBy("scan_id").agg(F.count("*").alias("files"), F.sum("byte_length").alias("bytes"))
    h = hashes.groupBy("scan_id").agg(F.count("digest").alias("hashed"), F.count_if(F.col("verification_state") == "reused").alias("reused"))
    u = understanding.groupBy("scan_id").agg(F.count("*").alias("understood"), F.count_if(F.col("analysis_state") == "failed").alias("failed"), F.count_if(F.col("uncertainty") == "needs-review").alias("uncertain"))
    r = reviews.groupBy("scan_id").agg(F.count_if(F.col("status") == "open").alias("open_reviews"))
    return f.join(h, "scan_id", "left").join(u, "scan_id", "left").join(r, "scan_id", "left").na.fill(0)


def intelligence_summary(files: DataFrame, understanding: DataFrame, scans: DataFrame, groups: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per root, and with root_id null over all: files (of the latest completed scan), analysed, awaiting (never
    negative), candidate_groups, exact_groups, reclaimable_bytes, open_reviews.

    groups: root_id, kind, reclaimable_bytes. Each table is summed by root first; only sums are joined."""
    latest = latest_completed_scan(scans).select("root_id", "scan_id")
    now = files.where("observation_status = 'observed' and entry_type = 'file'").join(latest, ["root_id", "scan_id"], "left_semi")
    one = F.lit(1).cast("long")
    exact = F.col("kind") == "exact"
    told = [
        (now, "files", one),
        (understanding.where("analysis_state in ('analyzed', 'partial')"), "analysed", one),
        (groups.where("kind = 'candidate'"), "candidate_groups", one),
        (groups.where(exact), "exact_groups", one),
        (groups.where(exact), "reclaimable_bytes", F.col("reclaimable_bytes").cast("long")),
        (reviews.where("status = 'open'"), "open_reviews", one),
    ]
    rows = None
    for df, name, value in told:
        part = df.groupBy("root_id").agg(F.sum(value).alias("v")).withColumn("name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    names = [name for _, name, _ in told]
    out = rows.rollup("root_id").agg(*[F.coalesce(F.sum(F.when(F.col("name") == x, F.col("v"))), F.lit(0)).alias(x) for x in names])
    return out.withColumn("awaiting", F.greatest(F.lit(0), F.col("files") - F.col("analysed")))
