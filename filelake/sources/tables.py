"""Event logs, manifests of typed records, and table sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_event_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, corrupt) of a JSONL log. schema: DDL of an event. corrupt: file, number (line from 1, blank ones
    count), line, reason: bad-json, or incomplete for a log that does not end in a line feed.

    Lines are numbered from the counts of each split of a file. What a file's lines and their feeds hold is
    compared with its size, so no file is read whole to see its end."""
    at = {"file": F.col("_metadata.file_path"), "_size": F.col("_metadata.file_size"), "_split": F.col("_metadata.file_block_start")}
    raw = spark.read.text(path).select("value", *[v.alias(k) for k, v in at.items()]).withColumn("_id", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = splits.withColumn("_before", above).drop("_n")
    parsed = raw.where("length(trim(value)) > 0").withColumn("e", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.where("e._bad is not null").join(before, ["file", "_split"])
    bad = bad.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("number"), F.col("value").alias("line"), F.lit("bad-json").alias("reason"))
    held = raw.groupBy("file", "_size").agg(F.sum(F.octet_length("value") + 1).alias("_held"), F.count("*").alias("number"))
    cut = held.where("_held > _size").select("file", "number", F.lit(None).cast("string").alias("line"), F.lit("incomplete").alias("reason"))
    return parsed.where("e._bad is null").select("e.*").drop("_bad"), bad.unionByName(cut)


def export_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON text per row, its recordType among its fields."""
    out = None
    for kind, df in tables.items():
        lines = df.select(F.to_json(F.struct(F.lit(kind).alias("recordType"), F.struct(*df.columns).alias("record"))).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def import_manifest(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    head = F.get_json_object("value", "$.recordType")
    return lines.where(head == kind).select(F.from_json(F.get_json_object("value", "$.record"), schema).alias("r")).select("r.*")


def write_table(df: DataFrame, base: str, name: str, partitions: list[str] | None = None) -> str:
    """Write df as a new version of a table and return its path; readers of other versions are undisturbed."""
    path = f"{base.rstrip('/')}/{name}/v-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path
