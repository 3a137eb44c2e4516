"""Views with the shape of file tables over the test tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One text for both dialects; {bytes} and {days} differ.
_FILES = """
SELECT *, CASE WHEN parent_path = '' THEN name ELSE parent_path || '/' || name END AS relative_path,
  substr(name, 1, 1) = '.' AS hidden, 'r' || cast(doc_id AS {string}) AS record_id
FROM (SELECT *, CASE WHEN doc_id % 97 = 0 THEN 'package.json' ELSE
    (CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END) || 'f' || cast(doc_id AS {string}) || '.' || extension END AS name
  FROM (SELECT doc_id, text AS content, 'root-' || cast((CASE WHEN doc_id % 97 <= 3 THEN doc_id - doc_id % 97 ELSE doc_id END) % 4 AS {string}) AS root_id, 's1' AS scan_id,
    CASE WHEN doc_id % 97 = 0 THEN 'json' ELSE split_part('pdf,txt,md,csv,jpg,png,mp3,mov,zip,ts,json,foo', ',', cast(floor(doc_id / 20.0) AS int) % 12 + 1) END AS extension,
    CASE WHEN doc_id % 97 = 0 THEN 'proj' || cast(doc_id AS {string})
         WHEN doc_id % 97 <= 3 THEN 'proj' || cast(doc_id - doc_id % 97 AS {string}) || '/src'
         WHEN doc_id % 5 = 0 THEN '' ELSE lang || '/' || source END AS parent_path,
    cast({bytes} AS bigint) AS byte_length, {days} AS modified_at, cast(NULL AS timestamp) AS created_at,
    'dev' || cast(doc_id % 3 AS {string}) AS device_id, cast(doc_id AS {string}) AS filesystem_record_id,
    'file' AS entry_type, 'observed' AS observation_status,
    cast(NULL AS boolean) AS system, cast(NULL AS boolean) AS read_only, cast(NULL AS {string}) AS issue_code
  FROM {documents}) a) b
"""

_SPARK = {"string": "string", "bytes": "octet_length(text)", "days": "timestampadd(DAY, cast(doc_id % 400 AS int), timestamp'2024-01-01 00:00:00')"}
_DUCK = {"string": "varchar", "bytes": "strlen(text)", "days": "(timestamp '2024-01-01 00:00:00' + to_days(cast(doc_id % 400 AS int)))"}

#: The second snapshot: rows dropped, grown, touched, hidden and added by doc_id % 10.
_SECOND = """
SELECT * REPLACE ('s2' AS scan_id) FROM (
  SELECT * REPLACE (CASE WHEN doc_id % 10 = 4 THEN byte_length + 1 ELSE byte_length END AS byte_length,
    CASE WHEN doc_id % 10 = 5 THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at,
    CASE WHEN doc_id % 10 = 6 THEN NOT hidden ELSE hidden END AS hidden) FROM files WHERE doc_id % 10 <> 3
  UNION ALL
  SELECT * REPLACE (doc_id + 1000000 AS doc_id, 'added/' || relative_path AS relative_path, 'x' || record_id AS record_id) FROM files WHERE doc_id % 10 = 7)
"""

FILES_SQL = "WITH files AS (" + _FILES.format(documents="documents", **_DUCK) + ")"
BOTH_SQL = FILES_SQL + ", files2 AS (" + _SECOND + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan s1: one file per document."""
    return spark.sql(_FILES.format(documents="{documents}", **_SPARK), documents=table(spark, sf_dir, "documents"))


def files2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan s2, a later state of the same trees."""
    from pyspark.sql import functions as F

    f = files(spark, sf_dir)
    m = F.col("doc_id") % 10
    kept = f.where(m != 3).withColumns(
        {
            "byte_length": F.when(m == 4, F.col("byte_length") + 1).otherwise(F.col("byte_length")),
            "modified_at": F.when(m == 5, F.col("modified_at") + F.expr("interval 1 day")).otherwise(F.col("modified_at")),
            "hidden": F.when(m == 6, ~F.col("hidden")).otherwise(F.col("hidden")),
        }
    )
    added = f.where(m == 7).withColumns({"doc_id": F.col("doc_id") + 1000000, "relative_path": F.concat(F.lit("added/"), "relative_path"), "record_id": F.concat(F.lit("x"), "record_id")})
    return kept.unionByName(added).withColumn("scan_id", F.lit("s2"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan headers from orders: a customer's orders as scans of one root."""
    return table(spark, sf_dir, "orders").selectExpr("concat('root-', cast(o_custkey as string)) as root_id", "concat('s', cast(o_orderkey as string)) as scan_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status", "o_orderdate as started_at")


SCANS_SQL = "WITH scans AS (SELECT 'root-' || o_custkey AS root_id, 's' || o_orderkey AS scan_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at FROM orders)"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events from events: a user is a job."""
    return table(spark, sf_dir, "events").selectExpr("user_id as job_id", "event_id", "ts as occurred_at", "case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'paused' end as status", "value")


EVENTS_SQL = "WITH job_events AS (SELECT user_id AS job_id, event_id, ts AS occurred_at, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'paused' END AS status, value FROM events)"


def root_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type in ('signup', 'error')").selectExpr("user_id as root_id", "event_id", "ts as occurred_at", "case event_type when 'signup' then 'approve' else 'revoke' end as kind")
