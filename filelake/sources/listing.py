"""Listings of trees as file rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import ancestors, encode_unsafe_name, extension, hidden, is_within, safe_entry_name
from ..session import ship

LISTED = "relative_path string, name string, entry_type string, byte_length long, modified_at double, device_id string, filesystem_record_id string, mode int, issue_code string"


class TreeSource(DataSource):
    """Every entry below a folder that all executors see, hidden ones and directories too; one partition per
    folder of the top level. Contents are never opened, links never followed. An entry or folder that is gone or
    cannot be read is one row with an issue_code (a folder that was listed before has a row of its own besides)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"])


def _issue(error: OSError) -> str:
    return "vanished" if isinstance(error, FileNotFoundError) else "inaccessible"


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        top = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [InputPartition("")] + [InputPartition(x) for x in sorted(top)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.value]
        while todo:
            folder = todo.pop()
            for row in entries(self.root, folder):
                yield row
                if row[2] == "directory" and row[8] is None and folder:  # a folder of the top level is a partition of its own
                    todo.append(row[0])


def entries(root: str, folder: str) -> Iterator[tuple]:
    """Rows of what lies in one folder; of a folder that cannot be read, one row of its own."""
    try:
        found = list(os.scandir(os.path.join(root, folder)))
    except OSError as e:
        yield (folder, folder.rpartition("/")[2], "directory", *[None] * 5, _issue(e))
        return
    for e in found:
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            kind = "symlink" if e.is_symlink() else "directory" if e.is_dir() else "file" if e.is_file() else "other"
            s = e.stat(follow_symlinks=False)
        except OSError as error:
            yield (path, e.name, "unknown", *[None] * 5, _issue(error))
            continue
        yield path, e.name, kind, s.st_size if kind == "file" else None, s.st_mtime, str(s.st_dev), str(s.st_ino), s.st_mode, None


#: Entries that a task gathers before it passes them on; folders that a task lists, if there are many.
GATHERED, FOLDERS = 4096, 512
_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in LISTED.split(", "))])


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def scan_tree(spark: SparkSession, root: str, state: str, levels: int | None = None) -> DataFrame | None:
    """The rows of read_tree(), level by level: folders still to be listed are a table, dealt over the tasks by a hash
    of their path, so neither a top-level folder nor a deep one is a task of its own.

    state: a folder of this scan, shared by all executors. A level's entries are written there, whole, before the next
    level begins; a scan that was stopped goes on behind its last whole level when it is called again, and lists no
    folder of it twice. levels: how many levels this call may list; None is returned while folders are left."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            held.clear()
            return out

        held: list[tuple] = []
        for todo in batches:
            for folder in todo.column(0).to_pylist():
                for row in entries(root, folder):
                    held.append(row)
                    if len(held) >= GATHERED:
                        yield batch()
        if held:
            yield batch()

    paths: list[str] = []
    pending = spark.createDataFrame([("",)], "relative_path string")
    while not pending.isEmpty():
        path = f"{state.rstrip('/')}/level={len(paths)}"
        if not _finished(spark, path):
            if levels == 0:
                return None
            levels = None if levels is None else levels - 1
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pending.count() // FOLDERS)  # a number that is given stays: paths are few bytes
            pending.repartition(tasks, "relative_path").mapInArrow(run, LISTED).write.mode("overwrite").parquet(path)
        paths.append(path)
        pending = spark.read.schema(LISTED).parquet(path).where("entry_type = 'directory' and issue_code is null").select("relative_path")
    return spark.read.schema(LISTED).parquet(*paths).withColumn("modified_at", F.timestamp_seconds("modified_at"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).load().withColumn("modified_at", F.timestamp_seconds("modified_at"))


def read_object_store(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of files in any store Spark reads; names with a leading dot or
    underscore and directories are not listed there. Contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def directory_rows(files: DataFrame) -> DataFrame:
    """root_id, relative_path, depth of every folder that a flat listing implies."""
    up = files.select("root_id", F.explode(ancestors(F.col("relative_path"))).alias("relative_path")).distinct()
    return up.withColumn("depth", F.when(F.col("relative_path") == "", 0).otherwise(F.size(F.split("relative_path", "/"))))


def from_manifest(df: DataFrame) -> DataFrame:
    """A listing with at least root_id, scan_id and relative_path as file rows, what is missing filled in."""
    have = set(df.columns)
    name = F.element_at(F.split("relative_path", "/"), -1)
    default = {
        "name": name,
        "extension": extension(name),
        "entry_type": F.lit("file"),
        "observation_status": F.lit("observed"),
        "byte_length": F.lit(None).cast("long"),
        "created_at": F.lit(None).cast("timestamp"),
        "modified_at": F.lit(None).cast("timestamp"),
        "device_id": F.lit(None).cast("string"),
        "filesystem_record_id": F.lit(None).cast("string"),
        "hidden": hidden(name),
        "system": F.lit(None).cast("boolean"),
        "read_only": F.lit(None).cast("boolean"),
        "issue_code": F.lit(None).cast("string"),
    }
    return df.withColumns({k: v for k, v in default.items() if k not in have})


def tag_issues(listing: DataFrame, device: str | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """Rows with observation_status and issue_code, the first that applies: unsafe name, ignored prefix,
    symlink, outside the root's boundary, other device, then what the reader said (vanished, inaccessible) or an
    unknown type. ignored: prefix (folders that policy leaves out); boundary: a column resolved_path, if the
    listing has one, must lie in root_path."""
    df = listing
    if ignored is not None:
        names = df.select("relative_path").withColumn("prefix", F.explode(ancestors(F.col("relative_path"), own=True))).join(ignored.select("prefix"), "prefix", "left_semi").select("relative_path").distinct()
        df = df.join(names.withColumn("_ignored", F.lit(True)), "relative_path", "left")
    else:
        df = df.withColumn("_ignored", F.lit(None).cast("boolean"))
    code = F.when(~safe_entry_name(F.col("name")), "unsafe-name").when(F.col("_ignored"), "policy-ignored").when(F.col("entry_type") == "symlink", "symlink-not-followed")
    if device is not None:
        code = code.when(F.col("device_id") != device, "different-device")
    if {"resolved_path", "root_path"} <= set(df.columns):
        code = code.when(~is_within(F.col("resolved_path"), F.col("root_path")), "outside-boundary")
    if "issue_code" in df.columns:
        code = code.when(F.col("issue_code").isin("vanished", "inaccessible"), F.col("issue_code"))
    code = code.when(F.col("entry_type") == "unknown", "inaccessible")
    status = F.when(F.col("issue_code") == "inaccessible", "error").when(F.col("issue_code").isNotNull(), "skipped").otherwise("observed")
    shown = F.when(F.col("issue_code") == "unsafe-name", encode_unsafe_name(F.col("name"))).otherwise(F.col("name"))
    return df.withColumn("issue_code", code).withColumn("observation_status", status).withColumn("name", shown).drop("_ignored")
