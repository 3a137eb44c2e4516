"""What the operators share: the folder for written tables, batch sizes, a bounded Bloom filter, output types."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of an Arrow batch that Python works on at once; with slices() this bounds a task's memory.
BATCH_ROWS = 512
#: Bytes of text that are worked on at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: Binary logarithms of the least and most bits of a filter.
LEAST_LOG2, MOST_LOG2 = 16, 26


def prepare(spark: SparkSession) -> None:
    """Hand the package to the session's Python workers. No setting of the session is changed."""
    ship(spark)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of at most so many rows. Spark bounds a batch's bytes by itself."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where the session has
    none (a local session, as in tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and the offset of each text (one more than texts). Null: empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit bytes, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long (seed 42; fixed constants of the algorithm)."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + five + np.uint64(8)) ^ (turn(x.astype(np.uint64) * two, 31) * one)
        h = turn(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return h ^ (h >> np.uint64(32))


def bloom_hits(bits: np.ndarray, log2: int, ids: np.ndarray) -> np.ndarray:
    """Which ids fall on a set bit of a filter of bloom(); their spots are those of bloom_column()."""
    spot = (xxhash64(ids) & np.uint64((1 << log2) - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).view(bool)


def bloom_column(c: Column, log2: int) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit((1 << log2) - 1).cast("long"))


def bloom(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bits, log2): one bit for each spot that an id of ids falls on, of 2**log2. The filter has eight bits or more
    for each row of ids within LEAST_LOG2 and MOST_LOG2, so at most 2**MOST_LOG2 / 64 rows of 64 bits reach the
    driver; beyond that it lets more rows through, which a join then sorts out, and loses none."""
    log2 = min(MOST_LOG2, max(LEAST_LOG2, (8 * ids.count()).bit_length()))
    spot = bloom_column(F.col(column), log2)
    words = (
        ids.where(F.col(column).isNotNull())
        .select(spot.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros((1 << log2) // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8), log2
