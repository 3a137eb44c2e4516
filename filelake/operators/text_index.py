"""Substring search over an index: trigrams of the searched columns, the rarest first, then verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import _text

#: Characters of a gram; a shorter text is sought by a scan.
GRAM = 3
#: Rarest grams of a text whose postings are read.
RAREST = 3
#: Candidates whose keys are handed to the scan as a filter; more are joined.
PUSHED = 1000


def _grams(text: Column) -> Column:
    """Distinct grams of a column, in lower case; none of null and of texts that are too short."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def build_index(files: DataFrame, path: str, key: str = "record_id", columns: tuple[str, ...] = ("name", "relative_path")) -> None:
    """Write an index of files below path: rows (sorted by key), postings (gram, key) and counts (gram, n).

    Postings are dealt by ranges of (gram, key), so a gram that every path has is spread over as many files as it
    fills, and a search skips the others by their bounds. Keys are to be unique and not null."""
    files.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{path}/rows")
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(c)) for c in columns])))
    postings = files.select(F.explode(grams).alias("gram"), F.col(key).alias("key"))
    postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.option("compression", "zstd").parquet(f"{path}/postings")
    counts = files.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.option("compression", "zstd").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """key of the rows that hold the rarest grams of text, or None where text is too short for the index."""
    low = text.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return None
    postings = spark.read.parquet(f"{path}/postings")
    # One row for each gram of the text at most.
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).collect()}
    if len(counts) < len(grams):
        return postings.select("key").limit(0)
    rare = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
    return postings.where(F.col("gram").isin(rare)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search_index(spark: SparkSession, path: str, text: str, key: str = "record_id", columns: tuple[str, ...] = ("name", "relative_path")) -> DataFrame:
    """Rows of which one of columns holds text, whatever its case: what search_inventory finds by a scan."""
    rows, found = spark.read.parquet(f"{path}/rows"), candidates(spark, path, text)
    if found is not None:
        keys = [r["key"] for r in found.limit(PUSHED + 1).collect()]
        if len(keys) <= PUSHED:
            rows = rows.where(F.col(key).isin(keys))
        else:
            rows = rows.join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return _text(rows, text, *columns)
