"""Tables sorted by a key, of which a page opens only the files behind its cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bounded_limit
from ..operators.search import LARGEST_PAGE, PAGE, _cursor, _uncursor, after_key


def write_sorted(df: DataFrame, keys: list[str], path: str, files: int | None = None) -> str:
    """Write df below path in ranges of keys, with each file's bounds and number of rows beside it. keys end in a
    unique column. files: how many ranges at most; without it Spark's number of shuffle partitions."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(*keys, F.col("_metadata.file_name").alias("file"))
    bounds = rows.groupBy("file").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.count("*").alias("n"))
    bounds.write.parquet(f"{path}/bounds")
    return path


def files_behind(spark: SparkSession, path: str, keys: list[str], values: list | None, n: int) -> list[str]:
    """The files that the first n rows behind a key lie in: those of the bounds table, in order, until their rows
    suffice. The first may hold the key itself, so its rows do not count. At most n + 1 names are read."""
    bounds = spark.read.parquet(f"{path}/bounds").select("file", "n", "low", "high.*")
    if values:
        bounds = after_key(bounds, keys, values)
    out, have = [], 0
    for r in bounds.orderBy("low").limit(n + 1).select("file", "n").collect():
        if have >= n:
            break
        have += r["n"] if out or not values else 0
        out.append(f"{path}/rows/{r['file']}")
    return out


def rows_behind(spark: SparkSession, path: str, keys: list[str], values: list | None, n: int) -> DataFrame:
    """The first n rows behind a key (None: of all), in order."""
    files = files_behind(spark, path, keys, values, n)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return (after_key(rows, keys, values) if values else rows).orderBy(*keys).limit(n)


def page_sorted(spark: SparkSession, path: str, keys: list[str], cursor: str | None, n: int | None = None, kind: str = "page") -> tuple[list, str | None]:
    """(rows, next cursor), as page_keyset gives them; a cursor holds a key alone, so it stays valid over a new
    version of the table in another path."""
    n = bounded_limit(n, PAGE, LARGEST_PAGE)
    rows = rows_behind(spark, path, keys, _uncursor(kind, cursor) if cursor else None, n + 1).collect()
    return rows[:n], _cursor(kind, [rows[n - 1][k] for k in keys]) if len(rows) > n else None
