"""Snapshot diff by one full outer join, of all rows or of the folders that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent_path
from ..functions.scalars import stable_id
from ..session import written

FIELDS = {"entryType": ["entry_type"], "byteLength": ["byte_length"], "modifiedAt": ["modified_at"], "attributes": ["hidden", "system", "read_only"]}

_FACTS = ["entry_type", "byte_length", "modified_at", "hidden", "system", "read_only"]


def check_reconcilable(scans: DataFrame, baseline: str, comparison: str) -> str:
    """The run's id; a ValueError unless the two are distinct, completed scans of one root."""
    if baseline == comparison:
        raise ValueError("a scan cannot be compared with itself")
    rows = scans.where(F.col("scan_id").isin(baseline, comparison)).select("scan_id", "root_id", "status").distinct().limit(3).collect()
    if len({r["scan_id"] for r in rows}) < 2:
        raise ValueError("both scans must exist")
    if len({r["root_id"] for r in rows}) != 1 or any(r["status"] != "completed" for r in rows):
        raise ValueError("both scans must be completed and of one root")
    import hashlib

    return "reconciliation:" + hashlib.sha256(f"reconciliation\0{baseline}\0{comparison}\0".encode()).hexdigest()


def reconcile(base: DataFrame, comp: DataFrame) -> DataFrame:
    """delta_id, root_id, relative_path, kind (added, missing, metadata-changed), changed_fields, before, after.

    Rows that are not observed, and ids and times of observation, do not count. Null equals null."""
    facts = _FACTS
    side = lambda df, name: df.where("observation_status = 'observed'").select("root_id", "relative_path", F.struct(*facts).alias(name))
    both = side(base, "before").join(side(comp, "after"), ["root_id", "relative_path"], "full_outer")
    differs = lambda names: ~F.reduce(F.array(*[F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}")) for n in names]), F.lit(True), lambda a, b: a & b)
    changed = F.array_compact(F.array(*[F.when(differs(cols), F.lit(name)) for name, cols in FIELDS.items()]))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "missing").when(F.size("changed_fields") > 0, "metadata-changed")
    out = both.withColumn("changed_fields", F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), changed).otherwise(F.array().cast("array<string>"))).withColumn("kind", kind)
    return out.where("kind is not null").select(stable_id("delta", F.col("root_id"), F.col("relative_path"), F.col("kind")).alias("delta_id"), "root_id", "relative_path", "kind", "changed_fields", "before", "after")


_DIGEST = ["n", "total", "first", "second"]


def _digest() -> list:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("first").alias("first"), F.bit_xor("second").alias("second")]


def folder_digests(snapshot: DataFrame) -> DataFrame:
    """root_id, folder, n, total, first, second: a digest of each folder's own observed rows, in any order.

    It is the number of rows, the sum of 32 bits of their hashes and the exclusive or of two hashes of 64 bits, so
    tasks add up their own rows before the shuffle and a folder of any size is a row. Nulls are told from values.
    Kept as a table beside a snapshot, it spares reading that snapshot when another is compared with it."""
    row = [F.col("relative_path"), *[F.col(c) for c in _FACTS], *[F.col(c).isNull() for c in _FACTS]]
    seen = snapshot.where("observation_status = 'observed'")
    hashed = seen.select("root_id", parent_path(F.col("relative_path")).alias("folder"), F.xxhash64(*row).alias("first"), F.xxhash64(F.lit(1), *row).alias("second"))
    hashed = hashed.withColumns({"n": F.lit(1), "total": F.col("first").bitwiseAND(F.lit(0xFFFFFFFF))})
    return hashed.groupBy("root_id", "folder").agg(*_digest())


def subtree_digests(digests: DataFrame) -> DataFrame:
    """Digests of all rows below each folder, rolled up from folder_digests(): root_id, folder ('' is the root), n, ..."""
    up = digests.withColumn("folder", F.explode(F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("folder"), own=True))))
    return up.groupBy("root_id", "folder").agg(*_digest())


def changed_folders(base: DataFrame, comp: DataFrame) -> DataFrame:
    """root_id, folder whose digests differ or stand on one side only; takes two tables of digests."""
    side = lambda df, name: df.select("root_id", "folder", F.struct(*_DIGEST).alias(name))
    both = side(base, "before").join(side(comp, "after"), ["root_id", "folder"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("root_id", "folder")


def unchanged_subtrees(base: DataFrame, comp: DataFrame) -> DataFrame:
    """root_id, folder, n: the topmost folders below which two tables of digests tell no difference, and their rows."""
    old, new = subtree_digests(base), subtree_digests(comp)
    differ = changed_folders(old, new)
    same = new.join(differ, ["root_id", "folder"], "left_anti").withColumn("_up", F.when(F.col("folder") != "", parent_path(F.col("folder"))))
    top = differ.select("root_id", F.col("folder").alias("_up"))
    return same.where("_up is null").unionByName(same.join(top, ["root_id", "_up"], "left_semi").select(*same.columns)).select("root_id", "folder", "n")


def reconcile_by_folder(base: DataFrame, comp: DataFrame, base_digests: DataFrame | None = None, comp_digests: DataFrame | None = None) -> DataFrame:
    """reconcile(), with the rows of folders whose digests differ alone in its outer join.

    The digests of either side may be given, as kept beside it. The join by folder is a left semi join whose large
    side adaptive execution splits where one folder holds much of all rows."""
    changed = changed_folders(folder_digests(base) if base_digests is None else base_digests, folder_digests(comp) if comp_digests is None else comp_digests)
    changed = written(changed.withColumnRenamed("folder", "_folder"), "changed")
    rows = lambda df: df.withColumn("_folder", parent_path(F.col("relative_path"))).join(changed, ["root_id", "_folder"], "left_semi").drop("_folder")
    return reconcile(rows(base), rows(comp))


def delta_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("kind").agg(F.count("*").alias("n"))


def path_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """relative_path, side: in one of the two only."""
    only = lambda x, y, name: x.select("relative_path").distinct().join(y.select("relative_path"), "relative_path", "left_anti").withColumn("side", F.lit(name))
    return only(b, a, "added").unionByName(only(a, b, "missing"))
