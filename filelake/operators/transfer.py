"""Ingest, transfer and quarantine as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from .classify import REVIEW, classify_ingest

HEAD_ROOM = 16 * 1024 * 1024


#: Bounds by which a listing is cut into ranges of paths.
BOUNDS = 255


def discover_items(listing: DataFrame, device: str, control: str = ".catalogue") -> DataFrame:
    """Regular files on the root's own device, outside the control folder, numbered by path (equal paths by record).

    Ranges of paths, cut at BOUNDS paths that a hash picks, are numbered apart and start from the counts of
    those before, so neither one task nor one folder's task orders the listing."""
    kept = listing.where("entry_type = 'file'").where(F.col("device_id") == device).where(~F.startswith("relative_path", F.lit(control + "/")))
    picked = kept.select("relative_path").distinct().orderBy(F.xxhash64("relative_path"), "relative_path").limit(BOUNDS).collect()
    bounds = F.array(*[F.lit(x) for x in sorted(r[0] for r in picked if r[0] is not None)]).cast("array<string>")
    blocks = kept.withColumn("_b", F.size(F.filter(bounds, lambda x: x <= F.col("relative_path"))))
    size = blocks.groupBy("_b").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("_b").orderBy("relative_path", "record_id")) - 1
    return blocks.join(before, "_b").withColumn("ordinal", (F.col("_before") + at).cast("long")).drop("_b", "_before")


def ingest_destination(category: Column, target: str = "Imported", preserve: bool = True) -> Column:
    flat = F.concat_ws("/", F.lit(target), category, "name")
    return F.when(F.contains("relative_path", F.lit("/")), F.concat_ws("/", F.lit(target), "relative_path")).otherwise(flat) if preserve else flat


def triage_ingest(items: DataFrame, matches: DataFrame, target: str = "Imported", preserve: bool = True) -> DataFrame:
    """items with status (exact-duplicate, needs-review, ready), category, destination, n_matches and, where
    matches has them, the matches themselves.

    matches: item_id, n_matches, as top_matches() gives it. Duplicates are settled first and not classified."""
    found = matches.select("item_id", "n_matches", *[c for c in matches.columns if c == "matches"])
    out = classify_ingest(items.join(found, "item_id", "left").na.fill(0, ["n_matches"]))
    dup = F.col("n_matches") > 0
    status = F.when(dup, "exact-duplicate").when(F.col("confidence") < REVIEW, "needs-review").otherwise("ready")
    return out.withColumns({"status": status, "destination": F.when(~dup, ingest_destination(F.col("category"), target, preserve))})


def transfer_counts(items: DataFrame) -> DataFrame:
    names = ("discovered", "ready", "exact-duplicate", "needs-review", "completed", "failed", "skipped")
    n = [F.count_if(F.col("status") == s).alias("n_" + s.replace("-", "_")) for s in names]
    return items.groupBy("plan_id").agg(F.count("*").alias("total"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("total_bytes"), *n, F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("byte_length"))), F.lit(0)).alias("completed_bytes"))


def ingest_plan_state(counts: DataFrame) -> DataFrame:
    return counts.withColumn("state", F.when(F.col("n_discovered") > 0, "analyzing").when(F.col("n_needs_review") > 0, "needs-review").otherwise("ready"))


def receipt_counts(items: DataFrame) -> DataFrame:
    names = ("imported", "exact-duplicate", "needs-review", "skipped", "failed")
    return items.groupBy("plan_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == s).alias(s.replace("-", "_")) for s in names])


def transfer_receipt(items: DataFrame) -> DataFrame:
    c = transfer_counts(items)
    status = F.when((F.col("n_failed") > 0) | (F.col("n_skipped") > 0), "partial").otherwise("completed")
    return c.withColumns({"receipt_id": stable_id("receipt", F.col("plan_id")), "status": status})


# Names of strategies and of their steps.
COPY, RENAME, MOVE = "copy-verify-preserve-source", "same-filesystem-rename", "cross-filesystem-copy-verify-quarantine-source"
COPY_STEP, VERIFY_STEP, QUARANTINE_STEP = "copy-to-destination", "verify-content-identity", "quarantine-source"


def transfer_strategy(intent: Column, relation: Column) -> Column:
    """Struct of status, strategy, steps and reason; a move across unknown file systems is for review and has a
    reason in place of a strategy."""
    none = F.lit(None).cast("string")
    of = lambda name, *steps: F.struct(F.lit("planned").alias("status"), F.lit(name).alias("strategy"), F.array(*map(F.lit, steps)).alias("steps"), none.alias("reason"))
    unknown = F.lit("how source and target file systems relate must be known before a move is planned")
    review = F.struct(F.lit("review-required").alias("status"), none.alias("strategy"), F.array().cast("array<string>").alias("steps"), unknown.alias("reason"))
    return F.when(intent == "copy", of(COPY, COPY_STEP, VERIFY_STEP)).when(relation == "same-filesystem", of(RENAME, RENAME, VERIFY_STEP)).when(relation == "cross-filesystem", of(MOVE, COPY_STEP, VERIFY_STEP, QUARANTINE_STEP)).otherwise(review)


def consolidation_plan(members: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, violations): members to consolidate whose digest still is the group's, of groups with a keeper
    and a copy. members: group_id, record_id, digest, decision; current: record_id, digest."""
    now = members.join(current.select("record_id", F.col("digest").alias("_now")), "record_id", "left")
    ok = now.groupBy("group_id").agg(F.count_if(F.col("decision").isin("keep", "keep-all")).alias("k"), F.count_if(F.col("decision") == "consolidate").alias("c"))
    bad = ok.where("k = 0 or c = 0").select("group_id", F.when(F.col("k") == 0, "no-keeper").otherwise("no-copy").alias("violation"))
    items = now.where("decision = 'consolidate' and _now <=> digest").join(ok.where("k > 0 and c > 0").select("group_id"), "group_id", "left_semi").drop("_now")
    return items, bad


def cross_volume_plan(ids: DataFrame, files: DataFrame, hashes: DataFrame, target_device: str, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(items, violations) for distinct ids: observed files with a digest on another volume than the target's."""
    want = ids.select("record_id").distinct()
    f = files.where("observation_status = 'observed' and entry_type = 'file'").select("record_id", "relative_path", "byte_length", "device_id")
    got = want.join(f, "record_id", "left").join(hashes.select("record_id", "digest"), "record_id", "left")
    why = F.when(F.col("relative_path").isNull(), "not-observed").when(F.col("digest").isNull(), "no-digest").when(F.col("device_id") == target_device, "same-volume")
    got = got.withColumn("violation", why)
    n = want.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a plan takes 1 to {most} files")
    return got.where("violation is null").drop("violation"), got.where("violation is not null").select("record_id", "violation")


def verify_transfer(items: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """item_id, result: verified, collision, stale-source, missing or pending. items: item_id, source_path,
    destination_path, digest, byte_length; source and dest: relative_path, digest, byte_length."""
    side = lambda df, p: df.select(F.col("relative_path").alias(f"_{p}"), F.struct("digest", "byte_length").alias(p))
    out = items.join(side(source, "src"), F.col("source_path") == F.col("_src"), "left").join(side(dest, "dst"), F.col("destination_path") == F.col("_dst"), "left")
    same = lambda p: F.col(f"{p}.digest").eqNullSafe(F.col("digest")) & F.col(f"{p}.byte_length").eqNullSafe(F.col("byte_length"))
    result = F.when(F.col("dst").isNotNull(), F.when(same("dst"), "verified").otherwise("collision")).when(F.col("src").isNull(), "missing").when(~same("src"), "stale-source").otherwise("pending")
    return out.select("item_id", result.alias("result"))


def capacity_check(items: DataFrame, free: DataFrame) -> DataFrame:
    """Per plan whether what remains and the head room fit. free: plan_id, free_bytes."""
    rest = items.where(~F.col("status").isin("completed", "skipped")).groupBy("plan_id").agg(F.coalesce(F.sum("byte_length"), F.lit(0)).alias("remaining_bytes"))
    return free.join(rest, "plan_id", "left").na.fill(0, ["remaining_bytes"]).withColumn("fits", F.col("remaining_bytes") + HEAD_ROOM <= F.col("free_bytes"))


def capacity_by_item(items: DataFrame, free: DataFrame) -> DataFrame:
    """Open items with needed_bytes, the running sum of their plan up to them by ordinal, and fits: that sum and
    the head room are free. A plan's items are bounded, so its window is."""
    rest = items.where(~F.col("status").isin("completed", "skipped"))
    needed = F.sum(F.coalesce("byte_length", F.lit(0))).over(Window.partitionBy("plan_id").orderBy("ordinal", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    return rest.withColumn("needed_bytes", needed).join(free, "plan_id", "left").withColumn("fits", F.coalesce(F.col("needed_bytes") + HEAD_ROOM <= F.col("free_bytes"), F.lit(False)))


def restore_candidates(quarantine: DataFrame, snapshot: DataFrame, contents: DataFrame) -> DataFrame:
    """Active quarantine items with blocked_by: missing, content-changed or path-occupied; null where the item
    can be restored. quarantine: quarantine_id, root_id, original_path, digest, byte_length, status; contents:
    quarantine_id, digest, byte_length of what lies in quarantine now."""
    taken = snapshot.where("observation_status = 'observed'").select("root_id", F.col("relative_path").alias("original_path"), F.lit(True).alias("_t")).distinct()
    now = contents.select("quarantine_id", F.struct("digest", "byte_length").alias("_c"))
    out = quarantine.where("status = 'active'").join(taken, ["root_id", "original_path"], "left").join(now, "quarantine_id", "left")
    same = F.col("_c.digest").eqNullSafe(F.col("digest")) & F.col("_c.byte_length").eqNullSafe(F.col("byte_length"))
    return out.withColumn("blocked_by", F.when(F.col("_c").isNull(), "missing").when(~same, "content-changed").when(F.col("_t"), "path-occupied")).drop("_t", "_c")


def quarantine_count(quarantine: DataFrame) -> DataFrame:
    return quarantine.agg(F.count_if(F.col("status") == "active").alias("active"))


def retirement_allowed(approved: Column, writes: Column, retirement: Column) -> Column:
    """Null if a source may be retired, else why not."""
    return F.when(~approved, "not-approved").when(~writes, "writes-disabled").when(~retirement, "retirement-disabled")


def approvable_plans(counts: DataFrame, plans: DataFrame, roots: DataFrame) -> DataFrame:
    """Plans without items for review or failed, both of whose roots are approved and writable."""
    ok = roots.where("status = 'approved' and writes").select("root_id")
    clean = plans.join(counts.where("n_needs_review = 0 and n_failed = 0").select("plan_id"), "plan_id", "left_semi")
    return clean.join(ok.withColumnRenamed("root_id", "source_root_id"), "source_root_id", "left_semi").join(ok.withColumnRenamed("root_id", "target_root_id"), "target_root_id", "left_semi")


def resolve_items(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Items with resolved status; resolutions: item_id, status, for items that need review."""
    r = resolutions.select("item_id", F.col("status").alias("_r"))
    return items.join(r, "item_id", "left").withColumn("status", F.when(F.col("status") == "needs-review", F.coalesce("_r", "status")).otherwise(F.col("status"))).drop("_r")


def reviewed_plans(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Plans, those in review without an item left that needs it being ready-for-approval."""
    open_ = items.where("status = 'needs-review'").select("plan_id").distinct().withColumn("_o", F.lit(True))
    done = (F.col("status") == "needs-review") & F.col("_o").isNull()
    return plans.join(open_, "plan_id", "left").withColumn("status", F.when(done, "ready-for-approval").otherwise(F.col("status"))).drop("_o")
