"""Organization plans: which files move where, and whether a plan still holds."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import has_parent, is_within, split_filename
from ..functions.scalars import month_bucket, stable_id, year_bucket
from ..session import ship, written
from .snapshots import latest_scan, matches_observation


@dataclass(frozen=True)
class PlanOptions:
    strategy: str = "category"  # category, category-and-year, year-and-month
    scope: str = "entire-library"  # or top-level
    philosophy: str = "balanced"  # conservative, balanced, deep
    collision: str = "suffix"  # or skip
    target: str = "Organized"
    control: str = ".catalogue"
    include_hidden: bool = False
    maximum: int = 10_000

    def __post_init__(self):
        for name, allowed in (("strategy", ("category", "category-and-year", "year-and-month")), ("scope", ("entire-library", "top-level")), ("philosophy", ("conservative", "balanced", "deep")), ("collision", ("suffix", "skip"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if not 1 <= self.maximum <= 50_000:
            raise ValueError("maximum must be 1 to 50000")
        if not self.target or any(p in ("", ".", "..") for p in self.target.split("/")):
            raise ValueError("target must be a relative folder")


def blocked_records(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Records with an open review of their own or of a duplicate group they are in."""
    open_ = reviews.where("status = 'open'")
    own = open_.where("record_id is not null").select("record_id")
    by_group = open_.where("group_id is not null").select("group_id").distinct().join(members.select("group_id", "record_id"), "group_id").select("record_id")
    return own.unionByName(by_group).distinct()


def planning_evidence(files: DataFrame, understanding: DataFrame, blocked: DataFrame, group_members: DataFrame) -> DataFrame:
    """files with category, captured_at, explanation, uncertainty (any open review: needs-review), n_groups."""
    u = understanding.select("record_id", "category", "captured_at", "explanation", "uncertainty")
    n = group_members.groupBy("record_id").agg(F.count_distinct("group_id").alias("n_groups"))
    out = files.join(u, "record_id", "left").join(blocked.select("record_id", F.lit(True).alias("_b")), "record_id", "left").join(n, "record_id", "left")
    return out.withColumns({"uncertainty": F.when(F.col("_b"), "needs-review").otherwise(F.col("uncertainty")), "n_groups": F.coalesce("n_groups", F.lit(0))}).drop("_b")


def dispositions(evidence: DataFrame, options: PlanOptions = PlanOptions()) -> DataFrame:
    path = F.col("relative_path")
    d = F.when(F.lit(not options.include_hidden) & F.coalesce("hidden", F.lit(False)), "hidden")
    d = d.when(is_within(path, F.lit(options.control)) | is_within(path, F.lit(options.target)), "already-organized")
    if options.scope == "top-level" or options.philosophy == "conservative":
        d = d.when(has_parent(path), "preserved-by-scope")
    d = d.when(F.col("n_groups") > 0, "preserved-group").when(F.col("uncertainty") == "needs-review", "needs-review")
    return evidence.withColumn("disposition", d.otherwise("eligible"))


def desired_destination(options: PlanOptions = PlanOptions()) -> Column:
    at = F.coalesce("captured_at", "modified_at", "created_at")
    parts = {"category": ["category"], "category-and-year": ["category", year_bucket(at)], "year-and-month": [year_bucket(at), month_bucket(at)]}[options.strategy]
    return F.concat_ws("/", F.lit(options.target), *parts, "name")


def family(path: Column) -> Column:
    """Destination with trailing ' (n)' groups stripped: only files of one family can take each other's place."""
    cut = split_filename(path)
    return F.concat(F.regexp_replace(cut["stem"], r"( \(\d+\))+$", ""), cut["extension"])


#: Names that a destination has: itself, then ' (2)' to ' (10000)'.
NAMES = 10_000
_NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,3}|10000)\)\z"


def nth_name(destination: Column, slot: Column) -> Column:
    """The name that a destination has in a slot: itself in slot 1, else with ' (slot)' before its extension."""
    cut = split_filename(destination)
    return F.when(slot == 1, destination).otherwise(F.concat(cut["stem"], F.lit(" ("), slot.cast("string"), F.lit(")"), cut["extension"]))


def slot_of(path: Column) -> Column:
    """Struct (destination, slot) of which path is a numbered name; null for names without a number from 2 to NAMES."""
    cut = split_filename(path)
    number = F.regexp_extract(cut["stem"], _NUMBERED, 2)
    return F.when(number != "", F.struct(F.concat(F.regexp_extract(cut["stem"], _NUMBERED, 1), cut["extension"]).alias("destination"), number.cast("int").alias("slot")))


def _settle(names: int):
    def run(wishes: pd.DataFrame, observed: pd.DataFrame) -> pd.DataFrame:
        """One family in path order: the first free name, from the wish through ' (2)' to ' (names)'."""
        taken, out = set(observed["p"]), []
        free: dict[str, int] = {}
        for wish in (wishes := wishes.sort_values(["relative_path", "record_id"]))["destination"]:
            got = wish if wish not in taken else None
            if got is None:
                folder, _, name = wish.rpartition("/")
                at = name.rfind(".")
                stem, ext = (wish[: len(wish) - len(name) + at], name[at:]) if at >= 0 else (wish, "")
                for k in range(free.get(wish, 2), names + 1):
                    if f"{stem} ({k}){ext}" not in taken:
                        got, free[wish] = f"{stem} ({k}){ext}", k + 1
                        break
            if got is not None:
                taken.add(got)
            out.append(got)
        return pd.DataFrame({"record_id": wishes["record_id"], "final": out})

    return run


def resolve_collisions(wishes: DataFrame, observed: DataFrame, collision: str = "suffix") -> DataFrame:
    """wishes (record_id, relative_path, destination) with final, null where nothing is free.

    A destination's names are slots: 1 is itself, k its ' (k)'. Its k-th wish by path gets its k-th free slot, which
    is k plus the taken slots with fewer than k free ones before them: a running count over wishes and taken slots,
    without Python. At most NAMES wishes of a destination can get a name, so the others are set aside while they are
    counted, before any shuffle gathers them, and at most NAMES taken slots stand beside them.

    Only destinations of which one is a numbered name of another are settled one after another, by family, with
    the slots that matter to them; with "skip" there are none. The wishes are written once and read several times."""
    skip = collision == "skip"
    w = written(wishes.select("record_id", "relative_path", "destination"), "wishes")
    turn = F.row_number().over(Window.partitionBy("destination").orderBy("relative_path", "record_id"))
    first = w.withColumn("turn", turn).where(F.col("turn") <= (1 if skip else NAMES))
    wished = w.select("destination").distinct()
    have = observed.select(F.col("relative_path").alias("destination"), F.lit(1).alias("slot"))
    if not skip:
        have = have.unionByName(observed.select(slot_of(F.col("relative_path")).alias("s")).where("s is not null").select("s.destination", "s.slot"))
    have = have.join(wished, "destination", "left_semi").distinct()
    later, settled = first, None
    if not skip:
        pairs = wished.select("destination", slot_of(F.col("destination"))["destination"].alias("base")).where("base is not null")
        pairs = pairs.join(wished.select(F.col("destination").alias("base")), "base", "left_semi")
        linked = pairs.select("destination").unionByName(pairs.select(F.col("base").alias("destination"))).distinct()
        ship(w.sparkSession)
        of = family(F.col("destination")).alias("_f")
        fed = first.join(linked, "destination", "left_semi").select("record_id", "relative_path", "destination", of)
        met = have.join(linked, "destination", "left_semi").select(nth_name(F.col("destination"), F.col("slot")).alias("p"), of)
        settled = fed.groupBy("_f").cogroup(met.groupBy("_f")).applyInPandas(_settle(NAMES), "record_id string, final string")
        later = first.join(linked, "destination", "left_anti")
    free = F.col("slot") - F.row_number().over(Window.partitionBy("destination").orderBy("slot"))
    taken = have.select("destination", free.alias("at"), F.lit(1).alias("taken"))
    rows = later.select("record_id", "destination", F.col("turn").alias("at"), F.lit(0).alias("taken")).unionByName(taken, allowMissingColumns=True)
    before = F.sum("taken").over(Window.partitionBy("destination").orderBy("at", "taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("slot", (F.col("at") + before).cast("int")).where(F.col("taken") == 0)
    ranked = ranked.select("record_id", F.when(F.col("slot") <= (1 if skip else NAMES), nth_name(F.col("destination"), F.col("slot"))).alias("final"))
    return wishes.join(ranked if settled is None else ranked.unionByName(settled), "record_id", "left")


def rationale(options: PlanOptions = PlanOptions()) -> Column:
    ext = F.coalesce(F.lower("extension"), F.lit("no extension"))
    said = F.coalesce("explanation", F.concat(ext, F.lit(" files count as "), F.col("category")))
    if options.strategy == "category":
        return F.concat(said, F.lit(f"; the {options.philosophy} plan puts it in "), F.col("category"))
    if options.strategy == "category-and-year":
        return F.concat(said, F.lit("; by capture date, else file date"))
    return F.lit("by observed year and month")


def ordinal(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first `limit` rows in order with their position from 0; the limit bounds the one-task numbering."""
    return df.orderBy(order).limit(limit).withColumn("ordinal", F.row_number().over(Window.orderBy(order)) - 1)


def plan(evidence: DataFrame, observed: DataFrame, options: PlanOptions = PlanOptions()) -> tuple[DataFrame, DataFrame]:
    """(operations, fates). fates has every file's disposition, the planned ones as planned or limited-out."""
    facts = ["byte_length", "modified_at", "device_id", "filesystem_record_id"]
    judged = dispositions(evidence, options).select("record_id", "relative_path", "disposition", "category", *facts, desired_destination(options).alias("destination"), rationale(options).alias("rationale"))
    judged = written(judged, "judged")
    settled = resolve_collisions(judged.where("disposition = 'eligible'"), observed, options.collision)
    fate = F.when(F.col("final").isNull(), "conflict-skipped").when(F.col("final") == F.col("relative_path"), "already-organized")
    settled = written(settled.withColumn("fate", fate), "settled")
    ops = ordinal(settled.where("fate is null").select("record_id", "relative_path", "final", "category", *facts, "rationale"), "relative_path", options.maximum)
    ops = ops.withColumn("operation_id", stable_id("operation", F.col("ordinal"), F.col("relative_path"), F.col("final")))
    planned = ops.select("record_id", F.lit("planned").alias("_p"))
    rest = settled.join(planned, "record_id", "left").select("record_id", F.coalesce("fate", "_p", F.lit("limited-out")).alias("disposition"))
    return ops, judged.where("disposition <> 'eligible'").select("record_id", "disposition").unionByName(rest)


def plan_counts(fates: DataFrame) -> DataFrame:
    return fates.groupBy("disposition").agg(F.count("*").alias("n"))


def category_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("category").agg(F.count("*").alias("n"), F.sum("byte_length").alias("bytes"))


def plan_is_fresh(plans: DataFrame, scans: DataFrame) -> DataFrame:
    """plans (plan_id, root_id, scan_id) with fresh: their scan is the root's latest, and completed."""
    now = latest_scan(scans).select("root_id", F.col("scan_id").alias("_s"), "status")
    return plans.join(now, "root_id", "left").withColumn("fresh", F.coalesce((F.col("_s") == F.col("scan_id")) & (F.col("status") == "completed"), F.lit(False))).drop("_s", "status")


def simulate_plan(ops: DataFrame, snapshot: DataFrame, rollback: bool = False) -> DataFrame:
    """operation_id, outcome of each operation against a newer snapshot."""
    source, dest = ("final", "relative_path") if rollback else ("relative_path", "final")
    facts = ["byte_length", "modified_at", "device_id", "filesystem_record_id"]
    seen = snapshot.where("observation_status = 'observed'")
    side = lambda p, key: seen.select(F.col("relative_path").alias(key), F.struct("entry_type", *facts).alias(p))
    out = ops.withColumnsRenamed({f: f"want_{f}" for f in facts}).withColumns({"_src": F.col(source), "_dst": F.col(dest)})
    out = out.join(side("s", "_src"), "_src", "left").join(side("d", "_dst"), "_dst", "left")
    same = lambda p: matches_observation({f: F.col(f"want_{f}") for f in facts}, {f: F.col(p)[f] for f in facts})
    done, would = ("already-rolled-back", "would-rollback") if rollback else ("already-completed", "simulated")
    outcome = (
        F.when(F.col("s").isNull(), F.when(F.col("d").isNotNull() & same("d"), done).otherwise("failed"))
        .when(F.col("s.entry_type") != "file", "skipped")
        .when(~same("s"), "skipped")
        .when(F.col("d").isNotNull(), "skipped")
        .otherwise(would)
    )
    return out.select("operation_id", outcome.alias("outcome"))


def simulate_rollback(ops: DataFrame, snapshot: DataFrame) -> DataFrame:
    return simulate_plan(ops, snapshot, rollback=True)


def pending_ops(ops: DataFrame, items: DataFrame) -> DataFrame:
    return ops.join(items.select("operation_id"), "operation_id", "left_anti")


def rollback_ops(ops: DataFrame, source_items: DataFrame, done: DataFrame) -> DataFrame:
    """Operations a run moved and no rollback undid, last first."""
    moved = source_items.where(F.col("outcome").isin("moved", "already-completed")).select("operation_id")
    back = done.where(F.col("outcome").isin("rolled-back", "already-rolled-back")).select("operation_id")
    return ops.join(moved, "operation_id", "left_semi").join(back, "operation_id", "left_anti").orderBy(F.desc("ordinal"))


def items_with_ops(items: DataFrame, ops: DataFrame) -> DataFrame:
    return items.join(ops, "operation_id")


def run_counts(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Per run: total, processed, succeeded, skipped, failed. totals: run_id, total."""
    good = ["moved", "simulated", "already-completed", "rolled-back", "would-rollback", "already-rolled-back"]
    c = items.groupBy("run_id").agg(F.count("*").alias("processed"), F.count_if(F.col("outcome").isin(good)).alias("succeeded"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return totals.join(c, "run_id", "left").na.fill(0)


def run_status(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", F.when((F.col("failed") > 0) | (F.col("skipped") > 0), "partial").otherwise("completed"))


def run_violations(runs: DataFrame) -> DataFrame:
    """plan_id, violation: two active runs, two finished live runs, or a rollback not of a live run of its plan."""
    per = runs.groupBy("plan_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("a"), F.count_if((F.col("mode") == "live") & F.col("status").isin("completed", "partial")).alias("b"))
    two = per.where("a > 1").select("plan_id", F.lit("several-active-runs").alias("violation")).unionByName(per.where("b > 1").select("plan_id", F.lit("several-live-runs").alias("violation")))
    live = runs.where("mode = 'live'").select("plan_id", F.col("run_id").alias("source_run_id"))
    lost = runs.where("mode = 'rollback'").join(live, ["plan_id", "source_run_id"], "left_anti").select("plan_id", F.lit("rollback-without-live-run").alias("violation"))
    return two.unionByName(lost)
