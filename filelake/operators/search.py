"""Search with optional filters, named orders, and paging by key or offset.

Text filters are substrings without regard to ASCII case. Every order ends in a unique key."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bounded_limit


def _has(column: str, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def _text(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(_has(c, text), F.lit(False))
    return df.where(hit)


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(column) == value)
    return df


def _between(df: DataFrame, column: str, low, high) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def search_inventory(files: DataFrame, text: str | None = None, entry_type: str | None = None, extension: str | None = None) -> DataFrame:
    df = _equal(_text(files, text, "name", "relative_path"), entry_type=entry_type)
    return df if extension is None else df.where(F.lower("extension") == extension.lstrip(".").lower())


def enrich(files: DataFrame, hashes: DataFrame, understanding: DataFrame) -> DataFrame:
    h = hashes.select("record_id", "digest", "verification_state")
    u = understanding.select("record_id", "category", "confidence", "uncertainty", "mime_type", "captured_at")
    return files.join(h, "record_id", "left").join(u, "record_id", "left")


def without_membership(files: DataFrame, members: DataFrame) -> DataFrame:
    return files.join(members.select("record_id"), "record_id", "left_anti")


def with_artwork(understanding: DataFrame) -> DataFrame:
    """Files in folders that hold an image."""
    art = understanding.where("category = 'Images'").select("scan_id", "parent_path")
    return understanding.join(art, ["scan_id", "parent_path"], "left_semi")


def flags(members: DataFrame, candidates: DataFrame, reviews: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id with what the EXISTS filters ask, one row each: pre-aggregated, not a join per filter."""
    mark = lambda df, name: df.select("record_id", F.lit(name).alias("flag"))
    all_ = mark(members, "exact").unionByName(mark(candidates, "candidate")).unionByName(mark(reviews.where("status = 'open'"), "review")).unionByName(mark(groups, "group"))
    return all_.groupBy("record_id").agg(*[F.bool_or(F.col("flag") == x).alias("in_" + x) for x in ("exact", "candidate", "review", "group")])


def search_enriched(enriched: DataFrame, flagged: DataFrame, text=None, category=None, extension=None, mime_prefix=None, duplicate_state=None, needs_review=None, in_group=None, uncertainty=None, min_bytes=None, max_bytes=None, modified_from=None, modified_to=None, captured_from=None, captured_to=None, hidden=None, entry_type=None) -> DataFrame:
    df = search_inventory(enriched, text, entry_type, extension)
    df = _equal(df, category=category, uncertainty=uncertainty, hidden=hidden)
    df = _between(_between(_between(df, "byte_length", min_bytes, max_bytes), "modified_at", modified_from, modified_to), "captured_at", captured_from, captured_to)
    if mime_prefix:
        df = df.where(F.startswith(F.lower("mime_type"), F.lit(mime_prefix.lower())))
    df = df.join(flagged, "record_id", "left").na.fill(False, ["in_exact", "in_candidate", "in_review", "in_group"])
    state = F.when(F.col("in_exact"), "exact").when(F.col("in_candidate"), "candidate").otherwise("unique")
    df = _equal(df.withColumn("duplicate_state", state), in_review=needs_review, in_group=in_group)
    if duplicate_state == "candidate":  # also those that turned out exact
        return df.where("in_candidate")
    return _equal(df, duplicate_state=duplicate_state)


GROUP_ORDERS = {"reclaimable": ["reclaimable_bytes"], "copies": ["copies"], "size": ["byte_length"], "total": ["total_bytes"]}


def sort_groups(df: DataFrame, order: str = "reclaimable") -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in GROUP_ORDERS[order]], F.asc("group_id"))


def search_duplicates(groups: DataFrame, members: DataFrame, keepers: DataFrame, text=None, min_reclaimable=None, state=None, order="reclaimable") -> DataFrame:
    df = _between(_equal(groups, state=state), "reclaimable_bytes", min_reclaimable, None)
    if text:
        df = df.join(_text(members, text, "relative_path").select("group_id"), "group_id", "left_semi")
    df = df.join(keepers.select("group_id", "keepers"), "group_id", "left").na.fill(0, ["keepers"])
    return sort_groups(df, order)


def duplicate_members(members: DataFrame, group_id: str) -> DataFrame:
    return lookup(members, "group_id", group_id).orderBy("relative_path", "record_id")


def search_reviews(reviews: DataFrame, root_id=None, scan_id=None, reason=None, status="open", text=None) -> DataFrame:
    searched = [c for c in ("title", "description") if c in reviews.columns]
    return _text(_equal(reviews, root_id=root_id, scan_id=scan_id, reason=reason, status=status), text, *searched).orderBy("review_id")


def search_deltas(deltas: DataFrame, kind=None, text=None) -> DataFrame:
    return _text(_equal(deltas, kind=kind), text, "relative_path").orderBy("relative_path", "delta_id")


def search_quarantine(items: DataFrame, root_id=None, status=None, text=None) -> DataFrame:
    return _text(_equal(items, root_id=root_id, status=status), text, "original_path").orderBy("quarantine_id")


def list_transfers(plans: DataFrame, kind=None, status=None) -> DataFrame:
    return _equal(plans, kind=kind, status=status).orderBy(F.desc("created_at"), "plan_id")


def list_plans(plans: DataFrame, root_id=None, status=None) -> DataFrame:
    return _equal(plans, root_id=root_id, status=status).orderBy(F.desc("created_at"), "plan_id")


def list_transfer_items(items: DataFrame, plan_id=None, status=None) -> DataFrame:
    return _equal(items, plan_id=plan_id, status=status).orderBy("plan_id", "ordinal", "item_id")


def list_operations(ops: DataFrame, plan_id, category=None) -> DataFrame:
    return _equal(ops, plan_id=plan_id, category=category).orderBy(F.asc_nulls_last("ordinal"), "operation_id")


def list_runs(runs: DataFrame, plan_id=None, mode=None, status=None) -> DataFrame:
    return _equal(runs, plan_id=plan_id, mode=mode, status=status).orderBy(F.desc("created_at"), "run_id")


def list_run_items(items: DataFrame, ops: DataFrame, run_id, outcome=None) -> DataFrame:
    """A run's items beside what they were to do, in the plan's order."""
    return _equal(items, run_id=run_id, outcome=outcome).join(ops, "operation_id").orderBy(F.asc_nulls_last("ordinal"), "operation_id")


def list_audit(entries: DataFrame, run_id=None, kind=None) -> DataFrame:
    return _equal(entries, run_id=run_id, kind=kind).orderBy(F.asc_nulls_last("sequence"))


def list_jobs(jobs: DataFrame, statuses=None) -> DataFrame:
    return _equal(jobs, status=statuses).orderBy(F.desc("submitted_at"), "job_id")


def job_history(events: DataFrame, job_id, after: int = 0) -> DataFrame:
    return lookup(events, "job_id", job_id).where(F.col("sequence") > after).orderBy("sequence")


def list_roots(roots: DataFrame, role=None, with_revoked: bool = False) -> DataFrame:
    df = _equal(roots, role=role)
    return (df if with_revoked else df.where("status <> 'revoked'")).orderBy("root_id")


def list_scans(scans: DataFrame, root_id=None) -> DataFrame:
    return _equal(scans, root_id=root_id).orderBy(F.desc("started_at"), F.desc("scan_id"))


def list_reconciliations(runs: DataFrame, root_id=None, status=None) -> DataFrame:
    return _equal(runs, root_id=root_id, status=status).orderBy(F.desc("created_at"), F.desc("run_id"))


def observed_paths(files: DataFrame, paths: DataFrame, platform: str = "posix") -> DataFrame:
    """Of paths (relative_path) those that a snapshot has."""
    from ..functions.paths import path_key

    have = files.where("observation_status = 'observed'").select(path_key(F.col("relative_path"), platform).alias("_k"))
    return paths.withColumn("_k", path_key(F.col("relative_path"), platform)).join(have, "_k", "left_semi").drop("_k")


def _cursor(kind: str, values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps({"k": kind, "v": values}, default=str).encode()).decode().rstrip("=")


def _uncursor(kind: str, cursor: str) -> list:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if found.get("k") != kind:
        raise ValueError("the cursor is of another listing")
    return found["v"]


def after_key(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Rows behind a key: one range filter on (k1, k2, ...)."""
    hit, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, values, strict=True):
        hit, same = hit | (same & (F.col(k) > v)), same & (F.col(k) == v)
    return df.where(hit)


#: Rows of a page where none are asked for, and at most.
PAGE, LARGEST_PAGE = 50, 1000


def page_keyset(df: DataFrame, keys: list[str], cursor: str | None, n: int | None = None, kind: str = "page") -> tuple[list, str | None]:
    """(rows, next cursor): up to n rows behind the cursor, by one top-n with look-ahead."""
    n = bounded_limit(n, PAGE, LARGEST_PAGE)
    if cursor:
        df = after_key(df, keys, _uncursor(kind, cursor))
    rows = df.orderBy(*keys).limit(n + 1).collect()
    return rows[:n], _cursor(kind, [rows[n - 1][k] for k in keys]) if len(rows) > n else None


def page_offset(df: DataFrame, order: list[Column], cursor: str | None, n: int | None = None, kind: str = "offset") -> tuple[list, str | None]:
    n = bounded_limit(n, PAGE, LARGEST_PAGE)
    k = _uncursor(kind, cursor)[0] if cursor else 0
    rows = df.orderBy(*order).offset(k).limit(n + 1).collect()
    return rows[:n], _cursor(kind, [k + n]) if len(rows) > n else None


def attention(jobs: DataFrame, scans: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """kind, id, n: failed jobs and scans, failed or partial runs, one line for all open reviews."""
    pick = lambda df, kind, key, bad: df.where(F.col("status").isin(bad)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(1).cast("long").alias("n"))
    line = reviews.where("status = 'open'").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("reviews").alias("kind"), F.lit("all").alias("id"), "n")
    return pick(jobs, "job", "job_id", ["failed"]).unionByName(pick(scans, "scan", "scan_id", ["failed"])).unionByName(pick(runs, "run", "run_id", ["failed", "partial"])).unionByName(line)
