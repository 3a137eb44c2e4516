"""Queries for organization plans, transfers, ledgers and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import duplicates as D
from ..operators import facts as X
from ..operators import ledger as E
from ..operators import organize as O
from ..operators import transfer as T
from ..streaming import streams as ST
from .fixtures import BOTH_SQL, EVENTS_SQL, FILES_SQL, files, files2, job_events, table
from .listings import _JOBS, _jobs, scratch
from .registry import _EXT, _ITEMS, H, _case, _hashed, _items, query

# Organization.

#: Files whose names collide, with and without suffixes, and where they wish to go.
_WISHES = (
    FILES_SQL.replace("WITH files", "WITH RECURSIVE files")
    + f""", w0 AS (SELECT f.record_id, f.doc_id, f.extension, d.lang || '/d' || f.doc_id AS folder, 'f' || f.doc_id % 50 AS stem, CASE WHEN f.doc_id % 13 = 0 THEN ' (2)' ELSE '' END AS mark, 'Organized/' || {_case(_EXT)} || '/' AS target FROM files f JOIN documents d USING (doc_id)),
 w AS (SELECT *, target || stem || mark || '.' || extension AS destination, target || stem || '.' || extension AS fam, folder || '/' || stem || mark || '.' || extension AS relative_path FROM w0)"""
)


def _plan_files(spark, d) -> DataFrame:
    stem = F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 13 == 0, " (2)").otherwise(""))
    name = F.concat(stem, F.lit("."), "extension")
    parent = F.concat(F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return files(spark, d).drop("content").join(docs, "doc_id").withColumns({"name": name, "parent_path": parent, "relative_path": F.concat_ws("/", parent, name)})


def _wishes(spark, d) -> DataFrame:
    return _plan_files(spark, d).select("doc_id", "record_id", "relative_path", F.concat_ws("/", F.lit("Organized"), C.category_for_extension(F.col("extension")), "name").alias("destination"))


@query(
    "o4_resolve_collisions",
    _WISHES
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY relative_path) AS i FROM w),
 r AS (SELECT fam, 0::BIGINT AS i, NULL::VARCHAR AS record_id, NULL::VARCHAR AS destination, NULL::VARCHAR AS final, coalesce(list(DISTINCT destination) FILTER (doc_id % 17 = 0), []) AS taken FROM w GROUP BY fam
  UNION ALL SELECT fam, i, record_id, destination, pick, list_append(taken, pick) FROM (SELECT o.fam, o.i, o.record_id, o.destination, r.taken, CASE WHEN NOT list_contains(r.taken, o.destination) THEN o.destination
   ELSE list_filter(list_transform(range(2, len(r.taken) + 3), lambda k: o.target || o.stem || o.mark || ' (' || k || ').' || o.extension), lambda x: NOT list_contains(r.taken, x))[1] END AS pick FROM r JOIN o ON o.fam = r.fam AND o.i = r.i + 1))
 SELECT record_id, destination, final FROM r WHERE i > 0""",
)
def _o4(spark, d):
    w = _wishes(spark, d)
    observed = w.select("relative_path").unionByName(w.where("doc_id % 17 = 0").select(F.col("destination").alias("relative_path")))
    return O.resolve_collisions(w.drop("doc_id"), observed).select("record_id", "destination", "final")


def _eligible(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return _plan_files(spark, d).withColumns({"category": C.category_for_extension(F.col("extension")), "captured_at": F.lit(None).cast("timestamp"), "explanation": none, "uncertainty": F.lit("confident"), "n_groups": F.when(F.col("doc_id") % 19 == 0, 1).otherwise(0), "hidden": F.col("doc_id") % 23 == 0})


_FATES = _WISHES + """, e AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'hidden' WHEN doc_id % 19 = 0 THEN 'preserved-group' END AS kept FROM w),
 s AS (SELECT record_id, relative_path, destination, row_number() OVER (PARTITION BY destination ORDER BY relative_path) AS n FROM e WHERE kept IS NULL),
 p AS (SELECT *, row_number() OVER (ORDER BY relative_path) AS place FROM s WHERE n = 1)"""


@query(
    "o5_capped_fates",
    _FATES + " SELECT record_id, kept AS disposition FROM e WHERE kept IS NOT NULL UNION ALL SELECT record_id, 'conflict-skipped' FROM s WHERE n > 1 UNION ALL SELECT record_id, CASE WHEN place <= 40 THEN 'planned' ELSE 'limited-out' END FROM p",
)
def _o5c(spark, d):
    return O.plan(_eligible(spark, d), _plan_files(spark, d), O.PlanOptions(collision="skip", maximum=40))[1]


@query("a10_category_counts", _FATES + " SELECT split_part(destination, '/', 2) AS category, count(*) AS n FROM p WHERE place <= 40 GROUP BY 1")
def _a10(spark, d):
    return O.category_counts(O.plan(_eligible(spark, d), _plan_files(spark, d), O.PlanOptions(collision="skip", maximum=40))[0]).select("category", "n")


@query("o1_scoped_dispositions", FILES_SQL + " SELECT record_id, CASE WHEN parent_path LIKE 'proj%' THEN 'already-organized' WHEN parent_path <> '' THEN 'preserved-by-scope' ELSE 'eligible' END AS disposition FROM files")
def _o1s(spark, d):
    e = files(spark, d).drop("content").withColumns({"n_groups": F.lit(0), "uncertainty": F.lit("confident"), "relative_path": F.when(F.startswith("parent_path", F.lit("proj")), F.concat(F.lit("Sorted/"), "relative_path")).otherwise(F.col("relative_path"))})
    return O.dispositions(e, O.PlanOptions(philosophy="conservative", include_hidden=True, target="Sorted")).select("record_id", "disposition")


@query(
    "o6_rationales",
    FILES_SQL + f" SELECT record_id, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE lower(extension) || ' files count as ' || {_case(_EXT)} END || '; the deep plan puts it in ' || {_case(_EXT)} AS by_category, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE lower(extension) || ' files count as ' || {_case(_EXT)} END || '; by capture date, else file date' AS by_year, 'by observed year and month' AS by_month, 'Sorted/' || strftime(modified_at, '%Y/%m') || '/' || name AS destination FROM files",
)
def _o6(spark, d):
    e = files(spark, d).drop("content").withColumns({"category": C.category_for_extension(F.col("extension")), "explanation": F.when(F.col("doc_id") % 2 == 0, "seen"), "captured_at": F.lit(None).cast("timestamp")})
    of = lambda strategy: O.PlanOptions(strategy=strategy, philosophy="deep", target="Sorted")
    year, month = of("category-and-year"), of("year-and-month")
    return e.select("record_id", O.rationale(of("category")).alias("by_category"), O.rationale(year).alias("by_year"), O.rationale(month).alias("by_month"), O.desired_destination(month).alias("destination"))


def _ops(spark, d) -> DataFrame:
    return files(spark, d).where("not hidden").select(F.col("record_id").alias("operation_id"), "doc_id", "relative_path", F.concat(F.lit("Organized/"), "relative_path").alias("final"), "byte_length", "modified_at", "device_id", "filesystem_record_id", F.col("doc_id").alias("ordinal"))


@query(
    "o10_simulate_rollback",
    FILES_SQL + " SELECT record_id AS operation_id, CASE WHEN doc_id % 4 = 0 THEN 'would-rollback' WHEN doc_id % 4 = 1 THEN 'already-rolled-back' WHEN doc_id % 4 = 2 THEN 'skipped' ELSE 'failed' END AS outcome FROM files WHERE NOT hidden",
)
def _o10(spark, d):
    """Moved; moved back already; moved and grown since; gone."""
    k = F.col("doc_id") % 4
    f = files(spark, d).drop("content")
    now = f.where(k < 3).withColumns({"relative_path": F.when(k == 1, F.col("relative_path")).otherwise(F.concat(F.lit("Organized/"), "relative_path")), "byte_length": F.col("byte_length") + F.when(k == 2, 1).otherwise(0)})
    return O.simulate_rollback(_ops(spark, d), now)


@query(
    "j14_run_items",
    FILES_SQL + ", o AS (SELECT record_id, doc_id FROM files WHERE NOT hidden) SELECT 'pending' AS listing, record_id AS operation_id FROM o WHERE doc_id % 3 = 0 UNION ALL SELECT 'rollback', record_id FROM o WHERE doc_id % 3 = 1 AND doc_id % 2 = 0 UNION ALL SELECT 'items', record_id FROM o WHERE doc_id % 3 > 0",
)
def _j14(spark, d):
    ops = _ops(spark, d)
    items = ops.where("doc_id % 3 > 0").select("operation_id", F.when(F.col("doc_id") % 3 == 1, "moved").otherwise("failed").alias("outcome"))
    back = ops.where("doc_id % 2 = 1").select("operation_id", F.lit("rolled-back").alias("outcome"))
    named = lambda name, df: df.select(F.lit(name).alias("listing"), "operation_id")
    both = O.items_with_ops(items, ops).where("relative_path is not null")
    return named("pending", O.pending_ops(ops, items)).unionByName(named("rollback", O.rollback_ops(ops, items, back))).unionByName(named("items", both))


@query(
    "o12_run_violations",
    """WITH r AS (SELECT o_custkey AS plan_id, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'rollback' ELSE 'live' END AS mode FROM orders),
 g AS (SELECT plan_id, count(*) FILTER (status = 'running') AS a, count(*) FILTER (mode = 'live' AND status = 'completed') AS b FROM r GROUP BY 1)
 SELECT plan_id, 'several-active-runs' AS violation FROM g WHERE a > 1 UNION ALL SELECT plan_id, 'several-live-runs' FROM g WHERE b > 1
 UNION ALL SELECT plan_id, 'rollback-without-live-run' FROM r WHERE mode = 'rollback' AND NOT EXISTS (SELECT 1 FROM r l WHERE l.mode = 'live' AND l.plan_id = r.plan_id AND l.run_id = r.run_id - 1)""",
)
def _o12(spark, d):
    r = table(spark, d, "orders").selectExpr("o_custkey as plan_id", "o_orderkey as run_id", "o_orderkey - 1 as source_run_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as status", "case when o_orderkey % 3 = 0 then 'rollback' else 'live' end as mode")
    return O.run_violations(r)


# Transfers.


@query(
    "t1_triage_ingest",
    H + f""", m AS (SELECT a.record_id AS i, count(*) AS n, string_agg(b.record_id, ',' ORDER BY b.root_id, b.relative_path, b.record_id) AS r FROM hashes a JOIN hashes b USING (digest, byte_length) WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY 1)
      SELECT record_id, CASE WHEN i IS NOT NULL THEN 'exact-duplicate' WHEN extension = 'foo' THEN 'needs-review' ELSE 'ready' END AS status, coalesce(n, 0) AS n_matches, r AS matches,
      CASE WHEN i IS NULL THEN (CASE WHEN parent_path <> '' THEN 'Imported/' || relative_path ELSE 'Imported/' || {_case(_EXT)} || '/' || name END) END AS destination FROM hashes LEFT JOIN m ON i = record_id WHERE doc_id % 2 = 1""",
)
def _t1(spark, d):
    """Incoming files against the catalogue, with up to 500 matches each."""
    h = _hashed(spark, d)
    mime = X.sniff_type(F.encode("content", "UTF-8"), F.col("extension"))["mime_type"]
    items = h.where("doc_id % 2 = 1").withColumns({"item_id": F.col("record_id"), "mime_type": mime, "n_failed": F.lit(0)}).drop("content")
    have = h.where("doc_id % 2 = 0").drop("content")
    head = have.select("root_id", "scan_id").distinct().withColumns({"status": F.lit("completed"), "started_at": F.lit("2024-01-01").cast("timestamp")})
    top = D.top_matches(items, D.current_hashes(have, head))
    return T.triage_ingest(items, top).select("record_id", "status", "n_matches", F.array_join(F.transform("matches", lambda x: x["record_id"]), ",").alias("matches"), "destination")


@query(
    "t4_strategy",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'copy-verify-preserve-source' WHEN o_orderkey % 3 = 0 THEN 'same-filesystem-rename' WHEN o_orderkey % 3 = 1 THEN 'cross-filesystem-copy-verify-quarantine-source' END AS strategy, (CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 3 ELSE 0 END)::INTEGER AS steps, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 2 THEN 'review-required' ELSE 'planned' END AS status, o_orderkey % 2 = 1 AND o_orderkey % 3 = 2 AS explained FROM orders",
)
def _t4(spark, d):
    k = F.col("o_orderkey")
    s = T.transfer_strategy(F.when(k % 2 == 0, "copy").otherwise("relocate"), F.when(k % 3 == 0, "same-filesystem").when(k % 3 == 1, "cross-filesystem").otherwise("unknown"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.strategy", F.size("s.steps").alias("steps"), "s.status", F.col("s.reason").isNotNull().alias("explained"))


_DECIDED = H + """, g AS (SELECT digest, byte_length, min(doc_id) AS k FROM hashes GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT h.record_id, h.doc_id, g.digest, k,
 CASE WHEN k % 3 = 0 THEN 'consolidate' WHEN k % 3 = 1 THEN 'keep' WHEN h.doc_id = k THEN 'keep' ELSE 'consolidate' END AS decision FROM hashes h JOIN g USING (digest, byte_length))"""


@query(
    "t5_consolidation",
    _DECIDED + " SELECT record_id, 'item' AS kind FROM m WHERE k % 3 = 2 AND decision = 'consolidate' AND doc_id % 5 > 0 UNION ALL SELECT digest, CASE WHEN any_value(k) % 3 = 0 THEN 'no-keeper' ELSE 'no-copy' END FROM m WHERE k % 3 < 2 GROUP BY 1",
)
def _t5(spark, d):
    """Groups without a keeper, without a copy, and sound ones, of which one file in five has changed since."""
    h = _hashed(spark, d).drop("content")
    m = D.exact_members(h).select("group_id", "record_id", "digest", "doc_id")
    k = m.groupBy("group_id").agg(F.min("doc_id").alias("k"))
    decision = F.when(F.col("k") % 3 == 0, "consolidate").when(F.col("k") % 3 == 1, "keep").when(F.col("doc_id") == F.col("k"), "keep").otherwise("consolidate")
    m = m.join(k, "group_id").withColumn("decision", decision)
    current = h.select("record_id", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("digest")).alias("digest"))
    items, bad = T.consolidation_plan(m, current)
    digest = m.groupBy("group_id").agg(F.first("digest").alias("digest"))
    return items.select("record_id", F.lit("item").alias("kind")).unionByName(bad.join(digest, "group_id").select(F.col("digest").alias("record_id"), F.col("violation").alias("kind")))


@query(
    "t6_cross_volume",
    FILES_SQL + " SELECT record_id, CASE WHEN doc_id % 7 = 1 THEN 'not-observed' WHEN doc_id % 7 = 2 THEN 'no-digest' WHEN device_id = 'dev1' THEN 'same-volume' ELSE 'item' END AS kind FROM files WHERE doc_id < 3000",
)
def _t6(spark, d):
    """A plan takes 10,000 files at most; ids repeat and count once."""
    f = _hashed(spark, d).drop("content")
    k = F.col("doc_id") % 7
    ids = f.where("doc_id < 3000").select("record_id")
    now = f.withColumn("observation_status", F.when(k == 1, "skipped").otherwise("observed"))
    items, bad = T.cross_volume_plan(ids.unionByName(ids), now, f.where(k != 2), "dev1")
    return items.select("record_id", F.lit("item").alias("kind")).unionByName(bad.select("record_id", F.col("violation").alias("kind")))


_LINES = "SELECT o_custkey AS plan_id, o_orderkey AS ordinal, o_orderkey AS item_id, cast(floor(o_totalprice) AS bigint) * 100 AS byte_length, CASE o_orderstatus WHEN 'P' THEN 'completed' WHEN 'O' THEN 'ready' ELSE 'failed' END AS status FROM orders"


@query(
    "t8_running_capacity",
    f"WITH i AS ({_LINES}), n AS (SELECT *, sum(byte_length) OVER (PARTITION BY plan_id ORDER BY ordinal, item_id ROWS UNBOUNDED PRECEDING)::BIGINT AS needed_bytes FROM i WHERE status <> 'completed') SELECT plan_id, ordinal, item_id, needed_bytes, needed_bytes + 16777216 <= 90000000 AS fits FROM n",
)
def _t8(spark, d):
    i = spark.sql(_LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    free = i.select("plan_id").distinct().withColumn("free_bytes", F.lit(90000000))
    return T.capacity_by_item(i, free).select("plan_id", "ordinal", "item_id", "needed_bytes", "fits")


@query(
    "t9_restore_candidates",
    FILES_SQL + " SELECT record_id AS quarantine_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'content-changed' WHEN doc_id % 5 = 2 THEN 'path-occupied' END AS blocked_by FROM files WHERE doc_id % 3 > 0",
)
def _t9(spark, d):
    h = _hashed(spark, d).drop("content")
    k = F.col("doc_id") % 5
    q = h.select("doc_id", F.col("record_id").alias("quarantine_id"), "root_id", F.col("relative_path").alias("original_path"), "digest", "byte_length", F.when(F.col("doc_id") % 3 > 0, "active").otherwise("restored").alias("status"))
    contents = q.where(k > 0).select("quarantine_id", F.when(k == 1, "other").otherwise(F.col("digest")).alias("digest"), "byte_length")
    return T.restore_candidates(q.drop("doc_id"), h.where(k == 2), contents).select("quarantine_id", "blocked_by")


@query("a18_quarantine_count", "SELECT count(*) AS active FROM labels WHERE toxic = 0")
def _a18(spark, d):
    return T.quarantine_count(table(spark, d, "labels").select(F.when(F.col("toxic") == 0, "active").otherwise("restored").alias("status")))


@query("t10_retirement", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'not-approved' WHEN c_custkey % 3 = 0 THEN 'writes-disabled' WHEN c_custkey % 5 = 0 THEN 'retirement-disabled' END AS refused FROM customer")
def _t10(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.retirement_allowed(k % 2 > 0, k % 3 > 0, k % 5 > 0).alias("refused"))


@query(
    "t11_approvable_plans",
    _ITEMS + " SELECT plan_id FROM i GROUP BY 1 HAVING count(*) FILTER (status IN ('needs-review', 'failed')) = 0 AND plan_id % 5 > 0 AND plan_id % 7 > 0",
)
def _t11(spark, d):
    counts = T.transfer_counts(_items(spark, d))
    plans = counts.select("plan_id", (F.col("plan_id") % 5).alias("source_root_id"), (F.col("plan_id") % 7 + 10).alias("target_root_id"))
    roots = spark.range(20).select(F.col("id").alias("root_id"), F.when(F.col("id") == 0, "revoked").otherwise("approved").alias("status"), (F.col("id") != 10).alias("writes"))
    return T.approvable_plans(counts, plans, roots).select("plan_id")


@query(
    "t12_resolved_items",
    _ITEMS + " SELECT plan_id, count(*) FILTER (status = 'needs-review' AND item_id % 3 > 0) AS open_items, count(*) FILTER (status = 'ready' OR (status = 'needs-review' AND item_id % 3 = 0)) AS ready, CASE WHEN count(*) FILTER (status = 'needs-review' AND item_id % 3 > 0) = 0 THEN 'ready-for-approval' ELSE 'needs-review' END AS status FROM i GROUP BY 1 HAVING count(*) FILTER (status = 'needs-review') > 0",
)
def _t12(spark, d):
    i = _items(spark, d)
    plans = i.where("status = 'needs-review'").select("plan_id", "status").distinct()
    now = T.resolve_items(i, i.where("item_id % 3 = 0").select("item_id", F.lit("ready").alias("status")))
    counts = now.groupBy("plan_id").agg(F.count_if(F.col("status") == "needs-review").alias("open_items"), F.count_if(F.col("status") == "ready").alias("ready"))
    return T.reviewed_plans(plans, now).join(counts, "plan_id").select("plan_id", "open_items", "ready", "status")


@query(
    "t13_receipts",
    _ITEMS + " SELECT plan_id, 'receipt:' || sha256('receipt' || chr(0) || plan_id || chr(0)) AS receipt_id, count(*) AS total, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS status FROM i GROUP BY 1",
)
def _t13(spark, d):
    return T.transfer_receipt(_items(spark, d)).select("plan_id", "receipt_id", "total", "status")


@query("a13_receipt_counts", "SELECT o_custkey AS plan_id, count(*) AS total, count(*) FILTER (o_orderkey % 5 = 0) AS imported, count(*) FILTER (o_orderkey % 5 = 1) AS exact_duplicate, count(*) FILTER (o_orderkey % 5 = 2) AS needs_review, count(*) FILTER (o_orderkey % 5 = 3) AS skipped, count(*) FILTER (o_orderkey % 5 = 4) AS failed FROM orders GROUP BY 1")
def _a13(spark, d):
    outcome = F.element_at(F.array(*map(F.lit, ("imported", "exact-duplicate", "needs-review", "skipped", "failed"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return T.receipt_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), outcome.alias("outcome")))


# Ledgers.


def _chain(spark, d) -> DataFrame:
    return E.append_chain(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(
    "e1_verify_chain",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), b AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND n >= 2 THEN 'hash' WHEN conv_id % 5 = 1 AND n >= 3 THEN 'sequence' WHEN conv_id % 5 = 2 AND n >= 3 THEN 'link' END AS reason FROM n)
 SELECT conv_id, reason IS NULL AS valid, CASE reason WHEN 'hash' THEN 1 WHEN 'sequence' THEN 1 WHEN 'link' THEN 2 ELSE n END AS entries_checked, CASE WHEN reason = 'hash' THEN 2 WHEN reason IS NOT NULL THEN 3 ELSE 0 END::INTEGER AS first_invalid, reason FROM b""",
)
def _e1(spark, d):
    """Chains altered at their second entry, without it where a third follows, or with a wrong link at the third."""
    c = _chain(spark, d)
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    k, at = F.col("conv_id") % 5, F.col("sequence")
    c = c.join(n, "conv_id").where(~((k == 1) & (at == 2) & (F.col("n") >= 3)))
    broken = c.withColumns({"text": F.when((k == 0) & (at == 2), "altered").otherwise(F.col("text")), "previous_hash": F.when((k == 2) & (at == 3), "0").otherwise(F.col("previous_hash"))})
    return E.verify_chain(broken.drop("n"), "conv_id", "text").withColumn("first_invalid", F.coalesce("first_invalid", F.lit(0)))


@query("w5_with_previous", "SELECT conv_id, count(*) AS entries, count(*) - 1 AS linked FROM conversations GROUP BY 1")
def _w5(spark, d):
    linked = E.with_previous(_chain(spark, d), "conv_id")
    return linked.groupBy("conv_id").agg(F.count("*").alias("entries"), F.count_if(F.col("prior_hash") == F.col("previous_hash")).alias("linked"))


@query("e8_audit_after", "SELECT turn FROM (SELECT turn, row_number() OVER (ORDER BY turn, text) AS s FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY count(*) DESC, conv_id LIMIT 1)) WHERE s > 1 QUALIFY row_number() OVER (ORDER BY s) <= 3")
def _e8(spark, d):
    c = _chain(spark, d)
    top = table(spark, d, "conversations").groupBy("conv_id").count().orderBy(F.desc("count"), "conv_id").first()["conv_id"]
    return E.audit_after(c.where(F.col("conv_id") == top), 1, 3).select("turn")


@query("a19_retries", "SELECT user_id AS job_id, count(*) FILTER (event_type IN ('error', 'click')) AS retries FROM events GROUP BY 1")
def _a19(spark, d):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "lease-expired").otherwise("done")
    return E.retry_counts(table(spark, d, "events").select(F.col("user_id").alias("job_id"), outcome.alias("outcome")))


@query("w6_dispatch_order", f"SELECT job_id, kind, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, submitted_at, job_id)::BIGINT AS place FROM ({_JOBS}) WHERE status = 'queued'")
def _w6(spark, d):
    return E.dispatch_order(_jobs(spark, d)).select("job_id", "kind", "place")


@query("w8_latest_root_event", "SELECT user_id AS root_id, event_id, CASE event_type WHEN 'signup' THEN 'approve' ELSE 'revoke' END AS kind FROM events WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _w8(spark, d):
    from .fixtures import root_events

    return E.latest_root_event(root_events(spark, d)).select("root_id", "event_id", "kind")


@query("e7_stage_status", "SELECT user_id AS scan_id, event_type AS stage, max(event_id) AS completed, max(event_id % 100) AS total, arg_max(event_id % 7, ts)::VARCHAR AS status FROM events GROUP BY 1, 2")
def _e7(spark, d):
    e = table(spark, d, "events").selectExpr("user_id as scan_id", "event_type as stage", "event_id as completed", "event_id % 100 as total", "cast(event_id % 7 as string) as status", "ts as updated_at")
    return E.stage_status(e).drop("updated_at")


@query("m1_insert_ignore", "SELECT user_id AS key, min(event_id) FILTER (event_id % 2 = 0) AS old, min(event_id) FILTER (event_id % 2 = 0) IS NULL AS added FROM events GROUP BY 1")
def _m1(spark, d):
    e = table(spark, d, "events")
    target = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("old"))
    batch = e.where("event_id % 2 = 1").select(F.col("user_id").alias("key"), F.lit(None).cast("long").alias("old"))
    return E.insert_ignore(target, batch, ["key"]).withColumn("added", F.col("old").isNull())


@query("m5_merge_max", "SELECT user_id AS key, max(event_id) AS top, coalesce(max(value) FILTER (event_id % 2 = 0 AND event_id % 3 > 0), max(value) FILTER (event_id % 2 = 1)) AS known, count(*) AS n FROM events GROUP BY 1")
def _m5(spark, d):
    e = table(spark, d, "events").withColumn("key", F.col("user_id"))
    side = lambda odd, value: e.where(f"event_id % 2 = {odd}").groupBy("key").agg(F.max("event_id").alias("top"), F.max(value).alias("known"), F.count("*").alias("n"))
    return E.merge_max(side(0, F.when(F.col("event_id") % 3 > 0, F.col("value"))), side(1, F.col("value")), ["key"], greatest=["top"], known=["known"], added=["n"])


@query("m8_accepted", "SELECT user_id AS key, arg_min(event_id, (ts, event_id)) AS job_id, arg_min('{\"a\":1,\"b\":\"' || event_type || '\"}', (ts, event_id)) AS payload, count(*) AS n FROM events GROUP BY 1")
def _m8a(spark, d):
    """Payloads whose keys stand in another order are one payload."""
    from ..functions.scalars import canonical_json

    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": 1}'))).otherwise(F.concat(F.lit('{"a":1,"b":"'), "event_type", F.lit('"}')))
    s = table(spark, d, "events").select(F.col("user_id").alias("key"), canonical_json(text).alias("payload"), F.col("ts").alias("submitted_at"), F.col("event_id").alias("job_id"))
    return E.idempotent(s)[0]


# Streams: a table is written, read as a stream until it is used up, and what the stream gave is read back.


def _drained(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    path, log = scratch(spark, "stream"), scratch(spark, "stream-log")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", path).schema(stream.schema).parquet(f"{path}/batch=*")


def _streamed(spark, df: DataFrame) -> DataFrame:
    path = scratch(spark, "source")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _item_files(spark, d) -> str:
    path = scratch(spark, "items")
    table(spark, d, "benchmark").select(F.col("text").alias("value"), "item_id").write.partitionBy("item_id").text(path)
    return path


@query("st1_arriving_files", "SELECT sha256(text || chr(10)) AS digest, strlen(text) + 1 AS byte_length FROM benchmark")
def _st1(spark, d):
    return _drained(spark, ST.arriving_files(spark, _item_files(spark, d))).select("digest", "byte_length")


@query("st2_arrivals_against", "SELECT sha256(text || chr(10)) AS digest, text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) AS known FROM benchmark")
def _st2(spark, d):
    have = table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.sha2(F.concat("text", F.lit("\n")), 256).alias("digest"), (F.octet_length("text") + 1).cast("long").alias("byte_length"))
    return _drained(spark, ST.arrivals_against(ST.arriving_files(spark, _item_files(spark, d)), have)).select("digest", "known")


@query("st3_first_submissions", "SELECT DISTINCT user_id FROM events")
def _st3(spark, d):
    stream = _streamed(spark, table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    return _drained(spark, ST.first_submissions(stream, "user_id", "ts", "1000 days")).select("user_id")


@query("st4_live_job_state", EVENTS_SQL + " SELECT job_id, count(*) AS events, arg_max(status, event_id) AS status FROM job_events GROUP BY 1")
def _st4(spark, d):
    stream = _streamed(spark, job_events(spark, d).select("job_id", F.col("event_id").alias("sequence"), "status"))
    # A state is written after each batch that has events of its job; the one of most events is the last.
    return _drained(spark, ST.live_job_state(stream), "update").groupBy("job_id").agg(F.max("events").alias("events"), F.max_by("status", "events").alias("status"))


_STALE = """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR AS cut FROM events), s AS (SELECT user_id, ts, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id AS worker_id, max(ts) AS last_beat, count(*) AS beats FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY"""


@query("st5_stale_workers", _STALE)
def _st5(spark, d):
    stream = _streamed(spark, table(spark, d, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("heartbeat_at")))
    return _drained(spark, ST.stale_workers(stream, "1 hour", "1 day")).select("worker_id", "last_beat", "beats")


@query("st5_expired_workers", _STALE)
def _st5e(spark, d):
    """Timers instead of session windows, in a session of its own for RocksDB state."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    beats = table(own, d, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("heartbeat_at"))
    return _drained(own, ST.expired_workers(_streamed(own, beats), timedelta(hours=1), "1 day")).select("worker_id", "last_beat", "beats")


@query("st6_merged_streams", EVENTS_SQL + ", n AS (SELECT job_id, event_id, status FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, event_id DESC) = 1) SELECT 'latest' AS kind, job_id, event_id FROM n UNION ALL SELECT 'new', event_id, event_id FROM job_events")
def _st6(spark, d):
    """Two runs over the same checkpoint: files that came between them are merged into what the first left."""
    e = job_events(spark, d).select("job_id", "event_id", "occurred_at", "status")
    source, latest, new, logs = scratch(spark, "source"), scratch(spark, "latest"), scratch(spark, "new"), scratch(spark, "logs")
    for rest in (0, 1):
        e.where(f"event_id % 2 = {rest}").unionByName(e.where("event_id % 10 = 0")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        ST.upsert_latest(stream, latest, ["job_id"], "occurred_at", "event_id", logs + "/a").awaitTermination()
        ST.append_new(stream, new, "event_id", logs + "/b").awaitTermination()
    top = ST.latest_version(spark, latest, e.schema).select(F.lit("latest").alias("kind"), "job_id", "event_id")
    return top.unionByName(spark.read.schema(e.schema).parquet(f"{new}/batch=*").select(F.lit("new").alias("kind"), F.col("event_id").alias("job_id"), "event_id"))
