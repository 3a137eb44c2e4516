"""Queries over the test tables for the operators of this library, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import classify as C
from ..operators import duplicates as D
from ..operators import facts as X
from ..operators import ledger as E
from ..operators import organize as O
from ..operators import reconcile as N
from ..operators import relate as R
from ..operators import search as Q
from ..operators import snapshots as A
from ..operators import transfer as T
from ..sources import listing as L
from .fixtures import BOTH_SQL, EVENTS_SQL, FILES_SQL, SCANS_SQL, files, files2, job_events, root_events, scans, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _hashed(spark, d) -> DataFrame:
    return files(spark, d).withColumns({"digest": F.sha2("content", 256), "hashed_at": F.col("modified_at"), "verification_state": F.lit("verified")})


def _listed(spark, d) -> DataFrame:
    """Files without their contents."""
    return files(spark, d).drop("content")


def _understood(spark, d) -> DataFrame:
    f = files(spark, d)
    mime = X.sniff_type(F.encode("content", "UTF-8"), F.col("extension"))["mime_type"]
    none = F.lit(0)
    facts = f.withColumns({"mime_type": mime, "n_failed": none, "n_results": none + 1, "n_unavailable": none, "captured_at": F.lit(None).cast("timestamp")})
    return C.classify(facts.drop("content"))


H = FILES_SQL + ", hashes AS (SELECT *, sha256(content) AS digest FROM files)"
_EXT = {"pdf": "Documents", "txt": "Documents", "md": "Documents", "csv": "Spreadsheets", "jpg": "Images", "png": "Images", "mp3": "Audio", "mov": "Videos", "zip": "Archives", "ts": "Code", "json": "Data", "foo": "Other"}
_MIME = {"pdf": "Documents", "txt": "Documents", "md": "Documents", "csv": "Documents", "jpg": "Images", "png": "Images", "mp3": "Audio", "mov": "Videos", "zip": "Archives"}
_case = lambda m: "CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
U = FILES_SQL + f""", u0 AS (SELECT *, {_case(_EXT)} AS c1, {_case(_MIME)} AS c2 FROM files),
 u AS (SELECT *, CASE WHEN c1 = 'Other' AND c2 IS NOT NULL THEN c2 ELSE c1 END AS category,
  CASE WHEN c2 IS NULL THEN (CASE WHEN c1 = 'Other' THEN 0.35 ELSE 0.88 END) WHEN c1 = 'Other' THEN 0.82 WHEN c1 <> c2 THEN 0.55 ELSE 0.94 END::DOUBLE AS confidence FROM u0),
 und AS (SELECT *, CASE WHEN confidence < 0.65 THEN 'needs-review' ELSE 'confident' END AS uncertainty FROM u)"""


@query("a1_scan_counts", BOTH_SQL + " SELECT root_id, scan_id, count(*) AS records, count(*) AS files, sum(byte_length)::BIGINT AS bytes, 0::BIGINT AS skipped, 0::BIGINT AS errors, 0::BIGINT AS directories FROM (SELECT root_id, scan_id, byte_length FROM files UNION ALL SELECT root_id, scan_id, byte_length FROM files2) GROUP BY 1, 2")
def _a1(spark, d):
    return A.scan_counts(files(spark, d).unionByName(files2(spark, d)))


@query("w1_latest_scan", SCANS_SQL + " SELECT root_id, started_at, scan_id, status FROM scans QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY started_at DESC, scan_id DESC) = 1")
def _w1(spark, d):
    return A.latest_scan(scans(spark, d)).select("root_id", "started_at", "scan_id", "status")


@query("w2_latest_completed_scan", SCANS_SQL + " SELECT root_id, scan_id FROM scans WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY started_at DESC, scan_id DESC) = 1")
def _w2(spark, d):
    return A.latest_completed_scan(scans(spark, d)).select("root_id", "scan_id")


@query("a16_scan_summary", SCANS_SQL + " SELECT root_id, count(*) AS retained, arg_max(scan_id, (started_at, scan_id)) AS latest_scan FROM scans GROUP BY 1")
def _a16(spark, d):
    return A.scan_summary(scans(spark, d))


@query("s5_append_snapshot", BOTH_SQL + " SELECT record_id, relative_path FROM files2 WHERE record_id NOT IN (SELECT record_id FROM files)")
def _s5(spark, d):
    return A.append_snapshot(files(spark, d), files2(spark, d)).select("record_id", "relative_path")


@query("s2_directory_rows", FILES_SQL + ", p AS (SELECT root_id, string_split(relative_path, '/') AS s FROM files), e AS (SELECT DISTINCT root_id, array_to_string(s[1:n], '/') AS relative_path, n AS depth FROM p, unnest(range(0, len(s))) AS t(n)) SELECT root_id, relative_path, depth::INTEGER AS depth FROM e")
def _s2(spark, d):
    return L.directory_rows(files(spark, d))


@query("s4_tag_issues", FILES_SQL + " SELECT record_id, CASE WHEN parent_path LIKE 'proj%' THEN 'policy-ignored' WHEN device_id <> 'dev0' THEN 'different-device' END AS issue_code, CASE WHEN parent_path LIKE 'proj%' OR device_id <> 'dev0' THEN 'skipped' ELSE 'observed' END AS observation_status FROM files")
def _s4(spark, d):
    f = files(spark, d)
    ignored = f.where(F.startswith("parent_path", F.lit("proj"))).select(F.split("parent_path", "/")[0].alias("prefix")).distinct()
    return L.tag_issues(f, "dev0", ignored).select("record_id", "issue_code", "observation_status")


@query("s9_discover_items", FILES_SQL + " SELECT record_id, row_number() OVER (ORDER BY relative_path) - 1 AS ordinal FROM files WHERE device_id = 'dev1'")
def _s9(spark, d):
    return T.discover_items(files(spark, d), "dev1").select("record_id", "ordinal")


@query(
    "p_path_functions",
    FILES_SQL + r""" SELECT record_id, parent_path AS p_parent, name AS p_base, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '^(.+)\.[^.]*$', '\1') ELSE name END AS p_stem,
      nullif(regexp_extract(name, '^.+\.([^.]+)$', 1), '') AS p_ext, parent_path <> '' AS p_has_parent, starts_with(relative_path, 'en/') AS p_within, substr(name, 1, 1) = '.' AS p_hidden, len(string_split(relative_path, '/'))::INTEGER AS p_ancestors FROM files""",
)
def _p(spark, d):
    r = F.col("relative_path")
    return files(spark, d).select("record_id", P.parent_path(r).alias("p_parent"), P.basename(r).alias("p_base"), P.stem(r).alias("p_stem"), P.extension(F.col("name")).alias("p_ext"), P.has_parent(r).alias("p_has_parent"), P.is_within(r, F.lit("en")).alias("p_within"), P.hidden(F.col("name")).alias("p_hidden"), F.size(P.ancestors(r)).alias("p_ancestors"))


@query("p10_portable_target", "SELECT page_id, CASE WHEN url LIKE '%//%' THEN 'empty-segment' END AS error FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS url FROM pages)")
def _p10(spark, d):
    return table(spark, d, "pages").select("page_id", P.portable_target(F.col("url"))["error"].alias("error"))


@query("f2_identities", FILES_SQL + " SELECT record_id, 'file:' || sha256('file' || chr(0) || root_id || chr(0) || relative_path || chr(0)) AS id, sha256(byte_length::VARCHAR || chr(0) || strftime(modified_at, '%Y-%m-%d %H:%M:%S') || chr(0) || device_id || chr(0) || filesystem_record_id) AS signature FROM files")
def _f2(spark, d):
    return files(spark, d).select("record_id", S.stable_id("file", F.col("root_id"), F.col("relative_path")).alias("id"), S.observation_signature(F.col("byte_length"), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"), F.col("device_id"), F.col("filesystem_record_id")).alias("signature"))


@query("f_scalars", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, least(1.0, greatest(0.0, o_totalprice / 1000000))::DOUBLE AS c, (3 * o_orderkey)::BIGINT AS r, least(99, floor(o_orderkey * 100 / 60000))::BIGINT AS pct FROM orders")
def _f(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.year_bucket(F.col("o_orderdate")).alias("y"), S.month_bucket(F.col("o_orderdate")).alias("m"), S.clamp01(F.col("o_totalprice") / 1000000).alias("c"), S.reclaimable(F.lit(4), k).alias("r"), S.percent(k, F.lit(60000), F.lit(True)).alias("pct"))


@query("a2_size_candidates", FILES_SQL + " SELECT byte_length, count(*) AS copies, count(*) * byte_length AS total_bytes, (count(*) - 1) * byte_length AS reclaimable_bytes FROM files GROUP BY byte_length HAVING count(*) > 1")
def _a2(spark, d):
    return D.size_candidates(files(spark, d))


@query("a7_hash_workload", FILES_SQL + " SELECT count(*) AS files, sum(byte_length)::BIGINT AS bytes FROM files WHERE byte_length IN (SELECT byte_length FROM files GROUP BY 1 HAVING count(*) > 1)")
def _a7(spark, d):
    return D.hash_workload(files(spark, d))


@query("d1_hash_content", H + " SELECT record_id, digest FROM hashes WHERE byte_length IN (SELECT byte_length FROM files GROUP BY 1 HAVING count(*) > 1)")
def _d1(spark, d):
    return D.hash_content(D.hash_tasks(files(spark, d))).select("record_id", "digest")


@query(
    "d3_incremental_hash",
    FILES_SQL + """, prior AS (SELECT *, sha256(content) AS digest FROM files WHERE doc_id % 10 NOT IN (1, 2)), t AS (SELECT *, modified_at + to_days((CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END)::INT) AS m2 FROM files)
      SELECT record_id, sha256(content) AS digest, CASE WHEN doc_id % 10 IN (1, 2, 5) THEN 'verified' ELSE 'reused' END AS verification_state FROM t""",
)
def _d3(spark, d):
    f = files(spark, d)
    prior = _hashed(spark, d).drop("content").where("doc_id % 10 not in (1, 2)")
    moved = f.withColumn("modified_at", F.when(F.col("doc_id") % 10 == 5, F.col("modified_at") + F.expr("interval 1 day")).otherwise(F.col("modified_at")))
    return D.incremental_hash(moved, prior).select("record_id", "digest", "verification_state")


@query("d4_candidate_groups", H + " SELECT byte_length, CASE WHEN bool_and(doc_id % 3 = 0) THEN 'verified' WHEN bool_or(doc_id % 3 = 0) THEN 'partially-verified' ELSE 'candidate' END AS state, count(*) AS copies FROM hashes GROUP BY 1 HAVING count(*) > 1")
def _d4(spark, d):
    f = files(spark, d)
    return D.verification_state(D.candidate_members(f, _hashed(spark, d).where("doc_id % 3 = 0")))


_GROUPS = "SELECT 'exact:' || sha256('exact' || chr(0) || digest || chr(0) || byte_length || chr(0)) AS group_id, digest, byte_length, count(*) AS copies, count(*) * byte_length AS total_bytes, (count(*) - 1) * byte_length AS reclaimable_bytes FROM hashes GROUP BY digest, byte_length HAVING count(*) > 1"


@query("d6_exact_duplicates", H + " " + _GROUPS)
def _d6(spark, d):
    return D.exact_groups(_hashed(spark, d))


@query("d6_exact_members", H + f", g AS ({_GROUPS}) SELECT record_id, group_id FROM hashes JOIN g USING (digest, byte_length)")
def _d6m(spark, d):
    return D.exact_members(_hashed(spark, d)).select("record_id", "group_id")


@query("d8_decisions", H + f", g AS ({_GROUPS}), m AS (SELECT record_id, group_id, doc_id FROM hashes JOIN g USING (digest, byte_length)), k AS (SELECT group_id, min(doc_id) AS k FROM m GROUP BY 1) SELECT record_id, CASE WHEN doc_id = k THEN 'keep' ELSE 'consolidate' END AS decision FROM m JOIN k USING (group_id)")
def _d8(spark, d):
    m = D.exact_members(_hashed(spark, d)).select("group_id", "record_id", "doc_id")
    keep = m.groupBy("group_id").agg(F.min_by("record_id", "doc_id").alias("record_id"))
    return D.apply_decisions(m, keep)[0].select("record_id", "decision")


@query("d9_content_matches", H + " SELECT a.record_id AS item_id, b.record_id, b.relative_path FROM hashes a JOIN hashes b ON a.digest = b.digest AND a.byte_length = b.byte_length WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0")
def _d9(spark, d):
    h = _hashed(spark, d)
    items = h.where("doc_id % 2 = 1").select(F.col("record_id").alias("item_id"), "digest", "byte_length")
    head = h.select("root_id", "scan_id").distinct().withColumns({"status": F.lit("completed"), "started_at": F.lit("2024-01-01").cast("timestamp")})
    return D.match_catalogue(items, h.where("doc_id % 2 = 0"), head).select("item_id", "record_id", "relative_path")


@query("d10_content_identities", H + " SELECT digest, byte_length, max(modified_at) AS last_seen, 'sha256:' || digest AS identity FROM hashes GROUP BY 1, 2")
def _d10(spark, d):
    return D.content_identities(_hashed(spark, d))


@query("d11_reclaimable_report", H + f" SELECT count(*) AS groups, sum(copies)::BIGINT AS files, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes FROM ({_GROUPS})")
def _d11(spark, d):
    return D.reclaimable_report(D.exact_groups(_hashed(spark, d)))


_DIFF = BOTH_SQL + """, j AS (SELECT coalesce(a.root_id, b.root_id) AS root_id, coalesce(a.relative_path, b.relative_path) AS relative_path, a.record_id AS a, b.record_id AS b,
   a.byte_length IS DISTINCT FROM b.byte_length AS x, a.modified_at IS DISTINCT FROM b.modified_at AS y, a.hidden IS DISTINCT FROM b.hidden AS z FROM files a FULL JOIN files2 b ON a.root_id = b.root_id AND a.relative_path = b.relative_path),
 k AS (SELECT root_id, relative_path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'missing' WHEN x OR y OR z THEN 'metadata-changed' END AS kind,
   CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE concat_ws(',', CASE WHEN x THEN 'byteLength' END, CASE WHEN y THEN 'modifiedAt' END, CASE WHEN z THEN 'attributes' END) END AS fields FROM j)"""


@query("n1_reconcile", _DIFF + " SELECT root_id, relative_path, kind, fields FROM k WHERE kind IS NOT NULL")
def _n1(spark, d):
    return N.reconcile(files(spark, d), files2(spark, d)).select("root_id", "relative_path", "kind", F.array_join("changed_fields", ",").alias("fields"))


@query("n1_reconcile_by_folder", _DIFF + " SELECT root_id, relative_path, kind, fields FROM k WHERE kind IS NOT NULL")
def _n1f(spark, d):
    got = N.reconcile_by_folder(files(spark, d), files2(spark, d))
    return got.select("root_id", "relative_path", "kind", F.array_join("changed_fields", ",").alias("fields"))


@query(
    "n1_unchanged_subtrees",
    _DIFF
    + """, p AS (SELECT root_id, relative_path, false AS differs FROM files2 UNION ALL SELECT root_id, relative_path, true FROM k WHERE kind IS NOT NULL),
 f AS (SELECT root_id, unnest(list_concat([''], list_transform(range(1, len(string_split(relative_path, '/'))), lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/')))) AS folder, differs FROM p),
 g AS (SELECT root_id, folder, count(*) AS n, bool_or(differs) AS differs FROM f GROUP BY 1, 2)
 SELECT root_id, folder, n FROM g WHERE NOT differs AND (folder = '' OR (root_id, CASE WHEN contains(folder, '/') THEN regexp_extract(folder, '^(.*)/[^/]*$', 1) ELSE '' END) IN (SELECT (root_id, folder) FROM g WHERE differs))""",
)
def _n1u(spark, d):
    return N.unchanged_subtrees(N.folder_digests(files(spark, d)), N.folder_digests(files2(spark, d)))


@query("a14_delta_counts", _DIFF + " SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1")
def _a14(spark, d):
    return N.delta_counts(N.reconcile(files(spark, d), files2(spark, d)))


@query("m9_path_difference", BOTH_SQL + " SELECT relative_path, 'added' AS side FROM files2 WHERE relative_path NOT IN (SELECT relative_path FROM files) UNION ALL SELECT relative_path, 'missing' FROM files WHERE relative_path NOT IN (SELECT relative_path FROM files2)")
def _m9(spark, d):
    return N.path_difference(files(spark, d), files2(spark, d))


@query(
    "n1_reconcile_large",
    "SELECT o_orderpriority || '/' || o_orderkey AS relative_path, CASE WHEN o_orderkey % 10 = 3 THEN 'missing' ELSE 'metadata-changed' END AS kind FROM orders WHERE o_orderkey % 10 IN (3, 4)",
)
def _n1l(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("relative_path"), F.lit("r").alias("root_id"), F.lit("s").alias("scan_id"), (F.col("o_totalprice") * 100).cast("long").alias("byte_length"), F.col("o_orderdate").alias("modified_at"))
    a = L.from_manifest(o)
    b = a.where("o_orderkey % 10 <> 3").withColumn("byte_length", F.col("byte_length") + F.when(F.col("o_orderkey") % 10 == 4, 1).otherwise(0))
    return N.reconcile(a, b).select("relative_path", "kind")


@query("c3_classify", U + " SELECT record_id, category, confidence, uncertainty FROM und")
def _c3(spark, d):
    return _understood(spark, d).select("record_id", "category", "confidence", "uncertainty")


@query("c5_reviews", U + " SELECT record_id, 'low-classification-confidence' AS reason FROM und WHERE uncertainty = 'needs-review' UNION ALL SELECT record_id, 'unsupported-format' FROM und WHERE category = 'Other'")
def _c5(spark, d):
    return C.generate_reviews(_understood(spark, d)).select("record_id", "reason")


@query("c6_resolutions", U + " SELECT record_id, CASE WHEN doc_id % 7 = 0 THEN 'Design' ELSE category END AS category, CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE confidence END::DOUBLE AS confidence FROM und")
def _c6(spark, d):
    u = _understood(spark, d)
    res = u.where("doc_id % 7 = 0").select("record_id", F.lit("Design").alias("category"), F.col("modified_at").alias("resolved_at"))
    return C.apply_resolutions(u, res).select("record_id", "category", "confidence")


@query("c6_learned_rules", FILES_SQL + " SELECT extension, 'Design' AS category, count(*) AS use_count FROM files WHERE doc_id % 7 <> 3 GROUP BY 1")
def _c6r(spark, d):
    """Every file is resolved; one resolution in seven is not to be remembered."""
    return C.learn_rules(files(spark, d).select("record_id", "extension", F.lit("Design").alias("category"), (F.col("doc_id") % 7 != 3).alias("remember"), F.col("modified_at").alias("resolved_at")))


@query(
    "c7_external_labels",
    U + " SELECT record_id, CASE WHEN l.doc_id IS NOT NULL AND und.confidence < 0.8 THEN 'Books' ELSE category END AS category, CASE WHEN l.doc_id IS NOT NULL AND und.confidence < 0.8 THEN 0.7 ELSE und.confidence END::DOUBLE AS confidence FROM und LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)",
)
def _c7(spark, d):
    labels = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.lit("Books").alias("category"), F.lit(0.7).alias("confidence"), F.lit("from labels").alias("explanation"), F.array(F.lit("quality")).alias("evidence"))
    return C.apply_external_labels(_understood(spark, d), labels)[0].select("record_id", "category", "confidence")


@query("c9_ingest_classification", FILES_SQL + f" SELECT record_id, {_case(_EXT)} AS category, CASE WHEN extension = 'foo' THEN 0.35 ELSE 0.9 END::DOUBLE AS confidence FROM files")
def _c9(spark, d):
    f = files(spark, d).withColumns({"mime_type": X.sniff_type(F.encode("content", "UTF-8"), F.col("extension"))["mime_type"], "n_failed": F.lit(0)})
    return C.classify_ingest(f).select("record_id", "category", "confidence")


@query("r2_project_groups", FILES_SQL + " SELECT root_id, parent_path AS relative_root, parent_path AS display_name, name AS manifest, 0.87::DOUBLE AS confidence FROM files WHERE name = 'package.json'")
def _r2(spark, d):
    return R.project_groups(files(spark, d)).select("root_id", "relative_root", "display_name", "manifest", "confidence")


@query("r3_project_members", FILES_SQL + " SELECT p.parent_path AS relative_root, f.record_id FROM files p JOIN files f ON p.root_id = f.root_id AND (f.parent_path = p.parent_path OR starts_with(f.parent_path, p.parent_path || '/')) WHERE p.name = 'package.json'")
def _r3(spark, d):
    f = files(spark, d)
    g = R.project_groups(f)
    return R.prefix_members(f, g).join(g.select("group_id", "relative_root"), "group_id").select("relative_root", "record_id")


_RAW = """WITH raw AS (SELECT doc_id, 'p' || (doc_id % 7) AS parent_path, 'x' || doc_id AS stem, unnest(CASE WHEN doc_id % 80 = 0 THEN ['nef', 'jpg', 'xmp'] ELSE ['nef', 'jpg'] END) AS ext FROM documents WHERE doc_id % 40 = 0)"""


def _media_listing(spark, d):
    """Files of every document: one in 40 has a RAW and its rendering, every other of these a sidecar too; the
    others are RAW, rendered, sidecar and plain files without a partner."""
    k = F.col("doc_id")
    lone = F.element_at(F.array(*map(F.lit, ("txt", "nef", "jpg", "xmp"))), (F.abs(k) % 4 + 1).cast("int"))
    exts = F.when(k % 80 == 0, F.array(*map(F.lit, ("nef", "jpg", "xmp")))).when(k % 40 == 0, F.array(F.lit("nef"), F.lit("jpg"))).otherwise(F.array(lone))
    docs = table(spark, d, "documents").select("doc_id", F.explode(exts).alias("ext"))
    name = F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit("."), "ext")
    return docs.select(F.lit("r").alias("root_id"), F.lit("s").alias("scan_id"), F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")).alias("parent_path"), F.concat_ws("/", F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")), name).alias("relative_path"), name.alias("record_id"))


@query("r4_media_pairs", _RAW + " SELECT stem || '.nef' AS source_id, stem || '.' || ext AS target_id, CASE WHEN ext = 'xmp' THEN 'sidecar-of' ELSE 'derived-version' END AS relationship FROM raw WHERE ext <> 'nef'")
def _r4(spark, d):
    return R.media_pairs(L.from_manifest(_media_listing(spark, d))).select("source_id", "target_id", "relationship")


@query("r6_album_groups", U + " SELECT root_id, parent_path, count(*) FILTER (category = 'Audio') AS tracks, count(*) FILTER (category = 'Images') AS artwork, count(*) AS members FROM und GROUP BY 1, 2 HAVING count(*) FILTER (category = 'Audio') >= 2 AND count(*) FILTER (category = 'Images') >= 1")
def _r6(spark, d):
    return R.album_groups(_understood(spark, d))[0].select("root_id", "parent_path", "tracks", "artwork", "members")


@query("q1_search_inventory", FILES_SQL + " SELECT record_id FROM files WHERE (contains(lower(name), 'f1') OR contains(lower(relative_path), 'f1')) AND extension = 'pdf'")
def _q1(spark, d):
    return Q.search_inventory(files(spark, d), text="F1", entry_type="file", extension=".PDF").select("record_id")


@query(
    "q2_search_enriched",
    U + ", dup AS (SELECT sha256(content) AS h FROM files GROUP BY 1 HAVING count(*) > 1), r AS (SELECT record_id FROM und WHERE uncertainty = 'needs-review') SELECT record_id, category, CASE WHEN sha256(content) IN (SELECT h FROM dup) THEN 'exact' ELSE 'unique' END AS duplicate_state FROM und WHERE category IN ('Documents', 'Spreadsheets') AND byte_length BETWEEN 500 AND 100000 AND modified_at >= TIMESTAMP '2024-02-01' AND record_id NOT IN (SELECT record_id FROM r)",
)
def _q2(spark, d):
    f, u, h = _listed(spark, d), _understood(spark, d), _hashed(spark, d).drop("content")
    m = D.exact_members(h)
    empty = m.limit(0)
    reviews = Q.search_reviews(C.generate_reviews(u).withColumn("status", F.lit("open")))
    flagged = Q.flags(m, empty, reviews, empty)
    out = Q.search_enriched(Q.enrich(f, h, u), flagged, category=["Documents", "Spreadsheets"], min_bytes=500, max_bytes=100000, modified_from="2024-02-01", needs_review=False)
    return out.select("record_id", "category", "duplicate_state")


@query("q5_search_duplicates", H + f", g AS ({_GROUPS}) SELECT group_id, reclaimable_bytes FROM g WHERE reclaimable_bytes >= 1000 AND digest IN (SELECT digest FROM hashes WHERE contains(lower(relative_path), 'src1'))")
def _q5(spark, d):
    h = _hashed(spark, d)
    m = D.exact_members(h)
    none = D.keeper_counts(m.withColumn("decision", F.lit("undecided")))
    return Q.search_duplicates(D.exact_groups(h), m, none, text="src1", min_reclaimable=1000).select("group_id", "reclaimable_bytes")


@query("l1_page_keyset", FILES_SQL + " SELECT relative_path, record_id FROM files WHERE (relative_path, record_id) > ('en/src1', '') ORDER BY 1, 2 LIMIT 50")
def _l1(spark, d):
    return Q.after_key(files(spark, d), ["relative_path", "record_id"], ["en/src1", ""]).orderBy("relative_path", "record_id").limit(50).select("relative_path", "record_id")


@query("j3_without_membership", H + " SELECT record_id FROM hashes WHERE digest NOT IN (SELECT digest FROM hashes GROUP BY 1 HAVING count(*) > 1)")
def _j3(spark, d):
    return Q.without_membership(files(spark, d), D.exact_members(_hashed(spark, d))).select("record_id")


@query("q13_observed_paths", BOTH_SQL + " SELECT relative_path FROM files2 WHERE relative_path IN (SELECT relative_path FROM files)")
def _q13(spark, d):
    return Q.observed_paths(files(spark, d), files2(spark, d).select("relative_path"))


_COH = " SELECT record_id, CASE WHEN hidden THEN 'hidden' WHEN parent_path LIKE 'proj%' THEN 'preserved-group' WHEN uncertainty = 'needs-review' THEN 'needs-review' ELSE 'eligible' END AS disposition, category, relative_path, modified_at, byte_length, name FROM und"


def _evidence(spark, d):
    f, u = _listed(spark, d), _understood(spark, d)
    reviews = C.generate_reviews(u).withColumns({"status": F.lit("open"), "group_id": F.lit(None).cast("string")})
    members = R.prefix_members(f, R.project_groups(f))
    return O.planning_evidence(f, u, O.blocked_records(reviews, members), members)


@query("o1_dispositions", U + ", d AS (" + _COH + ") SELECT disposition, count(*) AS n FROM d GROUP BY 1")
def _o1(spark, d):
    return O.plan_counts(O.dispositions(_evidence(spark, d)))


@query("o3_destinations", U + ", d AS (" + _COH + ") SELECT record_id, 'Organized/' || category || '/' || strftime(modified_at, '%Y') || '/' || name AS destination FROM d WHERE disposition = 'eligible'")
def _o3(spark, d):
    e = O.dispositions(_evidence(spark, d)).where("disposition = 'eligible'")
    return e.select("record_id", O.desired_destination(O.PlanOptions(strategy="category-and-year")).alias("destination"))


@query("o5_plan", U + ", d AS (" + _COH + ") SELECT record_id, row_number() OVER (ORDER BY relative_path) - 1 AS ordinal, 'Organized/' || category || '/' || name AS final FROM d WHERE disposition = 'eligible' QUALIFY ordinal < 10000")
def _o5(spark, d):
    return O.plan(_evidence(spark, d), _listed(spark, d))[0].select("record_id", F.col("ordinal").cast("long").alias("ordinal"), "final")


@query(
    "o9_simulate_plan",
    BOTH_SQL + """, ops AS (SELECT *, 'Organized/' || name AS final FROM files WHERE NOT hidden)
      SELECT o.record_id AS operation_id, CASE WHEN s.record_id IS NULL THEN 'failed' WHEN o.byte_length <> s.byte_length OR o.modified_at <> s.modified_at THEN 'skipped' ELSE 'simulated' END AS outcome FROM ops o LEFT JOIN files2 s USING (relative_path)""",
)
def _o9(spark, d):
    ops = files(spark, d).where("not hidden").select(F.col("record_id").alias("operation_id"), "relative_path", F.concat(F.lit("Organized/"), "name").alias("final"), "byte_length", "modified_at", "device_id", "filesystem_record_id")
    return O.simulate_plan(ops, files2(spark, d))


@query("o8_plan_freshness", SCANS_SQL + ", l AS (SELECT root_id, scan_id AS s, status AS t FROM scans QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY started_at DESC, scan_id DESC) = 1) SELECT scan_id AS plan_id, coalesce(s = scan_id AND t = 'completed', false) AS fresh FROM scans JOIN l USING (root_id)")
def _o8(spark, d):
    s = scans(spark, d)
    return O.plan_is_fresh(s.select(F.col("scan_id").alias("plan_id"), "root_id", "scan_id"), s).select("plan_id", "fresh")


@query(
    "a11_run_counts",
    "WITH i AS (SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'moved' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS outcome FROM orders) SELECT run_id, count(*) AS total, count(*) AS processed, count(*) FILTER (outcome = 'moved') AS succeeded, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, CASE WHEN count(*) FILTER (outcome <> 'moved') > 0 THEN 'partial' ELSE 'completed' END AS status FROM i GROUP BY 1",
)
def _a11(spark, d):
    i = table(spark, d, "orders").selectExpr("o_custkey as run_id", "case o_orderstatus when 'F' then 'moved' when 'O' then 'skipped' else 'failed' end as outcome")
    return O.run_status(O.run_counts(i, i.groupBy("run_id").agg(F.count("*").alias("total"))))


_ITEMS = "WITH i AS (SELECT o_custkey AS plan_id, o_orderkey AS item_id, CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'needs-review' END AS status, (o_totalprice * 100)::BIGINT AS byte_length FROM orders)"


def _items(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey as plan_id", "o_orderkey as item_id", "case o_orderkey % 4 when 0 then 'ready' when 1 then 'completed' when 2 then 'failed' else 'needs-review' end as status", "cast(round(o_totalprice * 100) as bigint) as byte_length")


@query("a12_transfer_counts", _ITEMS + " SELECT plan_id, count(*) AS total, sum(byte_length)::BIGINT AS total_bytes, count(*) FILTER (status = 'ready') AS n_ready, count(*) FILTER (status = 'needs-review') AS n_needs_review, count(*) FILTER (status = 'failed') AS n_failed, coalesce(sum(byte_length) FILTER (status = 'completed'), 0)::BIGINT AS completed_bytes FROM i GROUP BY 1")
def _a12(spark, d):
    return T.transfer_counts(_items(spark, d)).select("plan_id", "total", "total_bytes", "n_ready", "n_needs_review", "n_failed", "completed_bytes")


@query("t3_plan_state", _ITEMS + " SELECT plan_id, CASE WHEN count(*) FILTER (status = 'needs-review') > 0 THEN 'needs-review' ELSE 'ready' END AS state FROM i GROUP BY 1")
def _t3(spark, d):
    return T.ingest_plan_state(T.transfer_counts(_items(spark, d))).select("plan_id", "state")


@query(
    "t7_verify_transfer",
    BOTH_SQL + ", a AS (SELECT relative_path, sha256(content) AS g, byte_length AS n, doc_id FROM files) SELECT doc_id AS item_id, CASE WHEN doc_id % 4 = 0 THEN 'verified' WHEN doc_id % 4 = 1 THEN 'collision' WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'stale-source' ELSE 'pending' END AS result FROM a",
)
def _t7(spark, d):
    h = _hashed(spark, d)
    items = h.select(F.col("doc_id").alias("item_id"), F.col("relative_path").alias("source_path"), F.concat(F.lit("to/"), "relative_path").alias("destination_path"), "digest", "byte_length")
    dest = h.where("doc_id % 4 < 2").select(F.concat(F.lit("to/"), "relative_path").alias("relative_path"), F.when(F.col("doc_id") % 4 == 0, F.col("digest")).otherwise("other").alias("digest"), "byte_length")
    source = files2(spark, d).select("relative_path", F.sha2("content", 256).alias("digest"), "byte_length")
    return T.verify_transfer(items, source, dest)


@query("t8_capacity", _ITEMS + " SELECT plan_id, coalesce(sum(byte_length) FILTER (status <> 'completed'), 0)::BIGINT AS remaining_bytes, coalesce(sum(byte_length) FILTER (status <> 'completed'), 0) + 16777216 <= 100000000 AS fits FROM i GROUP BY 1")
def _t8(spark, d):
    i = _items(spark, d)
    return T.capacity_check(i, i.select("plan_id").distinct().withColumn("free_bytes", F.lit(100000000))).select("plan_id", "remaining_bytes", "fits")


@query("e3_invalid_transitions", EVENTS_SQL + """, p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY occurred_at, event_id) AS f FROM job_events)
 SELECT event_id, f AS from_status, status FROM p WHERE f IS NOT NULL AND f <> status AND NOT coalesce((f = 'queued' AND status IN ('running', 'paused')) OR (f = 'running' AND status IN ('queued', 'paused', 'completed', 'failed')) OR (f = 'paused' AND status = 'queued') OR (f = 'failed' AND status = 'queued'), false)""")
def _e3(spark, d):
    return E.invalid_transitions(job_events(spark, d)).select("event_id", "from_status", "status")


@query("e4_job_state", EVENTS_SQL + " SELECT job_id, arg_max(status, (occurred_at, event_id)) AS status, count(*) AS events, count(*) FILTER (status = 'running') AS attempts, count(*) FILTER (status = 'failed') AS failures FROM job_events GROUP BY 1")
def _e4(spark, d):
    return E.job_state(job_events(spark, d))


@query("e5_lease_triage", EVENTS_SQL + " SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 5 = 0 THEN 'paused' WHEN event_id % 3 >= 1 THEN 'failed' ELSE 'queued' END AS next_status FROM job_events WHERE status = 'running' AND occurred_at <= TIMESTAMP '2024-01-15'")
def _e5(spark, d):
    k = F.col("event_id")
    j = job_events(spark, d).withColumns({"lease_expires_at": F.col("occurred_at"), "cancel_requested": k % 7 == 0, "pause_requested": k % 5 == 0, "retries": k % 3, "maximum_attempts": F.lit(2)})
    return E.lease_triage(j, F.lit("2024-01-15").cast("timestamp")).select("event_id", "next_status")


@query("e6_worker_health", EVENTS_SQL + " SELECT job_id AS worker_id, CASE WHEN arg_max(status, (occurred_at, status)) = 'paused' THEN 'offline' WHEN epoch(TIMESTAMP '2024-01-30') - epoch(max(occurred_at)) > 86400 THEN 'stale' ELSE 'running' END AS health FROM job_events GROUP BY 1")
def _e6(spark, d):
    beats = job_events(spark, d).select(F.col("job_id").alias("worker_id"), F.col("occurred_at").alias("heartbeat_at"), F.when(F.col("status") == "paused", "stopped").otherwise(F.col("status")).alias("status"))
    # Ties of time go to the larger status; 'stopped' stands where 'paused' does between the others.
    return E.worker_health(beats, F.lit("2024-01-30").cast("timestamp"), 86400).select("worker_id", "health")


@query("m2_fold_roots", "WITH e AS (SELECT user_id AS root_id, event_id, ts, event_type FROM events), g AS (SELECT root_id, max((ts, event_id)) FILTER (event_type = 'signup') AS a, max((ts, event_id)) FILTER (event_type = 'error') AS r FROM e GROUP BY 1) SELECT root_id, CASE WHEN r > a THEN 'revoked' ELSE 'approved' END AS status FROM g WHERE a IS NOT NULL")
def _m2(spark, d):
    return E.fold_roots(root_events(spark, d)).select("root_id", "status")


@query("m3_upsert", EVENTS_SQL + " SELECT job_id, event_id, status FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, event_id DESC) = 1")
def _m3(spark, d):
    j = job_events(spark, d)
    return E.upsert(j.where("event_id % 2 = 0"), j.where("event_id % 2 = 1"), ["job_id"], "occurred_at", "event_id").select("job_id", "event_id", "status")


@query("m8_idempotent", "SELECT user_id AS key, count(DISTINCT event_type) AS payloads FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def _m8(spark, d):
    s = table(spark, d, "events").selectExpr("user_id as key", "event_type as payload", "ts as submitted_at", "event_id as job_id")
    return E.idempotent(s)[1]


@query("e2_append_chain", """WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS sequence FROM conversations),
  c AS (SELECT conv_id, turn, sequence, sha256(repeat('0', 64) || chr(0) || t) AS entry_hash FROM o WHERE sequence = 1
   UNION ALL SELECT o.conv_id, o.turn, o.sequence, sha256(c.entry_hash || chr(0) || o.t) FROM c JOIN o ON o.conv_id = c.conv_id AND o.sequence = c.sequence + 1)
  SELECT conv_id, sequence::INTEGER AS sequence, turn, entry_hash FROM c""")
def _e2(spark, d):
    return E.append_chain(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "sequence", "turn", "entry_hash")


_SIGNATURES = {"89504E470D0A1A0A": "image/png", "FFD8FFE0": "image/jpeg", "474946383961": "image/gif", "524946460000000057454250": "image/webp", "524946460000000057415645": "audio/wav", "255044462D": "application/pdf", "504B0304": "application/zip", "377ABCAF271C": "application/x-7z-compressed", "1F8B08": "application/gzip", "494433": "audio/mpeg"}


@query(
    "x1_sniff_pages",
    "SELECT page_id, CASE page_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SIGNATURES.values())) + " WHEN 10 THEN 'text/html' ELSE 'application/octet-stream' END AS mime_type, CASE WHEN page_id % 12 < 10 THEN 'signature' ELSE 'extension' END AS source FROM pages",
)
def _x1(spark, d):
    """Pages behind the signatures of ten types, and two that only their extension tells."""
    k = F.col("page_id") % 12
    heads = F.array(*[F.unhex(F.lit(h)) for h in _SIGNATURES], F.unhex(F.lit("")), F.unhex(F.lit("")))
    content = F.concat(F.get(heads, k.cast("int")), F.encode("html", "UTF-8"))
    kind = X.sniff_type(content, F.when(k == 10, "HTML").otherwise("none"))
    return table(spark, d, "pages").select("page_id", kind["mime_type"].alias("mime_type"), kind["source"].alias("source"))


# Further queries, by theme; each module registers its own.
from . import columns, flows, listings  # noqa: E402, F401
