"""Queries for path, scalar and JSON functions: the same odd inputs in both dialects, expected results by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from .fixtures import FILES_SQL, files, table
from .registry import query

#: Paths of nine kinds, by doc_id.
_ODD = (
    "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '/' || name WHEN 2 THEN 'a/../' || name WHEN 3 THEN './' WHEN 4 THEN 'C:/' || name"
    " WHEN 5 THEN 'a/' || name || '.' WHEN 6 THEN 'a/' || name || ':s' WHEN 7 THEN 'a' || chr(92) || name ELSE '.catalogue/' || name END"
)


def _odd(spark, d):
    return files(spark, d).selectExpr("doc_id", "record_id", "name", "device_id", "relative_path", f"{_ODD} as p")


def _by(n: int, *values: str | None) -> str:
    """SQL: values by doc_id."""
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


@query(
    "p11_relative_path_errors",
    FILES_SQL
    + f" SELECT record_id, {_by(9, 'empty-or-null-byte', 'absolute', 'traversal', 'root-itself')} AS posix,"
    + f" {_by(9, 'empty-or-null-byte', 'absolute', 'traversal', 'trailing-dot-or-space', 'absolute', 'trailing-dot-or-space', 'drive-or-stream')} AS win32 FROM files",
)
def _p11(spark, d):
    p = F.col("p")
    return _odd(spark, d).select("record_id", P.relative_path_error(p).alias("posix"), P.relative_path_error(p, "win32").alias("win32"))


@query(
    "p10_portable_targets",
    FILES_SQL
    + f" SELECT record_id, {_by(9, 'empty-segment', 'absolute', 'traversal', 'empty-segment', 'absolute', None, None, None, 'control-directory')} AS error,"
    + " CASE doc_id % 9 WHEN 5 THEN 'a/' || name || '.' WHEN 6 THEN 'a/' || name || ':s' WHEN 7 THEN 'a/' || name END AS path FROM files",
)
def _p10(spark, d):
    got = P.portable_target(F.col("p"))
    return _odd(spark, d).select("record_id", got["error"].alias("error"), got["path"].alias("path"))


@query(
    "p12_contains",
    FILES_SQL + " SELECT record_id, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND parent_path <> '') AS inside, lower(relative_path) AS win_key FROM files",
)
def _p12(spark, d):
    root = F.expr("case when doc_id % 3 = 0 then './' when doc_id % 3 = 1 then case when parent_path = '' then 'none' else parent_path end || '/' else upper(relative_path) || 'x' end")
    r = F.col("relative_path")
    return files(spark, d).select("record_id", P.contains(root, r).alias("inside"), P.path_key(F.upper(r), "win32").alias("win_key"))


@query(
    "p14_entry_names",
    FILES_SQL
    + " SELECT record_id, doc_id % 5 = 4 AS safe, translate(rtrim(base64(encode(relative_path || '?>' || name)), '='), '+/', '-_') AS encoded, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE extension END AS ext FROM files",
)
def _p14(spark, d):
    name = F.expr("case doc_id % 5 when 0 then '' when 1 then '.' when 2 then '..' when 3 then 'a/' || name else name end")
    ext = F.expr("case when doc_id % 7 = 0 then 'README' else upper(name) end")
    whole = F.concat("relative_path", F.lit("?>"), "name")
    return files(spark, d).select("record_id", P.safe_entry_name(name).alias("safe"), P.encode_unsafe_name(whole).alias("encoded"), P.ingest_extension(ext).alias("ext"))


@query(
    "p15_safe_filename",
    r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(CASE WHEN page_id % 10 = 0 THEN '. .' ELSE url || chr(9) || '"*. ' END, '[\x00-\x1f<>:"/\\|?*]', '_', 'g'), '[. ]+$', ''), ''), 'file') AS name FROM pages""",
)
def _p15(spark, d):
    url = F.when(F.col("page_id") % 10 == 0, ". .").otherwise(F.concat("url", F.lit('\t"*. ')))
    return table(spark, d, "pages").select("page_id", P.safe_filename(url).alias("name"))


@query(
    "p16_read_only",
    "SELECT o_orderkey, o_orderkey % 512 & 146 = 0 AS read_only FROM orders",
)
def _p16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.read_only((F.col("o_orderkey") % 512).cast("int")).alias("read_only"))


@query(
    "p17_volumes",
    FILES_SQL
    + ", v AS (SELECT record_id, relative_path, CASE doc_id % 4 WHEN 0 THEN 'ext' WHEN 1 THEN 'nfs' WHEN 2 THEN 'xfs' ELSE 'unknown' END AS fs, device_id FROM files)"
    + " SELECT record_id, fs || ':' || device_id AS volume, sha256('root-identity' || chr(0) || fs || ':' || device_id || chr(0) || relative_path) AS identity FROM v",
)
def _p17(spark, d):
    magic = F.expr("case doc_id % 4 when 0 then 61267 when 1 then 26985 when 2 then 1481003842 else 5 end")
    key = S.volume_key(F.col("device_id"), S.file_system_name(magic))
    return files(spark, d).select("record_id", key.alias("volume"), S.root_identity(key, F.col("relative_path")).alias("identity"))


@query("f1_escaped_like", FILES_SQL + " SELECT record_id FROM files WHERE doc_id % 2 = 1 AND contains(relative_path, 'f1')")
def _f1(spark, d):
    f = files(spark, d).withColumn("shown", F.concat("relative_path", F.lit("%")))
    f = f.withColumn("shown", F.when(F.col("doc_id") % 2 == 0, F.concat("shown", F.lit("f1%"))).otherwise(F.replace("shown", F.lit("f1"), F.lit("_1%"))))
    return f.where(F.col("shown").like(f"%{S.escape_like('_1%')}%")).select("record_id")


@query(
    "f3_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate END AS usable, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS exif,
      CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y') ELSE 'Unknown year' END AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01'""",
)
def _f3(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, "2024-02-30 01:02:03").when(k % 3 == 1, at.cast("string")).otherwise("none")
    rows = table(spark, d, "orders").where(at >= S.date_bound("1995-03-01T00:00:00Z"))
    usable = S.usable_date(text)
    exif = S.normalize_exif_date(F.concat(F.date_format(at, "yyyy:MM:dd HH:mm:ss"), F.lit(".5+02:00")))
    return rows.select("o_orderkey", usable.alias("usable"), exif.alias("exif"), S.year_bucket(usable).alias("y"))


@query(
    "f9_numbers",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey::DOUBLE / (o_orderkey % 5) END AS rate, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey::DOUBLE / 8 END AS finite,
      ((o_orderkey % 90) + (o_orderkey % 60) / 60 + (o_orderkey % 50) / 3600) * CASE WHEN o_orderkey % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS degrees,
      (o_orderkey % 300)::DOUBLE * CASE WHEN o_orderkey % 3 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS altitude FROM orders WHERE o_orderkey % 90 > 0 AND o_orderkey % 300 > 0""",
)
def _f9(spark, d):
    k = F.col("o_orderkey")
    text = k.cast("string")
    odd = F.when(k % 4 == 0, "NaN").when(k % 4 == 1, "Infinity").when(k % 4 == 2, "x1").otherwise((k / 8).cast("string"))
    degrees = S.gps_decimal(k % 90, k % 60, k % 50, F.when(k % 2 == 0, "s").otherwise("N"))
    rows = table(spark, d, "orders").where("o_orderkey % 90 > 0 and o_orderkey % 300 > 0")
    return rows.select(
        "o_orderkey", S.rational_number(F.concat_ws("/", text, (k % 5).cast("string"))).alias("rate"), S.finite_number(odd).alias("finite"), degrees.alias("degrees"), S.gps_altitude((k % 300).cast("double"), k % 3).alias("altitude")
    )


_NESTED = """'{"z": ' || event_id || ', "a": {"y": "' || event_type || '", "b": [1, {"d": "2", "c": true}]}}'"""


@query(
    "f11_canonical_json",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical, CASE WHEN event_id % 3 > 0 THEN '{"a":{"b":[1,{"c":true,"d":"2"}],"y":"' || event_type || '"},"z":' || event_id || '}' END AS nested FROM events""",
)
def _f11(spark, d):
    nested = F.expr(f"case when event_id % 3 = 0 then '{{\"a\": ' else {_NESTED} end")
    return table(spark, d, "events").select("event_id", S.canonical_json(F.col("props")).alias("canonical"), S.canonical_json(nested).alias("nested"))


@query(
    "f12_json_values",
    """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END::INTEGER AS n,
      CASE WHEN event_id % 4 > 0 THEN event_type || ',' || user_id ELSE '' END AS strings FROM events""",
)
def _f12(spark, d):
    bad = F.col("event_id") % 4 == 0
    strings = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    o = S.json_object(F.when(bad, "{oops").otherwise(F.col("props")))
    return table(spark, d, "events").select("event_id", F.try_element_at(o, F.lit("k")).alias("k"), F.size(o).alias("n"), F.array_join(S.json_strings(F.when(bad, '["').otherwise(strings)), ",").alias("strings"))


@query(
    "f13_formats",
    """WITH v AS (SELECT doc_id, text, (n_chars * n_chars * n_chars % 5000000000)::BIGINT AS n FROM documents)
      SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:,.1f}', n / 1024) || ' KB' WHEN n < 1073741824 THEN format('{:,.1f}', n / 1048576) || ' MB' ELSE format('{:,.1f}', n / 1073741824) || ' GB' END AS size,
      CASE WHEN n % 9000 < 60 THEN n % 9000 || 's' WHEN n % 9000 < 3600 THEN n % 9000 // 60 || 'm ' || n % 60 || 's' ELSE n % 9000 // 3600 || 'h ' || n % 9000 % 3600 // 60 || 'm' END AS took,
      CASE WHEN length(w) <= 16 THEN w ELSE left(w, 8) || '…' || right(w, 6) END AS short FROM (SELECT *, repeat('ab', (doc_id % 20)::INT) || doc_id AS w FROM v)""",
)
def _f13(spark, d):
    n = F.col("n_chars") * F.col("n_chars") * F.col("n_chars") % 5000000000
    w = F.concat(F.expr("repeat('ab', cast(doc_id % 20 as int))"), F.col("doc_id").cast("string"))
    took = n % 9000
    # Whole minutes of the same remainder: 9000 is a multiple of 60.
    return table(spark, d, "documents").select("doc_id", S.format_bytes(n).alias("size"), S.elapsed(took).alias("took"), S.short_id(w).alias("short"))


@query(
    "f14_without_private",
    """SELECT o_orderkey, '{"camera":{"list":[{"x":1},2],"make":"' || o_orderstatus || '"},"k":' || o_orderkey || '}' AS facts FROM orders""",
)
def _f14(spark, d):
    facts = F.format_string('{"k": %d, "GPSInfo": {"a": 1}, "camera": {"make": "%s", "Latitude": 3, "list": [{"x": 1, "location": [1, 2]}, 2]}}', "o_orderkey", "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", S.without_private_json(facts).alias("facts"))


@query(
    "f16_integers",
    """WITH b AS (SELECT page_id, html, encode(html) AS c FROM pages), o AS (SELECT page_id, octet_length(c) AS n, ord(substr(html, 2, 1)) AS b1, ord(substr(html, 3, 1)) AS b2, ord(substr(html, 4, 1)) AS b3, ord(substr(html, 5, 1)) AS b4 FROM b)
      SELECT page_id, (b1 * 16777216 + b2 * 65536 + b3 * 256 + b4)::BIGINT AS be, (b1 + b2 * 256 + b3 * 65536)::BIGINT AS le, (b1 * 2097152 + b2 * 16384 + b3 * 128 + b4)::BIGINT AS sync, true AS past FROM o""",
)
def _f16(spark, d):
    b = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", S.uint_be(b, 1, 4).alias("be"), S.uint_le(b, 1, 3).alias("le"), S.synchsafe(b, 1).alias("sync"), S.uint_be(b, 1 << 28, 4).isNull().alias("past"))


@query("f17_decoded_text", "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 3 THEN lang || source ELSE text END) AS h FROM documents")
def _f17(spark, d):
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode("text", c))
    k = F.col("doc_id") % 4
    coded = F.when(k == 0, mark("FFFE", "UTF-16LE")).when(k == 1, mark("FEFF", "UTF-16BE")).when(k == 2, mark("EFBBBF", "UTF-8")).otherwise(F.encode(F.concat("lang", "source"), "ISO-8859-1"))
    return table(spark, d, "documents").select("doc_id", F.sha2(S.decode_text(coded), 256).alias("h"))


@query(
    "s8_head_tail",
    "SELECT page_id, sha256(b[1:560]) AS h, sha256(b[greatest(octet_length(b) - 999, 1):octet_length(b)]) AS t, octet_length(b) AS n FROM (SELECT page_id, encode(html) AS b FROM pages)",
)
def _s8(spark, d):
    b = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", F.sha2(S.head(b, 560), 256).alias("h"), F.sha2(S.tail(b, 1000), 256).alias("t"), F.octet_length(b).cast("long").alias("n"))
