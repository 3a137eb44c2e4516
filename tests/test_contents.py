"""Files read where they lie, the registry of analyzers, and matches bounded before their join."""

import hashlib
import os
import struct
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filelake.operators import analysis, duplicates, facts, ledger
from filelake.sources import contents
from filelake.sources.listing import read_tree, scan_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret").write_bytes(b"s")
    page = b"/Type /Page "
    (root / "big.pdf").write_bytes(b"%PDF-1.7 /Title (One) " + page + b" " * (2 << 20) + page * 5 + b" " * (3 << 20) + page)
    (root / "two.pdf").write_bytes(b"%PDF-1.7 " + page * 2 + b"x" * (3 << 20) + page)
    (root / "sub" / "a.zip").write_bytes(b"PK\3\4" + b"z" * 200_000 + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 7, 7, 120, 0, 0))
    (root / "sub" / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\1" * 100_000)
    (root / "none.txt").write_bytes(b"")
    os.symlink(tmp_path / "outside" / "secret", root / "link")
    os.symlink(tmp_path / "outside", root / "way")
    return root


def listed(spark, root, more=()):
    rows = read_tree(spark, str(root)).where("entry_type = 'file'")
    rows = rows.select("relative_path", *contents._OBSERVED)
    if more:
        rows = rows.unionByName(spark.createDataFrame([(path, *[None] * 4) for path in more], rows.schema))
    return rows.withColumns({"record_id": F.col("relative_path"), "extension": F.element_at(F.split("relative_path", r"\."), -1)})


def test_hashing_by_chunks(spark, tree):
    files = listed(spark, tree, ["gone", "../outside/secret", "/etc/passwd", "link", "way/secret", "sub", "sub//a.zip", ""])
    files = files.withColumn("byte_length", F.when(F.col("record_id") == "two.pdf", 5).otherwise(F.col("byte_length")))
    files = files.withColumn("modified_at", F.when(F.col("record_id") == "sub/b.png", F.col("modified_at") + F.expr("interval 1 second")).otherwise(F.col("modified_at")))
    got = {r["record_id"]: r for r in contents.hash_files(files, str(tree), 4096).collect()}
    for name in ("big.pdf", "sub/a.zip", "none.txt"):
        data = (tree / name).read_bytes()
        assert (got[name]["hash_state"], got[name]["digest"], got[name]["bytes_read"]) == ("verified", hashlib.sha256(data).hexdigest(), len(data))
    states = {k: r["hash_state"] for k, r in got.items() if r["digest"] is None}
    assert states == {"two.pdf": "unstable", "sub/b.png": "unstable", "gone": "vanished"} | dict.fromkeys(["../outside/secret", "/etc/passwd", "link", "way/secret", "sub", "sub//a.zip", ""], "unsafe")
    assert contents.hash_files(files.limit(0), str(tree)).count() == 0


def test_a_file_that_changes_while_it_is_read(tree):
    row = {"relative_path": "none.txt"} | dict.fromkeys(contents._OBSERVED)
    read = contents._digest(4)
    assert contents._steadily(str(tree), row, read)[0] == "verified"

    def meddled(fd, size):
        (tree / "none.txt").write_bytes(b"more")
        return read(fd, size)

    assert contents._steadily(str(tree), row, meddled) == ("unstable", None)
    assert contents._steadily(str(tree), row, lambda fd, size: read(fd, size + 1)) == ("inaccessible", None)


def test_ranges_tell_what_whole_contents_tell(spark, tree):
    files = listed(spark, tree)
    got = {r["record_id"]: r for r in contents.ranged_facts(files, str(tree)).collect()}
    whole = files.withColumn("content", F.lit(b""))
    rows = [(r["record_id"], r["extension"], (tree / r["record_id"]).read_bytes()) for r in whole.collect()]
    df = spark.createDataFrame(rows, "record_id string, extension string, content binary")
    for r in facts.extract_facts(df).collect():
        g = got[r["record_id"]]
        assert [g[c] for c in ("mime_type", "type_source", "width", "height", "pages", "entries")] == [r[c] for c in ("mime_type", "type_source", "width", "height", "pages", "entries")]
    assert (got["big.pdf"]["pages"], got["big.pdf"]["title"], got["two.pdf"]["pages"], got["sub/a.zip"]["entries"], got["sub/b.png"]["width"]) == (2, "One", 3, 7, 640)
    read = {k: r["bytes_read"] for k, r in got.items()}
    assert read == {"big.pdf": 4 << 20, "two.pdf": (tree / "two.pdf").stat().st_size, "sub/a.zip": 560 + 66_000, "sub/b.png": 560, "none.txt": 0}


def test_a_count_that_lies_costs_nothing():
    for count in (3, 100_000_000, 0xFFFFFFFF):
        gps = struct.pack("<HHHII", 1, 2, 5, count, 44) + struct.pack("<I", 0)
        data = b"II*\0" + struct.pack("<IHHHII", 8, 1, 0x8825, 4, 1, 26) + struct.pack("<I", 0) + gps
        began = time.time()
        with pytest.raises(struct.error):
            facts.tiff(data)
        assert len(data) < 60 and time.time() - began < 0.1


FILES = "record_id string, root_id string, signature string, extension string, content binary, observation_status string, entry_type string, byte_length long"
PRIOR = "record_id string, root_id string, signature string, analyzer string, version string, status string, facts_json string, analyzed_at timestamp"


def file_rows(spark, rows):
    return spark.createDataFrame([(i, "root", s, e, c, "observed", "file", 1) for i, s, e, c in rows], FILES)


def test_registry(spark):
    def size(data):
        if data == b"bad":
            raise ValueError("bad file")
        if data == b"known":
            raise AssertionError("what is known is not read")
        return {"size": len(data)} if data != b"odd" else None

    one = analysis.Analyzer("size", "2", lambda: F.col("extension") != "none", function=size)
    two = analysis.Analyzer("head", "1", lambda: F.col("extension") == "txt", native=lambda c: F.when(F.length(c) > 0, F.create_map(F.lit("head"), F.hex(F.substring(c, 1, 1)))))
    files = file_rows(spark, [("a", "s1", "txt", b"known"), ("b", "s2", "txt", b"bad"), ("c", "s3", "txt", b"odd"), ("d", "s4", "pdf", None), ("e", "s5", "none", b"x"), ("f", "s1", "pdf", b"known"), ("g", "s7", "txt", b"")])
    files = files.unionByName(file_rows(spark, [("z", "s9", "txt", b"x")]).withColumn("observation_status", F.lit("skipped")))
    at = "2024-01-01"
    prior = [("a", "root", "s1", "size", "2", "completed", '{"size":"9"}', at), ("b", "root", "s2", "size", "2", "failed", None, at), ("c", "root", "s3", "size", "1", "completed", '{"old":"1"}', at), ("g", "root", "s7", "head", "1", "unavailable", None, at)]
    known = spark.createDataFrame(prior, PRIOR.replace("timestamp", "string")).withColumn("analyzed_at", F.col("analyzed_at").cast("timestamp"))
    got = {(r["record_id"], r["analyzer"]): (r["status"], r["facts_json"], r["message"], r["reused"]) for r in analysis.extract_facts(files, known, (one, two)).collect()}
    assert got == {
        ("a", "size"): ("completed", '{"size":"9"}', None, True),
        ("f", "size"): ("completed", '{"size":"9"}', None, True),
        ("a", "head"): ("completed", '{"head":"6B"}', None, False),
        ("b", "size"): ("failed", None, "ValueError: bad file", False),
        ("b", "head"): ("completed", '{"head":"62"}', None, False),
        ("c", "size"): ("unavailable", None, None, False),
        ("c", "head"): ("completed", '{"head":"6F"}', None, False),
        ("d", "size"): ("completed", '{"size":"0"}', None, False),
        ("g", "size"): ("completed", '{"size":"0"}', None, False),
        ("g", "head"): ("unavailable", None, None, False),
    }
    assert analysis.extract_facts(files.limit(0), known, (one, two)).count() == 0
    with pytest.raises(ValueError):
        analysis.analysis_tasks(files, (one, one))


def test_registry_of_the_library(spark):
    wav = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 2, 48000, 192000, 4, 16) + b"data" + struct.pack("<I", 192000)
    exif = b"II*\0" + struct.pack("<IHHHII", 8, 1, 0x0112, 3, 1, 6) + b"\0\0\0\0"
    id3 = b"ID3\3\0\0\0\0\0\x15TIT2\0\0\0\5\0\0\0Song" + b"\0" * 10
    rows = [("w", "s", "wav", wav), ("t", "s2", "tif", exif), ("m", "s3", "mp3", id3), ("j", "s4", "jpg", b"II*\0\xff"), ("p", "s5", "pdf", b"%PDF- /Type /Page "), ("x", "s6", "txt", b"?")]
    none = spark.createDataFrame([], PRIOR)
    got = analysis.extract_facts(file_rows(spark, rows), none)
    said = {(r["record_id"], r["analyzer"]): (r["status"], r["facts_json"]) for r in got.collect()}
    assert said["w", "media-tags"] == ("completed", '{"bits":"16","channels":"2","duration":"1.0","rate":"48000"}')
    assert said["t", "media-tags"] == ("completed", '{"orientation":"6"}') and said["m", "media-tags"] == ("completed", '{"title":"Song"}')
    assert said["j", "media-tags"][0] == "failed" and said["p", "pdf"] == ("completed", '{"pages":"1"}')
    assert said["x", "file-type"] == ("completed", '{"mime_type":"application/octet-stream","source":"extension"}') and len(said) == 11
    counts = {r["record_id"]: tuple(r)[1:] for r in analysis.analysis_counts(got).collect()}
    assert counts["j"] == (2, 1, 0) and counts["x"] == (1, 0, 0)


def test_matches_of_a_content_with_many_copies(spark):
    rows = [(f"r{i}", f"root{i % 3}", f"p{i * 7 % 5000:05d}", "hot", 10) for i in range(5000)] + [(f"s{i}", "root0", f"q{i}", f"d{i % 40}", 10) for i in range(100)]
    rows += [("n", "root0", "n", None, 10), ("t", "root0", "q0", "d0", 11)]
    hashes = spark.createDataFrame(rows, "record_id string, root_id string, relative_path string, digest string, byte_length long").repartition(7)
    first = duplicates.first_copies(hashes, 50)
    assert {r["digest"]: r["n"] for r in first.groupBy("digest").agg(F.sum(F.size("matches")).alias("n")).collect()}["hot"] == 50
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    items = spark.createDataFrame([(f"i{i}", "hot", 10) for i in range(3000)] + [("j", "d3", 10), ("k", "d0", 11), ("l", None, 10), ("m", "other", 10)], "item_id string, digest string, byte_length long")
    want = defaultdict(list)
    for record, root, path, digest, size in rows:
        want[digest, size].append((root, path, record))
    got = {r["item_id"]: [tuple(m) for m in r["matches"]] for r in duplicates.top_matches(items, hashes, 50).collect()}
    assert len(got) == 3002 and all(got[f"i{i}"] == sorted(want["hot", 10])[:50] for i in (0, 1, 2999))
    assert got["j"] == sorted(want["d3", 10]) and got["k"] == sorted(want["d0", 11])


def test_a_scan_goes_on_where_it_was_stopped(spark, tmp_path):
    root, state = tmp_path / "tree", str(tmp_path / "state")
    for i in range(30):
        (root / "top" / f"d{i}" / "deep" / "er").mkdir(parents=True)
        (root / "top" / f"d{i}" / "deep" / f"f{i}").write_bytes(b"x" * i)
    os.symlink(root, root / "top" / "loop")
    whole = sorted(tuple(r) for r in read_tree(spark, str(root)).collect())
    assert scan_tree(spark, str(root), state, levels=2) is None
    assert sorted(os.listdir(state)) == ["level=0", "level=1"]
    os.remove(f"{state}/level=1/_SUCCESS")  # as if it had been stopped within the level
    assert scan_tree(spark, str(root), state, levels=1) is None
    (root / "later").mkdir()  # a level that is whole is not listed again
    got = scan_tree(spark, str(root), state)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, whole))
    third = spark.read.parquet(f"{state}/level=3")
    assert len([f for f in os.listdir(f"{state}/level=3") if f.startswith("part-")]) > 1 and third.count() == 60
    empty = tmp_path / "empty"
    empty.mkdir()
    assert scan_tree(spark, str(empty), str(tmp_path / "other")).count() == 0
    assert [r["issue_code"] for r in scan_tree(spark, str(tmp_path / "gone"), str(tmp_path / "third")).collect()] == ["vanished"]


def test_places_in_a_queue(spark):
    rows = [(f"j{i:04d}", "hot" if i % 10 else None, None if i % 17 == 0 else i % 3, None if i % 13 == 0 else 1700000000.25 + (i * 7919 % 50_000) // 3, "queued" if i % 9 else "running") for i in range(3000)]
    df = spark.createDataFrame(rows, "job_id string, kind string, priority int, at double, status string").withColumn("submitted_at", F.timestamp_seconds("at"))
    got = {r["job_id"]: r["place"] for r in ledger.dispatch_order(df).collect()}
    want = {}
    for kind in ("hot", None):
        queue = sorted((r for r in rows if r[1] == kind and r[4] == "queued"), key=lambda r: (r[2] is None, -(r[2] or 0), r[3] is not None, r[3] or 0, r[0]))
        want |= {r[0]: n for n, r in enumerate(queue, 1)}
    assert got == want
