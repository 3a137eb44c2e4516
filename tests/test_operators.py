"""Literal cases of single operators."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from filelake.functions import paths as P
from filelake.functions import scalars as S
from filelake.operators import duplicates as D
from filelake.operators import facts as X
from filelake.operators import ledger as E
from filelake.operators import organize as O
from filelake.operators import reconcile as N
from filelake.operators import search as Q
from filelake.operators import transfer as T
from filelake.plans import registry
from filelake.sources.listing import read_tree
from filelake.sources.tables import export_manifest, import_manifest, read_event_log


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_path_rules(spark):
    rows = [("../a", "traversal"), ("/a", "absolute"), ("a\0b", "empty-or-null-byte"), ("", "empty-or-null-byte"), ("a/b", None), ("./", "root-itself")]
    for path, want in rows:
        assert one(spark, P.relative_path_error(F.lit(path))) == want
    assert one(spark, P.relative_path_error(F.lit("C:\\x"), "win32")) == "absolute"
    assert one(spark, P.relative_path_error(F.lit("a/b."), "win32")) == "trailing-dot-or-space"
    assert one(spark, P.ancestors(F.lit("a/b/c"))) == ["", "a", "a/b"]
    assert one(spark, P.ancestors(F.lit("c"))) == [""]
    assert one(spark, P.stem(F.lit("d/.bashrc"))) == ".bashrc"
    assert one(spark, P.extension(F.lit("a."))) is None
    assert one(spark, P.read_only(F.lit(0o444))) is True


def test_scalars(spark):
    assert one(spark, S.rational_number(F.lit("30000/1001"))) == 30000 / 1001
    assert one(spark, S.rational_number(F.lit("1/0"))) is None
    assert one(spark, S.normalize_exif_date(F.lit("2024:07:04 12:34:56"))) == "2024-07-04T12:34:56"
    assert one(spark, S.uint_le(F.lit(bytearray(b"\x01\x02\x03\x04")), 0, 4)) == 0x04030201
    assert one(spark, S.uint_be(F.lit(bytearray(b"\x01\x02")), 1, 2)) is None
    assert one(spark, S.canonical_json(F.lit('{"b":"1","a":"2"}'))) == '{"a":"2","b":"1"}'
    assert one(spark, S.gps_decimal(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("S"))) == -10.5
    assert one(spark, S.decode_text(F.lit(bytearray("é".encode("utf-16"))))) == "é"


def test_binary_facts(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 5)
    assert tuple(one(spark, X.image_size(F.lit(bytearray(png))))) == (640, 480)
    assert tuple(one(spark, X.image_size(F.lit(bytearray(gif))))) == (3, 5)
    pdf = b"%PDF-1.7 /Title (A) /Author (B) /Type /Page x /Type /Page /Type /Pages"
    got = one(spark, X.pdf_facts(F.lit(bytearray(pdf))))
    assert (got["pages"], got["title"], got["author"]) == (2, "A", "B")
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 3, 3, 120, 0, 0)
    got = one(spark, X.archive_facts(F.lit(bytearray(end)), F.lit("zip")))
    assert (got["archive_type"], got["entries"], got["directory_bytes"]) == ("zip", 3, 120)
    wav = b"RIFF" + struct.pack("<I", 192036) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48000, 192000, 4, 16) + b"data" + struct.pack("<I", 192000) + b"\0" * 8
    assert X.wave(wav) == {"channels": 2, "rate": 48000, "bits": 16, "duration": 1.0}
    probe = '{"format":{"format_name":"mp4","duration":"12.5"},"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"30000/1001"},{"codec_type":"audio","codec_name":"aac","channels":2}]}'
    got = one(spark, X.normalize_probe(F.lit(probe)))
    assert (got["duration"], got["width"], got["frame_rate"], got["channels"]) == (12.5, 1920, 29.97, 2)
    df = spark.createDataFrame([("a", bytearray(wav)), ("b", bytearray(b"\xff\xd8\xff")), ("c", bytearray(b"II*\0")), ("d", None)], "record_id string, content binary")
    assert {r["record_id"]: r["status"] for r in X.walked_facts(df).collect()} == {"a": "completed", "b": "completed", "c": "failed", "d": "unavailable"}


def test_collisions_match_a_sequential_pass(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", f"{rng.choice('abc')}/{i:03}/f", "T/" + rng.choice(["f.txt", "f (2).txt", "g.txt", "f (2) (2).txt", "h"])) for i in range(120)]
    seen = ["T/f.txt", "T/f (3).txt", "T/h"]
    taken, want = set(seen), {}
    for r, _, wish in sorted(rows, key=lambda x: x[1]):
        stem, dot, ext = wish.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (wish, "")
        got = next(n for n in [wish, *[f"{stem} ({k}){ext}" for k in range(2, 500)]] if n not in taken)
        taken.add(got)
        want[r] = got
    w = spark.createDataFrame(rows, "record_id string, relative_path string, destination string")
    o = spark.createDataFrame([(x,) for x in seen], "relative_path string")
    assert {r["record_id"]: r["final"] for r in O.resolve_collisions(w, o).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_free_slots_match_a_sequential_pass(spark, seed):
    """Families whose wishes name each other's numbers, and families whose wishes do not, over gaps of taken ones."""
    rng = random.Random(seed)
    stems = ["a", "a (2)", "a (3)", "a (2) (2)", "b", "b (02)", "b (1)", "c (10000)", "c", "d (7)", "e.x", ".f"]
    rows = [(f"r{i}", f"{i:04}", "T/" + rng.choice(stems) + rng.choice(["", ".txt"])) for i in range(300)]
    seen = {"T/" + rng.choice(stems) + rng.choice(["", f" ({rng.randint(0, 12)})"]) + rng.choice(["", ".txt"]) for _ in range(60)}
    taken, want = set(seen), {}
    for r, _, wish in rows:
        at = wish.rfind(".")
        stem, ext = (wish[:at], wish[at:]) if at >= 0 else (wish, "")
        want[r] = next(n for n in [wish, *[f"{stem} ({k}){ext}" for k in range(2, 999)]] if n not in taken)
        taken.add(want[r])
    w = spark.createDataFrame(rows, "record_id string, relative_path string, destination string")
    o = spark.createDataFrame([(x,) for x in sorted(seen)], "relative_path string")
    assert {r["record_id"]: r["final"] for r in O.resolve_collisions(w, o).collect()} == want
    firsts = {}
    for r, _, wish in rows:
        firsts.setdefault(wish, r)
    skipped = {r["record_id"]: r["final"] for r in O.resolve_collisions(w, o, "skip").collect()}
    assert skipped == {r: wish if firsts[wish] == r and wish not in seen else None for r, _, wish in rows}


def test_a_name_that_most_files_share(spark):
    """60,000 wishes for one name with every third number taken: no Python, and the numbers end at 10,000."""
    w = spark.range(60_000).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lpad(F.col("id").cast("string"), 6, "0").alias("relative_path"), F.lit("T/x.txt").alias("destination"))
    o = spark.range(1, 20_000).select(F.concat(F.lit("T/x ("), (3 * F.col("id")).cast("string"), F.lit(").txt")).alias("relative_path"))
    got = [r["final"] for r in O.resolve_collisions(w, o).orderBy("relative_path").collect()]
    free = ["T/x.txt", *[f"T/x ({k}).txt" for k in range(2, 10_001) if k % 3]]
    assert got == free + [None] * (60_000 - len(free))


def test_reconcile_by_folder(spark):
    none = F.lit(None).cast("boolean")
    base = spark.range(400).select(F.lit("r").alias("root_id"), F.concat(F.lit("top/d"), (F.col("id") % 20).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("relative_path"), F.lit("file").alias("entry_type"), F.col("id").alias("byte_length"), F.lit(None).cast("timestamp").alias("modified_at"), none.alias("hidden"), F.lit(True).alias("system"), F.lit(True).alias("read_only"), F.lit("observed").alias("observation_status"))
    swapped = F.col("relative_path") == "top/d3/f3"
    comp = base.where("relative_path <> 'top/d7/f7'").withColumns({"hidden": F.when(swapped, F.lit(True)), "read_only": F.when(~swapped, F.lit(True))})
    old, new = N.folder_digests(base), N.folder_digests(comp.repartition(7))
    assert {r["folder"] for r in N.changed_folders(old, new).collect()} == {"top/d3", "top/d7"}
    want = sorted((r["relative_path"], r["kind"]) for r in N.reconcile(base, comp).collect())
    assert want == [("top/d3/f3", "metadata-changed"), ("top/d7/f7", "missing")]
    assert sorted((r["relative_path"], r["kind"]) for r in N.reconcile_by_folder(base, comp, base_digests=old).collect()) == want
    same = {r["folder"]: r["n"] for r in N.unchanged_subtrees(old, new).collect()}
    assert same == {f"top/d{k}": 20 for k in range(20) if k not in (3, 7)}
    assert [(r["folder"], r["n"]) for r in N.unchanged_subtrees(old, old).collect()] == [("", 400)]
    assert N.reconcile_by_folder(base, base).count() == 0 and N.reconcile_by_folder(base.limit(0), base).count() == 400


def test_media_listing_holds_every_document(spark):
    sf = "/root/testdata/sf0.001"
    listing = registry._media_listing(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    stems = listing.groupBy(F.substring_index("record_id", ".", 1).alias("stem")).agg(F.count("*").alias("n"))
    assert stems.count() == n and stems.where("n = 1").count() > n / 2
    assert {r["ext"] for r in listing.select(F.substring_index("record_id", ".", -1).alias("ext")).distinct().collect()} == {"txt", "nef", "jpg", "xmp"}


def test_audit_chain(spark):
    events = spark.createDataFrame([("c", i, f"e{i}") for i in range(4)] + [("d", 0, "x")], "k string, o int, b string")
    chain = E.append_chain(events, "k", "o", "b")
    assert all(r["valid"] for r in E.verify_chain(chain, "k", "b").collect())
    bad = chain.withColumn("b", F.when((F.col("k") == "c") & (F.col("sequence") == 1), "y").otherwise(F.col("b")))
    got = {r["k"]: r for r in E.verify_chain(bad, "k", "b").collect()}["c"]
    assert (got["valid"], got["entries_checked"], got["first_invalid"]) == (False, 0, 1)
    gap = chain.where("not (k = 'c' and sequence = 2)")
    got = {r["k"]: r for r in E.verify_chain(gap, "k", "b").collect()}["c"]
    assert (got["entries_checked"], got["first_invalid"], got["reason"]) == (1, 3, "sequence")


def test_long_chain_is_not_held_as_an_array(spark):
    n = 20_000
    events = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").alias("k"), (-F.col("id")).alias("o"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("ü"), F.col("id").cast("string"))).alias("b"))
    chain = E.append_chain(events, "k", "o", "b")
    assert "collect_list" not in chain._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for odd, key in ((0, "hot"), (1, None)):
        last = None
        for s, i in enumerate(range(n - 2 + odd, -1, -2), 1):
            h = hashlib.sha256(f"{last or E.GENESIS}\0{f'ü{i}' if i % 5 else ''}".encode()).hexdigest()
            want[key, s] = (-i, last, h)
            last = h
    assert {(r["k"], r["sequence"]): (r["o"], r["previous_hash"], r["entry_hash"]) for r in chain.collect()} == want


def test_reuse_prefers_the_file_over_the_path(spark):
    ddl = "record_id string, root_id string, relative_path string, byte_length long, modified_at string, device_id string, filesystem_record_id string"
    tasks = spark.createDataFrame([("t", "r", "p", 1, "2024", "d", "7"), ("u", "r", "q", 1, None, "d", "8")], ddl)
    prior = spark.createDataFrame([("a", "r", "x", 1, "2024", "d", "7", "h1", 1), ("b", "r", "p", 1, "2024", "e", "9", "h2", 2), ("c", "r", "q", 1, None, "d", "8", "h3", 3)], ddl + ", digest string, hashed_at int")
    assert {r["record_id"]: r["digest"] for r in D.reuse_hashes(tasks, prior).collect()} == {"t": "h1", "u": None}


def test_paging(spark):
    df = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    seen, cursor = [], None
    for _ in range(3):
        rows, cursor = Q.page_keyset(df, ["k"], cursor, 2)
        seen += [r["k"] for r in rows]
    assert seen == list("abcde") and cursor is None
    rows, cursor = Q.page_offset(df, [F.desc("k")], None, 3)
    assert [r["k"] for r in rows] == ["e", "d", "c"] and cursor


def test_submissions_and_reconcile_guards(spark):
    s = spark.createDataFrame([("k", "p", 1, "j1"), ("k", "p", 2, "j2"), ("x", "p", 1, "j3"), ("x", "q", 2, "j4")], "key string, payload string, submitted_at int, job_id string")
    ok, bad = E.idempotent(s)
    assert {r["key"]: r["job_id"] for r in ok.collect()} == {"k": "j1", "x": "j3"} and [r["key"] for r in bad.collect()] == ["x"]
    scans = spark.createDataFrame([("a", "r", "completed"), ("b", "r", "completed"), ("c", "z", "completed")], "scan_id string, root_id string, status string")
    assert N.check_reconcilable(scans, "a", "b") == N.check_reconcilable(scans, "a", "b")
    for pair in (("a", "a"), ("a", "c"), ("a", "none")):
        try:
            N.check_reconcilable(scans, *pair)
            raise AssertionError(pair)
        except ValueError:
            pass


def test_receipt(spark):
    items = spark.createDataFrame([("p", x) for x in ["imported", "imported", "exact-duplicate", "needs-review", "skipped", "failed"]], "plan_id string, outcome string")
    assert tuple(T.receipt_counts(items).first())[1:] == (6, 2, 1, 1, 1, 1)


def test_tree_and_event_log(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.txt", ".hidden", "a/y.txt", "a/b/_z"):
        (tmp_path / name).write_text("12345")
    got = {r["relative_path"]: r["entry_type"] for r in read_tree(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": "file", ".hidden": "file", "a": "directory", "a/y.txt": "file", "a/b": "directory", "a/b/_z": "file"}
    (tmp_path / "log.jsonl").write_text('{"seq":1,"kind":"approve"}\nnot json\n{"seq":2,"kind":"revoke"}\n')
    events, bad = read_event_log(spark, str(tmp_path / "log.jsonl"), "seq int, kind string")
    assert events.count() == 2 and [r["line"] for r in bad.collect()] == ["not json"]
    lines = export_manifest({"event": events, "other": bad})
    assert sorted(map(tuple, import_manifest(lines, "event", "seq int, kind string").collect())) == [(1, "approve"), (2, "revoke")]


def test_what_cannot_be_read_is_a_row(tmp_path):
    from filelake.sources import listing

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    reader = listing.TreeReader(str(tmp_path))
    rows = [r for p in [*reader.partitions(), listing.InputPartition("gone")] for r in reader.read(p)]
    assert [(r[0], r[2], r[-1]) for r in rows] == [("a", "directory", None), ("a/x", "file", None), ("gone", "directory", "vanished")]
    assert listing._issue(PermissionError()) == "inaccessible"


def test_corrupt_logs_are_told_by_line(spark, tmp_path):
    (tmp_path / "one").write_text('{"seq":1}\n\nbad\n{"seq":2}\nworse')
    (tmp_path / "two").write_text('{"seq":3}\n')
    events, bad = read_event_log(spark, str(tmp_path), "seq int")
    assert sorted(r["seq"] for r in events.collect()) == [1, 2, 3]
    assert sorted((r["file"].rpartition("/")[2], r["number"], r["line"], r["reason"]) for r in bad.collect() if r["line"]) == [("one", 3, "bad", "bad-json"), ("one", 5, "worse", "bad-json")]
    assert [(r["file"].rpartition("/")[2], r["number"]) for r in bad.where("reason = 'incomplete'").collect()] == [("one", 5)]


def _directory(entries, at, order="<"):
    """A TIFF directory at `at`: entries (tag, kind, count, four bytes or data that follows it)."""
    import struct

    head, tail, end = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if len(value) > 4:
            value, tail = struct.pack(order + "I", end + len(tail)), tail + value
        head += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
    return struct.pack(order + "H", len(entries)) + head + bytes(4) + tail


def test_image_tags():
    import struct

    from filelake.operators import facts

    rational = lambda *x: b"".join(struct.pack("<II", a, b) for a, b in x)
    gps = _directory([(1, 2, 2, b"S\0"), (2, 5, 3, rational((10, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, rational((20, 1), (0, 1), (36, 1))), (5, 1, 1, b"\1"), (6, 5, 1, rational((5, 2)))], 500)
    first = _directory([(0x0112, 3, 1, struct.pack("<H", 6)), (0x010F, 2, 4, b"abc\0"), (0x0132, 2, 20, b"2024:01:02 03:04:05\0"), (0x8825, 4, 1, struct.pack("<I", 500))], 8)
    data = (b"II*\0" + struct.pack("<I", 8) + first).ljust(500, b"\0") + gps
    want = {"orientation": 6, "make": "abc", "capture_date": "2024:01:02 03:04:05", "latitude": -10.5, "longitude": 20.01, "altitude": -2.5}
    assert facts.tiff(data) == want
    frame = b"\xff\xc9\x00\x08\x08\x00\x10\x00\x20\x00"
    exif = lambda body: b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body
    assert facts.jpeg(b"\xff\xd8" + exif(data) + frame) == want | {"height": 16, "width": 32}
    broken = facts.jpeg(b"\xff\xd8" + exif(b"II*\0" + struct.pack("<I", 9999)) + frame)
    assert (broken["height"], broken["width"]) == (16, 32) and broken["exif_error"].startswith("error")


def test_audio_tags():
    from filelake.operators import facts

    frame = lambda name, text: name + (len(text) + 1).to_bytes(4, "big") + b"\0\0\0" + text
    body = frame(b"TIT2", b"Song") + frame(b"TRCK", b"3/9") + frame(b"TYER", b"1999")
    assert facts.id3(b"ID3\3\0\0" + bytes([0, 0, 0, len(body)]) + body) == {"title": "Song", "track": "3/9", "date": "1999"}


def test_a_name_that_everyone_wants(spark, monkeypatch):
    from filelake.operators import organize

    monkeypatch.setattr(organize, "NAMES", 40)
    rows = [(f"r{i}", f"d{i:04d}/x.txt", "o/x.txt") for i in range(60)] + [("s", "e/x (3).txt", "o/x (3).txt"), ("t", "z/y.txt", "o/y.txt")]
    wishes = spark.createDataFrame(rows, "record_id string, relative_path string, destination string")
    seen = spark.createDataFrame([("o/x (2).txt",), ("a/b.txt",)], "relative_path string")
    got = {r["record_id"]: r["final"] for r in organize.resolve_collisions(wishes, seen).collect()}
    assert got["r0"] == "o/x.txt" and got["r1"] == "o/x (3).txt" and got["s"] == "o/x (3) (2).txt" and got["t"] == "o/y.txt"
    names = [got[f"r{i}"] for i in range(60)]
    assert len({n for n in names if n}) == 39 and names[39:] == [None] * 21
