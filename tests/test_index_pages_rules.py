"""The substring index, pages of a sorted layout, and entity rules."""

from filelake.operators import search as Q
from filelake.operators import text_index as I
from filelake.sources import entities as G
from filelake.sources import layouts as Z


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    names = [("r%d" % i, "f%d.TXT" % i, "a/%s/f%d.TXT" % ("bc" if i % 7 else "Größe", i)) for i in range(400)]
    names += [("n1", None, None), ("n2", "ab", "ab"), ("n3", "aaaaaa", "x/aaaaaa"), ("n4", "", "")]
    rows = spark.createDataFrame(names, "record_id string, name string, relative_path string")
    path = str(tmp_path / "index")
    I.build_index(rows, path)
    for text in ("f12", "TXT", "größe/f14", "aaaa", "ab", "a", "", "/bc/f399.txt", "zzz", "f12f", "x/a"):
        got = sorted(r["record_id"] for r in I.search_index(spark, path, text).collect())
        assert got == sorted(r["record_id"] for r in Q.search_inventory(rows, text).collect()), text
    # A rare gram leaves few candidates.
    assert I.candidates(spark, path, "f399.txt").count() == 1


def test_more_candidates_than_are_pushed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PUSHED", 5)
    rows = spark.range(100).selectExpr("concat('r', id) as record_id", "concat('name', id) as name", "concat('d/name', id) as relative_path")
    I.build_index(rows, str(tmp_path / "index"))
    assert I.search_index(spark, str(tmp_path / "index"), "NAME").count() == 100
    empty = str(tmp_path / "empty")
    I.build_index(rows.limit(0), empty)
    assert I.search_index(spark, empty, "name").count() == I.search_index(spark, empty, "na").count() == 0


def test_pages_open_few_files(spark, tmp_path):
    rows = spark.range(1000).selectExpr("concat('p', id % 50) as relative_path", "concat('r', id) as record_id")
    keys, path = ["relative_path", "record_id"], str(tmp_path / "pages")
    Z.write_sorted(rows, keys, path, 8)
    want = [tuple(r) for r in rows.orderBy(*keys).collect()]
    for n in (90, 400):
        got, cursor, first = [], None, True
        while first or cursor:
            values = Q._uncursor("page", cursor) if cursor else None
            if n == 90:
                assert len(Z.files_behind(spark, path, keys, values, n + 1)) <= 3
            page, cursor = Z.page_sorted(spark, path, keys, cursor, n)
            assert page == Q.page_keyset(rows, keys, Q._cursor("page", values) if values else None, n)[0]
            got, first = got + [tuple(r) for r in page], False
        assert got == want
    assert Z.rows_behind(spark, path, keys, ["z", ""], 5).collect() == []
    Z.write_sorted(rows.limit(0), keys, str(tmp_path / "none"))
    assert Z.page_sorted(spark, str(tmp_path / "none"), keys, None) == ([], None)


def test_rules(spark, tmp_path):
    rows = [("r1", "d", 5, "sha256", "verified"), ("r2", "d", -1, "md5", "verified"), ("r2", None, 1, None, None), (None, "d", 3, "sha256", "reused"), (None, "d", 3, "sha256", "new")]
    df = spark.createDataFrame(rows, "record_id string, digest string, byte_length long, algorithm string, verification_state string")
    got = sorted(r["violations"] for r in G.checked(df, G.ENTITIES["file_hashes"]).collect())
    low = "byte_length is too small"
    assert got == sorted([[], ["algorithm is not allowed", low, "record_id is repeated"], ["digest is required", "record_id is repeated"], ["record_id is required"], ["record_id is required", "verification_state is not allowed"]])
    known = spark.createDataFrame([("r1",), ("r1",), (None,)], "id string")
    told = {r["rule"]: r["n"] for r in G.violations(df, G.ENTITIES["file_hashes"], {"record_id": (known, "id")}).collect()}
    assert told["record_id is unknown"] == 2 and told["record_id is repeated"] == 2 and told["record_id is required"] == 2
    kept, refused = G.write_entity(df, str(tmp_path), "file_hashes")
    assert spark.read.parquet(kept).count() == 1 and spark.read.parquet(refused).count() == 4 and spark.read.parquet(kept).columns == df.columns
    assert G.violations(df.limit(0), G.ENTITIES["file_hashes"]).count() == 0
    try:
        G.checked(df.drop("digest"), G.ENTITIES["file_hashes"])
    except ValueError as e:
        assert "digest" in str(e)
    else:
        raise AssertionError
