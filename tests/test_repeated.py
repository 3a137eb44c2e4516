"""Tables of repeated rows and files of more than two windows."""

import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from filelake.plans.registry import ORACLE_SQL, QUERIES
from filelake.sources import contents

SF = "/root/testdata/sf0.001"


def agrees(spark, d, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = QUERIES[name](spark, str(d))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_runs_of_repeated_rows(spark, tmp_path):
    """Orders whose rows are repeated: each of a run's items is one operation's, not all copies'."""
    for t, n in (("orders", 1), ("conversations", 1), ("lineitem", 3)):
        pq.write_table(pa.concat_tables([pq.read_table(f"{SF}/{t}.parquet")] * n), tmp_path / f"{t}.parquet")
    agrees(spark, tmp_path, "q10_list_runs", ["orders", "conversations", "lineitem"])


@pytest.mark.parametrize("keyless", [False, True])
def test_runs_with_nulls(spark, tmp_path, keyless):
    """Rows without a number come last, as in the SQL; without any key there is no last conversation."""
    for t, key, number in (("orders", None, None), ("conversations", "conv_id", "turn"), ("lineitem", "l_orderkey", "l_linenumber")):
        rows = pq.read_table(f"{SF}/{t}.parquet")
        if key:
            top = max(rows[key].to_pylist())
            first = rows[key].to_pylist().index(top)  # one row of the last key, a user's turn
            numbers = [None if i == first else x for i, x in enumerate(rows[number].to_pylist())]
            rows = rows.set_column(rows.schema.get_field_index(number), number, pa.array(numbers, rows.schema.field(number).type))
            if keyless:
                rows = rows.set_column(rows.schema.get_field_index(key), key, pa.nulls(len(rows), rows.schema.field(key).type))
        pq.write_table(rows, tmp_path / f"{t}.parquet")
    agrees(spark, tmp_path, "q10_list_runs", ["orders", "conversations", "lineitem"])


def test_files_of_more_than_two_windows(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 60)
    long = pa.array([(x or "") + " word" * 150_000 for x in docs["text"].to_pylist()])
    docs = docs.set_column(docs.schema.get_field_index("text"), "text", long)
    docs = docs.set_column(docs.schema.get_field_index("source"), "source", pa.array(["s"] * 60))
    pq.write_table(docs, tmp_path / "documents.parquet")
    agrees(spark, tmp_path, "x3_ranged_facts", ["documents"])


@pytest.mark.parametrize("step", [5, 64, 3000])
def test_parts_cut_no_page_and_no_title(spark, tmp_path, step):
    random.seed(step)
    bits = ["/Type", "/Page", "/Pages", " ", "\n", " " * 2500, "/Title", "(", ")", "x", "/T", "/Type /Page", "/Title (a)", "()", "y" * 1990, "/Type  \n /Page\n"]
    data = {f"f{i}.pdf": ("%PDF" + "".join(random.choices(bits, k=random.randrange(1, 60)))).encode() for i in range(30)}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    rows = [(n, n, "pdf", len(x)) for n, x in data.items()]
    files = spark.createDataFrame(rows, "record_id string, relative_path string, extension string, byte_length long").withColumns({"modified_at": F.lit(None).cast("timestamp"), "device_id": F.lit(None).cast("string"), "filesystem_record_id": F.lit(None).cast("string")})
    got = {r["record_id"]: (r["read_state"], r["pages"], r["title"], r["bytes_read"]) for r in contents.ranged_facts(files, str(tmp_path), 2, whole=True, step=step).collect()}
    title = lambda x: (m := re.search(rb"/Title\s*\(([^)]{0,2000})\)", x)) and m[1].decode() or None
    assert got == {n: ("verified", len(re.findall(rb"/Type\s*/Page\b", x)) or None, title(x), len(x)) for n, x in data.items()}
