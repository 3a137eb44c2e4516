"""WARC archives: writing captures as request, response (or revisit) and metadata records, reading them
back, and assembling the records of each capture by their concurrent-to identifiers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, prepare, shared_dir, written

#: Records of one archive file; together with the payloads it bounds what a reading task holds.
FILE_RECORDS = 3000
#: Payloads smaller than this are never written as revisits.
REVISIT_BYTES = 0
_DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " " and c != "\x7f") or "urn:none"


def _record(kind: str, record_id: str, url: str, body: bytes, **more: str) -> bytes:
    """One record but for its last line feed, which is the text sink's line separator."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": _DATE, "WARC-Target-URI": url, **more, "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r"


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        out = []
        for page, url, html, winner, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload, url = (html or "").encode(), _one_line(url)
            sha, host = digest(payload), urlsplit(url).netloc if "://" in url else ""
            name = _id("capture", page, url, sha)
            mark = None if page is None else str(page)
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
            first = {"WARC-Payload-Digest": f"sha1:{sha}", "X-Page-Id": mark}
            if winner is None or winner == page:
                main = _record("response", name, url, block + payload, **first, **{"Content-Type": "application/http; msgtype=response"})
            else:
                refers = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _id("capture", winner, _one_line(tie), sha), "X-Refers-To-Page": str(winner), "X-Payload-Length": str(len(payload))}
                main = _record("revisit", name, url, block, **first, **refers, **{"Content-Type": "application/http; msgtype=response"})
            asked = f"GET {url} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
            out += [_record("request", _id("request", name), url, asked, **{"WARC-Concurrent-To": name, "Content-Type": "application/http; msgtype=request"}), main, _record("metadata", _id("metadata", name), url, f"payload-bytes: {len(payload)}\r\n".encode(), **{"WARC-Concurrent-To": name, "Content-Type": "application/warc-fields"})]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as gzip-compressed WARC files under path.

    Of pages of equal payloads (of REVISIT_BYTES or more) the one of largest page_id is the response, the
    others are revisits that refer to it. Null html: an empty payload. A null page_id is never the largest;
    if all are null, all are responses. Rows that repeat the largest page_id are all responses."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    big = F.octet_length("html") >= REVISIT_BYTES
    # Payloads of one page need no winner: what is joined to the pages is small unless most pages repeat.
    win = rows.where(big).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    win = written(win.select("sha", F.col("top.page_id").alias("winner"), F.col("top.url").alias("tie")), "winners")
    marked = rows.join(win, "sha", "left").select("page_id", "url", "html", F.when(big, F.col("winner")).alias("winner"), "tie")
    records = marked.mapInArrow(_write, "value binary").select(F.col("value").cast("string"))
    records.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; blocks by Content-Length, so a payload may
    hold what looks like a record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, url string, date string, page_id long, refers_to_page long, payload_digest string, payload_bytes long, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        number = lambda x: None if x is None else int(x)
        for batch in bounded(batches, 1):  # a row is an archive
            for content in batch.column(0).to_pylist():
                rows, held = [], 0
                with gzip.open(io.BytesIO(content)) as stream:
                    for head, block in parse(stream):
                        kind = head.get("warc-type")
                        body = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
                        sha = size = None
                        if kind == "response":
                            sha, size = digest(body), len(body)
                        elif kind == "revisit":
                            sha, size = head["warc-payload-digest"].removeprefix("sha1:"), number(head.get("x-payload-length"))
                        rows.append((head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), number(head.get("x-page-id")), number(head.get("x-refers-to-page")), sha, size, body if with_payload else None))
                        held += len(body) if with_payload else 0
                        if len(rows) >= 512 or held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under path. A response's digest and length are taken from its block."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read(with_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: each response or revisit, with the request and the metadata that name it in
    WARC-Concurrent-To (of several the one of least identifier; their numbers are n_requests, n_metadata).
    The capture is nested: request, response (null for a revisit), revisit (null for a response) and metadata are
    structs beside the capture's own identifier. Records that name no capture, or lack their own identifier, are
    left out; a capture without the others has nulls and zeros; records that repeat an identifier are each a capture."""
    part = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "url", "date", "payload")))
    others = records.where("type in ('request', 'metadata') and concurrent_to is not null")
    others = others.groupBy("concurrent_to").agg(part("request").alias("request"), part("metadata").alias("metadata"), F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata"))
    body = F.struct("record_id", "url", "date", "refers_to", "refers_to_page", "payload_digest", "payload_bytes", "payload")
    main = records.where("type in ('response', 'revisit') and record_id is not null")
    main = main.select(F.col("record_id").alias("capture_id"), "page_id", "type", F.when(F.col("type") == "response", body).alias("response"), F.when(F.col("type") == "revisit", body).alias("revisit"))
    out = main.join(others, main["capture_id"] == others["concurrent_to"], "left").drop("concurrent_to")
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_requests", "n_metadata")})


def captures(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) into archives, read them back and assemble one nested row per capture:
    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response that a revisit
    repeats), then the capture's identifier, its request, response or revisit, and metadata records, and counts.

    Null html is an empty payload; null page_ids are captures of their own; of rows that repeat a page_id each is
    a capture; an empty table gives none. Other columns are not read. See write_archives() for ties."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/llm/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = written(read_archives(spark, path, with_payload=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))
    out = assemble(records)
    of = lambda name: F.coalesce(F.col(f"response.{name}"), F.col(f"revisit.{name}"))
    told = [of("payload_bytes").alias("payload_bytes"), of("payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("revisit.refers_to_page").alias("refers_to")]
    return out.select("page_id", *told, "capture_id", "request", "response", "revisit", "metadata", "n_requests", "n_metadata")
