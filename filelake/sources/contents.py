"""Contents of files that executors open themselves: hashed by chunks, or read by ranges, never as a whole column.

Files lie below a root folder that all executors see. A path is opened only if it stays below the root and is a
regular file, not a link. What was observed of a file is compared with what it is before and after it is read.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes read at a time; bytes at the start that tell a type; the window of a PDF at either end; the end of a ZIP.
CHUNK, SIGNATURE, WINDOW, ZIP_END = 4 << 20, 560, 2 << 20, 66_000
_OBSERVED = ["byte_length", "modified_at", "device_id", "filesystem_record_id"]
_ROWS = 64


class Refused(Exception):
    """A file that is not read; its argument is the state to tell."""


def opened(root: str, path: str | None) -> int:
    """A descriptor of a regular file below root."""
    parts = (path or "").split("/")
    if not path or "\0" in path or any(p in ("", ".", "..") for p in parts):
        raise Refused("unsafe")
    top = os.path.realpath(root)
    folder = os.path.realpath(os.path.join(top, *parts[:-1]))
    if folder != top and not folder.startswith(top.rstrip("/") + "/"):
        raise Refused("unsafe")
    try:
        found = os.open(os.path.join(folder, parts[-1]), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except FileNotFoundError:
        raise Refused("vanished") from None
    except OSError as e:
        link = os.path.islink(os.path.join(folder, parts[-1]))
        raise Refused("unsafe" if link else "inaccessible") from e
    if not stat.S_ISREG(os.fstat(found).st_mode):
        os.close(found)
        raise Refused("unsafe")
    return found


def same_file(now: os.stat_result, row: dict) -> bool:
    """Whether a file is as it was observed; what the observation lacks is not compared, times to two microseconds."""
    then = row["modified_at"]
    seen = [(row["byte_length"], now.st_size), (row["device_id"], str(now.st_dev)), (row["filesystem_record_id"], str(now.st_ino))]
    return all(a is None or a == b for a, b in seen) and (then is None or abs(then - now.st_mtime_ns // 1000) <= 2)


def _unchanged(a: os.stat_result, b: os.stat_result) -> bool:
    return (a.st_size, a.st_mtime_ns, a.st_ctime_ns, a.st_ino) == (b.st_size, b.st_mtime_ns, b.st_ctime_ns, b.st_ino)


def _steadily(root: str, row: dict, read: Callable[[int, int], tuple]) -> tuple:
    """(state, what read(descriptor, size) gives); read only if the file is as observed, given only if it stays so."""
    try:
        fd = opened(root, row["relative_path"])
    except Refused as e:
        return str(e), None
    try:
        before = os.fstat(fd)
        if not same_file(before, row):
            return "unstable", None
        got = read(fd, before.st_size)
        return ("verified", got) if _unchanged(before, os.fstat(fd)) else ("unstable", None)
    except OSError:
        return "inaccessible", None
    finally:
        os.close(fd)


def _digest(chunk: int) -> Callable[[int, int], tuple]:
    def read(fd: int, size: int) -> tuple:
        h, at = hashlib.sha256(), 0
        while at < size and (data := os.pread(fd, min(chunk, size - at), at)):
            h.update(data)
            at += len(data)
        if at < size:
            raise OSError("the file ended early")
        return h.hexdigest(), at

    return read


def _observations(files: DataFrame, tasks: int | None) -> DataFrame:
    """What tasks need of files, dealt by a hash of the path. Rows are a few bytes and files may be many, so the number
    of tasks is given and not left to the size of the rows."""
    micros = F.unix_micros("modified_at").alias("modified_at")
    rows = files.select("record_id", "relative_path", *[micros if c == "modified_at" else F.col(c) for c in _OBSERVED])
    return rows.repartition(tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relative_path")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS).to_pylist()


def hash_files(files: DataFrame, root: str, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """record_id, digest (sha256, hex), hash_state, bytes_read of files below root (record_id, relative_path and what
    was observed: byte_length, modified_at, device_id, filesystem_record_id).

    A file is read by chunks, so its length does not matter. hash_state is verified, or, without a digest: unstable (not
    as observed, or changed meanwhile), vanished, unsafe (a path that leaves the root, a link, no regular file) or
    inaccessible. Rows are dealt over `tasks` (the session's shuffle partitions, if not given) by a hash of the path, so a
    folder of large files is no task of its own."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches):
            out = [(r["record_id"], *_steadily(root, r, _digest(chunk))) for r in rows]
            columns = [[i for i, _, _ in out], [g and g[0] for _, _, g in out], [s for _, s, _ in out], [g[1] if g else 0 for _, _, g in out]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "digest", "hash_state", "bytes_read"])

    return _observations(files, tasks).mapInArrow(run, "record_id string, digest string, hash_state string, bytes_read long")


def _windows(fd: int, size: int) -> tuple:
    head = os.pread(fd, SIGNATURE, 0)
    rest, tail, count = b"", b"", len(head)
    if head[:4] == b"%PDF":
        head = os.pread(fd, WINDOW, 0)
        end = max(0, min(WINDOW, size - WINDOW))
        rest = os.pread(fd, end, size - end)
        count = len(head) + len(rest)
    elif head[:2] == b"PK":
        tail = os.pread(fd, ZIP_END, max(0, size - ZIP_END))
        count += len(tail)
    return head, rest, tail, size, count


#: The end of a text within which a page or a title may have begun that goes on behind it.
_OPEN = re.compile(rb"/(?:T(?:y(?:p(?:e(?:\s*(?:/(?:P(?:a(?:ge?)?)?)?)?)?)?)?|i(?:t(?:l(?:e(?:\s*(?:\([^)]{0,2000})?)?)?)?)?)?)?\Z")
#: White space that no title holds: a longer run may stand before a page or a title's bracket, at any length.
_GAP = re.compile(rb"(\s{2001})\s+")


def _pdf_parts(fd: int, size: int, step: int) -> Iterator[tuple]:
    """A PDF's text in parts like _windows() gives them, cut where no page and no title is cut."""
    at, text = 0, b""
    while at < size:
        data = os.pread(fd, min(step, size - at), at)
        if not data:
            raise OSError("the file ended early")
        at, text = at + len(data), text + data
        cut = len(text) if at == size or not (found := _OPEN.search(text)) else found.start()
        yield text[:cut], b"", b"", size, len(data)
        text = _GAP.sub(rb"\1", text[cut:])


def _by_parts(root: str, row: dict, step: int) -> Iterator[tuple]:
    """(state, window) as _steadily() gives them, a PDF's as parts without a state and a last row with it."""
    try:
        fd = opened(root, row["relative_path"])
    except Refused as e:
        yield str(e), None
        return
    try:
        before = os.fstat(fd)
        if not same_file(before, row):
            yield "unstable", None
            return
        if os.pread(fd, 4, 0) == b"%PDF":
            for part in _pdf_parts(fd, before.st_size, step):
                yield None, part
            got = (b"", b"", b"", before.st_size, 0)
        else:
            got = _windows(fd, before.st_size)
        yield ("verified", got) if _unchanged(before, os.fstat(fd)) else ("unstable", None)
    except OSError:
        yield "inaccessible", None
    finally:
        os.close(fd)


def content_windows(files: DataFrame, root: str, tasks: int | None = None, whole: bool = False, step: int = WINDOW) -> DataFrame:
    """record_id, read_state, head, rest, tail, size, bytes_read, part: of each file only the bytes that facts need. head is
    the first SIGNATURE bytes, or a PDF's first WINDOW, rest the last WINDOW of a PDF as far as head ends before it,
    tail the last ZIP_END bytes of a ZIP. States are those of hash_files().

    whole: a PDF is read to its end, `step` bytes at a time. It has a row for each part (from 0), whose text is head, and the last
    row alone has a state. No page or title is cut by parts."""
    ship(files.sparkSession)
    schema = pa.schema([("record_id", pa.string()), ("read_state", pa.string()), ("head", pa.binary()), ("rest", pa.binary()), ("tail", pa.binary()), ("size", pa.int64()), ("bytes_read", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches):
            for r in rows:  # a row may hold two windows: one at a time
                for part, (state, got) in enumerate(_by_parts(root, r, step) if whole else [_steadily(root, r, _windows)]):
                    row = (r["record_id"], state, *(got or (None, None, None, None, 0)), part)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return _observations(files, tasks).mapInArrow(run, "record_id string, read_state string, head binary, rest binary, tail binary, size long, bytes_read long, part long")


def ranged_facts(files: DataFrame, root: str, tasks: int | None = None, whole: bool = False, step: int = WINDOW) -> DataFrame:
    """record_id, read_state, mime_type, type_source, width, height, pages, title, entries, bytes_read: as
    facts.extract_facts() tells them of whole contents, from windows alone.

    whole: pages and title of a PDF are those of all its text, not of its windows (see content_windows()); a record_id is one file's."""
    from ..operators.facts import archive_end, image_size, pdf_text_facts, sniff_type

    w = content_windows(files, root, tasks, whole, step).join(files.select("record_id", "extension"), "record_id")
    kind, size = sniff_type(F.col("head"), F.col("extension")), image_size(F.col("head"))
    latin = lambda c: F.decode(F.col(c), "ISO-8859-1")
    w = w.withColumns({"mime_type": kind["mime_type"], "type_source": kind["source"], "width": size["width"], "height": size["height"], "text": F.concat(latin("head"), latin("rest"))})
    pdf = pdf_text_facts(F.col("text"))
    w = w.withColumns({"pages": pdf["pages"], "title": pdf["title"], "entries": archive_end(F.col("tail"))["entries"]})
    if whole:
        # The first title counts, as in a text of one part, be it empty.
        titled = F.when(F.col("text").rlike(r"/Title\s*\([^)]{0,2000}\)"), F.col("part"))
        of_first = [F.min_by(c, "part").alias(c) for c in ("mime_type", "type_source", "width", "height", "entries")]
        w = w.groupBy("record_id").agg(F.max_by("read_state", "part").alias("read_state"), *of_first, F.sum("pages").alias("pages"), F.min_by("title", titled).alias("title"), F.sum("bytes_read").alias("bytes_read"))
        w = w.withColumns({"pages": F.col("pages").cast("int"), "bytes_read": F.when(F.col("read_state") == "verified", F.col("bytes_read")).otherwise(F.lit(0))})
    read = F.col("read_state") == "verified"
    of = lambda mime, c: F.when(F.col("mime_type") == mime, F.col(c))
    shown = {"mime_type": F.col("mime_type"), "type_source": F.col("type_source"), "width": F.col("width"), "height": F.col("height"), "pages": of("application/pdf", "pages"), "title": of("application/pdf", "title"), "entries": of("application/zip", "entries")}
    told: list[Column] = [F.when(read, c).alias(name) for name, c in shown.items()]
    return w.select("record_id", "read_state", *told, "bytes_read")
