"""Facts from file contents. Fixed-offset facts are expressions; chunk and segment walks run as one mapInArrow job."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_number, head, rational_number, tail, uint_be, uint_le
from ..session import ship

# Type by extension where no signature tells.
EXTENSION_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif",
    "mp4": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "mp3": "audio/mpeg", "flac": "audio/flac", "wav": "audio/wav",
    "pdf": "application/pdf", "zip": "application/zip", "json": "application/json", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv",
}


def sniff_type(content: Column, extension: Column) -> Column:
    """Struct of mime_type and source (signature or extension). The head is cut out and turned to hex once: it is
    bound as a lambda's argument, so generated code does not repeat it for each signature."""
    seen = F.struct(F.hex(head(content, 12)).alias("h"), F.hex(F.substring(content, 258, 5)).alias("tar"), F.lower(extension).alias("ext"))
    return F.get(F.transform(F.array(seen), _sniffed), F.lit(0))


def _sniffed(x: Column) -> Column:
    h = x["h"]
    starts = lambda *p: h.rlike("^(?:" + "|".join(p) + ")")
    found = (
        F.when(starts("89504E470D0A1A0A"), "image/png")
        .when(starts("FFD8FF"), "image/jpeg")
        .when(starts("47494638"), "image/gif")
        .when(starts("52494646.{8}57454250"), "image/webp")
        .when(starts("52494646.{8}57415645"), "audio/wav")
        .when(starts("25504446"), "application/pdf")
        .when(starts("504B03", "504B05", "504B07"), "application/zip")
        .when(starts("377ABCAF271C"), "application/x-7z-compressed")
        .when(starts("1F8B"), "application/gzip")
        .when(starts("494433"), "audio/mpeg")
        .when(x["tar"] == "7573746172", "application/x-tar")
    )
    table = F.create_map(*[F.lit(x) for k, v in EXTENSION_TYPES.items() for x in (k, v)])
    by_ext = F.coalesce(F.try_element_at(table, x["ext"]), F.lit("application/octet-stream"))
    return F.struct(F.coalesce(found, by_ext).alias("mime_type"), F.when(found.isNotNull(), "signature").otherwise("extension").alias("source"))


def image_size(content: Column) -> Column:
    """Struct of width and height of PNG, GIF, BMP and extended WebP; null for others."""
    h = F.hex(head(content, 16))
    of = lambda w, t: F.struct(w.alias("width"), t.alias("height"))
    signed = lambda x: F.abs(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), of(uint_be(content, 16, 4), uint_be(content, 20, 4)))
        .when(F.startswith(h, F.lit("47494638")), of(uint_le(content, 6, 2), uint_le(content, 8, 2)))
        .when(F.startswith(h, F.lit("424D")), of(signed(uint_le(content, 18, 4)), signed(uint_le(content, 22, 4))))
        .when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 16) == "5745425056503858"), of(uint_le(content, 24, 3) + 1, uint_le(content, 27, 3) + 1))
    )


WINDOW = 2 * 1024 * 1024


def pdf_facts(content: Column) -> Column:
    """Struct of pages, title, author, created, modified, over the first and last 2 MiB, not counted twice."""
    n = F.octet_length(content)
    rest = F.greatest(F.lit(0), F.least(F.lit(WINDOW), n - WINDOW))
    return pdf_text_facts(F.concat(F.decode(head(content, WINDOW), "ISO-8859-1"), F.when(rest > 0, F.decode(F.substr(content, n - rest + 1, rest), "ISO-8859-1")).otherwise("")))


def pdf_text_facts(text: Column) -> Column:
    """As pdf_facts(), from the windows' bytes as Latin-1. Values of over 2,000 characters are null."""
    value = lambda k: F.nullif(F.regexp_extract(text, rf"/{k}\s*\(([^)]{{0,2000}})\)", 1), F.lit(""))
    pages = F.nullif(F.regexp_count(text, F.lit(r"/Type\s*/Page\b")), F.lit(0))
    return F.struct(pages.alias("pages"), value("Title").alias("title"), value("Author").alias("author"), value("CreationDate").alias("created"), value("ModDate").alias("modified"))


def document_facts(extension: Column) -> Column:
    return F.struct(F.upper(extension).alias("format"), F.lit("container-only").alias("inspection"))


def archive_facts(content: Column, extension: Column) -> Column:
    """Struct of archive_type, entries, directory_bytes, spanned; ZIPs by their end record."""
    end = archive_end(tail(content, 66_000))
    kind = F.element_at(F.split(sniff_type(content, extension)["mime_type"], "/"), -1)
    return F.struct(F.when(end.isNotNull(), "zip").otherwise(kind).alias("archive_type"), end["entries"].alias("entries"), end["directory_bytes"].alias("directory_bytes"), end["spanned"].alias("spanned"))


def archive_end(last: Column) -> Column:
    """Struct of entries, directory_bytes, spanned by the end record in a ZIP's last bytes; null without one."""
    hexed = F.hex(last)
    after = F.substring_index(hexed, "504B0506", -1)
    at = F.length(hexed) - F.length(after) - 8
    found = (F.instr(hexed, "504B0506") > 0) & (at % 2 == 0) & (F.length(after) >= 36)
    le = lambda i, n: F.conv(F.concat(*[F.substring(after, 2 * (i + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")
    return F.when(found, F.struct(le(6, 2).alias("entries"), le(8, 4).alias("directory_bytes"), (le(0, 2) != 0).alias("spanned")))


def normalize_probe(probe: Column) -> Column:
    """Struct of container, duration, video size, frame rate and audio channels from a media probe's JSON."""
    p = F.from_json(probe, "format struct<format_name:string,duration:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,channels:int>>")
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    return F.struct(p["format"]["format_name"].alias("container"), finite_number(p["format"]["duration"]).alias("duration"), v["codec_name"].alias("video_codec"), v["width"].alias("width"), v["height"].alias("height"), F.round(rational_number(v["avg_frame_rate"]), 2).alias("frame_rate"), a["codec_name"].alias("audio_codec"), a["channels"].alias("channels"))


# The TIFF tags that are read.
_TAGS = {0x0112: "orientation", 0x010F: "make", 0x0110: "model", 0x9003: "capture_date", 0x9004: "digitized", 0x0132: "changed", 0x0100: "width", 0x0101: "height"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
#: Directories that a tag leads to.
_EXIF_AT, _GPS_AT = 0x8769, 0x8825
#: JPEG markers with the frame's size.
_FRAMES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})


def tiff(data: bytes) -> dict:
    """Tags of the first directory and of the EXIF and GPS directories it names. The date of capture falls back to
    that of digitizing, then to that of the last change."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    out: dict = {}
    place: dict = {}

    def rationals(where: int, count: int) -> list[float]:
        """At most three, which is all that a place needs: a tag's count may say anything."""
        count = min(count, 3)
        pairs = struct.unpack_from(order + "II" * count, data, where)
        return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]

    def directory(at: int, depth: int = 0, gps: bool = False) -> None:
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            where = at + 10 + 12 * i
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}.get(kind, 1) * count
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if gps:
                if tag in _GPS:
                    place[_GPS[tag]] = rationals(where, count) if kind == 5 else data[where] if kind == 1 else data[where : where + 1].decode("latin-1")
            elif tag in (_EXIF_AT, _GPS_AT) and depth == 0:
                directory(struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0], 1, tag == _GPS_AT)
            elif tag in _TAGS:
                if kind == 2:
                    out[_TAGS[tag]] = data[where : where + count].split(b"\0")[0].decode("latin-1").strip()
                elif kind in (3, 4):
                    (out[_TAGS[tag]],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, where)

    directory(struct.unpack_from(order + "I", data, 4)[0])
    later = out.pop("digitized", None) or out.get("changed")
    out.pop("changed", None)
    if later and "capture_date" not in out:
        out["capture_date"] = later
    for key, name in (("lat", "latitude"), ("lon", "longitude")):
        if len(place.get(key, ())) == 3:
            d, m, s = place[key]
            out[name] = (d + m / 60 + s / 3600) * (-1.0 if place.get(key + "_ref", "").upper() in ("S", "W") else 1.0)
    if place.get("alt"):
        out["altitude"] = place["alt"][0] * (-1.0 if place.get("alt_ref") == 1 else 1.0)
    return out


def jpeg(data: bytes) -> dict:
    """Size from the frame header and the tags of the EXIF segment; a broken segment leaves the rest."""
    out, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark in _FRAMES:
            out["height"], out["width"] = struct.unpack_from(">HH", data, at + 5)
        elif mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                out |= {k: v for k, v in tiff(data[at + 10 : at + 2 + size]).items() if k not in ("width", "height")}
            except (struct.error, KeyError, IndexError) as e:
                out["exif_error"] = f"{type(e).__name__}: {e}"[:200]
        elif mark == 0xDA:
            break
        at += 2 + max(2, size)
    return out


def wave(data: bytes) -> dict:
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            _, out["channels"], out["rate"], per_second, _, out["bits"] = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and out.get("rate"):
            out["duration"] = size / per_second
            break
        at += 8 + size + size % 2
    return out


def id3(data: bytes) -> dict:
    """Text frames of an ID3v2.3 or 2.4 tag."""
    names, out, at = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TRCK": "track", b"TYER": "date", b"TDRC": "date"}, {}, 10
    end = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    while at + 10 <= min(end, len(data)) and data[at]:
        raw = data[at + 4 : at + 8]
        size = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] >= 4 else int.from_bytes(raw, "big")
        if data[at : at + 4] in names and size:
            body = data[at + 11 : at + 10 + size]
            text = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}[data[at + 10]]
            out[names[data[at : at + 4]]] = body.decode(text, "replace").rstrip("\0")
        at += 10 + size
    return out


def parser_of(data: bytes) -> Callable[[bytes], dict] | None:
    """What can walk such contents."""
    if data[:3] == b"\xff\xd8\xff":
        return jpeg
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return wave
    return id3 if data[:3] == b"ID3" else None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        facts, status, message = [], [], []
        for data in batch.column(1).to_pylist():
            data = data or b""
            parse = parser_of(data)
            try:
                facts.append([(k, str(v)) for k, v in (parse(data) if parse else {}).items()])
                status.append("completed" if parse else "unavailable")
                message.append(None)
            except Exception as e:  # noqa: BLE001 - one bad file must not fail the others
                facts.append([])
                status.append("failed")
                message.append(f"{type(e).__name__}: {e}"[:200])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(facts, pa.map_(pa.string(), pa.string())), pa.array(status), pa.array(message, pa.string())], names=["record_id", "facts", "status", "message"])


def walked_facts(files: DataFrame) -> DataFrame:
    """record_id, facts, status (completed, unavailable, failed), message from segment and chunk walks."""
    ship(files.sparkSession)
    return files.select("record_id", "content").mapInArrow(_walk, "record_id string, facts map<string,string>, status string, message string")


def fact_tasks(files: DataFrame) -> DataFrame:
    return files.where("observation_status = 'observed' and entry_type = 'file' and byte_length is not null")


def reuse_facts(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """tasks (record_id, root_id, signature, analyzer, version) with facts: of the same record, else the newest
    of the root with the same signature; null where neither is."""
    on = ["analyzer", "version", "signature"]
    own = prior.groupBy("record_id", *on).agg(F.max(F.struct("analyzed_at", "facts_json"))["facts_json"].alias("f1"))
    near = prior.groupBy("root_id", *on).agg(F.max(F.struct("analyzed_at", "record_id", "facts_json"))["facts_json"].alias("f2"))
    out = tasks.join(own, ["record_id", *on], "left").join(near, ["root_id", *on], "left")
    return out.withColumns({"facts_json": F.coalesce("f1", "f2"), "reused": F.coalesce("f1", "f2").isNotNull()}).drop("f1", "f2")


_WALKED = "facts map<string,string>, status string, message string"


def extract_facts(files: DataFrame) -> DataFrame:
    """record_id, mime_type, type_source, width, height, pages, archive entries and the walked facts. Contents are
    read once: the walk runs beside the columns, and no join brings it back."""
    c, e = F.col("content"), F.col("extension")
    kind, size = sniff_type(c, e), image_size(c)
    native = files.select("record_id", "content", kind["mime_type"].alias("mime_type"), kind["source"].alias("type_source"), size["width"].alias("width"), size["height"].alias("height"), F.when(kind["mime_type"] == "application/pdf", pdf_facts(c)["pages"]).alias("pages"), F.when(kind["mime_type"] == "application/zip", archive_facts(c, e)["entries"]).alias("entries"))
    ship(files.sparkSession)
    rest = [f for f in native.schema.fields if f.name not in ("record_id", "content")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walked = next(_walk(iter([batch.select([0, 1])])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *walked.columns[1:]], names=["record_id", *[f.name for f in rest], *walked.schema.names[1:]])

    return native.mapInArrow(run, f"record_id string, {ddl}, {_WALKED}")


def assemble_facts(facts: DataFrame) -> DataFrame:
    """record_id, captured_at, duration, width, height: an image's own facts before a probe's, a probe's
    duration before an audio file's. facts: record_id, analyzer, facts (map)."""
    by = {a: F.max_by("facts", F.when(F.col("analyzer") == a, F.lit(1))) for a in ("image-metadata", "media-probe", "audio-tags")}
    g = facts.groupBy("record_id").agg(*[v.alias(k.replace("-", "_")) for k, v in by.items()])
    first = lambda key, *names: F.coalesce(*[F.try_element_at(F.col(n), F.lit(key)) for n in names])
    return g.select("record_id", first("capture_date", "image_metadata", "media_probe").alias("captured_at"), first("duration", "media_probe", "audio_tags").try_cast("double").alias("duration"), first("width", "image_metadata", "media_probe").try_cast("int").alias("width"), first("height", "image_metadata", "media_probe").try_cast("int").alias("height"))
