"""Identity, date, number, JSON and byte functions (columns in, column out)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

NUL = "\0"


def _joined(*parts: Column, trailing: bool) -> Column:
    pieces = []
    for i, p in enumerate(parts):
        pieces += [F.coalesce(p.cast("string"), F.lit(""))] + ([F.lit(NUL)] if trailing or i < len(parts) - 1 else [])
    return F.concat(*pieces)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256(prefix NUL part NUL ... NUL); null counts as ''."""
    return F.concat(F.lit(prefix + ":"), F.sha2(_joined(F.lit(prefix), *parts, trailing=True), 256))


def record_id(tag: str, scan: Column, path: Column, status: Column, issue: Column) -> Column:
    return F.concat(F.lit("inv:"), F.sha2(_joined(F.lit(tag), scan, path, status, issue, trailing=False), 256))


def observation_signature(length: Column, modified: Column, device: Column, inode: Column) -> Column:
    return F.sha2(_joined(length, modified, device, inode, trailing=False), 256)


def root_identity(volume_key: Column, path: Column) -> Column:
    return F.sha2(_joined(F.lit("root-identity"), volume_key, path, trailing=False), 256)


def volume_key(device: Column, fs_type: Column) -> Column:
    return F.concat_ws(":", fs_type, device)


#: Magic numbers of file systems.
FILE_SYSTEMS = {0xEF53: "ext", 0x6969: "nfs", 0x9123683E: "btrfs", 0x58465342: "xfs", 0x01021994: "tmpfs", 0x4D44: "fat", 0x5346544E: "ntfs", 0x2FC12FC1: "zfs", 0xFF534D42: "cifs", 0x794C7630: "overlay"}


def file_system_name(magic: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in FILE_SYSTEMS.items() for x in (int(k), v)])
    return F.coalesce(F.try_element_at(table, magic.cast("long")), F.lit("unknown"))


def usable_date(text: Column) -> Column:
    return F.try_to_timestamp(text)


def year_bucket(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy"), F.lit("Unknown year"))


def month_bucket(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MM"), F.lit("Unknown month"))


def normalize_exif_date(text: Column) -> Column:
    """'2024:07:04 12:34:56' as '2024-07-04T12:34:56'."""
    return F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2}).*$", "$1-$2-$3T$4")


def reclaimable(copies: Column, length: Column) -> Column:
    """(n - 1) * length; overflow is an error under ANSI."""
    return (copies - 1).cast("long") * length.cast("long")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def percent(done: Column, total: Column, running: Column) -> Column:
    """Whole per cent; never 100 while running, 0 of nothing."""
    raw = F.coalesce(F.floor(F.try_divide(done * 100, total)), F.lit(0)).cast("long")
    return F.when(running, F.least(raw, F.lit(99))).otherwise(F.least(raw, F.lit(100)))


def rational_number(text: Column) -> Column:
    """'30000/1001' as a double; null on zero denominators and garbage."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(text.try_cast("double"))


def finite_number(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed decimal degrees; south and west are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)


def gps_altitude(metres: Column, ref: Column) -> Column:
    return metres * F.when(ref == 1, -1.0).otherwise(1.0)


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order, at every depth, without white space; null if it isn't JSON.
    A variant holds an object's fields by name, so writing it out again orders them; 1 and "1" stay apart."""
    return F.to_json(F.try_parse_json(text))


def json_object(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.expr("map()").cast("map<string,string>"))


def json_strings(text: Column) -> Column:
    """A JSON array of strings; [] on bad JSON."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def format_bytes(n: Column) -> Column:
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")])
    at = F.when(n < 1024, 0).otherwise(F.least(F.floor(F.log(2.0, n.cast("double")) / 10), F.lit(5)))
    scaled = n / F.pow(F.lit(1024.0), at)
    return F.concat(F.when(at == 0, n.cast("string")).otherwise(F.format_number(scaled, 1)), F.lit(" "), F.element_at(units, (at + 1).cast("int")))


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def short_id(x: Column) -> Column:
    return F.when(F.length(x) <= 16, x).otherwise(F.concat(F.substring(x, 1, 8), F.lit("…"), F.substring(x, -6, 6)))


#: Keys that say where something was, dropped at every depth.
PRIVATE_KEYS = ("gps", "latitude", "longitude", "location")


def _private(key: Column) -> Column:
    return F.lower(key).rlike("|".join(PRIVATE_KEYS))


def without_private(facts: Column) -> Column:
    """map<string, map<string,string>> without private keys at either depth."""
    return F.transform_values(F.map_filter(facts, lambda k, v: ~_private(k)), lambda k, v: F.map_filter(v, lambda a, b: ~_private(a)))


def _strip(value):
    if isinstance(value, dict):
        return {k: _strip(v) for k, v in value.items() if not any(p in k.lower() for p in PRIVATE_KEYS)}
    return [_strip(v) for v in value] if isinstance(value, list) else value


def _without_private(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(_strip(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def without_private_json(text: Column) -> Column:
    """JSON without private keys at any depth, keys in order; null if it isn't JSON. Depth has no bound, so this
    is a small function over Arrow batches."""
    ship(SparkSession.active())
    return F.pandas_udf(_without_private, "string")(text)


def invalid_fields(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (a rule that is null is broken)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def _hex_at(content: Column, offset: int, n: int) -> Column:
    return F.hex(F.substring(content, offset + 1, n))


def uint_be(content: Column, offset: int, n: int) -> Column:
    """Unsigned big-endian integer of n bytes; null past the end."""
    h = _hex_at(content, offset, n)
    return F.when(F.length(h) == 2 * n, F.conv(h, 16, 10).cast("long"))


def uint_le(content: Column, offset: int, n: int) -> Column:
    h = _hex_at(content, offset, n)
    turned = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(h, i * 2 + 1, F.lit(2)))), "")
    return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("long"))


def synchsafe(content: Column, offset: int) -> Column:
    b = [uint_be(content, offset + i, 1) for i in range(4)]
    return b[0] * (1 << 21) + b[1] * (1 << 14) + b[2] * (1 << 7) + b[3]


def head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def tail(content: Column, n: int) -> Column:
    return F.when(F.octet_length(content) <= n, content).otherwise(F.substring(content, -n, n))


def decode_text(content: Column) -> Column:
    """By byte order mark: UTF-16 either way, UTF-8, else Latin-1."""
    h = F.hex(F.substring(content, 1, 3))
    return (
        F.when(F.startswith(h, F.lit("FFFE")), F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
        .when(F.startswith(h, F.lit("FEFF")), F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
        .when(h == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def bounded_limit(n: int | None, default: int, cap: int) -> int:
    if n is not None and n < 1:
        raise ValueError("limit must be 1 or more")
    return min(n or default, cap)


def date_bound(text: str) -> Column:
    """A literal bound; a ValueError if it is no date."""
    from datetime import datetime

    return F.lit(datetime.fromisoformat(text.replace("Z", "+00:00")))
