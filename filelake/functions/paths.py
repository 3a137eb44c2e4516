"""Path functions (columns in, column out). Paths are relative and use '/'; '\\' counts as '/' where said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def trimmed(path: Column) -> Column:
    """Without a leading './' and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(slashed(path), r"^\./", ""), r"/+$", "")


def parent_path(path: Column) -> Column:
    """'' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(slashed(path), r"/+$", ""), "/"), -1)


def stem(path: Column) -> Column:
    """Basename without extension; a dot at the very start or none keeps the name."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    """Case is kept; null for '.bashrc', 'a.' and names without a dot."""
    return F.nullif(F.regexp_extract(name, r"^.+\.([^.]+)$", 1), F.lit(""))


def ingest_extension(name: Column) -> Column:
    return F.lower(extension(name))


def split_filename(path: Column) -> Column:
    """Struct of stem (with directory) and extension (with its dot, or '')."""
    dotted = path.rlike(r"\.[^./]*$")
    return F.struct(F.when(dotted, F.regexp_extract(path, r"^(.*)\.[^./]*$", 1)).otherwise(path).alias("stem"), F.when(dotted, F.regexp_extract(path, r"(\.[^./]*)$", 1)).otherwise("").alias("extension"))


def path_key(path: Column, platform: str = "posix") -> Column:
    return F.lower(slashed(path)) if platform == "win32" else slashed(path)


def is_within(candidate: Column, parent: Column, platform: str = "posix") -> Column:
    c, p = path_key(trimmed(candidate), platform), path_key(trimmed(parent), platform)
    return (c == p) | F.startswith(c, F.concat(p, F.lit("/")))


def contains(root: Column, path: Column, platform: str = "posix") -> Column:
    """Lexical containment, a root holding itself; '' is the root of all."""
    return (trimmed(root) == "") | is_within(path, root, platform)


def has_parent(path: Column) -> Column:
    return F.contains(slashed(path), F.lit("/"))


def ancestors(path: Column, own: bool = False) -> Column:
    """All directories above a path, '' first; with own, the path itself last."""
    parts = F.split(path, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    up = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), up)


def relative_path_error(path: Column, platform: str = "posix") -> Column:
    """Why a relative path is refused, or null."""
    parts = F.split(path, r"[\\/]+")
    out = F.when((path == "") | F.contains(path, F.lit(NUL)), "empty-or-null-byte")
    out = out.when(path.rlike(r"^[\\/]|^[A-Za-z]:") if platform == "win32" else F.startswith(path, F.lit("/")), "absolute")
    out = out.when(F.array_contains(parts, ".."), "traversal")
    if platform == "win32":
        out = out.when(F.contains(path, F.lit(":")), "drive-or-stream").when(F.exists(parts, lambda p: p.rlike(r"[. ]$")), "trailing-dot-or-space")
    return out.when(path.rlike(r"^(\./*)+$"), "root-itself")


def portable_target(path: Column, control: str = ".catalogue") -> Column:
    """Struct of path, normalised, and error (one of the two is null)."""
    p = trimmed(F.trim(path))
    parts = F.split(p, "/")
    error = (
        F.when(F.contains(p, F.lit(NUL)), "null-byte")
        .when(F.startswith(p, F.lit("/")) | p.rlike(r"^[A-Za-z]:"), "absolute")
        .when((p == "") | F.array_contains(parts, ""), "empty-segment")
        .when(F.array_contains(parts, ".."), "traversal")
        .when(F.array_contains(parts, "."), "dot-segment")
        .when(is_within(p, F.lit(control)), "control-directory")
    )
    return F.struct(F.when(error.isNull(), p).alias("path"), error.alias("error"))


def safe_entry_name(name: Column) -> Column:
    return ~name.rlike(r"[/\\\x00]") & ~name.isin("", ".", "..")


def encode_unsafe_name(name: Column) -> Column:
    """base64url without padding."""
    return F.translate(F.rtrim(F.base64(F.encode(name, "UTF-8")), F.lit("=")), "+/", "-_")


def safe_filename(name: Column) -> Column:
    """For quarantine: control characters and marks that file systems refuse become '_'; never empty."""
    cut = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f<>:\"/\\|?*]", "_"), r"[. ]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("file"))


def hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def read_only(mode: Column) -> Column:
    """No write bit for owner, group or others (octal 222)."""
    return mode.bitwiseAND(F.lit(146)) == 0
