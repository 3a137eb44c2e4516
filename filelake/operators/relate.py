"""Semantic groups: projects, camera pairs, albums, and the edges between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, stem
from ..functions.scalars import stable_id

# Names and extensions that tell projects and pairs.
MANIFESTS = "package.json pyproject.toml cargo.toml go.mod pom.xml build.gradle build.gradle.kts composer.json gemfile".split()
SIGNALS = [*MANIFESTS, "readme", "readme.md", "readme.txt", ".git", "src"]
BESIDE = [".git", "src", "readme", "readme.md", "readme.txt"]
RAW = "raw dng cr2 nef arw orf rw2".split()
RENDERED = "jpg jpeg heic heif tif tiff png".split()
SIDECARS = "xmp aae".split()


def project_signals(files: DataFrame) -> DataFrame:
    return files.where("observation_status = 'observed'").where(F.lower("name").isin(SIGNALS))


def project_groups(files: DataFrame) -> DataFrame:
    """group_id, scan_id, root_id, relative_root, display_name, manifest, signals, confidence; one per folder
    with a manifest. Of several the last by path is named; signals are it and its neighbours."""
    s = project_signals(files).withColumn("_n", F.lower("name"))
    is_m = F.col("_n").isin(MANIFESTS)
    g = s.groupBy("scan_id", "root_id", F.col("parent_path").alias("relative_root")).agg(
        F.max(F.when(is_m, F.struct("relative_path", "name"))).alias("m"),
        F.collect_set(F.when(F.col("_n").isin(BESIDE), F.col("_n"))).alias("beside"),
    )
    g = g.where("m is not null").withColumn("signals", F.array_sort(F.array_union("beside", F.array(F.lower("m.name")))))
    g = g.withColumn("confidence", F.least(F.lit(0.99), F.round(0.84 + F.size("signals") * 0.03, 2)))
    name = F.coalesce(F.nullif(basename(F.col("relative_root")), F.lit("")), F.lit("Library project"))
    return g.select(stable_id("project", F.col("scan_id"), F.col("root_id"), F.col("relative_root")).alias("group_id"), "scan_id", "root_id", "relative_root", name.alias("display_name"), F.col("m.name").alias("manifest"), "signals", "confidence")


def prefix_members(files: DataFrame, roots: DataFrame) -> DataFrame:
    """group_id, record_id: files in or under each root's folder. Folders, not files, are joined by their
    ancestors, then expanded; nested roots overlap."""
    f = files.where("observation_status = 'observed' and entry_type = 'file'")
    folders = f.select("scan_id", "root_id", "parent_path").distinct()
    up = folders.withColumn("relative_root", F.explode(F.when(F.col("parent_path") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("parent_path"), own=True))))
    hit = up.join(roots.select("group_id", "scan_id", "root_id", "relative_root"), ["scan_id", "root_id", "relative_root"]).select("scan_id", "root_id", "parent_path", "group_id")
    return f.select("scan_id", "root_id", "parent_path", "record_id").join(hit, ["scan_id", "root_id", "parent_path"]).select("group_id", "record_id")


def media_pairs(files: DataFrame) -> DataFrame:
    """source_id (RAW), target_id, relationship for files of one folder and stem."""
    f = files.where("observation_status = 'observed' and entry_type = 'file'").select("scan_id", "root_id", "parent_path", F.lower(stem(F.col("name"))).alias("stem"), "record_id", F.lower("extension").alias("ext"))
    on = ["scan_id", "root_id", "parent_path", "stem"]
    raw = f.where(F.col("ext").isin(RAW)).select(*on, F.col("record_id").alias("source_id"))
    other = f.where(F.col("ext").isin(RENDERED + SIDECARS)).select(*on, F.col("record_id").alias("target_id"), F.when(F.col("ext").isin(SIDECARS), "sidecar-of").otherwise("derived-version").alias("relationship"))
    pairs = raw.join(other, on).where("source_id <> target_id")
    return pairs.select(stable_id("media-pair", F.col("scan_id"), F.col("source_id"), F.col("target_id")).alias("group_id"), "scan_id", "root_id", "parent_path", "source_id", "target_id", "relationship", F.lit(0.94).alias("confidence"))


def relationship_edges(pairs: DataFrame) -> DataFrame:
    """from_id -> to_id: rendered or sidecar to its RAW."""
    return pairs.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), F.col("relationship").alias("kind"), "confidence")


def album_candidates(understanding: DataFrame) -> DataFrame:
    """Folders with two or more audio files and artwork, by one aggregation."""
    g = understanding.groupBy("scan_id", "root_id", "parent_path").agg(F.count_if(F.col("category") == "Audio").alias("tracks"), F.count_if(F.col("category") == "Images").alias("artwork"), F.count("*").alias("members"))
    return g.where("tracks >= 2 and artwork >= 1")


def album_groups(understanding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): all files of an album folder belong to it."""
    g = album_candidates(understanding).withColumns({"group_id": stable_id("album", F.col("scan_id"), F.col("root_id"), F.col("parent_path")), "confidence": F.lit(0.9)})
    return g, understanding.select("scan_id", "root_id", "parent_path", "record_id").join(g.select("scan_id", "root_id", "parent_path", "group_id", "confidence"), ["scan_id", "root_id", "parent_path"]).select("group_id", "record_id", "confidence")


def groups_for_records(records: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id with its groups as an ordered list of (kind, group_id)."""
    named = members.join(groups.select("group_id", "kind"), "group_id").join(records.select("record_id"), "record_id", "left_semi")
    return named.groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("kind", "group_id"))).alias("groups"))


def all_groups(projects: DataFrame, pairs: DataFrame, albums: DataFrame) -> DataFrame:
    """group_id, kind, scan_id, root_id, confidence of project, media pair and album groups, in one table."""
    out = None
    for kind, df in (("project", projects), ("media-pair", pairs), ("album", albums)):
        own = df.select("group_id", F.lit(kind).alias("kind"), "scan_id", "root_id", "confidence")
        out = own if out is None else out.unionByName(own)
    return out


def list_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    return groups.join(members.groupBy("group_id").agg(F.count("*").alias("members")), "group_id", "left").na.fill(0, ["members"])
