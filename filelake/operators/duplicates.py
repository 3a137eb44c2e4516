"""Content identity and duplicates. Groups are header and member tables; pairs are never made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reclaimable, stable_id


def observed(files: DataFrame) -> DataFrame:
    return files.where("observation_status = 'observed' and entry_type = 'file'")


def _totals(groups: DataFrame) -> DataFrame:
    n, size = F.col("copies"), F.col("byte_length")
    return groups.withColumns({"total_bytes": n * size, "reclaimable_bytes": reclaimable(n, size)})


def size_candidates(files: DataFrame) -> DataFrame:
    """byte_length, copies, total_bytes, reclaimable_bytes of lengths that several observed files have."""
    sized = observed(files).where("byte_length is not null")
    return _totals(sized.groupBy("byte_length").agg(F.count("*").alias("copies")).where("copies > 1"))


def in_candidate_group(files: DataFrame) -> DataFrame:
    return observed(files).join(size_candidates(files).select("byte_length"), "byte_length", "left_semi")


def hash_workload(files: DataFrame, scope: str = "candidates") -> DataFrame:
    """files, bytes to be read."""
    rows = in_candidate_group(files) if scope == "candidates" else observed(files)
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))


def hash_tasks(files: DataFrame, scope: str = "candidates") -> DataFrame:
    """Files to hash. The semi join comes before content is read, so files of unique size are never opened."""
    return in_candidate_group(files) if scope == "candidates" else observed(files).where("byte_length is not null")


def hash_content(tasks: DataFrame, content: str = "content") -> DataFrame:
    """Tasks with digest (sha256, hex) of their content."""
    return tasks.withColumn("digest", F.sha2(F.col(content), 256)).drop(content)


def newest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; ties to the larger `tie`. Pre-aggregated, so hot keys cost no sort."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), *rest)).alias("_top"))
    return top.select(*keys, *[F.col("_top")[c].alias(c) for c in rest])


def reuse_hashes(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """Tasks with digest, verification_state: a digest known for the same file (device, inode), else for the
    same path, at equal length and known, equal time; else null."""
    known = prior.where("modified_at is not null")
    file_key = ["root_id", "byte_length", "modified_at", "device_id", "filesystem_record_id"]
    path_key = ["root_id", "relative_path", "byte_length", "modified_at"]
    newest = lambda df, key, name: newest_per_key(df.select(*key, "hashed_at", "record_id", F.col("digest").alias(name)), key, "hashed_at", "record_id").drop("hashed_at", "record_id")
    by_file = newest(known.where("device_id is not null and filesystem_record_id is not null"), file_key, "d1")
    out = tasks.join(by_file, file_key, "left").join(newest(known, path_key, "d2"), path_key, "left")
    digest = F.coalesce("d1", "d2")
    return out.withColumns({"digest": digest, "verification_state": F.when(digest.isNotNull(), "reused")}).drop("d1", "d2")


def incremental_hash(tasks: DataFrame, prior: DataFrame, content: str = "content") -> DataFrame:
    """Every task with digest and verification_state (reused or verified); only the rest is hashed.

    What is known is decided on metadata alone. Contents then meet only the ids of the rest, usually few: such a
    semi join is broadcast, or filtered before its shuffle, so contents of known files stay where they are."""
    facts = [c for c in tasks.columns if c != content]
    tried = reuse_hashes(tasks.select(*facts), prior)
    known = tried.where("digest is not null")
    rest = tasks.join(tried.where("digest is null").select("record_id"), "record_id", "left_semi")
    fresh = rest.select(*facts, F.sha2(F.col(content), 256).alias("digest"), F.lit("verified").alias("verification_state"))
    return known.select(*facts, "digest", "verification_state").unionByName(fresh)


def stable_hashes(hashed: DataFrame, listing: DataFrame) -> DataFrame:
    """Hashed files whose observation a second listing, taken after reading, still shows unchanged."""
    from .snapshots import matches_observation

    facts = ["byte_length", "modified_at", "device_id", "filesystem_record_id"]
    seen = listing.where("observation_status = 'observed'").select("root_id", "relative_path", F.struct(*facts).alias("_now"))
    out = hashed.join(seen, ["root_id", "relative_path"], "left")
    same = F.col("_now").isNotNull() & matches_observation({f: F.col(f) for f in facts}, {f: F.col("_now")[f] for f in facts})
    return out.withColumn("stable", same).drop("_now")


def exact_groups(hashes: DataFrame) -> DataFrame:
    """group_id, digest, byte_length, copies, total_bytes, reclaimable_bytes of contents that several files have."""
    g = hashes.where("digest is not null").groupBy("digest", "byte_length").agg(F.count("*").alias("copies")).where("copies > 1")
    return _totals(g).withColumn("group_id", stable_id("exact", F.col("digest"), F.col("byte_length")))


def exact_members(hashes: DataFrame) -> DataFrame:
    return hashes.join(exact_groups(hashes).select("digest", "byte_length", "group_id"), ["digest", "byte_length"])


def verification_state(members: DataFrame, key: str = "byte_length") -> DataFrame:
    """Per candidate group: verified, partially-verified or candidate, from which members have a digest."""
    state = F.when(F.bool_and(F.col("digest").isNotNull()), "verified").when(F.bool_or(F.col("digest").isNotNull()), "partially-verified").otherwise("candidate")
    return members.groupBy(key).agg(state.alias("state"), F.count("*").alias("copies"))


def candidate_members(files: DataFrame, hashes: DataFrame) -> DataFrame:
    return in_candidate_group(files).join(hashes.select("record_id", "digest"), "record_id", "left")


def keeper_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count_if(F.col("decision").isin("keep", "keep-all")).alias("keepers"), F.count("*").alias("copies"))


def keep_decisions(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions live in their own table, so they outlast a rebuild of the groups."""
    return members.join(decisions.select("group_id", "record_id", "decision"), ["group_id", "record_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))


def apply_decisions(members: DataFrame, keepers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with decision, violations). keepers: group_id, record_id (null: keep all). In a decided group
    keepers keep and the rest consolidate. A group that names a stranger, and no keep-all, is refused whole: its
    members stay undecided, so a group with copies to consolidate always has a keeper."""
    known = members.select("group_id", "record_id", F.lit(True).alias("member"))
    named = keepers.distinct().join(known, ["group_id", "record_id"], "left")
    of_group = named.groupBy("group_id").agg(F.bool_or(F.col("record_id").isNull()).alias("all"), F.bool_or(F.col("record_id").isNotNull() & F.col("member").isNull()).alias("strange"))
    chosen = of_group.where("all or not strange").select("group_id", "all", F.lit(True).alias("decided"))
    keep = named.where("record_id is not null and member").select("group_id", "record_id", F.lit(True).alias("keeper"))
    out = members.join(chosen, "group_id", "left").join(keep, ["group_id", "record_id"], "left")
    decision = F.when(F.col("decided").isNull(), "undecided").when(F.col("all"), "keep-all").when(F.col("keeper"), "keep").otherwise("consolidate")
    refused = of_group.where("strange and not all").select("group_id", F.lit("keeper-not-a-member").alias("violation"))
    return out.withColumn("decision", decision).drop("all", "decided", "keeper"), refused


def duplicate_reviews(groups: DataFrame) -> DataFrame:
    """One open review item per exact group."""
    reason = F.lit("duplicate-keeper-uncertain")
    return groups.select(stable_id("review", F.col("group_id"), reason).alias("review_id"), "group_id", reason.alias("reason"), F.concat(F.col("copies").cast("string"), F.lit(" verified copies")).alias("title"), "reclaimable_bytes", F.lit("open").alias("status"))


def close_reviews(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Duplicate reviews, resolved where their group is decided."""
    done = members.where("decision <> 'undecided'").select("group_id").distinct().withColumn("_d", F.lit(True))
    resolved = F.col("_d") & (F.col("reason") == "duplicate-keeper-uncertain") & (F.col("status") == "open")
    return reviews.join(done, "group_id", "left").withColumn("status", F.when(resolved, "resolved").otherwise(F.col("status"))).drop("_d")


def content_identities(hashes: DataFrame) -> DataFrame:
    return hashes.where("digest is not null").groupBy("digest", "byte_length").agg(F.max("hashed_at").alias("last_seen"), F.concat(F.lit("sha256:"), F.first("digest")).alias("identity"))


#: Parts into which the copies of one content are dealt before the least of them are picked.
PARTS = 64
_PLACE = ["root_id", "relative_path", "record_id"]


def first_copies(hashes: DataFrame, n: int = 500) -> DataFrame:
    """digest, byte_length, matches (the n least copies by root, path, record, in order), n_matches.

    Each task passes on at most n copies of a content (the limit of ranks comes before the shuffle), each of PARTS
    parts of a content at most n more, and no more than n reach a row, whatever the number of copies."""
    key = ["digest", "byte_length"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*key, *by).orderBy(*_PLACE))
    rows = hashes.where("digest is not null").select(*key, *_PLACE, F.pmod(F.xxhash64("record_id"), F.lit(PARTS)).alias("_part"))
    rows = rows.withColumn("_n", rank("_part")).where(F.col("_n") <= n)
    rows = rows.withColumn("_n", rank()).where(F.col("_n") <= n)
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*_PLACE))).alias("matches"), F.count("*").alias("n_matches"))


def top_matches(items: DataFrame, hashes: DataFrame, n: int = 500) -> DataFrame:
    """item_id, matches, n_matches of items (item_id, digest, byte_length) whose content hashes have: the n least copies
    of each content are picked first, from contents that items have, so an item meets one row."""
    key = ["digest", "byte_length"]
    wanted = items.where("digest is not null").select(*key).distinct()
    copies = first_copies(hashes.join(wanted, key, "left_semi"), n)
    return items.select("item_id", *key).join(copies, key).select("item_id", "matches", "n_matches")


def current_hashes(hashes: DataFrame, scans: DataFrame) -> DataFrame:
    """Hashes of each root's latest completed scan."""
    from .snapshots import latest_completed_scan

    return hashes.join(latest_completed_scan(scans).select("root_id", "scan_id"), ["root_id", "scan_id"], "left_semi")


def match_catalogue(items: DataFrame, hashes: DataFrame, scans: DataFrame, n: int = 500) -> DataFrame:
    """item_id, record_id, root_id, relative_path: catalogue files of latest completed scans with an item's content,
    the n least of each content."""
    found = top_matches(items, current_hashes(hashes, scans), n)
    return found.select("item_id", F.inline("matches")).select("item_id", "record_id", "root_id", "relative_path")


def reclaimable_report(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("files"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))
