"""Classification of files by extension, type evidence and remembered rules, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import invalid_fields, stable_id

# Extensions of each category.
CATEGORIES = {
    "Applications": "exe msi app apk deb rpm pkg appimage",
    "Archives": "zip rar sevenz 7z tar gz bz2 xz tgz iso dmg bak",
    "Audio": "mp3 wav flac m4a aac ogg opus wma aiff",
    "Books": "epub mobi azw azw3 cbz cbr",
    "Code": "js jsx ts tsx py rb rs go java c h cpp cs swift kt sh ps1 html css scss sql",
    "Data": "yaml yml json xml toml sqlite db parquet ndjson jsonl",
    "Design": "psd ai sketch fig xcf dwg dxf blend stl obj",
    "Documents": "pdf doc docx odt rtf txt md tex pages ppt pptx odp",
    "Fonts": "ttf otf woff woff2",
    "Images": "jpg jpeg png gif webp heic heif tif tiff bmp svg ico raw dng cr2 nef avif",
    "Spreadsheets": "xls xlsx ods csv",
    "Videos": "mp4 mov mkv avi webm m4v mpg mpeg wmv flv",
}
OTHER = "Other"
#: Confidences of the rules, and below which a file needs review.
KNOWN, UNKNOWN, BY_MIME, CONFLICT, AGREED, REVIEW = 0.88, 0.35, 0.82, 0.55, 0.94, 0.65


def categories() -> list[str]:
    return sorted([*CATEGORIES, OTHER])


def category_for_extension(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c, names in CATEGORIES.items() for e in names.split() for x in (e, c)])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit(OTHER))


def category_for_mime(mime: Column) -> Column:
    return (
        F.when(F.startswith(mime, F.lit("image/")), "Images")
        .when(F.startswith(mime, F.lit("video/")), "Videos")
        .when(F.startswith(mime, F.lit("audio/")), "Audio")
        .when((mime == "application/pdf") | F.startswith(mime, F.lit("text/")), "Documents")
        .when(mime.isin("application/zip", "application/gzip", "application/x-tar", "application/x-7z-compressed"), "Archives")
    )


def classify(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """files (extension, mime_type, n_failed, n_results, n_unavailable) with category, confidence,
    uncertainty, conflicting, analysis_state, explanation, classification_layer. rules: extension, category
    (broadcast only while Catalyst's size check allows)."""
    if rules is not None:
        files = files.join(rules.select(F.lower("extension").alias("_ext"), F.col("category").alias("_rule")), F.lower("extension") == F.col("_ext"), "left").drop("_ext")
    else:
        files = files.withColumn("_rule", F.lit(None).cast("string"))
    first = F.coalesce("_rule", category_for_extension(F.col("extension")))
    mime = category_for_mime(F.col("mime_type"))
    files = files.withColumns({"_first": first, "_mime": mime, "_base": F.when(F.col("_rule").isNotNull(), 1.0).when(first == OTHER, UNKNOWN).otherwise(KNOWN)})
    said, first, rule = F.col("_mime"), F.col("_first"), F.col("_rule")
    conflict = F.coalesce((first != OTHER) & (said != first), F.lit(False))
    confidence = F.when(said.isNull(), F.col("_base")).when(first == OTHER, BY_MIME).when(conflict, F.least(F.col("_base"), F.lit(CONFLICT))).otherwise(F.greatest(F.col("_base"), F.lit(AGREED)))
    why = (
        F.when((first == OTHER) & said.isNotNull(), F.concat(F.lit("type evidence says "), said))
        .when(conflict, F.concat(F.lit("extension says "), first, F.lit(", type evidence says "), said))
        .when(said.isNotNull(), F.concat(F.lit("extension and type evidence agree on "), first))
        .when(rule.isNotNull(), F.concat(F.lit("remembered rule: "), rule))
        .when(first == OTHER, F.lit("no evidence maps to a known category"))
        .otherwise(F.concat(F.lit("extension says "), first))
    )
    state = F.when(F.col("n_failed") == F.col("n_results"), "failed").when((F.col("n_failed") > 0) | (F.col("n_unavailable") > 0), "partial").otherwise("analyzed")
    out = files.withColumns({"category": F.when((first == OTHER) & said.isNotNull(), said).otherwise(first), "confidence": confidence, "conflicting": conflict, "explanation": why, "analysis_state": state, "classification_layer": F.lit("deterministic")})
    return out.withColumn("uncertainty", F.when((F.col("confidence") < REVIEW) | F.col("conflicting"), "needs-review").otherwise("confident")).drop("_first", "_mime", "_base", "_rule")


def generate_reviews(understanding: DataFrame, failures: DataFrame | None = None, stale: DataFrame | None = None) -> DataFrame:
    """review_id, root_id, scan_id, record_id, reason, title; one per (scan, record, reason)."""
    reason = lambda name, df: df.select("root_id", "scan_id", "record_id", F.lit(name).alias("reason") if isinstance(name, str) else name.alias("reason"), F.col("explanation").alias("title"))
    low = F.when(F.col("confidence") < REVIEW, "low-classification-confidence").otherwise("conflicting-metadata")
    out = reason(low, understanding.where("uncertainty = 'needs-review'")).unionByName(reason("unsupported-format", understanding.where(F.col("category") == OTHER)))
    for name, df in (("analysis-failed", failures), ("stale-source", stale)):
        if df is not None:
            out = out.unionByName(reason(name, df.withColumnRenamed("message", "explanation")))
    return out.withColumn("review_id", stable_id("review", F.col("scan_id"), F.col("record_id"), F.col("reason"))).dropDuplicates(["review_id"])


def sticky_reviews(generated: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Reviews with status: what was resolved or dismissed stays so when reviews are made anew."""
    return generated.join(resolutions.select("review_id", F.col("status").alias("_s")), "review_id", "left").withColumn("status", F.coalesce("_s", F.lit("open"))).drop("_s")


def apply_resolutions(understanding: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A resolved category wins: confidence 1, layer context."""
    r = resolutions.where("category is not null").groupBy("record_id").agg(F.max_by("category", "resolved_at").alias("_c"))
    hit = F.col("_c").isNotNull()
    out = understanding.join(r, "record_id", "left")
    return out.withColumns({"category": F.coalesce("_c", "category"), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "uncertainty": F.when(hit, "confident").otherwise(F.col("uncertainty")), "classification_layer": F.when(hit, "context").otherwise(F.col("classification_layer"))}).drop("_c")


def learn_rules(resolutions: DataFrame) -> DataFrame:
    """extension, category (the latest remembered), use_count."""
    kept = resolutions.where("remember and extension is not null and category is not null")
    return kept.groupBy(F.lower("extension").alias("extension")).agg(F.max(F.struct("resolved_at", "category"))["category"].alias("category"), F.count("*").alias("use_count"))


def apply_external_labels(understanding: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(understanding, violations). labels: record_id, category, confidence, explanation, evidence. Valid ones
    replace what has a confidence under 0.8."""
    rules = {"category": F.col("category").isin(categories()), "confidence": F.col("confidence").between(0, 1), "explanation": F.length("explanation").between(1, 2000), "evidence": F.size("evidence") <= 20}
    judged = labels.withColumn("broken", invalid_fields(rules))
    good = judged.where(F.size("broken") == 0).select("record_id", F.col("category").alias("_c"), F.col("confidence").alias("_p"), F.col("explanation").alias("_e"))
    use = F.col("_c").isNotNull() & (F.col("confidence") < 0.8)
    out = understanding.join(good.dropDuplicates(["record_id"]), "record_id", "left").withColumn("_use", use)
    pick = lambda new, old: F.when(F.col("_use"), new).otherwise(F.col(old))
    out = out.withColumns({"category": pick(F.col("_c"), "category"), "explanation": pick(F.col("_e"), "explanation"), "classification_layer": pick(F.lit("model"), "classification_layer"), "confidence": pick(F.col("_p"), "confidence")})
    out = out.withColumn("uncertainty", F.when(F.col("_use"), F.when(F.col("confidence") < REVIEW, "needs-review").otherwise("confident")).otherwise(F.col("uncertainty")))
    return out.drop("_c", "_p", "_e", "_use"), judged.where(F.size("broken") > 0).select("record_id", "broken")


def apply_group_context(understanding: DataFrame, members: DataFrame) -> DataFrame:
    """Members of a group: confidence at least the group's, layer context, confident."""
    best = members.groupBy("record_id").agg(F.max("confidence").alias("_g"))
    hit = F.col("_g").isNotNull()
    out = understanding.join(best, "record_id", "left")
    return out.withColumns({"confidence": F.greatest("confidence", F.coalesce("_g", "confidence")), "classification_layer": F.when(hit, "context").otherwise(F.col("classification_layer")), "uncertainty": F.when(hit, "confident").otherwise(F.col("uncertainty"))}).drop("_g")


def classify_ingest(items: DataFrame) -> DataFrame:
    """items (extension, mime_type, n_failed) with category and confidence by the rules for incoming files."""
    by_ext = category_for_extension(F.col("extension"))
    m = F.col("mime_type")
    loose = F.coalesce(F.when(F.startswith(m, F.lit("image/")) | F.startswith(m, F.lit("video/")) | F.startswith(m, F.lit("audio/")) | F.startswith(m, F.lit("text/")) | (m == "application/pdf"), category_for_mime(m)), F.when(m.contains("zip") | m.contains("compressed"), "Archives"))
    out = items.withColumn("category", F.when(by_ext == OTHER, F.coalesce(loose, F.lit(OTHER))).otherwise(by_ext))
    return out.withColumn("confidence", F.when(F.col("category") == OTHER, 0.35).when(F.col("n_failed") > 0, 0.75).otherwise(0.9))
