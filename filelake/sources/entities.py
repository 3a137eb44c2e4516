"""Rules that rows of an entity keep, and writing with the rows that break them set apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import write_table


@dataclass(frozen=True)
class Entity:
    """required: columns that are never null. allowed: values of a column. at_least, at_most: bounds of a number.
    unique: keys, of which rows with a null are no repeats. Null is allowed where a column is not required."""

    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


# Names of states and kinds, and bounds, that tables must keep.
_JOB_STATES = ("queued", "running", "paused", "completed", "failed", "cancelled")
_PROVENANCE = ("deterministic", "local-model", "user")
ENTITIES = {
    "content_identities": Entity(("algorithm", "digest", "byte_length"), {}, {"byte_length": 0}, {}, (("algorithm", "digest", "byte_length"),)),
    "file_hashes": Entity(("record_id", "digest", "byte_length"), {"algorithm": ("sha256",), "verification_state": ("verified", "reused")}, {"byte_length": 0}, {}, (("record_id",),)),
    "analysis_stages": Entity(("scan_id", "stage", "status"), {"status": ("not-started", *_JOB_STATES)}, {"processed": 0, "total": 0}, {}, (("scan_id", "stage"),)),
    "duplicate_groups": Entity(("group_id",), {"kind": ("candidate", "exact"), "verification_state": ("candidate", "partially-verified", "verified")}, {"copies": 2, "byte_length": 0, "total_bytes": 0, "reclaimable_bytes": 0}, {}, (("group_id",),)),
    "duplicate_members": Entity(("group_id", "record_id"), {"hash_state": ("not-hashed", "verified", "reused"), "decision": ("undecided", "keep", "consolidate", "keep-all")}, {"byte_length": 0}, {}, (("group_id", "record_id"),)),
    "analyzer_results": Entity(("record_id", "analyzer", "status"), {"status": ("completed", "unavailable", "failed")}),
    "understanding": Entity(("record_id", "category"), {"classification_layer": ("deterministic", "context", "local-model"), "uncertainty": ("confident", "needs-review"), "analysis_state": ("pending", "analyzed", "partial", "failed")}, {"confidence": 0}, {"confidence": 1}, (("record_id",),)),
    "semantic_groups": Entity(("group_id", "kind"), {"kind": ("project", "album", "media-pair", "media-event"), "provenance": _PROVENANCE}, {"confidence": 0}, {"confidence": 1}, (("group_id",),)),
    "relationships": Entity(("source_record_id", "target_record_id", "kind"), {"provenance": _PROVENANCE}, {"confidence": 0}, {"confidence": 1}, (("scan_id", "source_record_id", "target_record_id", "kind"),)),
    "reviews": Entity(("scan_id", "reason", "status"), {"status": ("open", "resolved", "dismissed")}, {}, {}, (("scan_id", "reason", "record_id", "group_id"),)),
    "rules": Entity(("source",), {"source": ("user", "system")}, {"use_count": 1}),
    "reconciliation_runs": Entity(("run_id", "root_id", "status"), {"status": _JOB_STATES, "phase": ("missing", "added", "changed", "complete")}, {"processed": 0, "added_count": 0, "missing_count": 0, "changed_count": 0}, {}, (("run_id",), ("root_id", "baseline_scan_id", "comparison_scan_id"))),
    "deltas": Entity(("run_id", "kind", "relative_path"), {"kind": ("added", "missing", "metadata-changed")}, {}, {}, (("run_id", "kind", "relative_path"),)),
    "jobs": Entity(("job_id", "status"), {"recovery_mode": ("restart", "resume-from-checkpoint")}, {"revision": 0}, {}, (("job_id",), ("idempotency_key",))),
}


def _row_rules(entity: Entity, columns: list[str]) -> list[tuple[str, Column]]:
    """(rule, whether a row breaks it); rules of columns that a table does not have are left out, required ones not."""
    missing = [c for c in entity.required if c not in columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    out = [(f"{c} is required", F.col(c).isNull()) for c in entity.required]
    out += [(f"{c} is not allowed", ~F.col(c).isin(list(v))) for c, v in entity.allowed.items() if c in columns]
    out += [(f"{c} is too small", F.col(c) < v) for c, v in entity.at_least.items() if c in columns]
    return out + [(f"{c} is too large", F.col(c) > v) for c, v in entity.at_most.items() if c in columns]


def checked(df: DataFrame, entity: Entity, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """df with violations, the sorted texts of the rules that a row breaks (none: an empty array).

    Every row of a repeated key breaks its rule. references: column -> (table, its key); a value that the table lacks
    breaks the rule, null does not. Repeated and known keys are aggregated before they meet the rows."""
    rules = [F.when(broken, rule) for rule, broken in _row_rules(entity, df.columns)]
    for i, key in enumerate(k for k in entity.unique if set(k) <= set(df.columns)):
        again = df.dropna("any", subset=list(key)).groupBy(*[F.col(c).alias(f"_key{i}_{c}") for c in key]).agg(F.count("*").alias(f"_times{i}")).where(f"_times{i} > 1")
        df = df.join(again, [F.col(c) == F.col(f"_key{i}_{c}") for c in key], "left").drop(*[f"_key{i}_{c}" for c in key])
        rules.append(F.when(F.col(f"_times{i}").isNotNull(), f"{', '.join(key)} is repeated"))
    for c, (other, key) in (references or {}).items():
        known = other.select(F.col(key).alias(f"_known_{c}")).where(f"_known_{c} is not null").distinct()
        df = df.join(known, F.col(c) == F.col(f"_known_{c}"), "left")
        rules.append(F.when(F.col(c).isNotNull() & F.col(f"_known_{c}").isNull(), f"{c} is unknown"))
    out = df.withColumn("violations", F.array_sort(F.array_compact(F.array(*rules))) if rules else F.array().cast("array<string>"))
    return out.drop(*[c for c in df.columns if c.startswith(("_times", "_known_"))])


def violations(df: DataFrame, entity: Entity, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """rule, n: rows that break each rule; rules that all rows keep have no row."""
    return checked(df, entity, references).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def write_entity(df: DataFrame, base: str, name: str, references: dict[str, tuple[DataFrame, str]] | None = None, partitions: list[str] | None = None) -> tuple[str, str]:
    """Write df as a new version of the entity `name` of ENTITIES: paths of the accepted rows and of the refused ones
    with their violations. Both come from one checked table, which is written once."""
    both = df.sparkSession.read.parquet(write_table(checked(df, ENTITIES[name], references), base, f"{name}-checked"))
    kept = write_table(both.where(F.size("violations") == 0).drop("violations"), base, name, partitions)
    return kept, write_table(both.where(F.size("violations") > 0), base, f"{name}-refused")
