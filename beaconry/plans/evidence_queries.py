"""Registered queries for static evidence and artifact versions."""

from pyspark.sql import functions as F

from beaconry.operators import evidence as E
from beaconry.operators import versions as V
from beaconry.plans.common import Tables


def _names(t: Tables):
    return t.artifact_copies.select("repository")


QUERIES = {
    "scan_files": lambda t: E.scan_files(t.files.drop("text")).select("repo", "path", "suffix"),
    "language_profile": lambda t: E.language_profile(E.scan_files(t.files.drop("text"))).select("repo", "suffix", "files", "rank"),
    "test_file_flag": lambda t: E.scan_files(t.files.drop("text")).select("repo", "path", E.is_test_file(F.col("path")).alias("is_test")),
    "todo_markers": lambda t: E.file_facts(t.files).groupBy("repo").agg(F.sum("todo").alias("todo_markers")),
    "presence_indicators": lambda t: E.evidence_summary(t.files).select("repo", *[f"ind_{i}" for i in E.INDICATORS]),
    "license_hint": lambda t: E.license_hints(t.files),
    "evidence_summary": lambda t: E.evidence_summary(t.files).select(
        "repo", "schema_version", "project_id", "scanned_files", "test_files", "todo_markers", "license_hint", "confidence",
        F.array_join("warnings", "|").alias("warnings"),
        F.array_join(F.transform(F.map_entries("language_files"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
        .alias("language_files")),
    "authoritative_artifact": lambda t: V.authoritative_artifact(t.artifact_copies, _names(t))[0].select(
        "repository_key", "schema_version", "repository", "analyzed_at"),
    "authoritative_artifact_errors": lambda t: V.authoritative_artifact(t.artifact_copies, _names(t))[1],
    "upgrade_evidence_versions": lambda t: V.upgrade_versions(t.artifact_copies)[0],
    "upgrade_totals": lambda t: V.upgrade_versions(t.artifact_copies)[1],
    "upgrade_applied": lambda t: V.upgrade_versions(t.static_evidence)[2].select("ord", "schema_version", "repository", "project_id"),
    "downgrade_evidence_versions": lambda t: V.downgrade_versions(t.artifact_copies),
    "overlay_newer": lambda t: V.overlay_newer(t.current_artifacts, t.staging),
    "stale_write_guard": lambda t: V.stale_write_guard(t.current_artifacts, t.staging),
    "ingest_drafts": lambda t: V.ingest_drafts(t.project_enrichment).select("ord", "reason", "target"),
}
