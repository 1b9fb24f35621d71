"""Registered queries for recall, identity and the catalog."""

import uuid

from pyspark.sql import functions as F

from beaconry.functions.timefns import iso_text
from beaconry.operators import catalog as C
from beaconry.operators import identity as I
from beaconry.operators import recall as R
from beaconry.plans.common import Tables, joined, shared_dir
from beaconry.sources.writers import history, write_history

c = F.col


def scored(t: Tables):
    return C.scored_snapshot(t.repo_snapshot, t.captures, t.static_evidence, t.project_enrichment)


def catalog(t: Tables, limit: int = 30):
    return C.build_catalog(t.repo_snapshot, t.captures, t.static_evidence, t.project_enrichment, limit)


def told(t: Tables, limit: int = 30):
    return C.told_catalog(t.repo_snapshot, t.captures, t.static_evidence, t.project_enrichment, limit)


# What the queue, the views and the audit read of a catalog.
SLIM = ["capture_id", "position", "repo", "canonical", "title", "category", "pushed_at", "attention", "endurance", "readiness", "completeness",
        "recommendation", "growth_kind", "growth_value", "observed", "obs_count", "obs_window", "heat_track", "long_term_evidence", "verified",
        "analysis_state"]


def stored_catalog(t: Tables):
    """The catalog without its texts, written once for queries that read it several times."""
    return t.filed("_catalog", lambda: told(t).select(*SLIM))


def ordered(t: Tables, limit: int = 30):
    return C.balanced_order(scored(t), limit)


def declared(t: Tables):
    numbered = C.previous_capture(t.captures)
    wanted = numbered.select(
        "capture_id", F.when(c("capture_no") % 3 == 0, iso_text(c("previous_ts")))
        .when(c("capture_no") % 3 == 1, F.lit("1990-01-01T00:00:00Z")).alias("declared_previous_at"))
    return C.previous_capture(t.captures, wanted)


def summary_inputs(t: Tables):
    counts = t.repo_snapshot.groupBy("capture_id").agg(F.count("*").alias("source_count"))
    runs = R.query_health(t.repo_hits, t.attempts)
    failed = runs.groupBy("capture_id").agg(F.count_if(c("state") == "failed").alias("query_failure_count"))
    return counts.join(failed, "capture_id", "left")


def append_history(t: Tables):
    """Archive the older captures on storage, then try to archive everything, altered, twice: archived ones must not change."""
    root = f"{shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    facts = t.repo_snapshot
    old = c("captured_us") < F.lit(946_684_800_000_000)
    write_history(facts.filter(old), root)
    for _ in range(2):
        write_history(facts.withColumn("stars", F.when(old, c("stars") + 1).otherwise(c("stars"))), root)
    return (history(t.spark, root, facts.schema).groupBy("captured_at")
            .agg(F.count("*").alias("n_rows"), F.sum("stars").alias("total_stars")))


def explained(t: Tables):
    """One row per (project, dimension): the whole explanation, its score, summary and four lists of lines."""
    return C.explained_dimensions(catalog(t)).select(
        "capture_id", "repo", "dimension", "score", "summary", joined("facts"), joined("proxies"), joined("limitations"), joined("upgrade_conditions"))


def _scored(*cols):
    """Columns by name, or by SQL text."""
    return lambda t: scored(t).selectExpr("capture_id", "repo", *cols)


QUERIES = {
    "recall_rules": lambda t: R.recall_rules(t.repo_facts).select("capture_id", "rule", "repo", "stars", "item_ord"),
    "normalize_repo_items": lambda t: R.normalize_repo_items(t.raw_items).select(
        "capture_id", "rule", "query_ord", "item_ord", "repo", "url", "description", "owner", "language", "license",
        joined("topics"), "stars", "forks", "open_issues", "created_at", "pushed_at"),
    "merge_candidates": lambda t: R.merge_candidates(t.repo_hits).select(
        "capture_id", "repo", "url", "description", "stars", "forks", "pushed_at", "candidate_query", "first_query_ord", "first_item_ord"),
    "query_health": lambda t: R.query_health(t.repo_hits, t.attempts),
    "capture_header": lambda t: R.capture_header(R.query_health(t.repo_hits, t.attempts)),
    "rank_snapshot": lambda t: R.rank_snapshot(t.repo_snapshot).select("capture_id", "repo", "position"),
    "append_history": append_history,
    "canonical_repository": lambda t: I.canonical_repository(t.carried_identity).select("ord", "repository", "canonical", "error"),
    "project_identity": lambda t: I.project_identity(t.carried_identity).select(
        "ord", "repository", "project_id", I.legacy_slug(c("repository")).alias("slug")),
    "validate_carried_identity": lambda t: I.validate_carried_identity(t.carried_identity).select("ord", "error"),
    "identity_uniqueness": lambda t: I.identity_uniqueness(t.identity_names),
    "legacy_slug_collisions": lambda t: I.legacy_slug_collisions(t.identity_names).select("capture_id", "slug", joined("repositories")),
    "previous_capture": lambda t: C.previous_capture(t.captures).select("capture_id", "capture_no", "previous_capture_id"),
    "declared_previous_capture": lambda t: declared(t).select("capture_id", "previous_capture_id", "error"),
    "star_growth": lambda t: C.with_growth_labels(C.with_growth(t.repo_snapshot, t.captures)).select(
        "capture_id", "repo", "growth_kind", "growth_value", "growth_label", "trend", F.round("ranking_value", 6).alias("ranking_value")),
    "heat_observations": lambda t: C.with_growth(t.repo_snapshot, t.captures).select("capture_id", "repo", "obs_count", "obs_window"),
    "persistence": lambda t: C.with_growth(t.repo_snapshot, t.captures).select(
        "capture_id", "repo", C.persistence_verified(c("obs_count"), c("obs_window")).alias("persistent")),
    "term_hits": _scored("array_join(terms, '|') AS terms", "low_actionability", "risk"),
    "category": _scored("base_category AS category"),
    "momentum_score": _scored("momentum", "query_count"),
    "endurance_score": _scored("endurance", "long_term", "verified"),
    "attention_score": _scored("attention"),
    "engineering_readiness": _scored("readiness"),
    "recommendation": _scored("recommendation"),
    "evidence_completeness": _scored("completeness"),
    "analysis_current": _scored("has_payload", "has_analysis"),
    "enrichment_current": _scored("has_profile", "has_enrichment"),
    "heat_track": _scored("heat_track", "heat_label", "long_term_evidence"),
    "analysis_state": _scored("analysis_state"),
    "evidence_base_score": lambda t: scored(t).select(
        "capture_id", "repo", F.round(C.evidence_base_score(c("attention"), c("readiness")), 6).alias("base_score")),
    "balanced_order": lambda t: ordered(t, 100).select("capture_id", "position", "repo", "daily", "attention", "readiness"),
    "catalog_limit": lambda t: ordered(t, 1).select("capture_id", "position", "repo"),
    "catalog": lambda t: ordered(t).select(
        "capture_id", "position", "repo", "attention", "momentum", "endurance", "readiness", "completeness", "heat_track",
        "heat_label", "recommendation", "analysis_state", "growth_kind", "growth_value"),
    "analysis_targets": lambda t: C.analysis_targets(t.repo_snapshot, t.captures),
    "analysis_failures": lambda t: C.analysis_failures(C.analysis_targets(t.repo_snapshot, t.captures), t.static_evidence),
    "narrative_fields": lambda t: told(t).select("capture_id", "repo", "why_now", "risk_text", "captured_label"),
    "capability_terms": lambda t: told(t).select(
        "capture_id", "repo", F.array_join("own_capabilities", "|").alias("capabilities"), F.array_join("own_task_terms", "|").alias("task_terms")),
    "apply_enrichment": lambda t: told(t).select(
        "capture_id", "repo", "title", "category", "project_description", "fit_hypothesis", "reuse_plan", joined("capabilities"), joined("task_terms")),
    "license_and_url": lambda t: told(t).select("capture_id", "repo", "safe_link", "license_display", "language_display"),
    "score_explanations": explained,
    "explanation_rows": lambda t: C.explanation_rows(catalog(t)),
    "evidence_list": lambda t: catalog(t).select("capture_id", "repo", F.explode("evidence").alias("e")).select("capture_id", "repo", "e.*"),
    "catalog_summary": lambda t: C.catalog_summary(told(t), summary_inputs(t)).select(
        "capture_id", "project_count", "deep_count", joined("pending_deep"), "daily_long_term", "daily_recent", "verified_long_term",
        "observed_count", "snapshot_count", "source_count", "query_failure_count", "growth_mode", "notice"),
    "catalog_facets": lambda t: C.catalog_facets(told(t)),
    "catalog_views": lambda t: C.catalog_views(stored_catalog(t)).withColumn("facets", F.array_join("facets", "|")),
    "normalize_legacy_catalog": lambda t: C.normalize_legacy_catalog(t.legacy_catalog)[0],
    "normalize_legacy_catalog_errors": lambda t: C.normalize_legacy_catalog(t.legacy_catalog)[1],
}
