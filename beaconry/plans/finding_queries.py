"""Registered queries for the audit findings: the tables of each audit group, one row per broken rule and row."""

from beaconry.operators import findings as D
from beaconry.plans import audit_queries as Q

QUERIES = {
    "findings_presence": lambda t: D.presence(t.audit_headers, t.audit_inventory, ["snapshot", "catalog", "signals", "queue"]),
    "findings_shape": lambda t: D.shape(t.intake_documents, t.intake_rows),
    "findings_times": lambda t: D.times(t.generation_headers),
    "findings_counts": lambda t: D.counts(t.audit_headers, t.audit_snapshot, t.audit_catalog, t.audit_signals, t.audit_queue),
    "findings_uniqueness": lambda t: D.uniqueness(
        t.audit_snapshot, t.audit_catalog, t.audit_artifacts, t.audit_profiles, t.audit_signals, t.audit_sources, t.audit_queue),
    "findings_references": lambda t: D.references(t.audit_headers, t.audit_snapshot, t.audit_catalog, t.audit_rules, t.audit_artifacts),
    "findings_query_health": lambda t: D.query_health(t.audit_headers, t.audit_rules, t.audit_status),
    "findings_tracks": lambda t: D.tracks(t.audit_headers, t.audit_catalog),
    "findings_heat": lambda t: D.heat(*Q.heat_inputs(t)),
    "findings_urls_scores": lambda t: D.urls_scores(t.audit_headers, t.audit_catalog, t.audit_signals, t.audit_sources),
    "findings_sources": lambda t: D.sources(t.audit_headers, t.audit_sources),
    "findings_queue_rebuild": lambda t: D.queue_rebuild(*Q.queue_rebuild_inputs(t)),
    "findings_catalog_rebuild": lambda t: D.catalog_rebuild(*Q.catalog_rebuild_inputs(t)),
    "findings_growth": lambda t: D.growth(*Q.growth_inputs(t)),
    "findings_analysis_failures": lambda t: D.analysis_failures(t.audit_headers, t.audit_failures),
}
