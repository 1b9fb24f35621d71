"""Registered queries for the work queue, the action log and feedback."""

from pyspark.sql import functions as F

from beaconry.operators import actions as A
from beaconry.operators import queue as W
from beaconry.operators.catalog import number_captures
from beaconry.plans.catalog_queries import stored_catalog as catalog
from beaconry.plans.common import Tables, joined
from beaconry.plans.signal_queries import overlay

AS_OF_US = 1_706_659_200_000_000  # 2024-01-31T00:00:00Z


def project_items(t: Tables, limit: int = 5):
    return W.project_queue(catalog(t), t.static_evidence, t.project_enrichment, limit)


def signal_items(t: Tables, limit: int = 10):
    return W.signal_queue(t.once("_overlay", lambda: overlay(t)), t.signal_enrichment, limit)


def both_items(t: Tables):
    """Queue of a capture, with the signal run that has the same ordinal; a run without a capture is a queue of its own."""
    projects = project_items(t).withColumn("queue_id", F.col("capture_id"))
    cap = number_captures(t.captures).select("capture_id", F.concat(F.lit("r"), (F.col("capture_no") - 1).cast("string")).alias("run_id"))
    signals = signal_items(t).join(cap, "run_id", "left").withColumn("queue_id", F.coalesce("capture_id", "run_id")).drop("run_id")
    return projects, signals


def work_queue(t: Tables):
    return W.work_queue(*both_items(t)).select(
        "queue_id", "position", "id", "kind", "priority", "title", "reason", "evidence_state", "repository", "url", "output_path",
        joined("input_paths"), joined("required_fields"))


def log(t: Tables):
    return A.recorded_actions(t.action_events)


def calendar(t: Tables):
    """Every midnight of the log's days."""
    return t.action_events.select((F.floor(F.col("at_us") / A.DAY_US) * A.DAY_US).cast("bigint").alias("as_of_us")).distinct()


def tampered(t: Tables):
    """A later log version with deleted, changed and re-used rows."""
    e = t.action_events
    i = F.col("id")
    kept = e.filter(i % 500 != 7).withColumn("action", F.when(i % 400 == 9, "opened").otherwise(F.col("action")))
    return kept.unionByName(e.filter(i % 900 == 11))


QUERIES = {
    "project_queue": lambda t: project_items(t).select(
        "capture_id", "id", "priority", "repository", "title", "reason", "evidence_state", "source_pushed_at", "source_analysis_at",
        "previous_analyzed_at", joined("input_paths"), "output_path", "completed"),
    "signal_queue": lambda t: signal_items(t).select(
        "run_id", "id", "priority", "title", "url", "source", "reason", "source_published_at", "previous_analyzed_at", joined("input_paths"), "completed"),
    "work_queue": work_queue,
    "queue_summary": lambda t: W.queue_summary(*both_items(t)),
    "accept_actions": lambda t: A.accept_actions(t.action_requests, t.known_projects).select("id", "reason"),
    "dedupe_actions": lambda t: A.dedupe_actions(t.action_events).select("id", "status"),
    "action_state": lambda t: A.action_state(log(t)),
    "action_projection": lambda t: A.action_projection(A.action_state(log(t))),
    "action_state_order": lambda t: A.state_order(A.action_state(log(t))).select("device_id", "project_slug", "position"),
    "weekly_action_metrics": lambda t: A.weekly_action_metrics(log(t), calendar(t)),
    "migrate_legacy_actions": lambda t: A.migrate_legacy_actions(t.legacy_actions, log(t)).select(
        "id", "device_id", "project_slug", "action", "at_us", "idempotency_key"),
    "legacy_projection": lambda t: A.legacy_projection(log(t)),
    "append_only_check": lambda t: A.append_only_check(t.action_events, tampered(t)),
    "feedback_current": lambda t: A.feedback_current(t.feedback_changes),
    "decision_events": lambda t: A.decision_events(t.feedback_changes).select("id", "device_id", "project_slug", "value", "at_us"),
    "feedback_counts": lambda t: A.feedback_counts(A.feedback_current(t.feedback_changes)),
    "weekly_decisions": lambda t: A.weekly_decisions(A.decision_events(t.feedback_changes), AS_OF_US),
    "watchlist": lambda t: A.watchlist(A.feedback_current(t.feedback_changes), A.action_state(log(t)), t.known_projects).select(
        "device_id", "project_slug", "position", joined("status")),
}
