"""Analyst work queue: which top projects and signals still need work, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.text import filled
from beaconry.functions.timefns import strict_time
from beaconry.operators.identity import canonical, project_id

c = F.col
PROJECT_TEXT_FIELDS = ["title", "summary", "category", "best_for", "reuse_plan", "limitation", "evidence_summary", "source_url"]
PROJECT_ARRAY_FIELDS = ["capabilities", "task_terms"]
PROJECT_REQUIRED = sorted([*PROJECT_TEXT_FIELDS, *PROJECT_ARRAY_FIELDS, "schema_version", "repository", "source_pushed_at",
                           "source_analysis_at", "analyzed_at", "project_id", "project_id_version"])
SIGNAL_REQUIRED = sorted(["title", "takeaway", "why", "category", "analyzed_at", "source_published_at"])


def project_queue(catalog: DataFrame, evidence: DataFrame, enrichment: DataFrame, project_limit: int = 5) -> DataFrame:
    """State of the first catalog positions; completed rows carry ``completed = true``."""
    top = catalog.filter(c("position") <= max(0, project_limit)).select(
        "capture_id", "position", "repo", "title", "pushed_at", canonical(c("repo")).alias("canonical"))
    ev = evidence.select(canonical(c("repository")).alias("canonical"), c("schema_version").alias("_ev"), c("analyzed_at").alias("analysis_at"))
    complete = F.lit(True)
    for name in PROJECT_TEXT_FIELDS + ["repository", "source_pushed_at", "source_analysis_at", "analyzed_at", "project_id"]:
        complete = complete & filled(c(name))
    for name in PROJECT_ARRAY_FIELDS:
        complete = complete & filled(c(name), "array")
    complete = complete & c("project_id_version").isNotNull() & c("schema_version").isNotNull()
    en = enrichment.select(
        canonical(c("repository")).alias("canonical"), F.coalesce(complete, F.lit(False)).alias("_complete"), c("schema_version").alias("_nv"),
        c("source_pushed_at").alias("_sp"), c("source_analysis_at").alias("_sa"), c("analyzed_at").alias("profile_at"))
    wanted = top.select("canonical").distinct()  # a null name meets nothing
    rows = top.join(ev.join(wanted, "canonical", "left_semi"), "canonical", "left").join(en.join(wanted, "canonical", "left_semi"), "canonical", "left")
    ready = F.coalesce((c("_ev") == 2) & (strict_time(c("analysis_at")) >= strict_time(c("pushed_at"))), F.lit(False))
    current = F.coalesce(
        c("_complete") & (c("_nv") == 2) & (c("_ev") == 2) & (c("_sp") == c("pushed_at")) & (c("_sa") == c("analysis_at"))
        & strict_time(c("_sp")).isNotNull() & (strict_time(c("profile_at")) >= strict_time(c("_sa"))), F.lit(False))
    identity = project_id(c("repo"))
    rows = rows.withColumn("ready", ready).withColumn("completed", c("ready") & current).withColumn("project_id", identity)
    base = F.concat(F.lit("data/generations/"), c("capture_id"))
    return rows.select(
        "capture_id", F.concat(F.lit("project:"), c("project_id")).alias("id"), F.lit("project").alias("kind"),
        (100 - (c("position") - 1) * 4).cast("int").alias("priority"), "project_id", c("repo").alias("repository"), "title",
        F.when(~c("ready"), "static_inspection_missing").when(F.coalesce("_complete", F.lit(False)), "profile_stale")
        .otherwise("profile_missing").alias("reason"),
        F.when(c("ready"), "ready").otherwise("static_analysis_required").alias("evidence_state"),
        c("pushed_at").alias("source_pushed_at"), c("analysis_at").alias("source_analysis_at"), c("profile_at").alias("previous_analyzed_at"),
        F.array_compact(F.array(F.when(c("ready"), F.concat(base, F.lit("/analysis/"), c("project_id"), F.lit(".json"))),
                                F.concat(base, F.lit("/catalog/latest.json")))).alias("input_paths"),
        F.concat(F.lit("data/enrichment/"), c("project_id"), F.lit(".json")).alias("output_path"),
        F.array(*[F.lit(f) for f in PROJECT_REQUIRED]).alias("required_fields"), "completed")


def signal_queue(overlay: DataFrame, enrichment: DataFrame, signal_limit: int = 10) -> DataFrame:
    """State of the first signals of each run (``overlay`` carries the currency flags)."""
    at = enrichment.select("run_id", "url", F.coalesce("analyzed_at", "set_generated_at").alias("previous_analyzed_at"))
    return overlay.filter(c("position") <= max(0, signal_limit)).join(at, ["run_id", "url"], "left").select(
        "run_id", F.concat(F.lit("signal:"), c("id")).alias("id"), F.lit("signal").alias("kind"),
        (98 - (c("position") - 1) * 3).cast("int").alias("priority"), "title", "url", "source",
        F.when(c("complete_but_stale"), "summary_stale").otherwise("summary_missing").alias("reason"),
        c("published_at").alias("source_published_at"), "previous_analyzed_at",
        F.array(F.concat(F.lit("data/generations/"), c("run_id"), F.lit("/signals/latest.json"))).alias("input_paths"),
        F.lit("data/signals/enrichment.json").alias("output_path"),
        F.array(*[F.lit(f) for f in SIGNAL_REQUIRED]).alias("required_fields"), c("enriched").alias("completed"))


def work_queue(projects: DataFrame, signals: DataFrame) -> DataFrame:
    """Pending items of both kinds by priority and id (``queue_id`` names the queue)."""
    pending = projects.filter("NOT completed").unionByName(signals.filter("NOT completed"), allowMissingColumns=True)
    order = Window.partitionBy("queue_id").orderBy(F.desc("priority"), "id")
    return pending.withColumn("position", F.row_number().over(order))


def queue_summary(projects: DataFrame, signals: DataFrame) -> DataFrame:
    both = projects.select("queue_id", "kind", "completed").unionByName(signals.select("queue_id", "kind", "completed"))
    flat = both.groupBy("queue_id").agg(
        F.count_if(~c("completed")).alias("pending_count"),
        F.count_if(~c("completed") & (c("kind") == "project")).alias("project_pending_count"),
        F.count_if(~c("completed") & (c("kind") == "signal")).alias("signal_pending_count"),
        F.count_if(c("completed") & (c("kind") == "project")).alias("completed_project_count"),
        F.count_if(c("completed") & (c("kind") == "signal")).alias("completed_signal_count"))
    return flat
