"""Registered queries for the streaming jobs and the generation writer."""

import os
import uuid

from pyspark.sql import functions as F

from beaconry.operators import actions as A
from beaconry.plans.common import Tables, joined, shared_dir
from beaconry.sources.streams import stream
from beaconry.sources.writers import manifest, read_current, write_generation
from beaconry.streaming import jobs as J


def work_dir(t: Tables, name: str) -> str:
    """A new folder for this run under the shared folder."""
    root = shared_dir(t.spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def actions(t: Tables):
    return stream(t.spark, t.sf_dir, "events", "action_events")


def judged(t: Tables):
    """The accepted log and the conflicts of one run of the stream."""
    return J.stream_dedupe_actions(actions(t), work_dir(t, "dedupe"))


def action_state(t: Tables):
    work = work_dir(t, "dedupe")
    J.stream_dedupe_actions(actions(t), work)
    log = t.spark.readStream.schema(f"{J.ACTION_LOG}, batch_id BIGINT").parquet(f"{work}/log")
    return J.stream_action_state(log, work_dir(t, "state"))


def weekly_metrics(t: Tables):
    """Weeks of the accepted log; all its files are one batch here or many, so nothing counts as late."""
    work = work_dir(t, "dedupe")
    J.stream_dedupe_actions(actions(t), work)
    log = t.spark.readStream.schema(f"{J.ACTION_LOG}, batch_id BIGINT").parquet(f"{work}/log")
    return J.stream_weekly_metrics(log, work_dir(t, "weeks"))


def written_generations(t: Tables) -> str:
    """Three generations of the accepted log and its states: its first half, a log that was tampered with, the whole log.

    Each must only append to what was accepted before.
    """
    root = work_dir(t, "generations")
    log = t.once("recorded_log", lambda: A.recorded_actions(t.action_events))
    none = log.limit(0)
    half = log.filter("id % 2 = 0")
    altered = log.withColumn("action", F.when(F.col("id") % 400 == 8, "opened").otherwise(F.col("action"))).filter("id % 500 <> 6")
    for name, rows, time in (("g1", half, 1), ("g2", altered, 2), ("g3", log, 3)):
        before = read_current(t.spark, root, "actions", log.schema).drop("generation_id")
        issues = A.append_only_check(before if name != "g1" else none, rows)
        write_generation({"actions": rows, "states": A.action_state(rows)}, name, root, issues, time)
    return root


def generation(t: Tables):
    """Write the accepted log and states as one generation, twice as by a retry, and read the current one back."""
    root = work_dir(t, "generation")
    log = t.once("recorded_log", lambda: A.recorded_actions(t.action_events))
    tables = {"actions": log, "states": A.action_state(log)}
    for _ in range(2):
        write_generation(tables, "g1", root, A.append_only_check(log.limit(0), log), 1)
    parts = [read_current(t.spark, root, name, rows.schema).groupBy("generation_id").agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
             for name, rows in tables.items()]
    return parts[0].unionByName(parts[1])


def generation_manifest(t: Tables):
    """The verdicts over all generations that were written."""
    return manifest(t.spark, written_generations(t)).select("generation_id", "table_name", "row_count", "error_count", "accepted", "current")


def current_actions(t: Tables):
    """The log of the current generation: the refused one changes nothing."""
    root = written_generations(t)
    schema = t.once("recorded_log", lambda: A.recorded_actions(t.action_events)).schema
    return read_current(t.spark, root, "actions", schema).select("generation_id", "id", "device_id", "project_slug", "action", "at_us")


QUERIES = {
    "stream_dedupe_actions": lambda t: judged(t)[0].select("id", "device_id", "idempotency_key"),
    "stream_action_conflicts": lambda t: judged(t)[1].select("id"),
    "stream_action_state": action_state,
    "stream_weekly_metrics": weekly_metrics,
    "stream_signals": lambda t: J.stream_signals(stream(t.spark, t.sf_dir, "pages", "signals_raw"), work_dir(t, "signals")).select(
        "run_id", "url_key", "score", "arrivals", "kind", "title", "id", joined("sources")),
    "stream_decisions": lambda t: J.stream_decisions(stream(t.spark, t.sf_dir, "events", "feedback_changes"), work_dir(t, "decisions")).select(
        "id", "device_id", "project_slug", "value", "at_us"),
    "write_generation": generation,
    "generation_verdicts": generation_manifest,
    "read_current_generation": current_actions,
}
