"""Action log and feedback for all devices: acceptance, replay handling, state, metrics, change log.

No step sorts a whole device or key.  First arrivals come from aggregates joined back on the key, and change
detection looks inside day buckets first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import (
    ACTION_STAGES, FEEDBACK_VALUES, IDEMPOTENCY_PATTERN, LEGACY_MATCH_MICROS, RESERVED_KEY_PREFIX)
from beaconry.operators.skew import exact_position, previous_value

c = F.col
DAY_US = 86_400_000_000


def stage_rank(action: Column) -> Column:
    chain = None
    for i, name in enumerate(ACTION_STAGES, 1):
        chain = F.when(action == name, i) if chain is None else chain.when(action == name, i)
    return chain.otherwise(0)


def accept_actions(requests: DataFrame, known: DataFrame) -> DataFrame:
    """First failing check per submitted action, or null when accepted."""
    projects = known.select("project_slug", F.lit(True).alias("_known"))
    rows = requests.join(projects, "project_slug", "left")
    device, key = F.trim("device_id"), F.trim("idempotency_key")
    reason = (
        F.when((device == "") | device.isNull() | (F.length(device) > 200), "invalid_device")
        .when(c("_known").isNull(), "unknown_project")
        .when(~F.coalesce(c("action").isin(ACTION_STAGES), F.lit(False)), "invalid_action")
        .when(~F.coalesce(key.rlike(IDEMPOTENCY_PATTERN), F.lit(False)), "invalid_key")
        .when(key.startswith(RESERVED_KEY_PREFIX), "reserved_key")
        .when(c("has_client_time"), "client_time_refused"))
    return rows.withColumn("reason", reason).drop("_known")


def dedupe_actions(events: DataFrame) -> DataFrame:
    """Status per arrival: the first of a (device, key) is recorded, later ones replay it or conflict."""
    keys = ["device_id", "idempotency_key"]
    first = events.groupBy(*keys).agg(F.min_by(F.struct("id", "project_slug", "action"), F.struct("at_us", "id")).alias("_f"))
    status = (F.when(c("id") == c("_f.id"), "recorded")
              .when((c("project_slug") == c("_f.project_slug")) & (c("action") == c("_f.action")), "replayed").otherwise("conflict"))
    return events.join(first, keys).withColumn("status", status).drop("_f")


def recorded_actions(events: DataFrame) -> DataFrame:
    """The accepted log alone: one aggregate, no join back."""
    kept = [x for x in events.columns if x not in ("device_id", "idempotency_key")]
    return (events.groupBy("device_id", "idempotency_key").agg(F.min_by(F.struct(*kept), F.struct("at_us", "id")).alias("_f"))
            .select("device_id", "idempotency_key", "_f.*"))


def action_state(log: DataFrame) -> DataFrame:
    """Highest stage and latest time per stage for every (device, project)."""
    rank = F.max(stage_rank(c("action")))
    return log.groupBy("device_id", "project_slug").agg(
        rank.alias("_rank"), *[F.max(F.when(c("action") == a, c("at_us"))).alias(f"{a}_us") for a in ACTION_STAGES],
        F.max("at_us").alias("updated_us")).withColumn(
        "highest_stage", F.element_at(F.array(*[F.lit(a) for a in ACTION_STAGES]), c("_rank"))).drop("_rank")


def action_projection(state: DataFrame) -> DataFrame:
    """One row per reached stage."""
    wide = state.select("device_id", "project_slug", *[c(f"{a}_us").alias(a) for a in ACTION_STAGES])
    return wide.unpivot(["device_id", "project_slug"], ACTION_STAGES, "action", "at_us").filter("at_us IS NOT NULL")


def state_order(state: DataFrame) -> DataFrame:
    """States of each device, newest first, then by project; day by day, so no task sorts a whole device."""
    day = F.floor(c("updated_us") / DAY_US).cast("bigint")
    return exact_position(state, ["device_id"], [F.desc("updated_us"), "project_slug"], [day], [F.desc("_b0")])


def weekly_action_metrics(log: DataFrame, as_of: DataFrame) -> DataFrame:
    """Distinct projects per device in [as_of - 7 d, as_of], for every as-of instant of a calendar.

    Events and as-of instants meet on day numbers: each as-of instant is spread over the eight days it can
    see, so the calendar join is an equi-join with an exact filter on top and the log is not multiplied first.
    """
    day = F.floor(c("as_of_us") / DAY_US).cast("bigint")
    marks = as_of.select("as_of_us", F.explode(F.sequence(day - 7, day)).alias("_day"))
    hits = (log.withColumn("_day", F.floor(c("at_us") / DAY_US).cast("bigint")).join(marks, "_day")
            .filter((c("at_us") >= c("as_of_us") - 7 * DAY_US) & (c("at_us") <= c("as_of_us"))))
    # Projects first: one row per (device, as_of, project) with flags, then plain counts.
    per_project = hits.groupBy("device_id", "as_of_us", "project_slug").agg(
        *[F.bool_or(c("action") == a).alias(a) for a in ACTION_STAGES])
    acted = c("tried") | c("cloned") | c("reused")
    return per_project.groupBy("device_id", "as_of_us").agg(
        F.count_if(acted).alias("acted_projects"), *[F.count_if(c(a)).alias(f"{a}_projects") for a in ACTION_STAGES])


def migrate_legacy_actions(legacy: DataFrame, log: DataFrame) -> DataFrame:
    """Legacy rows without an event of the same action within 2 ms become events.

    Time slots as wide as the tolerance are part of the key, so a busy (device, project, action) never
    compares all its rows with each other.
    """
    slot = F.floor(c("at_us") / LEGACY_MATCH_MICROS)
    have = log.select("device_id", "project_slug", "action", c("at_us").alias("_at"),
                      F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    rows = legacy.withColumn("_slot", slot)
    keys = ["device_id", "project_slug", "action", "_slot"]
    match = reduce(lambda a, b: a & b, [rows[k] == have[k] for k in keys])
    near = F.abs(rows["at_us"] - have["_at"]) < LEGACY_MATCH_MICROS
    return (rows.join(have, match & near, "left_anti").drop("_slot")
            .withColumn("idempotency_key", F.concat(F.lit(RESERVED_KEY_PREFIX), c("id").cast("string"))))


def legacy_projection(log: DataFrame) -> DataFrame:
    """Latest event per (device, project, action) in the old text format."""
    return log.groupBy("device_id", "project_slug", "action").agg(F.max("at_us").alias("at_us")).withColumn(
        "created_at", F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd HH:mm:ss.SSS")).drop("at_us")


def append_only_check(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old log that changed or vanished, and identities used twice in the new one."""
    body = ["device_id", "project_slug", "action", "at_us", "idempotency_key"]
    a = old.select("id", F.struct(*body).alias("_old"))
    b = new.select("id", F.struct(*body).alias("_new"))
    changed = (a.join(b, "id", "left").withColumn("code", (
        F.when(c("_new").isNull(), "deleted_event").when(~c("_old").eqNullSafe(c("_new")), "changed_event")))
        .filter("code IS NOT NULL").select("code", c("id").cast("string").alias("key")))
    reused = (new.groupBy("device_id", "idempotency_key").agg(F.count("*").alias("n")).filter("n > 1")
              .select(F.lit("reused_identity").alias("code"), F.concat_ws(" ", "device_id", "idempotency_key").alias("key")))
    twice = new.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("reused_id").alias("code"), c("id").cast("string").alias("key"))
    return changed.unionByName(reused).unionByName(twice)


def decision_events(changes: DataFrame) -> DataFrame:
    """First value and every changed value per (device, project)."""
    rows = previous_value(changes, ["device_id", "project_slug"], F.floor(c("at_us") / DAY_US), ["at_us", "id"], "value")
    return rows.filter(c("previous").isNull() | (c("previous") != c("value"))).drop("previous")


def feedback_current(changes: DataFrame) -> DataFrame:
    """Current value per (device, project); the time moves only when the value does."""
    decided = decision_events(changes)
    return decided.groupBy("device_id", "project_slug").agg(
        F.max_by("value", F.struct("at_us", "id")).alias("value"), F.max("at_us").alias("updated_us"))


def feedback_counts(current: DataFrame) -> DataFrame:
    """Projects per value and device, zero-filled."""
    wide = current.groupBy("device_id").pivot("value", FEEDBACK_VALUES).agg(F.count(F.lit(1))).na.fill(0, FEEDBACK_VALUES)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [c(v) for v in FEEDBACK_VALUES]))


def weekly_decisions(decided: DataFrame, as_of_us: int) -> DataFrame:
    """Decisions since as_of - 7 d: distinct useful or reuse projects, distinct reuse, all changes."""
    recent = decided.filter(c("at_us") >= as_of_us - 7 * DAY_US)
    per_project = recent.groupBy("device_id", "project_slug").agg(
        F.bool_or(c("value").isin("useful", "reuse")).alias("_e"), F.bool_or(c("value") == "reuse").alias("_r"), F.count("*").alias("_n"))
    return per_project.groupBy("device_id").agg(
        F.count_if(c("_e")).alias("effective_decisions"), F.count_if(c("_r")).alias("reuse_decisions"), F.sum("_n").alias("feedback_changes"))


def watchlist(current: DataFrame, state: DataFrame, known: DataFrame) -> DataFrame:
    """Projects marked unsure or saved, with both marks, in catalog order."""
    unsure = current.filter("value = 'unsure'").select("device_id", "project_slug", F.lit(True).alias("unsure"), F.lit(False).alias("saved"))
    saved = state.filter("saved_us IS NOT NULL").select("device_id", "project_slug", F.lit(False).alias("unsure"), F.lit(True).alias("saved"))
    marks = unsure.unionByName(saved).groupBy("device_id", "project_slug").agg(F.bool_or("unsure").alias("_u"), F.bool_or("saved").alias("_s"))
    status = F.array_compact(F.array(F.when(c("_u"), F.lit("unsure")), F.when(c("_s"), F.lit("saved"))))
    return marks.join(known.select("project_slug", "position"), "project_slug").select("device_id", "project_slug", "position", status.alias("status"))
