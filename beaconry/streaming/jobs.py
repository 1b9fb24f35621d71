"""Streaming twins of the action, decision and signal jobs.

Each micro-batch writes its own ``batch_id`` partition and replaces it on a retry, so a restarted query neither
loses nor repeats rows.  Readers see the union of the partitions, or the newest fold of them and what came after it.
What a job must remember of earlier batches is in the state store or in such parts, not in the log.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.operators import actions as A
from beaconry.operators import signals as S
from beaconry.operators.skew import task_count

c = F.col
ACTION_LOG = "id BIGINT, device_id STRING, project_slug STRING, action STRING, at_us BIGINT, idempotency_key STRING"
DECISIONS = "id BIGINT, device_id STRING, project_slug STRING, value STRING, at_us BIGINT"


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of earlier batches (all of them when ``before`` is None)."""
    rows = spark.read.schema(f"{schema}, batch_id BIGINT").option("ignoreMissingFiles", "true").parquet(path)
    return (rows if before is None else rows.filter(c("batch_id") < before)).drop("batch_id")


def _save(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def _ensure(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table to read before the first batch."""
    (spark.createDataFrame([], f"{schema}, batch_id BIGINT").write.mode("append").partitionBy("batch_id").parquet(path))


def read_folded(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest fold below ``path`` and the batches after it; earlier parts are of no more use."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/folds")
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName().split("=")[1]) for f in system.listStatus(files) if system.exists(f.getPath().suffix("/_SUCCESS"))] if system.exists(files) else []
    upto = max((n for n in done if before is None or n < before), default=None)
    recent = spark.read.schema(f"{schema}, batch_id BIGINT").option("ignoreMissingFiles", "true").parquet(f"{path}/batches") if system.exists(files.getParent().suffix("/batches")) \
        else spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    recent = recent if upto is None else recent.filter(c("batch_id") > upto)
    recent = (recent if before is None else recent.filter(c("batch_id") < before)).drop("batch_id")
    return recent if upto is None else recent.unionByName(spark.read.schema(schema).parquet(f"{path}/folds/upto={upto}"))


def save_folded(rows: DataFrame, path: str, schema: str, batch_id: int, combine: Callable[[DataFrame], DataFrame], every: int = 16) -> None:
    """Write a batch's part; every so many batches, combine all parts so far into a fold that replaces them for readers."""
    _save(rows.select(*[f.split()[0] for f in schema.split(", ")]), f"{path}/batches", batch_id)
    if batch_id % every == every - 1:
        folded = combine(read_folded(rows.sparkSession, path, schema, batch_id + 1))
        folded.select(*[f.split()[0] for f in schema.split(", ")]).write.mode("overwrite").parquet(f"{path}/folds/upto={batch_id}")


def run_available(stream: DataFrame, work: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that is available and stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{work}/offsets")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


_LOG_COLUMNS = [f.split()[0] for f in ACTION_LOG.split(", ")]


KEY = ["device_id", "idempotency_key"]


def with_firsts(events: DataFrame) -> DataFrame:
    """The events of a batch, and for each of their keys one row with ``first``, ``since`` and ``seen``.

    A streaming aggregate keeps the project and action of each key's first event, by the time of the batch it came in and then
    by its own; ``since`` is the time of that batch and ``seen`` that of the newest one.  Batch times are logged with the
    offsets, so a retry sees the same; they have to rise.
    """
    rows = events.select(*_LOG_COLUMNS).withColumn("_batch", F.current_timestamp())
    order = F.struct("_batch", c("at_us").isNull(), "at_us", c("id").isNull(), "id", "project_slug", "action")
    firsts = rows.groupBy(*KEY).agg(F.min_by(F.struct("project_slug", "action"), order).alias("first"), F.min("_batch").alias("since"), F.max("_batch").alias("seen"))
    return rows.drop("_batch").unionByName(firsts, allowMissingColumns=True)


def with_status(rows: DataFrame) -> DataFrame:
    """``status`` of the events in the rows of ``with_firsts``: recorded, replayed or conflict."""
    whole = Window.partitionBy(*KEY)
    events_first = whole.orderBy(c("since").isNotNull(), F.asc_nulls_last("at_us"), F.asc_nulls_last("id"), "project_slug", "action")
    rows = rows.withColumns({"_n": F.row_number().over(events_first), "_new": F.max(c("since") == c("seen")).over(whole), "_first": F.max("first").over(whole)})
    same = c("project_slug").eqNullSafe(c("_first.project_slug")) & c("action").eqNullSafe(c("_first.action"))
    status = F.when((c("_n") == 1) & c("_new"), "recorded").when(same, "replayed").otherwise("conflict")
    return rows.filter("since IS NULL").select(*_LOG_COLUMNS, status.alias("status"))


def stream_dedupe_actions(events: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """Accepted log and conflicts: the first event of every (device, key) is accepted, one that differs from it conflicts.

    The state store keeps the first project and action of each key, so a batch costs what its own events cost and the
    log is never read.  Among events of one batch the earliest is first, across batches the one that came first.
    """
    spark = events.sparkSession
    paths = {"recorded": f"{work}/log", "conflict": f"{work}/conflicts"}
    for path in paths.values():
        _ensure(spark, path, ACTION_LOG)

    def save(batch: DataFrame, batch_id: int) -> None:
        judged = with_status(batch).persist()
        for status, path in paths.items():
            _save(judged.filter(c("status") == status).drop("status"), path, batch_id)
        judged.unpersist()

    run_available(with_firsts(events), work, save, "update")
    return stored(spark, paths["recorded"], ACTION_LOG), stored(spark, paths["conflict"], ACTION_LOG)


def dedupe_within_watermark(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Variant with bounded state: replays later than the delay count as new."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["device_id", "idempotency_key"])


STATE = ("device_id STRING, project_slug STRING, opened_us BIGINT, saved_us BIGINT, tried_us BIGINT, cloned_us BIGINT, reused_us BIGINT, "
         "updated_us BIGINT, highest_stage STRING")


def stream_action_state(log: DataFrame, work: str) -> DataFrame:
    """Running state per (device, project): every field is a maximum, so partial states simply combine."""
    spark, path = log.sparkSession, f"{work}/state"
    times = [f"{a}_us" for a in A.ACTION_STAGES] + ["updated_us"]

    def combined(parts: DataFrame) -> DataFrame:
        return parts.groupBy("device_id", "project_slug").agg(
            *[F.max(n).alias(n) for n in times], F.max_by("highest_stage", A.stage_rank(c("highest_stage"))).alias("highest_stage"))

    run_available(log, work, lambda batch, batch_id: save_folded(A.action_state(batch), path, STATE, batch_id, combined))
    return combined(read_folded(spark, path, STATE))


WEEK_FLAGS = [*A.ACTION_STAGES, "acted"]
DAYS = "device_id STRING, project_slug STRING, day BIGINT, at_midnight BOOLEAN, flags INT"
NEWEST = "day BIGINT"
WEEK_BLOCK = 28  # days; a device's weeks are counted in blocks of so many


def _whole_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_id", "project_slug", "day", "at_midnight").agg(F.bit_or("flags").alias("flags"))


def day_flags(events: DataFrame) -> DataFrame:
    """Each (device, project, day) once with its flags, the actions and ``acted``, as bits; events at midnight are apart."""
    held = [c("action") == a for a in A.ACTION_STAGES] + [c("action").isin("tried", "cloned", "reused")]
    flags = reduce(lambda x, y: x + y, [F.when(h, 1 << i).otherwise(0) for i, h in enumerate(held)])
    day = F.floor(c("at_us") / A.DAY_US).cast("bigint")
    return _whole_days(events.filter("at_us IS NOT NULL").select(
        "device_id", "project_slug", day.alias("day"), (c("at_us") % A.DAY_US == 0).alias("at_midnight"), flags.alias("flags")))


def week_counts(days: DataFrame) -> DataFrame:
    """Distinct projects per device, midnight and flag in the closed seven days before each midnight that sees an event.

    A row moves once to each block of midnights that it reaches into, at most two, and marks its midnights there as bits.  Bits of
    a project combine, so a midnight is a row only after that and none is shuffled; a busy device is a task per block.
    """
    first, last = c("day") + F.when(c("at_midnight"), 0).otherwise(1), c("day") + 7
    blocks = F.array_distinct(F.array(*[F.floor(m / WEEK_BLOCK).cast("bigint") for m in (first, last)]))
    rows = (days.select("device_id", "project_slug", "flags", first.alias("_first"), last.alias("_last"), F.explode(blocks).alias("_block"))
            .repartition(task_count(days.sparkSession), "device_id", "_block"))
    start = c("_block") * WEEK_BLOCK
    low, high = F.greatest("_first", start) - start, F.least("_last", start + (WEEK_BLOCK - 1)) - start
    rows = rows.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int"))
    seen = F.expr("shiftleft(1, _high + 1) - shiftleft(1, _low)")
    masks = {f: F.bit_or(F.when(c("flags").bitwiseAND(1 << i) != 0, seen).otherwise(0)) for i, f in enumerate(WEEK_FLAGS)}
    projects = rows.groupBy("device_id", "_block", "project_slug").agg(F.bit_or(seen).alias("_any"), *[m.alias(f) for f, m in masks.items()])
    each = projects.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(WEEK_BLOCK - 1)))).filter("shiftright(_any, _k) & 1 = 1")
    counts = each.groupBy("device_id", "_block", "_k").agg(*[F.sum(F.expr(f"shiftright({f}, _k) & 1")).alias(f"{f}_projects") for f in WEEK_FLAGS])
    return counts.withColumn("as_of_us", (start + c("_k")) * A.DAY_US).drop("_block", "_k")


def stream_weekly_metrics(events: DataFrame, work: str, late_days: int = 3) -> DataFrame:
    """Exact distinct projects per device in the closed seven days before each midnight of a day with events.

    A batch is reduced to its days, and days of batches combine, so a batch costs what its own events cost and a midnight is
    counted when it is read, also while its week is open.  Events more than ``late_days`` and eight days older than the newest
    of earlier batches are left out.  Events without a device count for none, but the midnights that see them are shown.
    """
    spark = events.sparkSession
    path, seen = f"{work}/days", f"{work}/newest"

    def newest(rows: DataFrame) -> DataFrame:
        return rows.agg(F.max("day").alias("day"))

    def save(batch: DataFrame, batch_id: int) -> None:
        last = newest(read_folded(spark, seen, NEWEST, batch_id)).first()["day"]
        rows = day_flags(batch)
        if last is not None:
            rows = rows.filter(c("day") > last - late_days - 8)
        save_folded(rows, path, DAYS, batch_id, _whole_days)
        saved = spark.read.schema(f"{DAYS}, batch_id BIGINT").parquet(f"{path}/batches").filter(c("batch_id") == batch_id)
        save_folded(newest(saved), seen, NEWEST, batch_id, newest)

    run_available(events, work, save)
    days = read_folded(spark, path, DAYS)
    marks = days.select("day").union(days.filter("device_id IS NULL").select(
        F.explode(F.sequence(c("day") + F.when(c("at_midnight"), 0).otherwise(1), c("day") + 7))))
    shown = marks.distinct().select((c("day") * A.DAY_US).alias("as_of_us"))
    rows = week_counts(days.filter("device_id IS NOT NULL")).select("device_id", "as_of_us", *[f"{f}_projects" for f in WEEK_FLAGS])
    return rows.join(shown, "as_of_us", "left_semi")


def stream_signals(raw: DataFrame, work: str) -> DataFrame:
    """Signals inside their window, merged by URL over all batches."""
    spark, path = raw.sparkSession, f"{work}/partials"

    def partial(rows: DataFrame) -> DataFrame:
        return S.partial_merge(S.with_score(S.signal_window(rows)))

    empty = spark.createDataFrame([], raw.schema)
    schema = partial(empty).schema
    _save(partial(empty), path, -1)  # there is a table to read when no batch came
    run_available(raw, work, lambda batch, batch_id: _save(partial(batch), path, batch_id))
    return S.final_merge(spark.read.schema(schema).parquet(path))


def stream_decisions(changes: DataFrame, work: str) -> DataFrame:
    """First values and changed values in the order of time, also when changes arrive late.

    The changes are kept.  A batch decides the keys that it touches anew from all their changes, since a late one may
    turn a later decision into a repetition; of each key the rows of the newest batch that touched it count.
    """
    spark, log, path = changes.sparkSession, f"{work}/changes", f"{work}/decisions"
    _ensure(spark, log, DECISIONS)
    _ensure(spark, path, DECISIONS)
    keys = ["device_id", "project_slug"]

    def decide(batch: DataFrame, batch_id: int) -> None:
        _save(batch.select("id", *keys, "value", "at_us"), log, batch_id)
        known = stored(batch.sparkSession, log, DECISIONS, batch_id + 1)
        touched = known.join(batch.select(*keys).distinct(), keys, "left_semi")
        _save(A.decision_events(touched).select("id", *keys, "value", "at_us"), path, batch_id)

    run_available(changes, work, decide)
    rows = spark.read.schema(f"{DECISIONS}, batch_id BIGINT").parquet(path)
    newest = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id")
