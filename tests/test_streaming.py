"""Streams over several files give the batch result, also after a retry of the whole run."""

from pyspark.sql import functions as F

from beaconry.operators import actions as A
from beaconry.plans.common import Tables
from beaconry.plans.stream_queries import QUERIES
from beaconry.streaming import jobs as J



def events(spark, n=240):
    i = F.col("id")
    return spark.range(n).select(
        "id", F.concat(F.lit("d"), (i % 7).cast("string")).alias("device_id"), F.concat(F.lit("p"), (i % 5).cast("string")).alias("project_slug"),
        F.element_at(F.array(*[F.lit(a) for a in A.ACTION_STAGES]), (i % 5 + 1).cast("int")).alias("action"), (i * 1000).alias("at_us"),
        F.concat(F.lit("key"), (i % 97).cast("string")).alias("idempotency_key"))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_log_and_state_match_batch(spark, tmp_path):
    rows = events(spark)
    folder = str(tmp_path / "in")
    for lo in range(0, 240, 80):  # files arrive in time order
        rows.filter(F.col("id").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(folder)
    log, conflicts = J.stream_dedupe_actions(stream(spark, folder, rows.schema), str(tmp_path / "log"))
    want = A.recorded_actions(rows)
    assert sorted(r.id for r in conflicts.collect()) == sorted(r.id for r in A.dedupe_actions(rows).filter("status = 'conflict'").collect())
    assert sorted(log.select("device_id", "idempotency_key").collect()) == sorted(want.select("device_id", "idempotency_key").collect())
    state = J.stream_action_state(stream(spark, folder, rows.schema), str(tmp_path / "state"))
    cols = ["device_id", "project_slug", "highest_stage", "updated_us"]
    assert sorted(state.select(*cols).collect()) == sorted(A.action_state(rows).select(*cols).collect())


def test_decisions_match_batch(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(150).select("id", F.lit("d").alias("device_id"), (i % 4).cast("string").alias("project_slug"),
                                   F.when(F.floor(i / 20) % 2 == 0, "useful").otherwise("reuse").alias("value"), (i * 1_000_000_000).alias("at_us"))
    folder = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(folder)
    got = J.stream_decisions(stream(spark, folder, rows.schema), str(tmp_path / "out"))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in A.decision_events(rows).collect())


def test_late_decisions_match_batch(spark, tmp_path):
    schema = "id long, device_id string, project_slug string, value string, at_us long"
    rows = [(1, "d", "p", "useful", 10), (2, "d", "p", "reuse", 30), (3, "d", "p", "useful", 20), (4, "d", "q", "reuse", 5), (5, "d", "p", "unsure", 1), (6, "e", "p", "useful", 7)]
    folder = str(tmp_path / "in")
    for row in rows:  # one file and so one batch each, the third and fifth late
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    got = J.stream_decisions(stream(spark, folder, schema), str(tmp_path / "out"))
    want = A.decision_events(spark.createDataFrame(rows, schema))
    cols = ["id", "device_id", "project_slug", "value", "at_us"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4, 5, 6]


def test_first_of_a_key_is_remembered_without_the_log(spark, tmp_path):
    schema = "id long, device_id string, project_slug string, action string, at_us long, idempotency_key string"
    batches = [[(1, "d", "p", "opened", 30, "k"), (2, "d", "q", "opened", 20, "k")], [(3, "d", "p", "opened", 10, "k"), (4, "d", "q", "opened", 90, "k"), (5, None, "p", "saved", 1, None)],
               [(6, "d", "q", "saved", 91, "k"), (7, None, "p", "saved", 2, None), (8, "e", "p", "saved", 2, "k")]]
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    log, conflicts = J.stream_dedupe_actions(stream(spark, folder, schema), str(tmp_path / "out"))
    assert sorted(r.id for r in log.collect()) == [2, 5, 8]  # the earliest of a batch, then whoever came first
    assert sorted(r.id for r in conflicts.collect()) == [1, 3, 6]


def test_weeks_over_files_with_late_rows_match_batch(spark, tmp_path):
    day = A.DAY_US
    i = F.col("id")
    rows = spark.range(400).select(
        "id", F.concat(F.lit("d"), (i % 3).cast("string")).alias("device_id"), F.concat(F.lit("p"), (i * 7 % 11).cast("string")).alias("project_slug"),
        F.element_at(F.array(*[F.lit(a) for a in A.ACTION_STAGES]), (i * 3 % 5 + 1).cast("int")).alias("action"),
        # Days with gaps, some events at midnight itself; every fifth row comes three days late, twelve across a gap.
        ((F.floor(i / 12) + F.floor(i / 100) * 9 + 19_000) * day + F.when(i % 8 == 0, 0).otherwise(i % 12 * 7_000_000)).alias("at_us"), F.concat(F.lit("key"), i.cast("string")).alias("idempotency_key"))
    arrival = F.floor((i + F.when(i % 5 == 0, 36).otherwise(0)) / 20)
    folder = str(tmp_path / "in")
    parts = sorted({r.k for r in rows.select(arrival.alias("k")).collect()})
    for k in parts:
        rows.filter(arrival == k).coalesce(1).write.mode("append").parquet(folder)
    assert len(parts) > 18  # more batches than one fold takes
    got = J.stream_weekly_metrics(stream(spark, folder, rows.schema), str(tmp_path / "out"), late_days=12)
    calendar = rows.select((F.floor(F.col("at_us") / day) * day).cast("bigint").alias("as_of_us")).distinct()
    want = A.weekly_action_metrics(rows, calendar)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and want.count() > 60


def test_weeks_keep_a_row_per_day_and_count_blanks(spark, tmp_path):
    """An event is kept as one row of its day, not as a row of each midnight and flag that see it."""
    day = A.DAY_US
    schema = "id long, device_id string, project_slug string, action string, at_us long, idempotency_key string"
    first = [(i, f"d{i % 2}", f"p{i % 3}", A.ACTION_STAGES[i % 5], (20_000 + i % 12) * day + (0 if i % 4 == 0 else 5), "k") for i in range(90)]
    first += [(90, "d0", None, "saved", 20_003 * day + 5, "k"), (91, "d1", "p1", None, 20_004 * day + 5, "k"), (92, None, "p1", "saved", 20_030 * day + 5, "k"),
              (93, "d2", "p1", "tried", 20_029 * day + 5, "k"), (94, "d0", "p1", "saved", None, "k")]
    second = [(95, "d0", "p0", "cloned", 20_020 * day, "k"), (96, "d0", "p0", "cloned", 20_019 * day, "k")]  # the newest is 20,030, eleven days are allowed
    folder = str(tmp_path / "in")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    got = J.stream_weekly_metrics(stream(spark, folder, schema), str(tmp_path / "out"))
    kept = [r for r in first + second[:1] if r[4] is not None]
    marks = {r[4] // day for r in kept} | {m for r in kept if r[1] is None for m in range(r[4] // day + 1, r[4] // day + 8)}
    want = set()
    for device in {r[1] for r in kept} - {None}:
        for mark in marks:
            seen = [r for r in kept if r[1] == device and (mark - 7) * day <= r[4] <= mark * day]
            if seen:
                flags = [[a] for a in A.ACTION_STAGES] + [["tried", "cloned", "reused"]]
                want.add((device, mark * day, *[len({r[2] for r in seen if r[3] in f}) for f in flags]))
    assert {tuple(r) for r in got.select("device_id", "as_of_us", *[f"{f}_projects" for f in J.WEEK_FLAGS]).collect()} == want
    parts = spark.read.parquet(str(tmp_path / "out" / "days" / "batches"))
    assert parts.count() == len({(r[1], r[2], r[4] // day, r[4] % day == 0) for r in kept})


def test_firsts_are_kept_without_python(spark, tmp_path):
    """The state is one streaming aggregate; a Python call for every key does not scale."""
    rows = events(spark, 40)
    folder = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(folder)
    plan = J.with_firsts(stream(spark, folder, rows.schema))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan
    twins = spark.createDataFrame([(1, "d", "p", "saved", 5, "k")] * 3 + [(2, "d", None, "saved", 6, "k"), (3, None, None, "saved", 6, None), (4, None, None, "saved", 7, None)], rows.schema)
    other = str(tmp_path / "twins")
    for part in (twins, twins.filter("id < 3")):  # equal rows in one batch, then all of a key again
        part.coalesce(1).write.mode("append").parquet(other)
    log, conflicts = J.stream_dedupe_actions(stream(spark, other, rows.schema), str(tmp_path / "out"))
    assert sorted(r.id for r in log.collect()) == [1, 3] and sorted(r.id for r in conflicts.collect()) == [2, 2]


def test_signals_of_a_table_that_is_a_folder_and_of_none(spark, tmp_path):
    rows = spark.range(1, 240).selectExpr("id AS page_id", "concat('https://example.org/', id) AS url", "concat('<title>Agent release ', id, '</title>') AS html")
    merged = {}
    for name, frames in {"one": [rows], "many": [rows.filter("page_id % 3 = 0"), rows.filter("page_id % 3 <> 0")], "none": [rows.limit(0)]}.items():
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "pages.parquet"))
        merged[name] = sorted(map(str, QUERIES["stream_signals"](Tables(spark, str(tmp_path / name))).collect()))
    assert merged["one"] == merged["many"] and len(merged["one"]) > 100 and merged["none"] == []
