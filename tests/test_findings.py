"""Audit findings: seeded faults are named by row and value, and agree with the counting audit."""

from beaconry.operators import audit as A
from beaconry.operators import findings as D

STATUS = "generation_id string, query string, state string, item_count long, error string"
HEADS = ("generation_id string, queries_is_list boolean, status_is_list boolean, status_non_objects int, successful_query_count long, "
         "failed_query_count long, query_failure_count long")


def found(frame):
    return sorted((r.generation_id, r.scope, r.code, r.key, r.detail) for r in frame.collect())


def pairs(frame):
    return {(r.generation_id, r.severity, r.code) for r in frame.collect()}


def test_query_health(spark):
    heads = spark.createDataFrame([("a", True, True, 0, 2, 1, 1), ("b", False, True, 3, None, 0, 0), ("c", True, True, 0, 0, 0, 0)], HEADS)
    rules = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("a", "q2"), ("b", "q1"), ("zz", "q9")], "generation_id string, query string")
    status = spark.createDataFrame([("a", "q1", "healthy", 4, "odd"), ("a", "q2", "failed", -1, " "), ("b", "q1", None, None, None), ("a", "q3", "healthy", 1, None)], STATUS)
    got = D.query_health(heads, rules, status)
    assert got.columns == D.COLUMNS
    rows = found(got)
    assert ("a", "queries", "invalid_query_definition", "q2", "declared 2 times") in rows
    assert ("a", "queries", "query_status_coverage_mismatch", "q3", "declared 0 times, reported 1") in rows
    assert ("a", "query_status", "invalid_query_error", "q1", "healthy: odd") in rows
    assert ("a", "query_status", "partial_query_failure", "q2", " ") in rows
    assert ("b", "query_status", "invalid_query_state", "q1", "null") in rows
    assert ("b", "header", "successful_query_count_mismatch", "successful_query_count", "declared null, found 0") in rows
    assert not [r for r in rows if r[0] == "zz"]
    counted = A.audit_query_health(heads, rules, status)
    assert pairs(got) == {p for p in pairs(counted) if p[0] != "zz"}
    row_codes = {"invalid_query_state", "invalid_query_item_count", "invalid_query_error", "partial_query_failure"}
    per_code = {(r.generation_id, r.code): r.n for r in D.counted(got).collect() if r.code in row_codes}
    assert per_code == {(r.generation_id, r.code): r.n for r in counted.collect() if r.code in row_codes}
    assert found(D.query_health(heads.limit(0), rules.limit(0), status.limit(0))) == []


def test_keys_and_times(spark):
    empty = spark.createDataFrame([], "generation_id string, repository string, schema_version int")
    snapshot = spark.createDataFrame([("a", "x/y"), ("a", "x/y"), ("a", None), ("b", "x/y")], "generation_id string, repo string")
    ids = spark.createDataFrame([], "generation_id string, repo string, slug string, project_id string, id string, url string")
    got = found(D.uniqueness(snapshot, ids, empty, empty, ids, ids, ids))
    assert got == [("a", "snapshot", "duplicate_snapshot_repository", "", "1 rows"), ("a", "snapshot", "duplicate_snapshot_repository", "x/y", "2 rows")]
    heads = spark.createDataFrame([("a", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", None, "soon")],
                                  "generation_id string, snapshot_at string, catalog_at string, signals_at string, queue_at string")
    assert found(D.times(heads)) == [
        ("a", "catalog", "catalog_snapshot_mismatch", "catalog_at", "2024-01-01T00:00:00Z, snapshot at 2024-01-02T00:00:00Z"),
        ("a", "queue", "invalid_queue_time", "queue_at", "soon"), ("a", "signals", "invalid_signal_time", "signals_at", "null")]
    assert pairs(D.times(heads)) == pairs(A.audit_times(heads))


def test_compared_names_columns(spark):
    schema = "generation_id string, id string, kind string, score double, more string"
    a = spark.createDataFrame([("g", "1", "p", 1.0, "m"), ("g", "2", None, 2.0, "m"), ("g", "3", "p", 3.0, "m"), ("h", "1", None, None, "m")], schema)
    b = spark.createDataFrame([("g", "1", "q", 1.5, "n"), ("g", "2", None, 2.0, "n"), ("g", "4", "p", 3.0, "n"), ("h", "1", None, None, "n")], schema)
    got = sorted((r.generation_id, r.key, r.change) for r in D.compared(a, b, "id", ["kind", "score"]).collect())
    assert got == [("g", "1", "differs: kind, score"), ("g", "3", "only recorded"), ("g", "4", "only rebuilt")]


def test_stale_queue_of_a_run_without_capture(spark):
    items = "generation_id string, id string, kind string, repository string, completed boolean"
    rebuilt = spark.createDataFrame([("r", "1", "signal", None, False), ("r", "2", "signal", None, True)], items)
    queue = spark.createDataFrame([("r", "1", "idea", None)], "generation_id string, id string, kind string, repository string")
    heads = spark.createDataFrame([("r", 0, 1, "")], "generation_id string, completed_project_count long, completed_signal_count long, pending_deep string")
    catalog = spark.createDataFrame([], "generation_id string, repo string, position int, analysis_state string")
    assert found(D.queue_rebuild(heads, queue, rebuilt, catalog, ["id", "kind", "repository"])) == [
        ("r", "queue", "invalid_queue_kind", "1", "idea"), ("r", "queue", "stale_queue_items", "1", "differs: kind")]
