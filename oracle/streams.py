"""Checking SQL for the streaming jobs: the result of the batch definition."""

from oracle import actions, signals
from oracle.core import query

SQL: dict[str, str] = {
    "stream_dedupe_actions": query(["log"], "SELECT id, device_id, idempotency_key FROM log"),
    "stream_action_conflicts": query(["arrivals"], "SELECT id FROM arrivals WHERE fp <> project_slug OR fa <> action"),
    "stream_action_state": actions.SQL["action_state"],
    "stream_weekly_metrics": actions.SQL["weekly_action_metrics"],
    "stream_signals": query(["sig_merged"], "SELECT run_id, url_key, score, arrivals, kind, title, id, sources FROM sig_merged"),
    "stream_decisions": actions.SQL["decision_events"],
    "write_generation": query(["log", "state"], """
SELECT 'g1' AS generation_id, 'actions' AS table_name, count(*) AS n FROM log UNION ALL SELECT 'g1', 'states', count(*) FROM state"""),
    "generation_verdicts": query(["log"], """
SELECT v.* EXCLUDE (n_log, n_state), t.table_name, CASE WHEN t.table_name = 'actions' THEN v.n_log ELSE v.n_state END AS row_count FROM (
  SELECT 'g1' AS generation_id, 0 AS error_count, TRUE AS accepted, FALSE AS current, count(*) AS n_log, count(DISTINCT (device_id, project_slug)) AS n_state FROM log WHERE id % 2 = 0
  UNION ALL SELECT 'g2', (SELECT count(*) FROM log WHERE id % 2 = 0 AND (id % 500 = 6 OR (id % 400 = 8 AND action <> 'opened'))), FALSE, FALSE, count(*), count(DISTINCT (device_id, project_slug)) FROM log WHERE id % 500 <> 6
  UNION ALL SELECT 'g3', 0, TRUE, TRUE, count(*), count(DISTINCT (device_id, project_slug)) FROM log) v, (VALUES ('actions'), ('states')) t(table_name)"""),
    "read_current_generation": query(["log"], "SELECT 'g3' AS generation_id, id, device_id, project_slug, action, at_us FROM log"),
}
assert signals.SQL  # defines sig_merged
