"""Checking SQL for the work queue, the action log and feedback."""

from beaconry.constants import ACTION_STAGES, FEEDBACK_VALUES
from beaconry.operators.queue import PROJECT_REQUIRED, SIGNAL_REQUIRED
from oracle.catalog import project_id
from oracle.core import cte, query, us

SQL: dict[str, str] = {}
_req = ["title", "summary", "category", "best_for", "reuse_plan", "limitation", "evidence_summary", "source_url", "repository",
        "source_pushed_at", "source_analysis_at", "analyzed_at", "project_id"]
_complete = " AND ".join(f"coalesce(n.{f}, '') <> ''" for f in _req) + " AND len(n.capabilities) > 0 AND len(n.task_terms) > 0 AND n.project_id_version IS NOT NULL"
cte("pq0", ["catalog_rows", "evidence_one", "profile_one"], f"""
SELECT c.capture_id, c.position, c.repo, c.title, c.pushed_at, {project_id('c.repo')} AS pid, e.analyzed_at AS source_analysis_at, n.analyzed_at AS previous_analyzed_at,
  coalesce({_complete}, false) AS complete,
  coalesce(e.schema_version = 2 AND {us('e.analyzed_at')} >= {us('c.pushed_at')}, false) AS ready,
  coalesce(n.schema_version = 2 AND e.schema_version = 2 AND n.source_pushed_at = c.pushed_at AND n.source_analysis_at = e.analyzed_at
    AND {us('n.source_pushed_at')} IS NOT NULL AND {us('n.analyzed_at')} >= {us('n.source_analysis_at')}, false) AS bound
FROM catalog_rows c LEFT JOIN evidence_one e ON e.ecanon = c.canonical LEFT JOIN profile_one n ON n.ncanon = c.canonical WHERE c.position <= 5""")
cte("pq", ["pq0"], """
SELECT capture_id, 'project:' || pid AS id, 'project' AS kind, 100 - (position - 1) * 4 AS priority, repo AS repository, title,
  CASE WHEN NOT ready THEN 'static_inspection_missing' WHEN complete THEN 'profile_stale' ELSE 'profile_missing' END AS reason,
  CASE WHEN ready THEN 'ready' ELSE 'static_analysis_required' END AS evidence_state, pushed_at AS source_pushed_at, source_analysis_at, previous_analyzed_at,
  concat_ws('|', CASE WHEN ready THEN 'data/generations/' || capture_id || '/analysis/' || pid || '.json' END, 'data/generations/' || capture_id || '/catalog/latest.json') AS input_paths,
  'data/enrichment/' || pid || '.json' AS output_path, ready AND complete AND bound AS completed FROM pq0""")
SQL["project_queue"] = query(["pq"], """
SELECT capture_id, id, priority, repository, title, reason, evidence_state, source_pushed_at, source_analysis_at, previous_analyzed_at, input_paths, output_path, completed FROM pq""")
cte("sq", ["sig_overlay", "signal_enrichment"], """
SELECT o.run_id, 'signal:' || o.id AS id, 'signal' AS kind, 98 - (o.position - 1) * 3 AS priority, o.title, o.url, o.source,
  CASE WHEN complete AND NOT enriched THEN 'summary_stale' ELSE 'summary_missing' END AS reason, o.published_at AS source_published_at,
  coalesce(e.analyzed_at, e.set_generated_at) AS previous_analyzed_at, 'data/generations/' || o.run_id || '/signals/latest.json' AS input_paths, enriched AS completed
FROM sig_overlay o LEFT JOIN signal_enrichment e ON e.run_id = o.run_id AND e.url = o.url WHERE o.position <= 10""")
SQL["signal_queue"] = query(["sq"], """
SELECT run_id, id, priority, title, url, source, reason, source_published_at, previous_analyzed_at, input_paths, completed FROM sq""")
cte("wq", ["pq", "sq", "caps"], f"""
SELECT capture_id AS queue_id, id, kind, priority, title, reason, evidence_state, repository, NULL AS url, output_path, input_paths,
  '{"|".join(PROJECT_REQUIRED)}' AS required_fields, completed FROM pq
UNION ALL SELECT coalesce(c.capture_id, sq.run_id), id, kind, priority, title, reason, NULL, NULL, url, 'data/signals/enrichment.json', input_paths, '{"|".join(SIGNAL_REQUIRED)}', completed
FROM sq LEFT JOIN caps c ON 'r' || (c.capture_no - 1) = sq.run_id""")
SQL["work_queue"] = query(["wq"], """
SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY priority DESC, id)::INT AS position, id, kind, priority, title, reason, evidence_state, repository, url,
  output_path, input_paths, required_fields FROM wq WHERE NOT completed""")
SQL["queue_summary"] = query(["wq"], """
SELECT queue_id, count(*) FILTER (WHERE NOT completed) AS pending_count, count(*) FILTER (WHERE NOT completed AND kind = 'project') AS project_pending_count,
  count(*) FILTER (WHERE NOT completed AND kind = 'signal') AS signal_pending_count, count(*) FILTER (WHERE completed AND kind = 'project') AS completed_project_count,
  count(*) FILTER (WHERE completed AND kind = 'signal') AS completed_signal_count FROM wq GROUP BY queue_id""")

# --- action log ---------------------------------------------------------------------------
SQL["accept_actions"] = query(["action_requests", "known_projects"], """
SELECT id, CASE WHEN device_id = '' OR length(device_id) > 200 THEN 'invalid_device'
  WHEN project_slug NOT IN (SELECT project_slug FROM known_projects) THEN 'unknown_project'
  WHEN action NOT IN ('opened', 'saved', 'tried', 'cloned', 'reused') THEN 'invalid_action'
  WHEN NOT regexp_full_match(idempotency_key, '[A-Za-z0-9][A-Za-z0-9._:-]{7,199}') THEN 'invalid_key'
  WHEN starts_with(idempotency_key, 'legacy-project-actions:') THEN 'reserved_key' WHEN has_client_time THEN 'client_time_refused' END AS reason FROM action_requests""")
cte("arrivals", ["action_events"], """
SELECT *, row_number() OVER k AS arrival, first_value(project_slug) OVER k AS fp, first_value(action) OVER k AS fa
FROM action_events WINDOW k AS (PARTITION BY device_id, idempotency_key ORDER BY at_us, id)""")
SQL["dedupe_actions"] = query(["arrivals"], """
SELECT id, CASE WHEN arrival = 1 THEN 'recorded' WHEN fp = project_slug AND fa = action THEN 'replayed' ELSE 'conflict' END AS status FROM arrivals""")
cte("log", ["arrivals"], "SELECT * FROM arrivals WHERE arrival = 1")
_latest = ", ".join(f"max(at_us) FILTER (WHERE action = '{a}') AS {a}_us" for a in ACTION_STAGES)
_rank = "CASE action " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ACTION_STAGES, 1)) + " ELSE 0 END"
cte("state", ["log"], f"""
SELECT device_id, project_slug, arg_max(action, {_rank}) AS highest_stage, {_latest}, max(at_us) AS updated_us FROM log GROUP BY device_id, project_slug""")
SQL["action_state"] = query(["state"], "SELECT * FROM state")
SQL["action_projection"] = query(["log"], "SELECT device_id, project_slug, action, max(at_us) AS at_us FROM log GROUP BY ALL")
SQL["action_state_order"] = query(["state"], """
SELECT device_id, project_slug, row_number() OVER (PARTITION BY device_id ORDER BY updated_us DESC, project_slug)::INT AS position FROM state""")
_D = 86400000000
cte("marks", ["action_events"], f"SELECT DISTINCT (at_us // {_D}) * {_D} AS as_of_us FROM action_events")
_dist = ", ".join(f"count(DISTINCT project_slug) FILTER (WHERE action = '{a}') AS {a}_projects" for a in ACTION_STAGES)
SQL["weekly_action_metrics"] = query(["log", "marks"], f"""
SELECT device_id, as_of_us, count(DISTINCT project_slug) FILTER (WHERE action IN ('tried', 'cloned', 'reused')) AS acted_projects, {_dist}
FROM log, marks WHERE at_us BETWEEN as_of_us - 7 * {_D} AND as_of_us GROUP BY device_id, as_of_us""")
SQL["migrate_legacy_actions"] = query(["log", "legacy_actions"], """
SELECT id, device_id, project_slug, action, at_us, 'legacy-project-actions:' || id AS idempotency_key FROM legacy_actions l
WHERE NOT EXISTS (SELECT 1 FROM log e WHERE e.device_id = l.device_id AND e.project_slug = l.project_slug AND e.action = l.action AND abs(e.at_us - l.at_us) < 2000)""")
SQL["legacy_projection"] = query(["log"], """
SELECT device_id, project_slug, action, strftime(make_timestamp(max(at_us)), '%Y-%m-%d %H:%M:%S.%g') AS created_at FROM log GROUP BY ALL""")
cte("newlog", ["action_events"], """
SELECT id, device_id, project_slug, CASE WHEN id % 400 = 9 THEN 'opened' ELSE action END AS action, at_us, idempotency_key FROM action_events WHERE id % 500 <> 7
UNION ALL SELECT id, device_id, project_slug, action, at_us, idempotency_key FROM action_events WHERE id % 900 = 11""")
SQL["append_only_check"] = query(["action_events", "newlog"], """
SELECT 'deleted_event' AS code, id::VARCHAR AS key FROM action_events WHERE id NOT IN (SELECT id FROM newlog)
UNION ALL SELECT 'changed_event', o.id::VARCHAR FROM action_events o JOIN newlog n ON n.id = o.id WHERE n.action <> o.action
UNION ALL SELECT 'reused_identity', device_id || ' ' || idempotency_key FROM newlog GROUP BY device_id, idempotency_key HAVING count(*) > 1
UNION ALL SELECT 'reused_id', id::VARCHAR FROM newlog GROUP BY id HAVING count(*) > 1""")
cte("changes", ["feedback_changes"], """
SELECT *, lag(value) OVER (PARTITION BY device_id, project_slug ORDER BY at_us, id) AS previous FROM feedback_changes""")
cte("decided", ["changes"], "SELECT * FROM changes WHERE previous IS NULL OR previous <> value")
SQL["decision_events"] = query(["decided"], "SELECT id, device_id, project_slug, value, at_us FROM decided")
cte("fcurrent", ["decided", "feedback_changes"], """
SELECT f.device_id, f.project_slug, value, updated_us FROM (SELECT device_id, project_slug, arg_max(value, at_us) AS value FROM feedback_changes GROUP BY ALL) f
JOIN (SELECT device_id, project_slug, max(at_us) AS updated_us FROM decided GROUP BY ALL) d ON d.device_id = f.device_id AND d.project_slug = f.project_slug""")
SQL["feedback_current"] = query(["fcurrent"], "SELECT device_id, project_slug, value, updated_us FROM fcurrent")
SQL["feedback_counts"] = query(["fcurrent"], "SELECT device_id, " + ", ".join(f"count(*) FILTER (WHERE value = '{v}') AS {v}" for v in FEEDBACK_VALUES)
                              + ", count(*) AS total FROM fcurrent GROUP BY device_id")
SQL["weekly_decisions"] = query(["decided"], f"""
SELECT device_id, count(DISTINCT project_slug) FILTER (WHERE value IN ('useful', 'reuse')) AS effective_decisions,
  count(DISTINCT project_slug) FILTER (WHERE value = 'reuse') AS reuse_decisions, count(*) AS feedback_changes
FROM decided WHERE at_us >= 1706659200000000 - 7 * {_D} GROUP BY device_id""")
SQL["watchlist"] = query(["fcurrent", "state", "known_projects"], """
SELECT m.device_id, m.project_slug, k.position, concat_ws('|', CASE WHEN bool_or(u) THEN 'unsure' END, CASE WHEN bool_or(s) THEN 'saved' END) AS status FROM (
  SELECT device_id, project_slug, true AS u, false AS s FROM fcurrent WHERE value = 'unsure'
  UNION ALL SELECT device_id, project_slug, false, true FROM state WHERE saved_us IS NOT NULL) m
JOIN known_projects k ON k.project_slug = m.project_slug GROUP BY ALL""")
