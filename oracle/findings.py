"""Checking SQL for the audit findings, written from the rules; inputs are the projections the audit reads."""

import oracle.audit  # noqa: F401  (its common tables)
from oracle.core import cte, query, us

SQL: dict[str, str] = {}
WARN = {"partial_query_failure", "partial_signal_source_failure", "partial_static_analysis_failure", "no_observed_growth_after_history"}


def text(*parts):
    """Literals as they are, columns (in a tuple) with null spelled out."""
    return " || ".join(f"coalesce(({p[0]})::VARCHAR, 'null')" if isinstance(p, tuple) else f"'{p}'" for p in parts)


def rule(table, scope, code, key, detail, cond):
    as_sql = lambda x: f"coalesce(({x[0]})::VARCHAR, 'null')" if isinstance(x, tuple) else f"'{x}'"
    severity = "warning" if code in WARN else "error"
    return (f"SELECT generation_id, {as_sql(scope)} AS scope, '{severity}' AS severity, {as_sql(code)} AS code, {as_sql(key)} AS key, {detail} AS detail "
            f"FROM {table} WHERE {cond}")


def declared(table, code, name, actual):
    return rule(table, "header", code, name, text("declared ", (name,), ", found ", (actual,)), f"{name} IS DISTINCT FROM {actual}")


def findings(name, deps, *parts):
    SQL[f"findings_{name}"] = query(deps, " UNION ALL ".join(parts))


http = lambda u: f"regexp_matches({u}, '^[hH][tT][tT][pP][sS]?://[^/?#]')"

cte("f_pres", ["audit_headers", "audit_inventory"], """
SELECT h.generation_id, h.artifact, i.parse_state, i.schema_errors FROM (SELECT generation_id, unnest(['snapshot', 'catalog', 'signals', 'queue']) AS artifact FROM audit_headers) h
LEFT JOIN audit_inventory i ON i.generation_id = h.generation_id AND i.artifact = h.artifact""")
findings("presence", ["f_pres"],
         rule("f_pres", ("artifact",), "missing_artifact", ("artifact",), "'not found'", "parse_state IS NULL"),
         rule("f_pres", ("artifact",), "invalid_artifact", ("artifact",), "'cannot be parsed'", "parse_state = 'broken'"),
         rule("f_pres", ("artifact",), "invalid_artifact_shape", ("artifact",), "'not an object'", "parse_state = 'not_object'"),
         rule("f_pres", ("artifact",), "schema_validation_failed", ("artifact",), text(("schema_errors",), " contract errors"), "parse_state = 'ok' AND schema_errors > 0"))

one = "CASE WHEN artifact IN ('signals', 'sources') THEN rtrim(artifact, 's') ELSE artifact END"
findings("shape", ["intake_documents", "intake_rows"], *[
    rule(t, ("artifact",), (f"'invalid_' || {one} || '{tail}'",), ("artifact",), text((f"substr({col}, 1, 40)",)), f"NOT coalesce(starts_with(trim({col}), '{mark}'), false)")
    for t, col, mark, tail in [("intake_documents", "container_text", "[", "_rows"), ("intake_rows", "row_text", "{", "_row")]])

at = lambda x: f"coalesce({us(x)}, epoch_us(try_strptime({x}, '%Y-%m-%dT%H:%M:%S')))"
cte("f_times", ["generation_headers"], f"SELECT *, {at('snapshot_at')} AS s, {at('catalog_at')} AS k, {at('signals_at')} AS g, {at('queue_at')} AS q FROM generation_headers")
findings("times", ["f_times"],
         *[rule("f_times", n, code, f"{n}_at", text((f"{n}_at",)), f"{x} IS NULL") for n, x, code in [
             ("snapshot", "s", "invalid_snapshot_time"), ("catalog", "k", "invalid_catalog_time"), ("signals", "g", "invalid_signal_time"), ("queue", "q", "invalid_queue_time")]],
         *[rule("f_times", a, code, f"{a}_at", text((f"{a}_at",), f", {b} at ", (f"{b}_at",)), cond) for a, b, cond, code in [
             ("catalog", "snapshot", "k <> s", "catalog_snapshot_mismatch"), ("signals", "snapshot", "g < s", "signals_older_than_snapshot"),
             ("queue", "catalog", "q < k", "queue_older_than_catalog"), ("queue", "signals", "q < g", "queue_older_than_signals")]])

findings("counts", ["ac"], *[declared("ac", *x) for x in [
    ("snapshot_count_mismatch", "snapshot_count", "n_snapshot"), ("catalog_source_count_mismatch", "source_count", "n_snapshot"),
    ("catalog_project_count_mismatch", "project_count", "n_catalog"), ("signal_count_mismatch", "signal_count", "n_signals"), ("queue_count_mismatch", "pending_count", "n_queue"),
    ("project_queue_count_mismatch", "project_pending_count", "n_project"), ("signal_queue_count_mismatch", "signal_pending_count", "n_signal"),
    ("catalog_queue_count_mismatch", "catalog_pending_count", "n_queue"), ("deep_analysis_count_mismatch", "deep_count", "n_deep")]])

version = "lower(repository) || ' ' || schema_version"
findings("uniqueness", ["audit_snapshot", "audit_catalog", "audit_artifacts", "audit_profiles", "audit_signals", "audit_sources", "audit_queue"], *[
    f"SELECT generation_id, '{scope}' AS scope, 'error' AS severity, '{code}' AS code, k AS key, count(*)::VARCHAR || ' rows' AS detail "
    f"FROM (SELECT generation_id, coalesce(({key})::VARCHAR, '') AS k FROM {table}) d GROUP BY generation_id, k HAVING count(*) > 1 OR k = ''"
    for table, scope, key, code in [
        ("audit_snapshot", "snapshot", "repo", "duplicate_snapshot_repository"), ("audit_catalog", "catalog", "repo", "duplicate_catalog_repository"),
        ("audit_catalog", "catalog", "slug", "duplicate_catalog_slug"), ("audit_catalog", "catalog", "project_id", "duplicate_catalog_project_id"),
        ("audit_artifacts", "analyses", version, "duplicate_analysis_repository"), ("audit_profiles", "enrichments", version, "duplicate_enrichment_repository"),
        ("audit_signals", "signals", "id", "duplicate_signal_id"), ("audit_signals", "signals", "url", "duplicate_signal_url"),
        ("audit_sources", "sources", "id", "duplicate_source_id"), ("audit_queue", "queue", "id", "duplicate_queue_id")]])

cte("f_stars", ["acat", "asnap"], """
SELECT c.generation_id, c.repo, c.stars, s.stars AS was, s.generation_id IS NULL AS absent FROM acat c LEFT JOIN asnap s ON s.generation_id = c.generation_id AND s.cn = c.cn""")
cte("f_used", ["asnap", "audit_rules"], """
SELECT DISTINCT generation_id, repo, q FROM (SELECT generation_id, repo, unnest(string_split(coalesce(candidate_query, ''), ' | ')) AS q FROM asnap) u
WHERE NOT EXISTS (SELECT 1 FROM audit_rules r WHERE r.generation_id = u.generation_id AND r.query = u.q)""")
cte("f_cross", ["aart", "acat"], """
SELECT a.generation_id, a.repository, a.project_id AS aid, i.pid FROM aart a JOIN (SELECT generation_id, cn, min(project_id) AS pid FROM acat WHERE carried IS NULL GROUP BY ALL) i
  ON i.generation_id = a.generation_id AND i.cn = a.cn WHERE a.schema_version = 2 AND a.project_id <> i.pid""")
cte("f_slugs", ["asnap", "aart"], """
SELECT generation_id, slug, count(*) AS n, min(cn) AS a, max(cn) AS b FROM (SELECT generation_id, cn, slug FROM asnap UNION SELECT generation_id, cn, slug FROM aart WHERE schema_version < 2) x
WHERE cn IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
findings("references", ["f_stars", "f_used", "acat", "audit_headers", "aart", "f_cross", "f_slugs"],
         rule("f_stars", "catalog", "catalog_repository_missing_from_snapshot", ("repo",), "'not in the snapshot'", "absent"),
         rule("f_stars", "catalog", "catalog_star_mismatch", ("repo",), text("catalog ", ("stars",), ", snapshot ", ("was",)), "stars IS DISTINCT FROM was"),
         rule("f_used", "snapshot", "unknown_candidate_query", ("repo",), text(("q",)), "true"),
         rule("acat", "catalog", ("carried",), ("repo",), text(("project_id",), " version ", ("project_id_version",)), "carried IS NOT NULL"),
         rule("audit_headers", "header", "catalog_queue_identity_version_mismatch", "queue_version",
              text("catalog ", ("catalog_version",), ", queue ", ("queue_version",), ", identity ", ("queue_identity_version",)),
              "queue_version IS DISTINCT FROM 2 OR queue_identity_version IS DISTINCT FROM 1"),
         rule("aart", "analyses", "legacy_artifact_in_identity_generation", ("repository",), "'schema version 1'", "schema_version = 1"),
         rule("f_cross", "analyses", "project_identity_cross_file_mismatch", ("repository",), text("artifact ", ("aid",), ", catalog ", ("pid",)), "true"),
         rule("f_slugs", "snapshot", "unresolved_legacy_collision", ("slug",), text(("n",), " repositories from ", ("a",), " to ", ("b",)), "true"))

cte("f_cover", ["audit_rules", "audit_status", "audit_headers"], """
SELECT generation_id, query, count(*) FILTER (WHERE k = 'd') AS d, count(*) FILTER (WHERE k = 's') AS s
FROM (SELECT generation_id, query, 'd' AS k FROM audit_rules UNION ALL SELECT generation_id, query, 's' FROM audit_status) x
WHERE generation_id IN (SELECT generation_id FROM audit_headers) GROUP BY ALL""")
cte("f_status", ["audit_status", "audit_headers"], "SELECT * FROM audit_status WHERE generation_id IN (SELECT generation_id FROM audit_headers)")
cte("f_heads", ["audit_headers", "audit_status"], """
SELECT h.*, (SELECT count(*) FROM audit_status s WHERE s.generation_id = h.generation_id) AS n, (SELECT count(*) FROM audit_status s WHERE s.generation_id = h.generation_id AND state = 'healthy') AS ok,
  (SELECT count(*) FROM audit_status s WHERE s.generation_id = h.generation_id AND state = 'failed') AS bad FROM audit_headers h""")
findings("query_health", ["f_cover", "f_status", "f_heads"],
         rule("f_cover", "queries", "invalid_query_definition", ("query",), text("declared ", ("d",), " times"), "d > 1 OR (d > 0 AND query = '')"),
         rule("f_cover", "queries", "query_status_coverage_mismatch", ("query",), text("declared ", ("d",), " times, reported ", ("s",)), "d <> 1 OR s <> 1"),
         rule("f_status", "query_status", "invalid_query_state", ("query",), text(("state",)), "state NOT IN ('healthy', 'failed')"),
         rule("f_status", "query_status", "invalid_query_item_count", ("query",), text(("item_count",)), "item_count IS NULL OR item_count < 0"),
         rule("f_status", "query_status", "invalid_query_error", ("query",), text(("state",), ": ", ("error",)),
              "(state = 'healthy' AND error IS NOT NULL) OR (state = 'failed' AND trim(coalesce(error, '')) = '')"),
         rule("f_status", "query_status", "partial_query_failure", ("query",), text(("error",)), "state = 'failed'"),
         rule("f_heads", "queries", "invalid_query_rows", "queries", "'not a list'", "NOT queries_is_list"),
         rule("f_heads", "query_status", "invalid_query_status_rows", "query_status", "'not a list'", "NOT status_is_list"),
         rule("f_heads", "query_status", "invalid_query_status_row", "query_status", text(("status_non_objects",), " rows are not objects"), "status_non_objects > 0"),
         rule("f_heads", "query_status", "no_successful_query", "query_status", text("none of ", ("n",)), "ok = 0"),
         declared("f_heads", "successful_query_count_mismatch", "successful_query_count", "ok"), declared("f_heads", "failed_query_count_mismatch", "failed_query_count", "bad"),
         declared("f_heads", "catalog_query_failure_count_mismatch", "query_failure_count", "bad"))

findings("tracks", ["audit_catalog", "tr"],
         rule("audit_catalog", "catalog", "invalid_heat_track", ("repo",), text(("heat_track",), " ''", ("heat_label",), "'', attention ", ("attention",), ", endurance ", ("endurance",)),
              "heat_track NOT IN ('recent_momentum', 'long_term') OR heat_label = '' OR attention NOT BETWEEN 0 AND 100 OR endurance NOT BETWEEN 0 AND 100"),
         rule("tr", "header", "daily_track_count_mismatch", "daily",
              text("declared ", ("daily_long_term",), " + ", ("daily_recent",), ", found ", ("d_long",), " + ", ("d_recent",), " of ", ("daily",)),
              "daily_long_term IS DISTINCT FROM d_long OR daily_recent IS DISTINCT FROM d_recent OR d_long + d_recent <> daily"),
         rule("tr", "catalog", "daily_track_balance_mismatch", "daily", text(("d_long",), " lasting and ", ("d_recent",), " recent"),
              "daily = 5 AND eligible >= 2 AND recent >= 3 AND (d_long <> 2 OR d_recent <> 3)"))

cte("f_sig", ["audit_headers", "audit_signals"], f"""
SELECT s.*, CASE WHEN isnan(score) THEN 'NaN' ELSE score::VARCHAR END AS said_score, {us('signals_at')} IS NOT NULL AND NOT coalesce(({us('signals_at')} - {us('published_at')}) / 3600000000.0::DOUBLE
  BETWEEN -2 AND CASE WHEN window_hours > 0 THEN window_hours ELSE 48 END, false) AS outside FROM audit_signals s JOIN audit_headers h ON h.generation_id = s.generation_id""")
findings("urls_scores", ["audit_headers", "audit_catalog", "f_sig", "audit_sources"],
         rule("audit_catalog", "catalog", "unsafe_evidence_url", ("repo",), text(("href",)), f"NOT {http('href')}"),
         rule("f_sig", "signals", "unsafe_signal_url", ("id",), text(("url",)), f"NOT {http('url')}"),
         rule("f_sig", "signals", "invalid_signal_score", ("id",), text(("said_score",)), "score IS NULL OR isnan(score) OR score < 0 OR score > 1"),
         rule("f_sig", "signals", "signal_outside_window", ("id",), text(("published_at",)), "outside"),
         rule("audit_sources", "sources", "unsafe_source_url", ("id",), text(("url",)), f"NOT {http('url')} AND generation_id IN (SELECT generation_id FROM audit_headers)"),
         rule("audit_headers", "header", "invalid_signal_window", "window_hours", text(("window_hours",)), "signals_at IS NOT NULL AND (window_hours IS NULL OR window_hours <= 0)"))

findings("sources", ["so", "audit_sources", "audit_headers"],
         rule("audit_sources", "sources", "invalid_source_state", ("id",), text(("state",)), "state NOT IN ('healthy', 'failed') AND generation_id IN (SELECT generation_id FROM audit_headers)"),
         rule("audit_sources", "sources", "partial_signal_source_failure", ("id",), text(("url",)), "state = 'failed' AND generation_id IN (SELECT generation_id FROM audit_headers)"),
         declared("so", "healthy_source_count_mismatch", "healthy_source_count", "ok"), declared("so", "failed_source_count_mismatch", "failed_source_count", "bad"))
findings("analysis_failures", ["audit_failures", "audit_headers"],
         rule("audit_failures", "analysis_failures", "invalid_analysis_failure_row", ("repository",), text(("error",)), "coalesce(repository, '') = '' OR coalesce(error, '') = ''"),
         rule("audit_failures", "analysis_failures", "partial_static_analysis_failure", ("repository",), text(("error",)), "true"),
         rule("audit_headers", "analysis_failures", "invalid_analysis_failure_rows", "analysis_failures", "'not a list'", "NOT failures_is_list"))

# --- recorded tables against rebuilt ones ---------------------------------------------------
cte("f_heat", ["recorded", "grow"], """
SELECT r.capture_id AS generation_id, r.no, r.repo, r.obs_count, r.obs_window, r.long_term_evidence, r.verified AS dv, coalesce(o.obs_count, 0) AS n, o.obs_window AS w, r.long_term AND coalesce(o.p, false) AS v,
  CASE WHEN r.long_term AND o.p THEN 'multi_snapshot' WHEN r.long_term THEN 'structural_proxy' END AS kind
FROM recorded r LEFT JOIN (SELECT capture_id, repo, obs_count, obs_window, obs_window >= 7 AND obs_count >= 5 AND obs_count / obs_window::DOUBLE >= 0.7 AS p FROM grow) o
  ON o.capture_id = r.capture_id AND o.repo = r.repo""")
cte("f_heat_heads", ["f_heat"], """
SELECT generation_id, max(obs_window) + CASE WHEN no % 11 = 1 THEN 1 ELSE 0 END AS snapshot_count, CASE WHEN no % 11 = 2 THEN 31 ELSE 30 END AS maximum_snapshots, 30 AS most,
  CASE WHEN no % 11 = 3 THEN 8 ELSE 7 END AS minimum_persistence, 7 AS least, count(*) FILTER (WHERE dv) + CASE WHEN no % 11 = 4 THEN 1 ELSE 0 END AS verified_long_term,
  max(w) AS wide, count(*) FILTER (WHERE v) AS verified FROM f_heat GROUP BY generation_id, no""")
findings("heat", ["f_heat", "f_heat_heads"],
         rule("f_heat", "catalog", "heat_observation_mismatch", ("repo",),
              text("declared ", ("obs_count",), " of ", ("obs_window",), " ", ("long_term_evidence",), ", found ", ("n",), " of ", ("w",), " ", ("kind",)),
              "obs_count IS DISTINCT FROM n OR obs_window IS DISTINCT FROM w OR long_term_evidence IS DISTINCT FROM kind"),
         *[declared("f_heat_heads", "heat_history_mismatch", a, b) for a, b in [
             ("snapshot_count", "wide"), ("maximum_snapshots", "most"), ("minimum_persistence", "least"), ("verified_long_term", "verified")]])


def changes(cols):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN a.{x} IS DISTINCT FROM b.{x} THEN '{x}' END" for x in cols) + ")"


ITEM = ["kind", "priority", "reason", "repository", "url"]
cte("f_stale", ["rec_q", "rq"], f"""
SELECT * FROM (SELECT coalesce(a.generation_id, b.generation_id) AS generation_id, coalesce(a.id, b.id) AS key,
  CASE WHEN b.id IS NULL THEN 'only recorded' WHEN a.id IS NULL THEN 'only rebuilt' ELSE 'differs: ' || {changes(ITEM)} END AS change
  FROM rec_q a FULL OUTER JOIN (SELECT * FROM rq WHERE NOT completed) b ON b.generation_id = a.generation_id AND b.id = a.id) x WHERE change <> 'differs: '""")
cte("f_top", ["recorded", "rq"], """
SELECT r.capture_id AS generation_id, r.position, r.repo, r.analysis_state, EXISTS (SELECT 1 FROM rq y WHERE y.generation_id = r.capture_id AND y.repository = r.repo
  AND NOT y.completed AND y.kind = 'project') AS pending FROM recorded r WHERE r.position <= 5 AND r.capture_id IN (SELECT generation_id FROM rq)""")
cte("f_done", ["rq", "f_top"], """
SELECT generation_id, p AS projects, s AS signals, coalesce(pd, '') AS listed, p + CASE WHEN no % 8 = 1 THEN 1 ELSE 0 END AS completed_project_count,
  s + CASE WHEN no % 8 = 2 THEN 1 ELSE 0 END AS completed_signal_count, coalesce(pd, '') || CASE WHEN no % 8 = 3 THEN '|x' ELSE '' END AS pending_deep
FROM (SELECT generation_id, no, count(*) FILTER (WHERE completed AND kind = 'project') AS p, count(*) FILTER (WHERE completed AND kind = 'signal') AS s,
  (SELECT string_agg(repo, '|' ORDER BY position, repo) FROM f_top t WHERE t.generation_id = q.generation_id AND analysis_state <> 'deep') AS pd FROM rq q GROUP BY generation_id, no) x""")
findings("queue_rebuild", ["rec_q", "f_stale", "f_top", "f_done"],
         rule("rec_q", "queue", "invalid_queue_kind", ("id",), text(("kind",)), "kind NOT IN ('project', 'signal')"),
         rule("f_stale", "queue", "stale_queue_items", ("key",), "change", "true"),
         rule("f_top", "catalog", "deep_analysis_without_current_evidence", ("repo",), "'still pending'", "analysis_state = 'deep' AND pending"),
         rule("f_top", "catalog", "current_enrichment_not_applied", ("repo",), text(("analysis_state",)), "analysis_state <> 'deep' AND NOT pending"),
         declared("f_done", "pending_deep_analysis_mismatch", "pending_deep", "listed"), declared("f_done", "completed_project_count_mismatch", "completed_project_count", "projects"),
         declared("f_done", "completed_signal_count_mismatch", "completed_signal_count", "signals"))

SCORED = ["repo", "attention", "endurance", "readiness", "completeness", "recommendation", "growth_kind", "growth_value", "obs_count", "long_term_evidence", "analysis_state"]
cte("f_scored", ["recorded", "catalog_rows", "captures"], f"""
SELECT * FROM (SELECT coalesce(a.capture_id, b.capture_id) AS generation_id, coalesce(a.position, b.position) AS position,
  CASE WHEN b.capture_id IS NULL THEN 'only recorded' WHEN a.capture_id IS NULL THEN 'only rebuilt' ELSE 'differs: ' || {changes(SCORED)} END AS change
  FROM recorded a FULL OUTER JOIN catalog_rows b ON b.capture_id = a.capture_id AND b.position = a.position) x
WHERE change <> 'differs: ' AND generation_id IN (SELECT capture_id FROM captures)""")
cte("f_models", ["captures"], f"SELECT capture_id AS generation_id, {oracle.audit._no('capture_id', 'capture_id')} AS no FROM captures")
findings("catalog_rebuild", ["f_scored", "f_models"],
         rule("f_scored", "catalog", "score_semantics_mismatch", ("position",), "change", "true"),
         rule("f_models", "header", "score_semantics_mismatch", "score_model", "'declared legacy-v1, found evidence-v2'", "no % 12 = 1"))

cte("f_grown", ["gh", "recorded", "repo_snapshot"], """
SELECT r.capture_id AS generation_id, r.repo, r.growth_kind, r.growth_value, p.stars AS was, n.stars - p.stars AS actual
FROM gh g JOIN recorded r ON r.capture_id = g.generation_id LEFT JOIN repo_snapshot n ON n.capture_id = r.capture_id AND n.repo = r.repo
LEFT JOIN repo_snapshot p ON p.capture_id = g.pid AND p.repo = r.repo""")
cte("f_named", ["said_before", "repo_snapshot", "recorded"], """
SELECT capture_id AS generation_id, previous_at, (SELECT count(DISTINCT capture_id) FROM repo_snapshot s WHERE s.captured_at = b.previous_at) AS n,
  (SELECT count(*) FROM recorded r WHERE r.capture_id = b.capture_id) AS projects,
  (SELECT count(*) FROM recorded r WHERE r.capture_id = b.capture_id AND growth_kind = 'observed') AS observed FROM said_before b""")
findings("growth", ["f_grown", "f_named"],
         rule("f_grown", "catalog", "growth_kind_mismatch", ("repo",), text(("growth_kind",), ", previous stars ", ("was",)), "(was IS NOT NULL) <> (growth_kind = 'observed')"),
         rule("f_grown", "catalog", "observed_growth_mismatch", ("repo",), text("declared ", ("growth_value",), ", found ", ("actual",)),
              "was IS NOT NULL AND growth_kind = 'observed' AND growth_value IS DISTINCT FROM actual"),
         rule("f_named", "header", "missing_previous_snapshot", "previous_at", text(("previous_at",), " names ", ("n",), " captures"), "previous_at IS NOT NULL AND n <> 1"),
         rule("f_named", "catalog", "no_observed_growth_after_history", "growth_kind", text("none of ", ("projects",), " projects"), "previous_at IS NOT NULL AND observed = 0"))
