"""Checking SQL for versioned datasets, contracts and the audit."""

from beaconry.operators.generations import REQUIRED_ARTIFACTS
from beaconry.plans.audit_queries import REBUILT
from oracle.catalog import canon, carried_error, slug, valid_repo
from oracle.core import cte, query, us

SQL: dict[str, str] = {}
_list = lambda items: "[" + ", ".join(f"'{i}'" for i in items) + "]"

# --- versioned datasets -------------------------------------------------------------------
cte("fps", ["generation_rows"], """
SELECT generation_id, artifact, count(*) AS row_count,
  sum(('0x' || substr(md5(concat_ws('|', row_key, o_custkey::VARCHAR, o_orderstatus, cents::VARCHAR)), 1, 15))::BIGINT::DECIMAL(38,0))::VARCHAR AS fingerprint
FROM generation_rows GROUP BY ALL""")
cte("gens", ["generation_rows"], f"SELECT generation_id, unnest({_list(REQUIRED_ARTIFACTS)}) AS artifact FROM (SELECT DISTINCT generation_id FROM generation_rows) g")
cte("manifest", ["fps", "gens"], """
SELECT coalesce(g.generation_id, f.generation_id) AS generation_id, coalesce(g.artifact, f.artifact) AS artifact, coalesce(row_count, 0) AS row_count, fingerprint, row_count IS NOT NULL AS present
FROM gens g FULL OUTER JOIN fps f ON f.generation_id = g.generation_id AND f.artifact = g.artifact""")
SQL["generation_manifest"] = query(["manifest"], "SELECT generation_id, artifact, row_count, fingerprint, present FROM manifest")
cte("declared", ["manifest"], """
WITH kept AS MATERIALIZED (SELECT *, substr(generation_id, 2)::INT AS no FROM manifest WHERE NOT (substr(generation_id, 2)::INT % 7 = 2 AND artifact = 'signals'))
SELECT generation_id, artifact, row_count, CASE WHEN no % 5 = 1 AND artifact = 'catalog' THEN fingerprint || '9' ELSE fingerprint END AS fingerprint FROM kept
UNION ALL SELECT generation_id, 'notes', row_count, fingerprint FROM kept WHERE no % 6 = 3 AND artifact = 'snapshot'""")
cte("mstate", ["declared", "manifest"], """
SELECT coalesce(d.generation_id, m.generation_id) AS generation_id, coalesce(d.artifact, m.artifact) AS artifact,
  CASE WHEN d.generation_id IS NULL THEN 'extra' WHEN m.generation_id IS NULL THEN 'missing'
    WHEN d.fingerprint IS NOT DISTINCT FROM m.fingerprint AND d.row_count = m.row_count THEN 'match' ELSE 'changed' END AS state
FROM declared d FULL OUTER JOIN manifest m ON m.generation_id = d.generation_id AND m.artifact = d.artifact""")
SQL["verify_manifest"] = query(["mstate"], "SELECT generation_id, artifact, state FROM mstate")
SQL["verified_generations"] = query(["mstate"], """
SELECT generation_id, wrong_artifacts, no % 8 <> 0 AND no % 11 <> 4 AS audit_matches, wrong_artifacts = 0 AND no % 8 <> 0 AND no % 11 <> 4 AS intact
FROM (SELECT generation_id, substr(generation_id, 2)::INT AS no, count(*) FILTER (WHERE state <> 'match') AS wrong_artifacts FROM mstate GROUP BY ALL) g""")
cte("bl", ["baseline_rows"], """
SELECT pair_id, max(captured_at) FILTER (WHERE role = 'latest' AND side = 'base') AS b_at, max(captured_at) FILTER (WHERE role = 'latest' AND side = 'candidate') AS c_at,
  max(fingerprint) FILTER (WHERE role = 'latest' AND side = 'base') AS b_fp FROM baseline_rows GROUP BY pair_id""")
SQL["refresh_baseline_check"] = query(["baseline_pairs", "baseline_rows", "bl"], f"""
SELECT pair_id, code, code IS NULL AS accepted FROM (SELECT p.pair_id, CASE
  WHEN NOT coalesce({us('c_at')} > {us('b_at')}, false) THEN 'stale_generation'
  WHEN declared_previous_at IS DISTINCT FROM b_at THEN 'refresh_previous_capture_mismatch'
  WHEN EXISTS (SELECT 1 FROM baseline_rows b WHERE b.pair_id = p.pair_id AND b.side = 'base' AND b.role = 'history' AND NOT EXISTS (
    SELECT 1 FROM baseline_rows x WHERE x.pair_id = p.pair_id AND x.side = 'candidate' AND x.role = 'history' AND x.captured_at = b.captured_at AND x.fingerprint = b.fingerprint)) THEN 'refresh_history_changed'
  WHEN (SELECT count(*) FROM baseline_rows x WHERE x.pair_id = p.pair_id AND x.side = 'candidate' AND x.role = 'history' AND x.captured_at = b_at) <> 1
    OR (SELECT count(*) FROM baseline_rows x WHERE x.pair_id = p.pair_id AND x.side = 'candidate' AND x.role = 'history' AND x.captured_at = b_at AND x.fingerprint = b_fp) <> 1 THEN 'refresh_base_snapshot_not_archived' END AS code
  FROM baseline_pairs p LEFT JOIN bl ON bl.pair_id = p.pair_id WHERE p.operation = 'refresh') x""")
SQL["derive_baseline_check"] = query(["baseline_pairs", "baseline_rows"], """
SELECT pair_id, CASE WHEN bad THEN 'growth_baseline_changed' END AS code, NOT bad AS accepted FROM (
  SELECT pair_id, (SELECT string_agg(role || captured_at || fingerprint, ',' ORDER BY role, captured_at, fingerprint) FROM baseline_rows b WHERE b.pair_id = p.pair_id AND side = 'base')
    IS DISTINCT FROM (SELECT string_agg(role || captured_at || fingerprint, ',' ORDER BY role, captured_at, fingerprint) FROM baseline_rows b WHERE b.pair_id = p.pair_id AND side = 'candidate') AS bad
  FROM baseline_pairs p WHERE operation = 'derive') x""")
SQL["commit_coherence"] = query(["generation_headers"], f"""
SELECT generation_id, ok AS committed, CASE WHEN ok THEN snapshot_at END AS capture_at FROM (
  SELECT *, coalesce({us('snapshot_at')} = {us('catalog_at')} AND {us('signals_at')} >= {us('snapshot_at')} AND {us('queue_at')} >= {us('signals_at')}, false) AS ok FROM generation_headers) h""")
cte("glog", ["generation_log"], "SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY created_us, generation_id) - 1)::INT AS log_no FROM generation_log")
SQL["publication_lineage"] = query(["glog"], """
SELECT dataset, log_no, generation_id, previous, accepted, accepted AND log_no = max(log_no) FILTER (WHERE accepted) OVER (PARTITION BY dataset) AS current FROM (
  WITH RECURSIVE fold AS (
    SELECT g.dataset, g.log_no, g.generation_id, NULL::VARCHAR AS previous, g.state = 'ready' AND g.error_count = 0 AND g.base_generation_id IS NULL AS accepted,
      CASE WHEN g.state = 'ready' AND g.error_count = 0 AND g.base_generation_id IS NULL THEN g.generation_id END AS cur, CASE WHEN g.state = 'ready' AND g.error_count = 0 AND g.base_generation_id IS NULL THEN g.published_us END AS cur_at
    FROM glog g WHERE log_no = 0
    UNION ALL
    SELECT g.dataset, g.log_no, g.generation_id, f.cur, x.ok, CASE WHEN x.ok THEN g.generation_id ELSE f.cur END, CASE WHEN x.ok THEN g.published_us ELSE f.cur_at END
    FROM fold f JOIN glog g ON g.dataset = f.dataset AND g.log_no = f.log_no + 1,
      LATERAL (SELECT g.state = 'ready' AND g.error_count = 0 AND g.base_generation_id IS NOT DISTINCT FROM f.cur AND coalesce(g.published_us > f.cur_at, f.cur_at IS NULL) AS ok) x)
  SELECT * FROM fold) y""")
SQL["dataset_diff"] = query(["inventory"], """
SELECT qno, o_custkey, change FROM (SELECT coalesce(a.qno + 1, b.qno) AS qno, coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
  CASE WHEN a.qno IS NULL THEN 'added' WHEN b.qno IS NULL THEN 'removed' WHEN a.cents <> b.cents THEN 'changed' END AS change
  FROM inventory a FULL OUTER JOIN inventory b ON b.qno = a.qno + 1 AND b.o_custkey = a.o_custkey) d WHERE change IS NOT NULL""")

# --- contracts ----------------------------------------------------------------------------
_http = lambda u: f"regexp_matches({u}, '^[hH][tT][tT][pP][sS]?://[^/?#]')"


def rules(table, kind, scope, checks):
    return " UNION ALL ".join(
        f"SELECT {scope} AS scope, '{kind}' AS kind, ord::VARCHAR AS key, '/{col}' AS path, '{rule}' AS rule FROM {table} WHERE {cond}" for col, rule, cond in checks)


cte("snap_issues", ["faulty_snapshot"], rules("faulty_snapshot", "snapshot", "capture_id", [
    ("repo", "required", "repo IS NULL"), ("repo", "pattern", f"NOT {valid_repo('repo')}"), ("url", "http_url", f"NOT {_http('url')}"),
    ("stars", "required", "stars IS NULL"), ("stars", "minimum", "stars < 0"), ("forks", "required", "forks IS NULL"), ("forks", "minimum", "forks < 0"),
    ("open_issues", "minimum", "open_issues < 0"), ("description", "max_length", "length(description) > 4000"),
    ("license", "min_length", "length(license) < 1"), ("license", "max_length", "length(license) > 100"), ("topics", "unique_items", "len(list_distinct(topics)) < len(topics)"), ("topics", "max_items", "len(topics) > 100"),
    ("created_at", "required", "created_at IS NULL"), ("pushed_at", "required", "pushed_at IS NULL"), ("candidate_query", "max_length", "length(candidate_query) > 5000"),
    ("created_at", "timestamp", f"created_at IS NOT NULL AND {us('created_at')} IS NULL"), ("pushed_at", "timestamp", f"pushed_at IS NOT NULL AND {us('pushed_at')} IS NULL"),
    ("candidate_query", "min_length", "length(candidate_query) < 1")]))
cte("sig_issues", ["faulty_signals"], rules("faulty_signals", "signals", "run_id", [
    ("kind", "enum", "kind = 'rumour'"), ("title", "min_length", "title = ''"), ("url", "http_url", f"NOT {_http('url')}"), ("score", "required", "score IS NULL"),
    ("score", "finite", "isnan(score)"), ("score", "minimum", "score < 0"), ("score", "maximum", "score > 1"), ("published_at", "required", "published_at IS NULL"),
    ("window_hours", "minimum", "window_hours < 1"), ("window_hours", "maximum", "window_hours > 720"), ("repo", "paired", "(repo IS NULL) <> (reported_daily_growth IS NULL)"),
    ("repo", "required_if", "repo IS NULL AND kind = 'ranking'"), ("evidence", "min_items", "len(evidence) < 1")]))
SQL["contract_issues"] = query(["snap_issues"], "SELECT scope, kind, key, path, rule FROM snap_issues")
SQL["signal_contract_issues"] = query(["sig_issues"], "SELECT scope, kind, key, path, rule FROM sig_issues")
cte("all_issues", ["snap_issues", "sig_issues"], "SELECT * FROM snap_issues UNION ALL SELECT * FROM sig_issues")
SQL["bounded_contract_report"] = query(["all_issues"], """
SELECT scope, kind, key, path, rule, issue_no FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY path, rule, key)::INT AS issue_no FROM all_issues) i""")
_stem = f"CASE WHEN schema_version = 2 THEN project_id ELSE {slug('repository')} END"
cte("af", ["artifact_files"], f"""
SELECT *, {_stem} AS stem, CASE WHEN schema_version = 2 THEN {carried_error('repository', 'project_id', 'project_id_version')} END AS carried,
  coalesce(repository = expected_repository OR (schema_version = 2 AND {canon('repository')} = {canon('expected_repository')}), false) AS same FROM artifact_files""")
SQL["identity_contract_issues"] = query(["af"], """
SELECT ord, repository, 'unexpected_repository' AS code FROM af WHERE NOT same
UNION ALL SELECT ord, repository, 'local_evidence_committed' FROM af WHERE repository = 'local'
UNION ALL SELECT ord, repository, 'file_key_mismatch' FROM af WHERE repository <> 'local' AND NOT coalesce(stem = file_key, false)
UNION ALL SELECT ord, repository, 'queue_path_mismatch' FROM af WHERE queue_path <> 'data/enrichment/' || stem || '.json'
UNION ALL SELECT ord, repository, carried FROM af WHERE carried IS NOT NULL""")
SQL["capture_required_fields"] = query(["capture_headers"], """
SELECT capture_id, field FROM (SELECT capture_id, unnest(list_filter([CASE WHEN query_status_count IS NULL THEN 'query_status_count' END,
  CASE WHEN successful_query_count IS NULL THEN 'successful_query_count' END, CASE WHEN failed_query_count IS NULL THEN 'failed_query_count' END], lambda x: x IS NOT NULL)) AS field
  FROM capture_headers WHERE captured_at = (SELECT max(captured_at) FROM capture_headers)) h""")
SQL["manifest_contract"] = query(["manifest_artifacts", "manifest_hashes", "manifests"], """
SELECT generation_id, 'artifact_without_hash' AS code, artifact AS key FROM (SELECT * FROM manifest_artifacts EXCEPT SELECT * FROM manifest_hashes) a
UNION ALL SELECT generation_id, 'hash_without_artifact', artifact FROM (SELECT * FROM manifest_hashes EXCEPT SELECT * FROM manifest_artifacts) b
UNION ALL SELECT generation_id, 'generation_partition_mismatch', partition_id FROM manifests WHERE generation_id <> partition_id""")

# --- audit ---------------------------------------------------------------------------------
WARN = {"partial_query_failure", "partial_signal_source_failure", "partial_static_analysis_failure", "no_observed_growth_after_history"}


def found(table, checks, key="generation_id"):
    """Rows of (generation, severity, code, n) for one-row-per-generation tables."""
    return " UNION ALL ".join(
        f"SELECT {key} AS generation_id, '{'warning' if code in WARN else 'error'}' AS severity, '{code}' AS code, coalesce(({expr})::BIGINT, 0) AS n "
        f"FROM {table} WHERE coalesce(({expr})::BIGINT, 0) > 0" for code, expr in checks)


def audit(name, deps, sql):
    cte(f"issues_{name}", deps, sql)
    SQL[f"audit_{name}"] = query([f"issues_{name}"], f"SELECT generation_id, severity, code, n FROM issues_{name}")


cte("pres", ["audit_headers", "audit_inventory"], """
SELECT h.generation_id, count(*) FILTER (WHERE parse_state IS NULL) AS missing, count(*) FILTER (WHERE parse_state = 'broken') AS broken,
  count(*) FILTER (WHERE parse_state = 'not_object') AS shape, count(*) FILTER (WHERE parse_state = 'ok' AND schema_errors > 0) AS sch
FROM (SELECT generation_id, unnest(['snapshot', 'catalog', 'signals', 'queue']) AS artifact FROM audit_headers) h
LEFT JOIN audit_inventory i ON i.generation_id = h.generation_id AND i.artifact = h.artifact GROUP BY ALL""")
audit("presence", ["pres"], found("pres", [("missing_artifact", "missing"), ("invalid_artifact", "broken"), ("invalid_artifact_shape", "shape"), ("schema_validation_failed", "sch")]))
_sc = "CASE artifact WHEN 'snapshot' THEN 'snapshot' WHEN 'catalog' THEN 'catalog' WHEN 'signals' THEN 'signal' WHEN 'sources' THEN 'source' ELSE 'queue' END"
audit("shape", ["intake_rows", "intake_documents"], f"""
SELECT generation_id, 'error' AS severity, 'invalid_' || {_sc} || '_rows' AS code, 1::BIGINT AS n FROM intake_documents WHERE NOT coalesce(starts_with(trim(container_text), '['), false)
UNION ALL SELECT generation_id, 'error', 'invalid_' || {_sc} || '_row', count(*) FROM intake_rows WHERE NOT coalesce(starts_with(trim(row_text), '{{'), false) GROUP BY generation_id, artifact""")
_len = lambda x: f"coalesce({us(x)}, epoch_us(try_strptime({x}, '%Y-%m-%dT%H:%M:%S')))"
cte("ht", ["generation_headers"], f"SELECT generation_id, {_len('snapshot_at')} AS s, {_len('catalog_at')} AS c, {_len('signals_at')} AS g, {_len('queue_at')} AS q FROM generation_headers")
audit("times", ["ht"], found("ht", [
    ("invalid_snapshot_time", "s IS NULL"), ("invalid_catalog_time", "c IS NULL"), ("invalid_signal_time", "g IS NULL"), ("invalid_queue_time", "q IS NULL"),
    ("catalog_snapshot_mismatch", "s <> c"), ("signals_older_than_snapshot", "g < s"), ("queue_older_than_catalog", "q < c"), ("queue_older_than_signals", "q < g")]))
cte("ac", ["audit_headers", "audit_snapshot", "audit_catalog", "audit_signals", "audit_queue"], """
SELECT h.*, (SELECT count(*) FROM audit_snapshot x WHERE x.generation_id = h.generation_id) AS n_snapshot, (SELECT count(*) FROM audit_catalog x WHERE x.generation_id = h.generation_id) AS n_catalog,
  (SELECT count(*) FROM audit_catalog x WHERE x.generation_id = h.generation_id AND analysis_state = 'deep') AS n_deep,
  (SELECT count(*) FROM audit_signals x WHERE x.generation_id = h.generation_id) AS n_signals, (SELECT count(*) FROM audit_queue x WHERE x.generation_id = h.generation_id) AS n_queue,
  (SELECT count(*) FROM audit_queue x WHERE x.generation_id = h.generation_id AND kind = 'project') AS n_project,
  (SELECT count(*) FROM audit_queue x WHERE x.generation_id = h.generation_id AND kind = 'signal') AS n_signal FROM audit_headers h""")
audit("counts", ["ac"], found("ac", [(c, f"{d} IS DISTINCT FROM {a}") for c, d, a in [
    ("snapshot_count_mismatch", "snapshot_count", "n_snapshot"), ("catalog_source_count_mismatch", "source_count", "n_snapshot"), ("catalog_project_count_mismatch", "project_count", "n_catalog"),
    ("signal_count_mismatch", "signal_count", "n_signals"), ("queue_count_mismatch", "pending_count", "n_queue"), ("project_queue_count_mismatch", "project_pending_count", "n_project"),
    ("signal_queue_count_mismatch", "signal_pending_count", "n_signal"), ("catalog_queue_count_mismatch", "catalog_pending_count", "n_queue"), ("deep_analysis_count_mismatch", "deep_count", "n_deep")]]))
_dup = lambda table, key, code: (f"SELECT generation_id, 'error' AS severity, '{code}' AS code, count(*) AS n FROM (SELECT generation_id, {key} AS k FROM {table} "
                                 f"GROUP BY ALL HAVING count(*) > 1 OR coalesce(max({key}), '') = '') d GROUP BY generation_id")
audit("uniqueness", ["audit_snapshot", "audit_catalog", "audit_artifacts", "audit_profiles", "audit_signals", "audit_sources", "audit_queue"], " UNION ALL ".join([
    _dup("audit_snapshot", "repo", "duplicate_snapshot_repository"), _dup("audit_catalog", "repo", "duplicate_catalog_repository"), _dup("audit_catalog", "slug", "duplicate_catalog_slug"),
    _dup("audit_catalog", "project_id", "duplicate_catalog_project_id"), _dup("audit_artifacts", "lower(repository) || ' ' || schema_version", "duplicate_analysis_repository"),
    _dup("audit_profiles", "lower(repository) || ' ' || schema_version", "duplicate_enrichment_repository"), _dup("audit_signals", "id", "duplicate_signal_id"),
    _dup("audit_signals", "url", "duplicate_signal_url"), _dup("audit_sources", "id", "duplicate_source_id"), _dup("audit_queue", "id", "duplicate_queue_id")]))
cte("acat", ["audit_catalog"], f"SELECT *, {canon('repo')} AS cn, {carried_error('repo', 'project_id', 'project_id_version')} AS carried FROM audit_catalog")
cte("asnap", ["audit_snapshot"], f"SELECT *, {canon('repo')} AS cn, {slug('repo')} AS slug FROM audit_snapshot")
cte("aart", ["audit_artifacts"], f"SELECT *, {canon('repository')} AS cn, {slug('repository')} AS slug FROM audit_artifacts")
cte("aref", ["acat", "asnap"], """
SELECT c.generation_id, max((s.stars IS NULL)::INT) AS absent, count(*) FILTER (WHERE c.stars IS DISTINCT FROM s.stars) AS stars
FROM acat c LEFT JOIN asnap s ON s.generation_id = c.generation_id AND s.cn = c.cn GROUP BY ALL""")
cte("aused", ["asnap", "audit_rules"], """
SELECT generation_id, count(DISTINCT repo) AS unknown FROM (SELECT generation_id, repo, unnest(string_split(coalesce(candidate_query, ''), ' | ')) AS q FROM asnap) u
WHERE (generation_id, q) NOT IN (SELECT (generation_id, query) FROM audit_rules) GROUP BY ALL""")
audit("references", ["aref", "aused", "acat", "aart", "asnap", "audit_headers"], found("aref", [("catalog_repository_missing_from_snapshot", "absent"), ("catalog_star_mismatch", "stars")])
      + " UNION ALL " + found("aused", [("unknown_candidate_query", "unknown")]) + """
UNION ALL SELECT generation_id, 'error', carried, count(*) FROM acat WHERE carried IS NOT NULL GROUP BY generation_id, carried
UNION ALL SELECT generation_id, 'error', 'catalog_queue_identity_version_mismatch', 1 FROM audit_headers WHERE queue_version IS DISTINCT FROM 2 OR queue_identity_version IS DISTINCT FROM 1
UNION ALL SELECT generation_id, 'error', 'legacy_artifact_in_identity_generation', count(*) FROM aart WHERE schema_version = 1 GROUP BY generation_id
UNION ALL SELECT a.generation_id, 'error', 'project_identity_cross_file_mismatch', count(*) FROM aart a
  JOIN (SELECT generation_id, cn, min(project_id) AS pid FROM acat WHERE carried IS NULL GROUP BY ALL) i ON i.generation_id = a.generation_id AND i.cn = a.cn
  WHERE a.schema_version = 2 AND a.project_id <> i.pid GROUP BY a.generation_id
UNION ALL SELECT generation_id, 'error', 'unresolved_legacy_collision', count(*) FROM (SELECT generation_id, slug FROM (
  SELECT generation_id, cn, slug FROM asnap UNION SELECT generation_id, cn, slug FROM aart WHERE schema_version < 2) n WHERE cn IS NOT NULL GROUP BY ALL HAVING count(DISTINCT cn) > 1) s GROUP BY generation_id""")
cte("qcover", ["audit_rules", "audit_status"], """
SELECT coalesce(d.generation_id, s.generation_id) AS generation_id, max((coalesce(d.n, 0) <> 1 OR coalesce(s.n, 0) <> 1)::INT) AS cover, max(coalesce(d.n > 1, false)::INT) AS definition
FROM (SELECT generation_id, query, count(*) AS n FROM audit_rules GROUP BY ALL) d FULL OUTER JOIN (SELECT generation_id, query, count(*) AS n FROM audit_status GROUP BY ALL) s
  ON s.generation_id = d.generation_id AND s.query = d.query GROUP BY ALL""")
cte("qtot", ["audit_status"], """
SELECT generation_id, count(*) FILTER (WHERE state NOT IN ('healthy', 'failed')) AS bad_state, count(*) FILTER (WHERE item_count IS NULL OR item_count < 0) AS bad_count,
  count(*) FILTER (WHERE (state = 'healthy' AND error IS NOT NULL) OR (state = 'failed' AND trim(coalesce(error, '')) = '')) AS bad_error,
  count(*) FILTER (WHERE state = 'healthy') AS ok, count(*) FILTER (WHERE state = 'failed') AS bad FROM audit_status GROUP BY ALL""")
cte("qh", ["audit_headers", "qcover", "qtot"], "SELECT h.*, cover, definition, bad_state, bad_count, bad_error, ok, bad FROM audit_headers h LEFT JOIN qcover c ON c.generation_id = h.generation_id LEFT JOIN qtot t ON t.generation_id = h.generation_id")
audit("query_health", ["qh"], found("qh", [
    ("invalid_query_rows", "NOT queries_is_list"), ("invalid_query_status_rows", "NOT status_is_list"), ("invalid_query_definition", "definition"), ("invalid_query_status_row", "status_non_objects"),
    ("query_status_coverage_mismatch", "cover"), ("invalid_query_state", "bad_state"), ("invalid_query_item_count", "bad_count"), ("invalid_query_error", "bad_error"), ("no_successful_query", "ok = 0"),
    ("successful_query_count_mismatch", "successful_query_count IS DISTINCT FROM ok"), ("failed_query_count_mismatch", "failed_query_count IS DISTINCT FROM bad"),
    ("catalog_query_failure_count_mismatch", "query_failure_count IS DISTINCT FROM bad"), ("partial_query_failure", "bad")]))
cte("tr", ["audit_headers", "audit_catalog"], """
SELECT h.*, invalid, daily, d_long, d_recent, eligible, recent FROM audit_headers h LEFT JOIN (
  SELECT generation_id, count(*) FILTER (WHERE heat_track NOT IN ('recent_momentum', 'long_term') OR heat_label = '' OR attention NOT BETWEEN 0 AND 100 OR endurance NOT BETWEEN 0 AND 100) AS invalid,
    count(*) FILTER (WHERE position <= 5) AS daily, count(*) FILTER (WHERE position <= 5 AND heat_track = 'long_term') AS d_long,
    count(*) FILTER (WHERE position <= 5 AND heat_track = 'recent_momentum') AS d_recent, count(*) FILTER (WHERE heat_track = 'long_term' AND attention >= 60 AND recommendation <> 'watch') AS eligible,
    count(*) FILTER (WHERE heat_track = 'recent_momentum') AS recent FROM audit_catalog GROUP BY ALL) c ON c.generation_id = h.generation_id""")
audit("tracks", ["tr"], found("tr", [
    ("invalid_heat_track", "invalid"), ("daily_track_count_mismatch", "daily_long_term IS DISTINCT FROM d_long OR daily_recent IS DISTINCT FROM d_recent OR d_long + d_recent <> daily"),
    ("daily_track_balance_mismatch", "daily = 5 AND eligible >= 2 AND recent >= 3 AND (d_long <> 2 OR d_recent <> 3)")]))
cte("us", ["audit_headers", "audit_signals"], f"""
SELECT s.generation_id, max((NOT {_http('url')})::INT) AS u, count(*) FILTER (WHERE score IS NULL OR isnan(score) OR score < 0 OR score > 1) AS sc,
  count(*) FILTER (WHERE {us('signals_at')} IS NOT NULL AND NOT coalesce(({us('signals_at')} - {us('published_at')}) / 3600000000.0::DOUBLE BETWEEN -2 AND CASE WHEN window_hours > 0 THEN window_hours ELSE 48 END, false)) AS outside
FROM audit_signals s JOIN audit_headers h ON h.generation_id = s.generation_id GROUP BY ALL""")
cte("uh", ["audit_headers", "us", "audit_catalog", "audit_sources"], f"""
SELECT h.*, u, sc, outside, (SELECT count(*) FROM audit_catalog c WHERE c.generation_id = h.generation_id AND NOT {_http('href')}) AS ev,
  (SELECT coalesce(max((NOT {_http('url')})::INT), 0) FROM audit_sources c WHERE c.generation_id = h.generation_id) AS so FROM audit_headers h LEFT JOIN us ON us.generation_id = h.generation_id""")
audit("urls_scores", ["uh"], found("uh", [
    ("unsafe_evidence_url", "ev"), ("unsafe_signal_url", "u"), ("unsafe_source_url", "so"), ("invalid_signal_score", "sc"),
    ("invalid_signal_window", "signals_at IS NOT NULL AND (window_hours IS NULL OR window_hours <= 0)"), ("signal_outside_window", "outside")]))
cte("so", ["audit_headers", "audit_sources"], """
SELECT h.*, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n_src FROM audit_headers h LEFT JOIN (
  SELECT generation_id, count(*) FILTER (WHERE state = 'healthy') AS ok, count(*) FILTER (WHERE state = 'failed') AS bad, count(*) AS n FROM audit_sources GROUP BY ALL) s ON s.generation_id = h.generation_id""")
audit("sources", ["so"], found("so", [
    ("healthy_source_count_mismatch", "healthy_source_count IS DISTINCT FROM ok"), ("failed_source_count_mismatch", "failed_source_count IS DISTINCT FROM bad"), ("invalid_source_state", "ok + bad <> n_src"),
    ("partial_signal_source_failure", "bad")]))
cte("fl", ["audit_headers", "audit_failures"], """
SELECT h.*, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n_fail FROM audit_headers h LEFT JOIN (
  SELECT generation_id, count(*) FILTER (WHERE coalesce(repository, '') = '' OR coalesce(error, '') = '') AS bad, count(*) AS n FROM audit_failures GROUP BY ALL) s ON s.generation_id = h.generation_id""")
audit("analysis_failures", ["fl"], found("fl", [("invalid_analysis_failure_rows", "NOT failures_is_list"), ("invalid_analysis_failure_row", "bad"), ("partial_static_analysis_failure", "n_fail")]))

# recorded catalog: the job's rows with altered fields
_no = "(try_cast(substr({}, 2, 4) AS INT) * 4 + try_cast(substr({}, 7) AS INT) - 1)".format
cte("recorded", ["catalog_rows"], """
SELECT * REPLACE (
  (obs_count + CASE WHEN no % 6 = 1 AND position = 2 THEN 1 ELSE 0 END) AS obs_count, CASE WHEN no % 7 = 2 AND position = 3 THEN NULL ELSE long_term_evidence END AS long_term_evidence,
  attention + CASE WHEN no % 8 = 3 AND position = 4 THEN 1 ELSE 0 END AS attention, growth_value + CASE WHEN no % 9 = 4 AND position = 5 THEN 1 ELSE 0 END AS growth_value,
  CASE WHEN no % 10 = 5 AND position = 6 THEN 'velocity_proxy' ELSE growth_kind END AS growth_kind,
  CASE WHEN no % 5 = 1 AND position = 1 THEN CASE WHEN analysis_state = 'deep' THEN 'static' ELSE 'deep' END ELSE analysis_state END AS analysis_state)
FROM (SELECT *, """ + _no("capture_id", "capture_id") + " AS no FROM catalog_rows) r")
cte("heat0", ["recorded"], f"""
SELECT r.capture_id AS generation_id, r.no, count(*) FILTER (WHERE r.obs_count <> o.obs_count OR r.long_term_evidence IS DISTINCT FROM
    CASE WHEN r.long_term AND o.p THEN 'multi_snapshot' WHEN r.long_term THEN 'structural_proxy' END) AS bad,
  max(r.obs_window) AS w, count(*) FILTER (WHERE r.long_term AND o.p) AS v, count(*) FILTER (WHERE r.verified) AS dv
FROM recorded r JOIN (SELECT capture_id, repo, obs_count, obs_window >= 7 AND obs_count >= 5 AND obs_count / obs_window::DOUBLE >= 0.7 AS p FROM grow) o
  ON o.capture_id = r.capture_id AND o.repo = r.repo GROUP BY ALL""")
audit("heat", ["grow", "heat0"], found("heat0", [
    ("heat_history_mismatch", "no % 11 IN (1, 2, 3, 4) OR dv <> v"), ("heat_observation_mismatch", "bad")]))
audit("catalog_rebuild", ["recorded", "catalog_rows", "captures"], f"""
SELECT generation_id, 'error' AS severity, 'score_semantics_mismatch' AS code, 1::BIGINT AS n FROM (
  SELECT capture_id AS generation_id FROM captures WHERE {_no('capture_id', 'capture_id')} % 12 = 1
  UNION SELECT r.capture_id FROM recorded r JOIN catalog_rows b ON b.capture_id = r.capture_id AND b.position = r.position
    WHERE {' OR '.join(f'r.{x} IS DISTINCT FROM b.{x}' for x in REBUILT)}) g""")
cte("gh", ["caps"], f"""
SELECT capture_id AS generation_id, no, CASE WHEN no % 11 = 6 OR no % 13 = 7 THEN NULL ELSE prev END AS pid, CASE WHEN no % 11 = 6 THEN true WHEN no % 13 = 7 THEN false ELSE prev IS NOT NULL END AS declared
FROM (SELECT *, {_no('capture_id', 'capture_id')} AS no, lag(capture_id) OVER (ORDER BY capture_no) AS prev FROM caps) c""")
cte("gr", ["gh", "recorded", "repo_snapshot"], """
SELECT g.generation_id, g.no, g.pid, g.declared, count(*) FILTER (WHERE (p.stars IS NOT NULL) <> (r.growth_kind = 'observed')) AS kinds,
  count(*) FILTER (WHERE p.stars IS NOT NULL AND r.growth_kind = 'observed' AND r.growth_value IS DISTINCT FROM n.stars - p.stars) AS vals,
  count(*) FILTER (WHERE r.growth_kind = 'observed') AS observed
FROM gh g JOIN recorded r ON r.capture_id = g.generation_id LEFT JOIN repo_snapshot n ON n.capture_id = r.capture_id AND n.repo = r.repo
LEFT JOIN repo_snapshot p ON p.capture_id = g.pid AND p.repo = r.repo GROUP BY ALL""")
audit("growth", ["gr"], found("gr", [
    ("missing_previous_snapshot", "declared AND pid IS NULL"), ("growth_kind_mismatch", "kinds"), ("observed_growth_mismatch", "vals"), ("no_observed_growth_after_history", "declared AND observed = 0")]))
cte("rq", ["wq"], f"""
SELECT queue_id AS generation_id, id, kind, priority, reason, repository, url, completed, {_no('queue_id', 'queue_id')} AS no FROM wq""")
cte("rec_q", ["rq"], """
SELECT generation_id, id, CASE WHEN no % 9 = 3 AND priority = 92 THEN 'idea' ELSE kind END AS kind, priority, CASE WHEN no % 9 = 2 AND priority = 96 THEN 'altered' ELSE reason END AS reason, repository, url
FROM rq WHERE NOT completed AND NOT (no % 9 = 1 AND priority = 100)""")
cte("q12", ["rq", "rec_q", "recorded"], """
SELECT g.generation_id, g.no, (SELECT max((kind NOT IN ('project', 'signal'))::INT) FROM rec_q x WHERE x.generation_id = g.generation_id) AS kinds,
  (SELECT count(*) FROM (SELECT id, kind, priority, reason, repository, url FROM rec_q x WHERE x.generation_id = g.generation_id
      EXCEPT SELECT id, kind, priority, reason, repository, url FROM rq y WHERE y.generation_id = g.generation_id AND NOT completed) a)
  + (SELECT count(*) FROM (SELECT id, kind, priority, reason, repository, url FROM rq y WHERE y.generation_id = g.generation_id AND NOT completed
      EXCEPT SELECT id, kind, priority, reason, repository, url FROM rec_q x WHERE x.generation_id = g.generation_id) b) AS stale,
  (SELECT count(*) FROM recorded r WHERE r.capture_id = g.generation_id AND r.position <= 5 AND r.analysis_state = 'deep'
     AND EXISTS (SELECT 1 FROM rq y WHERE y.generation_id = r.capture_id AND y.repository = r.repo AND NOT y.completed AND y.kind = 'project')) AS deep_open,
  (SELECT count(*) FROM recorded r WHERE r.capture_id = g.generation_id AND r.position <= 5 AND r.analysis_state <> 'deep'
     AND NOT EXISTS (SELECT 1 FROM rq y WHERE y.generation_id = r.capture_id AND y.repository = r.repo AND NOT y.completed AND y.kind = 'project')) AS not_applied
FROM (SELECT DISTINCT generation_id, no FROM rq) g""")
audit("queue_rebuild", ["q12"], found("q12", [
    ("invalid_queue_kind", "kinds"), ("pending_deep_analysis_mismatch", "no % 8 = 3"), ("stale_queue_items", "stale > 0"), ("completed_project_count_mismatch", "no % 8 = 1"),
    ("completed_signal_count_mismatch", "no % 8 = 2"), ("deep_analysis_without_current_evidence", "deep_open"), ("current_enrichment_not_applied", "not_applied")]))
_GROUPS = ["presence", "shape", "counts", "uniqueness", "references", "query_health", "tracks", "heat", "urls_scores", "sources", "queue_rebuild", "catalog_rebuild",
           "growth", "analysis_failures"]
cte("every_issue", [f"issues_{n}" for n in [*_GROUPS, "times"]] + ["audit_headers"],
    " UNION ALL ".join(f"SELECT generation_id, severity, code, n FROM issues_{n}" for n in _GROUPS)
    + " UNION ALL SELECT h.generation_id, severity, code, n FROM issues_times t JOIN audit_headers h ON t.generation_id = 'g' || h.gno")
SQL["audit_issues"] = query(["every_issue"], "SELECT generation_id, severity, code, n FROM every_issue")
_obs = "growth_kind = 'observed'"
cte("said_before", ["caps"], f"""
SELECT capture_id, CASE WHEN no % 11 = 6 THEN '1980-01-01T00:00:00Z' WHEN no % 13 = 7 THEN NULL ELSE strftime(make_timestamp(prev), '%Y-%m-%dT%H:%M:%SZ') END AS previous_at
FROM (SELECT *, {_no('capture_id', 'capture_id')} AS no, lag(captured_us) OVER (ORDER BY capture_no) AS prev FROM caps) c""")
cte("report", ["every_issue", "ac", "qh", "so", "audit_catalog", "audit_queue", "audit_failures", "generation_headers", "said_before"], f"""
SELECT a.generation_id, g.snapshot_at, g.catalog_at, p.previous_at,
  (SELECT count(*) FROM audit_failures f WHERE f.generation_id = a.generation_id) AS analysis_failure_count, a.n_snapshot AS repository_count, c.*, qh.ok AS successful_query_count, qh.bad AS failed_query_count,
  a.n_signals AS signal_count, so.ok AS healthy_source_count, so.bad AS failed_source_count, a.n_queue AS queue_pending_count,
  (SELECT count(*) FROM audit_queue q WHERE q.generation_id = a.generation_id AND kind = 'project' AND evidence_state = 'static_analysis_required') AS static_analysis_required_count,
  (SELECT count(*) FROM every_issue i WHERE i.generation_id = a.generation_id AND severity = 'error') AS error_count,
  (SELECT count(*) FROM every_issue i WHERE i.generation_id = a.generation_id AND severity = 'warning') AS warning_count
FROM ac a LEFT JOIN generation_headers g ON g.generation_id = 'g' || a.gno LEFT JOIN said_before p ON p.capture_id = a.generation_id JOIN qh ON qh.generation_id = a.generation_id JOIN so ON so.generation_id = a.generation_id JOIN (
  SELECT generation_id AS gid, count(*) AS project_count, count(*) FILTER (WHERE analysis_state = 'deep') AS deep_analysis_count, count(*) FILTER (WHERE {_obs}) AS observed_project_count,
    count(*) FILTER (WHERE {_obs} AND growth_value > 0) AS positive_growth_count, count(*) FILTER (WHERE {_obs} AND growth_value = 0) AS flat_growth_count,
    count(*) FILTER (WHERE {_obs} AND growth_value < 0) AS negative_growth_count, coalesce(sum(growth_value) FILTER (WHERE {_obs}), 0)::BIGINT AS observed_net_star_change,
    count(*) FILTER (WHERE position <= 5 AND heat_track = 'long_term') AS daily_long_term, count(*) FILTER (WHERE position <= 5 AND heat_track = 'recent_momentum') AS daily_recent
  FROM audit_catalog GROUP BY ALL) c ON c.gid = a.generation_id""")
_status = "CASE WHEN error_count > 0 THEN 'failed' WHEN warning_count > 0 THEN 'degraded' ELSE 'healthy' END AS status"
SQL["audit_report"] = query(["report"], f"""
SELECT * EXCLUDE (gid), CASE WHEN observed_project_count = project_count THEN 'observed' WHEN observed_project_count > 0 THEN 'mixed_observation' ELSE 'first_observation_proxy' END AS growth_mode, {_status} FROM report""")
SQL["run_status"] = query(["report"], f"""
SELECT generation_id, {_status}, snapshot_at, repository_count, project_count, deep_analysis_count, signal_count, queue_pending_count, error_count, warning_count FROM report""")
