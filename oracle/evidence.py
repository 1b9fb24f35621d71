"""Checking SQL for static evidence and artifact versions."""

from beaconry import constants as K
from oracle.catalog import canon, carried_error, project_id, slug
from oracle.core import cte, query, us

SQL: dict[str, str] = {}
_in = lambda items: "(" + ", ".join(f"'{i}'" for i in items) + ")"

_NAME = "split_part(path, '/', -1)"
_FOLDERS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
cte("scanned", ["files"], f"""
SELECT * FROM (
  SELECT *, lower(path) AS low, lower({_NAME}) AS name, {_FOLDERS} AS folders, coalesce(regexp_extract(lower({_NAME}), '^.+(\\.[^.]+)$', 1), '') AS suffix,
    coalesce(list_aggregate(list_transform({_FOLDERS}, lambda f: '1' || f || chr(1)), 'string_agg', ''), '') || '0' || {_NAME} AS walk
  FROM files WHERE NOT is_symlink) f
  WHERE len(list_intersect(list_transform(folders, lambda f: lower(f)), {list(K.SKIP_DIRECTORIES)})) = 0 AND suffix NOT IN {_in(K.SKIP_SUFFIXES)}""")
cte("marked", ["scanned"], f"""
SELECT *, len(list_intersect(list_transform(folders, lambda f: lower(f)), ['test', 'tests', '__tests__', 'spec', 'specs'])) > 0
    OR stem IN ('test', 'tests', 'spec') OR starts_with(stem, 'test_') OR ends_with(stem, '_test') OR ends_with(stem, '_spec')
    OR contains(name, '.test.') OR contains(name, '.spec.') AS is_test,
  CASE WHEN suffix IN {_in(K.TEXT_SUFFIXES)}
    THEN len(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(TODO|FIXME|XXX)(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')) ELSE 0 END AS todo
FROM (SELECT *, CASE WHEN suffix <> '' THEN left(name, length(name) - length(suffix)) ELSE name END AS stem FROM scanned) s""")
SQL["scan_files"] = query(["scanned"], "SELECT repo, path, suffix FROM scanned")
cte("languages", ["scanned"], """
SELECT repo, suffix, files, row_number() OVER (PARTITION BY repo ORDER BY files DESC, first_seen)::INT AS rank FROM (
  SELECT repo, CASE WHEN suffix = '' THEN '[none]' ELSE suffix END AS suffix, count(*) AS files, min(walk) AS first_seen FROM scanned GROUP BY ALL) g""")
SQL["language_profile"] = query(["languages"], "SELECT repo, suffix, files, rank FROM languages WHERE rank <= 12")
SQL["test_file_flag"] = query(["marked"], "SELECT repo, path, is_test FROM marked")
SQL["todo_markers"] = query(["marked"], "SELECT repo, sum(todo)::BIGINT AS todo_markers FROM marked GROUP BY repo")
_IND = {
    "readme": "starts_with(name, 'readme')", "license": "starts_with(name, 'license') OR starts_with(name, 'copying')", "tests": "is_test",
    "ci": "starts_with(low, '.github/workflows/')", "docker": f"name IN {_in(K.DOCKER_NAMES)}", "dependency_lock": f"name IN {_in(K.LOCK_NAMES)}",
    "package_manifest": f"name IN {_in(K.MANIFEST_NAMES)}", "examples": "split_part(low, '/', 1) IN ('examples', 'example', 'demo') AND contains(low, '/')",
    "docs": "split_part(low, '/', 1) IN ('docs', 'doc') AND contains(low, '/')", "environment_example": f"name IN {_in(K.ENV_EXAMPLE_NAMES)}"}
cte("indicators", ["marked"], "SELECT repo, count(*) AS scanned_files, count(*) FILTER (WHERE is_test) AS test_files, sum(todo)::BIGINT AS todo_markers, "
    + ", ".join(f"bool_or({v}) AS ind_{k}" for k, v in _IND.items()) + " FROM marked GROUP BY repo")
SQL["presence_indicators"] = query(["indicators"], "SELECT repo, " + ", ".join(f"ind_{k}" for k in _IND) + " FROM indicators")
_sig = " ".join(f"WHEN contains(body, '{s}') THEN '{n}'" for n, s in K.LICENSE_SIGNATURES)
cte("hints", ["files"], f"""
SELECT repo, CASE {_sig} ELSE '{K.LICENSE_UNRECOGNISED}' END AS license_hint FROM (
  SELECT repo, lower(text) AS body, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn
  FROM files WHERE NOT is_symlink AND NOT contains(path, '/') AND (starts_with(lower(path), 'license') OR starts_with(lower(path), 'copying'))) l WHERE rn = 1""")
SQL["license_hint"] = query(["hints"], "SELECT repo, license_hint FROM hints")
SQL["evidence_summary"] = query(["indicators", "languages", "hints"], f"""
SELECT i.repo, 2 AS schema_version, {project_id('i.repo')} AS project_id, scanned_files, test_files, todo_markers, license_hint,
  least(95, 35 + 6 * ({' + '.join(f'ind_{k}::INT' for k in _IND)}) + least(test_files, 12))::INT AS confidence,
  concat_ws('|', CASE WHEN NOT ind_license THEN 'no license file detected' END,
    'static inspection only; code was not executed') AS warnings, language_files
FROM indicators i JOIN (SELECT repo, string_agg(suffix || '=' || files, '|' ORDER BY rank) AS language_files FROM languages WHERE rank <= 12 GROUP BY repo) l ON l.repo = i.repo
LEFT JOIN hints h ON h.repo = i.repo""")

# --- versions -----------------------------------------------------------------------------
cte("ranked_copies", ["artifact_copies"], f"""
SELECT *, lower(repository) AS repository_key, {canon('repository')} AS cn, {slug('repository')} AS slug,
  max(schema_version) OVER (PARTITION BY lower(repository)) AS top, count(*) OVER (PARTITION BY lower(repository), schema_version) AS n FROM artifact_copies""")
cte("shared_slugs", ["ranked_copies"], "SELECT slug FROM ranked_copies WHERE cn IS NOT NULL GROUP BY slug HAVING count(DISTINCT cn) > 1")
SQL["authoritative_artifact"] = query(["ranked_copies", "shared_slugs"], """
SELECT repository_key, schema_version, repository, analyzed_at FROM ranked_copies
WHERE schema_version = top AND n = 1 AND NOT (schema_version < 2 AND slug IN (SELECT slug FROM shared_slugs))""")
SQL["authoritative_artifact_errors"] = query(["ranked_copies", "shared_slugs"], """
SELECT DISTINCT repository_key, 'duplicate_version' AS error FROM ranked_copies WHERE schema_version = top AND n > 1
UNION ALL SELECT repository_key, 'ambiguous_legacy_slug' FROM ranked_copies
WHERE schema_version = top AND n = 1 AND schema_version < 2 AND slug IN (SELECT slug FROM shared_slugs)""")


def _upgrade(name, source):
    cte(name, [source], f"""
    WITH have AS MATERIALIZED (SELECT project_id AS tid, min({{'a': lower(repository), 'b': analyzed_at}}) AS h FROM {source} WHERE schema_version = 2 GROUP BY ALL),
    new AS MATERIALIZED (SELECT *, {project_id('repository')} AS target_id FROM {source} WHERE schema_version = 1)
    SELECT ord, schema_version, repository, analyzed_at, target_id, CASE WHEN target_id IS NULL THEN 'invalid_repository' WHEN h IS NULL THEN 'migrated'
      WHEN h.a = lower(repository) AND h.b IS NOT DISTINCT FROM analyzed_at THEN 'equivalent' ELSE 'conflict' END AS status
    FROM new LEFT JOIN have ON tid = target_id
    UNION ALL SELECT ord, schema_version, repository, analyzed_at, project_id, CASE WHEN schema_version = 2 THEN 'already_current' ELSE 'legacy_unmigrated' END
    FROM {source} WHERE schema_version <> 1""")


_upgrade("upgraded", "artifact_copies")
_upgrade("upgraded_clean", "static_evidence")
SQL["upgrade_evidence_versions"] = query(["upgraded"], "SELECT ord, schema_version, repository, analyzed_at, target_id, status FROM upgraded")
SQL["upgrade_totals"] = query(["upgraded"], "SELECT status, count(*) AS n FROM upgraded GROUP BY status")
SQL["upgrade_applied"] = query(["upgraded_clean"], """
SELECT ord, 2 AS schema_version, repository, target_id AS project_id FROM upgraded_clean
WHERE status = 'migrated' AND (SELECT count(*) FROM upgraded_clean WHERE status = 'conflict') = 0""")
cte("slug_owners", ["ranked_copies"], "SELECT slug, count(DISTINCT cn) AS owners FROM ranked_copies WHERE cn IS NOT NULL GROUP BY slug")
SQL["downgrade_evidence_versions"] = query(["ranked_copies", "slug_owners"], """
SELECT ord, 1 AS schema_version, repository, analyzed_at, r.slug, CASE WHEN cn IS NULL THEN 'invalid_repository' WHEN owners > 1 THEN 'slug_collision' ELSE 'downgraded' END AS status
FROM ranked_copies r LEFT JOIN slug_owners o ON o.slug = r.slug WHERE schema_version = 2""")
SQL["overlay_newer"] = query(["current_artifacts", "staging"], f"""
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.key, b.key) AS key, source, CASE WHEN source <> 'current' THEN b.repository ELSE a.repository END AS repository,
  CASE WHEN source <> 'current' THEN b.schema_version ELSE a.schema_version END AS schema_version, CASE WHEN source <> 'current' THEN b.stamp ELSE a.stamp END AS stamp,
  CASE WHEN source <> 'current' THEN b.payload ELSE a.payload END AS payload
FROM (SELECT a, b, CASE WHEN a.key IS NULL THEN 'staged_missing' WHEN coalesce(b.schema_version >= 1 AND {us('b.stamp')} > {us('a.stamp')}, false) THEN 'staged_newer' ELSE 'current' END AS source
  FROM (SELECT a, b FROM current_artifacts a FULL OUTER JOIN staging b ON a.kind = b.kind AND a.key = b.key) j) x""")
SQL["stale_write_guard"] = query(["current_artifacts", "staging"], f"""
SELECT kind, key, repository, stamp, reason, reason IS NULL AS accepted FROM (
  SELECT s.kind, s.key, s.repository, s.stamp, CASE WHEN e.repository IS NULL THEN NULL
    WHEN NOT (s.repository = e.repository OR coalesce(s.schema_version = 2 AND e.schema_version = 2 AND {canon('s.repository')} = {canon('e.repository')}, false)) THEN 'owned_by_other_repository'
    WHEN {us('e.stamp')} IS NOT NULL AND ({us('s.stamp')} IS NULL OR {us('s.stamp')} < {us('e.stamp')}) THEN 'older_than_existing' END AS reason
  FROM staging s LEFT JOIN current_artifacts e ON e.kind = s.kind AND e.key = s.key) x""")
cte("drafts", ["project_enrichment"], f"""
SELECT ord, project_id, CASE WHEN schema_version <> 2 THEN 'unsupported_version' WHEN {us('analyzed_at')} IS NULL OR {us('source_analysis_at')} IS NULL THEN 'invalid_time'
  WHEN {us('analyzed_at')} < {us('source_analysis_at')} THEN 'analyzed_before_source' WHEN ident IS NOT NULL THEN ident WHEN coalesce(summary, '') = '' THEN 'incomplete' END AS reason
FROM (SELECT *, {carried_error('repository', 'project_id', 'project_id_version')} AS ident FROM project_enrichment) p""")
SQL["ingest_drafts"] = query(["drafts"], "SELECT ord, reason, CASE WHEN reason IS NULL THEN 'enrichment/' || project_id END AS target FROM drafts")
