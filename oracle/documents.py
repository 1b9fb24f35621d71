"""Checking SQL for document contracts: what each named fault must break, read off the formats by hand.

``@n`` stands for the row's number and ``@id`` for its project's id, as in the documents.
"""

from oracle.core import cte, query

EXPECTED = {
    "github-snapshot": {
        "version": [('/schema_version', 'enum', 'must be one of 1')],
        "no_queries": [('/queries', 'min_items', 'must have at least 1 items')],
        "twin_queries": [('/queries', 'unique_items', 'must not repeat items')],
        "blank_query": [('/queries/1', 'min_length', 'must have at least 1 letters')],
        "bad_time": [('/captured_at', 'format', 'must be a time')],
        "no_such_day": [('/captured_at', 'format', 'must be a time')],
        "no_status": [('/', 'together', 'query_status must come with the rest of its group')],
        "no_counts": [('/', 'together', 'failed_query_count must come with the rest of its group'), ('/', 'together', 'successful_query_count must come with the rest of its group')],
        "healthy_error": [('/query_status/0/error', 'must_be_null', 'must be null')],
        "failed_silent": [('/query_status/1/error', 'type', 'must be a text')],
        "state": [('/query_status/0/state', 'enum', 'must be one of healthy, failed')],
        "count_text": [('/count', 'type', 'must be a whole number')],
        "count_half": [('/count', 'type', 'must be a whole number')],
        "count_null": [('/count', 'type', 'must be a whole number')],
        "less_than_none": [('/repositories/1/forks', 'minimum', 'must be at least 0')],
        "bad_repo": [('/repositories/1/repo', 'format', 'must be a repository'), ('/repositories/1/repo', 'pattern', 'must match the pattern')],
        "bad_scheme": [('/repositories/1/url', 'format', 'must be a web address'), ('/repositories/1/url', 'pattern', 'must match the pattern')],
        "login_url": [('/repositories/1/url', 'format', 'must be a web address')],
        "long_license": [('/repositories/1/license', 'max_length', 'must have at most 100 letters')],
        "license_number": [('/repositories/1/license', 'type', 'must be a text')],
        "twin_topics": [('/repositories/1/topics', 'unique_items', 'must not repeat items')],
        "no_owner": [('/repositories/1', 'required', 'owner is required')],
        "new_field": [('/repositories/1', 'unknown_field', 'mood is not a known field')],
        "state_done": [('/repositories/1/analysis_state', 'enum', 'must be one of pending')],
        "list_as_text": [('/repositories', 'type', 'must be a list')],
        "text_row": [('/repositories/1', 'type', 'must be an object')],
    },
    "technical-signals": {
        "long_window": [('/windowHours', 'maximum', 'must be at most 720')],
        "no_window": [('/windowHours', 'minimum', 'must be at least 1')],
        "kind": [('/signals/0/kind', 'enum', 'must be one of official, aggregated, ranking, curated')],
        "score_over": [('/signals/0/score', 'maximum', 'must be at most 1')],
        "score_under": [('/signals/0/score', 'minimum', 'must be at least 0')],
        "score_text": [('/signals/0/score', 'type', 'must be a number')],
        "no_sources": [('/signals/0/sources', 'min_items', 'must have at least 1 items')],
        "twin_sources": [('/signals/0/sources', 'unique_items', 'must not repeat items')],
        "late": [('/signals/0/publishedAt', 'format', 'must be a time')],
        "top_six": [('/topSignals', 'max_items', 'must have at most 5 items')],
        "growth_half": [('/signals/1/reportedDailyGrowth', 'type', 'must be a whole number')],
        "bad_latest": [('/sourceStatus/0/latestItemAt', 'format', 'must be a time')],
        "two_faults": [('/signalCount', 'minimum', 'must be at least 0'), ('/signals/0/title', 'min_length', 'must have at least 1 letters')],
        "failed_silent": [('/sourceStatus/0/error', 'type', 'must be a text')],
    },
    "static-evidence": {
        "version": [('/schemaVersion', 'enum', 'must be one of 0, 1, 2')],
        "old_with_id": [('/', 'forbidden', 'projectId is not allowed here'), ('/', 'forbidden', 'projectIdVersion is not allowed here')],
        "oldest": [('/', 'forbidden', 'analyzed_at is not allowed here')],
        "no_id": [('/', 'required', 'projectId is required')],
        "bad_id": [('/projectId', 'pattern', 'must match the pattern')],
        "too_many_files": [('/scanned_files', 'maximum', 'must be at most 12000')],
        "half_language": [('/language_files/C~1C++', 'type', 'must be a whole number')],
        "no_tests": [('/indicators', 'required', 'tests is required')],
        "flag_text": [('/indicators/ci', 'type', 'must be true or false')],
        "unknown_indicator": [('/indicators', 'unknown_field', 'wiki is not a known field')],
        "long_hint": [('/license_hint', 'max_length', 'must have at most 500 letters')],
        "over_sure": [('/confidence', 'maximum', 'must be at most 100')],
        "long_warning": [('/warnings/1', 'max_length', 'must have at most 2000 letters')],
        "odd_repository": [('/repository', 'format', 'must be a repository'), ('/repository', 'pattern', 'must match the pattern')],
        "here": [('/source', 'format', 'must be a web address'), ('/source', 'pattern', 'must match the pattern')],
    },
    "project-enrichment": {
        "undated": [('/', 'required', 'sourcePushedAt is required')],
        "oldest_dated": [('/', 'forbidden', 'sourceAnalysisAt is not allowed here'), ('/', 'forbidden', 'sourcePushedAt is not allowed here')],
        "no_skill": [('/capabilities', 'min_items', 'must have at least 1 items')],
        "blank_term": [('/taskTerms/0', 'min_length', 'must have at least 1 letters')],
        "long_title": [('/titleZh', 'max_length', 'must have at most 500 letters')],
        "number_title": [('/titleZh', 'type', 'must be a text')],
        "bad_source": [('/sourceUrl', 'format', 'must be a web address'), ('/sourceUrl', 'pattern', 'must match the pattern')],
        "id_version": [('/projectIdVersion', 'enum', 'must be one of 1')],
        "no_risk": [('/', 'required', 'limitation is required')],
        "many_skills": [('/capabilities', 'max_items', 'must have at most 64 items')],
    },
    "signal-enrichment": {
        "model": [('/model', 'min_length', 'must have at least 1 letters')],
        "bad_key": [('/items/no address~01', 'format', 'must be a web address'), ('/items/no address~01', 'pattern', 'must match the pattern')],
        "half_dated": [('/items/https:~1~1git.example.org~1acme~1tool-@n', 'together', 'analyzedAt must come with the rest of its group')],
        "no_text": [('/items/https:~1~1git.example.org~1acme~1tool-@n/takeawayZh', 'min_length', 'must have at least 1 letters')],
        "items_list": [('/items', 'type', 'must be an object')],
        "extra": [('/items/https:~1~1git.example.org~1acme~1tool-@n', 'unknown_field', 'mood is not a known field')],
    },
    "catalog": {
        "no_version": [('/', 'required', 'schemaVersion is required')],
        "version": [('/schemaVersion', 'enum', 'must be one of 1, 2, 3')],
        "version_two": [('/', 'unknown_field', 'projectIdVersion is not a known field'), ('/projects/0', 'unknown_field', 'projectId is not a known field'), ('/projects/0', 'unknown_field', 'projectIdVersion is not a known field')],
        "model": [('/scoreModelVersion', 'enum', 'must be one of evidence-v2')],
        "mode": [('/growthMode', 'enum', 'must be one of observed, mixed_observation, first_observation_proxy')],
        "no_history": [('/heatHistory/maximumSnapshotCount', 'minimum', 'must be at least 1')],
        "tracks": [('/dailyTrackCounts', 'required', 'longTerm is required')],
        "pending_twins": [('/pendingDeepAnalysis', 'unique_items', 'must not repeat items')],
        "failure": [('/analysisFailures/0/error', 'min_length', 'must have at least 1 letters')],
        "over_score": [('/projects/0/enduranceScore', 'maximum', 'must be at most 100')],
        "no_evidence": [('/projects/0/evidence', 'min_items', 'must have at least 1 items')],
        "bad_href": [('/projects/0/evidence/0/href', 'format', 'must be a web address'), ('/projects/0/evidence/0/href', 'pattern', 'must match the pattern')],
        "explained": [('/projects/0/scoreExplanations/reuseFit/score', 'minimum', 'must be at least 0')],
        "twin_facts": [('/projects/0/scoreExplanations/attention/facts', 'unique_items', 'must not repeat items')],
        "unexplained": [('/projects/0/scoreExplanations', 'required', 'endurance is required')],
        "label_time": [('/projects/0/capturedAt', 'pattern', 'must match the pattern')],
        "advice": [('/projects/0/recommendation', 'enum', 'must be one of 了解, 收藏, 隔离试用, 观望')],
        "state": [('/projects/0/analysisState', 'enum', 'must be one of 事实初筛, 静态分析, 深度分析, 画像待复核')],
        "no_project_id": [('/projects/0', 'required', 'projectId is required')],
    },
    "codex-queue": {
        "version_one": [('/', 'forbidden', 'projectIdVersion is not allowed here'), ('/items/0', 'unknown_field', 'projectId is not a known field'), ('/items/0', 'unknown_field', 'projectIdVersion is not a known field')],
        "no_id_version": [('/', 'required', 'projectIdVersion is required')],
        "limit": [('/scope/projectLimit', 'maximum', 'must be at most 30')],
        "priority": [('/items/0/priority', 'minimum', 'must be at least -100')],
        "kind": [('/items/1/kind', 'enum', 'must be one of project, signal')],
        "parent_path": [('/items/0/inputPaths/0', 'forbidden_pattern', 'must not match the pattern')],
        "no_paths": [('/items/0/inputPaths', 'min_items', 'must have at least 1 items')],
        "other_root": [('/items/1/outputPath', 'pattern', 'must match the pattern')],
        "unready": [('/items/0/sourceAnalysisAt', 'type', 'must be a text')],
        "task_id": [('/items/0/id', 'pattern', 'must match the pattern')],
    },
    "generation-manifest": {
        "ready_error": [('/error', 'must_be_null', 'must be null')],
        "ready_empty": [('/artifacts', 'min_items', 'must have at least 1 items'), ('/hashes', 'min_properties', 'must have at least 1 entries')],
        "ready_unaudited": [('/audit', 'type', 'must be an object')],
        "failed_silent": [('/error', 'type', 'must be a text'), ('/failureStage', 'enum', 'must be one of build, schema_validation, audit, manifest, publish')],
        "building_audited": [('/audit', 'must_be_null', 'must be null')],
        "errors": [('/audit/errorCount', 'enum', 'must be one of 0')],
        "climbing": [('/artifacts/0', 'pattern', 'must match the pattern')],
        "hash": [('/hashes/catalog~1latest.json', 'pattern', 'must match the pattern')],
        "hash_key": [('/hashes/notes.txt', 'pattern', 'must match the pattern')],
        "stage": [('/failureStage', 'enum', 'must be one of build, schema_validation, audit, manifest, publish')],
        "id": [('/generationId', 'pattern', 'must match the pattern')],
    },
    "current-generation": {
        "no_previous": [('/', 'required', 'previousGenerationId is required')],
        "previous": [('/previousGenerationId', 'min_length', 'must have at least 1 letters'), ('/previousGenerationId', 'pattern', 'must match the pattern')],
        "hash": [('/manifestSha256', 'pattern', 'must match the pattern')],
        "time": [('/publishedAt', 'type', 'must be a text')],
        "other": [('/', 'unknown_field', 'note is not a known field')],
    },
}
UNREADABLE = {name: [("/", "unreadable", "must be strict JSON")] for name in ("cut", "twice", "not_finite")}
IDENTITIES = {
    "catalog": {
        "other_id": [("/projects/0/projectId", "project_id_mismatch", "acme-tool--0123456789abcdef0123")], "odd_repo": [("/projects/0/projectId", "invalid_repository_format", "@id")],
        "twin_projects": [("/projects", "duplicate_normalized_repository", "acme/tool-@n")], "no_project_id": [("/projects/0/projectId", "invalid_project_id", "")]},
    "codex-queue": {
        "other_id": [("/items/0/projectId", "project_id_mismatch", "acme-tool--0123456789abcdef0123")], "other_output": [("/items/0", "queue_project", "disagrees with outputPath, requiredFields")],
        "task_id": [("/items/0", "queue_project", "disagrees with id")]}
    | {name: [("/items/0", "queue_project", "disagrees with inputPaths")] for name in ("parent_path", "no_paths", "two_catalogs", "no_evidence")},
}


def expected(kind: str, faults: dict) -> str:
    """Every document with a fault and what that fault breaks."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (name, *found)) + ")" for name, issues in faults.items() for found in issues)
    named = "replace(replace({}, '@id', 'acme-tool-@n--' || substr(sha256('acme/tool-' || key), 1, 20)), '@n', key)"
    return query([f"documents_{kind.replace('-', '_')}"], f"""
SELECT key, {named.format('path')} AS path, rule, {named.format('message')} AS message
FROM documents_{kind.replace('-', '_')} JOIN (VALUES {rows}) AS e(fault, path, rule, message) USING (fault)""")


SQL: dict[str, str] = {f"contract_{kind.replace('-', '_')}": expected(kind, faults | UNREADABLE) for kind, faults in EXPECTED.items()}
SQL["catalog_identity_contract"] = expected("catalog", IDENTITIES["catalog"])
SQL["queue_identity_contract"] = expected("codex-queue", IDENTITIES["codex-queue"])

#: The first failing check of a draft: broken contracts by path and rule, then version, time and identity.
LATER = {"version_one": ("unsupported_version", "/schemaVersion"), "early": ("analyzed_before_source", "/analyzedAt"), "other_id": ("project_id_mismatch", "/projectId")}


def drafts(kind: str, draft: str, later: dict) -> str:
    faults = {name: min(issues)[:2][::-1] for name, issues in (EXPECTED[kind] | UNREADABLE).items()} | later
    rows = ", ".join(f"('{name}', '{rule}', '{path}')" for name, (rule, path) in faults.items())
    return f"""SELECT CASE WHEN key::BIGINT % 13 = 5 THEN 'poem' ELSE '{draft}' END AS draft, key,
  CASE WHEN key::BIGINT % 13 = 5 THEN 'unknown_kind' ELSE rule END AS reason, CASE WHEN key::BIGINT % 13 = 5 THEN '/' ELSE replace(path, '@n', key) END AS path
FROM documents_{kind.replace('-', '_')} LEFT JOIN (VALUES {rows}) AS e(fault, rule, path) USING (fault)"""


cte("draft_checks", ["documents_project_enrichment", "documents_signal_enrichment"],
    drafts("project-enrichment", "project", LATER) + "\nUNION ALL " + drafts("signal-enrichment", "signal", {}))
SQL["rejected_drafts"] = query(["draft_checks"], "SELECT draft, key, reason, path FROM draft_checks WHERE reason IS NOT NULL")
SQL["ingested_drafts"] = query(["draft_checks"], """
SELECT draft, key, CASE draft WHEN 'project' THEN 'enrichment/acme-tool-' || key || '--' || substr(sha256('acme/tool-' || key), 1, 20) || '.json' ELSE 'signals/enrichment.json' END AS target
FROM draft_checks WHERE reason IS NULL""")
