"""JSON documents of every kind, one per driver row, with named faults dealt by the row's number.

A sample is a sound document; ``@n`` in it stands for the row's number, ``@id`` for the id of its project.  A fault sets or drops places of the sample.
"""

from __future__ import annotations

import json

from beaconry.sources.bindings import LOGICAL

DROP = object()
_T, _ID, _URL = "2024-05-0{}T10:00:00Z", "@id", "https://git.example.org/acme/tool-@n"
_LONG = {n: "x" * n for n in (101, 301, 501, 2001)}

_REPO = {"repo": "acme/tool-@n", "url": _URL, "description": None, "owner": "acme", "language": "Scala", "license": None, "topics": ["etl", "sql"], "stars": "@n", "forks": 3, "open_issues": 0,
         "created_at": _T.format(1), "updated_at": _T.format(2), "pushed_at": "2024-05-03T10:00:00.250+02:00", "default_branch": "main", "captured_at": _T.format(4), "candidate_query": "topic:etl",
         "analysis_state": "pending"}
_SIGNAL = {"id": "s-@n", "kind": "official", "title": "Release @n", "summaryZh": "Text", "url": _URL, "source": "feed", "sourceUrl": "http://feed.example.org", "publishedAt": _T.format(1), "score": 0.5,
           "evidence": [], "sources": ["feed"]}
_EXPLAINED = {"score": None, "summary": "Text", "facts": ["a", "b"], "proxies": [], "limitations": [], "upgradeConditions": []}
_PROJECT = {"slug": "acme-tool", "repo": "acme/tool-@n", "title": "Tool @n", "description": "", "category": "data", "language": "Scala", "license": "MIT", "stars": "@n", "growthValue": -4, "growthLabel": "g",
            "growthKind": "observed", "enduranceScore": 70, "heatTrack": "long_term", "heatLabel": "h", "longTermEvidenceKind": None, "heatObservationCount": 3, "heatObservationWindow": 30, "trend": "t",
            "analysisState": "静态分析", "sourcePushedAt": None, "analysisAnalyzedAt": _T.format(2), "enrichmentAnalyzedAt": None, "whyNow": "w", "reusePlan": "r", "risk": "k", "capabilities": [],
            "taskTerms": ["load"], "evidence": [{"label": "Code", "detail": "d", "href": _URL}], "capturedAt": "2024-05-04 10:00 UTC", "projectIdVersion": 1, "projectId": _ID, "attentionScore": 0,
            "engineeringReadiness": None, "reuseFitScore": 100, "evidenceCompleteness": 50,
            "scoreExplanations": {name: _EXPLAINED for name in ("attention", "endurance", "engineeringReadiness", "reuseFit", "evidenceCompleteness")}, "recommendation": "收藏", "fitHypothesis": "f"}
_TASK = {"id": "project:" + _ID, "kind": "project", "priority": 96, "projectIdVersion": 1, "projectId": _ID, "repository": "acme/tool-@n", "title": "Tool", "reason": "r", "evidenceState": "ready",
         "sourcePushedAt": _T.format(1), "sourceAnalysisAt": _T.format(2), "previousAnalyzedAt": None, "inputPaths": ["data/analysis/" + _ID + ".json", "data/catalog/latest.json"],
         "outputPath": "data/enrichment/" + _ID + ".json", "requiredFields": ["projectIdVersion", "projectId"], "safety": "s"}
_SIGNAL_TASK = {"id": "signal:s-@n", "kind": "signal", "priority": 90, "title": "Release", "url": _URL, "source": None, "reason": "r", "sourcePublishedAt": None, "previousAnalyzedAt": None,
                "inputPaths": ["data/signals/latest.json"], "outputPath": "data/signals/enrichment.json", "requiredFields": ["titleZh"], "safety": "s"}

#: kind: driver table, its number, sample
SAMPLES = {
    "github-snapshot": ("part", "p_partkey", {
        "schema_version": 1, "captured_at": _T.format(4), "queries": ["topic:etl", "topic:sql"],
        "query_status": [{"query": "topic:etl", "state": "healthy", "item_count": 2, "error": None}, {"query": "topic:sql", "state": "failed", "item_count": 0, "error": "refused"}],
        "successful_query_count": 1, "failed_query_count": 1, "count": 2, "repositories": [_REPO, _REPO | {"repo": "acme/other"}]}),
    "technical-signals": ("pages", "page_id", {
        "schemaVersion": 1, "capturedAt": _T.format(4), "windowHours": 48, "signalCount": 1, "healthySourceCount": 1, "failedSourceCount": 0,
        "sourceStatus": [{"id": "feed", "name": "Feed", "url": "http://feed.example.org", "state": "healthy", "itemCount": 1, "latestItemAt": None, "error": None}],
        "topSignals": [], "signals": [_SIGNAL, _SIGNAL | {"repo": "acme/tool", "reportedDailyGrowth": 5}]}),
    "static-evidence": ("part", "p_partkey", {
        "schemaVersion": 2, "projectIdVersion": 1, "projectId": _ID, "repository": "acme/tool-@n", "source": _URL, "analyzed_at": _T.format(2), "scanned_files": 12, "language_files": {"Scala": 9, "C/C++": 3},
        "indicators": {name: True for name in ("readme", "license", "tests", "ci", "docker", "dependency_lock", "package_manifest", "examples", "docs", "environment_example")},
        "counts": {"test_files": 2, "todo_markers": 0}, "license_hint": None, "confidence": 80, "warnings": []}),
    "project-enrichment": ("part", "p_partkey", {
        "schemaVersion": 2, "projectIdVersion": 1, "projectId": _ID, "repository": "acme/tool-@n", "sourcePushedAt": _T.format(1), "sourceAnalysisAt": _T.format(2), "analyzedAt": _T.format(3),
        "titleZh": "t", "summaryZh": "s", "category": "c", "capabilities": ["load"], "taskTerms": ["load"], "bestFor": "b", "reusePlan": "r", "limitation": "l", "evidenceSummary": "e", "sourceUrl": _URL}),
    "signal-enrichment": ("pages", "page_id", {
        "schemaVersion": 1, "generatedAt": _T.format(4), "model": "m",
        "items": {_URL: {"titleZh": "t", "takeawayZh": "k", "whyItMattersZh": "w", "categoryZh": "c", "analyzedAt": _T.format(3), "sourcePublishedAt": _T.format(1)}}}),
    "catalog": ("part", "p_partkey", {
        "schemaVersion": 3, "scoreModelVersion": "evidence-v2", "projectIdVersion": 1, "capturedAt": _T.format(4), "sourceCount": 2, "queryFailureCount": 0, "projectCount": 1, "deepAnalysisCount": 0,
        "pendingDeepAnalysis": ["acme/tool"], "dailyTrackCounts": {"recentMomentum": 3, "longTerm": 2},
        "heatHistory": {"snapshotCount": 7, "maximumSnapshotCount": 30, "minimumPersistenceSnapshots": 7, "verifiedLongTermCount": 1}, "growthMode": "observed", "notice": "n", "projects": [_PROJECT]}),
    "codex-queue": ("customer", "c_custkey", {
        "schemaVersion": 2, "projectIdVersion": 1, "generatedAt": _T.format(4), "scope": {"projectLimit": 5, "signalLimit": 10}, "pendingCount": 2, "projectPendingCount": 1, "signalPendingCount": 1,
        "completedProjectCount": 0, "completedSignalCount": 0, "items": [_TASK, _SIGNAL_TASK]}),
    "generation-manifest": ("customer", "c_custkey", {
        "schemaVersion": 1, "generationId": "g-@n", "createdAt": _T.format(4), "baseGenerationId": None, "operation": "refresh", "state": "ready", "failureStage": None, "error": None,
        "artifacts": ["catalog/latest.json"], "hashes": {"catalog/latest.json": "0" * 64}, "audit": {"status": "healthy", "errorCount": 0, "warningCount": 0, "validatedCount": 9}}),
    "current-generation": ("orders", "o_orderkey", {"schemaVersion": 1, "generationId": "g-@n", "publishedAt": _T.format(4), "previousGenerationId": None, "manifestSha256": "a1" * 32}),
}

_P, _S = ("repositories", 1), ("signals", 0)
#: kind: fault: places and what they become
FAULTS = {
    "github-snapshot": {
        "version": {("schema_version",): 2}, "no_queries": {("queries",): []}, "twin_queries": {("queries",): ["a", "a"]}, "blank_query": {("queries", 1): ""}, "bad_time": {("captured_at",): "2024-05-04 10:00"},
        "no_such_day": {("captured_at",): "2024-02-30T10:00:00Z"}, "no_status": {("query_status",): DROP}, "no_counts": {("successful_query_count",): DROP, ("failed_query_count",): DROP},
        "healthy_error": {("query_status", 0, "error"): "late"}, "failed_silent": {("query_status", 1, "error"): None}, "state": {("query_status", 0, "state"): "slow"}, "count_text": {("count",): "2"},
        "count_half": {("count",): 2.5}, "count_null": {("count",): None}, "less_than_none": {(*_P, "forks"): -1}, "bad_repo": {(*_P, "repo"): "acme/a/b"}, "bad_scheme": {(*_P, "url"): "ftp://x.example.org"},
        "login_url": {(*_P, "url"): "https://me:pw@x.example.org"}, "long_license": {(*_P, "license"): _LONG[101]}, "license_number": {(*_P, "license"): 5}, "twin_topics": {(*_P, "topics"): ["a", "b", "a"]},
        "no_owner": {(*_P, "owner"): DROP}, "new_field": {(*_P, "mood"): "calm"}, "state_done": {(*_P, "analysis_state"): "done"}, "list_as_text": {("repositories",): "none"}, "text_row": {_P: "acme/tool"}},
    "technical-signals": {
        "long_window": {("windowHours",): 721}, "no_window": {("windowHours",): 0}, "kind": {(*_S, "kind"): "rumour"}, "score_over": {(*_S, "score"): 1.5}, "score_under": {(*_S, "score"): -0.25},
        "score_text": {(*_S, "score"): "high"}, "no_sources": {(*_S, "sources"): []}, "twin_sources": {(*_S, "sources"): ["a", "a"]}, "late": {(*_S, "publishedAt"): "yesterday"},
        "top_six": {("topSignals",): [_SIGNAL] * 6}, "growth_half": {("signals", 1, "reportedDailyGrowth"): 1.5}, "bad_latest": {("sourceStatus", 0, "latestItemAt"): "soon"},
        "two_faults": {(*_S, "title"): "", ("signalCount",): -1}, "failed_silent": {("sourceStatus", 0, "state"): "failed"}},
    "static-evidence": {
        "version": {("schemaVersion",): 3}, "old_with_id": {("schemaVersion",): 1}, "oldest": {("schemaVersion",): 0, ("projectId",): DROP, ("projectIdVersion",): DROP}, "no_id": {("projectId",): DROP},
        "bad_id": {("projectId",): "Acme--0123456789abcdef0123"}, "too_many_files": {("scanned_files",): 12001}, "half_language": {("language_files", "C/C++"): 1.5}, "no_tests": {("indicators", "tests"): DROP},
        "flag_text": {("indicators", "ci"): "yes"}, "unknown_indicator": {("indicators", "wiki"): True}, "long_hint": {("license_hint",): _LONG[501]}, "over_sure": {("confidence",): 101},
        "long_warning": {("warnings",): ["ok", _LONG[2001]]}, "local": {("repository",): "local", ("source",): "here"}, "odd_repository": {("repository",): "acme"}, "here": {("source",): "local folder"}},
    "project-enrichment": {
        "undated": {("sourcePushedAt",): DROP}, "oldest_dated": {("schemaVersion",): 0, ("projectId",): DROP, ("projectIdVersion",): DROP}, "no_skill": {("capabilities",): []}, "blank_term": {("taskTerms", 0): ""},
        "long_title": {("titleZh",): _LONG[501]}, "number_title": {("titleZh",): 7}, "bad_source": {("sourceUrl",): "https:// x"}, "id_version": {("projectIdVersion",): 2}, "no_risk": {("limitation",): DROP},
        "early": {("analyzedAt",): "2024-05-02T11:59:59+02:00"}, "version_one": {("schemaVersion",): 1, ("projectId",): DROP, ("projectIdVersion",): DROP},
        "other_id": {("projectId",): "acme-tool--0123456789abcdef0123"}, "many_skills": {("capabilities",): [f"c{k}" for k in range(65)]}},
    "signal-enrichment": {
        "model": {("model",): ""}, "bad_key": {("items", "no address~1"): {"titleZh": "t", "takeawayZh": "k", "whyItMattersZh": "w", "categoryZh": "c"}}, "half_dated": {("items", _URL, "analyzedAt"): DROP},
        "no_text": {("items", _URL, "takeawayZh"): ""}, "items_list": {("items",): []}, "extra": {("items", _URL, "mood"): 1}},
    "catalog": {
        "no_version": {("schemaVersion",): DROP}, "version": {("schemaVersion",): 4}, "version_two": {("schemaVersion",): 2}, "model": {("scoreModelVersion",): "v1"}, "mode": {("growthMode",): "guess"},
        "no_history": {("heatHistory", "maximumSnapshotCount"): 0}, "tracks": {("dailyTrackCounts", "longTerm"): DROP}, "pending_twins": {("pendingDeepAnalysis",): ["a/b", "a/b"]},
        "failure": {("analysisFailures",): [{"repository": "a/b", "error": ""}]}, "over_score": {("projects", 0, "enduranceScore"): 101}, "no_evidence": {("projects", 0, "evidence"): []},
        "bad_href": {("projects", 0, "evidence", 0, "href"): "https://"}, "explained": {("projects", 0, "scoreExplanations", "reuseFit", "score"): -1}, "twin_facts": {("projects", 0, "scoreExplanations", "attention", "facts"): ["a", "a"]},
        "other_id": {("projects", 0, "projectId"): "acme-tool--0123456789abcdef0123"}, "odd_repo": {("projects", 0, "repo"): "-acme/tool"},
        "twin_projects": {("projects",): [_PROJECT, _PROJECT | {"repo": "Acme/Tool-@n"}]}, "unexplained": {("projects", 0, "scoreExplanations", "endurance"): DROP}, "label_time": {("projects", 0, "capturedAt"): "2024-05-04T10:00Z"}, "advice": {("projects", 0, "recommendation"): "试用"},
        "state": {("projects", 0, "analysisState"): "done"}, "no_project_id": {("projects", 0, "projectId"): DROP}},
    "codex-queue": {
        "version_one": {("schemaVersion",): 1}, "no_id_version": {("projectIdVersion",): DROP}, "limit": {("scope", "projectLimit"): 31}, "priority": {("items", 0, "priority"): -101}, "kind": {("items", 1, "kind"): "song"},
        "parent_path": {("items", 0, "inputPaths"): ["data/../secret.json"]}, "no_paths": {("items", 0, "inputPaths"): []}, "other_root": {("items", 1, "outputPath"): "etc/passwd"},
        "other_id": {("items", 0, "projectId"): "acme-tool--0123456789abcdef0123"}, "other_output": {("items", 0, "outputPath"): "data/enrichment/x.json", ("items", 0, "requiredFields"): ["projectId"]},
        "two_catalogs": {("items", 0, "inputPaths"): ["data/catalog/latest.json", "data/generations/g1/catalog/latest.json"]}, "no_evidence": {("items", 0, "inputPaths"): ["data/catalog/latest.json"]},
        "unready": {("items", 0, "sourceAnalysisAt"): None}, "not_ready": {("items", 0, "sourceAnalysisAt"): None, ("items", 0, "evidenceState"): "static_analysis_required", ("items", 0, "inputPaths"): ["data/catalog/latest.json"]}, "task_id": {("items", 0, "id"): "project:x"}},
    "generation-manifest": {
        "ready_error": {("error",): "broken"}, "ready_empty": {("artifacts",): [], ("hashes",): {}}, "ready_unaudited": {("audit",): None}, "failed_silent": {("state",): "failed"}, "building_audited": {("state",): "building"},
        "errors": {("audit", "errorCount"): 1}, "climbing": {("artifacts",): ["a/../b.json"]}, "hash": {("hashes", "catalog/latest.json"): "0" * 63}, "hash_key": {("hashes", "notes.txt"): "0" * 64},
        "stage": {("state",): "failed", ("error",): "broken", ("failureStage",): "lunch"}, "id": {("generationId",): "-g"}},
    "current-generation": {
        "no_previous": {("previousGenerationId",): DROP}, "previous": {("previousGenerationId",): ""}, "hash": {("manifestSha256",): "A1" * 32}, "time": {("publishedAt",): 5}, "other": {("note",): "n"}},
}
#: Texts that are no strict JSON, of every kind.
BROKEN = {"cut": lambda text: text[:-1], "twice": lambda text: text[:-1] + ',"schemaVersion":1,"schemaVersion":1}', "not_finite": lambda text: text[:-1] + ',"note":NaN}'}


def _changed(sample: dict, changes: dict) -> dict:
    out = json.loads(json.dumps(sample))
    for place, value in changes.items():
        at = out
        for step in place[:-1]:
            at = at[step]
        if value is DROP:
            del at[place[-1]]
        else:
            at[place[-1]] = value
    return out


def _body(sample: dict) -> str:
    return json.dumps(sample, ensure_ascii=False, separators=(",", ":")).replace('"@n"', "@n")


def texts(kind: str) -> list[tuple[str, str]]:
    """Fault names and document texts of a kind; the sound one comes first."""
    sample = SAMPLES[kind][2]
    sound = _body(sample)
    return ([("sound", sound)] + [(name, _body(_changed(sample, changes))) for name, changes in FAULTS[kind].items()]
            + [(name, spoil(sound)) for name, spoil in BROKEN.items()])


def documents_of(kind: str):
    def projection(d):
        table, number, _ = SAMPLES[kind]
        found = texts(kind)
        name = f"'acme/tool-' || CAST({number} AS STRING)"
        pick = f"{number} % {len(found)}"
        names = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(found))
        bodies = " ".join(f"WHEN {k} THEN '{text}'" for k, (_, text) in enumerate(found))
        return f"""SELECT '{kind}' AS kind, CAST({number} AS STRING) AS key, CASE {pick} {names} END AS fault,
                          replace(replace(CASE {pick} {bodies} END, '@id', 'acme-tool-@n--' || substr({d.sha256(name)}, 1, 20)), '@n', CAST({number} AS STRING)) AS body FROM {d.spread(table)}"""
    return projection


LOGICAL.update({f"documents_{kind.replace('-', '_')}": documents_of(kind) for kind in SAMPLES})
