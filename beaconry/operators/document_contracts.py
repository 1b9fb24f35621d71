"""The nine document kinds as trees of rules.  Field names, values, bounds and patterns are fixed values of the formats."""

from __future__ import annotations

from beaconry.operators.documents import All, Fields, Flag, Group, Items, Keyed, Keys, Lacks, Needs, Not, Null, Number, Object, OneOf, OrNull, Rule, Text, When

TIME, COUNT, SCORE = Text(kind="time"), Number(0), Number(0, 100)
URL = Text(8, 2048, r"^https?://[^\s]+$", "web address")
REPOSITORY = Text(3, 200, r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$", "repository")
PROJECT_ID = Text(25, 86, "^[a-z0-9]+(?:-[a-z0-9]+)*--[0-9a-f]{20}$")
GENERATION_ID = Text(1, 128, r"^[A-Za-z0-9](?:[A-Za-z0-9._-]{0,126}[A-Za-z0-9])?$")
SHA256 = Text(pattern="^[a-f0-9]{64}$")


def healthy_or_failed(limit: int) -> tuple:
    """A healthy row has no error, a failed one says what went wrong."""
    return When("state", ("healthy",), Fields({"error": Null()})), When("state", ("failed",), Fields({"error": Text(1, limit)}))


SNAPSHOT = Object({
    "schema_version": OneOf((1,)), "captured_at": TIME, "queries": Items(Text(1, 1000), 1, 100, True),
    "query_status": Items(Object({"query": Text(1, 1000), "state": OneOf(("healthy", "failed")), "item_count": COUNT, "error": OrNull(Text(1, 300))}, also=healthy_or_failed(300)), 0, 100),
    "successful_query_count": COUNT, "failed_query_count": COUNT, "count": COUNT,
    "repositories": Items(Object({
        "repo": REPOSITORY, "url": URL, "description": OrNull(Text(0, 4000)), "owner": Text(1, 100), "language": OrNull(Text(1, 100)), "license": OrNull(Text(1, 100)),
        "topics": Items(Text(1, 100), 0, 100, True), "stars": COUNT, "forks": COUNT, "open_issues": COUNT, "created_at": TIME, "updated_at": TIME, "pushed_at": TIME,
        "default_branch": Text(1, 255), "captured_at": TIME, "candidate_query": Text(1, 5000), "analysis_state": OneOf(("pending",))}), 0, 5000),
}, ("query_status", "successful_query_count", "failed_query_count"), (Group(("query_status", "successful_query_count", "failed_query_count")),))

_SIGNAL = Object({
    "id": Text(1, 160), "kind": OneOf(("official", "aggregated", "ranking", "curated")), "title": Text(1, 500), "summaryZh": Text(1, 4000), "url": URL, "source": Text(1, 300),
    "sourceUrl": URL, "publishedAt": TIME, "score": Number(0, 1, False), "evidence": Items(Text(1, 200), 0, 50, True), "sources": Items(Text(1, 300), 1, 50, True),
    "repo": REPOSITORY, "reportedDailyGrowth": COUNT}, ("repo", "reportedDailyGrowth"))
SIGNALS = Object({
    "schemaVersion": OneOf((1,)), "capturedAt": TIME, "windowHours": Number(1, 720), "signalCount": COUNT, "healthySourceCount": COUNT, "failedSourceCount": COUNT,
    "sourceStatus": Items(Object({"id": Text(1, 120), "name": Text(1, 200), "url": URL, "state": OneOf(("healthy", "failed")), "itemCount": COUNT, "latestItemAt": OrNull(TIME),
                                  "error": OrNull(Text(1, 1000))}, also=healthy_or_failed(1000)), 0, 100),
    "topSignals": Items(_SIGNAL, 0, 5), "signals": Items(_SIGNAL, 0, 100)})

_IDENTITY = ("projectIdVersion", "projectId")
_INDICATORS = ("readme", "license", "tests", "ci", "docker", "dependency_lock", "package_manifest", "examples", "docs", "environment_example")
#: A repository here is the word ``local`` or, by the last rule, a repository with a web address as its source.
EVIDENCE = Object({
    "schemaVersion": OneOf((0, 1, 2)), "projectIdVersion": OneOf((1,)), "projectId": PROJECT_ID, "repository": All(()),
    "source": Text(1, 2048), "analyzed_at": TIME, "scanned_files": Number(0, 12000), "language_files": Keyed(COUNT, most=100),
    "indicators": Object({name: Flag() for name in _INDICATORS}), "counts": Object({"test_files": COUNT, "todo_markers": COUNT}),
    "license_hint": OrNull(Text(1, 500)), "confidence": SCORE, "warnings": Items(Text(1, 2000), 0, 100),
}, (*_IDENTITY, "analyzed_at"), (
    When("schemaVersion", (1, 2), Needs(("analyzed_at",))), When("schemaVersion", (2,), Needs(_IDENTITY)), When("schemaVersion", (0, 1), Lacks(_IDENTITY)),
    When("schemaVersion", (0,), Lacks(("analyzed_at",))), When("repository", ("local",), Fields({"repository": REPOSITORY, "source": URL}), no=True)))

_DATED = ("sourcePushedAt", "sourceAnalysisAt")
ENRICHMENT = Object({
    "schemaVersion": OneOf((0, 1, 2)), "projectIdVersion": OneOf((1,)), "projectId": PROJECT_ID, "repository": REPOSITORY, "sourcePushedAt": TIME, "sourceAnalysisAt": TIME,
    "analyzedAt": TIME, "model": Text(1, 200), "titleZh": Text(1, 500), "summaryZh": Text(1, 5000), "category": Text(1, 200), "capabilities": Items(Text(1, 300), 1, 64, True),
    "taskTerms": Items(Text(1, 200), 1, 128, True), "bestFor": Text(1, 5000), "reusePlan": Text(1, 8000), "limitation": Text(1, 8000), "evidenceSummary": Text(1, 10000), "sourceUrl": URL,
}, (*_IDENTITY, *_DATED, "model"), (
    When("schemaVersion", (1, 2), Needs(_DATED)), When("schemaVersion", (2,), Needs(_IDENTITY)), When("schemaVersion", (0, 1), Lacks(_IDENTITY)),
    When("schemaVersion", (0,), Lacks(_DATED))))

SIGNAL_ENRICHMENT = Object({
    "schemaVersion": OneOf((1,)), "generatedAt": TIME, "model": Text(1, 200),
    "items": Keyed(Object({"titleZh": Text(1, 500), "takeawayZh": Text(1, 5000), "whyItMattersZh": Text(1, 5000), "categoryZh": Text(1, 200), "analyzedAt": TIME, "sourcePublishedAt": TIME},
                          ("analyzedAt", "sourcePublishedAt"), (Group(("analyzedAt", "sourcePublishedAt")),)),
                   Text(0, 2048, r"^https?://[^\s]+$", "web address"), most=500)})

_STAGES = ("build", "schema_validation", "audit", "manifest", "publish")
_AUDIT = Object({"status": OneOf(("healthy", "degraded")), "errorCount": OneOf((0,)), "warningCount": COUNT, "validatedCount": Number(1)})
_ARTIFACT = Text(6, 512, r"^(?!/)(?!.*(?:^|/)\.{1,2}(?:/|$))(?!.*\\)(?!.*//)[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*\.json$")
_QUIET = {"failureStage": Null(), "error": Null()}
MANIFEST = Object({
    "schemaVersion": OneOf((1,)), "generationId": GENERATION_ID, "createdAt": TIME, "baseGenerationId": OrNull(GENERATION_ID), "operation": OneOf(("bootstrap", "refresh", "derive")),
    "state": OneOf(("building", "ready", "failed")), "failureStage": OrNull(OneOf(_STAGES)), "error": OrNull(Text(1, 2000)), "artifacts": Items(_ARTIFACT, 0, 5000, True),
    "hashes": Keyed(SHA256, _ARTIFACT, most=5000), "audit": OrNull(_AUDIT),
}, (), (
    When("state", ("ready",), Fields({**_QUIET, "audit": _AUDIT, "artifacts": Items(least=1), "hashes": Keyed(All(()), least=1)})),
    When("state", ("failed",), Fields({"failureStage": OneOf(_STAGES), "error": Text(1, 2000)})),
    When("state", ("building",), Fields({**_QUIET, "audit": Null()}))))

CURRENT = Object({"schemaVersion": OneOf((1,)), "generationId": GENERATION_ID, "publishedAt": TIME, "previousGenerationId": OrNull(GENERATION_ID), "manifestSha256": SHA256})

_PROJECT = {
    "slug": Text(1, 255), "repo": REPOSITORY, "title": Text(1, 500), "description": Text(0, 5000), "category": Text(1, 200), "language": Text(1, 100), "license": Text(1, 200), "stars": COUNT,
    "growthValue": Number(), "growthLabel": Text(1, 500), "growthKind": OneOf(("observed", "velocity_proxy")), "enduranceScore": SCORE, "heatTrack": OneOf(("recent_momentum", "long_term")),
    "heatLabel": Text(1, 500), "longTermEvidenceKind": OrNull(OneOf(("structural_proxy", "multi_snapshot"))), "heatObservationCount": COUNT, "heatObservationWindow": COUNT,
    "trend": Text(1, 500), "analysisState": OneOf(("事实初筛", "静态分析", "深度分析", "画像待复核")), "sourcePushedAt": OrNull(TIME), "analysisAnalyzedAt": OrNull(TIME),
    "enrichmentAnalyzedAt": OrNull(TIME), "whyNow": Text(1, 5000), "reusePlan": Text(1, 8000), "risk": Text(1, 10000), "capabilities": Items(Text(1, 300), 0, 64, True),
    "taskTerms": Items(Text(1, 200), 0, 128, True), "evidence": Items(Object({"label": Text(1, 300), "detail": Text(1, 5000), "href": URL}), 1, 50),
    "capturedAt": Text(pattern=r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2} [A-Z]{2,8}$")}
_STATEMENTS = Items(Text(1, 1000), 0, 32, True)
_EXPLANATION = Object({"score": OrNull(SCORE), "summary": Text(1, 2000), "facts": _STATEMENTS, "proxies": _STATEMENTS, "limitations": _STATEMENTS, "upgradeConditions": _STATEMENTS})
_SCORED = {
    "attentionScore": SCORE, "engineeringReadiness": OrNull(SCORE), "reuseFitScore": OrNull(SCORE), "evidenceCompleteness": SCORE,
    "scoreExplanations": Object({name: _EXPLANATION for name in ("attention", "endurance", "engineeringReadiness", "reuseFit", "evidenceCompleteness")}),
    "recommendation": OneOf(("了解", "收藏", "隔离试用", "观望")), "fitHypothesis": Text(1, 5000)}
_PROJECTS = {
    1: Object(_PROJECT | {"globalScore": SCORE, "reuseScore": SCORE, "momentumScore": SCORE, "recommendation": OneOf(("了解", "收藏", "试用", "复用", "观望")), "fit": Text(1, 5000)}),
    2: Object(_PROJECT | _SCORED), 3: Object(_PROJECT | {"projectIdVersion": OneOf((1,)), "projectId": PROJECT_ID} | _SCORED)}
_CATALOG = {
    "capturedAt": TIME, "sourceCount": COUNT, "queryFailureCount": COUNT, "projectCount": COUNT, "deepAnalysisCount": COUNT, "pendingDeepAnalysis": Items(REPOSITORY, 0, 100, True),
    "dailyTrackCounts": Object({"recentMomentum": COUNT, "longTerm": COUNT}),
    "heatHistory": Object({"snapshotCount": COUNT, "maximumSnapshotCount": Number(1), "minimumPersistenceSnapshots": Number(1), "verifiedLongTermCount": COUNT}),
    "growthMode": OneOf(("observed", "mixed_observation", "first_observation_proxy")), "notice": Text(1, 10000), "previousCapturedAt": OrNull(TIME),
    "analysisFailures": Items(Object({"repository": REPOSITORY, "error": Text(1, 2000)}), 0, 100), "signalCount": COUNT, "healthySignalSourceCount": COUNT, "codexPendingCount": COUNT}
_LATER = {1: {}, 2: {"scoreModelVersion": OneOf(("evidence-v2",))}, 3: {"scoreModelVersion": OneOf(("evidence-v2",)), "projectIdVersion": OneOf((1,))}}
_VERSIONS = {n: Object({"schemaVersion": OneOf((n,))} | _CATALOG | _LATER[n] | {"projects": Items(_PROJECTS[n], 0, 100)},
                       ("previousCapturedAt", "analysisFailures", "signalCount", "healthySignalSourceCount", "codexPendingCount")) for n in (1, 2, 3)}
CATALOG = All((Keys(), Needs(("schemaVersion",)), Fields({"schemaVersion": OneOf((1, 2, 3))}), *[When("schemaVersion", (n,), rule) for n, rule in _VERSIONS.items()]))

_PATH = All((Text(6, 500, r"^data/[A-Za-z0-9._/-]+$"), Not(r"(?:^|/)\.\.(?:/|$)")))
_TASK = {"priority": Number(-100, 100), "title": Text(1, 500), "reason": Text(1, 5000), "previousAnalyzedAt": OrNull(TIME), "inputPaths": Items(_PATH, 1, 20, True), "outputPath": _PATH,
         "requiredFields": Items(Text(1, 100), 1, 100, True), "safety": Text(1, 5000)}
_PROJECT_TASK = {"kind": OneOf(("project",)), "repository": REPOSITORY, "evidenceState": OneOf(("ready", "static_analysis_required")), "sourcePushedAt": TIME, "sourceAnalysisAt": OrNull(TIME)} | _TASK
_READY = (When("evidenceState", ("ready",), Fields({"sourceAnalysisAt": TIME})),)
_TASKS = {1: Object({"id": Text(0, 300, "^project:[a-z0-9-]+$")} | _PROJECT_TASK, also=_READY),
          2: Object({"id": Text(0, 100, "^project:[a-z0-9]+(?:-[a-z0-9]+)*--[0-9a-f]{20}$"), "projectIdVersion": OneOf((1,)), "projectId": PROJECT_ID} | _PROJECT_TASK, also=_READY)}
_SIGNAL_TASK = Object({"id": Text(0, 300, "^signal:[A-Za-z0-9_.:-]+$"), "kind": OneOf(("signal",)), "url": URL, "source": OrNull(Text(1, 300)), "sourcePublishedAt": OrNull(TIME)} | _TASK)


def _task(version: int) -> Rule:
    """Items say by their kind which of two shapes they have; one of neither kind breaks that alone."""
    return All((Keys(), Fields({"kind": OneOf(("project", "signal"))}), Needs(("kind",)), When("kind", ("project",), _TASKS[version]), When("kind", ("signal",), _SIGNAL_TASK)))


QUEUE = Object({
    "schemaVersion": OneOf((1, 2)), "projectIdVersion": OneOf((1,)), "generatedAt": TIME, "scope": Object({"projectLimit": Number(0, 30), "signalLimit": Number(0, 30)}),
    "pendingCount": COUNT, "projectPendingCount": COUNT, "signalPendingCount": COUNT, "completedProjectCount": COUNT, "completedSignalCount": COUNT, "items": Items(None, 0, 100),
}, ("projectIdVersion",), (
    When("schemaVersion", (1,), All((Lacks(("projectIdVersion",)), Fields({"items": Items(_task(1))})))),
    When("schemaVersion", (2,), All((Needs(("projectIdVersion",)), Fields({"items": Items(_task(2))}))))))

CONTRACTS: dict[str, Rule] = {
    "github-snapshot": SNAPSHOT, "technical-signals": SIGNALS, "static-evidence": EVIDENCE, "project-enrichment": ENRICHMENT, "signal-enrichment": SIGNAL_ENRICHMENT,
    "catalog": CATALOG, "codex-queue": QUEUE, "generation-manifest": MANIFEST, "current-generation": CURRENT}
