"""Checking SQL for recall, identity and the catalog."""

import re

from beaconry import constants as K
from beaconry.operators.recall import RULES
from beaconry.plans import texts
from oracle.core import any_of, cte, joined, list_of, query, score, us

SQL: dict[str, str] = {}

# --- recall ------------------------------------------------------------------------------
_rules = []
for name, col, back, stars, topic in RULES:
    test = (f"substr({col}, 1, 10)::DATE >= (substr(captured_at, 1, 10)::DATE - {14 if back is None else back}) "
            f"AND stars >= {stars}" + (f" AND list_contains(topics, '{topic}')" if topic else ""))
    _rules.append(f"SELECT '{name}' AS rule, * FROM repo_facts WHERE NOT archived AND NOT fork AND {test}")
SQL["recall_rules"] = query(["repo_facts"], f"""
SELECT capture_id, rule, repo, stars, item_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id, rule ORDER BY stars DESC, ord)::INT AS item_ord
  FROM ({' UNION ALL '.join(_rules)}) u) r WHERE item_ord <= 30""")

_js = lambda p: f"json_extract_string(item, '$.{p}')"
SQL["normalize_repo_items"] = query(["raw_items"], f"""
SELECT capture_id, rule, query_ord, item_ord, {_js('full_name')} AS repo, {_js('html_url')} AS url,
  {_js('description')} AS description, {_js('owner.login')} AS owner, {_js('language')} AS language,
  {_js('license.spdx_id')} AS license,
  coalesce(array_to_string(json_extract_string(item, '$.topics[*]'), '|'), '') AS topics,
  coalesce({_js('stargazers_count')}::BIGINT, 0) AS stars, coalesce({_js('forks_count')}::BIGINT, 0) AS forks,
  coalesce({_js('open_issues_count')}::BIGINT, 0) AS open_issues, {_js('created_at')} AS created_at, {_js('pushed_at')} AS pushed_at
FROM raw_items""")

cte("merged_hits", ["repo_hits"], """
SELECT capture_id, repo, url, description, stars, forks, pushed_at, query_ord AS first_query_ord, item_ord AS first_item_ord,
       rules AS candidate_query
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, repo ORDER BY query_ord, item_ord) AS rn,
             string_agg(rule, ' | ') OVER (PARTITION BY capture_id, repo ORDER BY rule ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rules
      FROM repo_hits WHERE repo IS NOT NULL) h WHERE rn = 1""")
SQL["merge_candidates"] = query(["merged_hits"], """
SELECT capture_id, repo, url, description, stars, forks, pushed_at, candidate_query, first_query_ord, first_item_ord FROM merged_hits""")
cte("query_runs", ["repo_hits", "attempts"], """
SELECT a.capture_id, a.query, CASE WHEN error IS NULL THEN 'healthy' ELSE 'failed' END AS state,
       CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS item_count, error
FROM attempts a LEFT JOIN (SELECT capture_id, rule, count(*) AS n FROM repo_hits GROUP BY ALL) h
  ON h.capture_id = a.capture_id AND h.rule = a.query""")
SQL["query_health"] = query(["query_runs"], "SELECT capture_id, query, state, item_count, error FROM query_runs")
SQL["capture_header"] = query(["query_runs"], """
SELECT capture_id, count(*) FILTER (WHERE state = 'healthy') AS successful_query_count,
  count(*) FILTER (WHERE state = 'failed') AS failed_query_count, count(*) FILTER (WHERE state = 'healthy') > 0 AS accepted
FROM query_runs GROUP BY capture_id""")
SQL["rank_snapshot"] = query(["repo_snapshot"], """
SELECT capture_id, repo, row_number() OVER (PARTITION BY capture_id ORDER BY stars DESC, coalesce(pushed_at, '') DESC, ord)::INT AS position
FROM repo_snapshot""")
SQL["append_history"] = query(["repo_snapshot"], """
SELECT captured_at, count(*) AS n_rows, sum(stars)::BIGINT AS total_stars FROM repo_snapshot GROUP BY captured_at""")

# --- identity ------------------------------------------------------------------------------
_RX_OWNER = "[A-Za-z0-9](-?[A-Za-z0-9]){0,38}"


def valid_repo(r):
    return (f"(regexp_full_match({r}, '{_RX_OWNER}/[A-Za-z0-9._-]{{1,100}}') AND length(split_part({r}, '/', 1)) <= 39 "
            f"AND split_part({r}, '/', 2) NOT IN ('.', '..'))")


def canon(r):
    return f"CASE WHEN {valid_repo(r)} THEN lower({r}) END"


def project_id(r):
    cn = canon(r)
    return (f"rtrim(substr(trim(regexp_replace({cn}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-') || '--' || "
            f"substr(sha256({cn}), 1, 20)")


def slug(r):
    return f"trim(regexp_replace(replace({canon(r)}, '/', '--'), '[^a-z0-9-]+', '-', 'g'), '-')"


def repo_error(r):
    return (f"CASE WHEN {r} IS NULL THEN 'invalid_repository_type' WHEN NOT {valid_repo(r)} THEN 'invalid_repository_format' END")


def carried_error(r, pid, ver):
    return f"""CASE WHEN {repo_error(r)} IS NOT NULL THEN {repo_error(r)}
      WHEN {ver} IS NULL OR {ver} <> 1 THEN 'unsupported_project_id_version'
      WHEN {pid} IS NULL OR length({pid}) NOT BETWEEN 25 AND 86
        OR NOT regexp_full_match({pid}, '[a-z0-9]+(-[a-z0-9]+)*--[0-9a-f]{{20}}') THEN 'invalid_project_id'
      WHEN {pid} <> {project_id(r)} THEN 'project_id_mismatch' END"""


SQL["canonical_repository"] = query(["carried_identity"], f"""
SELECT ord, repository, {canon('repository')} AS canonical, {repo_error('repository')} AS error FROM carried_identity""")
SQL["project_identity"] = query(["carried_identity"], f"""
SELECT ord, repository, {project_id('repository')} AS project_id, {slug('repository')} AS slug FROM carried_identity""")
SQL["validate_carried_identity"] = query(["carried_identity"], f"""
SELECT ord, {carried_error('repository', 'project_id', 'project_id_version')} AS error FROM carried_identity""")
cte("canon_names", ["identity_names"], f"SELECT capture_id, {canon('repository')} AS canonical FROM identity_names")
SQL["identity_uniqueness"] = query(["canon_names"], """
SELECT capture_id, 'duplicate_normalized_repository' AS code, canonical AS key, count(*) AS n
FROM canon_names WHERE canonical IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
SQL["legacy_slug_collisions"] = query(["identity_names"], f"""
SELECT capture_id, slug, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS repositories
FROM (SELECT capture_id, {canon('repository')} AS canonical, {slug('repository')} AS slug FROM identity_names) n
WHERE canonical IS NOT NULL GROUP BY capture_id, slug HAVING count(DISTINCT canonical) > 1""")

# --- growth and scores ---------------------------------------------------------------------
cte("caps", ["captures"], f"""
SELECT capture_id, {us('captured_at')} AS captured_us, dense_rank() OVER (ORDER BY captured_at)::INT AS capture_no FROM captures""")
SQL["previous_capture"] = query(["caps"], """
SELECT capture_id, capture_no, lag(capture_id) OVER (ORDER BY capture_no) AS previous_capture_id FROM caps""")
SQL["declared_previous_capture"] = query(["caps"], """
SELECT capture_id, CASE capture_no % 3 WHEN 0 THEN lag(capture_id) OVER (ORDER BY capture_no) WHEN 1 THEN NULL
  ELSE lag(capture_id) OVER (ORDER BY capture_no) END AS previous_capture_id,
  CASE WHEN capture_no % 3 = 1 THEN 'missing_previous_snapshot' END AS error FROM caps""")
cte("grow0", ["repo_snapshot", "caps"], f"""
SELECT s.* EXCLUDE (captured_us), c.captured_us, c.capture_no, {canon('s.repo')} AS canonical,
  lag(capture_no) OVER h AS pno, lag(stars) OVER h AS pstars, lag(c.captured_us) OVER h AS pus,
  (count(*) OVER (PARTITION BY lower(s.repo) ORDER BY capture_no RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))::INT AS obs_count,
  {us('created_at')} AS created_us0, {us('pushed_at')} AS pushed_us
FROM repo_snapshot s JOIN caps c ON c.capture_id = s.capture_id
WINDOW h AS (PARTITION BY lower(s.repo) ORDER BY capture_no)""")
cte("grow1", ["grow0"], """
SELECT *, coalesce(pno = capture_no - 1, false) AS observed, coalesce(created_us0, captured_us) AS created_us,
  least(capture_no, 30)::INT AS obs_window,
  greatest((captured_us - coalesce(created_us0, captured_us)) / 86400000000.0::DOUBLE, 1.0::DOUBLE) AS age_days FROM grow0""")
cte("grow", ["grow1"], """
SELECT *, CASE WHEN observed THEN 'observed' ELSE 'velocity_proxy' END AS growth_kind,
  CASE WHEN observed THEN (captured_us - pus) / 3600000000.0::DOUBLE END AS window_hours,
  CASE WHEN observed THEN stars - pstars ELSE round_even(stars / age_days, 0)::BIGINT END AS growth_value,
  CASE WHEN observed THEN greatest(stars - pstars, 0) * 24.0::DOUBLE / greatest((captured_us - pus) / 3600000000.0::DOUBLE, 1.0::DOUBLE)
       ELSE stars / age_days END AS ranking_value,
  CASE WHEN observed THEN printf('%+d in %.1f hours', stars - pstars, (captured_us - pus) / 3600000000.0::DOUBLE)
       ELSE 'about ' || round_even(stars / age_days, 0)::BIGINT || ' stars a day since creation' END AS growth_label,
  CASE WHEN observed THEN printf('%+d / %.1fh', stars - pstars, (captured_us - pus) / 3600000000.0::DOUBLE)
       ELSE '~' || round_even(stars / age_days, 0)::BIGINT || '/day' END AS trend FROM grow1""")
SQL["star_growth"] = query(["grow"], """
SELECT capture_id, repo, growth_kind, growth_value, growth_label, trend, round(ranking_value, 6) AS ranking_value FROM grow""")
SQL["heat_observations"] = query(["grow"], "SELECT capture_id, repo, obs_count, obs_window FROM grow")
_VERIFIED = "(obs_window >= 7 AND obs_count >= 5 AND obs_count / greatest(obs_window, 1)::DOUBLE >= 0.7)"
SQL["persistence"] = query(["grow"], f"SELECT capture_id, repo, {_VERIFIED} AS persistent FROM grow")

# artifacts: none, or the bound evidence and profiles
_inds = [f"ind_{i}" for i in K.INDICATORS]
cte("evidence_one", ["static_evidence"], f"SELECT *, {canon('repository')} AS ecanon FROM static_evidence")
cte("profile_one", ["project_enrichment"], f"SELECT *, {canon('repository')} AS ncanon FROM project_enrichment")
cte("art0", ["grow", "evidence_one"], f"""
SELECT g.*, e.schema_version IS NOT NULL AS has_payload, e.analyzed_at AS analysis_at, e.scanned_files, e.test_files, e.license_hint,
  e.confidence, {', '.join('e.' + i for i in _inds)},
  coalesce(e.schema_version = 2 AND {us('e.analyzed_at')} IS NOT NULL AND (g.pushed_us IS NULL OR {us('e.analyzed_at')} >= g.pushed_us), false) AS has_analysis
FROM grow g LEFT JOIN evidence_one e ON e.ecanon = g.canonical""")
_enr = ["title", "summary", "category", "best_for", "reuse_plan", "limitation", "evidence_summary", "source_url", "analyzed_at",
        "capabilities", "task_terms"]
cte("art", ["art0", "profile_one"], f"""
SELECT g.*, n.schema_version IS NOT NULL AS has_profile, {', '.join(f'n.{f} AS enr_{f}' for f in _enr)},
  coalesce(has_analysis AND n.schema_version = 2 AND n.source_pushed_at = g.pushed_at AND n.source_analysis_at = g.analysis_at
    AND {us('n.source_pushed_at')} IS NOT NULL AND {us('n.analyzed_at')} >= {us('n.source_analysis_at')}, false) AS has_enrichment
FROM art0 g LEFT JOIN profile_one n ON n.ncanon = g.canonical""")
cte("art_none", ["grow"], f"""
SELECT *, false AS has_payload, false AS has_analysis, false AS has_profile, false AS has_enrichment, 0 AS test_files,
  {', '.join(f'false AS {i}' for i in _inds)} FROM grow""")


def _scored(name, source):
    text = "lower(repo || ' ' || coalesce(description, '') || ' ' || coalesce(array_to_string(topics, ' '), ''))"
    cat = " ".join(f"WHEN {any_of('txt', t)} THEN '{n}'" for n, t in K.CATEGORY_TERMS)
    cte(name + "0", [source], f"""
    SELECT *, len(terms)::INT AS term_count, CASE WHEN pushed_us IS NULL THEN 30.0::DOUBLE
        ELSE greatest((captured_us - pushed_us) / 86400000000.0::DOUBLE, 0.0::DOUBLE) END AS push_age,
      (CASE WHEN low_actionability THEN 12.0 ELSE 0.0 END + CASE WHEN risk THEN 26.0 ELSE 0.0 END)::DOUBLE AS penalty,
      age_days >= 180 AND stars >= 5000 AND (CASE WHEN pushed_us IS NULL THEN 30.0 ELSE greatest((captured_us - pushed_us) / 86400000000.0::DOUBLE, 0.0) END) <= 120 AS long_term
    FROM (SELECT *, {list_of('txt', K.PRODUCTIVITY_TERMS)} AS terms, {any_of('txt', K.LOW_ACTIONABILITY_TERMS)} AS low_actionability,
            {any_of('txt', K.RISK_TERMS)} AS risk, CASE {cat} ELSE '{K.DEFAULT_CATEGORY}' END AS base_category,
            len(string_split(coalesce(candidate_query, ''), ' | '))::INT AS query_count
          FROM (SELECT *, {text} AS txt FROM {source}) a) b""")
    momentum = score("""16.0::DOUBLE + least(44.0::DOUBLE, log2(ranking_value + 1.0::DOUBLE) * CASE WHEN observed THEN 7.0::DOUBLE ELSE 4.5::DOUBLE END)
      + greatest(0.0::DOUBLE, 22.0::DOUBLE * (1.0::DOUBLE - age_days / 45.0::DOUBLE)) + greatest(0.0::DOUBLE, 12.0::DOUBLE * (1.0::DOUBLE - push_age / 14.0::DOUBLE))
      + least(18.0::DOUBLE, term_count * 3.0::DOUBLE) + least(6.0::DOUBLE, query_count * 1.5::DOUBLE) - penalty""")
    endurance = score(f"""least(45.0::DOUBLE, greatest(0.0::DOUBLE, (log10(greatest(stars, 1)::DOUBLE) - 3.0::DOUBLE) * 22.5::DOUBLE))
      + least(20.0::DOUBLE, greatest(0.0::DOUBLE, log2(greatest(age_days / 30.0::DOUBLE, 1.0::DOUBLE)) * 5.2::DOUBLE))
      + greatest(0.0::DOUBLE, 15.0::DOUBLE * (1.0::DOUBLE - push_age / 120.0::DOUBLE))
      + least(10.0::DOUBLE, log10(greatest(forks, 1)::DOUBLE) * 2.5::DOUBLE) + least(10.0::DOUBLE, term_count * 2.0::DOUBLE)
      + CASE WHEN verified THEN least(10.0::DOUBLE, 5.0::DOUBLE + obs_count / obs_window::DOUBLE * 5.0::DOUBLE) ELSE 0.0::DOUBLE END - penalty""")
    material = " + ".join(f"CASE WHEN ind_{n} THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END" for n, w in K.READINESS_WEIGHTS)
    ready = score(f"{material} + least(5.0::DOUBLE, log10(greatest(coalesce(test_files, 0), 1)::DOUBLE) * 2.5::DOUBLE) - CASE WHEN risk THEN 26.0::DOUBLE ELSE 0.0::DOUBLE END")
    cte(name + "1", [name + "0"], f"""
    SELECT *, {momentum} AS m, {endurance} AS e, {ready} AS r FROM (SELECT *, long_term AND {_VERIFIED} AS verified FROM {name}0) v""")
    cte(name + "2", [name + "1"], """
    SELECT *, CASE WHEN risk THEN least(greatest(m, round_even(e * 0.92::DOUBLE, 0)::INT), 49) ELSE greatest(m, round_even(e * 0.92::DOUBLE, 0)::INT) END AS attention,
      CASE WHEN risk THEN least(m, 49) ELSE m END AS momentum, CASE WHEN risk THEN least(e, 35) ELSE e END AS endurance,
      CASE WHEN has_analysis THEN CASE WHEN risk THEN least(r, 35) ELSE r END END AS readiness,
      (25 + CASE WHEN observed THEN 15 ELSE 5 END + CASE WHEN has_analysis THEN 30 ELSE 0 END + CASE WHEN has_enrichment THEN 20 ELSE 0 END
        + CASE WHEN verified THEN 10 ELSE 0 END)::INT AS completeness FROM """ + name + "1")
    cte(name, [name + "2"], """
    SELECT *, CASE WHEN risk THEN 'watch'
        WHEN readiness >= 75 AND attention >= 55 AND coalesce(license NOT IN ('NOASSERTION', ''), false) THEN 'sandbox_trial'
        WHEN readiness >= 60 THEN 'save' WHEN attention >= 60 OR readiness IS NOT NULL THEN 'learn' ELSE 'watch' END AS recommendation,
      CASE WHEN long_term THEN 'long_term' ELSE 'recent_momentum' END AS heat_track,
      CASE WHEN verified THEN 'long_term_verified' WHEN long_term THEN 'long_term_proxy' WHEN NOT observed THEN 'first_proxy'
        WHEN growth_value > 0 THEN 'rising' WHEN growth_value = 0 THEN 'flat' ELSE 'falling' END AS heat_label,
      CASE WHEN verified THEN 'multi_snapshot' WHEN long_term THEN 'structural_proxy' END AS long_term_evidence,
      CASE WHEN has_enrichment THEN 'deep' WHEN has_profile THEN 'enrichment_stale' WHEN has_analysis THEN 'static' ELSE 'facts_only' END AS analysis_state
    FROM """ + name + "2")


_scored("scored", "art")
_scored("scored_none", "art_none")

_pick = lambda cols: query(["scored"], f"SELECT capture_id, repo, {cols} FROM scored")
SQL["term_hits"] = _pick(f"{joined('terms')} AS terms, low_actionability, risk")
SQL["category"] = _pick("base_category AS category")
SQL["momentum_score"] = _pick("momentum, query_count")
SQL["endurance_score"] = _pick("endurance, long_term, verified")
SQL["attention_score"] = _pick("attention")
SQL["engineering_readiness"] = _pick("readiness")
SQL["recommendation"] = _pick("recommendation")
SQL["evidence_completeness"] = _pick("completeness")
SQL["analysis_current"] = _pick("has_payload, has_analysis")
SQL["enrichment_current"] = _pick("has_profile, has_enrichment")
SQL["heat_track"] = _pick("heat_track, heat_label, long_term_evidence")
SQL["analysis_state"] = _pick("analysis_state")
SQL["evidence_base_score"] = _pick("round(CASE WHEN readiness IS NULL THEN attention::DOUBLE ELSE attention * 0.58::DOUBLE + readiness * 0.42::DOUBLE END, 6) AS base_score")

# --- order ---------------------------------------------------------------------------------
_BASE = "attention DESC, coalesce(readiness, -1) DESC, stars DESC, ord"


def _ordered(name, source, limit=30):
    cte(name + "0", [source], f"""
    SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {_BASE}) AS base,
      heat_track = 'long_term' AND attention >= 60 AND recommendation <> 'watch' AS fit FROM {source}""")
    cte(name + "1", [name + "0"], f"""
    SELECT *, (fit AND row_number() OVER (PARTITION BY capture_id, fit ORDER BY endurance DESC, {_BASE}) <= 2)
      OR (heat_track = 'recent_momentum' AND row_number() OVER (PARTITION BY capture_id, heat_track ORDER BY base) <= 3) AS picked FROM {name}0""")
    cte(name + "2", [name + "1"], f"""
    SELECT *, picked OR (sum((NOT picked)::INT) OVER (PARTITION BY capture_id ORDER BY base)
      <= 5 - sum(picked::INT) OVER (PARTITION BY capture_id)) AS daily FROM {name}1""")
    cte(name, [name + "2"], f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY daily DESC, base)::INT AS position FROM {name}2) o
    WHERE position <= {limit}""")


_ordered("ordered", "scored")
_ordered("ordered100", "scored", 100)
_ordered("targets", "scored_none", 5)
SQL["balanced_order"] = query(["ordered100"], "SELECT capture_id, position, repo, daily, attention, readiness FROM ordered100")
SQL["catalog_limit"] = query(["ordered100"], "SELECT capture_id, position, repo FROM ordered100 WHERE position <= 1")
SQL["analysis_targets"] = query(["targets"], "SELECT capture_id, position, repo FROM targets")
SQL["analysis_failures"] = query(["targets", "evidence_one"], """
SELECT capture_id, position, repo, 'static inspection returned no evidence' AS error FROM targets
WHERE lower(repo) NOT IN (SELECT ecanon FROM evidence_one WHERE ecanon IS NOT NULL)""")
SQL["catalog"] = query(["ordered"], """
SELECT capture_id, position, repo, attention, momentum, endurance, readiness, completeness, heat_track, heat_label, recommendation,
  analysis_state, growth_kind, growth_value FROM ordered""")

# --- text fields -----------------------------------------------------------------------------
_SAFE = """CASE WHEN length(url) <= 2048 AND NOT contains(url, ' ') AND regexp_matches(url, '^https?://[^/?#@]+(/|$)') THEN url
  ELSE 'https://github.com/' || repo END"""
_T = {
    "stars": "format('{:,}', stars)", "forks": "format('{:,}', forks)",
    "pushed_day": "strftime(make_timestamp(coalesce(pushed_us, captured_us)), '%Y-%m-%d')",
    "created_day": "strftime(make_timestamp(created_us), '%Y-%m-%d')",
    "growth_label": "growth_label", "growth_kind": "growth_kind", "attention": "attention::VARCHAR", "momentum": "momentum::VARCHAR",
    "endurance": "endurance::VARCHAR", "readiness": "readiness::VARCHAR", "completeness": "completeness::VARCHAR",
    "term_count": "term_count::VARCHAR", "query_count": "query_count::VARCHAR", "obs_count": "obs_count::VARCHAR",
    "obs_window": "obs_window::VARCHAR", "coverage_pct": "round_even(obs_count * 100.0::DOUBLE / obs_window, 0)::INT || '%'",
    "scanned_files": "format('{:,}', coalesce(scanned_files, 0))", "test_files": "coalesce(test_files, 0)::VARCHAR",
    "confidence": "coalesce(confidence, 0)::VARCHAR",
    "present": "coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN ind_{n} THEN '{n}' END" for n, _ in K.READINESS_WEIGHTS) + "), ''), 'no main material')",
    "missing_text": "CASE WHEN ind_license AND ind_tests AND ind_ci AND ind_docs THEN 'Main material is complete.' ELSE 'Not found: ' || concat_ws(', ', "
                    + ", ".join(f"CASE WHEN NOT coalesce(ind_{n}, false) THEN '{n}' END" for n in ("license", "tests", "ci", "docs")) + ") || '.' END",
    "coverage": "concat_ws(', ', 'repository facts', CASE WHEN observed THEN 'exact growth' END, CASE WHEN has_analysis THEN 'current inspection' END, "
                "CASE WHEN has_enrichment THEN 'bound profile' END, CASE WHEN verified THEN 'persistence' END)",
    "hint": "CASE WHEN has_analysis THEN trim(coalesce(license_hint, '')) ELSE '' END",
    "enr_summary": "coalesce(enr_evidence_summary, 'Profile from the readme and inspection.')",
}
cte("told", ["ordered"], "SELECT *, " + ", ".join(f"{v} AS t_{k}" for k, v in _T.items()) + f", {_SAFE} AS safe_link FROM ordered")
_COND = {
    "observed": "observed", "not_observed": "NOT observed", "risk": "risk", "verified": "verified", "not_verified": "NOT verified",
    "has_analysis": "has_analysis", "no_analysis": "NOT has_analysis", "has_enrichment": "has_enrichment",
    "no_enrichment": "NOT has_enrichment", "analysis_and_risk": "has_analysis AND risk", "long_term_unverified": "long_term AND NOT verified",
}


def fill(template):
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return " || ".join(f"coalesce(t_{p[1:-1]}, '')" if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in parts)


def when(cond, value):
    return value if cond is None else f"CASE WHEN {_COND[cond]} THEN {value} END"


_R = {k: fill(v) for k, v in texts.RISK_TEXTS.items()}
_MISS = "(license IS NULL OR license = 'NOASSERTION')"
_RISK = f"""CASE WHEN risk THEN {_R['risk']} WHEN {_MISS} AND has_payload AND NOT has_analysis THEN {_R['stale_license']}
  WHEN {_MISS} AND t_hint <> '' THEN {_R['hint_license']} WHEN {_MISS} AND has_analysis THEN {_R['none_license']}
  WHEN {_MISS} THEN {_R['unknown_license']} WHEN has_analysis THEN {_R['inspected']}
  WHEN has_payload THEN {_R['stale']} ELSE {_R['facts_only']} END"""
_RISK_FULL = f"""CASE WHEN has_enrichment AND trim(coalesce(enr_limitation, '')) <> '' THEN trim(enr_limitation) || ' ' || ({_RISK})
  WHEN has_profile AND NOT has_enrichment THEN CASE WHEN NOT has_analysis THEN {_R['profile_without_inspection']} ELSE {_R['profile_outdated']} END || ({_RISK})
  ELSE {_RISK} END"""
_WHY = " || ".join(f"coalesce({when(c, fill(t))}, '')" for c, t in texts.WHY_NOW)
SQL["narrative_fields"] = query(["told"], f"""
SELECT capture_id, repo, {_WHY} AS why_now, {_RISK_FULL} AS risk_text,
  strftime(make_timestamp(captured_us + 8 * 3600000000), '%Y-%m-%d %H:%M') || ' CST' AS captured_label FROM told""")
_TOP = "list_transform(coalesce(topics, []), lambda t: replace(t, '-', ' '))"


def dedup(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


cte("terms0", ["told"], f"""
SELECT *, list_concat([base_category], {_TOP}, CASE WHEN coalesce(language, '') <> '' THEN [language || ' project'] ELSE [] END) AS caps0,
  list_concat([base_category], terms, {_TOP}) AS tt0 FROM told""")
cte("terms1", ["terms0"], f"SELECT *, {dedup('caps0')} AS own_caps, {dedup('tt0')} AS own_terms FROM terms0")
cte("terms2", ["terms1"], "SELECT *, list_concat(own_terms, coalesce(enr_task_terms, [])) AS tt1 FROM terms1")
cte("catalog_rows", ["terms2"], f"""
SELECT *, CASE WHEN has_enrichment THEN coalesce(nullif(enr_title, ''), split_part(repo, '/', 2)) ELSE split_part(repo, '/', 2) END AS title,
  CASE WHEN has_enrichment THEN CASE WHEN len(enr_capabilities) > 0 THEN enr_capabilities ELSE own_caps END ELSE own_caps END AS capabilities,
  CASE WHEN has_enrichment THEN {dedup('tt1')} ELSE own_terms END AS task_terms,
  CASE WHEN has_enrichment THEN coalesce(nullif(enr_category, ''), base_category) ELSE base_category END AS category,
  CASE WHEN has_enrichment AND coalesce(enr_summary, '') <> '' THEN enr_summary
    ELSE coalesce(nullif(description, ''), 'No public description yet; inspect before judging what it does.') END AS project_description,
  CASE WHEN has_enrichment AND coalesce(enr_best_for, '') <> '' THEN enr_best_for
    ELSE 'Placed in ' || base_category || ' with ' || term_count || ' productivity terms; match it against a concrete task next.' END AS fit_hypothesis,
  CASE WHEN has_enrichment AND coalesce(enr_reuse_plan, '') <> '' THEN enr_reuse_plan
    ELSE 'Read the readme and the inspection first, then decide on an isolated trial.' END AS reuse_plan
FROM terms2""")
SQL["capability_terms"] = query(["catalog_rows"], f"SELECT capture_id, repo, {joined('own_caps')} AS capabilities, {joined('own_terms')} AS task_terms FROM catalog_rows")
SQL["apply_enrichment"] = query(["catalog_rows"], f"""
SELECT capture_id, repo, title, category, project_description, fit_hypothesis, reuse_plan, {joined('capabilities')} AS capabilities,
  {joined('task_terms')} AS task_terms FROM catalog_rows""")
SQL["license_and_url"] = query(["told"], f"""
SELECT capture_id, repo, safe_link, CASE WHEN NOT {_MISS} THEN license WHEN t_hint <> '' THEN t_hint || ' (static hint)' ELSE 'to verify' END AS license_display,
  coalesce(nullif(language, ''), 'unspecified') AS language_display FROM told""")

# long form of the explanations
_lines = []
for dim in texts.DIMENSIONS:
    for kind in texts.KINDS:
        found = [when(cond, fill(t)) for d, k, cond, t in texts.EXPLANATION_LINES if (d, k) == (dim, kind)]
        if found:
            _lines.append(f"SELECT capture_id, position, repo, '{dim}' AS dimension, '{kind}' AS kind, "
                          f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS ls FROM told")
SQL["explanation_rows"] = query(["told"], f"""
SELECT capture_id, position, repo, dimension, kind, (line - 1)::INT AS line_no, ls[line] AS text
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS line FROM ({' UNION ALL '.join(_lines)}) u) x""")
_ev = [f"SELECT capture_id, repo, {i} AS k, '{label}' AS label, {when(cond, fill(detail))} AS detail, "
       + {"api_url": "'https://api.github.com/repos/' || repo", "safe_link": "safe_link", "enr_link": "coalesce(enr_source_url, safe_link)"}[link]
       + " AS href FROM told" for i, (label, cond, detail, link) in enumerate(texts.EVIDENCE_LINES)]
SQL["evidence_list"] = query(["told"], f"""
SELECT capture_id, repo, label, detail, href FROM ({' UNION ALL '.join(_ev)}) e WHERE detail IS NOT NULL""")
_sums = []
for dim in texts.DIMENSIONS:
    parts = ", ".join(when(cond, fill(t)) for d, cond, t in texts.SUMMARIES if d == dim)
    val = {"attention": "attention", "endurance": "endurance", "engineering_readiness": "readiness", "reuse_fit": "NULL::INT", "evidence_completeness": "completeness"}[dim]
    lists = []
    for kind, field in (("fact", "facts"), ("proxy", "proxies"), ("limitation", "limitations"), ("condition", "upgrade_conditions")):
        found = [when(cond, fill(t)) for d, k, cond, t in texts.EXPLANATION_LINES if (d, k) == (dim, kind)]
        ls = f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"
        lists.append(f"{joined(dedup(ls)) if found else chr(39) * 2} AS {field}")
    _sums.append(f"SELECT capture_id, repo, '{dim}' AS dimension, {val} AS score, coalesce({parts}) AS summary, {', '.join(lists)} FROM told")
SQL["score_explanations"] = query(["told"], " UNION ALL ".join(_sums))

# --- summary and views -------------------------------------------------------------------------
cte("source_counts", ["repo_snapshot", "query_runs"], """
SELECT s.capture_id, s.n AS source_count, coalesce(q.f, 0) AS query_failure_count
FROM (SELECT capture_id, count(*) AS n FROM repo_snapshot GROUP BY ALL) s
LEFT JOIN (SELECT capture_id, count(*) FILTER (WHERE state = 'failed') AS f FROM query_runs GROUP BY ALL) q ON q.capture_id = s.capture_id""")
cte("summary0", ["catalog_rows"], """
SELECT capture_id, count(*) AS project_count, count(*) FILTER (WHERE analysis_state = 'deep') AS deep_count,
  coalesce(string_agg(repo, '|' ORDER BY position) FILTER (WHERE position <= 5 AND analysis_state <> 'deep'), '') AS pending_deep,
  count(*) FILTER (WHERE position <= 5 AND long_term) AS daily_long_term, count(*) FILTER (WHERE position <= 5 AND NOT long_term) AS daily_recent,
  count(*) FILTER (WHERE verified) AS verified_long_term, count(*) FILTER (WHERE observed) AS observed_count, max(obs_window)::INT AS snapshot_count,
  strftime(make_timestamp(max(captured_us) + 8 * 3600000000), '%Y-%m-%d %H:%M') || ' CST' AS captured_label FROM catalog_rows GROUP BY capture_id""")
cte("summary", ["summary0", "source_counts"], """
SELECT s.*, c.source_count, c.query_failure_count, CASE WHEN observed_count = project_count THEN 'observed' WHEN observed_count > 0 THEN 'mixed_observation'
  ELSE 'first_observation_proxy' END AS growth_mode FROM summary0 s LEFT JOIN source_counts c ON c.capture_id = s.capture_id""")
SQL["catalog_summary"] = query(["summary"], """
SELECT capture_id, project_count, deep_count, pending_deep, daily_long_term, daily_recent, verified_long_term, observed_count, snapshot_count,
  source_count, query_failure_count, growth_mode,
  'Capture of ' || captured_label || ': ' || project_count || ' of ' || source_count || ' candidates. ' || CASE growth_mode WHEN 'observed' THEN 'Growth is observed.'
    WHEN 'mixed_observation' THEN observed_count || ' projects have observed growth.' ELSE 'Growth is a lifetime rate.' END
    || CASE WHEN query_failure_count > 0 THEN ' ' || query_failure_count || ' recall rules failed.' ELSE '' END
    || ' Daily five: ' || daily_long_term || ' long-term. ' || CASE WHEN verified_long_term > 0 THEN verified_long_term || ' verified over captures.'
       ELSE 'Structural proxies after ' || snapshot_count || ' captures.' END AS notice FROM summary""")
cte("facets", ["catalog_rows"], """
SELECT capture_id, category, min(position) AS first_position, count(*) AS n FROM catalog_rows GROUP BY ALL""")
SQL["catalog_facets"] = query(["facets"], """
SELECT capture_id, category, first_position, n, row_number() OVER (PARTITION BY capture_id ORDER BY first_position)::INT AS facet_no FROM facets""")
SQL["catalog_views"] = query(["catalog_rows", "facets"], """
SELECT c.capture_id, daily_count, candidate_count, observed_count, deep_count, average_readiness, facets FROM (
  SELECT capture_id, count(*) FILTER (WHERE position <= 5) AS daily_count, count(*) FILTER (WHERE position > 5) AS candidate_count,
    count(*) FILTER (WHERE observed) AS observed_count, count(*) FILTER (WHERE analysis_state = 'deep') AS deep_count,
    floor(avg(readiness) + 0.5)::INT AS average_readiness FROM catalog_rows GROUP BY capture_id) c
JOIN (SELECT capture_id, string_agg(category, '|' ORDER BY first_position) AS facets FROM facets GROUP BY capture_id) f ON f.capture_id = c.capture_id""")
_OKV = """coalesce(schema_version IN (1, 2, 3) AND (schema_version <> 3 OR (project_id_version = 1 AND project_id <> '')), false)
  AND coalesce(CASE WHEN schema_version = 1 THEN global_score ELSE attention_score END BETWEEN 0 AND 100, false)"""
SQL["normalize_legacy_catalog"] = query(["legacy_catalog"], f"""
SELECT capture_id, repo, schema_version, CASE WHEN schema_version = 1 THEN 'legacy-v1' ELSE 'evidence-v2' END AS score_model,
  CASE WHEN schema_version = 1 THEN global_score ELSE attention_score END AS attention, endurance_score AS endurance,
  CASE WHEN schema_version <> 1 THEN readiness_score END AS readiness, CASE WHEN schema_version <> 1 THEN completeness_score END AS completeness,
  CASE WHEN schema_version = 1 AND recommendation IN ('trial', 'reuse') THEN 'sandbox_trial' ELSE recommendation END AS recommendation
FROM legacy_catalog WHERE {_OKV}""")
SQL["normalize_legacy_catalog_errors"] = query(["legacy_catalog"], f"""
SELECT capture_id, repo, schema_version, 'unsupported_catalog_row' AS error FROM legacy_catalog WHERE NOT ({_OKV})""")
