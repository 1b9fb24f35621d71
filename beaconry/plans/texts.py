"""Explanation and narrative templates.

Each line names the condition column it needs (None = always).  Placeholders are text columns prepared
by the catalog job.
"""

# dimension -> summary lines (first whose condition holds)
SUMMARIES = [
    ("attention", None, "{attention}/100: recent momentum and lasting interest decide whether to look first."),
    ("endurance", None, "{endurance}/100: signs of lasting interest and steady maintenance."),
    ("engineering_readiness", "has_analysis", "{readiness}/100: engineering material found by the current read-only inspection."),
    ("engineering_readiness", None, "Not scored: no read-only inspection matches the latest push."),
    ("reuse_fit", None, "Not scored: a general catalog knows no task, limits or acceptance tests."),
    ("evidence_completeness", None, "{completeness}/100: how much evidence is covered, not how good the project is."),
]

# dimension, kind, condition, text; order is the order shown
EXPLANATION_LINES = [
    ("attention", "fact", None, "The capture records {stars} stars and {forks} forks."),
    ("attention", "fact", None, "Last push on {pushed_day}."),
    ("attention", "fact", "observed", "Two captures show {growth_label}."),
    ("attention", "proxy", None, "Momentum is {momentum}/100; endurance counts at 92 percent and the larger one wins."),
    ("attention", "proxy", None, "{term_count} productivity terms and {query_count} recall rules matched."),
    ("attention", "proxy", "not_observed", "{growth_label}"),
    ("attention", "limitation", None, "Attention only says what to read first, not quality or fit."),
    ("attention", "limitation", "not_observed", "Without a second capture growth is a lifetime rate."),
    ("attention", "limitation", "risk", "Risk terms cap attention at 49."),
    ("attention", "condition", "not_observed", "The next capture gives the exact star change."),
    ("attention", "condition", "risk", "A person reviews the safety questions first."),
    ("endurance", "fact", None, "The capture records {stars} stars and {forks} forks."),
    ("endurance", "fact", None, "Last push on {pushed_day}."),
    ("endurance", "fact", None, "Created on {created_day}."),
    ("endurance", "fact", "verified", "Seen in {obs_count} of the last {obs_window} captures."),
    ("endurance", "proxy", None, "Stars, age, maintenance and forks estimate lasting interest."),
    ("endurance", "limitation", None, "Lasting interest is not code quality or fit."),
    ("endurance", "limitation", "not_verified", "Persistence over captures is not yet verified."),
    ("endurance", "limitation", "risk", "Risk terms cap endurance at 35."),
    ("endurance", "condition", "not_verified", "At least 7 captures with steady presence."),
    ("engineering_readiness", "fact", "has_analysis", "{scanned_files} files inspected, {test_files} of them tests."),
    ("engineering_readiness", "fact", "has_analysis", "Found: {present}."),
    ("engineering_readiness", "proxy", "has_analysis", "Files and folders stand in for engineering readiness."),
    ("engineering_readiness", "limitation", "has_analysis", "Nothing was installed or run; this is not reliability."),
    ("engineering_readiness", "limitation", "analysis_and_risk", "Risk terms cap readiness at 35."),
    ("engineering_readiness", "limitation", "no_analysis", "Metadata cannot show whether code, tests or docs are complete."),
    ("engineering_readiness", "condition", "has_analysis", "Install, test and accept it in isolation and record the result."),
    ("engineering_readiness", "condition", "no_analysis", "Inspect the current push read-only."),
    ("reuse_fit", "fact", "has_enrichment", "The capability profile is bound to the latest push and inspection."),
    ("reuse_fit", "proxy", None, "Listed uses are search hints, not a fit score."),
    ("reuse_fit", "limitation", None, "Without a task no reuse verdict follows."),
    ("reuse_fit", "condition", None, "State the task, needs and limits, then verify in isolation."),
    ("evidence_completeness", "fact", None, "Covered: {coverage}."),
    ("evidence_completeness", "limitation", "not_observed", "No second capture; growth is a rate."),
    ("evidence_completeness", "limitation", "no_analysis", "No current read-only inspection."),
    ("evidence_completeness", "limitation", "no_enrichment", "No profile bound to current evidence."),
    ("evidence_completeness", "limitation", "not_verified", "No verified persistence."),
    ("evidence_completeness", "condition", "not_observed", "Take the next capture."),
    ("evidence_completeness", "condition", "no_analysis", "Finish a read-only inspection."),
    ("evidence_completeness", "condition", "no_enrichment", "Publish a profile from current evidence."),
    ("evidence_completeness", "condition", "not_verified", "Collect captures that reach the persistence threshold."),
]
DIMENSIONS = ["attention", "endurance", "engineering_readiness", "reuse_fit", "evidence_completeness"]
KINDS = ["fact", "proxy", "limitation", "condition"]

# label, condition, detail, link column
EVIDENCE_LINES = [
    ("repository facts", None, "{stars} stars, {forks} forks, last push {pushed_day}.", "api_url"),
    ("recall basis", None, "Recalled by {query_count} search rules; growth kind {growth_kind}.", "safe_link"),
    ("persistence over captures", "verified", "Seen in {obs_count} of the last {obs_window} captures; coverage {coverage_pct}.", "safe_link"),
    ("read-only inspection", "has_analysis", "{scanned_files} files, {test_files} test files, confidence {confidence}%. Nothing was run.", "safe_link"),
    ("capability profile", "has_enrichment", "{enr_summary}", "enr_link"),
]

WHY_NOW = [
    ("observed", "Between two captures the stars moved {growth_label}; last push on {pushed_day}."),
    ("not_observed", "Created on {created_day}, now {stars} stars; with one capture only {growth_label} is known."),
    ("verified", " Endurance {endurance}/100: present in {obs_count} of the last {obs_window} captures."),
    ("long_term_unverified", " Endurance {endurance}/100 from stars, age, maintenance and forks; {obs_window} captures so far, 7 needed."),
]

RISK_TEXTS = {
    "risk": "Risk terms found: review by a person first; do not download, run or reuse.",
    "stale_license": "No standard licence from the API and the inspection is out of date; check the terms again.",
    "hint_license": "No standard licence from the API; the inspection hints at {hint}, which needs checking.",
    "none_license": "Neither API nor inspection confirms a licence; verify before reuse.",
    "unknown_license": "No clear licence from the API and no inspection yet; verify licence and content.",
    "inspected": "{scanned_files} files inspected, {test_files} test files. {missing_text} Inspection does not replace a run.",
    "stale": "The inspection has no usable time or predates the last push; readiness stays unknown.",
    "facts_only": "Only metadata so far; code, tests and docs are not inspected and readiness stays unknown.",
    "profile_without_inspection": "The profile has no current inspection behind it and is not used. ",
    "profile_outdated": "The profile is bound to another push or inspection and needs review. ",
}
