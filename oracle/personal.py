"""Checking SQL for personal ranking and task search."""

from beaconry import constants as K
from oracle.core import any_of, cte, joined, query

SQL: dict[str, str] = {}
_values = ", ".join(f"'{v}'" for v in K.FEEDBACK_VALUES)
_case = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"
_r1 = lambda x: f"floor(({x}) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE"

cte("vf", ["served_feedback", "served_catalog"], f"""
SELECT f.device_id, f.generation_id, f.project_slug, arg_max(value, at_us) AS value FROM served_feedback f
JOIN served_catalog c ON c.generation_id = f.generation_id AND c.project_slug = f.project_slug WHERE value IN ({_values}) GROUP BY ALL""")
SQL["valid_feedback"] = query(["vf"], "SELECT device_id, generation_id, project_slug, value FROM vf")
cte("feat0", ["served_catalog"], """
SELECT generation_id, project_slug, 0 AS feature_no, 'category' AS prefix, category AS raw FROM served_catalog
UNION ALL SELECT generation_id, project_slug, i, 'capability', capabilities[i] FROM (SELECT *, unnest(range(1, len(capabilities) + 1)) AS i FROM served_catalog) a
UNION ALL SELECT generation_id, project_slug, len(capabilities) + i, 'task', task_terms[i] FROM (SELECT *, unnest(range(1, len(task_terms) + 1)) AS i FROM served_catalog) b""")
_gen = ", ".join(f"'{g}'" for g in K.GENERIC_FEATURES)
cte("feat", ["feat0"], f"""
SELECT generation_id, project_slug, min(feature_no)::INT AS feature_no, prefix || ':' || nm AS feature, arg_min(trim(raw), feature_no) AS label,
  count(*) OVER (PARTITION BY generation_id, project_slug) AS n_features
FROM (SELECT *, regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g') AS nm FROM feat0) x WHERE length(nm) >= 2 AND nm NOT IN ({_gen}) GROUP BY generation_id, project_slug, prefix, nm""")
SQL["project_features"] = query(["feat"], "SELECT generation_id, project_slug, feature_no, feature, label, n_features FROM feat")
cte("fscore", ["vf", "feat"], f"""
SELECT device_id, v.generation_id, feature, max(label) AS label, sum(({_case('value', K.PREFERENCE_WEIGHTS)} / sqrt(n_features::DOUBLE))::DECIMAL(20,12)) AS score
FROM vf v JOIN feat f ON f.generation_id = v.generation_id AND f.project_slug = v.project_slug GROUP BY ALL""")
SQL["preference_profile"] = query(["fscore"], f"""
SELECT device_id, position, feature, {_r1('score::DOUBLE')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY abs(score) DESC, feature)::INT AS position FROM fscore) p WHERE position <= 8""")
cte("aff", ["fscore", "feat"], """
SELECT device_id, s.generation_id, f.project_slug, least(12.0::DOUBLE, greatest(-12.0::DOUBLE, sum(score)::DOUBLE / sqrt(count(*)::DOUBLE) * 4.0::DOUBLE)) AS affinity,
  array_to_string(list_slice(list(f.label ORDER BY score DESC, feature_no) FILTER (WHERE score > 0), 1, 2), '|') AS liked,
  list_slice(list(f.label ORDER BY score DESC, feature_no) FILTER (WHERE score > 0), 1, 2) AS liked_list
FROM fscore s JOIN feat f ON f.generation_id = s.generation_id AND f.feature = s.feature WHERE score <> 0 GROUP BY ALL""")
SQL["affinity"] = query(["aff"], "SELECT device_id, project_slug, round(affinity, 6) AS affinity, coalesce(liked, '') AS liked FROM aff")
cte("adj", ["vf", "served_catalog", "aff"], f"""
SELECT *, {_r1('base + (pull + direct)')} AS score, {_r1('base')} AS base_score, {_r1('pull + direct')} AS adjustment FROM (
  SELECT o.device_id, c.project_slug, c.position, c.heat_track, v.value, coalesce(affinity, 0.0::DOUBLE) AS pull, coalesce({_case('v.value', K.DIRECT_ADJUSTMENTS)}, 0.0::DOUBLE) AS direct,
    CASE WHEN readiness IS NULL THEN attention::DOUBLE ELSE attention * 0.58::DOUBLE + readiness * 0.42::DOUBLE END AS base,
    CASE WHEN v.value = 'useless' THEN 'marked useless, shown less' WHEN v.value = 'unsure' THEN 'marked unsure, kept for review'
      WHEN v.value IS NOT NULL THEN 'marked ' || v.value || ', similar projects first'
      WHEN len(liked_list) > 0 THEN array_to_string(list_transform(liked_list, lambda x: 'fits your interest: ' || x), '|')
      WHEN affinity < 0 THEN 'close to projects marked useless' ELSE 'base order by attention and readiness' END AS reasons
  FROM (SELECT DISTINCT device_id, generation_id FROM vf) o JOIN served_catalog c ON c.generation_id = o.generation_id
  LEFT JOIN aff a ON a.device_id = o.device_id AND a.generation_id = o.generation_id AND a.project_slug = c.project_slug
  LEFT JOIN vf v ON v.device_id = o.device_id AND v.generation_id = o.generation_id AND v.project_slug = c.project_slug) x""")
SQL["direct_adjustment"] = query(["adj"], "SELECT device_id, project_slug, direct FROM adj")
SQL["ranking_reasons"] = query(["adj"], "SELECT device_id, project_slug, reasons FROM adj")
cte("prank", ["adj"], "SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY score DESC, position)::INT AS rank FROM adj")
SQL["personal_ranking"] = query(["prank"], "SELECT device_id, rank, project_slug, score, base_score, adjustment FROM prank")
cte("pbal", ["prank"], """
SELECT *, (heat_track = 'long_term' AND score >= 60 AND row_number() OVER (PARTITION BY device_id, heat_track = 'long_term' AND score >= 60 ORDER BY rank) <= 2)
  OR (heat_track = 'recent_momentum' AND row_number() OVER (PARTITION BY device_id, heat_track ORDER BY rank) <= 3) AS picked FROM prank""")
cte("pbal2", ["pbal"], """
SELECT *, picked OR sum((NOT picked)::INT) OVER (PARTITION BY device_id ORDER BY rank) <= 5 - sum(picked::INT) OVER (PARTITION BY device_id) AS first5 FROM pbal""")
SQL["balanced_personal_ranking"] = query(["pbal2"], """
SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY first5 DESC, rank)::INT AS position, project_slug, score FROM pbal2""")
SQL["cold_start"] = query(["devices", "vf", "served_catalog"], f"""
SELECT d.device_id, c.position, c.project_slug, {_r1('CASE WHEN readiness IS NULL THEN attention::DOUBLE ELSE attention * 0.58::DOUBLE + readiness * 0.42::DOUBLE END')} AS score,
  0.0::DOUBLE AS adjustment, CASE WHEN readiness IS NULL THEN 'by attention; readiness unknown' ELSE 'by attention and readiness' END AS reason
FROM devices d JOIN served_catalog c ON c.generation_id = d.generation_id WHERE d.device_id NOT IN (SELECT device_id FROM vf)""")

# --- search -------------------------------------------------------------------------------
_norm = lambda x: f"regexp_replace(lower({x}), '[-_/]+', ' ', 'g')"
_lst = lambda items: "[" + ", ".join(f"'{i}'" for i in items) + "]"
_rules = ", ".join(f"CASE WHEN {any_of('nt', words)} THEN '{label}' END" for label, words, _, _ in K.INTENT_RULES)
_caps = ", ".join(f"CASE WHEN {any_of('nt', words)} THEN {_lst(caps)} ELSE [] END" for _, words, caps, _ in K.INTENT_RULES)
cte("qi0", ["search_queries"], f"""
SELECT query_id, generation_id, text, list_filter([{_rules}], lambda x: x IS NOT NULL) AS rules, flatten([{_caps}]) AS caps,
  list_concat(regexp_extract_all(lower(text), '[a-z0-9+#.]{{2,}}'), list_filter(string_split_regex(lower(text), '[\\s，。,.、/：:；;（）()]+'), lambda x: length(x) > 1)) AS toks
FROM (SELECT *, {_norm('text')} AS nt FROM search_queries) q""")
cte("qi", ["qi0"], f"""
SELECT *, CASE WHEN len(caps) > 0 THEN list_filter(caps, lambda x, i: list_position(caps, x) = i) ELSE {_lst(K.DEFAULT_CAPABILITIES)} END AS capabilities,
  list_filter(toks, lambda x, i: list_position(toks, x) = i) AS tokens FROM qi0""")
SQL["query_intents"] = query(["qi"], f"SELECT query_id, {joined('rules')} AS rules, {joined('capabilities')} AS capabilities, {joined('tokens')} AS tokens FROM qi")
cte("hay", ["served_catalog"], f"""
SELECT *, {_norm("repo || ' ' || title || ' ' || description || ' ' || category || ' ' || fit_hypothesis || ' ' || reuse_plan || ' ' || array_to_string(capabilities, ' ') || ' ' || array_to_string(task_terms, ' ')")} AS haystack,
  CASE analysis_state WHEN 'deep' THEN 10 WHEN 'static' THEN 6 ELSE 2 END + CASE WHEN readiness IS NULL THEN 0 ELSE floor(readiness * 0.06::DOUBLE + 0.5::DOUBLE)::INT END AS base FROM served_catalog""")
_hits = ", ".join(f"CASE WHEN list_contains(rules, '{label}') THEN list_filter({_lst(terms)}, lambda t: contains(haystack, {_norm('t')})) ELSE [] END"
                  for label, _, _, terms in K.INTENT_RULES)
cte("pm0", ["qi", "hay"], f"""
SELECT q.query_id, h.generation_id, h.position, h.project_slug, h.attention, h.base, h.analysis_state, [{_hits}] AS rh,
  list_filter(tokens, lambda t: contains(haystack, {_norm('t')})) AS th FROM qi q JOIN hay h ON h.generation_id = q.generation_id""")
_labels = _lst([r[0] for r in K.INTENT_RULES])
cte("pm", ["pm0"], f"""
SELECT *, least(100, least(54, coalesce(list_sum(list_transform(rh, lambda r: CASE WHEN len(r) > 0 THEN 10 + least(12, (len(r) - 1) * 4) ELSE 0 END)), 0))
    + least(20, len(th) * 5) + base)::INT AS score, len(flatten(rh)) > 0 OR len(th) > 0 AS strong,
  list_slice(list_concat(list_filter(list_transform(rh, lambda r, i: CASE WHEN len(r) > 0 THEN {_labels}[i] || ': ' || array_to_string(list_slice(r, 1, 2), ', ') END), lambda x: x IS NOT NULL),
    CASE WHEN len(th) > 0 THEN ['direct: ' || array_to_string(list_slice(th, 1, 2), ', ')] ELSE [] END, [analysis_state]), 1, 3) AS reasons FROM pm0""")
SQL["project_match"] = query(["pm"], "SELECT query_id, position, score FROM pm WHERE strong")
SQL["match_reasons"] = query(["pm"], f"SELECT query_id, position, {joined('reasons')} AS reasons FROM pm WHERE strong")
cte("topk", ["pm"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, attention DESC, position)::INT AS rank
  FROM (SELECT *, bool_or(strong) OVER (PARTITION BY query_id) AS any_strong FROM pm) p WHERE strong OR NOT any_strong) r WHERE rank <= 5""")
SQL["search_topk"] = query(["topk"], "SELECT query_id, rank, project_slug, score, strong FROM topk")
SQL["search_topk_compact"] = query(["topk"], "SELECT query_id, rank, project_slug FROM topk WHERE rank <= 3")
SQL["search_default"] = query(["served_catalog"], "SELECT generation_id, position, project_slug, heat_label || '|' || analysis_state AS reasons FROM served_catalog WHERE position <= 3")
