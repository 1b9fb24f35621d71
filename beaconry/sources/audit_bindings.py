"""Projections for the versioned-dataset, contract and audit jobs, with faults seeded by modulo."""

from __future__ import annotations

from beaconry.sources.bindings import (
    HOUR, LOGICAL, DuckSql, captures, project_enrichment, repo_facts, signals_raw, static_evidence)

_Q = "year(o_orderdate) * 4 + quarter(o_orderdate) - 1"
_CAP_OF_Q = "'c' || CAST(year(o_orderdate) AS STRING) || 'q' || CAST(quarter(o_orderdate) AS STRING)"
_QNO = "(CAST(substr(capture_id, 2, 4) AS INT) * 4 + CAST(substr(capture_id, 7) AS INT) - 1)"
_GNO = _QNO.replace("capture_id", "generation_id")


def _quarters(d):
    return f"""SELECT {_Q} AS qno, {d.iso(d.us('max(o_orderdate)'))} AS captured_at, {d.us('max(o_orderdate)')} AS captured_us,
               CAST(sum(o_orderkey) AS BIGINT) AS fp FROM {d.t('orders')} GROUP BY {_Q}"""


def baseline_pairs(d):
    return f"""
    SELECT 'refresh:' || CAST(qno AS STRING) AS pair_id, 'refresh' AS operation, CASE WHEN qno % 9 = 8 THEN NULL ELSE captured_at END AS declared_previous_at
    FROM ({_quarters(d)}) q
    UNION ALL SELECT 'derive:' || CAST(qno AS STRING), 'derive', captured_at FROM ({_quarters(d)}) q"""


def baseline_rows(d):
    """Latest and history captures of bases and candidates; combo = 2 * derive + candidate."""
    return f"""
    SELECT CASE WHEN combo < 2 THEN 'refresh:' ELSE 'derive:' END || CAST(g AS STRING) AS pair_id,
           CASE WHEN combo % 2 = 0 THEN 'base' ELSE 'candidate' END AS side,
           CASE WHEN k = top_k THEN 'latest' ELSE 'history' END AS role,
           CASE WHEN combo = 1 AND k = 1 AND g % 7 = 3 THEN '1990-01-01T00:00:00Z' ELSE captured_at END AS captured_at,
           CASE WHEN (combo = 1 AND k = -2 AND g % 11 = 4) OR (combo = 1 AND k = 0 AND g % 13 = 6) OR (combo = 3 AND k = -1 AND g % 4 = 1)
                THEN fp + 1 ELSE fp END AS fingerprint
    FROM (SELECT captured_at, fp, k, combo, qno - k AS g, CASE WHEN combo = 1 THEN 1 ELSE 0 END AS top_k
          FROM (SELECT captured_at, fp, qno, combo, {d.each(-5, 1)} AS k
                FROM (SELECT captured_at, fp, qno, {d.each(0, 3)} AS combo FROM ({_quarters(d)}) q) a) b) c
    WHERE k <= top_k AND NOT (combo = 1 AND k = 0 AND g % 5 = 2) AND NOT (combo = 3 AND k = 0 AND g % 6 = 5)"""


def generation_headers(d):
    return f"""
    SELECT 'g' || CAST(qno AS STRING) AS generation_id,
           CASE WHEN qno % 9 = 7 THEN substr(captured_at, 1, 19) ELSE captured_at END AS snapshot_at,
           CASE qno % 9 WHEN 1 THEN {d.iso('captured_us + 1000000')} WHEN 2 THEN 'soon' WHEN 7 THEN substr(captured_at, 1, 19) ELSE captured_at END AS catalog_at,
           CASE WHEN qno % 9 = 3 THEN {d.iso(f'captured_us - {HOUR}')} ELSE {d.iso(f'captured_us + {HOUR}')} END AS signals_at,
           CASE qno % 9 WHEN 4 THEN {d.iso(f'captured_us + {HOUR // 2}')} WHEN 5 THEN NULL WHEN 6 THEN {d.iso(f'captured_us - {HOUR}')}
                ELSE {d.iso(f'captured_us + 2 * {HOUR}')} END AS queue_at
    FROM ({_quarters(d)}) q"""


def inventory(d):
    """Order value per customer and quarter."""
    return f"""
    SELECT {_Q} AS qno, o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM {d.t('orders')} GROUP BY {_Q}, o_custkey"""


# --- contracts ------------------------------------------------------------------------------
def faulty_snapshot(d):
    return f"""
    SELECT capture_id, ord, CASE WHEN ord % 101 = 1 THEN NULL WHEN ord % 103 = 2 THEN repo || '/x' ELSE repo END AS repo,
           CASE WHEN ord % 107 = 3 THEN 'nowhere' ELSE 'https://git.example.org/' || repo END AS url,
           CASE WHEN ord % 109 = 4 THEN repeat('d', 4001) ELSE description END AS description,
           CASE WHEN ord % 113 = 5 THEN '' WHEN ord % 211 = 5 THEN repeat('l', 101) WHEN ord % 223 = 5 THEN 'BSD-3-Clause' ELSE license END AS license,
           CASE WHEN ord % 127 = 6 THEN {d.arr("'a'", "'b'", "'a'")} ELSE topics END AS topics,
           CASE WHEN ord % 131 = 7 THEN -1 WHEN ord % 137 = 8 THEN NULL ELSE stars END AS stars,
           CASE WHEN ord % 139 = 9 THEN NULL ELSE forks END AS forks, CASE WHEN ord % 149 = 10 THEN -5 ELSE open_issues END AS open_issues,
           CASE WHEN ord % 151 = 11 THEN '2020-01-01T00:00:00' WHEN ord % 227 = 11 THEN NULL ELSE created_at END AS created_at,
           CASE WHEN ord % 157 = 12 THEN '2020-13-01T00:00:00Z' WHEN ord % 229 = 12 THEN NULL ELSE pushed_at END AS pushed_at,
           CASE WHEN ord % 163 = 13 THEN '' ELSE candidate_query END AS candidate_query
    FROM ({repo_facts(d)}) f"""


def faulty_signals(d):
    return f"""
    SELECT run_id, ord, CASE WHEN ord % 17 = 1 THEN 'rumour' ELSE kind END AS kind, title,
           CASE WHEN ord % 19 = 2 THEN 'ftp://x/y' ELSE url END AS url,
           CASE WHEN ord % 23 = 3 THEN {d.if_nan()} WHEN ord % 29 = 4 THEN 1.5 WHEN ord % 31 = 5 THEN NULL WHEN ord % 37 = 6 THEN -0.25 ELSE 0.5 END AS score,
           published_at, CASE WHEN ord % 41 = 7 THEN 721 WHEN ord % 59 = 7 THEN 0 WHEN ord % 61 = 7 THEN 24 ELSE window_hours END AS window_hours,
           CASE WHEN ord % 43 = 8 THEN NULL ELSE repo END AS repo, CASE WHEN ord % 47 = 9 THEN NULL ELSE reported_daily_growth END AS reported_daily_growth,
           CASE WHEN ord % 53 = 10 THEN {d.arr()} ELSE evidence END AS evidence
    FROM ({signals_raw(d)}) s"""


def artifact_files(d):
    slug = "replace(replace(lower(repository), '/', '--'), '.', '-')"
    return f"""
    SELECT ord, schema_version, project_id, project_id_version, repository, expected_repository, file_key,
           CASE WHEN ord % 19 = 4 THEN 'data/elsewhere.json' ELSE 'data/enrichment/' || file_key || '.json' END AS queue_path
    FROM (SELECT ord, schema_version, CASE WHEN ord % 37 = 5 THEN 'bad' ELSE project_id END AS project_id,
                 CASE WHEN ord % 41 = 6 THEN 9 ELSE project_id_version END AS project_id_version,
                 CASE WHEN ord % 43 = 7 THEN 'local' ELSE repository END AS repository,
                 CASE WHEN ord % 23 = 8 THEN repository || 'x' ELSE repository END AS expected_repository,
                 CASE WHEN ord % 29 = 9 THEN 'strange' WHEN schema_version = 2 THEN project_id ELSE {slug} END AS file_key
          FROM ({static_evidence(d)}) e) x"""


def capture_headers(d):
    q = "CAST(substr(capture_id, 7) AS INT)"
    return f"""
    SELECT capture_id, captured_at, CASE WHEN {q} = 2 THEN NULL ELSE 6 END AS query_status_count,
           CASE WHEN {q} >= 3 THEN NULL ELSE 6 END AS successful_query_count, CASE WHEN {q} = 4 THEN NULL ELSE 0 END AS failed_query_count
    FROM ({captures(d)}) c"""


def _artifact_pairs(d):
    return f"""SELECT DISTINCT 'g' || CAST({_Q} AS STRING) AS generation_id, {_Q} AS qno, 'table_' || substr(o_orderpriority, 1, 1) AS artifact
               FROM {d.t('orders')}"""


def manifest_artifacts(d):
    return f"SELECT generation_id, artifact FROM ({_artifact_pairs(d)}) p WHERE NOT (qno % 6 = 1 AND artifact = 'table_2')"


def manifest_hashes(d):
    return f"SELECT generation_id, artifact FROM ({_artifact_pairs(d)}) p WHERE NOT (qno % 7 = 2 AND artifact IN ('table_3', 'table_5'))"


def manifests(d):
    return f"SELECT 'g' || CAST(qno AS STRING) AS generation_id, 'g' || CAST(qno - CASE WHEN qno % 8 = 3 THEN 1 ELSE 0 END AS STRING) AS partition_id FROM ({_quarters(d)}) q"


# --- audit tables: one generation per capture -----------------------------------------------------
def _ranked_facts(d):
    """Facts with their place by stars; the columns that audits read are written once."""
    return d.stored(f"""SELECT f.*, {_QNO} AS qno, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY stars DESC, ord) AS INT) AS position
               FROM ({repo_facts(d)}) f""", "capture_id, captured_at, repo, stars, created_at, pushed_at, candidate_query, ord, qno, position")


def audit_facts(d):
    """The rows of ``repo_snapshot`` with the columns that audits compare."""
    return f"SELECT capture_id, captured_at, repo, stars, created_at, pushed_at FROM ({_ranked_facts(d)}) r"


def _sha(d, text):
    return f"sha256({text})" if isinstance(d, DuckSql) else f"sha2({text}, 256)"


def audit_snapshot(d):
    return f"""
    SELECT capture_id AS generation_id, CASE WHEN qno % 8 = 1 AND position = 40 THEN '' ELSE repo END AS repo, stars,
           CASE WHEN qno % 9 = 2 AND ord % 50 = 1 THEN candidate_query || ' | ZZ' ELSE candidate_query END AS candidate_query
    FROM ({_ranked_facts(d)}) r
    UNION ALL SELECT capture_id, repo, stars, candidate_query FROM ({_ranked_facts(d)}) r WHERE qno % 11 = 3 AND position IN (50, 51)
    UNION ALL SELECT capture_id, replace(repo, '-', '.'), stars, candidate_query FROM ({_ranked_facts(d)}) r WHERE qno % 10 = 4 AND position = 60"""


def audit_catalog(d):
    return d.stored(f"""
    SELECT capture_id AS generation_id, position, CASE WHEN qno % 12 = 5 AND position = 30 THEN 'gone/' || CAST(ord AS STRING) ELSE repo END AS repo,
           CASE WHEN qno % 13 = 6 AND position IN (7, 8) THEN 'same' ELSE replace(lower(repo), '/', '--') END AS slug,
           CASE WHEN qno % 14 = 7 AND position = 9 THEN 'other--00000000000000000000' WHEN qno % 15 = 8 AND position = 10 THEN 'x'
                ELSE replace(lower(repo), '/', '-') || '--' || substr({_sha(d, 'lower(repo)')}, 1, 20) END AS project_id,
           CASE WHEN qno % 16 = 9 AND position = 11 THEN 2 ELSE 1 END AS project_id_version,
           stars + CASE WHEN qno % 7 = 3 AND position <= 3 THEN 1 ELSE 0 END AS stars,
           CASE WHEN qno % 9 = 4 AND position = 6 THEN 'sideways' WHEN (qno % 5 = 2 OR position > 5) AND ord % 3 = 0 THEN 'long_term'
                WHEN qno % 5 <> 2 AND position IN (2, 4) THEN 'long_term' ELSE 'recent_momentum' END AS heat_track,
           CASE WHEN qno % 10 = 5 AND position = 7 THEN '' ELSE 'label' END AS heat_label,
           CASE WHEN qno % 11 = 6 AND position = 8 THEN 120 ELSE CAST(100 - position AS INT) END AS attention, CAST(ord % 101 AS INT) AS endurance,
           CASE WHEN ord % 4 = 0 THEN 'watch' ELSE 'learn' END AS recommendation,
           CASE ord % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'static' ELSE 'facts_only' END AS analysis_state,
           CASE WHEN ord % 5 = 0 THEN 'velocity_proxy' ELSE 'observed' END AS growth_kind, CAST(ord % 9 - 2 AS BIGINT) AS growth_value,
           CASE WHEN qno % 6 = 1 AND position <= 2 THEN 'mailto:x' ELSE 'https://git.example.org/' || repo END AS href
    FROM ({_ranked_facts(d)}) r WHERE position <= 30""")


def audit_signals(d):
    gno = f"({_Q})"
    return f"""
    SELECT {_CAP_OF_Q} AS generation_id, CASE WHEN {gno} % 9 = 1 AND o_orderkey % 40 = 3 THEN 'signal_same' ELSE 'signal_' || CAST(o_orderkey AS STRING) END AS id,
           CASE WHEN {gno} % 10 = 2 AND o_orderkey % 40 = 5 THEN 'https://news.example.org/same'
                WHEN {gno} % 11 = 3 AND o_orderkey % 40 = 7 THEN 'javascript:' || CAST(o_orderkey AS STRING)
                ELSE 'https://news.example.org/' || CAST(o_orderkey AS STRING) END AS url,
           CASE WHEN {gno} % 12 = 4 AND o_orderkey % 40 = 9 THEN 1.25 WHEN {gno} % 12 = 5 AND o_orderkey % 40 = 9 THEN {d.if_nan()}
                ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS score,
           CASE WHEN {gno} % 13 = 6 AND o_orderkey % 40 = 11 THEN {d.iso(f"{d.us('make_date(1999, 12, 31)')}")}
                ELSE {d.iso(f"{d.us('make_date(2020, 1, 1)')} - (o_orderkey % 47) * {HOUR}")} END AS published_at
    FROM {d.t('orders')}"""


def audit_sources(d):
    return f"""
    SELECT generation_id, CASE WHEN gno % 8 = 1 AND p > '3' THEN 'src_same' ELSE 'src_' || p END AS id,
           CASE WHEN gno % 9 = 2 AND p = '2' THEN 'nohost' ELSE 'https://feeds.example.org/' || p END AS url,
           CASE WHEN gno % 10 = 3 AND p = '4' THEN 'unknown' WHEN n % 6 = 1 THEN 'failed' ELSE 'healthy' END AS state
    FROM (SELECT {_CAP_OF_Q} AS generation_id, {_Q} AS gno, substr(o_orderpriority, 1, 1) AS p, count(*) AS n FROM {d.t('orders')}
          GROUP BY {_CAP_OF_Q}, {_Q}, substr(o_orderpriority, 1, 1)) g"""


def audit_queue(d):
    return f"""
    SELECT generation_id, CASE WHEN {_GNO} % 9 = 1 AND position = 2 THEN 'project:same' WHEN {_GNO} % 9 = 1 AND position = 3 THEN 'project:same'
                ELSE 'project:' || project_id END AS id, CASE WHEN {_GNO} % 12 = 2 AND position = 4 THEN 'idea' ELSE 'project' END AS kind,
           CASE WHEN analysis_state = 'facts_only' THEN 'static_analysis_required' ELSE 'ready' END AS evidence_state
    FROM ({audit_catalog(d)}) c WHERE position <= 5
    UNION ALL SELECT generation_id, 'signal:' || id, 'signal', NULL FROM ({audit_signals(d)}) s"""


def _rule_counts(d):
    """Lines per generation and rule, counted once."""
    return d.stored(f"""SELECT 'c' || CAST(year(l_shipdate) AS STRING) || 'q' || CAST(quarter(l_shipdate) AS STRING) AS generation_id,
                 year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS gno, l_returnflag || l_linestatus AS rule, count(*) AS n
          FROM {d.t('lineitem')} GROUP BY 1, 2, 3""")


def audit_status(d):
    """Recall status rows per generation with faulty states, counts and errors."""
    return f"""
    SELECT generation_id, CASE WHEN gno % 9 = 1 AND rule = 'AF' THEN 'NO' ELSE rule END AS query,
           CASE WHEN gno % 10 = 2 AND rule = 'AO' THEN 'odd' WHEN gno % 17 = 3 THEN 'failed' WHEN n % 7 = 1 THEN 'failed' ELSE 'healthy' END AS state,
           CASE WHEN gno % 11 = 4 AND rule = 'RF' THEN -1 WHEN gno % 11 = 5 AND rule = 'RF' THEN NULL ELSE n END AS item_count,
           CASE WHEN gno % 12 = 6 AND rule = 'RO' THEN 'stray' WHEN gno % 12 = 7 THEN NULL WHEN gno % 17 = 3 OR n % 7 = 1 THEN 'timeout' END AS error
    FROM ({_rule_counts(d)}) g"""


def audit_rules(d):
    """Declared recall rules per generation."""
    if d.store:  # the same pairs, from the counts instead of three times from the lines
        return f"""
    SELECT DISTINCT generation_id, rule AS query FROM ({_rule_counts(d)}) r
    UNION ALL SELECT DISTINCT generation_id, 'AF' FROM ({_rule_counts(d)}) r WHERE gno % 13 = 8"""
    return f"""
    SELECT DISTINCT 'c' || CAST(year(l_shipdate) AS STRING) || 'q' || CAST(quarter(l_shipdate) AS STRING) AS generation_id,
           l_returnflag || l_linestatus AS query FROM {d.t('lineitem')}
    UNION ALL
    SELECT DISTINCT 'c' || CAST(year(l_shipdate) AS STRING) || 'q' || CAST(quarter(l_shipdate) AS STRING), 'AF' FROM {d.t('lineitem')}
    WHERE (year(l_shipdate) * 4 + quarter(l_shipdate) - 1) % 13 = 8"""


def audit_headers(d):
    """Declared values per generation: true counts with one added where the modulo says so."""
    def plus(m, r):
        return f"CASE WHEN gno % {m} = {r} THEN 1 ELSE 0 END"
    gno = _GNO
    return f"""
    SELECT s.generation_id, gno, n_snapshot + {plus(20, 1)} AS snapshot_count, n_snapshot + {plus(20, 2)} AS source_count,
           n_catalog + {plus(20, 3)} AS project_count, coalesce(n_signals, 0) + {plus(20, 4)} AS signal_count, n_queue + {plus(20, 5)} AS pending_count,
           n_project + {plus(20, 6)} AS project_pending_count, n_signal + {plus(20, 7)} AS signal_pending_count, n_queue + {plus(20, 8)} AS catalog_pending_count,
           n_deep + {plus(20, 9)} AS deep_count, d_long + {plus(20, 10)} AS daily_long_term, d_recent AS daily_recent,
           coalesce(src_ok, 0) + {plus(20, 11)} AS healthy_source_count, coalesce(src_bad, 0) + {plus(20, 12)} AS failed_source_count,
           CASE WHEN gno % 20 = 13 THEN NULL ELSE q_ok END AS successful_query_count, q_bad + {plus(20, 14)} AS failed_query_count, q_bad + {plus(20, 15)} AS query_failure_count,
           gno % 20 <> 16 AS queries_is_list, gno % 20 <> 17 AS status_is_list, CASE WHEN gno % 20 = 18 THEN 2 ELSE 0 END AS status_non_objects,
           gno % 20 <> 19 AS failures_is_list, 3 AS catalog_version, CASE WHEN gno % 19 = 1 THEN 1 ELSE 2 END AS queue_version,
           CASE WHEN gno % 19 = 2 THEN NULL ELSE 1 END AS queue_identity_version,
           CASE WHEN gno % 18 = 1 THEN NULL ELSE {d.iso(d.us('make_date(2020, 1, 1)'))} END AS signals_at,
           CASE gno % 17 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE 48 END AS window_hours
    FROM (SELECT generation_id, {gno} AS gno, count(*) AS n_snapshot FROM ({audit_snapshot(d)}) x GROUP BY generation_id) s
    LEFT JOIN (SELECT generation_id, count(*) AS n_catalog, {d.count_if("analysis_state = 'deep'")} AS n_deep,
                 {d.count_if("position <= 5 AND heat_track = 'long_term'")} AS d_long, {d.count_if("position <= 5 AND heat_track = 'recent_momentum'")} AS d_recent
          FROM ({audit_catalog(d)}) x GROUP BY generation_id) c ON c.generation_id = s.generation_id
    LEFT JOIN (SELECT generation_id, count(*) AS n_signals FROM ({audit_signals(d)}) x GROUP BY generation_id) g ON g.generation_id = s.generation_id
    LEFT JOIN (SELECT generation_id, count(*) AS n_queue, {d.count_if("kind = 'project'")} AS n_project, {d.count_if("kind = 'signal'")} AS n_signal
          FROM ({audit_queue(d)}) x GROUP BY generation_id) q ON q.generation_id = s.generation_id
    LEFT JOIN (SELECT generation_id, {d.count_if("state = 'healthy'")} AS src_ok, {d.count_if("state = 'failed'")} AS src_bad
          FROM ({audit_sources(d)}) x GROUP BY generation_id) o ON o.generation_id = s.generation_id
    LEFT JOIN (SELECT generation_id, {d.count_if("state = 'healthy'")} AS q_ok, {d.count_if("state = 'failed'")} AS q_bad
          FROM ({audit_status(d)}) x GROUP BY generation_id) t ON t.generation_id = s.generation_id"""


def audit_artifacts(d):
    """Evidence rows assigned to the newest generation, some with another id or version."""
    return f"""
    SELECT 'c2000q' || CAST(ord % 4 + 1 AS STRING) AS generation_id, repository, schema_version,
           CASE WHEN ord % 17 = 2 THEN 'other--11111111111111111111' ELSE project_id END AS project_id, ord
    FROM ({static_evidence(d)}) e
    UNION ALL
    SELECT 'c2000q' || CAST(ord % 4 + 1 AS STRING), upper(repository), schema_version, project_id, ord FROM ({static_evidence(d)}) e WHERE ord % 200 = 1"""


def audit_profiles(d):
    return f"""
    SELECT 'c2000q' || CAST(ord % 4 + 1 AS STRING) AS generation_id, repository, schema_version FROM ({project_enrichment(d)}) p
    UNION ALL
    SELECT 'c2000q' || CAST(ord % 4 + 1 AS STRING), upper(repository), schema_version FROM ({project_enrichment(d)}) p WHERE ord % 300 = 2"""


def audit_inventory(d):
    """Artifact files found per generation and how they parsed."""
    return f"""
    SELECT generation_id, artifact, CASE n % 8 WHEN 1 THEN 'broken' WHEN 2 THEN 'not_object' ELSE 'ok' END AS parse_state, CASE WHEN n % 8 = 3 THEN 4 ELSE 0 END AS schema_errors
    FROM (SELECT {_CAP_OF_Q} AS generation_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'snapshot' WHEN '2' THEN 'catalog' WHEN '3' THEN 'signals' ELSE 'queue' END AS artifact,
                 count(*) AS n, {_Q} AS gno FROM {d.t('orders')} GROUP BY 1, 2, 4) g WHERE NOT (gno % 9 = 4 AND artifact = 'queue')"""


_SHAPE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'snapshot' WHEN '2' THEN 'catalog' WHEN '3' THEN 'signals' WHEN '4' THEN 'sources' ELSE 'queue' END"


def intake_rows(d):
    """Raw rows of each document, some of them not objects."""
    return f"""
    SELECT {_CAP_OF_Q} AS generation_id, {_SHAPE} AS artifact,
           CASE WHEN o_orderkey % 211 = 1 THEN '"text"' WHEN o_orderkey % 307 = 2 THEN NULL ELSE ' {{"k":' || CAST(o_orderkey AS STRING) || '}}' END AS row_text
    FROM {d.t('orders')}"""


def intake_documents(d):
    return f"""
    SELECT generation_id, artifact, CASE WHEN n % 9 = 4 THEN '{{}}' WHEN n % 9 = 5 THEN NULL ELSE ' [...' END AS container_text
    FROM (SELECT {_CAP_OF_Q} AS generation_id, {_SHAPE} AS artifact, count(*) AS n FROM {d.t('orders')} GROUP BY 1, 2) g"""


def audit_failures(d):
    return f"""
    SELECT generation_id, CASE WHEN {_GNO} % 7 = 1 THEN '' ELSE repo END AS repository, CASE WHEN {_GNO} % 8 = 2 THEN NULL ELSE 'clone failed' END AS error
    FROM ({audit_catalog(d)}) c WHERE analysis_state = 'facts_only' AND attention % 3 = 0"""


LOGICAL.update({f.__name__: f for f in [
    baseline_pairs, baseline_rows, generation_headers, inventory, faulty_snapshot, faulty_signals, artifact_files, capture_headers,
    manifest_artifacts, manifest_hashes, manifests, audit_facts, audit_snapshot, audit_catalog, audit_signals, audit_sources, audit_queue, audit_status,
    audit_rules, audit_headers, audit_artifacts, audit_profiles, audit_inventory, intake_rows, intake_documents, audit_failures]})
