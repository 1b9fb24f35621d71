"""Checking SQL for the signal job and raw payload intake."""

from beaconry import constants as K
from oracle.core import count_of, cte, joined, query, us

SQL: dict[str, str] = {}


def safe(u):
    return (f"(length({u}) <= 2048 AND regexp_matches({u}, '^[hH][tT][tT][pP][sS]?://[^/?#]') AND NOT regexp_matches({u}, '[\\x00-\\x1f]'))")


def canonical(u):
    enc = "replace(url_encode(url_decode({x})), '%20', '+')"
    path = f"rtrim(regexp_extract({u}, '^[a-zA-Z]+:(?://[^/?#]*)?([^?#]*)', 1), '/')"
    q = (f"array_to_string(list_transform(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
         f"lambda p: regexp_matches(p, '^[^=]*=.') AND NOT starts_with(lower(p), 'utm_')), "
         f"lambda p: {enc.format(x=chr(115) + 'plit_part(p, ' + repr('=') + ', 1)')} || '=' || {enc.format(x='regexp_replace(p, ' + repr('^[^=]*=') + ', ' + repr('') + ')')}), '&')")
    return (f"lower(split_part({u}, ':', 1)) || '://' || lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)) || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END")


cte("sig", ["signals_raw"], f"""
SELECT *, {canonical('url')} AS url_key, 'signal_' || substr(sha1(kind || ':' || {canonical('url')}), 1, 12) AS id,
  (now_us - {us('published_at')}) / 3600000000.0::DOUBLE AS age_hours,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.24::DOUBLE + {count_of('lower(title)', K.SIGNAL_AI_TERMS)} * 0.14::DOUBLE
    + {count_of('lower(title)', K.SIGNAL_PRODUCT_TERMS)} * 0.1::DOUBLE - {count_of('lower(title)', K.SIGNAL_MARKETING_TERMS)} * 0.09::DOUBLE)) AS relevance,
  CASE WHEN coalesce(nullif(importance, ''), '0.5') IN ('NaN', 'high', 'true') THEN NULL
    ELSE round_even(greatest(0.0::DOUBLE, least(coalesce(nullif(importance, ''), '0.5')::DOUBLE, 0.96::DOUBLE)), 4)::DOUBLE END AS agg_score,
  round_even(greatest(0.5::DOUBLE, 0.82::DOUBLE - (rank - 1) * 0.025::DOUBLE), 4)::DOUBLE AS rk_score FROM signals_raw""")
cte("sig_window", ["sig"], f"SELECT * FROM sig WHERE coalesce(title, '') <> '' AND {safe('url')} AND age_hours BETWEEN -2 AND 48")
cte("sig_scored", ["sig_window"], """
SELECT * FROM (SELECT *, CASE kind WHEN 'official' THEN round_even(least(0.99::DOUBLE, 0.58::DOUBLE
      + greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(age_hours, 0.0::DOUBLE) / 48) * 0.14::DOUBLE + relevance * 0.28::DOUBLE), 4)::DOUBLE
    WHEN 'aggregated' THEN agg_score WHEN 'ranking' THEN rk_score ELSE 0.68::DOUBLE END AS score,
  CASE kind WHEN 'official' THEN 4 WHEN 'curated' THEN 3 WHEN 'ranking' THEN 2 ELSE 1 END AS prio FROM sig_window) s WHERE score IS NOT NULL""")
cte("sig_arrival", ["sig_scored"], """
SELECT *, row_number() OVER (PARTITION BY run_id, url_key ORDER BY ord) AS arrival,
  row_number() OVER (PARTITION BY run_id, url_key ORDER BY prio DESC, ord) AS lead FROM sig_scored""")
cte("sig_names", ["sig_arrival"], """
SELECT run_id, url_key, string_agg(DISTINCT n, '|' ORDER BY n) AS names FROM (
  SELECT run_id, url_key, unnest(sources) AS n FROM sig_arrival
  UNION ALL SELECT run_id, url_key, source FROM sig_arrival WHERE arrival > 1) u GROUP BY ALL""")
cte("sig_ev", ["sig_arrival"], """
SELECT run_id, url_key, string_agg(DISTINCT n, '|' ORDER BY n) AS names FROM (SELECT run_id, url_key, unnest(evidence) AS n FROM sig_arrival) u GROUP BY ALL""")
cte("sig_merged", ["sig_arrival", "sig_names", "sig_ev"], f"""
SELECT f.run_id, f.url_key, f.ord, g.score, g.arrivals, f.url, f.repo, f.reported_daily_growth, h.kind, h.title, h.source, h.source_url, h.published_at, h.id, h.prio,
  CASE WHEN arrivals > 1 THEN n.names ELSE {joined('f.sources')} END AS sources, CASE WHEN arrivals > 1 THEN e.names ELSE {joined('f.evidence')} END AS evidence
FROM (SELECT * FROM sig_arrival WHERE arrival = 1) f JOIN (SELECT * FROM sig_arrival WHERE lead = 1) h ON h.run_id = f.run_id AND h.url_key = f.url_key
JOIN (SELECT run_id, url_key, max(score) AS score, count(*) AS arrivals FROM sig_arrival GROUP BY ALL) g ON g.run_id = f.run_id AND g.url_key = f.url_key
LEFT JOIN sig_names n ON n.run_id = f.run_id AND n.url_key = f.url_key LEFT JOIN sig_ev e ON e.run_id = f.run_id AND e.url_key = f.url_key""")
cte("sig_ranked", ["sig_merged"], f"""
SELECT *, position <= 5 AS top FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY prio DESC, score DESC, {us('published_at')} DESC, ord)::INT AS position
FROM sig_merged) r WHERE position <= 30""")
cte("src_health", ["source_attempts", "sig_scored"], """
SELECT a.run_id, a.source, a.source_url, CASE WHEN error IS NULL THEN 'healthy' ELSE 'failed' END AS state,
  CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS item_count, CASE WHEN error IS NULL THEN latest END AS latest_item_at, error
FROM source_attempts a LEFT JOIN (SELECT run_id, source, count(*) AS n, max(published_at) AS latest FROM sig_scored GROUP BY ALL) s
  ON s.run_id = a.run_id AND s.source = a.source""")

SQL["signal_window"] = query(["sig_window"], "SELECT run_id, ord, kind, title, url FROM sig_window")
SQL["signal_relevance"] = query(["sig"], "SELECT run_id, ord, round(relevance, 6) AS relevance FROM sig")
SQL["official_score"] = query(["sig_scored"], "SELECT run_id, ord, score FROM sig_scored WHERE kind = 'official'")
SQL["aggregated_score"] = query(["sig"], "SELECT run_id, ord, agg_score AS score FROM sig")
SQL["rank_score"] = query(["sig"], "SELECT run_id, ord, rk_score AS score FROM sig")
SQL["signal_id"] = query(["sig"], "SELECT run_id, ord, id FROM sig")
SQL["canonical_signal_url"] = query(["sig"], "SELECT run_id, ord, url_key FROM sig")
SQL["merge_signals"] = query(["sig_merged"], """
SELECT run_id, url_key, ord, score, arrivals, url, repo, reported_daily_growth, kind, title, source, source_url, published_at, id, sources, evidence FROM sig_merged""")
SQL["rank_signals"] = query(["sig_ranked"], "SELECT run_id, position, id, kind, score, top FROM sig_ranked")
SQL["source_health"] = query(["src_health"], "SELECT run_id, source, source_url, state, item_count, latest_item_at, error FROM src_health")
SQL["signal_summary"] = query(["src_health", "sig_ranked"], """
SELECT h.run_id, healthy_source_count, failed_source_count, coalesce(signal_count, 0) AS signal_count, coalesce(top_count, 0) AS top_count FROM (
  SELECT run_id, count(*) FILTER (WHERE state = 'healthy') AS healthy_source_count, count(*) FILTER (WHERE state = 'failed') AS failed_source_count FROM src_health GROUP BY run_id) h
LEFT JOIN (SELECT run_id, count(*) AS signal_count, count(*) FILTER (WHERE top) AS top_count FROM sig_ranked GROUP BY run_id) s ON s.run_id = h.run_id""")
cte("sig_overlay", ["sig_ranked", "signal_enrichment"], f"""
SELECT *, coalesce(complete AND at_us >= {us('published_at')} AND (coalesce(e_source_at, '') = '' OR {us('e_source_at')} = {us('published_at')}), false) AS enriched FROM (
  SELECT r.*, e.title AS e_title, e.category AS e_category, e.takeaway AS e_takeaway, e.source_published_at AS e_source_at,
    coalesce(e.title <> '' AND e.takeaway <> '' AND e.why <> '' AND e.category <> '', false) AS complete, {us('coalesce(e.analyzed_at, e.set_generated_at)')} AS at_us
  FROM sig_ranked r LEFT JOIN signal_enrichment e ON e.run_id = r.run_id AND e.url = r.url) x""")
SQL["signal_enrichment_overlay"] = query(["sig_overlay"], """
SELECT run_id, position, url, enriched, complete AND NOT enriched AS complete_but_stale, CASE WHEN enriched THEN e_title ELSE title END AS shown_title,
  CASE WHEN enriched THEN e_category ELSE kind END AS shown_category FROM sig_overlay""")
SQL["signal_digest"] = query(["sig_overlay"], """
SELECT run_id, position, CASE WHEN enriched THEN e_title ELSE title END AS shown_title, CASE WHEN enriched THEN e_category ELSE kind END AS shown_category, source,
  floor(score * 100 + 0.5)::INT AS score_percent, len(string_split(sources, '|'))::INT AS source_count, enriched, CASE WHEN enriched THEN e_takeaway END AS takeaway
FROM sig_overlay WHERE top""")

# --- raw payload intake: the rows that the bodies were assembled from ---------------------------
_AGE = "((now_us - {}) / 3600000000.0::DOUBLE BETWEEN -2 AND 48)".format
_ISO = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%SZ')".format
cte("bodies", ["sig"], """
SELECT *, row_number() OVER (PARTITION BY run_id, source, kind ORDER BY ord) - 1 AS n, min(ord) OVER (PARTITION BY run_id, source, kind) AS first_ord FROM sig""")
SQL["extract_feed_entries"] = query(["bodies"], f"""
SELECT run_id, source, now_at AS fetched_at, window_hours, n::INT AS entry_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CASE WHEN {safe('url')} THEN url END AS url,
  {_AGE('published_us')} AS in_window, {_ISO('published_us')} AS published_at FROM bodies WHERE kind = 'official' AND n < 30 AND first_ord % 5 <> 4""")
SQL["extract_brief_items"] = query(["bodies"], f"""
SELECT run_id, source, now_at AS fetched_at, window_hours, n::INT AS item_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CASE WHEN {safe('url')} THEN url END AS url, agg_score AS score, '' AS sources,
  {_AGE('published_us')} AS in_window, {_ISO('published_us')} AS published_at FROM bodies WHERE kind = 'aggregated' AND n < 30 AND first_ord % 5 <> 4""")
cte("rank_day", ["bodies"], f"""
SELECT *, CASE WHEN first_ord % 5 = 4 THEN now_us ELSE epoch_us(date_trunc('day', make_timestamp(now_us))) - 8 * 3600000000 END AS day_us FROM bodies WHERE kind = 'ranking' AND n < 10""")
SQL["extract_rank_table"] = query(["rank_day"], f"""
SELECT run_id, source, n::INT AS row_no, rank, repo, 'https://github.com/' || repo AS url, reported_daily_growth, rk_score AS score, {_ISO('day_us')} AS published_at
FROM rank_day WHERE {_AGE('day_us')}""")
SQL["extract_release_signal"] = query(["bodies"], f"""
SELECT run_id, source, now_at AS fetched_at, window_hours, 'v' || first_ord AS tag, CASE WHEN first_ord % 4 <> 2 THEN source_url END AS url, {_AGE('p')} AS in_window,
  {_ISO('p')} AS published_at, CASE WHEN first_ord % 4 = 2 THEN 'failed' ELSE 'healthy' END AS state, CASE WHEN first_ord % 4 <> 2 AND {_AGE('p')} THEN 0.68::DOUBLE END AS score
FROM (SELECT run_id, source, now_at, now_us, window_hours, first_ord, min(source_url) AS source_url, max(published_us) AS p FROM bodies WHERE kind = 'curated' GROUP BY ALL) r""")
_FMT = "CASE kind WHEN 'official' THEN 'feed' WHEN 'aggregated' THEN 'brief' WHEN 'ranking' THEN 'rank_table' ELSE 'release' END"
cte("body_heads", ["bodies"], f"SELECT DISTINCT run_id, source, {_FMT} AS format, first_ord FROM bodies")
SQL["payload_state"] = query(["body_heads"], """
SELECT run_id, source, format, CASE WHEN format IN ('feed', 'brief') AND first_ord % 5 = 4 THEN 'failed' ELSE 'healthy' END AS state FROM body_heads""")
SQL["load_documents"] = query(["body_heads"], """
SELECT run_id, source, format, CASE WHEN format IN ('feed', 'rank_table') OR (format = 'brief' AND first_ord % 5 = 4) THEN 'not_an_object' END AS reason FROM body_heads""")
