"""Projections that turn the driver's parquet tables into the logical tables.

Each projection is one SQL text rendered for Spark or for the checking engine, so both sides
start from identical rows.  Text and integer arithmetic only: no randomness, no clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.operators.skew import task_count

HOUR, DAY = 3_600_000_000, 86_400_000_000


class SparkSql:
    """Spark rendering of the few functions that differ between engines."""

    def __init__(self, sf_dir: str, parts: int = 1, store=None):
        self.sf_dir, self.parts, self.store = sf_dir, parts, store

    mat = ""

    def stored(self, sql, columns="*"):
        """Rows that several tables are made of, written once: ``store`` takes their SQL and gives the folder; ``columns`` are those kept."""
        if not self.store:
            return sql
        return f"SELECT * FROM parquet.`{self.store(sql if columns == '*' else f'SELECT {columns} FROM ({sql}) s')}`"

    def last(self, key, order):
        """Column ``latest`` of the last row of each key."""
        return f", lead({order}) OVER (PARTITION BY {key} ORDER BY {order}) IS NULL AS latest"

    latest = "WHERE latest"

    def t(self, name):
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def spread(self, name):
        """A table whose rows cost far more than their bytes tell: a small file would be one task."""
        return f"(SELECT /*+ REPARTITION({self.parts}) */ * FROM {self.t(name)}) spread"

    def us(self, expr):
        return f"unix_micros(CAST({expr} AS TIMESTAMP))"

    def iso(self, us):
        return f"""date_format(timestamp_micros({us}), "yyyy-MM-dd'T'HH:mm:ss'Z'")"""

    def iso_us(self, us):
        return f"""date_format(timestamp_micros({us}), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")"""

    def rfc822(self, us):
        return f"date_format(timestamp_micros({us}), 'd MMM yyyy HH:mm:ss')"

    def day(self, us, fmt="yyyy-MM-dd"):
        return f"date_format(timestamp_micros({us}), '{fmt}')"

    def ts(self, us):
        return f"timestamp_micros({us})"

    def idiv(self, a, b):
        return f"({a} div {b})"

    def join_set(self, expr, sep):
        return f"array_join(array_sort(collect_set({expr})), '{sep}')"

    def join_seq(self, expr, sep, order):
        return (f"array_join(transform(array_sort(collect_list(struct({order} AS o, {expr} AS v))), "
                f"x -> x.v), '{sep}')")

    def arr(self, *items):
        return f"array({', '.join(items)})"

    def no_array(self):
        return "CAST(NULL AS ARRAY<STRING>)"

    def word(self, text, i):
        return f"element_at(split({text}, ' '), {i})"

    def named_parts(self):
        """Parts with their names cut into words, once a part instead of once for each of its rows."""
        return f"(SELECT *, split(p_name, ' ') AS p_words FROM {self.t('part')})"

    def part_word(self, i):
        return f"element_at(p_words, {i})"

    def sha256(self, text):
        return f"sha2({text}, 256)"

    def json_int(self, col, key):
        return f"CAST(get_json_object({col}, '$.{key}') AS BIGINT)"

    def count_if(self, cond):
        return f"count_if({cond})"

    def clean(self, text):
        return f"trim(regexp_replace({text}, '[^A-Za-z0-9 ]+', ''))"

    def if_nan(self):
        return "CAST('NaN' AS DOUBLE)"

    def each(self, first, last):
        return f"explode(sequence({first}, {last}))"


class DuckSql(SparkSql):
    mat = "MATERIALIZED"
    latest = ""

    def last(self, key, order):
        return ""

    def __init__(self):
        super().__init__("")

    def t(self, name):
        return name

    spread = t

    def us(self, expr):
        return f"epoch_us({expr}::TIMESTAMP)"

    def iso(self, us):
        return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ')"

    def iso_us(self, us):
        return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%fZ')"

    def rfc822(self, us):
        return f"strftime(make_timestamp({us}), '%-d %b %Y %H:%M:%S')"

    def day(self, us, fmt="yyyy-MM-dd"):
        fmt = fmt.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
        return f"strftime(make_timestamp({us}), '{fmt}')"

    def ts(self, us):
        return f"make_timestamp({us})"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def join_set(self, expr, sep):
        return f"string_agg(DISTINCT {expr}, '{sep}' ORDER BY {expr})"

    def join_seq(self, expr, sep, order):
        return f"string_agg({expr}, '{sep}' ORDER BY {order})"

    def arr(self, *items):
        return f"[{', '.join(items)}]"

    def no_array(self):
        return "CAST(NULL AS VARCHAR[])"

    def word(self, text, i):
        return f"split_part({text}, ' ', {i})"

    def named_parts(self):
        return self.t("part")

    def part_word(self, i):
        return self.word("p_name", i)

    def sha256(self, text):
        return f"sha256({text})"

    def json_int(self, col, key):
        return f"CAST(json_extract_string({col}, '$.{key}') AS BIGINT)"

    def count_if(self, cond):
        return f"count(*) FILTER (WHERE {cond})"

    def clean(self, text):
        return f"trim(regexp_replace({text}, '[^A-Za-z0-9 ]+', '', 'g'))"

    def each(self, first, last):
        return f"unnest(range({first}, {last} + 1))"


# Fixed maps from the words of a part name to repository topics.
NOUN_TOPICS = {
    "plate": "agent", "rod": "workflow", "anvil": "cli", "ring": "video", "bolt": "research",
    "gear": "roadmap", "gizmo": "exploit", "widget": "sdk",
}
ADJECTIVE_TOPICS = {
    "blue": "productivity", "new": "developer-tools", "cold": "self-hosted",
    "red": "artificial-intelligence", "large": "code-review", "small": "data",
    "hot": "productivity", "old": "data",
}


def _case(expr, mapping, default="NULL"):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _part_quarters(d):
    """One row per (part, quarter with a line), with cumulative counters."""
    return d.stored(f"""
    SELECT l_partkey, qno, min_ship, max_ship, rules,
           10 * sum(qty) OVER (PARTITION BY l_partkey ORDER BY qno) AS stars,
           sum(n_lines) OVER (PARTITION BY l_partkey ORDER BY qno) AS forks,
           min(min_ship) OVER (PARTITION BY l_partkey ORDER BY qno) AS first_ship{d.last('l_partkey', 'qno')}
    FROM (SELECT l_partkey, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qno,
                 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n_lines,
                 {d.us('min(l_shipdate)')} AS min_ship, {d.us('max(l_shipdate)')} AS max_ship,
                 {d.join_set("l_returnflag || l_linestatus", " | ")} AS rules
          FROM {d.t('lineitem')}
          GROUP BY l_partkey, year(l_shipdate) * 4 + quarter(l_shipdate) - 1) g""")


def _capture_cols(d):
    nxt = "(qno + 1)"
    end = f"make_date(CAST({d.idiv(nxt, 4)} AS INT), CAST(({nxt} % 4) * 3 + 1 AS INT), 1)"
    return (f"'c' || CAST({d.idiv('qno', 4)} AS STRING) || 'q' || CAST(qno % 4 + 1 AS STRING)", d.us(end))


def _repo_name():
    return ("'owner' || CAST(p_size AS STRING) || '/' || replace(p_name, ' ', '-') || '-' || "
            "CAST(p_partkey AS STRING)")


def repo_facts(d, only=""):
    """Repository facts at each capture: one row per (capture, repository); ``only`` is a condition on the quarters of parts."""
    cap_id, cap_us = _capture_cols(d)
    noun, adj = d.part_word(2), d.part_word(1)
    pushed = "max_ship + (p_partkey % 24) * 3600000000"
    return f"""
    SELECT capture_id, {d.iso('captured_us')} AS captured_at, captured_us, repo,
           CASE WHEN p_partkey % 13 = 0 THEN 'ftp://bad host/' || repo
                WHEN p_partkey % 19 = 0 THEN 'https://user@git.example.org/' || repo
                ELSE 'https://git.example.org/' || repo END AS url,
           CASE WHEN p_partkey % 5 = 0 THEN NULL
                ELSE {adj} || ' ' || lower(p_type) || ' toolbox for ' || {noun} END AS description,
           'owner' || CAST(p_size AS STRING) AS owner,
           CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS language,
           CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN NULL
                WHEN 2 THEN 'NOASSERTION' ELSE 'Apache-2.0' END AS license,
           CASE WHEN p_partkey % 23 = 0 THEN {d.no_array()}
                ELSE {d.arr(_case(noun, NOUN_TOPICS, "'misc'"), _case(adj, ADJECTIVE_TOPICS, "'misc'"))} END AS topics,
           CAST(stars AS BIGINT) AS stars, CAST(forks AS BIGINT) AS forks, CAST(p_partkey % 50 AS BIGINT) AS open_issues,
           CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE {d.iso('first_ship')} END AS created_at,
           CASE WHEN (p_partkey + qno) % 31 = 0 THEN NULL ELSE {d.iso(pushed)} END AS pushed_at,
           rules AS candidate_query, p_partkey AS ord,
           p_partkey % 37 = 0 AS archived, p_partkey % 41 = 0 AS fork
    FROM (SELECT q.*, p.*, {cap_id} AS capture_id, {cap_us} AS captured_us, {_repo_name()} AS repo
          FROM ({_part_quarters(d)}) q JOIN {d.named_parts()} p ON q.l_partkey = p.p_partkey {only}) x"""


def captures(d):
    """Capture headers: one row per quarter with a line."""
    cap_id, cap_us = _capture_cols(d)
    return f"""
    SELECT {cap_id} AS capture_id, {d.iso(cap_us)} AS captured_at
    FROM (SELECT DISTINCT year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qno FROM {d.t('lineitem')}) c"""


def repo_snapshot(d):
    return f"""
    SELECT capture_id, captured_at, captured_us, repo, url, description, owner, language, license, topics, stars,
           forks, open_issues, created_at, pushed_at, candidate_query, ord
    FROM ({repo_facts(d)}) f"""


def repo_hits(d):
    """Recall hits: one row per (capture, rule, repository)."""
    cap_id, cap_us = _capture_cols(d)
    return f"""
    WITH f AS {d.mat} ({repo_facts(d)}),
    h AS {d.mat} (
          SELECT {cap_id} AS capture_id, l_partkey, rule,
                 CASE rule WHEN 'AF' THEN 4 WHEN 'AO' THEN 1 WHEN 'NF' THEN 3 WHEN 'NO' THEN 6
                           WHEN 'RF' THEN 2 ELSE 5 END AS query_ord
          FROM (SELECT DISTINCT l_partkey, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qno,
                       l_returnflag || l_linestatus AS rule FROM {d.t('lineitem')}) r)
    SELECT f.capture_id, f.captured_at, h.rule, h.query_ord, CAST(f.ord AS INT) AS item_ord,
           CASE WHEN f.ord % 97 = 0 THEN NULL ELSE f.repo END AS repo,
           f.url || '?via=' || h.rule AS url, f.description, f.owner, f.language, f.license, f.stars, f.forks,
           f.open_issues, f.created_at, f.pushed_at
    FROM f JOIN h
      ON h.capture_id = f.capture_id AND h.l_partkey = f.ord"""


def raw_items(d):
    """Nested API items as JSON text, one per hit."""
    def js(name, col, quote=True):
        val = f"'\"' || {col} || '\"'" if quote else f"CAST({col} AS STRING)"
        return f"'\"{name}\":' || coalesce({val}, 'null')"
    fields = " || ',' || ".join([
        js("full_name", "repo"), js("html_url", "url"), js("description", "description"),
        js("language", "language"), js("stargazers_count", "stars", False),
        js("created_at", "created_at"), js("pushed_at", "pushed_at")])
    return f"""
    SELECT capture_id, rule, query_ord, item_ord,
           '{{' || {fields}
             || CASE WHEN item_ord % 7 = 0 THEN '' ELSE ',"forks_count":' || CAST(forks AS STRING) END
             || CASE WHEN owner IS NULL OR item_ord % 11 = 0 THEN '' ELSE ',"owner":{{"login":"' || owner || '","id":1}}' END
             || CASE WHEN license IS NULL THEN ',"license":null' ELSE ',"license":{{"key":"k","spdx_id":"' || license || '"}}' END
             || CASE WHEN item_ord % 3 = 0 THEN '' ELSE ',"topics":["t' || CAST(item_ord % 4 AS STRING) || '","cli"]' END
             || '}}' AS item
    FROM ({repo_hits(d)}) h"""


def attempts(d):
    """One row per (capture, rule) tried; some rules failed and returned nothing."""
    return f"""
    SELECT capture_id, rule AS query,
           CASE WHEN failed THEN 'timeout while asking the search service for ' || rule END AS error
    FROM (SELECT capture_id, rule, (min(item_ord) + count(*)) % 5 = 0 OR substr(capture_id, 6) = 'q9' AS failed
          FROM ({repo_hits(d)}) h GROUP BY capture_id, rule) g"""


def carried_identity(d):
    """Repository names with carried ids, some broken on purpose."""
    return f"""
    SELECT ord, CASE ord % 12 WHEN 1 THEN upper(repo) WHEN 2 THEN repo || ' ' WHEN 3 THEN '-' || repo
                     WHEN 4 THEN replace(repo, '/', '--') WHEN 5 THEN owner || '/..'
                     WHEN 6 THEN replace(repo, '-', '.') WHEN 7 THEN NULL ELSE repo END AS repository,
           CASE ord % 10 WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 1 END AS project_id_version,
           CASE ord % 9 WHEN 1 THEN 'Bad Id' WHEN 2 THEN NULL
                WHEN 3 THEN 'other--0123456789abcdef0123'
                ELSE rtrim_prefix || '--' || digest END AS project_id
    FROM (SELECT p_partkey AS ord, 'owner' || CAST(p_size AS STRING) AS owner, {_repo_name()} AS repo,
                 replace(replace(lower({_repo_name()}), '/', '-'), '.', '-') AS rtrim_prefix,
                 substr({'sha2(lower(' + _repo_name() + '), 256)' if not isinstance(d, DuckSql) else 'sha256(lower(' + _repo_name() + '))'}, 1, 20) AS digest
          FROM {d.t('part')}) x"""


def identity_names(d):
    """Repository sets per supplier-like group, with case variants and separator variants."""
    return f"""
    SELECT capture_id, CASE WHEN ord % 50 = 7 THEN upper(repo) ELSE repo END AS repository
    FROM ({repo_facts(d)}) f
    UNION ALL
    SELECT capture_id, CASE WHEN ord % 3 = 0 THEN repo ELSE replace(repo, '-', '.') END AS repository
    FROM ({repo_facts(d)}) f WHERE ord % 101 = 5"""


FILE_PATHS = [
    "README.md", "src/app/main.py", "src/app/util.js", "tests/test_main.py", "LICENSE",
    ".github/workflows/ci.yml", "docs/guide.md", "examples/demo.py", "node_modules/lib/index.js",
    "package.json", "src/core.test.ts", "Dockerfile", "go.sum", ".env.example", "img/logo.png",
    "src/Build/out.js", "Makefile", "src/app.py", "spec/shape_spec.rb", "COPYING.txt",
]


def files(d):
    """File inventory from the document table: repository = source, path by id."""
    n = len(FILE_PATHS)
    whens = []
    for i, path in enumerate(FILE_PATHS):
        head, dot, tail = path.rpartition("/")
        base, ext_dot, ext = tail.rpartition(".")
        if path in ("README.md", "LICENSE", "COPYING.txt"):
            whens.append(f"WHEN {i} THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'pkg/' END || '{path}-' || CAST(doc_id AS STRING)")
        elif path in ("package.json", "Dockerfile", "go.sum", ".env.example"):
            whens.append(f"WHEN {i} THEN 'pkg' || CAST(doc_id AS STRING) || '/{path}'")
        else:
            stem = (head + "/" if head else "")
            name = f"{base}.{ext}" if ext_dot and base else tail
            whens.append(f"WHEN {i} THEN '{stem}d' || CAST(doc_id % 5 AS STRING) || '/' || CAST(doc_id AS STRING) || '_{name}'"
                         if i % 2 else f"WHEN {i} THEN '{stem}' || CAST(doc_id AS STRING) || '/{name}'")
    return f"""
    SELECT 'org/' || source AS repo,
           CASE ({d.idiv('doc_id', 20)} * 7 + doc_id) % {n} {' '.join(whens)} END AS path,
           CASE WHEN doc_id % 47 = 0 THEN 600000 ELSE n_chars END AS size_bytes,
           CASE WHEN doc_id % 6 = 0 THEN text || ' // TODO tidy, fixme: TODOS xxx'
                WHEN doc_id % 11 = 0 THEN '{{"license":"' || text || ' MIT License"}}' ELSE text END AS text,
           doc_id % 43 = 0 AS is_symlink
    FROM {d.t('documents')}"""


SIGNAL_BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
_SIGNAL_TERMS = ["agent model release", "customer case study", "how teams use GPT", "open source API update",
                 "weekly notes", "developer changelog now available", "with AI"]


def signals_raw(d):
    """Accepted-shape signals before the window filter, in arrival order per run."""
    terms = " ".join(f"WHEN {i} THEN ' {t}'" for i, t in enumerate(_SIGNAL_TERMS))
    title = f"{d.clean('regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}"
    base = f"""
      SELECT page_id, url, {title} || CASE page_id % 8 {terms} ELSE '' END AS title,
             'r' || CAST({d.idiv('page_id', 100)} AS STRING) AS run_id,
             {SIGNAL_BASE_US} + ({d.idiv('page_id', 100)} + 1) * 100 * 20 * 60000000 AS now_us,
             {SIGNAL_BASE_US} + page_id * 20 * 60000000 AS published_us
      FROM {d.t('pages')}"""
    kind = "CASE page_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'aggregated' WHEN 2 THEN 'ranking' ELSE 'curated' END"
    kind2 = "CASE page_id % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'curated' ELSE 'aggregated' END"
    return f"""
    SELECT run_id, now_us, {d.iso('now_us')} AS now_at, 48 AS window_hours, ord, kind, title, url,
           'src_' || kind || '_' || CAST(page_id % 3 AS STRING) AS source,
           'https://feeds.example.org/' || kind AS source_url,
           published_us, CASE WHEN page_id % 61 = 0 THEN NULL ELSE {d.iso('published_us')} END AS published_at,
           CAST(page_id % 13 + 1 AS INT) AS rank,
           CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NaN' WHEN 3 THEN 'high' WHEN 4 THEN '42'
                WHEN 5 THEN '-42' WHEN 6 THEN 'true' ELSE '0.' || CAST(page_id % 97 AS STRING) END AS importance,
           CASE WHEN kind = 'ranking' THEN 'owner/' || CAST(page_id AS STRING) END AS repo,
           CASE WHEN kind = 'ranking' THEN CAST(page_id % 500 AS BIGINT) END AS reported_daily_growth,
           {d.arr("'ev_' || kind", "'ev_' || CAST(page_id % 4 AS STRING)")} AS evidence,
           {d.arr("'src_' || kind || '_' || CAST(page_id % 3 AS STRING)", "'wire_' || CAST(page_id % 6 AS STRING)")} AS sources
    FROM (
      SELECT page_id, run_id, now_us, CASE WHEN page_id % 41 = 0 THEN '' ELSE title END AS title,
             CASE WHEN page_id % 53 = 0 THEN 'javascript:alert(1)' ELSE url END AS url,
             {kind} AS kind,
             CASE WHEN page_id % 37 = 0 THEN now_us + 3 * {HOUR} WHEN page_id % 43 = 0 THEN now_us - 49 * {HOUR}
                  ELSE published_us END AS published_us, page_id * 2 AS ord
      FROM ({base}) b
      UNION ALL
      SELECT page_id, run_id, now_us, title || ' again' AS title,
             CASE WHEN url LIKE '%#%' THEN replace(url, '#', '/#') WHEN url LIKE '%?%' THEN url || '&utm_campaign=x'
                  ELSE url || '?utm_source=mail' END AS url,
             {kind2} AS kind, published_us + 60000000 AS published_us, page_id * 2 + 1 AS ord
      FROM ({base}) b WHERE page_id % 3 = 0) a"""


def source_attempts(d):
    """Source inventory per run with fetch errors for some."""
    return f"""
    SELECT run_id, source, source_url, CASE WHEN mod_key % 7 = 3 THEN 'connection refused by ' || source END AS error
    FROM (SELECT run_id, source, min(source_url) AS source_url, min(ord) AS mod_key
          FROM ({signals_raw(d)}) s GROUP BY run_id, source) g
    UNION ALL
    SELECT DISTINCT run_id, 'src_silent', 'https://feeds.example.org/silent', CAST(NULL AS STRING)
    FROM ({signals_raw(d)}) s"""


def raw_payloads(d):
    """Raw bodies assembled from the page rows, one per (run, source)."""
    base = f"({signals_raw(d)}) s"
    rss = ("'<item><title>' || title || '</title><link>' || replace(url, '&', '&amp;') || '</link><pubDate>Mon, ' || "
           f"{d.rfc822('published_us')} || ' GMT</pubDate></item>'")
    brief = ("'{\"title\":\"' || title || '\",\"primary_url\":\"' || CASE WHEN ord % 3 = 0 THEN '' ELSE url END || "
             "'\",\"url\":\"' || url || '\",\"latest_at\":' || coalesce('\"' || published_at || '\"', 'null') || "
             f"',\"earliest_at\":\"' || {d.iso('published_us')} || '\",\"importance\":' || "
             "CASE WHEN importance IS NULL THEN 'null' WHEN importance LIKE '0.%' OR importance LIKE '%42' OR importance = 'true' "
             "THEN importance ELSE '\"' || importance || '\"' END || '}'")
    row = ("'| ' || CAST(rank AS STRING) || ' | [' || coalesce(repo, 'x/y') || '](https://github.com/' || coalesce(repo, 'x/y') || "
           "')| ' || CAST(ord AS STRING) || ' | +' || CAST(reported_daily_growth AS STRING) || ' |'")
    return f"""
    SELECT run_id, source, now_at AS fetched_at, 48 AS window_hours, 'feed' AS format,
           CASE WHEN min(ord) % 5 = 4 THEN '<rss><channel><item><title>broken'
                ELSE '<rss><channel>' || {d.join_seq(rss, '', 'ord')} || '</channel></rss>' END AS body
    FROM {base} WHERE kind = 'official' GROUP BY run_id, source, now_at
    UNION ALL
    SELECT run_id, source, now_at, 48, 'brief',
           CASE WHEN min(ord) % 5 = 4 THEN '{{"items": [' ELSE '{{"items":[' || {d.join_seq(brief, ',', 'ord')} || ']}}' END
    FROM {base} WHERE kind = 'aggregated' GROUP BY run_id, source, now_at
    UNION ALL
    SELECT run_id, source, now_at, 48, 'rank_table',
           CASE WHEN min(ord) % 5 = 4 THEN '' ELSE '## ' || {d.day('max(now_us)', 'yyyy.MM.dd')} || ' '  END
             || {d.join_seq(row, ' ', 'ord')}
    FROM {base} WHERE kind = 'ranking' GROUP BY run_id, source, now_at
    UNION ALL
    SELECT run_id, source, now_at, 48, 'release',
           '{{"tag_name":"v' || CAST(min(ord) AS STRING) || '","html_url":"' || CASE WHEN min(ord) % 4 = 2 THEN '' ELSE min(source_url) END
             || '","published_at":"' || {d.iso('max(published_us)')} || '"}}'
    FROM {base} WHERE kind = 'curated' GROUP BY run_id, source, now_at"""


def signal_enrichment(d):
    """Reviewed texts for some signal URLs, some stale or incomplete."""
    return f"""
    SELECT run_id, url, CASE WHEN k % 9 = 0 THEN '' ELSE 'Title ' || CAST(k AS STRING) END AS title,
           'Takeaway ' || CAST(k AS STRING) AS takeaway, CASE WHEN k % 11 = 0 THEN NULL ELSE 'Why ' || CAST(k AS STRING) END AS why,
           'topic' || CAST(k % 4 AS STRING) AS category,
           CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN {d.iso(f'p - {HOUR}')} ELSE {d.iso(f'p + {HOUR}')} END AS analyzed_at,
           CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN {d.iso('p + 1000000')} ELSE {d.iso('p')} END AS source_published_at,
           set_generated_at
    FROM (SELECT run_id, url, min(ord) AS k, min(published_us) AS p, {d.iso('max(now_us)')} AS set_generated_at
          FROM ({signals_raw(d)}) s WHERE ord % 7 <> 0 GROUP BY run_id, url) g"""


def _latest_repo(d):
    """The last facts of each repository; they are the last of their part as well, so earlier ones need not be built."""
    return f"""SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY repo ORDER BY captured_us DESC) AS rn
               FROM ({repo_facts(d, d.latest)}) f) r WHERE rn = 1"""


_IND = ["readme", "license", "tests", "ci", "docker", "dependency_lock", "package_manifest", "examples", "docs",
        "environment_example"]


def static_evidence(d):
    """Evidence rows by repository: versions, times and carried ids vary by modulo."""
    inds = ", ".join(f"(ord * {i + 3} + {i}) % {i % 3 + 2} <> 0 AS ind_{name}" for i, name in enumerate(_IND))
    sha = "sha256({})" if isinstance(d, DuckSql) else "sha2({}, 256)"
    return f"""
    SELECT CASE WHEN ord % 10 = 0 THEN 0 WHEN ord % 10 <= 2 THEN 1 ELSE 2 END AS schema_version,
           CASE WHEN ord % 10 > 2 THEN 1 END AS project_id_version,
           CASE WHEN ord % 10 > 2 THEN replace(lower(repo), '/', '-') || '--' || substr({sha.format('lower(repo)')}, 1, 20) END AS project_id,
           CASE WHEN ord % 14 = 3 THEN upper(repo) ELSE repo END AS repository,
           'https://git.example.org/' || repo AS source,
           CASE WHEN ord % 33 = 0 THEN 'not a time'
                WHEN ord % 7 = 0 THEN {d.iso(f'push_us - {DAY}')} WHEN ord % 7 = 1 THEN {d.iso('push_us')}
                ELSE {d.iso(f'push_us + {DAY}')} END AS analyzed_at,
           CAST(ord % 9000 + 3 AS BIGINT) AS scanned_files, {inds},
           CAST(ord % 17 AS BIGINT) AS test_files, CAST(ord % 5 AS BIGINT) AS todo_markers,
           CASE ord % 6 WHEN 0 THEN NULL WHEN 1 THEN 'license file present' ELSE 'MIT' END AS license_hint,
           CAST(40 + ord % 56 AS INT) AS confidence, ord
    FROM (SELECT l.*, coalesce(unix_push, captured_us) AS push_us
          FROM (SELECT r.*, captured_us - (ord % 20) * {DAY} AS unix_push FROM ({_latest_repo(d)}) r) l) x
    WHERE ord % 3 <> 0"""


def project_enrichment(d):
    sha = "sha256({})" if isinstance(d, DuckSql) else "sha2({}, 256)"
    return f"""
    SELECT CASE WHEN ord % 10 = 0 THEN 0 WHEN ord % 10 <= 2 THEN 1 ELSE 2 END AS schema_version,
           CASE WHEN ord % 10 > 2 THEN 1 END AS project_id_version,
           CASE WHEN ord % 10 > 2 THEN replace(lower(repo), '/', '-') || '--' || substr({sha.format('lower(repo)')}, 1, 20) END AS project_id,
           repo AS repository,
           CASE WHEN ord % 8 = 0 THEN {d.iso('captured_us')} ELSE pushed_at END AS source_pushed_at,
           CASE WHEN ord % 11 = 0 THEN {d.iso('captured_us')}
                WHEN ord % 7 = 0 THEN {d.iso(f'push_us - {DAY}')} WHEN ord % 7 = 1 THEN {d.iso('push_us')}
                ELSE {d.iso(f'push_us + {DAY}')} END AS source_analysis_at,
           CASE WHEN ord % 9 = 0 THEN {d.iso(f'push_us - 2 * {DAY}')} ELSE {d.iso(f'push_us + 2 * {DAY}')} END AS analyzed_at,
           'Title ' || repo AS title, CASE WHEN ord % 12 = 0 THEN '' ELSE 'Summary ' || CAST(ord AS STRING) END AS summary,
           CASE WHEN ord % 2 = 0 THEN 'ai_agent' ELSE 'productivity' END AS category,
           {d.arr("'cap a'", "'cap ' || CAST(ord % 7 AS STRING)", "'cap b'")} AS capabilities,
           {d.arr("'task ' || CAST(ord % 5 AS STRING)", "'agent'")} AS task_terms,
           'Teams ' || CAST(ord % 3 AS STRING) AS best_for, 'Plan' AS reuse_plan,
           CASE WHEN ord % 4 = 0 THEN '' ELSE 'Limit ' || CAST(ord % 4 AS STRING) END AS limitation,
           'Summary of evidence' AS evidence_summary, 'https://git.example.org/' || repo AS source_url, ord
    FROM (SELECT r.*, captured_us - (ord % 20) * {DAY} AS push_us FROM ({_latest_repo(d)}) r) x
    WHERE ord % 5 <> 0"""


def legacy_catalog(d):
    """Catalog rows of several schema versions, with integer scores."""
    return f"""
    SELECT capture_id, repo, CAST(ord % 5 AS INT) AS schema_version,
           CASE WHEN ord % 7 = 1 THEN 2 WHEN ord % 7 = 2 THEN NULL ELSE 1 END AS project_id_version,
           CASE WHEN ord % 11 = 3 THEN '' ELSE lower(repo) END AS project_id,
           CASE WHEN ord % 13 = 4 THEN NULL ELSE CAST((ord * 7 + stars) % 120 AS INT) END AS global_score,
           CAST((ord * 3 + stars) % 103 AS INT) AS attention_score, CAST(stars % 101 AS INT) AS endurance_score,
           CASE WHEN ord % 4 <> 0 THEN CAST((ord + forks) % 101 AS INT) END AS readiness_score,
           CAST(forks % 101 AS INT) AS completeness_score,
           CASE ord % 5 WHEN 0 THEN 'trial' WHEN 1 THEN 'reuse' WHEN 2 THEN 'save' ELSE 'watch' END AS recommendation
    FROM ({repo_facts(d)}) f"""


def artifact_copies(d):
    """Evidence rows plus extra copies of some repositories at other or equal versions."""
    cols = "schema_version, project_id_version, project_id, repository, analyzed_at, ord"
    return f"""
    SELECT {cols} FROM ({static_evidence(d)}) e
    UNION ALL
    SELECT schema_version - 1, project_id_version, project_id, upper(repository), analyzed_at, ord
    FROM ({static_evidence(d)}) e WHERE ord % 4 = 1 AND schema_version > 0
    UNION ALL
    SELECT schema_version, project_id_version, project_id, repository, analyzed_at, ord
    FROM ({static_evidence(d)}) e WHERE ord % 25 = 1
    UNION ALL
    SELECT 1, NULL, NULL, replace(repository, '-', '.'), analyzed_at, ord
    FROM ({static_evidence(d)}) e WHERE ord % 31 = 1"""


def staging(d):
    """Staged evidence: missing, newer, older, equal and unversioned rows against the current ones."""
    return f"""
    SELECT 'analysis' AS kind, lower(repository) AS key, repository,
           CASE WHEN ord % 6 = 0 THEN 0 WHEN ord % 6 = 1 THEN NULL ELSE 2 END AS schema_version,
           CASE ord % 5 WHEN 0 THEN analyzed_at WHEN 1 THEN '2030-01-01T00:00:00Z' WHEN 2 THEN '1990-01-01T00:00:00Z'
                WHEN 3 THEN '2030-01-01T00:00:00' ELSE '2031-06-01T12:00:00Z' END AS stamp,
           'staged ' || CAST(ord AS STRING) AS payload
    FROM ({static_evidence(d)}) e WHERE ord % 2 = 0
    UNION ALL
    SELECT 'enrichment', lower(repository), CASE WHEN ord % 8 = 3 THEN 'other/' || CAST(ord AS STRING) ELSE repository END, schema_version,
           CASE WHEN ord % 3 = 0 THEN '2030-01-01T00:00:00Z' WHEN ord % 3 = 1 THEN analyzed_at ELSE NULL END,
           'staged profile ' || CAST(ord AS STRING)
    FROM ({project_enrichment(d)}) p WHERE ord % 4 <> 1"""


def current_artifacts(d):
    return f"""
    SELECT 'analysis' AS kind, lower(repository) AS key, repository, schema_version, analyzed_at AS stamp,
           'current ' || CAST(ord AS STRING) AS payload FROM ({static_evidence(d)}) e WHERE ord % 10 <> 4
    UNION ALL
    SELECT 'enrichment', lower(repository), repository, schema_version, analyzed_at, 'current profile ' || CAST(ord AS STRING)
    FROM ({project_enrichment(d)}) p WHERE ord % 10 <> 6"""


_ACTION_BY_TYPE = {"view": "opened", "click": "saved", "signup": "tried", "error": "cloned", "purchase": "reused"}
_FEEDBACK_BY_TYPE = {"view": "useful", "click": "unsure", "error": "useless", "purchase": "reuse"}


def action_events(d):
    k = d.json_int("props", "k")
    return f"""
    SELECT event_id AS id, 'd' || CAST(user_id AS STRING) AS device_id, 'p' || CAST(k AS STRING) AS project_slug,
           {_case('event_type', _ACTION_BY_TYPE)} AS action, at_us, {d.ts('at_us')} AS occurred_at,
           'd' || CAST(user_id AS STRING) || ':p' || CAST(k AS STRING) || ':'
             || CAST({d.idiv('at_us', 3 * DAY)} AS STRING) || ':key' AS idempotency_key
    FROM (SELECT event_id, user_id, event_type, {k} AS k, {d.us('ts')} AS at_us FROM {d.t('events')}) e"""


def action_requests(d):
    """Submitted actions, some invalid."""
    return f"""
    SELECT id, CASE WHEN id % 71 = 0 THEN '' WHEN id % 73 = 0 THEN repeat('x', 201) ELSE device_id END AS device_id,
           CASE WHEN id % 67 = 0 THEN 'unknown' ELSE project_slug END AS project_slug,
           CASE WHEN id % 61 = 0 THEN 'starred' ELSE action END AS action,
           CASE WHEN id % 59 = 0 THEN 'short' WHEN id % 53 = 0 THEN 'legacy-project-actions:' || CAST(id AS STRING)
                WHEN id % 47 = 0 THEN '-' || idempotency_key ELSE idempotency_key END AS idempotency_key,
           id % 43 = 0 AS has_client_time, at_us
    FROM ({action_events(d)}) a"""


def known_projects(d):
    """Project slugs of the published catalog, with catalog positions."""
    return f"""
    SELECT 'p' || CAST(k AS STRING) AS project_slug, CAST(k + 1 AS INT) AS position
    FROM (SELECT DISTINCT {d.json_int('props', 'k')} AS k FROM {d.t('events')}) e WHERE k % 10 <> 9"""


def legacy_actions(d):
    return f"""
    SELECT id, device_id, project_slug, action, at_us, {d.ts('at_us')} AS created_at
    FROM (SELECT id, device_id, project_slug, action,
                 at_us + CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN 2 THEN 2000 ELSE {HOUR} END AS at_us
          FROM ({action_events(d)}) a WHERE id % 3 = 0) l"""


def feedback_changes(d):
    return f"""
    SELECT event_id AS id, 'd' || CAST(user_id AS STRING) AS device_id,
           'p' || CAST({d.json_int('props', 'k')} % 12 AS STRING) AS project_slug,
           {_case('event_type', _FEEDBACK_BY_TYPE)} AS value, {d.us('ts')} AS at_us
    FROM {d.t('events')} WHERE event_type <> 'signup'"""


def _served_by(n):
    """Capture that the n-th reader is served: one of the 28 quarters that the lines were shipped in."""
    return f"'c' || CAST(1995 + CAST(floor({n} / 4.0) AS BIGINT) % 7 AS STRING) || 'q' || CAST({n} % 4 + 1 AS STRING)"


def served_catalog(d):
    """The published catalog, of 100 projects, of each capture."""
    return f"""
    SELECT capture_id AS generation_id, position, 'p' || CAST(position - 1 AS STRING) AS project_slug, repo,
           'Title ' || CAST(ord % 9 AS STRING) AS title, coalesce(description, 'no description') AS description,
           CASE ord % 4 WHEN 0 THEN 'ai_agent' WHEN 1 THEN 'research' WHEN 2 THEN 'devtools' ELSE 'video' END AS category,
           {d.arr("'ai agent'", "' Topic ' || CAST(ord % 6 AS STRING)", "coalesce(language, 'x')")} AS capabilities,
           {d.arr("'Task  ' || CAST(ord % 8 AS STRING)", "'agent'", "'topic ' || CAST(ord % 6 AS STRING)", "'office excel ' || CAST(ord % 3 AS STRING)")} AS task_terms,
           CASE WHEN ord % 3 = 0 THEN 'long_term' ELSE 'recent_momentum' END AS heat_track,
           CASE WHEN ord % 3 = 0 THEN 'long_term_proxy' ELSE 'rising' END AS heat_label,
           CASE ord % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'static' ELSE 'facts_only' END AS analysis_state,
           CAST(100 - position + ord % 7 AS INT) AS attention,
           CASE WHEN ord % 4 < 2 THEN CAST((ord * 13) % 101 AS INT) END AS readiness,
           'Placed in ' || CAST(ord % 5 AS STRING) AS fit_hypothesis, 'Read the docs-first/then try' AS reuse_plan
    FROM (SELECT f.*, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY stars DESC, ord) AS INT) AS position
          FROM ({repo_facts(d)}) f) r WHERE position <= 100"""


def served_feedback(d):
    """Feedback of devices against the served catalogs; some values and projects are unknown, and some devices never say anything known."""
    return f"""
    SELECT event_id AS id, 'd' || CAST(user_id AS STRING) AS device_id, {_served_by('user_id')} AS generation_id,
           'p' || CAST({d.json_int('props', 'k')} + 3 AS STRING) AS project_slug,
           CASE WHEN user_id % 10 = 0 THEN 'seen' ELSE {_case('event_type', {**_FEEDBACK_BY_TYPE, 'signup': 'liked'})} END AS value, {d.us('ts')} AS at_us
    FROM {d.t('events')}"""


def devices(d):
    return f"""
    SELECT DISTINCT 'd' || CAST(user_id AS STRING) AS device_id, {_served_by('user_id')} AS generation_id
    FROM {d.t('events')}"""


def search_queries(d):
    words = ["agent", "research 研究", "excel", "github", "workflow 自动", "oauth", "video 视频", ""]
    case = " ".join(f"WHEN {i} THEN ' {w}'" for i, w in enumerate(words) if w)
    return f"""
    SELECT 'q' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS query_id,
           {_served_by('conv_id')} AS generation_id,
           {d.clean('text')} || CASE conv_id % 8 {case} ELSE '' END AS text
    FROM {d.t('conversations')} WHERE role = 'user'"""


def generation_log(d):
    """Publication attempts per dataset and quarter of orders; a few are built on the wrong base."""
    q = "year(o_orderdate) * 4 + quarter(o_orderdate) - 1"
    gid = "dataset || ':' || CAST({} AS STRING)".format
    return f"""
    SELECT dataset, {gid('qno')} AS generation_id,
           CASE WHEN wrong_base THEN 'none' ELSE {gid('max(CASE WHEN ok THEN qno END) OVER (PARTITION BY dataset ORDER BY qno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} END AS base_generation_id,
           state, error_count, CAST(n_all % 3 AS BIGINT) AS warning_count, created_us, published_us
    FROM (SELECT g.*, state = 'ready' AND error_count = 0 AND NOT wrong_base AND NOT early AS ok,
                 created_us + CASE WHEN early THEN -2000 ELSE 1 END * {DAY} AS published_us
          FROM (SELECT substr(o_orderpriority, 1, 1) AS dataset, {q} AS qno, count(*) AS n_all,
                       CASE WHEN {d.count_if("o_orderstatus = 'P'")} % 6 = 1 THEN 'building' ELSE 'ready' END AS state,
                       CAST(CASE WHEN {d.count_if("o_orderstatus = 'F'")} % 7 = 2 THEN 2 ELSE 0 END AS BIGINT) AS error_count,
                       count(*) % 9 = 5 AS wrong_base, count(*) % 13 = 6 AS early, {d.us('max(o_orderdate)')} AS created_us
                FROM {d.t('orders')} GROUP BY substr(o_orderpriority, 1, 1), {q}) g) x"""


def generation_rows(d):
    """Rows of each generation's artifacts: table name by order priority."""
    q = "year(o_orderdate) * 4 + quarter(o_orderdate) - 1"
    return f"""
    SELECT 'g' || CAST({q} AS STRING) AS generation_id,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'snapshot' WHEN '2' THEN 'catalog' WHEN '3' THEN 'signals'
                WHEN '4' THEN 'queue' ELSE 'history' END AS artifact,
           CAST(o_orderkey AS STRING) AS row_key, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
    FROM {d.t('orders')} WHERE NOT (substr(o_orderpriority, 1, 1) = '4' AND ({q}) % 8 = 3)"""


LOGICAL = {f.__name__: f for f in [
    captures, repo_facts, repo_snapshot, repo_hits, raw_items, attempts, carried_identity, identity_names, files,
    signals_raw, source_attempts, raw_payloads, signal_enrichment, static_evidence, project_enrichment,
    legacy_catalog, artifact_copies, staging, current_artifacts, action_events, action_requests, known_projects, legacy_actions, feedback_changes, served_catalog, served_feedback, devices, search_queries,
    generation_log, generation_rows]}


def bind(spark: SparkSession, sf_dir: str, name: str, store=None) -> DataFrame:
    return spark.sql(LOGICAL[name](SparkSql(sf_dir, task_count(spark), store)))


def duck(name: str) -> str:
    return LOGICAL[name](DuckSql())
