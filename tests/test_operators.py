"""Scenario tests of the jobs, with brute-force checks of the skew helpers."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from beaconry.operators import actions as A
from beaconry.operators import audit
from beaconry.operators import catalog as C
from beaconry.operators import evidence as E
from beaconry.operators import identity as I
from beaconry.operators import signals as S
from beaconry.operators import skew
from beaconry.operators import versions as V

DAY = 86_400_000_000


def rows(spark, n=400):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}", rnd.randrange(50), i) for i in range(n)]
    return spark.createDataFrame(data, "k string, v int, i int")


def test_top_k_equals_plain_window(spark):
    df = rows(spark)
    got = skew.top_k(df, ["k"], [F.desc("v"), F.asc("i")], 5, ["i"], salts=7)
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    want = df.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")
    assert sorted(got.collect()) == sorted(want.collect())


def test_exact_position_and_previous_value(spark):
    df = rows(spark)
    got = skew.exact_position(df, ["k"], [F.desc("v"), F.asc("i")], [F.floor(F.col("v") / 10)], [F.desc("_b0")])
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    assert sorted(got.select("k", "v", "i", "position").collect()) == sorted(df.withColumn("position", F.row_number().over(w)).collect())
    lagged = skew.previous_value(df, ["k"], F.floor(F.col("i") / 30), ["i"], "v").select("k", "v", "i", "previous")
    want = df.withColumn("previous", F.lag("v").over(Window.partitionBy("k").orderBy("i")))
    assert sorted(map(str, lagged.collect())) == sorted(map(str, want.collect()))


def test_identity_vectors(spark):
    data = [("owner/repo",), ("Owner/Repo",), ("a" * 40 + "/x",), ("-a/x",), ("a--b/x",), ("a/..",), ("a/x ",), ("a/b/c",), (None,)]
    got = I.project_identity(spark.createDataFrame(data, "repository string")).collect()
    assert got[0]["project_id"].startswith("owner-repo--") and len(got[0]["project_id"]) == len("owner-repo--") + 20
    assert got[0]["project_id"] == got[1]["project_id"]
    assert [r["error"] for r in got[2:8]] == ["invalid_repository_format"] * 6
    assert got[8]["error"] == "invalid_repository_type"


def scored(spark, specs):
    cols = "capture_id string, repo string, canonical string, attention int, readiness int, stars long, endurance int, heat_track string, recommendation string, ord long"
    return spark.createDataFrame([("c", r, r, a, rd, s, e, t, rec, i) for i, (r, a, rd, s, e, t, rec) in enumerate(specs)], cols)


def test_daily_five_balances_tracks(spark):
    specs = [(f"fast{i}", 90 - i, None, 100, 10, "recent_momentum", "learn") for i in range(5)]
    specs += [("big1", 70, None, 120_000, 90, "long_term", "learn"), ("big2", 69, None, 80_000, 80, "long_term", "learn"),
              ("big3", 95, None, 1, 70, "long_term", "watch")]
    got = C.balanced_order(scored(spark, specs), 30).orderBy("position").collect()
    first = [r["repo"] for r in got[:5]]
    assert first == ["fast0", "fast1", "fast2", "big1", "big2"]
    assert [r["repo"] for r in got[5:]] == ["big3", "fast3", "fast4"]
    assert [r["position"] for r in got] == list(range(1, 9))


def plain_order(rows, keep):
    """Positions by sorting all rows in Python."""
    base = sorted(rows, key=lambda r: (-r["attention"], -(-1 if r["readiness"] is None else r["readiness"]), -r["stars"], r["ord"]))
    fit = [r for r in base if r["heat_track"] == "long_term" and r["attention"] >= 60 and r["recommendation"] != "watch"]
    picked = {r["ord"] for r in sorted(fit, key=lambda r: -r["endurance"])[:2]} | {r["ord"] for r in base if r["heat_track"] == "recent_momentum"}.intersection(
        [r["ord"] for r in [x for x in base if x["heat_track"] == "recent_momentum"][:3]])
    free = [r["ord"] for r in base if r["ord"] not in picked][:max(0, 5 - len(picked))]
    daily = picked | set(free)
    order = [r["ord"] for r in base if r["ord"] in daily] + [r["ord"] for r in base if r["ord"] not in daily]
    return [(o, o in daily) for o in order[:keep]]


@pytest.mark.parametrize("keep", [1, 2, 5, 12, 500])
def test_balanced_order_equals_sorting_all_rows(spark, keep):
    rng = random.Random(keep)
    specs = [(f"p{i}", rng.choice([40, 60, 61, 80]), rng.choice([None, 10, 20]), rng.choice([5, 6]), rng.choice([1, 2]),
              rng.choice(["long_term", "recent_momentum", None]), rng.choice(["learn", "watch"])) for i in range(300)]
    rows = scored(spark, specs)
    got = C.balanced_order(rows, keep).orderBy("position").collect()
    assert [(r["ord"], r["daily"]) for r in got] == plain_order(rows.collect(), keep)
    assert C.balanced_order(rows.limit(0), keep).collect() == []


def test_tokens_take_their_rarest_piece(spark):
    from beaconry.operators.search import token_index
    texts = ["alpha beta gamma", "alphabet soup", "a b", "", "xxalp habet", "日本語 text"]
    hay = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "generation_id string, position int, haystack string")
    words = ["alpha", "alphabet", "beta", "b", "soup", "habeta", "日本", "te", "zz", "alp hab", "a b"]
    tokens = spark.createDataFrame([("g", w) for w in words + words] + [("h", "alpha")], "generation_id string, token string")
    got = {(r.generation_id, r.token, r.position) for r in token_index(tokens, hay).collect()}
    assert got == {("g", w, k) for w in words for k, t in enumerate(texts) if w in t}


def snapshot(spark, captures):
    data = [(f"c{n}", f"2024-01-{n:02d}T00:00:00Z", repo, stars, "2020-01-01T00:00:00Z", i)
            for n, repos in captures.items() for i, (repo, stars) in enumerate(repos.items())]
    df = spark.createDataFrame(data, "capture_id string, captured_at string, repo string, stars long, created_at string, ord long")
    df = df.withColumn("pushed_at", F.col("captured_at"))
    return df, df.select("capture_id", "captured_at").distinct()


def test_growth_kinds_and_gaps(spark):
    snap, caps = snapshot(spark, {1: {"o/a": 700, "o/b": 900}, 2: {"o/a": 900}, 3: {"o/a": 880, "o/b": 950}})
    got = {(r["capture_id"], r["repo"]): r for r in C.with_growth(snap, caps).collect()}
    assert got["c1", "o/a"]["growth_kind"] == "velocity_proxy"
    assert (got["c2", "o/a"]["growth_kind"], got["c2", "o/a"]["growth_value"]) == ("observed", 200)
    assert got["c3", "o/a"]["growth_value"] == -20 and got["c3", "o/a"]["ranking_value"] == 0
    assert got["c3", "o/b"]["growth_kind"] == "velocity_proxy"  # missing from the capture right before
    assert (got["c3", "o/b"]["obs_count"], got["c3", "o/b"]["obs_window"]) == (2, 3)


def test_growth_leaves_out_rows_without_name_time_or_place(spark):
    snap, caps = snapshot(spark, {1: {"o/a": 700, "bad name": 100}, 2: {"o/a": 900, "O/A": 800, "other bad": 900}, 3: {"o/a": 950}})
    broken = caps.withColumn("captured_at", F.when(F.col("capture_id") == "c3", "no time").otherwise(F.col("captured_at")))
    got = {(r["capture_id"], r["repo"]): r for r in C.with_growth(snap, broken).collect()}
    assert set(got) == {("c1", "o/a"), ("c2", "o/a")}
    assert (got["c2", "o/a"]["growth_value"], got["c2", "o/a"]["obs_count"], got["c2", "o/a"]["obs_window"]) == (200, 2, 2)
    rejects = {(r["capture_id"], r["repo"], r["reject"]) for r in C.growth_rejects(snap, broken).collect()}
    assert rejects == {("c1", "bad name", "invalid_repository"), ("c2", "other bad", "invalid_repository"),
                       ("c2", "O/A", "duplicate_repository"), ("c3", "o/a", "unreadable_capture")}


def test_scan_has_every_file_in_walk_order(spark):
    paths = ["b.py", "a/z.py", "a/b/c.py", "a.py", "node_modules/x.js", "pic.PNG", "ab/q.py"]
    df = spark.createDataFrame([("r", p, 10, False) for p in paths], "repo string, path string, size_bytes long, is_symlink boolean")
    got = [r["path"] for r in E.scan_files(df).orderBy("walk_key").collect()]
    assert got == ["a.py", "b.py", "a/z.py", "a/b/c.py", "ab/q.py"]


def test_signal_merge_keeps_highest_kind(spark):
    cols = ("run_id string, ord int, kind string, title string, url string, source string, source_url string, published_at string, score double, "
            "repo string, reported_daily_growth long, sources array<string>, evidence array<string>")
    data = [("r", 1, "aggregated", "t1", "https://x/a?utm_source=m", "agg", "u", "2024-01-01T00:00:00Z", 0.91, None, None, ["wire"], ["e1"]),
            ("r", 2, "official", "t2", "https://x/a/", "off", "u", "2024-01-01T01:00:00Z", 0.8, None, None, ["off"], ["e2"])]
    (got,) = S.merge_signals(spark.createDataFrame(data, cols)).collect()
    assert (got["kind"], got["title"], got["score"], got["url"]) == ("official", "t2", 0.91, "https://x/a?utm_source=m")
    assert got["sources"] == ["off", "wire"] and got["evidence"] == ["e1", "e2"]


def test_aggregated_scores(spark):
    df = spark.createDataFrame([("NaN",), ("high",), ("42",), ("-42",), ("true",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(S.aggregated_score(F.col("v"))).collect()] == [None, None, 0.96, 0.0, None, 0.5, 0.5]


def actions_log(spark, data):
    return spark.createDataFrame(data, "id long, device_id string, project_slug string, action string, at_us long, idempotency_key string")


def test_replays_and_conflicts(spark):
    log = actions_log(spark, [(1, "d", "p", "opened", 10, "k1"), (2, "d", "p", "opened", 20, "k1"), (3, "d", "p", "saved", 30, "k1"), (4, "d", "p", "saved", 40, "k2")])
    assert {r["id"]: r["status"] for r in A.dedupe_actions(log).collect()} == {1: "recorded", 2: "replayed", 3: "conflict", 4: "recorded"}
    state = A.action_state(A.recorded_actions(log)).first()
    assert (state["highest_stage"], state["opened_us"], state["saved_us"], state["updated_us"]) == ("saved", 10, 40, 40)


def test_weekly_window_is_inclusive(spark):
    now = 100 * DAY + 5
    log = actions_log(spark, [(1, "d", "a", "tried", now - 7 * DAY, "1"), (2, "d", "b", "tried", now - 7 * DAY - 1, "2"), (3, "d", "c", "cloned", now, "3")])
    got = A.weekly_action_metrics(log, spark.createDataFrame([(now,)], "as_of_us long")).first()
    assert (got["acted_projects"], got["tried_projects"], got["cloned_projects"]) == (2, 1, 1)


def test_legacy_two_millisecond_band(spark):
    log = actions_log(spark, [(1, "d", "p", "opened", 10_000_000, "k")])
    legacy = spark.createDataFrame([(i, "d", "p", "opened", 10_000_000 + off) for i, off in enumerate((-2000, -1999, 0, 1999, 2000))],
                                   "id long, device_id string, project_slug string, action string, at_us long")
    assert sorted(r["id"] for r in A.migrate_legacy_actions(legacy, log).collect()) == [0, 4]


def test_decisions_only_on_change(spark):
    data = [(i, "d", "p", v, d * DAY) for i, (v, d) in enumerate([("useful", 1), ("useful", 1), ("useful", 5), ("reuse", 6), ("useful", 9)])]
    df = spark.createDataFrame(data, "id long, device_id string, project_slug string, value string, at_us long")
    assert sorted(r["id"] for r in A.decision_events(df).collect()) == [0, 3, 4]


def test_overlay_needs_strictly_newer_versioned_rows(spark):
    cols = "kind string, key string, repository string, schema_version int, stamp string, payload string"
    at = "2024-01-0{}T00:00:00Z".format
    cur = spark.createDataFrame([("analysis", k, k, 2, at(2), "old") for k in "abcd"], cols)
    new = spark.createDataFrame([("analysis", "a", "a", 2, at(3), "new"), ("analysis", "b", "b", 2, at(2), "new"),
                                 ("analysis", "c", "c", 0, at(5), "new"), ("analysis", "e", "e", 0, at(1), "new")], cols)
    got = {r["key"]: r["source"] for r in V.overlay_newer(cur, new).collect()}
    assert got == {"a": "staged_newer", "b": "current", "c": "current", "d": "current", "e": "staged_missing"}


def test_audit_times_clean_and_single_fault(spark):
    def codes(**change):
        row = dict(generation_id="g", snapshot_at="2024-01-01T00:00:00Z", catalog_at="2024-01-01T00:00:00Z",
                   signals_at="2024-01-01T01:00:00Z", queue_at="2024-01-01T02:00:00Z") | change
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
        return sorted(r["code"] for r in audit.audit_times(df).collect())

    assert codes() == []
    assert codes(catalog_at="2024-01-01T00:30:00Z") == ["catalog_snapshot_mismatch"]
    assert codes(queue_at="2024-01-01T00:30:00Z") == ["queue_older_than_signals"]
    assert codes(snapshot_at="soon") == ["invalid_snapshot_time"]


def test_growth_moves_rows_once(spark):
    """Both windows of the growth read one shuffle by repository; rows of a repository twice in a capture count once."""
    from beaconry.operators import catalog as C
    caps = spark.createDataFrame([("c1", "2024-01-01T00:00:00Z"), ("c2", "2024-02-01T00:00:00Z")], "capture_id string, captured_at string")
    rows = spark.createDataFrame([("c1", "a/b", 5), ("c1", "A/B", 7), ("c2", "a/b", 9), ("c2", None, 9), ("c9", "a/b", 1)], "capture_id string, repo string, stars long")
    rows = rows.selectExpr("*", "CAST(NULL AS STRING) AS created_at", "CAST(NULL AS STRING) AS pushed_at")
    grown = C.with_growth(rows, caps)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(canonical") == 1
    assert sorted((r.capture_id, r.stars, r.growth_kind, r.growth_value, r.obs_count) for r in grown.collect()) == [
        ("c1", 7, "velocity_proxy", 7, 1), ("c2", 9, "observed", 2, 2)]


def test_captures_are_read_from_storage_not_from_the_lines(spark, tmp_path):
    from beaconry.plans.common import Tables
    lines = spark.createDataFrame([("1995-01-03",), ("1995-02-03",), ("1995-07-03",)], "at string")
    lines.select(F.to_timestamp("at").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    numbered = C.number_captures(Tables(spark, str(tmp_path)).captures)
    assert sorted((r.capture_id, r.capture_no) for r in numbered.collect()) == [("c1995q1", 1), ("c1995q3", 2)]
    plan = spark._jvm.PythonSQLUtils.explainString(numbered._jdf.queryExecution(), "extended")
    assert "FileScan" not in plan.split("== Physical Plan ==")[1]


def test_score_explanations_show_every_field(spark, monkeypatch):
    from beaconry.plans import catalog_queries as Q
    from beaconry.plans import texts

    names = sorted({n for _, _, _, text in texts.EXPLANATION_LINES for n in re.findall(r"{(\w+)}", text)}
                   | {n for _, _, text in texts.SUMMARIES for n in re.findall(r"{(\w+)}", text)}
                   | {n for _, _, text, _ in texts.EVIDENCE_LINES for n in re.findall(r"{(\w+)}", text)})
    flags = ["observed", "risk", "verified", "has_analysis", "has_enrichment", "long_term"]
    told = spark.range(2).select(
        F.lit("c").alias("capture_id"), F.concat(F.lit("o/r"), F.col("id").cast("string")).alias("repo"),
        F.struct(*[F.concat(F.lit(f"<{n}"), F.col("id").cast("string"), F.lit(">")).alias(n) for n in names]).alias("t"),
        *[(F.col("id") == 1).alias(n) for n in flags], *[F.lit(7).alias(n) for n in ("attention", "endurance", "readiness", "completeness")],
        *[F.lit("u").alias(n) for n in ("api_url", "safe_link", "enr_link")])
    monkeypatch.setattr(Q, "catalog", lambda t: C.with_explanations(told))
    got = {(r["repo"], r["dimension"]): r for r in Q.QUERIES["score_explanations"](None).collect()}
    assert len(got) == 10
    for i in range(2):
        holds = {"observed": i, "not_observed": 1 - i, "risk": i, "verified": i, "not_verified": 1 - i, "has_analysis": i, "no_analysis": 1 - i,
                 "has_enrichment": i, "no_enrichment": 1 - i, "analysis_and_risk": i, None: 1}
        for dim in texts.DIMENSIONS:
            row = got[f"o/r{i}", dim]
            for kind, field in (("fact", "facts"), ("proxy", "proxies"), ("limitation", "limitations"), ("condition", "upgrade_conditions")):
                want = [re.sub(r"{(\w+)}", rf"<\g<1>{i}>", text) for d, k, cond, text in texts.EXPLANATION_LINES if (d, k) == (dim, kind) and holds[cond]]
                assert row[field] == "|".join(want)


def test_audit_references_against_brute_force(spark):
    names = ["o/a-b", "o/a.b", "O/A-B", "x/only", "bad name", "-/x", None, "p/q", "p/r"]
    snapshot = [(g, n, i % 4, q) for g in ("g1", "g2", None) for i, (n, q) in enumerate(zip(names, ["AF", "AF | ZZ", None, "", "NO | AF", "AF", "ZZ", "NO", "AF | AF"]))
                if not (g == "g2" and n == "o/a.b")] + [("g1", "p/q", 9, "ZZ | YY")]
    rules = [("g1", "AF"), ("g1", "NO"), ("g2", "AF"), ("g2", None), (None, "AF")]
    catalog = [("g1", "o/a-b", 0), ("g1", "P/Q", 7), ("g2", "none/here", 1), ("g2", "x/only", 5), ("g2", None, 1)]
    artifacts = [("g2", "o/a.b", 1, "x", 1), ("g2", "x/only", 2, "other", 2), ("g3", "p/q", 0, "x", 3), ("g3", "p-q/r", 1, "x", 4)]
    identity = spark.createDataFrame(catalog, "generation_id string, repo string, stars int")
    carried = identity.withColumns({"project_id": I.project_id(F.col("repo")), "project_id_version": F.lit(1)})
    headers = spark.createDataFrame([(g, 3, 2, 1) for g in ("g1", "g2", "g3")], "generation_id string, catalog_version int, queue_version int, queue_identity_version int")
    got = audit.audit_references(
        headers, spark.createDataFrame(snapshot, "generation_id string, repo string, stars int, candidate_query string"), carried,
        spark.createDataFrame(rules, "generation_id string, query string"),
        spark.createDataFrame(artifacts, "generation_id string, repository string, schema_version int, project_id string, ord int"))

    def canonical(n):
        return n.lower() if n and re.fullmatch(r"[A-Za-z0-9]+/[A-Za-z0-9._-]+", n) else None

    want = {}
    for g in ("g1", "g2", "g3", None):
        rows = [r for r in snapshot if r[0] == g]
        known = {q for k, q in rules if k == g and g is not None}
        want[g, "unknown_candidate_query"] = len({r[1] for r in rows if any(q not in known for q in (r[3] or "").split(" | "))})
        here = {canonical(r[1]): r for r in rows}
        mine = [r for r in catalog if r[0] == g]
        pairs = [(r, s) for r in mine for s in ([s for s in rows if canonical(r[1]) and canonical(s[1]) == canonical(r[1])] or [None])]
        want[g, "catalog_repository_missing_from_snapshot"] = int(any(canonical(r[1]) not in here or canonical(r[1]) is None for r in mine))
        want[g, "catalog_star_mismatch"] = sum(s is None or s[2] != r[2] for r, s in pairs)
        all_names = {canonical(r[1]) for r in rows} | {canonical(a[1]) for a in artifacts if a[0] == g and a[2] < 2}
        slugs = {}
        for n in all_names - {None}:
            slugs.setdefault(re.sub(r"[^a-z0-9-]+", "-", n.replace("/", "--")).strip("-"), set()).add(n)
        want[g, "unresolved_legacy_collision"] = sum(len(v) > 1 for v in slugs.values())
    got = {(r["generation_id"], r["code"]): r["n"] for r in got.collect()}
    assert {k: got.get(k, 0) for k in want} == want and want["g1", "unresolved_legacy_collision"] == 1 and want["g2", "unresolved_legacy_collision"] == 1


def test_audits_share_what_they_rank_and_count(spark, tmp_path):
    """Facts are ranked and lines counted once; no audit table reads the lines again."""
    from beaconry.plans.common import Tables

    folder, i = str(tmp_path), F.col("id")
    day = F.timestamp_seconds(F.lit(883_612_800) + i * 400_000)
    spark.range(900).select(
        (i % 40).alias("l_partkey"), (i % 90).alias("l_orderkey"), (i % 50 + 1).cast("double").alias("l_quantity"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit(None)), (i % 3 + 1).cast("int")).alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"), day.alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(40).select(i.alias("p_partkey"), F.lit("hot ring").alias("p_name"), F.lit("Brand#7").alias("p_brand"), F.lit("LARGE").alias("p_type"), (i % 9).cast("int").alias("p_size")
                           ).write.parquet(f"{folder}/part.parquet")
    spark.range(90).select(i.alias("o_orderkey"), day.alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    t = Tables(spark, folder)
    for rows in (t.audit_snapshot, t.audit_catalog, t.audit_queue, t.audit_failures, t.audit_status, t.audit_rules, t.audit_facts):
        assert rows.count() and not [f for f in rows.inputFiles() if "lineitem" in f or "part.parquet" in f]
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(
        "concat('c', year(l_shipdate), 'q', quarter(l_shipdate)) AS g", "year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS no", "l_returnflag || l_linestatus AS q")
    want = {(r["g"], r["q"]) for r in lines.collect()}
    extra = [(g, "AF") for g in {r["g"] for r in lines.filter("no % 13 = 8").collect()}]
    assert sorted(map(str, (tuple(r) for r in t.audit_rules.collect()))) == sorted(map(str, [*want, *extra])) and extra
    facts = t.audit_facts
    assert sorted(facts.collect()) == sorted(t.repo_snapshot.select(*facts.columns).collect())
