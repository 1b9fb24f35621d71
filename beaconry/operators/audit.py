"""Cross-table audit of many generations at once.

Every check reduces its tables to one row per generation (map-side combined), joins the declared header and
turns broken rules into rows: generation, severity, code, count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import MAX_HEAT_OBSERVATIONS, MIN_PERSISTENCE_WINDOW
from beaconry.functions.timefns import lenient_time
from beaconry.functions.urls import is_http_url
from beaconry.operators.identity import canonical, carried_error, legacy_slug

c = F.col
G = "generation_id"


def issues(rows: DataFrame, checks: list[tuple[str, Column]], warnings: tuple = ()) -> DataFrame:
    """Explode (code, count-or-flag) checks of one-row-per-generation frames."""
    items = [F.struct(F.lit("warning" if code in warnings else "error").alias("severity"), F.lit(code).alias("code"),
                      F.coalesce(value.cast("bigint"), F.lit(0)).alias("n")) for code, value in checks]
    return (rows.select(G, F.explode(F.array(*items)).alias("i")).select(G, "i.*").filter("n > 0"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def differs(declared: Column, actual: Column) -> Column:
    return ~declared.eqNullSafe(actual)


def per_generation(headers: DataFrame, *counts: DataFrame) -> DataFrame:
    rows = headers
    for part in counts:
        names = [x for x in part.columns if x != G]
        rows = rows.join(part, G, "left").na.fill(0, names)
    return rows


# A1
def audit_presence(generations: DataFrame, inventory: DataFrame, expected: list[str]) -> DataFrame:
    wanted = generations.select(G).withColumn("artifact", F.explode(F.array(*[F.lit(a) for a in expected])))
    rows = wanted.join(inventory, [G, "artifact"], "left")
    state = c("parse_state")
    totals = rows.groupBy(G).agg(
        F.count_if(state.isNull()).alias("missing"), F.count_if(state == "broken").alias("broken"),
        F.count_if(state == "not_object").alias("shape"), F.count_if((state == "ok") & (c("schema_errors") > 0)).alias("schema"))
    return issues(totals, [("missing_artifact", c("missing")), ("invalid_artifact", c("broken")),
                           ("invalid_artifact_shape", c("shape")), ("schema_validation_failed", c("schema"))])


# A2
SHAPE_CODES = {"snapshot": "snapshot", "catalog": "catalog", "signals": "signal", "sources": "source", "queue": "queue"}


def audit_shape(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Row containers must be lists and rows objects."""
    bad_rows = rows.filter(~F.coalesce(F.trim("row_text").startswith("{"), F.lit(False))).groupBy(G, "artifact").agg(F.count("*").alias("n"))
    code = F.create_map(*[F.lit(x) for pair in SHAPE_CODES.items() for x in pair])
    lists = documents.filter(~F.coalesce(F.trim("container_text").startswith("["), F.lit(False))).select(
        G, F.lit("error").alias("severity"), F.concat(F.lit("invalid_"), code[c("artifact")], F.lit("_rows")).alias("code"), F.lit(1).cast("bigint").alias("n"))
    objects = bad_rows.select(G, F.lit("error").alias("severity"), F.concat(F.lit("invalid_"), code[c("artifact")], F.lit("_row")).alias("code"), "n")
    return lists.unionByName(objects)


# A3
def audit_times(headers: DataFrame) -> DataFrame:
    rows = headers
    for name in ("snapshot", "catalog", "signals", "queue"):
        rows = rows.withColumn(name, lenient_time(c(f"{name}_at")))
    return issues(rows, [
        ("invalid_snapshot_time", c("snapshot").isNull()), ("invalid_catalog_time", c("catalog").isNull()),
        ("invalid_signal_time", c("signals").isNull()), ("invalid_queue_time", c("queue").isNull()),
        ("catalog_snapshot_mismatch", c("snapshot") != c("catalog")), ("signals_older_than_snapshot", c("signals") < c("snapshot")),
        ("queue_older_than_catalog", c("queue") < c("catalog")), ("queue_older_than_signals", c("queue") < c("signals"))])


# A4
COUNTS = [("snapshot_count_mismatch", "snapshot_count", "n_snapshot"), ("catalog_source_count_mismatch", "source_count", "n_snapshot"),
          ("catalog_project_count_mismatch", "project_count", "n_catalog"), ("signal_count_mismatch", "signal_count", "n_signals"),
          ("queue_count_mismatch", "pending_count", "n_queue"), ("project_queue_count_mismatch", "project_pending_count", "n_project"),
          ("signal_queue_count_mismatch", "signal_pending_count", "n_signal"), ("catalog_queue_count_mismatch", "catalog_pending_count", "n_queue"),
          ("deep_analysis_count_mismatch", "deep_count", "n_deep")]


def counted(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, signals: DataFrame, queue: DataFrame) -> DataFrame:
    """Headers with the true row counts of their tables."""
    return per_generation(
        headers, snapshot.groupBy(G).agg(F.count("*").alias("n_snapshot")),
        catalog.groupBy(G).agg(F.count("*").alias("n_catalog"), F.count_if(c("analysis_state") == "deep").alias("n_deep")),
        signals.groupBy(G).agg(F.count("*").alias("n_signals")),
        queue.groupBy(G).agg(F.count("*").alias("n_queue"), F.count_if(c("kind") == "project").alias("n_project"),
                             F.count_if(c("kind") == "signal").alias("n_signal")))


def audit_counts(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, signals: DataFrame, queue: DataFrame) -> DataFrame:
    rows = counted(headers, snapshot, catalog, signals, queue)
    return issues(rows, [(code, differs(c(d), c(a))) for code, d, a in COUNTS])


# A5
def duplicates(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Generations where a key is empty or occurs twice (n = number of such keys)."""
    value = F.coalesce(c(key).cast("string"), F.lit(""))
    return (rows.groupBy(G, value.alias("_k")).agg(F.count("*").alias("_n")).filter((c("_n") > 1) | (c("_k") == ""))
            .groupBy(G).agg(F.count("*").alias("n")).select(G, F.lit("error").alias("severity"), F.lit(code).alias("code"), "n"))


def audit_uniqueness(snapshot, catalog, analyses, enrichments, signals, sources, queue) -> DataFrame:
    def versions(rows, code):
        keyed = rows.withColumn("_key", F.concat_ws(" ", F.lower("repository"), "schema_version"))
        return duplicates(keyed, "_key", code)

    return union(
        duplicates(snapshot, "repo", "duplicate_snapshot_repository"), duplicates(catalog, "repo", "duplicate_catalog_repository"),
        duplicates(catalog, "slug", "duplicate_catalog_slug"), duplicates(catalog, "project_id", "duplicate_catalog_project_id"),
        versions(analyses, "duplicate_analysis_repository"), versions(enrichments, "duplicate_enrichment_repository"),
        duplicates(signals, "id", "duplicate_signal_id"), duplicates(signals, "url", "duplicate_signal_url"),
        duplicates(sources, "id", "duplicate_source_id"), duplicates(queue, "id", "duplicate_queue_id"))


# A6
def audit_references(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Catalog against snapshot, recall rules against their declaration, artifacts against the identity contract."""
    # Only rows named like a catalog row can meet one; a name is judged after that.
    cat = catalog.withColumn("_c", canonical(c("repo")))
    alike = snapshot.withColumn("_l", F.lower("repo")).join(catalog.select(F.lower("repo").alias("_l")).distinct(), "_l", "left_semi")
    snap = alike.select(G, canonical(c("repo")).alias("_c"), c("stars").alias("_stars"), F.lit(True).alias("_in"))
    joined = cat.join(snap, [G, "_c"], "left")
    carried = carried_error(c("repo"), c("project_id"), c("project_id_version"))
    refs = joined.groupBy(G).agg(
        F.max(c("_in").isNull()).cast("int").alias("absent"), F.count_if(~c("stars").eqNullSafe(c("_stars"))).alias("stars"))
    # A generation's rules are one list, so the rules of a row are looked up without a row for each.
    known = rules.groupBy(G).agg(F.collect_set("query").alias("_known"))
    strange = F.array_except(F.split(F.coalesce("candidate_query", F.lit("")), " \\| "), F.coalesce("_known", F.array().cast("array<string>")))
    used = (snapshot.join(known, G, "left").filter(F.size(strange) > 0).select(G, "repo").distinct()
            .groupBy(G).agg(F.count("*").alias("unknown")))
    parts = [
        issues(refs, [("catalog_repository_missing_from_snapshot", c("absent")), ("catalog_star_mismatch", c("stars"))]),
        issues(used, [("unknown_candidate_query", c("unknown"))]),
        cat.select(G, carried.alias("code")).filter("code IS NOT NULL").groupBy(G, "code").agg(F.count("*").alias("n"))
        .select(G, F.lit("error").alias("severity"), "code", "n"),
        issues(headers, [("catalog_queue_identity_version_mismatch", differs(c("queue_version"), F.when(c("catalog_version") == 3, 2).otherwise(1))
                          | ((c("catalog_version") == 3) & differs(c("queue_identity_version"), F.lit(1))))])]
    old = artifacts.filter("schema_version = 1").groupBy(G).agg(F.count("*").alias("old"))
    parts.append(issues(old, [("legacy_artifact_in_identity_generation", c("old"))]))
    ids = cat.filter(carried.isNull()).groupBy(G, "_c").agg(F.min("project_id").alias("_pid"))
    both = (artifacts.filter("schema_version = 2").select(G, canonical(c("repository")).alias("_c"), c("project_id").alias("_aid"))
            .join(ids, [G, "_c"]).filter(c("_aid") != c("_pid")).groupBy(G).agg(F.count("*").alias("cross")))
    parts.append(issues(both, [("project_identity_cross_file_mismatch", c("cross"))]))
    names = snapshot.select(G, "repo").unionByName(artifacts.filter("schema_version < 2").select(G, c("repository").alias("repo"))).filter("repo IS NOT NULL")
    # Names that share a slug in a generation share it among all names, so each name is judged once and the few that clash by
    # generation.  An invalid name is '' and counts of rows are carried: without, Spark would judge every row of every generation.
    blank = F.lit("")
    spelled = names.groupBy("repo").agg(F.count("*").alias("_rows")).select(
        "repo", "_rows", F.coalesce(canonical(c("repo")), blank).alias("_c"), F.coalesce(legacy_slug(c("repo")), blank).alias("_s"))
    clash = (spelled.groupBy("_c", "_s").agg(F.sum("_rows").alias("_rows")).groupBy("_s").agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows"))
             .filter("_n > 1 AND _rows > 1").select("_s"))
    slugs = (names.join(spelled.join(clash, "_s"), "repo").groupBy(G, "_c", "_s").agg(F.sum("_rows").alias("_rows"))
             .groupBy(G, "_s").agg(F.count_if(c("_c") != "").alias("_n"), F.sum("_rows").alias("_rows")).filter("_n > 1 AND _rows > 1")
             .groupBy(G).agg(F.count("*").alias("slugs")))
    parts.append(issues(slugs, [("unresolved_legacy_collision", c("slugs"))]))
    return union(*parts)


# A7
def audit_query_health(headers: DataFrame, declared: DataFrame, status: DataFrame) -> DataFrame:
    d = declared.groupBy(G, "query").agg(F.count("*").alias("_d"))
    s = status.groupBy(G, "query").agg(F.count("*").alias("_s"))
    cover = d.join(s, [G, "query"], "full_outer").groupBy(G).agg(
        F.max(~(c("_d").eqNullSafe(F.lit(1)) & c("_s").eqNullSafe(F.lit(1)))).cast("int").alias("cover"),
        F.max(F.coalesce((c("_d") > 1) | (c("query") == ""), F.lit(False))).cast("int").alias("definition"))
    healthy, failed = c("state") == "healthy", c("state") == "failed"
    wrong_error = (healthy & c("error").isNotNull()) | (failed & (F.trim(F.coalesce("error", F.lit(""))) == ""))
    totals = status.groupBy(G).agg(
        F.count_if(~F.coalesce(c("state").isin("healthy", "failed"), F.lit(False))).alias("bad_state"),
        F.count_if(c("item_count").isNull() | (c("item_count") < 0)).alias("bad_count"), F.count_if(wrong_error).alias("bad_error"),
        F.count_if(healthy).alias("ok"), F.count_if(failed).alias("bad"))
    rows = per_generation(headers, cover, totals)
    checks = [
        ("invalid_query_rows", ~c("queries_is_list")), ("invalid_query_status_rows", ~c("status_is_list")),
        ("invalid_query_definition", c("definition")), ("invalid_query_status_row", c("status_non_objects")),
        ("query_status_coverage_mismatch", c("cover")), ("invalid_query_state", c("bad_state")), ("invalid_query_item_count", c("bad_count")),
        ("invalid_query_error", c("bad_error")), ("no_successful_query", c("ok") == 0),
        ("successful_query_count_mismatch", differs(c("successful_query_count"), c("ok"))),
        ("failed_query_count_mismatch", differs(c("failed_query_count"), c("bad"))),
        ("catalog_query_failure_count_mismatch", differs(c("query_failure_count"), c("bad"))), ("partial_query_failure", c("bad"))]
    return issues(rows, checks, ("partial_query_failure",))


# A8
def valid_track() -> Column:
    return F.coalesce(c("heat_track").isin("recent_momentum", "long_term") & (F.coalesce(c("heat_label"), F.lit("")) != "")
                      & c("attention").between(0, 100) & c("endurance").between(0, 100), F.lit(False))


def track_totals(catalog: DataFrame) -> DataFrame:
    daily = c("position") <= 5
    lasting, recent = c("heat_track") == "long_term", c("heat_track") == "recent_momentum"
    return catalog.groupBy(G).agg(
        F.count_if(~valid_track()).alias("invalid"), F.count_if(daily).alias("daily"),
        F.count_if(daily & lasting).alias("d_long"), F.count_if(daily & recent).alias("d_recent"),
        F.count_if(lasting & (c("attention") >= 60) & (c("recommendation") != "watch")).alias("eligible"), F.count_if(recent).alias("recent"))


def wrong_daily() -> Column:
    return (differs(c("daily_long_term"), c("d_long")) | differs(c("daily_recent"), c("d_recent"))
            | (c("d_long") + c("d_recent") != c("daily")))


def unbalanced_daily() -> Column:
    return (c("daily") == 5) & (c("eligible") >= 2) & (c("recent") >= 3) & ((c("d_long") != 2) | (c("d_recent") != 3))


def audit_tracks(headers: DataFrame, catalog: DataFrame) -> DataFrame:
    rows = per_generation(headers, track_totals(catalog))
    return issues(rows, [("invalid_heat_track", c("invalid")), ("daily_track_count_mismatch", wrong_daily()),
                         ("daily_track_balance_mismatch", unbalanced_daily())])


# A9
def heat_rows(catalog: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Catalog rows with the recomputed observations, the right kind of evidence and whether theirs differ."""
    truth = recomputed.select(G, "repo", c("obs_count").alias("_n"), c("obs_window").alias("_w"), c("persistent").alias("_p"))
    lasting = c("heat_track") == "long_term"
    kind = F.when(lasting & F.coalesce("_p", F.lit(False)), "multi_snapshot").when(lasting, "structural_proxy")
    bad = differs(c("obs_count"), F.coalesce("_n", F.lit(0))) | differs(c("obs_window"), c("_w")) | differs(c("long_term_evidence"), c("_kind"))
    return catalog.join(truth, [G, "repo"], "left").withColumn("_kind", kind).withColumn("_bad", bad)


def heat_totals(rows: DataFrame) -> DataFrame:
    verified = (c("heat_track") == "long_term") & F.coalesce("_p", F.lit(False))
    return rows.groupBy(G).agg(F.count_if(c("_bad")).alias("bad"), F.max("_w").alias("window"), F.count_if(verified).alias("verified"))


def audit_heat(headers: DataFrame, catalog: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Declared heat history and observations against a recomputation from the captures."""
    rows = per_generation(headers, heat_totals(heat_rows(catalog, recomputed)))
    return issues(rows, [
        ("heat_history_mismatch", differs(c("snapshot_count"), c("window")) | differs(c("maximum_snapshots"), F.lit(MAX_HEAT_OBSERVATIONS))
         | differs(c("minimum_persistence"), F.lit(MIN_PERSISTENCE_WINDOW)) | differs(c("verified_long_term"), c("verified"))),
        ("heat_observation_mismatch", c("bad"))])


# A10
def audit_urls_scores(headers: DataFrame, evidence: DataFrame, signals: DataFrame, sources: DataFrame) -> DataFrame:
    at = lenient_time(c("signals_at"))
    hours = F.when(c("window_hours") > 0, c("window_hours")).otherwise(48)
    s = signals.join(headers.select(G, at.alias("_at"), hours.alias("_h")), G)
    age = (F.unix_micros("_at") - F.unix_micros(lenient_time(c("published_at")))) / F.lit(3_600_000_000.0)
    outside = ~F.coalesce(age.between(F.lit(-2.0), c("_h").cast("double")), F.lit(False)) & c("_at").isNotNull()
    score_ok = F.coalesce((c("score") >= 0) & (c("score") <= 1) & ~F.isnan("score"), F.lit(False))
    totals = s.groupBy(G).agg(
        F.max(~is_http_url(F.coalesce("url", F.lit("")))).cast("int").alias("u"), F.count_if(~score_ok).alias("sc"), F.count_if(outside).alias("out"))
    bad_evidence = evidence.groupBy(G).agg(F.count_if(~is_http_url(F.coalesce("href", F.lit("")))).alias("ev"))
    bad_source = sources.groupBy(G).agg(F.max(~is_http_url(F.coalesce("url", F.lit("")))).cast("int").alias("so"))
    rows = per_generation(headers, totals, bad_evidence, bad_source)
    return issues(rows, [
        ("unsafe_evidence_url", c("ev")), ("unsafe_signal_url", c("u")), ("unsafe_source_url", c("so")), ("invalid_signal_score", c("sc")),
        ("invalid_signal_window", at.isNotNull() & (c("window_hours").isNull() | (c("window_hours") <= 0))), ("signal_outside_window", c("out"))])


# A11
def audit_sources(headers: DataFrame, sources: DataFrame) -> DataFrame:
    totals = sources.groupBy(G).agg(
        F.count_if(c("state") == "healthy").alias("ok"), F.count_if(c("state") == "failed").alias("bad"), F.count("*").alias("all"))
    rows = per_generation(headers, totals)
    return issues(rows, [
        ("healthy_source_count_mismatch", differs(c("healthy_source_count"), c("ok"))),
        ("failed_source_count_mismatch", differs(c("failed_source_count"), c("bad"))), ("invalid_source_state", c("ok") + c("bad") != c("all")),
        ("partial_signal_source_failure", c("bad"))], ("partial_signal_source_failure",))


# A12
def audit_queue_rebuild(headers: DataFrame, queue: DataFrame, rebuilt: DataFrame, catalog: DataFrame, cols: list[str]) -> DataFrame:
    """Recorded queue items against a rebuild, and catalog states against the rebuilt project items."""
    pending = rebuilt.filter("NOT completed")
    a, b = queue.select(G, *cols), pending.select(G, *cols)
    stale = a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy(G).agg(F.lit(1).alias("stale"))
    done = rebuilt.groupBy(G).agg(
        F.count_if(c("completed") & (c("kind") == "project")).alias("done_projects"), F.count_if(c("completed") & (c("kind") == "signal")).alias("done_signals"))
    kinds = queue.groupBy(G).agg(F.max(~F.coalesce(c("kind").isin("project", "signal"), F.lit(False))).cast("int").alias("kinds"))
    open_repos = pending.filter("kind = 'project'").select(G, c("repository").alias("repo"), F.lit(True).alias("_open"))
    top = catalog.filter(c("position") <= 5).join(open_repos, [G, "repo"], "left")
    deep = c("analysis_state") == "deep"
    states = top.groupBy(G).agg(
        F.count_if(deep & c("_open").isNotNull()).alias("deep_open"), F.count_if(~deep & c("_open").isNull()).alias("not_applied"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~deep, F.struct("position", "repo")))), lambda x: x["repo"]), "|").alias("_pending"))
    rows = per_generation(headers, stale, done, kinds).join(states, G, "left").na.fill(0, ["deep_open", "not_applied"])
    return issues(rows, [
        ("invalid_queue_kind", c("kinds")), ("pending_deep_analysis_mismatch", differs(c("pending_deep"), F.coalesce("_pending", F.lit("")))),
        ("stale_queue_items", c("stale")), ("completed_project_count_mismatch", differs(c("completed_project_count"), c("done_projects"))),
        ("completed_signal_count_mismatch", differs(c("completed_signal_count"), c("done_signals"))),
        ("deep_analysis_without_current_evidence", c("deep_open")), ("current_enrichment_not_applied", c("not_applied"))])


# A13
def audit_catalog_rebuild(headers: DataFrame, catalog: DataFrame, rebuilt: DataFrame, cols: list[str]) -> DataFrame:
    """Ordered catalog rows and the score model against a rebuild."""
    a = catalog.select(G, "position", F.struct(*cols).alias("_a"))
    b = rebuilt.select(G, "position", F.struct(*cols).alias("_b"))
    wrong = a.join(b, [G, "position"], "full_outer").filter(~c("_a").eqNullSafe(c("_b"))).groupBy(G).agg(F.count("*").alias("wrong"))
    rows = per_generation(headers, wrong)
    return issues(rows, [("score_semantics_mismatch", (c("wrong") > 0) | differs(c("score_model"), F.lit("evidence-v2")))])


# A14
def growth_rows(headers: DataFrame, catalog: DataFrame, snapshot: DataFrame, history: DataFrame) -> tuple[DataFrame, Column, DataFrame]:
    """Headers with the captures their previous time names, whether it is one, and catalog rows with stars now and then."""
    captures = history.select("captured_at", "capture_id").distinct()
    known = captures.groupBy(c("captured_at").alias("previous_at")).agg(F.count("capture_id").alias("_matches"), F.min("capture_id").alias("_pid"))
    heads = headers.join(known, "previous_at", "left")
    one = F.coalesce(c("_matches") == 1, F.lit(False))
    named = catalog.select("repo").distinct()
    previous = history.join(named, "repo", "left_semi").select(c("capture_id").alias("_pid"), c("repo"), c("stars").alias("_ps"))
    now = snapshot.join(named, "repo", "left_semi").select(G, "repo", c("stars").alias("_cs"))
    rows = catalog.join(heads.select(G, F.when(one, c("_pid")).alias("_pid")), G).join(now, [G, "repo"], "left")
    return heads, one, rows.join(previous, ["_pid", "repo"], "left")


def audit_growth(headers: DataFrame, catalog: DataFrame, snapshot: DataFrame, history: DataFrame) -> DataFrame:
    """Growth kind and value against the declared previous capture."""
    heads, one, rows = growth_rows(headers, catalog, snapshot, history)
    observed, had = c("growth_kind") == "observed", c("_ps").isNotNull()
    totals = rows.groupBy(G).agg(
        F.count_if(had != observed).alias("kinds"),
        F.count_if(had & observed & ~c("growth_value").eqNullSafe(c("_cs") - c("_ps"))).alias("values"), F.count_if(observed).alias("observed"))
    rows = per_generation(heads, totals)
    return issues(rows, [
        ("missing_previous_snapshot", c("previous_at").isNotNull() & ~one), ("growth_kind_mismatch", c("kinds")),
        ("observed_growth_mismatch", c("values")), ("no_observed_growth_after_history", c("previous_at").isNotNull() & (c("observed") == 0))],
        ("no_observed_growth_after_history",))


# A15
def audit_analysis_failures(headers: DataFrame, failures: DataFrame) -> DataFrame:
    bad = (F.coalesce("repository", F.lit("")) == "") | (F.coalesce("error", F.lit("")) == "")
    totals = failures.groupBy(G).agg(F.count_if(bad).alias("bad"), F.count("*").alias("all"))
    rows = per_generation(headers, totals)
    return issues(rows, [("invalid_analysis_failure_rows", ~c("failures_is_list")), ("invalid_analysis_failure_row", c("bad")),
                         ("partial_static_analysis_failure", c("all"))], ("partial_static_analysis_failure",))


# A16
def audit_report(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, signals: DataFrame, sources: DataFrame, queue: DataFrame,
                 status: DataFrame, failures: DataFrame, found: DataFrame) -> DataFrame:
    """One summary row per generation; ``found`` holds the rows of every check group."""
    observed = c("growth_kind") == "observed"
    value = F.when(observed, c("growth_value"))
    rows = per_generation(
        headers.select(G, "snapshot_at", "catalog_at", "previous_at"),
        snapshot.groupBy(G).agg(F.count("*").alias("repository_count")),
        catalog.groupBy(G).agg(
            F.count("*").alias("project_count"), F.count_if(c("analysis_state") == "deep").alias("deep_analysis_count"),
            F.count_if(observed).alias("observed_project_count"), F.count_if(value > 0).alias("positive_growth_count"),
            F.count_if(value == 0).alias("flat_growth_count"), F.count_if(value < 0).alias("negative_growth_count"),
            F.coalesce(F.sum(value), F.lit(0)).alias("observed_net_star_change"),
            F.count_if((c("position") <= 5) & (c("heat_track") == "long_term")).alias("daily_long_term"),
            F.count_if((c("position") <= 5) & (c("heat_track") == "recent_momentum")).alias("daily_recent")),
        status.groupBy(G).agg(F.count_if(c("state") == "healthy").alias("successful_query_count"), F.count_if(c("state") == "failed").alias("failed_query_count")),
        signals.groupBy(G).agg(F.count("*").alias("signal_count")),
        sources.groupBy(G).agg(F.count_if(c("state") == "healthy").alias("healthy_source_count"), F.count_if(c("state") == "failed").alias("failed_source_count")),
        queue.groupBy(G).agg(F.count("*").alias("queue_pending_count"),
                             F.count_if((c("kind") == "project") & (c("evidence_state") == "static_analysis_required")).alias("static_analysis_required_count")),
        failures.groupBy(G).agg(F.count("*").alias("analysis_failure_count")),
        found.groupBy(G).agg(F.count_if(c("severity") == "error").alias("error_count"), F.count_if(c("severity") == "warning").alias("warning_count")))
    mode = (F.when(c("observed_project_count") == c("project_count"), "observed")
            .when(c("observed_project_count") > 0, "mixed_observation").otherwise("first_observation_proxy"))
    status_text = F.when(c("error_count") > 0, "failed").when(c("warning_count") > 0, "degraded").otherwise("healthy")
    return rows.withColumn("growth_mode", mode).withColumn("status", status_text)


RUN_STATUS_FIELDS = [G, "status", "snapshot_at", "repository_count", "project_count", "deep_analysis_count", "signal_count",
                     "queue_pending_count", "error_count", "warning_count"]


def run_status(report: DataFrame) -> DataFrame:
    """Ten-field extract shown after a run."""
    return report.select(*RUN_STATUS_FIELDS)
