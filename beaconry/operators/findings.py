"""Audit findings a reader can act on: which row of which artifact broke a rule, and what was found there.

Each function reads the tables of one audit group and returns ``generation_id, scope, severity, code, key, detail``: the
artifact, the code of the rule, the row or declared field it is about, and the value found.  Row rules are plain
projections that move nothing; declared values are compared with one row of counts per generation; rebuilt tables meet
their recorded ones in one full outer join on the row key, which names the columns that differ.

Nulls read ``null``.  Empty tables give no findings.  Codes are those of the counting audit.  One difference: a rebuilt row
that was recorded twice, unchanged, is a duplicate key here and no stale item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import MAX_HEAT_OBSERVATIONS, MIN_PERSISTENCE_WINDOW
from beaconry.functions.timefns import lenient_time
from beaconry.functions.urls import is_http_url
from beaconry.operators import audit as A
from beaconry.operators.identity import canonical, carried_error, legacy_slug

c, G = F.col, A.G
COLUMNS = [G, "scope", "severity", "code", "key", "detail"]
WARNINGS = {"partial_query_failure", "partial_signal_source_failure", "partial_static_analysis_failure", "no_observed_growth_after_history"}
SHOWN = 40  # letters of a raw row shown in a detail


def phrase(*parts: str | Column) -> Column:
    """Texts and values as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def said(declared: Column, actual: Column) -> Column:
    return phrase("declared ", declared, ", found ", actual)


def finding(broken: Column, scope: str | Column, code: str | Column, key: str | Column, detail: Column) -> Column:
    """A finding where ``broken`` holds, else null."""
    severity = F.lit("warning" if isinstance(code, str) and code in WARNINGS else "error")
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(broken, F.struct(phrase(scope).alias("scope"), severity.alias("severity"), code.alias("code"), phrase(key).alias("key"), detail.alias("detail")))


def findings(rows: DataFrame, *items: Column) -> DataFrame:
    return rows.select(G, F.explode(F.array_compact(F.array(*items))).alias("_f")).select(G, "_f.*")


def not_in(value: Column, *known: str) -> Column:
    return ~F.coalesce(value.isin(*known), F.lit(False))


def unsafe(url: str) -> Column:
    return ~is_http_url(F.coalesce(url, F.lit("")))


# A1
def presence(generations: DataFrame, inventory: DataFrame, expected: list[str]) -> DataFrame:
    wanted = generations.select(G).withColumn("artifact", F.explode(F.array(*[F.lit(a) for a in expected])))
    rows, state, artifact = wanted.join(inventory, [G, "artifact"], "left"), c("parse_state"), c("artifact")
    return findings(
        rows, finding(state.isNull(), artifact, "missing_artifact", artifact, phrase("not found")),
        finding(state == "broken", artifact, "invalid_artifact", artifact, phrase("cannot be parsed")),
        finding(state == "not_object", artifact, "invalid_artifact_shape", artifact, phrase("not an object")),
        finding((state == "ok") & (c("schema_errors") > 0), artifact, "schema_validation_failed", artifact, phrase(c("schema_errors"), " contract errors")))


# A2
def shape(documents: DataFrame, rows: DataFrame) -> DataFrame:
    code = F.create_map(*[F.lit(x) for pair in A.SHAPE_CODES.items() for x in pair])[c("artifact")]

    def begins(text: str, mark: str, tail: str) -> Column:
        wrong = ~F.coalesce(F.trim(text).startswith(mark), F.lit(False))
        return finding(wrong, c("artifact"), F.concat(F.lit("invalid_"), code, F.lit(tail)), c("artifact"), phrase(F.substring(text, 1, SHOWN)))

    return findings(documents, begins("container_text", "[", "_rows")).unionByName(findings(rows, begins("row_text", "{", "_row")))


# A3
def times(headers: DataFrame) -> DataFrame:
    at = {name: lenient_time(c(f"{name}_at")) for name in ("snapshot", "catalog", "signals", "queue")}

    def unreadable(name: str, code: str) -> Column:
        return finding(at[name].isNull(), name, code, f"{name}_at", phrase(c(f"{name}_at")))

    def order(a: str, b: str, wrong: Column, code: str) -> Column:
        return finding(wrong, a, code, f"{a}_at", phrase(c(f"{a}_at"), f", {b} at ", c(f"{b}_at")))

    return findings(
        headers, unreadable("snapshot", "invalid_snapshot_time"), unreadable("catalog", "invalid_catalog_time"),
        unreadable("signals", "invalid_signal_time"), unreadable("queue", "invalid_queue_time"),
        order("catalog", "snapshot", at["catalog"] != at["snapshot"], "catalog_snapshot_mismatch"),
        order("signals", "snapshot", at["signals"] < at["snapshot"], "signals_older_than_snapshot"),
        order("queue", "catalog", at["queue"] < at["catalog"], "queue_older_than_catalog"),
        order("queue", "signals", at["queue"] < at["signals"], "queue_older_than_signals"))


# A4
def counts(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, signals: DataFrame, queue: DataFrame) -> DataFrame:
    rows = A.counted(headers, snapshot, catalog, signals, queue)
    return findings(rows, *[finding(A.differs(c(d), c(a)), "header", code, d, said(c(d), c(a))) for code, d, a in A.COUNTS])


# A5
def uniqueness(snapshot, catalog, analyses, enrichments, signals, sources, queue) -> DataFrame:
    def repeated(rows: DataFrame, scope: str, key: Column, code: str) -> DataFrame:
        keys = rows.groupBy(G, F.coalesce(key.cast("string"), F.lit("")).alias("_k")).agg(F.count("*").alias("_n"))
        return findings(keys, finding((c("_n") > 1) | (c("_k") == ""), scope, code, c("_k"), phrase(c("_n"), " rows")))

    version = F.concat_ws(" ", F.lower("repository"), "schema_version")
    return A.union(
        repeated(snapshot, "snapshot", c("repo"), "duplicate_snapshot_repository"), repeated(catalog, "catalog", c("repo"), "duplicate_catalog_repository"),
        repeated(catalog, "catalog", c("slug"), "duplicate_catalog_slug"), repeated(catalog, "catalog", c("project_id"), "duplicate_catalog_project_id"),
        repeated(analyses, "analyses", version, "duplicate_analysis_repository"), repeated(enrichments, "enrichments", version, "duplicate_enrichment_repository"),
        repeated(signals, "signals", c("id"), "duplicate_signal_id"), repeated(signals, "signals", c("url"), "duplicate_signal_url"),
        repeated(sources, "sources", c("id"), "duplicate_source_id"), repeated(queue, "queue", c("id"), "duplicate_queue_id"))


# A6
def references(headers: DataFrame, snapshot: DataFrame, catalog: DataFrame, rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    snap = snapshot.select(G, canonical(c("repo")).alias("_c"), c("stars").alias("_stars"), F.lit(True).alias("_in"))
    cat = catalog.withColumn("_c", canonical(c("repo"))).withColumn("_e", carried_error(c("repo"), c("project_id"), c("project_id_version")))
    against = findings(
        cat.join(snap, [G, "_c"], "left"),
        finding(c("_in").isNull(), "catalog", "catalog_repository_missing_from_snapshot", c("repo"), phrase("not in the snapshot")),
        finding(~c("stars").eqNullSafe(c("_stars")), "catalog", "catalog_star_mismatch", c("repo"), phrase("catalog ", c("stars"), ", snapshot ", c("_stars"))))
    known = rules.select(G, c("query").alias("_q")).distinct().withColumn("_known", F.lit(True))
    used = snapshot.select(G, "repo", F.explode(F.split(F.coalesce("candidate_query", F.lit("")), " \\| ")).alias("_q")).distinct().join(known, [G, "_q"], "left")
    carried = findings(cat, finding(c("_e").isNotNull(), "catalog", c("_e"), c("repo"), phrase(c("project_id"), " version ", c("project_id_version"))))
    wrong = (A.differs(c("queue_version"), F.when(c("catalog_version") == 3, 2).otherwise(1))
             | ((c("catalog_version") == 3) & A.differs(c("queue_identity_version"), F.lit(1))))
    versions = findings(headers, finding(wrong, "header", "catalog_queue_identity_version_mismatch", "queue_version", phrase(
        "catalog ", c("catalog_version"), ", queue ", c("queue_version"), ", identity ", c("queue_identity_version"))))
    old = findings(artifacts, finding(c("schema_version") == 1, "analyses", "legacy_artifact_in_identity_generation", c("repository"), phrase("schema version 1")))
    ids = cat.filter(c("_e").isNull()).groupBy(G, "_c").agg(F.min("project_id").alias("_pid"))
    both = artifacts.filter("schema_version = 2").withColumn("_c", canonical(c("repository"))).withColumnRenamed("project_id", "_aid").join(ids, [G, "_c"])
    cross = findings(both, finding(c("_aid") != c("_pid"), "analyses", "project_identity_cross_file_mismatch", c("repository"), phrase(
        "artifact ", c("_aid"), ", catalog ", c("_pid"))))
    names = snapshot.select(G, "repo").unionByName(artifacts.filter("schema_version < 2").select(G, c("repository").alias("repo")))
    slugs = (names.select(G, canonical(c("repo")).alias("_c"), legacy_slug(c("repo")).alias("_s")).filter("_c IS NOT NULL").distinct()
             .groupBy(G, "_s").agg(F.count("*").alias("_n"), F.min("_c").alias("_a"), F.max("_c").alias("_b")))
    shared = findings(slugs, finding(c("_n") > 1, "snapshot", "unresolved_legacy_collision", c("_s"), phrase(c("_n"), " repositories from ", c("_a"), " to ", c("_b"))))
    unknown = findings(used, finding(c("_known").isNull(), "snapshot", "unknown_candidate_query", c("repo"), phrase(c("_q"))))
    return A.union(against, unknown, carried, versions, old, cross, shared)


# A7
def query_health(headers: DataFrame, declared: DataFrame, status: DataFrame) -> DataFrame:
    d = declared.groupBy(G, "query").agg(F.count("*").alias("_d"))
    s = status.groupBy(G, "query").agg(F.count("*").alias("_s"))
    cover = d.join(s, [G, "query"], "full_outer").na.fill(0, ["_d", "_s"])
    healthy, failed = c("state") == "healthy", c("state") == "failed"
    wrong_error = (healthy & c("error").isNotNull()) | (failed & (F.trim(F.coalesce("error", F.lit(""))) == ""))
    per_query = findings(
        cover.join(headers.select(G), G, "left_semi"),
        finding((c("_d") > 1) | ((c("_d") > 0) & (c("query") == "")), "queries", "invalid_query_definition", c("query"), phrase("declared ", c("_d"), " times")),
        finding((c("_d") != 1) | (c("_s") != 1), "queries", "query_status_coverage_mismatch", c("query"), phrase("declared ", c("_d"), " times, reported ", c("_s"))))
    per_row = findings(
        status.join(headers.select(G), G, "left_semi"),
        finding(not_in(c("state"), "healthy", "failed"), "query_status", "invalid_query_state", c("query"), phrase(c("state"))),
        finding(c("item_count").isNull() | (c("item_count") < 0), "query_status", "invalid_query_item_count", c("query"), phrase(c("item_count"))),
        finding(wrong_error, "query_status", "invalid_query_error", c("query"), phrase(c("state"), ": ", c("error"))),
        finding(failed, "query_status", "partial_query_failure", c("query"), phrase(c("error"))))
    totals = status.groupBy(G).agg(F.count_if(healthy).alias("ok"), F.count_if(failed).alias("bad"), F.count("*").alias("all"))
    per_head = findings(
        A.per_generation(headers, totals),
        finding(~c("queries_is_list"), "queries", "invalid_query_rows", "queries", phrase("not a list")),
        finding(~c("status_is_list"), "query_status", "invalid_query_status_rows", "query_status", phrase("not a list")),
        finding(c("status_non_objects") > 0, "query_status", "invalid_query_status_row", "query_status", phrase(c("status_non_objects"), " rows are not objects")),
        finding(c("ok") == 0, "query_status", "no_successful_query", "query_status", phrase("none of ", c("all"))),
        *[finding(A.differs(c(name), c(actual)), "header", code, name, said(c(name), c(actual))) for code, name, actual in [
            ("successful_query_count_mismatch", "successful_query_count", "ok"), ("failed_query_count_mismatch", "failed_query_count", "bad"),
            ("catalog_query_failure_count_mismatch", "query_failure_count", "bad")]])
    return A.union(per_query, per_row, per_head)


# A8
def tracks(headers: DataFrame, catalog: DataFrame) -> DataFrame:
    per_row = findings(catalog, finding(~A.valid_track(), "catalog", "invalid_heat_track", c("repo"), phrase(
        c("heat_track"), " '", c("heat_label"), "', attention ", c("attention"), ", endurance ", c("endurance"))))
    rows = A.per_generation(headers, A.track_totals(catalog))
    return per_row.unionByName(findings(
        rows, finding(A.wrong_daily(), "header", "daily_track_count_mismatch", "daily", phrase(
            "declared ", c("daily_long_term"), " + ", c("daily_recent"), ", found ", c("d_long"), " + ", c("d_recent"), " of ", c("daily"))),
        finding(A.unbalanced_daily(), "catalog", "daily_track_balance_mismatch", "daily", phrase(c("d_long"), " lasting and ", c("d_recent"), " recent"))))


# A9
def heat(headers: DataFrame, catalog: DataFrame, recomputed: DataFrame) -> DataFrame:
    rows = A.heat_rows(catalog, recomputed)
    per_row = findings(rows, finding(c("_bad"), "catalog", "heat_observation_mismatch", c("repo"), phrase(
        "declared ", c("obs_count"), " of ", c("obs_window"), " ", c("long_term_evidence"), ", found ", F.coalesce("_n", F.lit(0)), " of ", c("_w"), " ", c("_kind"))))
    heads = A.per_generation(headers, A.heat_totals(rows))
    pairs = [("snapshot_count", c("window")), ("maximum_snapshots", F.lit(MAX_HEAT_OBSERVATIONS)),
             ("minimum_persistence", F.lit(MIN_PERSISTENCE_WINDOW)), ("verified_long_term", c("verified"))]
    return per_row.unionByName(findings(heads, *[
        finding(A.differs(c(name), actual), "header", "heat_history_mismatch", name, said(c(name), actual)) for name, actual in pairs]))


# A10
def urls_scores(headers: DataFrame, evidence: DataFrame, signals: DataFrame, sources: DataFrame) -> DataFrame:
    at = lenient_time(c("signals_at"))
    hours = F.when(c("window_hours") > 0, c("window_hours")).otherwise(48)
    s = signals.join(headers.select(G, at.alias("_at"), hours.alias("_h")), G)
    age = (F.unix_micros("_at") - F.unix_micros(lenient_time(c("published_at")))) / F.lit(3_600_000_000.0)
    outside = ~F.coalesce(age.between(F.lit(-2.0), c("_h").cast("double")), F.lit(False)) & c("_at").isNotNull()
    score_ok = F.coalesce((c("score") >= 0) & (c("score") <= 1) & ~F.isnan("score"), F.lit(False))
    known = headers.select(G)
    return A.union(
        findings(evidence.join(known, G, "left_semi"), finding(unsafe("href"), "catalog", "unsafe_evidence_url", c("repo"), phrase(c("href")))),
        findings(s, finding(unsafe("url"), "signals", "unsafe_signal_url", c("id"), phrase(c("url"))),
                 finding(~score_ok, "signals", "invalid_signal_score", c("id"), phrase(c("score"))),
                 finding(outside, "signals", "signal_outside_window", c("id"), phrase(c("published_at")))),
        findings(sources.join(known, G, "left_semi"), finding(unsafe("url"), "sources", "unsafe_source_url", c("id"), phrase(c("url")))),
        findings(headers, finding(at.isNotNull() & (c("window_hours").isNull() | (c("window_hours") <= 0)), "header", "invalid_signal_window", "window_hours",
                                  phrase(c("window_hours")))))


# A11
def sources(headers: DataFrame, rows: DataFrame) -> DataFrame:
    totals = rows.groupBy(G).agg(F.count_if(c("state") == "healthy").alias("ok"), F.count_if(c("state") == "failed").alias("bad"))
    per_row = findings(
        rows.join(headers.select(G), G, "left_semi"),
        finding(not_in(c("state"), "healthy", "failed"), "sources", "invalid_source_state", c("id"), phrase(c("state"))),
        finding(c("state") == "failed", "sources", "partial_signal_source_failure", c("id"), phrase(c("url"))))
    return per_row.unionByName(findings(A.per_generation(headers, totals), *[
        finding(A.differs(c(name), c(actual)), "header", code, name, said(c(name), c(actual))) for code, name, actual in [
            ("healthy_source_count_mismatch", "healthy_source_count", "ok"), ("failed_source_count_mismatch", "failed_source_count", "bad")]]))


def compared(recorded: DataFrame, rebuilt: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``generation_id, key, change``: rows of one side only and the names of columns that differ."""
    a = recorded.select(G, key, F.struct(*cols).alias("_a"))
    b = rebuilt.select(G, key, F.struct(*cols).alias("_b"))
    wrong = F.array_compact(F.array(*[F.when(~c(f"_a.{x}").eqNullSafe(c(f"_b.{x}")), F.lit(x)) for x in cols]))
    change = F.when(c("_b").isNull(), "only recorded").when(c("_a").isNull(), "only rebuilt").otherwise(F.concat(F.lit("differs: "), F.array_join(wrong, ", ")))
    return a.join(b, [G, key], "full_outer").filter(~c("_a").eqNullSafe(c("_b"))).select(G, c(key).alias("key"), change.alias("change"))


# A12
def queue_rebuild(headers: DataFrame, queue: DataFrame, rebuilt: DataFrame, catalog: DataFrame, cols: list[str]) -> DataFrame:
    known, pending = headers.select(G), rebuilt.filter("NOT completed")
    stale = compared(queue, pending, "id", [x for x in cols if x != "id"]).join(known, G, "left_semi")
    done = rebuilt.groupBy(G).agg(
        F.count_if(c("completed") & (c("kind") == "project")).alias("projects"), F.count_if(c("completed") & (c("kind") == "signal")).alias("signals"))
    open_repos = pending.filter("kind = 'project'").select(G, c("repository").alias("repo"), F.lit(True).alias("_open")).distinct()
    top = catalog.filter(c("position") <= 5).join(open_repos, [G, "repo"], "left").join(known, G, "left_semi")
    deep = c("analysis_state") == "deep"
    listed = top.groupBy(G).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~deep, F.struct("position", "repo")))), lambda x: x["repo"]), "|").alias("_pending"))
    heads = A.per_generation(headers, done).join(listed, G, "left").withColumn("_pending", F.coalesce("_pending", F.lit("")))
    return A.union(
        findings(queue.join(known, G, "left_semi"), finding(not_in(c("kind"), "project", "signal"), "queue", "invalid_queue_kind", c("id"), phrase(c("kind")))),
        findings(stale, finding(F.lit(True), "queue", "stale_queue_items", c("key"), c("change"))),
        findings(top, finding(deep & c("_open").isNotNull(), "catalog", "deep_analysis_without_current_evidence", c("repo"), phrase("still pending")),
                 finding(~deep & c("_open").isNull(), "catalog", "current_enrichment_not_applied", c("repo"), phrase(c("analysis_state")))),
        findings(heads, *[finding(A.differs(c(name), c(actual)), "header", code, name, said(c(name), c(actual))) for code, name, actual in [
            ("pending_deep_analysis_mismatch", "pending_deep", "_pending"), ("completed_project_count_mismatch", "completed_project_count", "projects"),
            ("completed_signal_count_mismatch", "completed_signal_count", "signals")]]))


# A13
def catalog_rebuild(headers: DataFrame, catalog: DataFrame, rebuilt: DataFrame, cols: list[str]) -> DataFrame:
    wrong = compared(catalog, rebuilt, "position", cols).join(headers.select(G), G, "left_semi")
    model = F.lit("evidence-v2")
    return findings(wrong, finding(F.lit(True), "catalog", "score_semantics_mismatch", c("key"), c("change"))).unionByName(
        findings(headers, finding(A.differs(c("score_model"), model), "header", "score_semantics_mismatch", "score_model", said(c("score_model"), model))))


# A14
def growth(headers: DataFrame, catalog: DataFrame, snapshot: DataFrame, history: DataFrame) -> DataFrame:
    heads, one, rows = A.growth_rows(headers, catalog, snapshot, history)
    observed, had = c("growth_kind") == "observed", c("_ps").isNotNull()
    actual = c("_cs") - c("_ps")
    per_head = A.per_generation(heads, rows.groupBy(G).agg(F.count_if(observed).alias("observed"), F.count("*").alias("projects")))
    return findings(
        rows, finding(had != observed, "catalog", "growth_kind_mismatch", c("repo"), phrase(c("growth_kind"), ", previous stars ", c("_ps"))),
        finding(had & observed & ~c("growth_value").eqNullSafe(actual), "catalog", "observed_growth_mismatch", c("repo"), said(c("growth_value"), actual))).unionByName(
        findings(per_head, finding(c("previous_at").isNotNull() & ~one, "header", "missing_previous_snapshot", "previous_at", phrase(
            c("previous_at"), " names ", F.coalesce("_matches", F.lit(0)), " captures")),
            finding(c("previous_at").isNotNull() & (c("observed") == 0), "catalog", "no_observed_growth_after_history", "growth_kind", phrase(
                "none of ", c("projects"), " projects"))))


# A15
def analysis_failures(headers: DataFrame, failures: DataFrame) -> DataFrame:
    bad = (F.coalesce("repository", F.lit("")) == "") | (F.coalesce("error", F.lit("")) == "")
    return findings(
        failures.join(headers.select(G), G, "left_semi"),
        finding(bad, "analysis_failures", "invalid_analysis_failure_row", c("repository"), phrase(c("error"))),
        finding(F.lit(True), "analysis_failures", "partial_static_analysis_failure", c("repository"), phrase(c("error")))).unionByName(
        findings(headers, finding(~c("failures_is_list"), "analysis_failures", "invalid_analysis_failure_rows", "analysis_failures", phrase("not a list"))))


def counted(found: DataFrame) -> DataFrame:
    """How many findings each generation has of each code."""
    return found.groupBy(G, "severity", "code").agg(F.count("*").alias("n"))
