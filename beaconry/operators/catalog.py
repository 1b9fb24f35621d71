"""The catalog job: growth, persistence, explainable scores, balanced order and summary.

Every capture is computed at once.  Growth and persistence share one window over the repository, the
artifact joins reuse that partitioning, and ranking trims inside salted groups before the final order.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import (
    CATEGORY_TERMS, DAILY_LONG_TERM, DAILY_RECENT, DAILY_SIZE, DEFAULT_CATEGORY,
    INDICATORS, LOW_ACTIONABILITY_TERMS, MAX_HEAT_OBSERVATIONS, MIN_PERSISTENCE_COUNT, MIN_PERSISTENCE_RATIO,
    MIN_PERSISTENCE_WINDOW, PRODUCTIVITY_TERMS, READINESS_WEIGHTS, RISK_TERMS)
from beaconry.functions import numeric as N
from beaconry.functions import text as X
from beaconry.functions import timefns as T
from beaconry.functions.urls import safe_url
from beaconry.operators.identity import canonical
from beaconry.operators.skew import exact_position, previous_value, task_count
from beaconry.plans import texts

c = F.col


# --- captures and growth --------------------------------------------------------------
def capture_chain(captures: DataFrame) -> DataFrame:
    """Consecutive numbers and predecessors of the capture headers, one capture per instant.

    Captures whose time cannot be read have no place in the chain; ``growth_rejects`` names them.  Numbers and
    predecessors come from month buckets, so only the bucket sizes meet in one task.
    """
    heads = (captures.select("capture_id", T.strict_time(c("captured_at")).alias("captured_ts")).filter("captured_ts is not null")
             .groupBy("captured_ts").agg(F.max("capture_id").alias("capture_id"))
             .withColumn("_head", F.struct("captured_ts", "capture_id")))
    month = F.date_trunc("month", "captured_ts")
    placed = exact_position(heads, [], [F.asc("captured_ts")], [month], [F.asc("_b0")], "capture_no")
    linked = previous_value(placed, [], month, ["captured_ts"], "_head", "_before")
    return linked.select("capture_id", "captured_ts", "capture_no", c("_before.captured_ts").alias("previous_ts"),
                         c("_before.capture_id").alias("previous_capture_id"))


def number_captures(captures: DataFrame) -> DataFrame:
    return capture_chain(captures).select("capture_id", "captured_ts", "capture_no")


def previous_capture(captures: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Capture before each capture; a declared predecessor must match exactly one capture."""
    chain = capture_chain(captures)
    if declared is None:
        return chain.withColumn("error", F.lit(None).cast("string"))
    known = chain.groupBy(c("captured_ts").alias("_ts")).agg(
        F.count("*").alias("_n"), F.min("capture_id").alias("_id"))
    wanted = declared.select("capture_id", T.strict_time(c("declared_previous_at")).alias("_ts"))
    return (
        chain.join(wanted, "capture_id", "left").join(known, "_ts", "left")
        .withColumn("error", F.when(c("_ts").isNotNull() & (F.coalesce("_n", F.lit(0)) != 1), "missing_previous_snapshot"))
        .withColumn("previous_capture_id", F.when(c("_ts").isNull(), c("previous_capture_id")).otherwise(c("_id")))
        .withColumn("previous_ts", F.coalesce("_ts", "previous_ts")).drop("_ts", "_n", "_id"))


def _numbered_rows(snapshot: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows of the snapshot with their capture's number, ``canonical`` and ``reject``, the reason to leave a row out."""
    rows = (snapshot.join(number_captures(captures), "capture_id", "left").withColumn("canonical", canonical(c("repo"))))
    same = Window.partitionBy("canonical", "capture_no").orderBy(F.desc("stars"), "repo")
    return rows.withColumn("reject", F.when(c("capture_no").isNull(), "unreadable_capture").when(c("canonical").isNull(), "invalid_repository")
                           .when((F.row_number().over(same) > 1), "duplicate_repository"))


def growth_rejects(snapshot: DataFrame, captures: DataFrame) -> DataFrame:
    """Rows that growth leaves out: captures without a readable time, invalid names, further rows of one repository."""
    return _numbered_rows(snapshot, captures).filter("reject is not null").select("capture_id", "repo", "reject")


def with_growth(snapshot: DataFrame, captures: DataFrame) -> DataFrame:
    """Star growth against the previous capture and presence in the last 30 captures, of rows that are not rejected."""
    # Rows without a name or a capture go before the windows: their shared null key would be a hot one.
    named = snapshot.filter(canonical(c("repo")).isNotNull()).join(number_captures(captures), "capture_id").withColumn("canonical", F.lower("repo"))
    # Both windows and the joins after them read one shuffle and one sort by repository.
    # Scoring costs far more than the bytes of a row tell, so the parts are not merged by size.
    named = named.repartition(task_count(snapshot.sparkSession), "canonical")
    # The first row of each capture is kept.  A window by repository and capture would start anew for nearly every row.
    every = Window.partitionBy("canonical").orderBy("capture_no", F.desc("stars"), "repo")
    rows = named.withColumn("_same", F.lag("capture_no").over(every).eqNullSafe(c("capture_no"))).filter(~c("_same")).drop("_same")
    history = Window.partitionBy("canonical").orderBy("capture_no")
    recent = history.rangeBetween(-(MAX_HEAT_OBSERVATIONS - 1), 0)
    rows = (rows.withColumn("_pno", F.lag("capture_no").over(history))
            .withColumn("_pstars", F.lag("stars").over(history))
            .withColumn("_pts", F.lag("captured_ts").over(history))
            .withColumn("obs_count", F.count("capture_no").over(recent).cast("int")))
    observed = F.coalesce(c("_pno") == c("capture_no") - 1, F.lit(False))
    created = F.coalesce(T.strict_time(c("created_at")), c("captured_ts"))
    hours = T.hours_between(c("captured_ts"), c("_pts"))
    rows = (
        rows.withColumn("observed", observed).withColumn("created_ts", created)
        .withColumn("pushed_ts", T.strict_time(c("pushed_at")))
        .withColumn("age_days", F.greatest(T.days_between(c("captured_ts"), created), F.lit(1.0)))
        .withColumn("window_hours", F.when(observed, hours))
        .withColumn("_delta", F.when(observed, c("stars") - c("_pstars"))))
    rate = c("stars") / c("age_days")
    proxy = F.bround(rate, 0).cast("long")
    return (
        rows.withColumn("growth_kind", F.when(c("observed"), "observed").otherwise("velocity_proxy"))
        .withColumn("growth_value", F.when(c("observed"), c("_delta")).otherwise(proxy))
        .withColumn("ranking_value", F.when(
            c("observed"), F.greatest(c("_delta"), F.lit(0)) * 24.0 / F.greatest(c("window_hours"), F.lit(1.0))).otherwise(rate))
        .withColumn("obs_window", F.least(c("capture_no"), F.lit(MAX_HEAT_OBSERVATIONS)))
        .drop("_pno", "_pstars", "_pts", "_delta"))


def with_growth_labels(rows: DataFrame) -> DataFrame:
    """Display texts of the growth; built for the rows that are shown."""
    hours = F.format_string("%.1f", F.bround(c("window_hours"), 1))
    value = c("growth_value").cast("string")
    return rows.withColumns({
        "growth_label": F.when(c("observed"), F.concat(N.signed(c("growth_value")), F.lit(" in "), hours, F.lit(" hours"))).otherwise(
            F.concat(F.lit("about "), value, F.lit(" stars a day since creation"))),
        "trend": F.when(c("observed"), F.concat(N.signed(c("growth_value")), F.lit(" / "), hours, F.lit("h"))).otherwise(
            F.concat(F.lit("~"), value, F.lit("/day")))})


def persistence_verified(count: Column, window: Column) -> Column:
    return ((window >= MIN_PERSISTENCE_WINDOW) & (count >= MIN_PERSISTENCE_COUNT)
            & (count / F.greatest(window, F.lit(1)) >= MIN_PERSISTENCE_RATIO))


# --- evidence and profiles --------------------------------------------------------------
def with_artifacts(rows: DataFrame, evidence: DataFrame | None, enrichment: DataFrame | None) -> DataFrame:
    """Join the one authoritative evidence and profile row per repository and test their currency."""
    if evidence is None:
        blank = {"has_payload": "boolean", "has_analysis": "boolean", "scanned_files": "bigint", "test_files": "bigint",
                 "license_hint": "string", "confidence": "int", "analysis_at": "string",
                 **{f"ind_{i}": "boolean" for i in INDICATORS}}
        for name, kind in blank.items():
            rows = rows.withColumn(name, F.lit(False) if name.startswith("has") else F.lit(None).cast(kind))
    else:
        # Times of artifacts are read once a repository, before the rows of all captures meet them.
        ev = evidence.select(
            canonical(c("repository")).alias("canonical"), c("schema_version").alias("_ev"), c("analyzed_at").alias("analysis_at"),
            T.strict_time(c("analyzed_at")).alias("_at"), "scanned_files", "test_files", "license_hint", "confidence", *[f"ind_{i}" for i in INDICATORS]
        ).filter("canonical IS NOT NULL")
        rows = rows.join(ev, "canonical", "left").withColumn("has_payload", c("_ev").isNotNull())
        current = (c("_ev") == 2) & c("_at").isNotNull() & (c("pushed_ts").isNull() | (c("_at") >= c("pushed_ts")))
        rows = rows.withColumn("has_analysis", F.coalesce(current, F.lit(False))).drop("_ev", "_at")
    if enrichment is None:
        return rows.withColumns({"has_profile": F.lit(False), "has_enrichment": F.lit(False)})
    en = enrichment.select(
        canonical(c("repository")).alias("canonical"), c("schema_version").alias("_nv"), "source_pushed_at", "source_analysis_at",
        T.strict_time(c("source_pushed_at")).isNotNull().alias("_dated"),
        (T.strict_time(c("analyzed_at")) >= T.strict_time(c("source_analysis_at"))).alias("_in_order")).filter("canonical IS NOT NULL")
    rows = rows.join(en, "canonical", "left").withColumn("has_profile", c("_nv").isNotNull())
    current = (
        c("has_analysis") & (c("_nv") == 2) & (c("source_pushed_at") == c("pushed_at"))
        & (c("source_analysis_at") == c("analysis_at")) & c("_dated") & c("_in_order"))
    return rows.withColumn("has_enrichment", F.coalesce(current, F.lit(False))).drop(
        "_nv", "source_pushed_at", "source_analysis_at", "_dated", "_in_order")


PROFILE_TEXTS = ["title", "summary", "category", "best_for", "reuse_plan", "limitation", "evidence_summary", "source_url"]
PROFILE_LISTS = ["capabilities", "task_terms"]


def with_profile_texts(ranked: DataFrame, enrichment: DataFrame | None) -> DataFrame:
    """Profile texts for catalog rows only; they never travel through scoring and ranking."""
    if enrichment is None:
        return ranked.withColumns({
            **{f"enr_{n}": F.lit(None).cast("string") for n in PROFILE_TEXTS},
            **{f"enr_{n}": F.lit(None).cast("array<string>") for n in PROFILE_LISTS}})
    texts_of = enrichment.select(canonical(c("repository")).alias("canonical"), *[c(n).alias(f"enr_{n}") for n in PROFILE_TEXTS + PROFILE_LISTS])
    return ranked.join(texts_of.filter("canonical IS NOT NULL"), "canonical", "left")


# --- scores --------------------------------------------------------------------------------
def _log_part(value: Column, base, floor=1):
    return base(F.greatest(value, F.lit(floor)).cast("double"))


def repository_text() -> Column:
    return X.repository_text(c("repo"), c("description"), c("topics"))


def with_scores(rows: DataFrame) -> DataFrame:
    """Scores of every row; the list ``terms`` is costly and read by few, so scores count terms without it."""
    text = repository_text()
    age, push = c("age_days"), c("push_age_days")
    rows = (
        rows.withColumn("_text", text)
        .withColumn("terms", X.hits(c("_text"), PRODUCTIVITY_TERMS)).withColumn("term_count", X.hit_count(c("_text"), PRODUCTIVITY_TERMS))
        .withColumn("low_actionability", X.has_any(c("_text"), LOW_ACTIONABILITY_TERMS))
        .withColumn("risk", X.has_any(c("_text"), RISK_TERMS))
        .withColumn("base_category", X.first_match(c("_text"), CATEGORY_TERMS, DEFAULT_CATEGORY)).drop("_text")
        .withColumn("query_count", F.size(F.split(F.coalesce("candidate_query", F.lit("")), " \\| ")))
        .withColumn("push_age_days", F.when(
            c("pushed_ts").isNull(), F.lit(30.0)).otherwise(F.greatest(T.days_between(c("captured_ts"), c("pushed_ts")), F.lit(0.0)))))
    penalty = F.when(c("low_actionability"), 12.0).otherwise(0.0) + F.when(c("risk"), 26.0).otherwise(0.0)
    momentum = (
        F.lit(16.0)
        + F.least(F.lit(44.0), F.log2(c("ranking_value") + 1.0) * F.when(c("observed"), 7.0).otherwise(4.5))
        + F.greatest(F.lit(0.0), F.lit(22.0) * (F.lit(1.0) - age / 45.0))
        + F.greatest(F.lit(0.0), F.lit(12.0) * (F.lit(1.0) - push / 14.0))
        + F.least(F.lit(18.0), c("term_count") * 3.0) + F.least(F.lit(6.0), c("query_count") * 1.5) - penalty)
    eligible = (age >= 180) & (c("stars") >= 5000) & (push <= 120)
    verified = eligible & persistence_verified(c("obs_count"), c("obs_window"))
    rows = rows.withColumn("long_term", eligible).withColumn("verified", verified)
    endurance = (
        F.least(F.lit(45.0), F.greatest(F.lit(0.0), (_log_part(c("stars"), F.log10) - 3.0) * 22.5))
        + F.least(F.lit(20.0), F.greatest(F.lit(0.0), F.log2(F.greatest(age / 30.0, F.lit(1.0))) * 5.2))
        + F.greatest(F.lit(0.0), F.lit(15.0) * (F.lit(1.0) - push / 120.0))
        + F.least(F.lit(10.0), _log_part(c("forks"), F.log10) * 2.5)
        + F.least(F.lit(10.0), c("term_count") * 2.0)
        + F.when(c("verified"), F.least(F.lit(10.0), F.lit(5.0) + c("obs_count") / c("obs_window") * 5.0)).otherwise(0.0)
        - penalty)
    rows = rows.withColumn("_m", N.score(momentum)).withColumn("_e", N.score(endurance))
    attention = F.greatest(c("_m"), F.bround(c("_e") * 0.92, 0).cast("int"))
    material = reduce(lambda a, b: a + b, [
        F.when(c(f"ind_{name}"), float(weight)).otherwise(0.0) for name, weight in READINESS_WEIGHTS])
    readiness = material + F.least(F.lit(5.0), _log_part(F.coalesce("test_files", F.lit(0)), F.log10) * 2.5)
    readiness = N.score(readiness - F.when(c("risk"), 26.0).otherwise(0.0))

    def capped(value, cap):
        return F.when(c("risk"), F.least(value, F.lit(cap))).otherwise(value)

    return (
        rows.withColumn("attention", capped(attention, 49)).withColumn("momentum", capped(c("_m"), 49))
        .withColumn("endurance", capped(c("_e"), 35))
        .withColumn("readiness", F.when(c("has_analysis"), capped(readiness, 35)))
        .withColumn("completeness", (
            25 + F.when(c("observed"), 15).otherwise(5) + F.when(c("has_analysis"), 30).otherwise(0)
            + F.when(c("has_enrichment"), 20).otherwise(0) + F.when(c("verified"), 10).otherwise(0)))
        .withColumn("license_confirmed", F.coalesce(~c("license").isin("NOASSERTION", ""), F.lit(False)))
        .withColumn("recommendation", recommendation(c("attention"), c("readiness"), c("license_confirmed"), c("risk")))
        .withColumn("heat_track", F.when(c("long_term"), "long_term").otherwise("recent_momentum"))
        .withColumn("heat_label", (
            F.when(c("verified"), "long_term_verified").when(c("long_term"), "long_term_proxy")
            .when(~c("observed"), "first_proxy").when(c("growth_value") > 0, "rising")
            .when(c("growth_value") == 0, "flat").otherwise("falling")))
        .withColumn("long_term_evidence", F.when(c("verified"), "multi_snapshot").when(c("long_term"), "structural_proxy"))
        .withColumn("analysis_state", (
            F.when(c("has_enrichment"), "deep").when(c("has_profile"), "enrichment_stale")
            .when(c("has_analysis"), "static").otherwise("facts_only")))
        .drop("_m", "_e"))


def recommendation(attention: Column, readiness: Column, licensed: Column, risk: Column) -> Column:
    return (
        F.when(risk, "watch")
        .when((readiness >= 75) & (attention >= 55) & licensed, "sandbox_trial")
        .when(readiness >= 60, "save")
        .when((attention >= 60) | readiness.isNotNull(), "learn").otherwise("watch"))


# --- text fields -------------------------------------------------------------------------
def _fill(template: str) -> Column:
    """Concat of a template's literal parts and its placeholder columns."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[F.coalesce(c("t")[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p) for p in parts])


def _conditions() -> dict[str, Column]:
    return {
        "observed": c("observed"), "not_observed": ~c("observed"), "risk": c("risk"), "verified": c("verified"),
        "not_verified": ~c("verified"), "has_analysis": c("has_analysis"), "no_analysis": ~c("has_analysis"),
        "has_enrichment": c("has_enrichment"), "no_enrichment": ~c("has_enrichment"),
        "analysis_and_risk": c("has_analysis") & c("risk"), "long_term_unverified": c("long_term") & ~c("verified"),
    }


def _when(condition: str | None, value: Column) -> Column:
    return value if condition is None else F.when(_conditions()[condition], value)


def with_text_values(rows: DataFrame) -> DataFrame:
    """Struct ``t`` of display texts used by the templates, plus links."""
    api = c("license").isNotNull() & (c("license") != "NOASSERTION")
    hint = F.when(c("has_analysis"), F.trim(F.coalesce("license_hint", F.lit("")))).otherwise(F.lit(""))
    present = F.array_join(F.array_compact(F.array(*[
        F.when(c(f"ind_{n}"), F.lit(n)) for n, _ in READINESS_WEIGHTS])), ", ")
    missing = F.array_join(F.array_compact(F.array(*[
        F.when(~F.coalesce(c(f"ind_{n}"), F.lit(False)), F.lit(n)) for n in ("license", "tests", "ci", "docs")])), ", ")
    coverage = F.array_join(F.array_compact(F.array(
        F.lit("repository facts"), F.when(c("observed"), "exact growth"), F.when(c("has_analysis"), "current inspection"),
        F.when(c("has_enrichment"), "bound profile"), F.when(c("verified"), "persistence"))), ", ")
    text = {
        "stars": N.thousands(c("stars")), "forks": N.thousands(c("forks")),
        "pushed_day": T.day_text(F.coalesce("pushed_ts", "captured_ts")), "created_day": T.day_text(c("created_ts")),
        "growth_label": c("growth_label"), "growth_kind": c("growth_kind"),
        "attention": c("attention").cast("string"), "momentum": c("momentum").cast("string"),
        "endurance": c("endurance").cast("string"), "readiness": c("readiness").cast("string"),
        "completeness": c("completeness").cast("string"), "term_count": c("term_count").cast("string"),
        "query_count": c("query_count").cast("string"), "obs_count": c("obs_count").cast("string"),
        "obs_window": c("obs_window").cast("string"),
        "coverage_pct": F.concat(F.bround(c("obs_count") * 100.0 / c("obs_window"), 0).cast("int").cast("string"), F.lit("%")),
        "scanned_files": N.thousands(F.coalesce("scanned_files", F.lit(0))),
        "test_files": F.coalesce("test_files", F.lit(0)).cast("string"),
        "confidence": F.coalesce("confidence", F.lit(0)).cast("string"),
        "present": F.when(present == "", F.lit("no main material")).otherwise(present),
        "missing_text": F.when(missing == "", F.lit("Main material is complete.")).otherwise(
            F.concat(F.lit("Not found: "), missing, F.lit("."))),
        "coverage": coverage, "hint": hint,
        "enr_summary": F.coalesce("enr_evidence_summary", F.lit("Profile from the readme and inspection.")),
    }
    rows = rows.withColumn("t", F.struct(*[v.alias(k) for k, v in text.items()]))
    default = F.concat(F.lit("https://github.com/"), c("repo"))
    rows = rows.withColumn("safe_link", safe_url(c("url"), default))
    return (
        rows.withColumn("api_url", F.concat(F.lit("https://api.github.com/repos/"), c("repo")))
        .withColumn("enr_link", safe_url(c("enr_source_url"), c("safe_link")))
        .withColumn("license_display", (
            F.when(api, c("license")).when(hint != "", F.concat(hint, F.lit(" (static hint)"))).otherwise("to verify")))
        .withColumn("language_display", F.coalesce(F.nullif(c("language"), F.lit("")), F.lit("unspecified"))))


def with_narrative(rows: DataFrame) -> DataFrame:
    """Title, description, category, terms, why-now and risk text, with a current profile on top."""
    api_missing = c("license").isNull() | (c("license") == "NOASSERTION")
    r = texts.RISK_TEXTS
    fill = {k: _fill(v) for k, v in r.items()}
    stale = c("has_payload") & ~c("has_analysis")
    risk_text = (
        F.when(c("risk"), fill["risk"])
        .when(api_missing & stale, fill["stale_license"])
        .when(api_missing & (c("t.hint") != ""), fill["hint_license"])
        .when(api_missing & c("has_analysis"), fill["none_license"])
        .when(api_missing, fill["unknown_license"])
        .when(c("has_analysis"), fill["inspected"]).when(stale, fill["stale"]).otherwise(fill["facts_only"]))
    limitation = F.trim(F.coalesce("enr_limitation", F.lit("")))
    risk_text = (
        F.when(c("has_enrichment") & (limitation != ""), F.concat(limitation, F.lit(" "), risk_text))
        .when(c("has_profile") & ~c("has_enrichment"), F.concat(
            F.when(~c("has_analysis"), F.lit(r["profile_without_inspection"])).otherwise(F.lit(r["profile_outdated"])), risk_text))
        .otherwise(risk_text))
    why = F.concat(*[F.coalesce(_when(cond, _fill(t)), F.lit("")) for cond, t in texts.WHY_NOW])
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.replace(t, F.lit("-"), F.lit(" ")))
    language = F.when(F.coalesce(c("language"), F.lit("")) != "", F.array(F.concat(c("language"), F.lit(" project")))).otherwise(
        F.array().cast("array<string>"))
    own_caps = X.distinct_head(F.concat(F.array("base_category"), topics, language))
    own_terms = X.distinct_head(F.concat(F.array("base_category"), c("terms"), topics))
    rows = rows.withColumns({"own_capabilities": own_caps, "own_task_terms": own_terms})

    def profile(field, own):
        value = F.nullif(c(f"enr_{field}"), F.lit(""))
        return F.when(c("has_enrichment"), F.coalesce(value, own)).otherwise(own)

    no_description = F.lit("No public description yet; inspect before judging what it does.")
    hypothesis = F.concat(F.lit("Placed in "), c("base_category"), F.lit(" with "), c("term_count").cast("string"),
                          F.lit(" productivity terms; match it against a concrete task next."))
    enr_caps = F.when(F.size("enr_capabilities") > 0, c("enr_capabilities")).otherwise(c("own_capabilities"))
    enr_terms = X.distinct_head(F.concat(c("own_task_terms"), F.coalesce("enr_task_terms", F.array().cast("array<string>"))))
    return rows.withColumns({
        "why_now": why, "risk_text": risk_text, "title": profile("title", F.substring_index("repo", "/", -1)),
        "project_description": profile("summary", F.coalesce(F.nullif(c("description"), F.lit("")), no_description)),
        "category": profile("category", c("base_category")), "fit_hypothesis": profile("best_for", hypothesis),
        "reuse_plan": profile("reuse_plan", F.lit("Read the readme and the inspection first, then decide on an isolated trial.")),
        "capabilities": F.when(c("has_enrichment"), enr_caps).otherwise(c("own_capabilities")),
        "task_terms": F.when(c("has_enrichment"), enr_terms).otherwise(c("own_task_terms")),
        "captured_label": T.display_label(c("captured_ts"))})


def with_explanations(rows: DataFrame) -> DataFrame:
    """Five score structs and the evidence list."""
    scores = {"attention": c("attention"), "endurance": c("endurance"), "engineering_readiness": c("readiness"),
              "reuse_fit": F.lit(None).cast("int"), "evidence_completeness": c("completeness")}

    def lines(dim, kind):
        found = [_when(cond, _fill(t)) for d, k, cond, t in texts.EXPLANATION_LINES if (d, k) == (dim, kind)]
        return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")

    structs = []
    for dim in texts.DIMENSIONS:
        summary = F.coalesce(*[_when(cond, _fill(t)) for d, cond, t in texts.SUMMARIES if d == dim])
        structs.append(F.struct(
            scores[dim].alias("score"), summary.alias("summary"), lines(dim, "fact").alias("facts"),
            lines(dim, "proxy").alias("proxies"), lines(dim, "limitation").alias("limitations"),
            lines(dim, "condition").alias("upgrade_conditions")).alias(dim))
    evidence = F.array_compact(F.array(*[
        _when(cond, F.struct(F.lit(label).alias("label"), _fill(detail).alias("detail"), c(link).alias("href")))
        for label, cond, detail, link in texts.EVIDENCE_LINES]))
    return rows.withColumn("score_explanations", F.struct(*structs)).withColumn("evidence", evidence)


# --- order --------------------------------------------------------------------------------
def base_order() -> list:
    return [F.desc("attention"), F.desc(F.coalesce("readiness", F.lit(-1))), F.desc("stars"), F.asc("ord")]


def catalog_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("a catalog has at least one row")
    return limit


def balanced_order(rows: DataFrame, limit: int = 30, key: str = "capture_id") -> DataFrame:
    """First positions per capture: up to two lasting and three recent projects, then the base order.

    A project stands once in the base order of its kind, recent or other, and a lasting one that fits in a list by endurance
    too.  One window ranks these lists, and Spark drops what cannot be among the first ``limit + 5`` of a list before rows
    move, so a capture of any size sends that many rows a task.  The windows over a whole capture see the heads of its
    lists only; the heads of both kinds hold the head of all.  ``canonical`` is unique in a capture.
    """
    keep = catalog_limit(limit)
    fit = F.coalesce((c("heat_track") == "long_term") & (c("attention") >= 60) & (c("recommendation") != "watch"), F.lit(False))
    kind = F.when(c("heat_track") == "recent_momentum", "recent").otherwise("other")
    lists = F.when(fit, F.array(kind, F.lit("lasting"))).otherwise(F.array(kind))
    lasting_first = F.desc(F.when(c("_list") == "lasting", c("endurance")))
    ranked = (rows.withColumn("_list", F.explode(lists))
              .withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_list").orderBy(lasting_first, *base_order())))
              .filter(c("_rank") <= keep + DAILY_SIZE))
    pick = ((c("_list") == "lasting") & (c("_rank") <= DAILY_LONG_TERM)) | ((c("_list") == "recent") & (c("_rank") <= DAILY_RECENT))
    project = Window.partitionBy(key, "canonical")
    heads = (ranked.filter((c("_list") != "lasting") | (c("_rank") <= DAILY_LONG_TERM)).repartition(key)
             .withColumn("_picked", F.max(pick).over(project))
             .withColumn("_copy", F.row_number().over(project.orderBy("_list"))).filter(c("_copy") == 1))
    whole, by_base = Window.partitionBy(key), Window.partitionBy(key).orderBy(*base_order())
    free = by_base.rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.sum(c("_picked").cast("int")).over(whole)
    heads = (heads.withColumn("_base", F.row_number().over(by_base)).withColumn("_filler", F.sum((~c("_picked")).cast("int")).over(free))
             .withColumn("daily", c("_picked") | (c("_filler") <= DAILY_SIZE - chosen)))
    final = Window.partitionBy(key).orderBy(F.desc("daily"), "_base")
    return (heads.withColumn("position", F.row_number().over(final)).filter(c("position") <= keep)
            .drop("_list", "_rank", "_picked", "_copy", "_base", "_filler"))


# --- whole job ------------------------------------------------------------------------------
def scored_snapshot(snapshot, captures, evidence=None, enrichment=None) -> DataFrame:
    return with_scores(with_artifacts(with_growth(snapshot, captures), evidence, enrichment))


def told_catalog(snapshot, captures, evidence=None, enrichment=None, limit: int = 30) -> DataFrame:
    """Ranked catalog rows with their narrative fields; texts are built for the kept rows only."""
    ranked = balanced_order(scored_snapshot(snapshot, captures, evidence, enrichment), limit)
    ranked = ranked.withColumn("terms", X.hits(repository_text(), PRODUCTIVITY_TERMS))
    return with_narrative(with_text_values(with_growth_labels(with_profile_texts(ranked, enrichment))))


def build_catalog(snapshot, captures, evidence=None, enrichment=None, limit: int = 30) -> DataFrame:
    """Ranked, explained catalog rows of every capture."""
    return with_explanations(told_catalog(snapshot, captures, evidence, enrichment, limit))


def analysis_targets(snapshot, captures, top_n: int = 5) -> DataFrame:
    """Repositories worth inspecting, from a catalog without evidence."""
    return balanced_order(scored_snapshot(snapshot, captures), top_n).select("capture_id", "position", "repo")


def analysis_failures(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Targets without an evidence row."""
    done = evidence.select(canonical(c("repository")).alias("_c")).distinct()
    return (targets.join(done, canonical(targets["repo"]) == done["_c"], "left_anti")
            .withColumn("error", F.lit("static inspection returned no evidence")))


def catalog_summary(catalog: DataFrame, source_counts: DataFrame) -> DataFrame:
    """One row per capture: counts, daily tracks, pending deep work, growth mode and notice."""
    daily = c("position") <= DAILY_SIZE
    pending = F.when(daily & (c("analysis_state") != "deep"), F.struct("position", "repo"))
    agg = catalog.groupBy("capture_id").agg(
        F.count("*").alias("project_count"),
        F.count_if(c("analysis_state") == "deep").alias("deep_count"),
        F.array_sort(F.collect_list(pending)).alias("_pending"),
        F.count_if(daily & (c("heat_track") == "long_term")).alias("daily_long_term"),
        F.count_if(daily & (c("heat_track") == "recent_momentum")).alias("daily_recent"),
        F.count_if(c("long_term_evidence") == "multi_snapshot").alias("verified_long_term"),
        F.count_if(c("observed")).alias("observed_count"),
        F.max("obs_window").alias("snapshot_count"), F.max("captured_label").alias("captured_label"))
    agg = agg.join(source_counts, "capture_id", "left")
    mode = (F.when(c("observed_count") == c("project_count"), "observed")
            .when(c("observed_count") > 0, "mixed_observation").otherwise("first_observation_proxy"))
    failures = F.coalesce("query_failure_count", F.lit(0))
    notice = F.concat(
        F.lit("Capture of "), c("captured_label"), F.lit(": "), c("project_count").cast("string"), F.lit(" of "),
        c("source_count").cast("string"), F.lit(" candidates. "),
        F.when(mode == "observed", "Growth is observed.").when(
            mode == "mixed_observation", F.concat(c("observed_count").cast("string"), F.lit(" projects have observed growth.")))
        .otherwise("Growth is a lifetime rate."),
        F.when(failures > 0, F.concat(F.lit(" "), failures.cast("string"), F.lit(" recall rules failed."))).otherwise(F.lit("")),
        F.lit(" Daily five: "), c("daily_long_term").cast("string"), F.lit(" long-term. "),
        F.when(c("verified_long_term") > 0, F.concat(c("verified_long_term").cast("string"), F.lit(" verified over captures.")))
        .otherwise(F.concat(F.lit("Structural proxies after "), c("snapshot_count").cast("string"), F.lit(" captures."))))
    return (agg.withColumn("growth_mode", mode).withColumn("query_failure_count", failures).withColumn("notice", notice)
            .withColumn("pending_deep", F.transform("_pending", lambda p: p["repo"])).drop("_pending"))


def evidence_base_score(attention: Column, readiness: Column) -> Column:
    return F.when(readiness.isNull(), attention.cast("double")).otherwise(attention * 0.58 + readiness * 0.42)


def catalog_facets(catalog: DataFrame) -> DataFrame:
    """Categories per capture in first-seen order."""
    first = catalog.groupBy("capture_id", "category").agg(F.min("position").alias("first_position"), F.count("*").alias("n"))
    return first.withColumn("facet_no", F.row_number().over(Window.partitionBy("capture_id").orderBy("first_position")))


def catalog_views(catalog: DataFrame) -> DataFrame:
    """Serving figures: daily and candidate sizes, observed, deep and mean known readiness."""
    facets = catalog_facets(catalog).groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.struct("facet_no", "category"))).alias("_f"))
    figures = catalog.groupBy("capture_id").agg(
        F.count_if(c("position") <= DAILY_SIZE).alias("daily_count"), F.count_if(c("position") > DAILY_SIZE).alias("candidate_count"),
        F.count_if(c("observed")).alias("observed_count"), F.count_if(c("analysis_state") == "deep").alias("deep_count"),
        N.half_up_0(F.avg("readiness")).alias("average_readiness"))
    return figures.join(facets, "capture_id").withColumn("facets", F.transform("_f", lambda f: f["category"])).drop("_f")


def explained_dimensions(catalog: DataFrame) -> DataFrame:
    """One row per (project, dimension) with every field of its explanation."""
    dims = F.array(*[F.struct(F.lit(dim).alias("dimension"), c(f"score_explanations.{dim}").alias("of")) for dim in texts.DIMENSIONS])
    return catalog.select("capture_id", "repo", F.explode(dims).alias("x")).select("capture_id", "repo", "x.dimension", "x.of.*")


def explanation_rows(catalog: DataFrame) -> DataFrame:
    """Long form: one row per (project, dimension, kind, line)."""
    names = {"facts": "fact", "proxies": "proxy", "limitations": "limitation", "upgrade_conditions": "condition"}
    cells = F.array(*[
        F.struct(F.lit(dim).alias("dimension"), F.lit(kind).alias("kind"), c(f"score_explanations.{dim}.{field}").alias("lines"))
        for dim in texts.DIMENSIONS for field, kind in names.items()])
    return (catalog.select("capture_id", "position", "repo", F.explode(cells).alias("x"))
            .select("capture_id", "position", "repo", "x.dimension", "x.kind", F.posexplode("x.lines").alias("line_no", "text")))


def normalize_legacy_catalog(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Version-tagged rows to the canonical score columns; unknown versions go to the error table."""
    valid = c("schema_version").isin(1, 2, 3) & ((c("schema_version") != 3) | ((c("project_id_version") == 1) & (c("project_id") != "")))
    valid = F.coalesce(valid, F.lit(False)) & F.coalesce(
        F.when(c("schema_version") == 1, c("global_score").between(0, 100)).otherwise(c("attention_score").between(0, 100)), F.lit(False))
    v1 = c("schema_version") == 1
    good = rows.filter(valid).select(
        "capture_id", "repo", "schema_version",
        F.when(v1, "legacy-v1").otherwise("evidence-v2").alias("score_model"),
        F.when(v1, c("global_score")).otherwise(c("attention_score")).alias("attention"),
        c("endurance_score").alias("endurance"),
        F.when(~v1, c("readiness_score")).alias("readiness"),
        F.when(~v1, c("completeness_score")).alias("completeness"),
        F.when(v1 & c("recommendation").isin("trial", "reuse"), "sandbox_trial").otherwise(c("recommendation")).alias("recommendation"))
    bad = rows.filter(~valid).select("capture_id", "repo", "schema_version", F.lit("unsupported_catalog_row").alias("error"))
    return good, bad
