"""Technical signals: window, scores, merge by canonical URL, ranking, overlay and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import (
    SIGNAL_AI_TERMS, SIGNAL_KIND_PRIORITY, SIGNAL_MARKETING_TERMS, SIGNAL_PRODUCT_TERMS)
from beaconry.functions.numeric import half_up_0
from beaconry.functions.text import filled, hit_count
from beaconry.functions.timefns import hours_between, strict_time
from beaconry.functions.urls import canonical_url, signal_id, signal_url

c = F.col


def window_hours(hours: Column) -> Column:
    return F.least(F.greatest(hours, F.lit(24)), F.lit(168))


def signal_window(raw: DataFrame) -> DataFrame:
    """Rows with title, safe URL and time inside [now - window, now + 2 h]."""
    now, published = strict_time(c("now_at")), strict_time(c("published_at"))
    age = hours_between(now, published)
    return (
        raw.withColumn("safe", signal_url(c("url"))).withColumn("age_hours", age)
        .filter((F.coalesce("title", F.lit("")) != "") & c("safe").isNotNull()
                & c("age_hours").between(F.lit(-2.0), window_hours(c("window_hours")).cast("double")))
        .withColumn("url", c("safe")).drop("safe"))


def relevance(title: Column) -> Column:
    low = F.lower(title)
    raw = (F.lit(0.24) + hit_count(low, SIGNAL_AI_TERMS) * 0.14 + hit_count(low, SIGNAL_PRODUCT_TERMS) * 0.1
           - hit_count(low, SIGNAL_MARKETING_TERMS) * 0.09)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def official_score(title: Column, age_hours: Column, window: Column) -> Column:
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(age_hours, F.lit(0.0)) / F.greatest(window, F.lit(1)))
    return F.bround(F.least(F.lit(0.99), F.lit(0.58) + recency * 0.14 + relevance(title) * 0.28), 4)


def aggregated_score(*raw: Column) -> Column:
    """First filled value, default 0.5; booleans, text and non-finite numbers give null."""
    first = F.coalesce(*[F.nullif(r, F.lit("")) for r in raw], F.lit("0.5"))
    value = F.when(first.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(first).try_cast("double"))
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    return F.when(value.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(value, F.lit(0.96))), 4))


def rank_score(rank: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.5), F.lit(0.82) - (rank - 1) * 0.025), 4)


RELEASE_SCORE = 0.68


def with_score(rows: DataFrame) -> DataFrame:
    """Score by kind; aggregated rows without a usable score drop out."""
    return rows.withColumn("score", (
        F.when(c("kind") == "official", official_score(c("title"), c("age_hours"), c("window_hours")))
        .when(c("kind") == "aggregated", aggregated_score(c("importance")))
        .when(c("kind") == "ranking", rank_score(c("rank"))).otherwise(F.lit(RELEASE_SCORE)))).filter("score IS NOT NULL")


def priority(kind: Column) -> Column:
    chain = None
    for name, value in SIGNAL_KIND_PRIORITY.items():
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return chain.otherwise(0)


def partial_merge(signals: DataFrame) -> DataFrame:
    """Signals of one (run, canonical URL, source) combined; partial results can be merged again later."""
    lead = F.struct(-priority(c("kind")), c("ord"))
    rows = signals.withColumn("url_key", canonical_url(c("url"))).withColumn("id", signal_id(c("kind"), c("url")))
    return rows.groupBy("run_id", "url_key", "source").agg(
        F.min_by(F.struct("url", "repo", "reported_daily_growth", "sources", "evidence"), "ord").alias("_first"),
        F.min_by(F.struct("kind", "title", "source", "source_url", "published_at", "id"), lead).alias("_head"),
        F.min(lead).alias("_lead"), F.min("ord").alias("_ord"), F.max("ord").alias("_last"),
        F.max("score").alias("score"), F.count("*").alias("arrivals"),
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("_sources"),
        F.array_distinct(F.flatten(F.collect_set("evidence"))).alias("_evidence"))


def final_merge(partials: DataFrame) -> DataFrame:
    merged = partials.groupBy("run_id", "url_key").agg(
        F.min_by("_first", "_ord").alias("_first"), F.min_by("_head", "_lead").alias("_head"), F.min("_ord").alias("ord"),
        F.max("score").alias("score"), F.sum("arrivals").alias("arrivals"),
        F.flatten(F.collect_set("_sources")).alias("_sources"), F.flatten(F.collect_set("_evidence")).alias("_evidence"),
        F.collect_list(F.struct("source", "_last")).alias("_seen"))
    # Names of every arrival but the first.
    names = F.transform(F.filter("_seen", lambda x: x["_last"] > c("ord")), lambda x: x["source"])
    many = c("arrivals") > 1
    return merged.select(
        "run_id", "url_key", "ord", "score", "arrivals", "_first.url", "_first.repo", "_first.reported_daily_growth", "_head.*",
        F.when(many, F.array_sort(F.array_distinct(F.concat("_sources", names)))).otherwise(c("_first.sources")).alias("sources"),
        F.when(many, F.array_sort(F.array_distinct("_evidence"))).otherwise(c("_first.evidence")).alias("evidence"))


def merge_signals(signals: DataFrame) -> DataFrame:
    """One row per (run, canonical URL), built by source first and then by URL.

    Both steps combine on the map side, and the sets keep one copy of each source and evidence name, so a
    URL that arrives very often costs no more than its distinct names.
    """
    return final_merge(partial_merge(signals))


def rank_signals(merged: DataFrame, limit: int = 30) -> DataFrame:
    """Best rows per run by kind, score and time; the first five are the top signals."""
    if limit < 1:
        raise ValueError("a ranking has at least one row")
    order = Window.partitionBy("run_id").orderBy(
        F.desc(priority(c("kind"))), F.desc("score"), F.desc(strict_time(c("published_at"))), F.asc("ord"))
    return (merged.withColumn("position", F.row_number().over(order)).filter(c("position") <= limit)
            .withColumn("top", c("position") <= 5))


def build_signals(raw: DataFrame, limit: int = 30) -> DataFrame:
    return rank_signals(merge_signals(with_score(signal_window(raw))), limit)


def source_health(attempts: DataFrame, accepted: DataFrame) -> DataFrame:
    """State, accepted items and newest item per source; a failed source never hides the others."""
    seen = accepted.groupBy("run_id", "source").agg(F.count("*").alias("n"), F.max("published_at").alias("latest"))
    ok = c("error").isNull()
    return attempts.join(seen, ["run_id", "source"], "left").select(
        "run_id", "source", "source_url", F.when(ok, "healthy").otherwise("failed").alias("state"),
        F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("item_count"),
        F.when(ok, c("latest")).alias("latest_item_at"), "error")


def signal_summary(ranked: DataFrame, health: DataFrame) -> DataFrame:
    counts = ranked.groupBy("run_id").agg(F.count("*").alias("signal_count"), F.count_if(c("top")).alias("top_count"))
    states = health.groupBy("run_id").agg(
        F.count_if(c("state") == "healthy").alias("healthy_source_count"), F.count_if(c("state") == "failed").alias("failed_source_count"))
    return states.join(counts, "run_id", "left").na.fill(0, ["signal_count", "top_count"])


def enrichment_overlay(ranked: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Reviewed texts on top of signals when complete, not older than the item and for the same item time."""
    e = enrichment.select("run_id", "url", c("title").alias("e_title"), c("takeaway").alias("e_takeaway"), c("why").alias("e_why"),
                          c("category").alias("e_category"), c("analyzed_at").alias("e_at"), c("source_published_at").alias("e_source_at"),
                          c("set_generated_at").alias("e_set_at"))
    rows = ranked.join(e, ["run_id", "url"], "left")
    complete = filled(c("e_title")) & filled(c("e_takeaway")) & filled(c("e_why")) & filled(c("e_category"))
    published = strict_time(c("published_at"))
    at = strict_time(F.coalesce("e_at", "e_set_at"))
    same = F.coalesce(c("e_source_at"), F.lit("")).eqNullSafe("") | (strict_time(c("e_source_at")) == published)
    current = F.coalesce(complete & (at >= published) & same, F.lit(False))
    return (rows.withColumn("enriched", current).withColumn("complete_but_stale", F.coalesce(complete, F.lit(False)) & ~current)
            .withColumn("shown_title", F.when(current, c("e_title")).otherwise(c("title")))
            .withColumn("shown_category", F.when(current, c("e_category")).otherwise(c("kind"))))


def signal_digest(overlay: DataFrame) -> DataFrame:
    """Display rows of the top five."""
    return overlay.filter("top").select(
        "run_id", "position", "shown_title", "shown_category", "source", half_up_0(c("score") * 100).alias("score_percent"),
        F.size("sources").alias("source_count"), "enriched", F.when(c("enriched"), c("e_takeaway")).alias("takeaway"))
