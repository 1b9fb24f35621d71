"""Registered queries for the signal job and raw payload intake."""

from pyspark.sql import functions as F

from beaconry.operators import signals as S
from beaconry.plans.common import Tables, joined
from beaconry.sources import intake


def windowed(t: Tables):
    return S.signal_window(t.signals_raw)


def scored(t: Tables):
    return S.with_score(windowed(t))


def ranked(t: Tables, limit: int = 30):
    return S.build_signals(t.signals_raw, limit)


def overlay(t: Tables):
    return S.enrichment_overlay(ranked(t), t.signal_enrichment)


def health(t: Tables):
    return S.source_health(t.source_attempts, scored(t))


def load_documents(t: Tables):
    """Payload documents as JSON text read through the permissive reader schema."""
    text = F.col("body")
    parsed = F.from_json(text, "tag_name STRING, html_url STRING, published_at STRING, score DOUBLE, _corrupt STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = t.raw_payloads.select("run_id", "source", "format", parsed.alias("d")).select("run_id", "source", "format", "d.*")
    good, bad = intake.split_documents(rows, ["score"])
    return good.select("run_id", "source", "format", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("run_id", "source", "format", "reason"))


QUERIES = {
    "signal_window": lambda t: windowed(t).select("run_id", "ord", "kind", "title", "url"),
    "signal_relevance": lambda t: t.signals_raw.select("run_id", "ord", F.round(S.relevance(F.col("title")), 6).alias("relevance")),
    "official_score": lambda t: scored(t).filter("kind = 'official'").select("run_id", "ord", "score"),
    "aggregated_score": lambda t: t.signals_raw.select("run_id", "ord", S.aggregated_score(F.col("importance")).alias("score")),
    "rank_score": lambda t: t.signals_raw.select("run_id", "ord", S.rank_score(F.col("rank")).alias("score")),
    "signal_id": lambda t: t.signals_raw.select("run_id", "ord", S.signal_id(F.col("kind"), F.col("url")).alias("id")),
    "canonical_signal_url": lambda t: t.signals_raw.select("run_id", "ord", S.canonical_url(F.col("url")).alias("url_key")),
    "merge_signals": lambda t: S.merge_signals(scored(t)).select(
        "run_id", "url_key", "ord", "score", "arrivals", "url", "repo", "reported_daily_growth", "kind", "title", "source", "source_url",
        "published_at", "id", joined("sources"), joined("evidence")),
    "rank_signals": lambda t: ranked(t).select("run_id", "position", "id", "kind", "score", "top"),
    "source_health": lambda t: health(t),
    "signal_summary": lambda t: S.signal_summary(ranked(t), health(t)),
    "signal_enrichment_overlay": lambda t: overlay(t).select(
        "run_id", "position", "url", "enriched", "complete_but_stale", "shown_title", "shown_category"),
    "signal_digest": lambda t: S.signal_digest(overlay(t)),
    "extract_feed_entries": lambda t: intake.extract_feed_entries(t.raw_payloads),
    "extract_brief_items": lambda t: intake.extract_brief_items(t.raw_payloads).withColumn("sources", F.array_join("sources", "|")),
    "extract_rank_table": lambda t: intake.extract_rank_table(t.raw_payloads),
    "extract_release_signal": lambda t: intake.extract_release_signal(t.raw_payloads),
    "payload_state": lambda t: intake.payload_state(t.raw_payloads),
    "load_documents": load_documents,
}
