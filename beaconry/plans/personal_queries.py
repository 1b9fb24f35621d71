"""Registered queries for personal ranking and task search."""

from pyspark.sql import functions as F

from beaconry.operators import personal as P
from beaconry.operators import search as Q
from beaconry.plans.common import Tables, joined


def current(t: Tables):
    return P.valid_feedback(t.served_feedback, t.served_catalog)


def features(t: Tables):
    return P.project_features(t.served_catalog)


def scores(t: Tables):
    return P.feature_scores(current(t), features(t))


def adjusted(t: Tables):
    return P.adjusted(current(t), t.served_catalog, features(t))


def intents(t: Tables):
    return Q.query_intents(t.search_queries)


QUERIES = {
    "valid_feedback": current,
    "project_features": lambda t: features(t).select("generation_id", "project_slug", "feature_no", "feature", "label", "n_features"),
    "preference_profile": lambda t: P.preference_profile(scores(t)).select("device_id", "position", "feature", "score"),
    "affinity": lambda t: P.affinity(scores(t), features(t)).select(
        "device_id", "project_slug", F.round("affinity", 6).alias("affinity"), joined("liked")),
    "direct_adjustment": lambda t: adjusted(t).select("device_id", "project_slug", "direct"),
    "ranking_reasons": lambda t: adjusted(t).select("device_id", "project_slug", joined("reasons")),
    "personal_ranking": lambda t: P.personal_ranking(adjusted(t)).select("device_id", "rank", "project_slug", "score", "base_score", "adjustment"),
    "balanced_personal_ranking": lambda t: P.recommendations(t.served_feedback, t.served_catalog).select(
        "device_id", "position", "project_slug", "score"),
    "cold_start": lambda t: P.cold_start(t.devices, current(t), t.served_catalog).select(
        "device_id", "position", "project_slug", "score", "adjustment", "reason"),
    "query_intents": lambda t: intents(t).select("query_id", joined("rules"), joined("capabilities"), joined("tokens")),
    "project_match": lambda t: Q.project_match(intents(t), t.served_catalog).select("query_id", "position", "score"),
    "match_reasons": lambda t: Q.project_match(intents(t), t.served_catalog).select("query_id", "position", joined("reasons")),
    "search_topk": lambda t: Q.search_topk(intents(t), t.served_catalog).select("query_id", "rank", "project_slug", "score", "strong"),
    "search_topk_compact": lambda t: Q.search_topk(intents(t), t.served_catalog, 3).select("query_id", "rank", "project_slug"),
    "search_default": lambda t: Q.search_default(t.served_catalog).withColumn("reasons", F.array_join("reasons", "|")),
}
