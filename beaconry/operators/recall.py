"""Candidate recall: rules, hit normalisation, merge across rules, health and snapshot order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import HITS_PER_RULE
from beaconry.functions.timefns import strict_time
from beaconry.operators.skew import exact_position

# Recall rules: name, date column, days back (None = the since_days parameter), minimum stars, topic.
RULES = [
    ("new", "created_at", None, 25, None),
    ("active_week", "pushed_at", 7, 500, None),
    ("maintained", "pushed_at", 90, 5000, None),
    ("productivity_maintained", "pushed_at", 90, 1000, "productivity"),
    ("devtools_maintained", "pushed_at", 90, 2000, "developer-tools"),
    ("productivity_week", "pushed_at", 7, 50, "productivity"),
    ("ai_week", "pushed_at", 7, 100, "artificial-intelligence"),
    ("devtools_week", "pushed_at", 7, 100, "developer-tools"),
    ("self_hosted_week", "pushed_at", 7, 100, "self-hosted"),
]

RAW_ITEM_SCHEMA = """full_name STRING, html_url STRING, description STRING, owner STRUCT<login: STRING>,
  language STRING, license STRUCT<spdx_id: STRING>, topics ARRAY<STRING>, stargazers_count BIGINT, forks_count BIGINT,
  open_issues_count BIGINT, created_at STRING, updated_at STRING, pushed_at STRING, default_branch STRING"""


def recall_rules(facts: DataFrame, since_days: int = 14, per_rule: int = HITS_PER_RULE) -> DataFrame:
    """Rows each rule recalls at each capture, best ``per_rule`` by stars (first seen on ties)."""
    if since_days < 1 or per_rule < 1:
        raise ValueError("since_days and per_rule start at 1")
    since = since_days
    day = {c: F.to_date(F.substring(F.col(c), 1, 10)) for c in ("created_at", "pushed_at")}
    captured = F.to_date(strict_time(F.col("captured_at")))

    def passes(rule):
        name, column, back, stars, topic = rule
        test = (day[column] >= F.date_sub(captured, since if back is None else back)) & (F.col("stars") >= stars)
        if topic:
            test = test & F.array_contains("topics", topic)
        return F.when(test, F.lit(name))

    hits = (facts.filter(~F.col("archived") & ~F.col("fork"))
            .withColumn("rule", F.explode(F.array_compact(F.array(*[passes(r) for r in RULES])))))
    best = Window.partitionBy("capture_id", "rule").orderBy(F.desc("stars"), "ord")
    # A small row_number filter is trimmed on the map side, so a hot capture stays cheap.
    return (hits.withColumn("item_ord", F.row_number().over(best)).filter(F.col("item_ord") <= per_rule))


def normalize_repo_items(raw: DataFrame) -> DataFrame:
    """Flatten nested API items; missing counters are 0 and missing topics empty."""
    item = F.from_json("item", RAW_ITEM_SCHEMA)
    return raw.withColumn("_i", item).select(
        "capture_id", "rule", "query_ord", "item_ord",
        F.col("_i.full_name").alias("repo"), F.col("_i.html_url").alias("url"),
        F.col("_i.description").alias("description"), F.col("_i.owner.login").alias("owner"),
        F.col("_i.language").alias("language"), F.col("_i.license.spdx_id").alias("license"),
        F.coalesce(F.col("_i.topics"), F.array().cast("array<string>")).alias("topics"),
        F.coalesce(F.col("_i.stargazers_count"), F.lit(0)).alias("stars"),
        F.coalesce(F.col("_i.forks_count"), F.lit(0)).alias("forks"),
        F.coalesce(F.col("_i.open_issues_count"), F.lit(0)).alias("open_issues"),
        F.col("_i.created_at").alias("created_at"), F.col("_i.updated_at").alias("updated_at"),
        F.col("_i.pushed_at").alias("pushed_at"), F.col("_i.default_branch").alias("default_branch"))


def merge_candidates(hits: DataFrame) -> DataFrame:
    """One row per (capture, repository): the first hit supplies the fields, rules are listed sorted."""
    arrival = F.struct("query_ord", "item_ord")
    carried = [c for c in hits.columns if c not in ("capture_id", "repo", "rule", "query_ord", "item_ord")]
    merged = (
        hits.filter("repo IS NOT NULL AND repo <> ''").groupBy("capture_id", "repo")
        .agg(F.min_by(F.struct(*carried), arrival).alias("_f"), F.min(arrival).alias("_o"),
             F.array_join(F.array_sort(F.collect_set("rule")), " | ").alias("candidate_query")))
    return merged.select(
        "capture_id", "repo", *[F.col(f"_f.{c}").alias(c) for c in carried], "candidate_query",
        F.col("_o.query_ord").alias("first_query_ord"), F.col("_o.item_ord").alias("first_item_ord"))


def query_health(hits: DataFrame, attempts: DataFrame) -> DataFrame:
    """State and item count of each rule tried."""
    counts = hits.groupBy("capture_id", F.col("rule").alias("query")).agg(F.count("*").alias("n"))
    return attempts.join(counts, ["capture_id", "query"], "left").select(
        "capture_id", "query",
        F.when(F.col("error").isNull(), "healthy").otherwise("failed").alias("state"),
        F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("item_count"),
        "error")


def capture_header(query_runs: DataFrame) -> DataFrame:
    """Totals per capture; captures without a healthy rule are rejected."""
    return (query_runs.groupBy("capture_id").agg(
        F.count_if(F.col("state") == "healthy").alias("successful_query_count"),
        F.count_if(F.col("state") == "failed").alias("failed_query_count"))
        .withColumn("accepted", F.col("successful_query_count") > 0))


def rank_snapshot(snapshot: DataFrame) -> DataFrame:
    """Position by stars, then pushed_at text, both descending, first seen first.

    Buckets are the star count and the push day, so a capture of any size is
    ranked by many tasks and only the bucket sizes meet in one place.
    """
    pushed = F.coalesce("pushed_at", F.lit(""))
    day = F.substring(pushed, 1, 10)
    return exact_position(
        snapshot, ["capture_id"], [F.desc("stars"), F.desc(pushed), F.asc("ord")],
        [F.col("stars"), day], [F.desc("_b0"), F.desc("_b1")])


def append_history(history: DataFrame, capture: DataFrame) -> DataFrame:
    """History plus a capture, keeping the rows of captures that are already archived."""
    new = capture.join(history.select("captured_at").distinct(), "captured_at", "left_anti")
    return history.unionByName(new, allowMissingColumns=True)
