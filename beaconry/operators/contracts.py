"""Row contracts: rule tables compiled to Columns, plus identity, header and manifest contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import REPOSITORY_PATTERN
from beaconry.functions.timefns import strict_time
from beaconry.functions.urls import is_http_url
from beaconry.operators.identity import canonical, carried_error, legacy_slug

c = F.col

# column, rule, argument
SNAPSHOT_RULES = [
    ("repo", "required", None), ("repo", "pattern", REPOSITORY_PATTERN), ("url", "http_url", None), ("url", "max_length", 2048),
    ("stars", "required", None), ("stars", "minimum", 0), ("forks", "required", None), ("forks", "minimum", 0),
    ("open_issues", "minimum", 0), ("description", "max_length", 4000), ("license", "min_length", 1), ("license", "max_length", 100),
    ("topics", "unique_items", None), ("topics", "max_items", 100), ("created_at", "required", None), ("created_at", "timestamp", None), ("pushed_at", "required", None), ("pushed_at", "timestamp", None),
    ("candidate_query", "min_length", 1), ("candidate_query", "max_length", 5000),
]
SIGNAL_RULES = [
    ("kind", "enum", ["official", "curated", "ranking", "aggregated"]), ("title", "min_length", 1), ("url", "http_url", None),
    ("score", "required", None), ("score", "finite", None), ("score", "minimum", 0.0), ("score", "maximum", 1.0),
    ("published_at", "required", None), ("published_at", "timestamp", None), ("window_hours", "minimum", 1), ("window_hours", "maximum", 720),
    ("repo", "paired", "reported_daily_growth"), ("repo", "required_if", ("kind", "ranking")), ("evidence", "min_items", 1),
]


def violation(column: str, rule: str, arg) -> Column:
    """True where the row breaks the rule; null values break only ``required`` rules."""
    v = c(column)
    tests = {
        "required": lambda: v.isNull(),
        "minimum": lambda: v < arg, "maximum": lambda: v > arg,
        "min_length": lambda: F.length(v) < arg, "max_length": lambda: F.length(v) > arg,
        "pattern": lambda: ~v.rlike(arg), "enum": lambda: ~v.isin(arg), "const": lambda: v != F.lit(arg),
        "http_url": lambda: ~is_http_url(v), "timestamp": lambda: v.isNotNull() & strict_time(v).isNull(),
        "finite": lambda: F.isnan(v) | (F.abs(v) == float("inf")),
        "unique_items": lambda: F.size(F.array_distinct(v)) < F.size(v), "min_items": lambda: F.size(v) < arg,
        "max_items": lambda: F.size(v) > arg, "paired": lambda: v.isNull() != c(arg).isNull(),
        "required_if": lambda: v.isNull() & (c(arg[0]) == arg[1]),
    }
    return F.coalesce(tests[rule](), F.lit(False))


def contract_issues(rows: DataFrame, kind: str, scope: str, key: Column, rules: list) -> DataFrame:
    """One row per broken rule, from a single scan of the table."""
    found = F.array_compact(F.array(*[
        F.when(violation(col, rule, arg), F.struct(F.lit(f"/{col}").alias("path"), F.lit(rule).alias("rule"))) for col, rule, arg in rules]))
    return (rows.select(c(scope).alias("scope"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.explode(found).alias("i"))
            .select("scope", "kind", "key", "i.path", "i.rule"))


def bounded_report(issues: DataFrame, cap: int | None = None) -> DataFrame:
    """Issues per scope in order; with ``cap``, the first ones and one row that counts the rest."""
    order = Window.partitionBy("scope").orderBy("path", "rule", "key")
    first = issues.withColumn("issue_no", F.row_number().over(order))
    if cap is None:
        return first
    first = first.filter(c("issue_no") <= cap)
    rest = (issues.groupBy("scope").agg(F.count("*").alias("n")).filter(c("n") > cap)
            .select("scope", F.lit("report").alias("kind"), F.concat((c("n") - cap).cast("string"), F.lit(" more")).alias("key"),
                    F.lit("/").alias("path"), F.lit("overflow").alias("rule"), F.lit(cap + 1).alias("issue_no")))
    return first.unionByName(rest)


def identity_contract_issues(files: DataFrame) -> DataFrame:
    """Every broken identity rule of artifact files: expected name, origin, file key, carried id, queue path."""
    repo, expected = c("repository"), c("expected_repository")
    same = (repo == expected) | ((c("schema_version") == 2) & F.coalesce(canonical(repo) == canonical(expected), F.lit(False)))
    stem = F.when(c("schema_version") == 2, c("project_id")).otherwise(legacy_slug(repo))
    carried = F.when(c("schema_version") == 2, carried_error(repo, c("project_id"), c("project_id_version")))
    checks = [
        (~F.coalesce(same, F.lit(False)), "unexpected_repository"), (repo == "local", "local_evidence_committed"),
        (~F.coalesce(stem == c("file_key"), F.lit(False)) & (repo != "local"), "file_key_mismatch"),
        (c("queue_path") != F.concat(F.lit("data/enrichment/"), stem, F.lit(".json")), "queue_path_mismatch"),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in checks], carried))
    return files.select("ord", "repository", F.explode(codes).alias("code"))


def capture_required_fields(headers: DataFrame) -> DataFrame:
    """The newest capture must carry its query-health fields."""
    newest = headers.agg(F.max("captured_at").alias("captured_at"))
    latest = headers.join(newest, "captured_at", "left_semi")
    fields = ["query_status_count", "successful_query_count", "failed_query_count"]
    missing = F.array_compact(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in fields]))
    return latest.select("capture_id", F.explode(missing).alias("field"))


def manifest_contract(artifacts: DataFrame, hashes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifact list and hash keys must agree, and the id must equal its partition."""
    a = artifacts.select("generation_id", "artifact", F.lit(True).alias("_a"))
    h = hashes.select("generation_id", "artifact", F.lit(True).alias("_h"))
    sets = a.join(h, ["generation_id", "artifact"], "full_outer").filter("_a IS NULL OR _h IS NULL").select(
        "generation_id", F.when(c("_a").isNull(), "hash_without_artifact").otherwise("artifact_without_hash").alias("code"), c("artifact").alias("key"))
    ids = manifests.filter("generation_id <> partition_id").select(
        "generation_id", F.lit("generation_partition_mismatch").alias("code"), c("partition_id").alias("key"))
    return sets.unionByName(ids)
