"""Artifact versions: one authority per repository, upgrades and downgrades, overlays and write guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.timefns import strict_time
from beaconry.operators.identity import canonical, carried_error, legacy_slug, project_id

c = F.col


def authoritative_artifact(copies: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Highest version per case-folded repository; ties at that version and ambiguous slugs are errors."""
    payload = [x for x in copies.columns if x != "schema_version"]
    best = (
        copies.withColumn("repository_key", F.lower("repository"))
        .groupBy("repository_key", "schema_version")
        .agg(F.count("*").alias("n"), F.min(F.struct(*payload)).alias("_row"))
        .groupBy("repository_key")
        .agg(F.max_by(F.struct("schema_version", "n", "_row"), "schema_version").alias("_b"))
        .select("repository_key", "_b.schema_version", "_b.n", "_b._row.*"))
    ties = best.filter("n > 1").select("repository_key", F.lit("duplicate_version").alias("error"))
    good = best.filter("n = 1").drop("n")
    if expected is None:
        return good, ties
    shared = (
        expected.select(canonical(c("repository")).alias("_c"), legacy_slug(c("repository")).alias("slug")).filter("_c IS NOT NULL")
        .distinct().groupBy("slug").agg(F.count("*").alias("_n")).filter("_n > 1").select("slug"))
    marked = good.withColumn("slug", legacy_slug(c("repository")))
    ambiguous = marked.filter("schema_version < 2").join(shared, "slug", "left_semi").select("repository_key")
    errors = ties.unionByName(ambiguous.select("repository_key", F.lit("ambiguous_legacy_slug").alias("error")))
    return marked.drop("slug").join(ambiguous, "repository_key", "left_anti"), errors


def upgrade_versions(copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Version 1 rows get an identity and become version 2.

    Returns (row status, totals, converted rows).  A converted row that differs from an existing version 2
    row is a conflict, and any conflict keeps every conversion back.
    """
    body = ["repository", "analyzed_at"]
    new = (copies.filter("schema_version = 1").withColumn("target_id", project_id(c("repository"))))
    existing = (copies.filter("schema_version = 2").groupBy(c("project_id").alias("target_id"))
                .agg(F.min(F.struct(F.lower("repository").alias("repository"), "analyzed_at")).alias("_have")))
    matched = new.join(existing, "target_id", "left")
    same = (c("_have.repository") == F.lower("repository")) & c("_have.analyzed_at").eqNullSafe(c("analyzed_at"))
    status = (
        F.when(c("target_id").isNull(), "invalid_repository").when(c("_have").isNull(), "migrated")
        .when(same, "equivalent").otherwise("conflict"))
    rows = matched.withColumn("status", status).select("ord", "schema_version", *body, "target_id", "status")
    kept = copies.filter("schema_version <> 1").select(
        "ord", "schema_version", *body, c("project_id").alias("target_id"),
        F.when(c("schema_version") == 2, "already_current").otherwise("legacy_unmigrated").alias("status"))
    every = rows.unionByName(kept)
    totals = every.groupBy("status").agg(F.count("*").alias("n"))
    # The gate is a one-row aggregate, broadcast so that the constant key moves no other rows; not a driver decision.
    conflicts = totals.filter("status = 'conflict'").select(c("n").alias("_conflicts"))
    gate = conflicts.agg(F.coalesce(F.sum("_conflicts"), F.lit(0)).alias("conflicts"))
    applied = every.filter("status = 'migrated'").withColumn("one", F.lit(1)).join(
        F.broadcast(gate.withColumn("one", F.lit(1))), "one").filter("conflicts = 0").select(
        F.lit(2).alias("schema_version"), *body, c("target_id").alias("project_id"), F.lit(1).alias("project_id_version"), "ord")
    return every, totals, applied


def downgrade_versions(copies: DataFrame) -> DataFrame:
    """Version 2 rows back to version 1 under the old slug; slugs shared by other names are fatal."""
    named = copies.withColumn("slug", legacy_slug(c("repository"))).withColumn("_c", canonical(c("repository")))
    owners = named.filter("_c IS NOT NULL").groupBy("slug").agg(F.count_distinct("_c").alias("owners"))
    return (named.filter("schema_version = 2").join(owners, "slug", "left")
            .withColumn("status", F.when(c("_c").isNull(), "invalid_repository").when(c("owners") > 1, "slug_collision").otherwise("downgraded"))
            .select("ord", F.lit(1).alias("schema_version"), "repository", "analyzed_at", "slug", "status"))


def overlay_newer(current: DataFrame, staging: DataFrame) -> DataFrame:
    """Staged rows fill gaps; they replace a row only when versioned and strictly newer."""
    cur, new = current.alias("a"), staging.alias("b")
    both = cur.join(new, [c("a.kind") == c("b.kind"), c("a.key") == c("b.key")], "full_outer")
    newer = F.coalesce((c("b.schema_version") >= 1) & (strict_time(c("b.stamp")) > strict_time(c("a.stamp"))), F.lit(False))
    source = F.when(c("a.key").isNull(), "staged_missing").when(newer, "staged_newer").otherwise("current")
    pick = source != "current"

    def value(name):
        return F.when(pick, c(f"b.{name}")).otherwise(c(f"a.{name}")).alias(name)

    return both.select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.key", "b.key").alias("key"),
                       source.alias("source"), value("repository"), value("schema_version"), value("stamp"), value("payload"))


def stale_write_guard(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reject reason per candidate: owned by another repository, or older than the existing row."""
    old = existing.select("kind", "key", c("repository").alias("_repo"), strict_time(c("stamp")).alias("_at"),
                          c("schema_version").alias("_v"))
    joined = candidates.join(old, ["kind", "key"], "left")
    same = (c("repository") == c("_repo")) | (
        (c("schema_version") == 2) & (c("_v") == 2)
        & F.coalesce(canonical(c("repository")) == canonical(c("_repo")), F.lit(False)))
    at = strict_time(c("stamp"))
    reason = (
        F.when(c("_repo").isNull(), F.lit(None))
        .when(~F.coalesce(same, F.lit(False)), "owned_by_other_repository")
        .when(c("_at").isNotNull() & (at.isNull() | (at < c("_at"))), "older_than_existing"))
    return joined.select("kind", "key", "repository", "stamp", reason.alias("reason"), reason.isNull().alias("accepted"))


def ingest_drafts(drafts: DataFrame) -> DataFrame:
    """Profile drafts: accepted only in version 2, with ordered times and a valid identity."""
    written, bound = strict_time(c("analyzed_at")), strict_time(c("source_analysis_at"))
    identity = carried_error(c("repository"), c("project_id"), c("project_id_version"))
    reason = (
        F.when(c("schema_version") != 2, "unsupported_version")
        .when(written.isNull() | bound.isNull(), "invalid_time")
        .when(written < bound, "analyzed_before_source")
        .when(identity.isNotNull(), identity)
        .when(~(F.coalesce(c("summary"), F.lit("")) != ""), "incomplete"))
    return drafts.withColumn("reason", reason).withColumn(
        "target", F.when(reason.isNull(), F.concat(F.lit("enrichment/"), c("project_id"))))
