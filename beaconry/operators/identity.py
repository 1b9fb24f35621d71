"""Stable repository identity: canonical names, ids, carried-id checks and collisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.constants import (
    PROJECT_ID_LENGTHS, PROJECT_ID_PATTERN, PROJECT_ID_VERSION, REPOSITORY_PATTERN)


def repository_error(repo: Column) -> Column:
    return (
        F.when(repo.isNull(), F.lit("invalid_repository_type"))
        .when(~repo.rlike(REPOSITORY_PATTERN), F.lit("invalid_repository_format")))


def canonical(repo: Column) -> Column:
    """Lower-case ``owner/name`` or null when the name is not exact."""
    return F.when(repo.rlike(REPOSITORY_PATTERN), F.lower(repo))


def project_id(repo: Column) -> Column:
    name = canonical(repo)
    prefix = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    prefix = F.regexp_replace(F.substring(prefix, 1, 64), "-+$", "")
    return F.concat(prefix, F.lit("--"), F.substring(F.sha2(name, 256), 1, 20))


def legacy_slug(repo: Column) -> Column:
    slug = F.regexp_replace(F.replace(canonical(repo), F.lit("/"), F.lit("--")), "[^a-z0-9-]+", "-")
    return F.regexp_replace(slug, "^-+|-+$", "")


def carried_error(repo: Column, carried_id: Column, version: Column) -> Column:
    """First failing check of a carried identity, or null."""
    low, high = PROJECT_ID_LENGTHS
    well_formed = carried_id.isNotNull() & F.length(carried_id).between(low, high) & carried_id.rlike(PROJECT_ID_PATTERN)
    return (
        F.when(repository_error(repo).isNotNull(), repository_error(repo))
        .when(version.isNull() | (version != PROJECT_ID_VERSION), F.lit("unsupported_project_id_version"))
        .when(~F.coalesce(well_formed, F.lit(False)), F.lit("invalid_project_id"))
        .when(carried_id != project_id(repo), F.lit("project_id_mismatch")))


def canonical_repository(names: DataFrame, col: str = "repository") -> DataFrame:
    return names.withColumn("canonical", canonical(F.col(col))).withColumn("error", repository_error(F.col(col)))


def project_identity(names: DataFrame, col: str = "repository") -> DataFrame:
    return canonical_repository(names, col).withColumn("project_id", project_id(F.col(col)))


def validate_carried_identity(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "error", carried_error(F.col("repository"), F.col("project_id"), F.col("project_id_version")))


def identity_uniqueness(names: DataFrame, scope: str = "capture_id", col: str = "repository") -> DataFrame:
    """Duplicate canonical names and ids owned by two names, per set."""
    ids = (names.withColumn("canonical", canonical(F.col(col))).filter("canonical IS NOT NULL")
           .groupBy(scope, "canonical").agg(F.count("*").alias("n"))
           .withColumn("project_id", project_id(F.col("canonical"))))
    duplicates = ids.filter("n > 1").select(
        scope, F.lit("duplicate_normalized_repository").alias("code"), F.col("canonical").alias("key"), "n")
    collisions = (ids.groupBy(scope, "project_id").agg(F.count("*").alias("n")).filter("n > 1")
                  .select(scope, F.lit("project_id_collision").alias("code"), F.col("project_id").alias("key"), "n"))
    return duplicates.unionByName(collisions)


def legacy_slug_collisions(names: DataFrame, scope: str = "capture_id", col: str = "repository") -> DataFrame:
    """Old slugs shared by more than one canonical name."""
    return (names.select(scope, canonical(F.col(col)).alias("canonical"), legacy_slug(F.col(col)).alias("slug"))
            .filter("canonical IS NOT NULL").distinct()
            .groupBy(scope, "slug").agg(F.array_sort(F.collect_list("canonical")).alias("repositories"))
            .filter(F.size("repositories") > 1))
