"""Static evidence over a file inventory: which files count, languages, tests, markers, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import (
    DOCKER_NAMES, ENV_EXAMPLE_NAMES, INDICATORS, LICENSE_SIGNATURES, LICENSE_UNRECOGNISED, LOCK_NAMES, MANIFEST_NAMES,
    SKIP_DIRECTORIES, SKIP_SUFFIXES, TEXT_SUFFIXES)
from beaconry.operators.identity import canonical, project_id

c = F.col
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs"]
MARKER = r"(?iU)\b(?:TODO|FIXME|XXX)\b"


def walk_key(path: Column) -> Column:
    """Text that sorts like a walk: files of a folder before its subfolders, both by name."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.lit("1"), p, F.lit("\x01")))
    return F.concat(F.array_join(folders, ""), F.lit("0"), F.element_at(parts, -1))


def suffix_of(name: Column) -> Column:
    """Lower-case suffix with its dot; '' for dotfiles and names without one."""
    return F.regexp_extract(F.lower(name), r"^.+(\.[^.]+)$", 1)


def scan_files(files: DataFrame) -> DataFrame:
    """All files that count, with their place in walk order; no exchange."""
    lower = F.lower("path")
    folders = F.split(F.regexp_replace(lower, r"/?[^/]*$", ""), "/")
    skipped = F.array(*[F.lit(d) for d in SKIP_DIRECTORIES])
    name = F.substring_index("path", "/", -1)
    return (
        files.filter(~c("is_symlink") & ~F.arrays_overlap(folders, skipped))
        .withColumn("suffix", suffix_of(name)).filter(~c("suffix").isin(SKIP_SUFFIXES))
        .withColumn("walk_key", walk_key(c("path"))))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    folder = low.rlike(r"(^|/)(" + "|".join(TEST_DIRS) + r")/")
    return (folder | stem.isin("test", "tests", "spec") | stem.startswith("test_") | stem.rlike(r"_(test|spec)$")
            | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")))


def marker_count(text: Column, suffix: Column) -> Column:
    readable = suffix.isin(TEXT_SUFFIXES) & text.isNotNull()
    return F.when(readable, F.regexp_count(text, F.lit(MARKER))).otherwise(F.lit(0))


def indicator_tests(path: Column) -> dict[str, Column]:
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    return {
        "readme": name.startswith("readme"), "license": name.rlike("^(license|copying)"), "tests": is_test_file(path),
        "ci": low.startswith(".github/workflows/"), "docker": name.isin(DOCKER_NAMES), "dependency_lock": name.isin(LOCK_NAMES),
        "package_manifest": name.isin(MANIFEST_NAMES), "examples": low.rlike("^(examples|example|demo)/"),
        "docs": low.rlike("^(docs|doc)/"), "environment_example": name.isin(ENV_EXAMPLE_NAMES)}


def license_name(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = None
    for label, signature in LICENSE_SIGNATURES:
        test = F.contains(low, F.lit(signature))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(LICENSE_UNRECOGNISED)


def is_root_license(path: Column, symlink: Column) -> Column:
    return ~symlink & ~F.contains(path, F.lit("/")) & F.lower(path).rlike("^(license|copying)")


def license_hints(files: DataFrame) -> DataFrame:
    """Licence named by the first root-level licence file (by path) of each repository."""
    roots = files.filter(is_root_license(c("path"), c("is_symlink")))
    # The text is reduced to a short label before the shuffle.
    labelled = roots.select("repo", "path", license_name(c("text")).alias("hint"))
    return labelled.groupBy("repo").agg(F.min_by("hint", "path").alias("license_hint"))


def language_profile(scanned: DataFrame, top: int = 12) -> DataFrame:
    """Files per suffix, largest first, first seen on ties."""
    label = F.when(c("suffix") == "", "[none]").otherwise(c("suffix"))
    counts = scanned.groupBy("repo", label.alias("suffix")).agg(F.count("*").alias("files"), F.min("walk_key").alias("_first"))
    best = Window.partitionBy("repo").orderBy(F.desc("files"), "_first")
    return counts.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= top).drop("_first")


def file_facts(files: DataFrame) -> DataFrame:
    """Scanned files reduced to the few columns the summary needs; texts never leave the scan."""
    slim = files.select(
        "repo", "path", "is_symlink",
        marker_count(c("text"), suffix_of(F.substring_index("path", "/", -1))).alias("todo"))
    tests = indicator_tests(c("path"))
    return scan_files(slim).select("repo", "path", "suffix", "walk_key", "todo", *[v.alias(k) for k, v in tests.items()])


def evidence_summary(files: DataFrame, analyzed_at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One evidence row per repository; partial aggregation keeps a repository of any size cheap."""
    facts = file_facts(files)
    totals = facts.groupBy("repo").agg(
        F.count("*").alias("scanned_files"), F.count_if(c("tests")).alias("test_files"), F.sum("todo").alias("todo_markers"),
        *[F.bool_or(c(i)).alias(f"ind_{i}") for i in INDICATORS])
    languages = language_profile(facts).groupBy("repo").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "suffix", "files"))),
        lambda x: F.struct(x["suffix"], x["files"]))).alias("language_files"))
    present = sum((c(f"ind_{i}").cast("int") for i in INDICATORS[1:]), c(f"ind_{INDICATORS[0]}").cast("int"))
    confidence = F.least(F.lit(95), 35 + 6 * present + F.least(c("test_files"), F.lit(12))).cast("int")
    warnings = F.array_compact(F.array(
        F.when(~c("ind_license"), F.lit("no license file detected")),
        F.lit("static inspection only; code was not executed")))
    return (
        totals.join(languages, "repo").join(license_hints(files), "repo", "left")
        .withColumn("confidence", confidence).withColumn("warnings", warnings)
        .withColumn("schema_version", F.when(canonical(c("repo")).isNotNull(), 2).otherwise(1))
        .withColumn("project_id", F.when(c("schema_version") == 2, project_id(c("repo"))))
        .withColumn("project_id_version", F.when(c("schema_version") == 2, 1))
        .withColumn("repository", c("repo")).withColumn("analyzed_at", F.lit(analyzed_at)))
