"""Personal ranking for all devices against their published catalog.

Feedback is reduced to one value per (device, project) first, then partitioned by device once; the profile,
affinity and ranking steps all reuse that partitioning.  The catalog of a generation holds at most 100 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import (
    DAILY_LONG_TERM, DAILY_RECENT, DAILY_SIZE, DIRECT_ADJUSTMENTS, FEEDBACK_VALUES, GENERIC_FEATURES, PREFERENCE_WEIGHTS)
from beaconry.functions.numeric import half_up_1
from beaconry.functions.text import feature_normal
from beaconry.operators.catalog import evidence_base_score

c = F.col
EXACT = "decimal(20,12)"  # sums are exact, so they do not depend on the order of rows


def _by_value(value: Column, table: dict[str, float]) -> Column:
    chain = None
    for name, weight in table.items():
        chain = F.when(value == name, F.lit(weight)) if chain is None else chain.when(value == name, F.lit(weight))
    return chain


def valid_feedback(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    """Last valid value per (device, known project)."""
    known = catalog.select("generation_id", "project_slug")
    return (feedback.filter(c("value").isin(FEEDBACK_VALUES)).join(known, ["generation_id", "project_slug"], "left_semi")
            .groupBy("device_id", "generation_id", "project_slug").agg(F.max_by("value", F.struct("at_us", "id")).alias("value")))


def project_features(catalog: DataFrame) -> DataFrame:
    """Distinct features of each project: category, capabilities and task terms."""
    def tagged(prefix, values):
        return F.transform(values, lambda v: F.struct(F.lit(prefix).alias("prefix"), v.alias("raw")))

    every = F.concat(tagged("category", F.array("category")), tagged("capability", c("capabilities")),
                     tagged("task", c("task_terms")))
    rows = catalog.select("generation_id", "project_slug", F.posexplode(every).alias("feature_no", "f"))
    name = feature_normal(c("f.raw"))
    rows = rows.select("generation_id", "project_slug", "feature_no", F.concat_ws(":", "f.prefix", name).alias("feature"),
                       F.trim("f.raw").alias("label"), name.alias("_n"))
    rows = rows.filter((F.length("_n") >= 2) & ~c("_n").isin(GENERIC_FEATURES)).drop("_n")
    one = rows.groupBy("generation_id", "project_slug", "feature").agg(
        F.min("feature_no").alias("feature_no"), F.min_by("label", "feature_no").alias("label"))
    return one.withColumn("n_features", F.count("*").over(Window.partitionBy("generation_id", "project_slug")))


def feature_scores(current: DataFrame, features: DataFrame) -> DataFrame:
    """Weight each device gives each feature."""
    share = (_by_value(c("value"), PREFERENCE_WEIGHTS) / F.sqrt(c("n_features").cast("double"))).cast(EXACT)
    rows = current.repartition("device_id").join(features, ["generation_id", "project_slug"])
    return rows.groupBy("device_id", "generation_id", "feature").agg(
        F.sum(share).alias("score"), F.max("label").alias("label"))


def preference_profile(scores: DataFrame, top: int = 8) -> DataFrame:
    best = Window.partitionBy("device_id").orderBy(F.desc(F.abs("score")), "feature")
    return (scores.withColumn("position", F.row_number().over(best)).filter(c("position") <= top)
            .withColumn("score", half_up_1(c("score").cast("double"))))


def affinity(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Clamped affinity and the two best liked features per (device, project)."""
    known = features.select("generation_id", "project_slug", "feature", "feature_no", c("label").alias("f_label"))
    hits = scores.filter("score <> 0").join(known, ["generation_id", "feature"])
    liked = F.when(c("score") > 0, F.struct((-c("score")).alias("k"), c("feature_no").alias("n"), c("f_label").alias("label")))
    # A project has at most 25 features, so the list stays tiny.
    rows = hits.groupBy("device_id", "generation_id", "project_slug").agg(
        F.sum("score").alias("_sum"), F.count("*").alias("_n"), F.array_sort(F.collect_list(liked)).alias("_liked"))
    raw = c("_sum").cast("double") / F.sqrt(c("_n").cast("double")) * 4.0
    return rows.select("device_id", "generation_id", "project_slug",
                       F.least(F.lit(12.0), F.greatest(F.lit(-12.0), raw)).alias("affinity"),
                       F.transform(F.slice("_liked", 1, 2), lambda x: x["label"]).alias("liked"))


def adjusted(current: DataFrame, catalog: DataFrame, features: DataFrame) -> DataFrame:
    """Every project of a device's catalog with base, affinity, direct adjustment and reasons."""
    current = current.repartition("device_id")
    likes = affinity(feature_scores(current, features), features)
    served = catalog.select("generation_id", "project_slug", "position", "heat_track", "attention", "readiness")
    owners = current.select("device_id", "generation_id").distinct()
    rows = (owners.join(served, "generation_id")
            .join(likes, ["device_id", "generation_id", "project_slug"], "left")
            .join(current, ["device_id", "generation_id", "project_slug"], "left"))
    pull = F.coalesce("affinity", F.lit(0.0))
    direct = F.coalesce(_by_value(c("value"), DIRECT_ADJUSTMENTS), F.lit(0.0))
    reasons = (
        F.when(c("value") == "useless", F.array(F.lit("marked useless, shown less")))
        .when(c("value") == "unsure", F.array(F.lit("marked unsure, kept for review")))
        .when(c("value").isNotNull(), F.array(F.concat(F.lit("marked "), c("value"), F.lit(", similar projects first"))))
        .when(F.size("liked") > 0, F.transform("liked", lambda x: F.concat(F.lit("fits your interest: "), x)))
        .when(pull < 0, F.array(F.lit("close to projects marked useless")))
        .otherwise(F.array(F.lit("base order by attention and readiness"))))
    base = evidence_base_score(c("attention"), c("readiness"))
    return (rows.withColumn("affinity", pull).withColumn("direct", direct)
            .withColumn("score", half_up_1(base + (pull + direct))).withColumn("base_score", half_up_1(base))
            .withColumn("adjustment", half_up_1(pull + direct)).withColumn("reasons", reasons)
            .withColumnRenamed("position", "catalog_position"))


def personal_ranking(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("device_id").orderBy(F.desc("score"), "catalog_position")
    return rows.withColumn("rank", F.row_number().over(order))


def balanced_ranking(ranked: DataFrame) -> DataFrame:
    """Two lasting projects scoring 60 or more and three recent ones first, filled up to five."""
    device = Window.partitionBy("device_id")
    fit = (c("heat_track") == "long_term") & (c("score") >= 60)
    rows = ranked.withColumn("_fit", fit).withColumn("_recent", c("heat_track") == "recent_momentum")
    for flag, name in (("_fit", "_lt"), ("_recent", "_rm")):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("device_id", flag).orderBy("rank")))
    picked = (c("_fit") & (c("_lt") <= DAILY_LONG_TERM)) | (c("_recent") & (c("_rm") <= DAILY_RECENT))
    rows = rows.withColumn("_picked", picked)
    filler = F.sum((~c("_picked")).cast("int")).over(device.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_first", c("_picked") | (filler <= DAILY_SIZE - F.sum(c("_picked").cast("int")).over(device)))
    return (rows.withColumn("position", F.row_number().over(device.orderBy(F.desc("_first"), "rank")))
            .drop("_fit", "_recent", "_lt", "_rm", "_picked", "_first"))


def recommendations(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    current = valid_feedback(feedback, catalog)
    return balanced_ranking(personal_ranking(adjusted(current, catalog, project_features(catalog))))


def cold_start(devices: DataFrame, current: DataFrame, catalog: DataFrame) -> DataFrame:
    """Devices without valid feedback get their catalog in catalog order."""
    cold = devices.join(current.select("device_id").distinct(), "device_id", "left_anti")
    base = half_up_1(evidence_base_score(c("attention"), c("readiness")))
    served = catalog.select(
        "generation_id", "project_slug", "position", base.alias("score"),
        F.when(c("readiness").isNull(), "by attention; readiness unknown").otherwise("by attention and readiness").alias("reason"))
    return cold.join(served, "generation_id").withColumn("adjustment", F.lit(0.0))
