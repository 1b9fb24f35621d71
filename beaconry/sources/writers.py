"""History and generations on storage.

Each capture and each generation has a partition of its own, and a row in a manifest that is written last.  What has no
manifest row does not count: an attempt that was cut short leaves no trace for readers and is replaced by the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
HISTORY_MANIFEST = "captured_at STRING, row_count BIGINT"
MANIFEST = "generation_id STRING, published_us BIGINT, table_name STRING, row_count BIGINT, error_count BIGINT, accepted BOOLEAN"


def _read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of a folder, none if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace(rows: DataFrame, folder: str, key: str) -> None:
    """Write the partitions of the rows' keys anew; AQE deals each key over as many files as its size asks for."""
    (rows.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder))


def history(spark: SparkSession, root: str, schema) -> DataFrame:
    """Rows of all archived captures."""
    done = _read(spark, f"{root}/manifest", HISTORY_MANIFEST)
    return _read(spark, f"{root}/rows", schema).join(done.select("captured_at").distinct(), "captured_at", "left_semi")


def write_history(rows: DataFrame, root: str) -> None:
    """Archive the captures that are not archived yet; archived ones never change.

    Rows without a capture time belong to no capture and are left out.
    """
    spark = rows.sparkSession
    done = _read(spark, f"{root}/manifest", HISTORY_MANIFEST).select("captured_at").distinct()
    wanted = rows.filter("captured_at IS NOT NULL").join(done, "captured_at", "left_anti")
    _replace(wanted, f"{root}/rows", "captured_at")
    stored = _read(spark, f"{root}/rows", rows.schema).join(done, "captured_at", "left_anti")
    # Only captures of this call: a partition that another attempt left behind is no part of it.
    mine = stored.join(rows.select("captured_at").distinct(), "captured_at", "left_semi")
    mine.groupBy("captured_at").agg(F.count("*").alias("row_count")).write.mode("append").parquet(f"{root}/manifest")


def write_generation(tables: dict[str, DataFrame], generation_id: str, root: str, issues: DataFrame, published_us: int) -> None:
    """Write the tables of a generation, then its manifest with the audit's verdict.

    ``issues`` holds a row for each fault found, with ``severity`` if some are only warnings.  A generation with an error
    is recorded as refused and does not become current.  An accepted generation never changes, so a rerun of it does
    nothing; any other rerun replaces the generation's own partitions alone.
    """
    spark = issues.sparkSession
    if not _read(spark, f"{root}/manifest", MANIFEST).filter((c("generation_id") == generation_id) & c("accepted")).isEmpty():
        return
    for name, rows in tables.items():
        _replace(rows.withColumn("generation_id", F.lit(generation_id)), f"{root}/{name}", "generation_id")
    errors = issues.filter("severity = 'error'") if "severity" in issues.columns else issues
    found = errors.agg(F.count("*").alias("error_count"))
    counts = None
    for name, rows in tables.items():
        count = generation_rows(spark, root, name, rows.schema, generation_id).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = count if counts is None else counts.unionByName(count)
    manifest = (counts.join(F.broadcast(found)).select(  # one row
        F.lit(generation_id).alias("generation_id"), F.lit(published_us).cast("bigint").alias("published_us"), "table_name", "row_count", "error_count",
        (c("error_count") == 0).alias("accepted")))
    _replace(manifest, f"{root}/manifest", "generation_id")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each table of each generation, with ``current``: of the accepted ones the last published."""
    rows = _read(spark, f"{root}/manifest", MANIFEST)
    last = rows.filter("accepted").agg(F.max(F.struct("published_us", "generation_id")).alias("m")).select(c("m.generation_id").alias("_last"))
    return rows.join(F.broadcast(last)).withColumn("current", F.coalesce(c("generation_id") == c("_last"), F.lit(False))).drop("_last")


def generation_rows(spark: SparkSession, root: str, name: str, schema, generation_id: str) -> DataFrame:
    """Rows of one table of one generation, whatever its verdict; only its partition is read."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "generation_id")
    return _read(spark, f"{root}/{name}", f"{kept}, generation_id STRING").filter(c("generation_id") == generation_id)


def read_current(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Rows of the current generation of a table, none if no generation was accepted."""
    found = manifest(spark, root).filter("current").select("generation_id").first()
    return generation_rows(spark, root, name, schema, found.generation_id if found else "")
