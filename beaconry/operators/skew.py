"""Helpers that keep exact results when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def task_count(spark: SparkSession) -> int:
    """Parts for rows whose work is far above their bytes: several a core, and no fewer than the session's shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(spread: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(n))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, spread: list[str], salts: int = 256) -> DataFrame:
    """First ``k`` rows per key: trimmed inside salted sub-groups first, then across them."""
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt(spread, salts))
        .withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(outer)).filter(F.col("_rank") <= k)
        .drop("_salt", "_rank"))


def exact_position(df: DataFrame, keys: list[str], order: list, bucket: list[Column], bucket_order: list,
                   name: str = "position") -> DataFrame:
    """Full ranking of groups of any size.

    ``bucket`` is a coarse prefix of the sort order.  Rows are numbered inside (key, bucket) and shifted
    by the number of rows in earlier buckets, so no task sorts a whole key.
    """
    cols = [f"_b{i}" for i in range(len(bucket))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(bucket, cols)])
    sizes = rows.groupBy(*keys, *cols).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, *cols).orderBy(*order)
    ranked = rows.withColumn("_in", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*keys, *cols])
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("int"))
        .drop("_in", "_before", *cols))


def previous_value(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str,
                   name: str = "previous") -> DataFrame:
    """``lag`` over groups of any size: inside time buckets, then across the bucket summaries."""
    rows = df.withColumn("_bucket", bucket)
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_prev", F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
        .join(carried, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_bucket", "_prev", "_first", "_carried"))
