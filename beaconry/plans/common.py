"""Shared pieces of the registered queries."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.sources import audit_bindings, document_samples  # noqa: F401  (add their projections)
from beaconry.sources.bindings import bind


def prepare(spark: SparkSession) -> None:
    """Session settings the jobs rely on: UTC instants, and no generated method too large for the JVM to compile.

    HotSpot interprets methods above 8,000 bytes; scoring was one of them.  Spark then generates it in smaller parts.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names; only a local master may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="beaconry-")


def written(rows: DataFrame) -> DataFrame:
    """Rows written once to the checkpoint folder, for results that several steps read."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.checkpoint()


# Logical tables that a deployment reads from storage and that several steps of a query read.
STORED = {"audit_headers", "served_catalog", "captures", "static_evidence", "project_enrichment"}


class Tables:
    """Logical tables of one data folder, bound on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark, self.sf_dir, self._seen, self._folders = spark, sf_dir, {}, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            rows = bind(self.spark, self.sf_dir, name, self._stored)
            self._seen[name] = written(rows) if name in STORED else rows
        return self._seen[name]

    def _stored(self, sql: str) -> str:
        """Folder of the rows of a text that several tables share, written on first use."""
        if sql not in self._folders:
            folder = f"{shared_dir(self.spark).rstrip('/')}/shared-{uuid.uuid4().hex}"
            # Small row groups: the work on a row is far above its bytes, and a group is one task.
            self.spark.sql(sql).write.option("parquet.block.size", 16 << 20).parquet(folder)
            self._folders[sql] = folder
        return self._folders[sql]

    def filed(self, name: str, build) -> DataFrame:
        """A derived table written on first use as files, whose size Spark then knows when it chooses joins."""
        if name not in self._seen:
            folder = f"{shared_dir(self.spark).rstrip('/')}/{name.strip('_')}-{uuid.uuid4().hex}"
            build().write.parquet(folder)
            self._seen[name] = self.spark.read.parquet(folder)
        return self._seen[name]

    def once(self, name: str, build) -> DataFrame:
        """A derived table written on first use."""
        if name not in self._seen:
            self._seen[name] = written(build())
        return self._seen[name]


def joined(name: str):
    """Array column as text for comparison."""
    return F.array_join(name, "|").alias(name)
