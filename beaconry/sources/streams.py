"""Driver tables as file streams, shaped by the same projections as the batch tables."""

from pyspark.sql import DataFrame, SparkSession

from beaconry.sources.bindings import LOGICAL, SparkSql


class StreamSql(SparkSql):
    """Renders table names as the streaming view of that table."""

    def t(self, name):
        return f"beaconry_stream_{name}"


def stream(spark: SparkSession, folder: str, table: str, logical: str, pattern: str | None = None) -> DataFrame:
    """Stream of a logical table over the parquet files of one driver table, which is a file or a folder of files."""
    # A stream takes a path that is no pattern for a folder; this pattern finds either.
    files = f"{folder}/{pattern or f'{table}.parque[t]'}"
    rows = spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)
    rows.createOrReplaceTempView(f"beaconry_stream_{table}")
    return spark.sql(LOGICAL[logical](StreamSql(folder)))
