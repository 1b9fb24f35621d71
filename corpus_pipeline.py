"""The corpus pipeline: reject poor and toxic documents, keep one of each group of near duplicates, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm import mixing, ngram_join, packing, quality, toxicity
from beaconry.llm.common import stored, table

#: Near duplicates share shingles of five words with a Jaccard similarity of at least 0.8.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose blended score calls them good."""
    model = quality.fit_from(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("score >= 0.5").select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression evidence does not call them toxic."""
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; rows without an id belong to no group.

    Rows that share an id are one document, so one of them stays: the longest text, then by digest of the text and of the
    whole row, so reruns agree.  Empty and null texts are groups of their own.  An empty table stays empty.
    """
    groups = ngram_join.near_duplicates(docs, NEAR_WIDTH, NEAR_PERCENT)
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    rows = docs.join(kept, "doc_id")
    several = rows.filter("_rows > 1").withColumn("_row", F.struct(*docs.columns))
    order = F.struct(F.length("text"), F.sha2("text", 256), F.sha2(F.to_json("_row"), 256))
    chosen = several.groupBy("doc_id").agg(F.max_by("_row", order).alias("_row")).select("_row.*")
    return rows.filter("_rows = 1").select(*docs.columns).union(chosen.select(*docs.columns)).union(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a document that the mix took twice is packed twice."""
    return packing.packed(docs)[1].withColumnRenamed("item", "piece_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor), ("toxicity", reject_toxic), ("near_duplicates", one_of_each_group), ("mix", mix_sources), ("pack", pack)]

#: Two stages are trained classifiers, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).drop("piece_id")
