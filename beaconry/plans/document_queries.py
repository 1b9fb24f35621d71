"""Registered queries for contracts of whole JSON documents."""

from pyspark.sql import functions as F

from beaconry.operators import documents as D
from beaconry.operators.document_contracts import CONTRACTS
from beaconry.plans.common import Tables


def table(kind: str) -> str:
    return "documents_" + kind.replace("-", "_")


def issues(t: Tables, kind: str):
    return D.document_issues(getattr(t, table(kind)), {kind: CONTRACTS[kind]}).drop("kind")


def drafts(t: Tables):
    """Profile drafts of every part and signal drafts of every page; each thirteenth one is of no known kind."""
    rows = t.documents_project_enrichment.withColumn("draft", F.lit("project")).unionByName(t.documents_signal_enrichment.withColumn("draft", F.lit("signal")))
    return rows.withColumn("draft", F.when(F.col("key").cast("int") % 13 == 5, "poem").otherwise(F.col("draft")))


QUERIES = {f"contract_{kind.replace('-', '_')}": lambda t, kind=kind: issues(t, kind) for kind in CONTRACTS} | {
    "catalog_identity_contract": lambda t: D.catalog_identity_issues(t.documents_catalog),
    "ingested_drafts": lambda t: D.ingested(drafts(t), CONTRACTS)[0].select("draft", "key", "target"),
    "rejected_drafts": lambda t: D.ingested(drafts(t), CONTRACTS)[1],
    "queue_identity_contract": lambda t: D.queue_identity_issues(t.documents_codex_queue),
}
