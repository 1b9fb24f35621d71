"""All registered queries by name."""

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beaconry.plans.common import Tables

MODULES = ["catalog_queries", "evidence_queries", "signal_queries", "action_queries", "personal_queries", "audit_queries", "finding_queries", "document_queries", "stream_queries"]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for module in MODULES:
        for name, build in importlib.import_module(f"beaconry.plans.{module}").QUERIES.items():
            found[name] = lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir))
    return found
