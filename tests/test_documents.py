"""Contracts of JSON documents: every named fault breaks what the checking table says, nothing else does."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from beaconry.operators import documents as D
from beaconry.operators.document_contracts import CONTRACTS
from beaconry.plans.common import Tables
from beaconry.sources.document_samples import SAMPLES, texts
from oracle.documents import EXPECTED, IDENTITIES, UNREADABLE

PROJECT = "acme-tool-77--" + hashlib.sha256(b"acme/tool-77").hexdigest()[:20]


def filled(text):
    return text.replace("@id", PROJECT).replace("@n", "77")


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(kind, f"{kind} {name}", filled(text)) for kind in SAMPLES for name, text in texts(kind)]
    rows += [("poem", "odd kind", "{}"), (None, "no kind", "{}"), ("catalog", "no body", None), ("catalog", "empty", ""), ("catalog", "list", "[]"), ("current-generation", "null", "null")]
    return spark.createDataFrame([(*row, "x", 1) for row in rows], "kind string, key string, body string, path string, i int")


def collected(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.key, []).append((r.path, r.rule, r.message))
    return {k: sorted(v) for k, v in out.items()}


def test_every_fault(documents):
    got = collected(D.document_issues(documents, CONTRACTS))
    want = {f"{kind} {name}": sorted(tuple(map(filled, i)) for i in issues) for kind in SAMPLES for name, issues in (EXPECTED[kind] | UNREADABLE).items()}
    odd = {"odd kind": "unknown_kind", "no kind": "unknown_kind", "no body": "unreadable", "empty": "unreadable"}
    assert {k: v for k, v in got.items() if k in want} == want
    assert {k: v[0][1] for k, v in got.items() if k in odd} == odd
    assert set(got) == set(want) | set(odd) | {"list", "null"}
    assert got["list"] == got["null"] == [("/", "type", "must be an object")]
    assert set(SAMPLES) == set(CONTRACTS) and sum(len(f) for f in EXPECTED.values()) > 110


def test_identities(documents):
    for kind, check in (("catalog", D.catalog_identity_issues), ("codex-queue", D.queue_identity_issues)):
        got = collected(check(documents.filter(f"kind = '{kind}'")))
        assert got == {f"{kind} {name}": [tuple(map(filled, i)) for i in issues] for name, issues in IDENTITIES[kind].items()}


def test_long_lists_carry_their_positions(spark):
    sample = json.loads(filled(texts("project-enrichment")[0][1]))
    sample["taskTerms"] = [f"t{k}" for k in range(127)] + [""]
    row = D.document_issues(spark.createDataFrame([("project-enrichment", 1, json.dumps(sample))], "kind string, key int, body string"), CONTRACTS).collect()
    assert [(r.key, r.path, r.rule) for r in row] == [("1", "/taskTerms/127", "min_length")]


def test_rules_ask_no_value_for_its_type_on_every_row():
    """``get``, ``flatten`` and ``transform`` around nested rules walk all that is below them for each row."""
    inner = D.Object({"n": D.Number(0, 9), "t": D.Text(1, 9, kind="time")})
    for _ in range(4):
        inner = D.Object({"a": D.Items(inner), "b": inner})
    text = D.together(inner.issues(D.Value("document")))
    assert "flatten(" not in text and "get(transform(" not in text and "array_compact(" not in text


def test_texts_are_not_read_as_numbers(spark):
    """A failing cast costs more than all rules; numbers are read where the type is one, with the same issues."""
    rule = D.Object({"n": D.Number(0, 9), "t": D.Text(2), "o": D.OneOf(("a", 5))})
    text = D.together(D.Text(2, 5).issues(D.Value("document")))
    assert "'double'" not in text
    rows = spark.createDataFrame([(0, '{"n":1,"t":"ab","o":5}'), (1, '{"n":"1","t":3,"o":"5"}'), (2, '{"n":1.5,"t":"a","o":"a"}'), (3, '{"n":10,"t":null,"o":[5]}'), (4, '{"n":2}')],
                                 "key int, body string").selectExpr("'k' AS kind", "key", "body")
    got = {(r.key, r.path, r.rule) for r in D.document_issues(rows, {"k": rule}).collect()}
    assert got == {("1", "/n", "type"), ("1", "/t", "type"), ("1", "/o", "enum"), ("2", "/n", "type"), ("2", "/t", "min_length"), ("3", "/n", "maximum"), ("3", "/t", "type"), ("3", "/o", "enum"),
                   ("4", "/", "required")}


def test_documents_of_one_small_file_are_many_tasks(spark, tmp_path):
    spark.range(1, 400).selectExpr("id AS p_partkey", "'name' AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    bodies = Tables(spark, str(tmp_path)).documents_catalog
    assert bodies.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    # What parses a body stays above the step that spreads the rows.
    plan = D.catalog_identity_issues(bodies)._jdf.queryExecution().executedPlan().toString()
    assert all("parse_json" not in part for part in plan.split("REPARTITION_BY_NUM")[1:])
