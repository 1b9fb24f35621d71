"""History and generations on storage: reruns, refused generations, attempts cut short, empty tables."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from beaconry.operators import catalog as C
from beaconry.plans.common import Tables
from beaconry.sources import writers as W
from beaconry.sources.bindings import LOGICAL, SparkSql, bind

CAPTURES = "captured_at string, repo string, stars long"
ROWS = "id long, generation_id string, value string"


def captures(spark, *rows):
    return spark.createDataFrame(list(rows), CAPTURES)


def read(spark, root):
    return sorted((r.captured_at, r.repo, r.stars) for r in W.history(spark, root, CAPTURES).collect())


def test_archived_captures_never_change(spark, tmp_path):
    root = str(tmp_path / "history")
    assert read(spark, root) == []
    W.write_history(captures(spark, ("2024-01-01T00:00:00Z", "a", 1), ("2024-01-01T00:00:00Z", "b", 2), (None, "c", 3)), root)
    first = [("2024-01-01T00:00:00Z", "a", 1), ("2024-01-01T00:00:00Z", "b", 2)]
    assert read(spark, root) == first
    W.write_history(captures(spark, ("2024-01-01T00:00:00Z", "a", 99), ("2024-01-02T00:00:00Z", "a", 5)), root)
    W.write_history(captures(spark), root)
    assert read(spark, root) == [*first, ("2024-01-02T00:00:00Z", "a", 5)]


def test_attempt_without_manifest_is_replaced(spark, tmp_path):
    root = str(tmp_path / "history")
    W.write_history(captures(spark, ("2024-01-01T00:00:00Z", "a", 1)), root)
    lost = captures(spark, ("2024-01-02T00:00:00Z", "a", 7), ("2024-01-03T00:00:00Z", "a", 8))
    W._replace(lost, f"{root}/rows", "captured_at")  # rows written, manifest not
    assert read(spark, root) == [("2024-01-01T00:00:00Z", "a", 1)]
    W.write_history(captures(spark, ("2024-01-02T00:00:00Z", "b", 9)), root)
    assert read(spark, root) == [("2024-01-01T00:00:00Z", "a", 1), ("2024-01-02T00:00:00Z", "b", 9)]


def publish(spark, root, name, values, faults, time):
    rows = spark.createDataFrame([(i, "clash", v) for i, v in enumerate(values)], ROWS)
    issues = spark.createDataFrame([(s, "code") for s in faults], "severity string, code string")
    W.write_generation({"things": rows, "none": rows.limit(0)}, name, root, issues, time)


def current(spark, root):
    return sorted((r.generation_id, r.value) for r in W.read_current(spark, root, "things", spark.createDataFrame([], ROWS).schema).collect())


def test_only_accepted_generations_become_current(spark, tmp_path):
    root = str(tmp_path / "generations")
    assert current(spark, root) == []
    publish(spark, root, "g1", "ab", ["warning"], 1)
    assert current(spark, root) == [("g1", "a"), ("g1", "b")]
    publish(spark, root, "g2", "x", ["error", "warning", "error"], 2)
    assert current(spark, root) == [("g1", "a"), ("g1", "b")]
    publish(spark, root, "g1", "zz", [], 9)  # accepted ones stay as they are
    assert current(spark, root) == [("g1", "a"), ("g1", "b")]
    publish(spark, root, "g2", "cd", [], 3)  # a refused one may be written anew
    assert current(spark, root) == [("g2", "c"), ("g2", "d")]
    got = sorted((r.generation_id, r.table_name, r.row_count, r.error_count, r.accepted, r.current) for r in W.manifest(spark, root).collect())
    assert got == [("g1", "none", 0, 0, True, False), ("g1", "things", 2, 0, True, False), ("g2", "none", 0, 0, True, True), ("g2", "things", 2, 0, True, True)]


def test_other_read_errors_are_not_taken_for_an_empty_history(spark, tmp_path):
    with pytest.raises(AnalysisException):
        W._read(spark, str(tmp_path), "no type at all").select(F.col("missing")).collect()


class PlainSql(SparkSql):
    """Spark's text without the shared rows and without the choice of last quarters."""
    latest = ""


def test_quarters_of_parts_are_written_once(spark, tmp_path):
    day = lambda y, m: datetime(y, m, 3, 5)
    parts = [(k, f"{a} {b}", "Brand#1", "SMALL TIN", k) for k, (a, b) in enumerate([("blue", "rod"), ("red", "gear"), ("new", "bolt")])]
    parts += [parts[0], (7, None, "Brand#2", None, 3), (None, "hot ring", "Brand#3", "X", 1)]
    lines = [(p, float(q + 1), day(1996 + q // 4, 3 * (q % 4) + 1), "A", "F") for p in (0, 1, 1, 2, 7, None) for q in range((p or 0) % 5 + 1)]
    lines += [(1, 2.0, None, "N", "O"), (9, 1.0, day(1997, 2), None, "O")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_shipdate timestamp, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = Tables(spark, str(tmp_path))
    for name in ("repo_snapshot", "static_evidence", "project_enrichment"):
        alone = spark.sql(LOGICAL[name](PlainSql(str(tmp_path))))
        shared = bind(spark, str(tmp_path), name, tables._stored)
        assert "lineitem" not in shared._jdf.queryExecution().toString()
        assert Counter(map(str, shared.collect())) == Counter(map(str, alone.collect())) and alone.columns == shared.columns
    assert len(tables._folders) == 1


class RowByRowSql(SparkSql):
    """Spark's text with names cut once for each row."""

    def named_parts(self):
        return self.t("part")

    def part_word(self, i):
        return self.word("p_name", i)


def test_names_are_cut_once_a_part(spark, tmp_path):
    # A name of one word is refused where its second word is read, and only there.
    parts = [(1, "blue rod", "Brand#1", "TIN", 1), (2, "red gear x", "Brand#2", None, 2), (2, "red gear x", "Brand#2", None, 2), (3, None, "Brand#3", "X", 3),
             (115, "single", "Brand#1", "X", 4), (4, "alone", "Brand#1", "X", 4), (None, "hot ring", "Brand#3", "X", 1)]
    lines = [(p, 1.0, datetime(1996 + y, 2, 3), "A", "F") for p in (1, 2, 3, 115, None) for y in range(2)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_shipdate timestamp, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    once, each = (spark.sql(LOGICAL["repo_snapshot"](kind(str(tmp_path)))) for kind in (SparkSql, RowByRowSql))
    assert Counter(map(str, once.collect())) == Counter(map(str, each.collect())) and once.columns == each.columns and once.count() == 10
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Join")] and "split(" in plan[plan.index("Join"):]


def test_scores_need_no_list_of_terms_and_are_compiled(spark, tmp_path):
    rows = [(f"o/{name}", text, k) for k, (name, text) in enumerate([("agent-cli", "a tool"), ("x", None), ("video", "视频 video video")])]
    snapshot = (spark.createDataFrame(rows, "repo string, description string, ord long").selectExpr(
        "'c' AS capture_id", "repo", "description", "array('sdk') AS topics", "ord", "10L AS stars", "1L AS forks", "'2024-01-01T00:00:00Z' AS created_at",
        "'2024-01-02T00:00:00Z' AS pushed_at", "'A' AS candidate_query", "'MIT' AS license"))
    scored = C.scored_snapshot(snapshot, spark.createDataFrame([("c", "2024-02-01T00:00:00Z")], "capture_id string, captured_at string"))
    assert all(r.term_count == len(r.terms) for r in scored.select("terms", "term_count").collect())
    assert sorted(r.term_count for r in scored.collect()) == [1, 3, 4]
    assert "lambdafunction" not in scored.select("attention", "endurance")._jdf.queryExecution().optimizedPlan().toString()
    Tables(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_further_rows_of_a_repository_in_a_capture_are_left_out(spark):
    rows = [("c1", "o/a", 5), ("c1", "O/A", 9), ("c1", "o/A", 9), ("c2", "o/a", 4), ("c2", "o/b", 1), ("c2", None, 1)]
    snapshot = spark.createDataFrame(rows, "capture_id string, repo string, stars long").selectExpr("*", "'2024-01-01T00:00:00Z' AS created_at", "'2024-01-02T00:00:00Z' AS pushed_at")
    heads = spark.createDataFrame([("c1", "2024-02-01T00:00:00Z"), ("c2", "2024-03-01T00:00:00Z")], "capture_id string, captured_at string")
    grown = C.with_growth(snapshot, heads)
    assert sorted((r.capture_id, r.repo, r.growth_value, r.obs_count) for r in grown.collect())[:2] == [("c1", "O/A", 0, 1), ("c2", "o/a", -5, 2)]
    assert grown.count() == 3 and "WindowGroupLimit" not in grown._jdf.queryExecution().optimizedPlan().toString()
