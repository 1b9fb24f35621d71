"""Task search: many queries against the catalog of their generation.

Matching never pairs every query with every project.  Rule terms are matched once per project, distinct query
tokens once per project through three-letter keys, and both indexes join back to the queries on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.constants import DEFAULT_CAPABILITIES, INTENT_RULES
from beaconry.functions.numeric import half_up_0
from beaconry.functions.text import distinct_head, has_any, query_tokens, search_normal

c = F.col
GRAM = 3


def query_intents(queries: DataFrame) -> DataFrame:
    """Matched rules, suggested capabilities and tokens of each query."""
    rows = queries.withColumn("_n", search_normal(c("text")))
    matched = {label: has_any(c("_n"), words) for label, words, _, _ in INTENT_RULES}
    rules = F.array_compact(F.array(*[F.when(m, F.lit(label)) for label, m in matched.items()]))
    empty = F.array().cast("array<string>")
    offered = F.flatten(F.array(*[
        F.when(matched[label], F.array(*[F.lit(x) for x in caps])).otherwise(empty) for label, _, caps, _ in INTENT_RULES]))
    default = F.array(*[F.lit(x) for x in DEFAULT_CAPABILITIES])
    return (rows.withColumn("rules", rules).withColumn("_caps", F.array_distinct(offered))
            .withColumn("capabilities", F.when(F.size("_caps") > 0, c("_caps")).otherwise(default))
            .withColumn("tokens", query_tokens(c("text"))).drop("_n", "_caps"))


def haystacks(catalog: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "repo", "title", "description", "category", "fit_hypothesis", "reuse_plan", "capabilities", "task_terms")
    evidence = F.when(c("analysis_state") == "deep", 10).when(c("analysis_state") == "static", 6).otherwise(2)
    ready = F.when(c("readiness").isNull(), 0).otherwise(half_up_0(c("readiness") * 0.06))
    return catalog.select("generation_id", "position", "project_slug", "attention", "analysis_state", "heat_label",
                          search_normal(text).alias("haystack"), (evidence + ready).alias("base"))


def rule_index(hay: DataFrame) -> DataFrame:
    """(generation, rule) -> projects with points and the first two terms found."""
    cells = []
    for i, (label, _, _, terms) in enumerate(INTENT_RULES):
        found = F.array_compact(F.array(*[F.when(F.contains(c("haystack"), search_normal(F.lit(t))), F.lit(t)) for t in terms]))
        cells.append(F.struct(F.lit(i).alias("rule_no"), F.lit(label).alias("rule"), found.alias("terms")))
    rows = hay.select("generation_id", "position", F.explode(F.array(*cells)).alias("x")).select("generation_id", "position", "x.*")
    n = F.size("terms")
    return rows.filter(n > 0).withColumn("points", 10 + F.least(F.lit(12), (n - 1) * 4)).withColumn(
        "terms", F.slice("terms", 1, 2))


def _pieces(text: Column, n: int) -> Column:
    """All pieces of ``n`` letters of a text, none of a shorter one."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def token_index(tokens: DataFrame, hay: DataFrame) -> DataFrame:
    """(generation, token) -> positions whose text contains the token; distinct tokens only.

    Each piece that some token holds has a list of its projects, no longer than the catalog of a generation.  A token
    takes the shortest of its lists only, and none if one of its pieces occurs nowhere.  Candidates gather per project,
    where the text is read once for all of them.
    """
    vocabulary = tokens.select("generation_id", "token").distinct().withColumn("_t", search_normal(c("token")))
    held = F.when(F.length("_t") < GRAM, F.array("_t")).otherwise(F.array_distinct(_pieces(c("_t"), GRAM)))
    asked = vocabulary.select("generation_id", "token", "_t", F.explode(held).alias("_gram"))
    grams = F.array_distinct(F.flatten(F.array(*[_pieces(c("haystack"), n) for n in range(1, GRAM + 1)])))
    blocks = hay.select("generation_id", "position", F.explode(grams).alias("_gram"))
    lists = (blocks.join(asked.select("generation_id", "_gram").distinct(), ["generation_id", "_gram"], "left_semi")
             .groupBy("generation_id", "_gram").agg(F.collect_list("position").alias("_at")))
    rarest = (asked.join(lists, ["generation_id", "_gram"], "left").groupBy("generation_id", "token", "_t")
              .agg(F.min(F.struct(F.coalesce(F.size("_at"), F.lit(0)).alias("n"), c("_at").alias("at"))).alias("_least"))
              .filter(c("_least.n") > 0))
    found = (rarest.select("generation_id", F.explode("_least.at").alias("position"), F.struct("token", "_t").alias("_ask"))
             .groupBy("generation_id", "position").agg(F.collect_list("_ask").alias("_asked")))
    met = found.join(hay.select("generation_id", "position", "haystack"), ["generation_id", "position"])
    return (met.select("generation_id", "position", F.explode(F.filter("_asked", lambda x: F.contains(c("haystack"), x["_t"]))).alias("_hit"))
            .select("generation_id", c("_hit.token").alias("token"), "position"))


def project_match(intents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Score and reasons of every (query, project) with a rule or token hit.

    Pairs that are not listed share the project's base score, which ``base_match`` gives once per generation.
    """
    hay = haystacks(catalog)
    rules = intents.select("query_id", "generation_id", F.explode("rules").alias("rule"))
    by_rule = rules.join(rule_index(hay), ["generation_id", "rule"]).select(
        "query_id", "generation_id", "position", "points",
        F.struct("rule_no", F.concat(c("rule"), F.lit(": "), F.array_join("terms", ", ")).alias("text")).alias("rule_hit"),
        F.lit(None).cast("struct<token_no:int,token:string>").alias("token_hit"))
    tokens = intents.select("query_id", "generation_id", F.posexplode("tokens").alias("token_no", "token"))
    by_token = tokens.join(token_index(tokens, hay), ["generation_id", "token"]).select(
        "query_id", "generation_id", "position", F.lit(0).alias("points"),
        F.lit(None).cast("struct<rule_no:int,text:string>").alias("rule_hit"), F.struct("token_no", "token").alias("token_hit"))
    # One group is one query and one project: at most eight rules and the distinct tokens of the query.
    pairs = by_rule.unionByName(by_token).groupBy("query_id", "generation_id", "position").agg(
        F.sum("points").alias("_points"), F.count("token_hit").alias("_tokens"),
        F.array_sort(F.collect_list("rule_hit")).alias("_rules"), F.slice(F.array_sort(F.collect_list("token_hit")), 1, 2).alias("_first"))
    rows = pairs.join(hay.drop("haystack"), ["generation_id", "position"])
    score = F.least(F.lit(54), c("_points")) + F.least(F.lit(20), c("_tokens") * 5) + c("base")
    direct = F.concat(F.lit("direct: "), F.array_join(F.transform("_first", lambda x: x["token"]), ", "))
    reasons = F.concat(F.transform("_rules", lambda x: x["text"]), F.array_compact(F.array(F.when(c("_tokens") > 0, direct), c("analysis_state"))))
    return rows.select("query_id", "generation_id", "position", "project_slug", "attention",
                       F.least(F.lit(100), score).cast("int").alias("score"), distinct_head(reasons, 3).alias("reasons"))


def base_match(catalog: DataFrame, k: int) -> DataFrame:
    """Best projects of a generation when nothing matches."""
    order = Window.partitionBy("generation_id").orderBy(F.desc("base"), F.desc("attention"), "position")
    return (haystacks(catalog).withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
            .select("generation_id", "position", "project_slug", "attention", "rank", c("base").alias("score"),
                    F.array("analysis_state").alias("reasons")))


def search_topk(intents: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """Best matches per query; queries without a match get the base order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("attention"), "position")
    strong = (project_match(intents, catalog).withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
              .withColumn("strong", F.lit(True)))
    missed = intents.select("query_id", "generation_id").join(strong.select("query_id").distinct(), "query_id", "left_anti")
    weak = missed.join(base_match(catalog, k), "generation_id").withColumn("strong", F.lit(False))
    return strong.unionByName(weak)


def search_default(catalog: DataFrame) -> DataFrame:
    """Rows shown without a query."""
    return catalog.filter("position <= 3").select(
        "generation_id", "position", "project_slug", F.array("heat_label", "analysis_state").alias("reasons"))
