"""Raw payload bodies and JSON documents as rows.

Feeds, briefs, rank tables and release notes arrive as one text per (run, source).  Bodies are bounded by the
collector, so each is taken apart inside its own row and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions.text import clean_title
from beaconry.functions.timefns import feed_time, iso_text, strict_time
from beaconry.functions.urls import signal_url
from beaconry.operators.signals import RELEASE_SCORE, aggregated_score, rank_score, window_hours

c = F.col

_ENTRY = r"(?s)<(item|entry)(?:\s[^>]*)?>(.*?)</\1>"
ENTRY_SCHEMA = """title STRING, link ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>, pubDate STRING,
  published STRING, updated STRING, date STRING"""
BRIEF_SCHEMA = """items ARRAY<STRUCT<title: STRING, primary_url: STRING, url: STRING, latest_at: STRING, earliest_at: STRING,
  importance_score: STRING, importance: STRING, score: STRING, reasons: ARRAY<STRING>, source_names: ARRAY<STRING>,
  source: STRING, category: STRING, source_count: BIGINT>>"""
RELEASE_SCHEMA = "published_at STRING, html_url STRING, tag_name STRING, name STRING"


def _in_window(rows: DataFrame, published: Column) -> DataFrame:
    now = strict_time(c("fetched_at"))
    hours = window_hours(c("window_hours"))
    age = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(3_600_000_000.0)
    return rows.withColumn("in_window", F.coalesce(age.between(F.lit(-2.0), hours.cast("double")), F.lit(False)))


def extract_feed_entries(payloads: DataFrame) -> DataFrame:
    """Entries of each RSS or Atom body, any namespace prefix."""
    body = F.regexp_replace(c("body"), r"<(/?)[A-Za-z0-9_.-]+:", "<$1")
    body = F.regexp_replace(body, r"(?i)<(/?)pubdate>", "<$1pubDate>")
    entries = F.regexp_extract_all(body, F.lit(_ENTRY), F.lit(2))
    rows = (payloads.filter("format = 'feed'").select(
        "run_id", "source", "fetched_at", "window_hours", F.posexplode(entries).alias("entry_no", "xml"))
        .withColumn("e", F.from_xml(F.concat(F.lit("<r>"), c("xml"), F.lit("</r>")), ENTRY_SCHEMA, {"rowTag": "r"})))
    usable = F.filter("e.link", lambda k: (
        (F.coalesce(k["_href"], F.lit("")) != "") & F.coalesce(k["_rel"], F.lit("alternate")).isin("alternate", ""))
        | F.coalesce(F.trim(k["_VALUE"]), F.lit("")).startswith("http"))
    first = F.get(usable, F.lit(0))
    by_href = (F.coalesce(first["_href"], F.lit("")) != "") & F.coalesce(first["_rel"], F.lit("alternate")).isin("alternate", "")
    link = F.trim(F.when(by_href, first["_href"]).otherwise(first["_VALUE"]))
    when = F.coalesce("e.pubDate", "e.published", "e.updated", "e.date")
    rows = rows.select("run_id", "source", "fetched_at", "window_hours", "entry_no", clean_title(c("e.title")).alias("title"),
                       signal_url(link).alias("url"), feed_time(when).alias("published_ts"))
    return _in_window(rows, c("published_ts")).withColumn("published_at", iso_text(c("published_ts"))).drop("published_ts")


def extract_brief_items(payloads: DataFrame) -> DataFrame:
    """Items of an aggregator document."""
    parsed = F.from_json("body", BRIEF_SCHEMA)["items"]
    rows = payloads.filter("format = 'brief'").select(
        "run_id", "source", "fetched_at", "window_hours", F.posexplode(parsed).alias("item_no", "i"))

    def filled(name):
        return F.nullif(c(f"i.{name}"), F.lit(""))

    names = F.when(F.size("i.source_names") > 0, c("i.source_names")).otherwise(F.array(c("i.source")))
    rows = rows.select(
        "run_id", "source", "fetched_at", "window_hours", "item_no", clean_title(c("i.title")).alias("title"),
        signal_url(F.coalesce(filled("primary_url"), filled("url"))).alias("url"),
        feed_time(F.coalesce(filled("latest_at"), filled("earliest_at"))).alias("published_ts"),
        aggregated_score(c("i.importance_score"), c("i.importance"), c("i.score")).alias("score"),
        F.array_compact(names).alias("sources"))
    return _in_window(rows, c("published_ts")).withColumn("published_at", iso_text(c("published_ts"))).drop("published_ts")


def extract_rank_table(payloads: DataFrame) -> DataFrame:
    """Rows of a Markdown ranking; the dated heading is midnight at UTC+8."""
    pattern = r"\|\s*(\d+)\s*\|\s*\[([^\]]+)\]\((https://github\.com/[^)]+)\)\|\s*([^|]+)\|\s*([^|]+)\|"
    heading = F.regexp_extract(c("body"), r"##\s+(\d{4}\.\d{2}\.\d{2})", 1)
    day = F.try_to_timestamp(F.concat(F.translate(heading, ".", "-"), F.lit("T00:00:00+08:00")))
    groups = [F.regexp_extract_all(c("body"), F.lit(pattern), F.lit(i)).alias(n)
              for i, n in ((1, "rank"), (2, "repo"), (3, "url"), (4, "stars"), (5, "growth"))]
    rows = (payloads.filter("format = 'rank_table'")
            .withColumn("published_ts", F.when(heading != "", day).otherwise(strict_time(c("fetched_at"))))
            .select("run_id", "source", "fetched_at", "window_hours", "published_ts", *groups))
    rows = _in_window(rows, c("published_ts")).filter("in_window")
    digits = F.regexp_replace(c("x.growth"), "[^0-9]", "")
    return (rows.select("run_id", "source", "published_ts", F.posexplode(F.arrays_zip("rank", "repo", "url", "stars", "growth")).alias("row_no", "x"))
            .select("run_id", "source", "row_no", c("x.rank").cast("int").alias("rank"), c("x.repo").alias("repo"), c("x.url").alias("url"),
                    F.when(digits == "", F.lit(0)).otherwise(digits.cast("bigint")).alias("reported_daily_growth"),
                    rank_score(c("x.rank").cast("int")).alias("score"), iso_text(c("published_ts")).alias("published_at")))


def extract_release_signal(payloads: DataFrame) -> DataFrame:
    """One release document gives at most one signal; a missing time or link is a source failure."""
    r = F.from_json("body", RELEASE_SCHEMA)
    rows = payloads.filter("format = 'release'").withColumn("r", r).select(
        "run_id", "source", "fetched_at", "window_hours", F.coalesce("r.tag_name", "r.name", F.lit("latest")).alias("tag"),
        signal_url(c("r.html_url")).alias("url"), feed_time(c("r.published_at")).alias("published_ts"))
    rows = _in_window(rows, c("published_ts")).withColumn("published_at", iso_text(c("published_ts"))).drop("published_ts")
    return (rows.withColumn("state", F.when(c("url").isNull() | c("published_at").isNull(), "failed").otherwise("healthy"))
            .withColumn("score", F.when((c("state") == "healthy") & c("in_window"), F.lit(RELEASE_SCORE))))


def payload_state(payloads: DataFrame) -> DataFrame:
    """Whether each body could be read at all."""
    body = c("body")
    well_formed = F.trim(body).rlike(r"(?s)^<.*</[A-Za-z:]+>$")
    readable = (
        F.when(c("format") == "feed", well_formed)
        .when(c("format") == "brief", F.from_json(body, BRIEF_SCHEMA)["items"].isNotNull() & F.trim(body).endswith("}"))
        .when(c("format") == "release", F.from_json(body, RELEASE_SCHEMA)["published_at"].isNotNull())
        .otherwise(body.isNotNull()))
    return payloads.select("run_id", "source", "format", F.when(F.coalesce(readable, F.lit(False)), "healthy").otherwise("failed").alias("state"))


def load_documents(spark: SparkSession, path: str, schema: str, number_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON documents of one kind; rows that are not objects or carry non-finite numbers are rejected."""
    rows = (spark.read.schema(schema + ", _corrupt STRING").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return split_documents(rows, number_columns)


def split_documents(rows: DataFrame, number_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    infinite = F.lit(False)
    for name in number_columns:
        infinite = infinite | F.coalesce(F.isnan(c(name)) | (F.abs(c(name)) == float("inf")), F.lit(False))
    reason = F.when(c("_corrupt").isNotNull(), "not_an_object").when(infinite, "non_finite_number")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("_corrupt", "reason"), marked.filter("reason IS NOT NULL")
