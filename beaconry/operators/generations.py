"""Versioned datasets: manifests, verification, baselines, coherence, lineage and differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.timefns import strict_time
from beaconry.operators.skew import exact_position

c = F.col
REQUIRED_ARTIFACTS = ["snapshot", "catalog", "signals", "queue", "history"]


def row_hash(cols: list[str], digest: str = "xxhash64") -> Column:
    """64-bit row hash, or 60 bits of MD5 where the value must be comparable with other systems."""
    if digest == "xxhash64":
        return F.xxhash64(*cols).cast("decimal(38,0)")
    text = F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(rows: DataFrame, by: list[str], cols: list[str], digest: str = "xxhash64") -> DataFrame:
    """Row count and order-free content sum per group (one partial aggregate)."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.sum(row_hash(cols, digest)).cast("string").alias("fingerprint"))


def generation_manifest(rows: DataFrame, cols: list[str], digest: str = "xxhash64") -> DataFrame:
    """Inventory of every generation with its required artifacts, present or not."""
    have = fingerprint(rows, ["generation_id", "artifact"], cols, digest)
    names = F.explode(F.array(*[F.lit(a) for a in REQUIRED_ARTIFACTS]))
    wanted = rows.select("generation_id").distinct().withColumn("artifact", names)
    return wanted.join(have, ["generation_id", "artifact"], "full_outer").withColumn(
        "present", c("row_count").isNotNull()).na.fill(0, ["row_count"])


def verify_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """State of each artifact against the recorded manifest."""
    a = declared.select("generation_id", "artifact", c("fingerprint").alias("_d"), c("row_count").alias("_dn"), F.lit(True).alias("_in_d"))
    b = actual.select("generation_id", "artifact", c("fingerprint").alias("_a"), c("row_count").alias("_an"), F.lit(True).alias("_in_a"))
    state = (F.when(c("_in_d").isNull(), "extra").when(c("_in_a").isNull(), "missing")
             .when(c("_d").eqNullSafe(c("_a")) & c("_dn").eqNullSafe(c("_an")), "match").otherwise("changed"))
    return a.join(b, ["generation_id", "artifact"], "full_outer").select("generation_id", "artifact", state.alias("state"))


def verified_generations(states: DataFrame, declared_audit: DataFrame, actual_audit: DataFrame) -> DataFrame:
    """A generation is intact when every artifact matches and the audit summary is unchanged."""
    wrong = states.groupBy("generation_id").agg(F.count_if(c("state") != "match").alias("wrong_artifacts"))
    d = declared_audit.select("generation_id", F.struct("error_count", "warning_count").alias("_d"))
    a = actual_audit.select("generation_id", F.struct("error_count", "warning_count").alias("_a"))
    rows = wrong.join(d, "generation_id", "left").join(a, "generation_id", "left")
    return rows.select("generation_id", "wrong_artifacts", c("_d").eqNullSafe(c("_a")).alias("audit_matches"),
                       ((c("wrong_artifacts") == 0) & c("_d").eqNullSafe(c("_a"))).alias("intact"))


def refresh_baseline_check(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """First broken rule of each refresh candidate against its base."""
    refresh = pairs.filter("operation = 'refresh'")
    side = rows.join(refresh.select("pair_id"), "pair_id", "left_semi")
    latest = side.filter("role = 'latest'").groupBy("pair_id").agg(
        F.max(F.when(c("side") == "base", F.struct("captured_at", "fingerprint"))).alias("_b"),
        F.max(F.when(c("side") == "candidate", c("captured_at"))).alias("_c"))
    history = side.filter("role = 'history'")
    base, cand = history.filter("side = 'base'"), history.filter("side = 'candidate'")
    kept = base.join(cand, ["pair_id", "captured_at", "fingerprint"], "left_anti").groupBy("pair_id").agg(F.count("*").alias("_lost"))
    archived = (cand.join(latest.select("pair_id", c("_b.captured_at").alias("captured_at"), c("_b.fingerprint").alias("_f")), ["pair_id", "captured_at"])
                .groupBy("pair_id").agg(F.count("*").alias("_copies"), F.count_if(c("fingerprint") == c("_f")).alias("_same")))
    out = (refresh.join(latest, "pair_id", "left").join(kept, "pair_id", "left").join(archived, "pair_id", "left")
           .na.fill(0, ["_lost", "_copies", "_same"]))
    code = (
        F.when(~F.coalesce(strict_time(c("_c")) > strict_time(c("_b.captured_at")), F.lit(False)), "stale_generation")
        .when(~c("declared_previous_at").eqNullSafe(c("_b.captured_at")), "refresh_previous_capture_mismatch")
        .when(c("_lost") > 0, "refresh_history_changed")
        .when((c("_copies") != 1) | (c("_same") != 1), "refresh_base_snapshot_not_archived"))
    return out.select("pair_id", code.alias("code"), code.isNull().alias("accepted"))


def derive_baseline_check(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """A derived candidate must carry exactly the rows of its base."""
    derive = pairs.filter("operation = 'derive'").select("pair_id")
    cols = ["pair_id", "role", "captured_at", "fingerprint"]
    mine = rows.join(derive, "pair_id", "left_semi")
    base, cand = mine.filter("side = 'base'").select(*cols), mine.filter("side = 'candidate'").select(*cols)
    changed = base.exceptAll(cand).unionByName(cand.exceptAll(base)).groupBy("pair_id").agg(F.count("*").alias("n"))
    return derive.join(changed, "pair_id", "left").select(
        "pair_id", F.when(c("n").isNotNull(), "growth_baseline_changed").alias("code"), c("n").isNull().alias("accepted"))


def commit_coherence(headers: DataFrame) -> DataFrame:
    """Capture time of generations whose four times are valid and in order."""
    snap, cat, sig, que = (strict_time(c(n)) for n in ("snapshot_at", "catalog_at", "signals_at", "queue_at"))
    ok = F.coalesce((snap == cat) & (sig >= snap) & (que >= sig), F.lit(False))
    return headers.select("generation_id", ok.alias("committed"), F.when(ok, c("snapshot_at")).alias("capture_at"))


def publication_lineage(log: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Accepted publications: ready, no errors, built on the current generation (none before the first), published later.

    While a generation is current, only entries built on it can be accepted, so the first later entry that passes its own
    tests and names it as base follows it.  These links are followed from the first entry in rounds, twice as far each time;
    places in the log and the current generation come from day buckets.  No task holds the log of a dataset.  ``cut``
    writes what the next round reads.  Entries without an id are refused.
    """
    order = ["created_us", "generation_id", "base_generation_id", "state", "error_count", "published_us"]
    day = F.coalesce(F.floor(c("created_us") / 86_400_000_000).cast("bigint"), F.lit(-(2**40)))
    named = log.withColumn("_set", F.coalesce(F.concat(F.lit("="), "dataset"), F.lit("")))
    rows = exact_position(named, ["_set"], order, [day], ["_b0"], "log_no").withColumn("log_no", c("log_no") - 1).withColumn("_day", day)
    rows = cut(rows.select("_set", "dataset", "_day", "log_no", "generation_id", "base_generation_id", "state", "error_count", "published_us"))
    fit = rows.filter((c("state") == "ready") & (c("error_count") == 0) & c("generation_id").isNotNull())
    built = fit.select("_set", c("log_no").alias("b"), c("base_generation_id").alias("id"), c("published_us").alias("later"))
    links = (fit.select("_set", c("log_no").alias("a"), c("generation_id").alias("id"), c("published_us").alias("at")).join(built, ["_set", "id"])
             .filter((c("b") > c("a")) & F.coalesce(c("later") > c("at"), c("at").isNull())).groupBy("_set", "a").agg(F.min("b").alias("b")))
    links = cut(links)
    reached = cut(fit.filter("base_generation_id IS NULL").groupBy("_set").agg(F.min("log_no").alias("log_no")))
    known, fresh = reached, reached
    while not fresh.isEmpty():
        fresh = cut(known.join(links.withColumnRenamed("a", "log_no"), ["_set", "log_no"]).select("_set", c("b").alias("log_no")))
        known = cut(known.unionByName(fresh))
        links = cut(links.join(links.select("_set", c("a").alias("b"), c("b").alias("c")), ["_set", "b"]).select("_set", "a", c("c").alias("b")))
    marked = rows.join(known.withColumn("accepted", F.lit(True)), ["_set", "log_no"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    marked = cut(marked.withColumn("_kept", F.when(c("accepted"), c("generation_id"))))
    days = marked.groupBy("_set", "_day").agg(F.max_by("_kept", F.when(c("accepted"), c("log_no"))).alias("_last"), F.max(F.when(c("accepted"), c("log_no"))).alias("_no"))
    earlier = Window.partitionBy("_set").orderBy("_day")
    carried = days.select("_set", "_day", F.last("_last", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                          F.max("_no").over(Window.partitionBy("_set")).alias("_newest"))
    inside = Window.partitionBy("_set", "_day").orderBy("log_no").rowsBetween(Window.unboundedPreceding, -1)
    return (marked.withColumn("_here", F.last("_kept", ignorenulls=True).over(inside)).join(carried, ["_set", "_day"])
            .select("dataset", "log_no", "generation_id", F.coalesce("_here", "_before").alias("previous"), "accepted",
                    F.coalesce(c("accepted") & (c("log_no") == c("_newest")), F.lit(False)).alias("current")))


def dataset_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, removed and changed keys between two inventories."""
    a, b = old.select(*keys, c(value).alias("_old")), new.select(*keys, c(value).alias("_new"))
    change = (F.when(c("_old").isNull(), "added").when(c("_new").isNull(), "removed").when(c("_old") != c("_new"), "changed"))
    return a.join(b, keys, "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")
