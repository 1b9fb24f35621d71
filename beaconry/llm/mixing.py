"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words.  Each document of a source is expected ``target / source size`` times.  Documents
are put in an order, expected copies are summed along it within the source, and a document is taken once for each whole
number that its step crosses, after one offset per source is added.  So a document is taken the floor or the ceiling of
its expectation, and the copies of any stretch of the order differ from their expectation by less than one.

The order goes by size class first, so that every stretch has documents of like size and the words taken come near the
target.  Expected copies are whole units of 1e-6, so that sums are exact and reruns agree.  Sums run in two levels:
within (source, size class, salt), and over the at most ``CLASSES x SALTS`` groups of a source; no task sorts a source.

Edge cases: a null or blank text has size 0 and is sampled like any other row; a source without words has target 0.  A
null source is a source of its own, the last one.  Rows that repeat a ``doc_id`` are separate documents; ties are broken
by the text's hash.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, SHARE_PERCENT, MOST, SALTS, UNIT = (5, 2, 1), 150, 2, 256, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``sized(source, size)``: weights repeat over sources by code point, null last.

    A source whose share of what is left exceeds ``most`` times its size stops there.  Sources stop in the order of
    size per weight, so one running sum finds all that stop: no loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("k"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (numbered.withColumn("w", weight.cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
              .withColumn("total", F.sum("source_size").over(every) * share_percent / 100.0)
              .withColumn("all_w", F.sum("w").over(every))
              .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("capped_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("capped_w"))))
    stops = ranked.withColumn("stops", F.col("w") * F.col("level") >= F.col("cap"))
    free = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    return stops.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * free).alias("target"))


def offset_of(source: Column, seed: int = 0) -> Column:
    """One offset per source, in units, from a digest of its name."""
    name = F.concat(F.lit(f"{seed} "), F.coalesce(source, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long") % UNIT


def size_class(size: Column) -> Column:
    """Sixteen classes to a doubling: the sizes of one lie within some 6 percent."""
    bits = F.length(F.bin(size + 1))
    return (bits * 32 + F.expr("shiftright(size + 1, greatest(length(bin(size + 1)) - 5, 0))")).cast("int")


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: int = 0) -> DataFrame:
    """``doc_id, tie, size, source, source_size, target, copies`` for every row of ``docs(doc_id, text, source)``."""
    sized = docs.select("doc_id", "source", size_of().alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    return step(sized, targets(sized, weights, share_percent, most), most, seed)


def step(sized: DataFrame, aims: DataFrame, most: int = MOST, seed: int = 0) -> DataFrame:
    """Adds ``source_size, target, copies`` to ``sized(doc_id, source, size, tie)``."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = (sized.withColumn("name", name).join(aims.select(name.alias("name"), "source_size", "target"), "name")
            .withColumn("units", F.least(F.round(share * UNIT), F.lit(most * UNIT)).cast("long"))
            .withColumn("class", size_class(F.col("size")))
            .withColumn("salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int")))
    group = ["name", "class", "salt"]
    earlier = Window.partitionBy("name").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group).agg(F.sum("units").alias("own")).select(*group, F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy(*group).orderBy("size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("within", F.sum("units").over(inner)).join(starts, group)
            .withColumn("upto", F.col("before") + F.col("within") + offset_of(F.col("source"), seed))
            .withColumn("copies", F.expr(f"upto div {UNIT} - (upto - units) div {UNIT}").cast("long"))
            .select(*sized.columns, "source_size", "target", "copies"))


def row_digest(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of the mix: each row of ``docs`` once for each copy taken, with the columns of ``docs``.

    Only ids and sizes go through the sampling; the rows join its outcome by id and digest.  Rows that are equal in
    every column take their copies together.
    """
    docs = docs.withColumn("_digest", row_digest(docs))
    sized = docs.select("doc_id", "source", size_of().alias("size"), F.col("_digest").alias("tie"))
    taken = (step(sized, targets(sized, weights, share_percent, most), most, seed)
             .groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
             .filter("_copies > 0"))
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & (docs["_digest"] == taken["_tie"])
    once = docs.join(taken, same).drop("_id", "_tie")
    # Equal rows cannot be told apart: they are made one row that takes the copies of all.
    several = once.filter("_rows > 1").dropDuplicates(["doc_id", "_digest"])
    rows = once.filter("_rows = 1").unionByName(several)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[c for c in docs.columns if c != "_digest"])


def report(docs: DataFrame, **settings) -> DataFrame:
    return sample(docs, **settings).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
