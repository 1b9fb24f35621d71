"""Document fingerprints by spot signatures.

Anchors are the ``ANCHORS`` most common words of the whole corpus.  At each anchor a chain is read: the next ``CHAIN``
words that are not anchors, passing at most ``SKIPPED`` anchors before each of them.  Anchor and chain make a signature; the beginning
of a text is an anchor too, so short texts have one.  A fingerprint is the sorted set of 32-bit signature hashes.  Two
fingerprints are compared by Jaccard.  ``similar_pairs``, which no query calls, seeks pairs within partitions of like set length.

Words are runs of letters and digits, lower-cased.  A break (full stop, question or exclamation mark, bar, line end)
counts as a common word, so lists without common words have anchors.  Everything is text and array functions of Spark.

Edge cases: a null text is empty and has an empty fingerprint; a text of anchors alone, or without letters and digits,
is one signature as a whole.  Two empty fingerprints have likeness 1, one empty and one not 0.  Rows that repeat a
``doc_id`` are separate rows; the document before them is edited with the one of the smallest text hash.  A null
``doc_id`` has no next document: nothing replaces its last quarter, and likeness to the next is null.  Other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import stored

ANCHORS, CHAIN, SKIPPED, PERCENT = 40, 2, 3, 80
_MARK, _BREAK = "\x01", "\x02"


def normal(text: Column) -> Column:
    """Words and breaks, each after one blank, and a blank at the end."""
    broken = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?|\n\r]+", f" {_BREAK} ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(broken, rf"[^\p{{L}}\p{{N}}{_BREAK}]+", " ")), F.lit(" "))


def anchors(docs: DataFrame, n: int = ANCHORS) -> list[str]:
    """The most common words of all texts, ties by word: ``n`` words reach the driver."""
    words = docs.select(F.explode(F.split(normal(F.col("text")), " ")).alias("w")).filter(~F.col("w").isin("", _BREAK))
    top = words.groupBy("w").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(n)
    return sorted(r.w for r in top.collect())


def signatures(text: Column, common: list[str], chain: int = CHAIN, skipped: int = SKIPPED) -> Column:
    """Sorted distinct signature hashes of a text."""
    plain = normal(text)
    known = "|".join([_BREAK, *map(re.escape, common)])
    marked = F.regexp_replace(plain, f"(?<= )({known})(?= )", f"{_MARK}$1")
    marked = F.concat(F.lit(f" {_MARK}^"), marked)
    spots = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?=([^ ]+(?:(?: {_MARK}[^ ]+){{0,{skipped}}} [^ {_MARK}][^ ]*){{1,{chain}}}))"), F.lit(1))
    own = F.transform(spots, lambda s: F.regexp_replace(s, f" {_MARK}[^ ]+", ""))
    own = F.when(F.size(own) > 0, own).when(F.length(F.coalesce(text, F.lit(""))) > 0, F.array(F.coalesce(text, F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(own, lambda s: F.shiftrightunsigned(F.xxhash64(s), 32))))


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets, whatever their lengths; an empty set is not intersected."""
    shared = F.size(F.array_intersect(a, b))
    return (F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0))
            .otherwise(shared / (F.size(a) + F.size(b) - shared)))


def similar_pairs(prints: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` with likeness of at least ``percent`` among ``prints(doc_id, hashes)``, each set once.

    Equal sets are one class, named by the smallest id, and only classes are paired.  A set of length n lies in the
    partition of its length and asks the next one too: partitions grow by the ratio of lengths that a pair can have.
    Within them sets meet on the first n - ceil(n p) + 1 of their hashes, are pruned by length, and are then compared.
    """
    classes = prints.filter("doc_id is not null and size(hashes) > 0").groupBy("hashes").agg(F.min("doc_id").alias("doc_id"))
    n = F.size("hashes")
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    first = F.slice("hashes", F.lit(1), (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int"))
    keyed = stored(classes.select("doc_id", n.alias("n"), part.alias("part"), F.explode(first).alias("h")), "spots")
    a = keyed.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "h")
    b = keyed.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "part", "h")
    met = (a.join(b, ["part", "h"]).filter(f"x <> y and (nx < ny or nx = ny and x < y) and 100 * nx >= {percent} * ny").select("x", "y").distinct())
    sets = classes.select("doc_id", "hashes")
    both = met.join(sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("hx")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("hashes").alias("hy")), "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    return both.filter(shared * 100 >= percent * (F.size("hx") + F.size("hy") - shared)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def next_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id, n_chars`` of each distinct id, the first after the last; no task sorts all ids.

    Ids are dealt by range; only the first id of each range, as many as there are partitions, meets in one task.
    ``n_chars`` is the longest text of the id.
    """
    ids = docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    ranged = ids.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars")).repartitionByRange("doc_id")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part"))).alias("after"))
    inner = Window.partitionBy("part").orderBy("doc_id")
    return (ranged.withColumn("lead", F.lead("doc_id").over(inner)).join(heads, "part")
            .select("doc_id", F.coalesce("lead", "after").alias("next_id"), "n_chars"))


def _packed(hashes: Column) -> Column:
    """Hashes of 32 bits in four bytes each, as they travel."""
    return F.transform(hashes, lambda h: F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int"))


def _unpacked(hashes: Column) -> Column:
    return F.array_sort(F.transform(hashes, lambda h: F.pmod(h.cast("long"), F.lit(2**32))))


def edited_pairs(docs: DataFrame, common: list[str]) -> DataFrame:
    """Each row with its signatures, the start of the next document and that one's signatures:
    ``doc_id, text, hashes, start, next_hashes``.

    Texts move once, by id, with their signatures; both joins read that one exchange, so both leave out rows without an
    id.  What goes on to the document before is a quarter of that one's length at most.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _packed(signatures(text, common)).alias("hashes"))
    texts = rows.filter("doc_id is not null")
    after = next_ids(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), F.floor(F.col("n_chars") / 4).cast("int").alias("take"))
    told = (texts.join(after, "doc_id").select(
                "to", F.xxhash64("text").alias("tie"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("start"), F.col("hashes").alias("next_hashes"))
            .groupBy("to").agg(F.min(F.struct("tie", "start", "next_hashes")).alias("m")).select(F.col("to").alias("doc_id"), "m.start", "m.next_hashes"))
    alone = rows.filter("doc_id is null").withColumn("start", F.lit(None).cast("string")).withColumn("next_hashes", F.lit(None).cast("array<int>"))
    return texts.join(told, "doc_id", "left").unionByName(alone)


def fingerprints(docs: DataFrame, n_anchors: int = ANCHORS) -> DataFrame:
    """Fingerprints of every text and of its edited text; see the module text.  ``edited_text`` is kept as well."""
    common = anchors(docs, n_anchors)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = (edited_pairs(docs, common).withColumn("n_chars", n.cast("long"))
            .withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("start", F.lit("")), F.lit(1), cut)))
            .select("doc_id", "n_chars", "edited_text", _unpacked(F.col("next_hashes")).alias("next_hashes"), _unpacked(F.col("hashes")).alias("hashes"),
                    signatures(F.col("edited_text"), common).alias("edited_hashes")))
    return rows.select(
        "doc_id", "n_chars", "edited_text", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("hashes")).alias("fingerprint"), fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), F.when(F.col("next_hashes").isNotNull(), likeness(F.col("hashes"), F.col("next_hashes"))).alias("near_next"))
