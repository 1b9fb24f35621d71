"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles.  All sets are ordered by one global order, rare shingles first.  Two sets
whose overlap reaches ``t`` share at least ``l`` tokens within their prefixes of ``n - t + l`` tokens, for any ``l``.
Each document picks its own ``l`` by estimated cost: a longer prefix reads more list entries but asks a partner for
more shared tokens before the pair is verified.  A pair counts at the smaller ``l`` of its two documents.

Steps, none of which gathers a group:

1. One scan gives each row its set size and a 128-bit digest of the set, and adds all sets to a count sketch of fixed
   size (``2**sketch_bits`` counters, sent to all tasks).  Equal sets are one class, named by its smallest ``doc_id``.
2. A second scan writes the prefix tokens of one document per class.
3. Tokens in very many prefixes first link all their documents to one pivot each, chosen differently for each token.
   After that only pairs between different components are sought on them.  Their entries carry the whole prefix, so the
   join itself counts the shared tokens and gives each pair that can reach the threshold once, at its first hot token.
   All other tokens join directly and are counted by pair.
4. Pairs that pass the match and overlap bounds are verified on the whole sets; components follow.

Edge cases: a null or blank text has an empty set and links with nothing.  A null ``doc_id`` links with nothing and has
a null component.  Rows that repeat a ``doc_id`` are one node.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import stored
from beaconry.llm.components import components
from beaconry.llm.hashing import mix, shingle_set, texts_of, word_hashes

WIDTH, PERCENT, SKETCH_BITS, HOT, CHUNK = 4, 85, 20, 16, 4096
#: Verifying one pair costs as much as reading so many list entries.
VERIFY_COST = 20.0
BITMAP_WORDS = 1 << 17


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, raw in enumerate(texts_of(batch.column("text"))):
        yield i, shingle_set(word_hashes(raw), width)


def _summaries(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Per row ``doc_id, n, d1, d2``; at each partition's end its share of the sketch as ``chunk, counts``."""

    def run(batches):
        sketch, held, size = np.zeros(1 << bits, np.uint32), [], 0
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, own in _sets(batch, width):
                n[i], d1[i], d2[i] = len(own), own.sum(dtype=np.uint64).view(np.int64), mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)
                held.append(own & mask)
                size += len(own)
                if size > 1 << 20:
                    sketch += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                    held, size = [], 0
            empty = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), *empty], names)
        if held:
            sketch += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        parts = sketch.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        blank = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([blank, blank, blank, blank, pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())], names)

    names = ["doc_id", "n", "d1", "d2", "chunk", "counts"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary")


def _sketch(summaries: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch: 2**bits counters, whatever the size of the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint32).astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = summaries.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((max(1, (1 << bits) // CHUNK), CHUNK), np.int64)
    for k, raw in parts.collect():
        out[k] = np.frombuffer(raw, np.int64)
    return out.reshape(-1)


def least_overlap(n: np.ndarray | int, percent: int):
    """Smallest overlap of a set of n with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def choose_matches(freq: np.ndarray, percent: int, verify_cost: float = VERIFY_COST) -> int:
    """The cheapest number of shared prefix tokens to ask for, given the estimated list lengths in prefix order."""
    n = len(freq)
    t = least_overlap(n, percent)
    others, reads = np.cumsum(freq - 1.0), np.cumsum(freq)
    best, cost = 1, np.inf
    ell = 1
    while ell <= t:
        last = n - t + ell - 1
        now = reads[last] + verify_cost * others[last] / ell
        if now < cost:
            best, cost = ell, now
        ell *= 2
    return best


def _prefixes(docs: DataFrame, width: int, percent: int, bits: int, sketch: np.ndarray) -> DataFrame:
    """Prefix tokens ``token, doc, n, ell, level, hots, prefix`` of each document.

    level is the smallest l whose prefix has the token.  A hot token also carries the document's hot tokens and its
    whole prefix, both in the global order; for others these are null, and ``n_hot`` is how many hot ones there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    level_of = sketch.mean()
    hot_from = level_of + max(HOT, 4 * level_of**0.5)

    def run(batches):
        counts, mask = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out, size = [], 0
            for i, own in _sets(batch, width):
                n = len(own)
                if not n:
                    continue
                seen = counts[(own & mask).astype(np.int64)]
                order = np.lexsort((own, seen))
                ell = choose_matches(np.maximum(seen[order] - level_of, 1.0), percent)
                base = n - least_overlap(n, percent)
                take = order[: base + ell]
                level = np.maximum(np.arange(len(take)) - base + 1, 1)
                tokens, hot = own[take].view(np.int64), seen[take] >= hot_from
                for part, wide in ((~hot, False), (hot, True)):
                    k = int(part.sum())
                    if k:
                        lists = ([tokens[hot]] * k, [tokens] * k) if wide else ([None] * k, [None] * k)
                        out.append((tokens[part], np.full(k, ids[i]), np.full(k, n, np.int32), np.full(k, ell, np.int32), level[part].astype(np.int32), np.full(k, int(hot.sum()), np.int32), *lists))
                        size += k * (1 + len(tokens) // 4 * wide)
                if size > 200_000:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    def packed(out):
        flat = [pa.array(np.concatenate(c)) for c in list(zip(*out))[:6]]
        lists = [pa.array([x for part in c for x in part], pa.list_(pa.int64())) for c in list(zip(*out))[6:]]
        return pa.RecordBatch.from_arrays([*flat, *lists], ["token", "doc", "n", "ell", "level", "n_hot", "hots", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "token long, doc long, n int, ell int, level int, n_hot int, hots array<long>, prefix array<long>")


def _prefix_length(n: Column, ell: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)) + ell


def _bound(n_a: str, n_b: str, ell: Column, shared: Column, percent: int) -> Column:
    """Whether a pair that shares so many tokens within its prefixes can still reach the threshold."""
    a, b = F.col(n_a), F.col(n_b)
    beyond = F.greatest(a - _prefix_length(a, ell, percent), b - _prefix_length(b, ell, percent))
    return (shared >= ell) & (shared + beyond >= F.ceil((a + b) * percent / F.lit(100 + percent)))


def _meeting(entries: DataFrame, percent: int, also=None) -> DataFrame:
    """Pairs of entries that share a token within both prefixes at the pair's own l."""
    a, b = (entries.select("token", *[F.col(c).alias(c + s) for c in entries.columns if c != "token"]) for s in ("_a", "_b"))
    fits = F.expr(f"doc_a < doc_b and greatest(level_a, level_b) <= least(ell_a, ell_b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    on = (a["token"] == b["token"]) & fits
    return a.join(b, on & also(a["token"]) if also is not None else on)


def _plain_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidates by tokens that are not hot; those that are count as shared as far as both documents have any."""
    counted = _meeting(entries, percent).groupBy("doc_a", "doc_b", "n_a", "n_b", "ell_a", "ell_b", "n_hot_a", "n_hot_b").agg(F.count("*").alias("c"))
    shared = F.col("c") + F.least("n_hot_a", "n_hot_b")
    return counted.filter(_bound("n_a", "n_b", F.least("ell_a", "ell_b"), shared, percent)).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def _hot_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidates by hot tokens, between components only, each at its first common hot token."""
    ell = F.least("ell_a", "ell_b")
    head = lambda s: F.slice(f"prefix_{s}", F.lit(1), _prefix_length(F.col(f"n_{s}"), ell, percent).cast("int"))
    shared = F.size(F.array_intersect(head("a"), head("b")))

    def also(token: Column) -> Column:
        return (F.expr("comp_a <> comp_b") & (F.element_at(F.array_intersect("hots_a", "hots_b"), 1) == token)
                & _bound("n_a", "n_b", ell, shared, percent))

    return _meeting(entries, percent, also).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold.

    A bitmap of hashed ids, of fixed size, lets the scan skip texts that no pair needs; those it lets through wrongly
    find no partner.
    """
    spark, n_bits = docs.sparkSession, BITMAP_WORDS * 64
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    spot = F.pmod(F.xxhash64("doc"), F.lit(n_bits))
    rows = (wanted.select(spot.alias("s")).groupBy(F.expr("s div 64").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).collect())
    words = np.zeros(BITMAP_WORDS, np.uint64)
    for w, bits in rows:
        words[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    bitmap = spark.sparkContext.broadcast(np.unpackbits(words.view(np.uint8), bitorder="little").view(bool))

    def run(batches):
        for batch in batches:
            keep = np.flatnonzero(bitmap.value[batch.column("spot").to_numpy(zero_copy_only=False)])
            for at in range(0, len(keep), 500):
                part = batch.take(pa.array(keep[at : at + 500]))
                sets = [own.view(np.int64) for _, own in _sets(part, width)]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["doc", "shingles"])

    sets = (docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text").withColumn("spot", spot)
            .mapInArrow(run, "doc long, shingles array<long>"))
    a, b = (sets.select(F.col("doc").alias(s), F.col("shingles").alias("s" + s)) for s in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.select("a", "b").join(a, "a").join(b, "b")
            .withColumn("shared", shared)
            .filter(f"100 * shared >= {percent} * (size(sa) + size(sb) - shared)").select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``; see the module text."""
    summaries = stored(_summaries(docs, width, sketch_bits), "summaries")
    rows = summaries.filter("chunk is null").select("doc_id", "n", "d1", "d2")
    sketch = _sketch(summaries, sketch_bits)
    usable = rows.filter("doc_id is not null and n > 0")
    classes = stored(usable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    firsts = docs.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    entries = stored(_prefixes(firsts, width, percent, sketch_bits, sketch), "prefixes")

    # Pivots link the documents of a hot token without forming its pairs.
    crowded = entries.filter("hots is not null")
    pivots = crowded.groupBy("token").agg(F.count("*").alias("c"), F.min_by("doc", F.xxhash64("token", "doc")).alias("pivot")).filter("c >= 2")
    star = (crowded.select("token", "doc").join(pivots.filter(F.col("c") >= hot), "token").filter("doc <> pivot")
            .select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct())
    star_links = stored(_verified(docs, stored(star, "star"), width, percent), "starlinks")
    near = components(star_links).withColumnRenamed("node", "doc")

    placed = crowded.join(near, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component", "n_hot")
    split = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    placed = placed.join(split, "token")
    plain = entries.filter("hots is null").drop("hots", "prefix")
    candidates = _plain_pairs(plain, percent).union(_hot_pairs(placed, percent)).distinct()
    links = _verified(docs, stored(candidates, "candidates"), width, percent)

    # A doc_id on rows of several classes joins those classes.
    placed_rows = usable.join(classes, ["d1", "d2", "n"]).select("doc_id", "rep")
    several = placed_rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last")
    repeated = placed_rows.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(star_links.union(links).union(repeated))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return (rows.join(classes, ["d1", "d2", "n"], "left").join(found, F.col("rep") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))
