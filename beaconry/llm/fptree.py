"""Ranked lexical search by branch and bound over trees of documents.

1. Items are read in blocks of some ``block_terms`` distinct terms in all, so that what travels to the tasks is bounded.
2. One scan of the texts reduces each document to its length and its vector restricted to the terms of the block; the
   table is written once.  Document counts of the terms come from it by a combining aggregate.
3. Each task sorts the vectors of up to ``TREE_DOCS`` documents, rarest term first, so that those with the same rare
   terms share a path.  A path is split while more than ``LEAF_DOCS`` documents share it.  Each node knows the largest
   count of each term and the smallest length penalty below it; both bound every score there.  Per item the tree is
   searched depth first, best child first, and a subtree is left out only when its bound is below the last place.
4. The best of each task are merged in two steps, so that no task sees the candidates of all tasks for an item.

Terms are compared byte by byte after a hash match, so results are exact.  All arithmetic of scores is 64-bit integer.

Edge cases: a null or empty text has no term and is never found.  Rows that repeat a ``doc_id`` are documents of their
own.  A null ``doc_id`` sorts first among equal scores.  Rows of ``items`` with the same ``item_id`` are one item; an item
without terms finds nothing.  Empty tables give an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import stored
from beaconry.llm.hashing import mix, texts_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, TREE_DOCS, TREE_ENTRIES, LEAF_DOCS, BLOCK_TERMS, SALTS = 50, 1 << 14, 1 << 21, 64, 1 << 15, 64
PIECE = 1 << 20

_LETTER = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _LETTER[_first : _last + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _terms(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each term of lower-cased bytes starts, how long it is, and its hash."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[raw], [False])).view(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return starts, lengths, np.empty(0, np.uint64)
    power = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return starts, lengths, mix(np.add.reduceat(_VALUES[raw[np.repeat(starts, lengths) + place]] * power[place], first))


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text, cut where no term is."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and _LETTER[raw[end]]:
            gap = np.flatnonzero(~_LETTER[raw[end : end + PIECE]])
            end += int(gap[0]) if len(gap) else min(PIECE, len(raw) - end)
        yield raw[at:end]
        at = end


class Lexicon:
    """Numbers of the terms of a block, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]):
        raws = [np.frombuffer(t.encode(), np.uint8) for t in terms]
        hashes = np.array([_terms(r)[2][0] for r in raws], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], order
        if len(self.hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a block share a hash: take blocks of other sizes")
        self.lengths = np.array([len(r) for r in raws], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.concatenate(raws) if raws else np.empty(0, np.uint8)

    def vector(self, text: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms a text has in all, the numbers of those of the block, and how often each occurs."""
        total, counts = 0, np.zeros(len(self.lengths), np.int64)
        for part in _pieces(text):
            raw = _LOWER[part]
            starts, lengths, hashes = _terms(raw)
            total += len(starts)
            if not len(starts) or not len(self.hashes):
                continue
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            number = self.number[at[hit]]
            same = self.lengths[number] == lengths[hit]
            hit, number = hit[same], number[same]
            if not len(hit):
                continue
            span = lengths[hit]
            first = np.cumsum(span) - span
            place = np.arange(int(span.sum())) - np.repeat(first, span)
            differ = raw[np.repeat(starts[hit], span) + place] != self.bytes[np.repeat(self.starts[number], span) + place]
            counts += np.bincount(number[~np.logical_or.reduceat(differ, first)], minlength=len(counts))
        found = np.flatnonzero(counts)
        return total, found, counts[found]


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Tree:
    """Documents with their vectors, sorted by paths of terms; term 0 is the rarest of the block."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, leaf_docs: int = LEAF_DOCS):
        big = terms.astype(">u4")
        order = np.array(sorted(range(len(ids)), key=lambda i: big[offsets[i] : offsets[i + 1]].tobytes()), np.int64)
        lengths = np.diff(offsets)[order]
        self.ends = np.concatenate(([0], np.cumsum(lengths)))
        take = np.repeat(offsets[order] - self.ends[:-1], lengths) + np.arange(int(lengths.sum()))
        self.ids, self.m, self.terms, self.tfs = ids[order], m[order], terms[take].astype(np.int64), tfs[take].astype(np.int64)
        self.owner_m = np.repeat(self.m, lengths)
        self.lo, self.hi, self.children = [0], [len(ids)], [(0, 0)]
        self._split(lengths, leaf_docs)
        nodes = len(self.lo)
        self.most = np.zeros((nodes, n_terms), np.int32)
        self.least = np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):
            first, last = self.children[node]
            if first < last:
                self.most[node] = self.most[first:last].max(axis=0)
                self.least[node] = self.least[first:last].min()
            else:
                a, b = self.ends[self.lo[node]], self.ends[self.hi[node]]
                np.maximum.at(self.most[node], self.terms[a:b], self.tfs[a:b])
                self.least[node] = self.m[self.lo[node] : self.hi[node]].min()

    def _split(self, lengths: np.ndarray, leaf_docs: int) -> None:
        """Children are the documents that go on with the same term; neighbours with few documents share one child."""
        work = [(0, 0)]
        while work:
            node, depth = work.pop()
            lo, hi = self.lo[node], self.hi[node]
            groups = np.array([lo, hi])
            while hi - lo > leaf_docs and len(groups) == 2 and (lengths[lo:hi] > depth).any():
                at = np.where(lengths[lo:hi] > depth, self.terms[np.minimum(self.ends[lo:hi] + depth, len(self.terms) - 1)], -1)
                groups = np.concatenate(([lo], lo + 1 + np.flatnonzero(np.diff(at)), [hi]))
                depth += 1
            if len(groups) == 2:
                continue
            cuts = [lo]
            for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
                if b - cuts[-1] > leaf_docs and a > cuts[-1]:
                    cuts.append(a)
                if b - cuts[-1] > leaf_docs:
                    cuts.append(b)
            cuts += [hi] if cuts[-1] < hi else []
            if len(cuts) == 2:
                continue
            self.children[node] = (len(self.lo), len(self.lo) + len(cuts) - 1)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > leaf_docs:
                    work.append((len(self.lo), depth))
                self.lo.append(a)
                self.hi.append(b)
                self.children.append((0, 0))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best scores and ids of an item among ``best`` and the documents of this tree."""
        dense = np.zeros(self.most.shape[1], np.int64)
        dense[terms] = weights
        work = [(self._bounds(0, 1, terms, weights)[0], 0)]
        while work:
            bound, node = work.pop()
            if bound <= 0 or (len(best[0]) == top and bound < best[0][-1]):
                continue
            first, last = self.children[node]
            if first < last:
                bounds = self._bounds(first, last, terms, weights)
                order = np.argsort(bounds, kind="stable")
                work += [(int(bounds[k]), first + int(k)) for k in order if bounds[k] > 0]
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.ends[lo], self.ends[hi]
            part = np.flatnonzero(dense[self.terms[a:b]]) + a
            gained = np.zeros(b - a, np.int64)
            gained[part - a] = dense[self.terms[part]] * saturated(self.tfs[part], self.owner_m[part])
            scores = np.add.reduceat(gained, self.ends[lo:hi] - a)
            keep = np.flatnonzero((scores > 0) & (scores >= (best[0][-1] if len(best[0]) == top else 1)))
            if len(keep):
                scores, ids = np.concatenate((best[0], scores[keep])), np.concatenate((best[1], self.ids[lo:hi][keep]))
                order = np.lexsort((ids, -scores))[:top]
                best = scores[order], ids[order]
        return best

    def _bounds(self, first: int, last: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        tf = self.most[first:last, terms].astype(np.int64)
        return (saturated(tf, self.least[first:last, None]) * weights).sum(axis=1)


NO_ID = -(2**63)


def _vectors(docs: DataFrame, lexicon) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with at least one term."""
    names = ["doc_id", "n", "terms", "tfs"]

    def run(batches):
        for batch in batches:
            ids, held, size = batch.column("doc_id"), [], 0
            texts = texts_of(batch.column("text"))
            for k, text in enumerate(texts):
                n, terms, tfs = lexicon.value.vector(text)
                if n:
                    held.append((k, n, terms, tfs))
                    size += len(terms)
                if held and (size > TREE_ENTRIES or k == len(texts) - 1):
                    ends = pa.array(np.concatenate(([0], np.cumsum([len(h[2]) for h in held]))), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([h[c] for h in held]), pa.int32())) for c in (2, 3)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([h[0] for h in held])), pa.array([h[1] for h in held], pa.int64()), *lists], names)
                    held, size = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _block(vectors: DataFrame, items: list[tuple], n_terms: int, top: int, tree_docs: int, leaf_docs: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task for each item of a block, given by the numbers of its terms."""
    spark = vectors.sparkSession
    stats = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    known, total = stats.n, stats.l or 1
    df = np.zeros(n_terms, np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r.term] = r.df
    order = np.argsort(df, kind="stable")
    rank = np.empty(n_terms, np.int64)
    rank[order] = np.arange(n_terms)
    weight = np.array([math.floor(1000 * math.log((2 * known + 2) / (2 * d + 1))) for d in df[order].tolist()], np.int64)
    asked = []
    for _, numbers in items:
        own = np.sort(rank[np.array(numbers, np.int64)])
        own = own[df[order][own] > 0]
        asked.append((own, weight[own]))
    given = spark.sparkContext.broadcast((asked, rank))

    def run(batches):
        asked, rank = given.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]

        def search(parts):
            ids, n, lengths, terms, tfs = (np.concatenate(c) for c in zip(*parts))
            owner = np.repeat(np.arange(len(ids)), lengths)
            inside = np.lexsort((rank[terms], owner))
            tree = Tree(ids, 50 + 50 * n * known // total, np.concatenate(([0], np.cumsum(lengths))), rank[terms][inside], tfs[inside], n_terms, leaf_docs)
            for k, (own, weights) in enumerate(asked):
                if len(own):
                    best[k] = tree.search(own, weights, best[k], top)

        parts, docs, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("terms")
                lengths = lists.value_lengths().to_numpy()
                full = np.flatnonzero(lengths)
                if not len(full):
                    continue
                ids = np.array([NO_ID if v is None else v for v in part.column("doc_id").to_pylist()], np.int64)[full]
                parts.append((ids, part.column("n").to_numpy()[full], lengths[full].astype(np.int64), lists.flatten().to_numpy().astype(np.int64),
                              part.column("tfs").flatten().to_numpy().astype(np.int64)))
                docs, entries = docs + len(full), entries + int(lengths.sum())
                if docs >= tree_docs or entries >= TREE_ENTRIES:
                    search(parts)
                    parts, docs, entries = [], 0, 0
        if parts:
            search(parts)
        for at in range(0, len(best), 256):
            found = best[at : at + 256]
            ids = np.concatenate([b[1] for b in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(at, at + len(found)), [len(b[0]) for b in found]), pa.int32()),
                                              pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([b[0] for b in found]), pa.int64())],
                                             ["item", "doc_id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = (items.select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("terms"))
             .groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0))
    terms = stored(terms, "items")
    blocks = -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        numbers: dict[str, int] = {}
        asked = [(r.item_id, [numbers.setdefault(t, len(numbers)) for t in r.terms]) for r in rows]
        if not asked:
            continue
        lexicon = spark.sparkContext.broadcast(Lexicon(list(numbers)))
        vectors = stored(_vectors(docs, lexicon), "vectors")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], "item int, item_id long")
        best = _block(vectors, asked, len(numbers), top, tree_docs, leaf_docs)
        found = found.union(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    # Ids salt the first step: equal ids stay together, so ties fall as they would in one step.
    first = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    last = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    trimmed = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    return (trimmed.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
