"""Near duplicates among embeddings by spherical-cap filters.

Random product codes name the filters.  For each of ``CODES`` codes the space is turned at random and cut into blocks,
each block has ``WORDS`` random unit vectors, and a filter is one choice per block.  A vector passes a filter when its
inner product with the filter's direction exceeds a bound.  List decoding finds all filters a vector passes: it extends
partial choices block by block and drops those that the best remaining choices cannot lift over the bound.  Vectors that
pass a common filter are compared in double precision.

For a pair at the threshold the mean number of common filters is ``SHARED``; the bound is set from that, on random
pairs, whatever the data.  Closer pairs share more.  Many codes of two blocks keep the number near its mean for every
vector: of 3,000 random pairs at cosine 0.95 in 64 dimensions none shared fewer than two filters (one code of four
blocks misses nearly half).  Equal vectors are one class before filtering, whatever their ids.

Random words coincide in few dimensions, so vectors below ``LOW_DIM`` dimensions have other filters: the corners of the
grid cell that their first three coordinates lie in.  Cells are as wide as a pair at the threshold can be apart, so no
pair misses.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows
without a ``vec_id``.  Vectors of different length are never compared.  Each row is a vector of its own: rows that repeat
a ``vec_id`` link with each other if their vectors are close, and have their own counts and components if not.  Other
columns, labels among them, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import stored
from beaconry.llm.components import components

THRESHOLD, BLOCKS, WORDS, CODES, SHARED, SEED = 0.95, 2, 96, 64, 17.0, 11
LOW_DIM, GRID = 8, 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class ProductCodes:
    """Of each code its blocks of unit vectors, already turned; and the least inner product with a passed filter."""

    codes: list[list[np.ndarray]]
    bound: float

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of all filters that the rows of ``unit`` pass."""
        rows, numbers, first = [], [], 0
        for parts in self.codes:
            inner = [unit @ part.T for part in parts]
            rest = np.zeros((len(inner) + 1, len(unit)))
            for k in range(len(inner) - 1, -1, -1):
                rest[k] = rest[k + 1] + inner[k].max(axis=1)
            row, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
            for k, part in enumerate(inner):
                sums = total[:, None] + part[row]
                at, word = np.nonzero(sums >= (self.bound - rest[k + 1][row])[:, None])
                row, number, total = row[at], number[at] * part.shape[1] + word, sums[at, word]
            rows.append(row)
            numbers.append(number + first)
            first += int(np.prod([len(part) for part in parts]))
        return np.concatenate(rows), np.concatenate(numbers)


@functools.lru_cache(maxsize=4)
def product_codes(dim: int, threshold: float = THRESHOLD, blocks: int = BLOCKS, words: int = WORDS, codes: int = CODES, shared: float = SHARED, seed: int = SEED) -> ProductCodes:
    """The codes of a dimension: the same in every process."""
    rng = np.random.default_rng([seed, dim])
    made = []
    for _ in range(codes):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cuts = np.array_split(np.arange(dim), min(blocks, dim))
        made.append([_unit(rng.normal(size=(words, len(cut)))) @ turn[cut] / np.sqrt(len(cuts)) for cut in cuts])
    # Pairs at the threshold: the bound at which they share enough filters on average.
    x = _unit(rng.normal(size=(24, dim)))
    y = rng.normal(size=x.shape)
    y = threshold * x + np.sqrt(1 - threshold**2) * _unit(y - (y * x).sum(1, keepdims=True) * x)
    best = []
    for a, b in zip(x, y):
        for parts in made:
            both = [np.zeros(1), np.zeros(1)]
            for part in parts:
                both = [np.add.outer(s, part @ v).reshape(-1) for s, v in zip(both, (a, b))]
            best.append(np.sort(np.minimum(*both))[-400:])
    best = np.sort(np.concatenate(best))
    return ProductCodes(made, float(best[-min(len(best), round(shared * len(x)))]))


def _clean(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None for those that can link with nothing."""
    out = []
    for value in column:
        vector = value.values
        ok = vector is not None and len(vector) and not vector.null_count
        x = vector.to_numpy(zero_copy_only=False).astype(np.float64) if ok else None
        out.append(x if ok and np.isfinite(x).all() and x.any() else None)
    return out


def _digests(vectors: DataFrame) -> DataFrame:
    """Each row with the digest of its vector, null if it can link with nothing."""

    def run(batches):
        for batch in batches:
            marks = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in _clean(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], ["vec_id", "embedding", "digest"])

    return vectors.mapInArrow(run, f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, digest binary")


def _matrices(column: pa.Array):
    """Places and scaled vectors, a matrix for each length, of a column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)]
        yield at, x / np.abs(x).max(axis=1, keepdims=True)


def grid_corners(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and filter numbers of the eight corners of each row's cell; rows within reach share a corner."""
    width = max(np.sqrt(max(2 - 2 * threshold, 0.0)) * (1 + 1e-6), 4 / GRID)
    cell = np.zeros((len(unit), 3), np.int64)
    cell[:, : unit.shape[1]] = np.floor(unit[:, :3] / width).astype(np.int64) + GRID // 2
    corner = np.array([[i >> k & 1 for k in range(3)] for i in range(8)])
    number = ((cell[:, None, :] + corner) * np.array([GRID * GRID, GRID, 1])).sum(axis=2)
    return np.repeat(np.arange(len(unit)), 8), number.reshape(-1)


def _filters(vectors: DataFrame, threshold: float, **code) -> DataFrame:
    """``node, dim, filter`` for each filter passed."""

    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at, x in _matrices(batch.column("embedding")):
                unit, dim = _unit(x), x.shape[1]
                for k in range(0, len(at), 500):
                    row, number = grid_corners(unit[k : k + 500], threshold) if dim < LOW_DIM else product_codes(dim, threshold, **code).decode(unit[k : k + 500])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at[k : k + 500][row]]), pa.array(np.full(len(row), dim, np.int32)), pa.array(number)], ["node", "dim", "filter"])

    return vectors.select("node", "embedding").mapInArrow(run, "node long, dim int, filter long")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose cosine reaches the threshold."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for (at, x), (_, y) in zip(_matrices(batch.column("va")), _matrices(batch.column("vb"))):  # both of a pair are of one length
                inner, xx, yy = (np.einsum("ij,ij->i", u, v) for u, v in ((x, y), (x, x), (y, y)))
                keep[at] = inner >= threshold * np.sqrt(xx * yy)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    a, b = (vectors.select(F.col("node").alias(s), F.col("embedding").alias("v" + s)) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **code) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``; see the module text."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = stored(_digests(vectors), "digests")
    usable = rows.filter("vec_id is not null and digest is not null")
    # A class is all rows of one vector.  Its number is fixed once the table is written.
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectorclasses")
    first = classes.select("digest", F.col("rep").alias("vec_id"), "node")
    reps = stored(usable.join(first, ["digest", "vec_id"]).select("node", "embedding").dropDuplicates(["node"]), "vectors")

    passed = stored(_filters(reps, threshold, **code), "filters")
    a, b = (passed.select("dim", "filter", F.col("node").alias(s)) for s in "ab")
    pairs = a.join(b, ["dim", "filter"]).filter("a < b").select("a", "b").distinct()
    links = stored(_verified(pairs, reps, threshold), "vectorlinks")

    size = classes.select(F.col("node").alias("b"), F.col("n").alias("n_other"))
    both = links.union(links.select("b", "a"))
    other = both.join(size, "b").groupBy("a").agg(F.sum("n_other").alias("others")).withColumnRenamed("a", "node")
    found = components(links)
    linked = classes.join(other, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("comp"))
    known = linked.join(least, "component").select("digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "comp")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("comp", "vec_id"))
    return (rows.select("vec_id", "digest").join(known, "digest", "left")
            .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))
