"""Quality by co-training two views of a page.

The content view sees byte pairs and words of the text.  The metadata view sees language, source, declared length and
layout (lines, their lengths).  Each view is a logistic regression.  Over several rounds each view labels the unlabelled
rows it is most sure of, and the other view learns from them too.  A last curve, fitted on labelled rows that neither
view was fitted on, weighs both views into one score.  The sample has as many rows of each label as it can, so the curve is
then moved to the odds of a good row among all labelled rows outside the held-out fold.

Fitting takes at most ``per_class`` labelled rows of each label.  Each round of co-training scores all unlabelled rows on
Spark and brings back the ``EXCHANGED`` rows that each view is most sure of, as features.  No row is left out for its
length, and none of the held-out fold takes part.  Scoring reads every whole text.

Short texts say little, so their content features are drawn towards the mean: a text of ``HALF_TRUST_BYTES`` by half.

Edge cases: null and empty texts have no content features and are scored all the same; null language, source and
length count as values of their own.  Without labelled rows of both classes all rows get the share of good rows seen
(1 if none, so that nothing is rejected for want of labels).  Repeated rows each get their own score.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import stored
from beaconry.llm.hashing import texts_of, word_hashes
from beaconry.llm.logistic import fit_gradient, fit_newton, sigmoid
from beaconry.llm.sampling import held_out, label_counts, labelled_ids

PAIR_BITS, WORD_BITS, META = 11, 11, 64 + 8 + 1
PER_CLASS, ROUNDS, EXCHANGED = 2000, 4, 150
_PAIR_SLOT = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
_COLUMNS = ["text", "lang", "source", "n_chars"]
#: A text of so many bytes is trusted half: its shares may be far from those of longer texts by chance alone.
HALF_TRUST_BYTES = 200


def content_view(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of byte pairs and words by hash slot; the shares of distinct words and of words like the one before; trust."""
    out = np.zeros((1 << PAIR_BITS) + (1 << WORD_BITS) + 3, np.float32)
    if len(raw) > 1:
        pairs = np.zeros(1 << PAIR_BITS)
        for at in range(0, len(raw) - 1, 1 << 20):
            part = raw[at : at + (1 << 20) + 1].astype(np.int64)
            pairs += np.bincount(_PAIR_SLOT[part[:-1] * 256 + part[1:]], minlength=1 << PAIR_BITS)
        out[: 1 << PAIR_BITS] = np.sqrt(pairs / pairs.sum())
    words = word_hashes(raw)
    if len(words):
        slots = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        out[1 << PAIR_BITS : -3] = np.sqrt(np.bincount(slots, minlength=1 << WORD_BITS) / len(words))
        out[-3] = len(np.unique(words)) / len(words)
        out[-2] = (words[1:] == words[:-1]).sum() / len(words)
    out[-1] = len(raw) / (len(raw) + HALF_TRUST_BYTES)
    return out


def metadata_view(raw: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    out[zlib.crc32(f"lang {lang}".encode()) % 32] = 1
    out[32 + zlib.crc32(f"source {source}".encode()) % 32] = 1
    ends = np.flatnonzero(raw == 10)
    lines = np.diff(np.concatenate(([-1], ends, [len(raw)]))) - 1
    out[64:-1] = [n_chars is None, math.log1p(max(0, n_chars or 0)) / 8, math.log1p(len(raw)) / 8, math.log1p(len(lines)) / 8,
                math.log1p(lines.mean()) / 8, math.log1p(lines.max()) / 8, (lines < 30).mean(),
                abs(math.log1p(max(0, n_chars or 0)) - math.log1p(len(raw))) / 8]
    out[-1] = 1
    return out


@dataclass
class View:
    """A logistic regression on all columns but the last, which says how far a row may stray from the mean."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        slope = (self.weights[:-1] / self.scale).astype(np.float32)
        return ((x[:, :-1] @ slope - float(self.mean @ slope)) * x[:, -1] + self.weights[-1]).astype(np.float64)


@dataclass
class QualityModel:
    content: View | None
    metadata: View | None
    blend: np.ndarray

    def probability(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.content is None:
            return np.full(len(content), sigmoid(self.blend[-1]))
        return sigmoid(np.column_stack([self.content.logit(content), self.metadata.logit(metadata)]) @ self.blend[:2] + self.blend[2])


class Scaled:
    """Blocks of raw rows seen as one matrix that is centred, scaled and drawn to the mean by trust; nothing is copied.

    ``share`` weighs rows in mean and spread; rows of weight 0 stay in their block and count for nothing.
    """

    def __init__(self, blocks: list[np.ndarray], share: np.ndarray):
        self.blocks, self.dtype = [b[:, :-1] for b in blocks], np.float32
        self.trust = np.concatenate([b[:, -1] for b in blocks]).astype(np.float64)
        self.shape = (len(self.trust), self.blocks[0].shape[1])
        self.mean = self._moment(share, np.zeros(self.shape[1], np.float32), 1) / share.sum()
        spread = np.sqrt(self._moment(share, self.mean, 2) / share.sum())
        self.scale = np.maximum(spread, 0.01) * math.sqrt(self.shape[1])

    def _pieces(self, size: int):
        begin = 0
        for block in self.blocks:
            for at in range(0, len(block), size):
                part = block[at : at + size]
                yield slice(begin + at, begin + at + len(part)), part
            begin += len(block)

    def _moment(self, share: np.ndarray, centre: np.ndarray, power: int) -> np.ndarray:
        total = np.zeros(self.shape[1])
        for rows, part in self._pieces(128):
            total += share[rows] @ (part - centre).astype(np.float64) ** power
        return total

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        slope = v / self.scale
        out = np.concatenate([b @ slope.astype(np.float32) for b in self.blocks]).astype(np.float64)
        return ((out - self.mean @ slope) * self.trust).astype(np.float32)

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transpose times ``r``."""
        r, out, begin = r * self.trust, np.zeros(self.shape[1]), 0
        for block in self.blocks:
            out += block.T @ r[begin : begin + len(block)].astype(np.float32)
            begin += len(block)
        return (out - self.mean * r.sum()) / self.scale


def _fit_view(blocks: list[np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float) -> View:
    x = Scaled(blocks, (weight > 0).astype(np.float64))
    return View(fit_gradient(x, y, weight, l2), x.mean.astype(np.float32), x.scale.astype(np.float32))


class ArrayPool:
    """Unlabelled rows given by their two views."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views = views

    def sure(self, fitted: list[View], good: int, bad: int, taken: list[set]) -> list[dict]:
        """For each view the rows that the other is most sure of and that are not ``taken``: id to label and features."""
        out: list[dict] = [{}, {}]
        for k in (0, 1) if len(self.views[0]) else ():
            logit = fitted[k].logit(self.views[k])
            order = np.argsort(logit, kind="stable")
            sure = [(i, 1) for i in order[::-1] if i not in taken[1 - k] and logit[i] > 1.0][:good]
            sure += [(i, 0) for i in order if i not in taken[1 - k] and logit[i] < -1.0][:bad]
            out[1 - k].update((i, (label, self.views[1 - k][i])) for i, label in sure)
        return out


class SparkPool:
    """The rows of ``docs`` whose id is not among ``known``, scored where they lie; only the rows asked for reach the driver.

    Texts are never shuffled: known ids are left out of the narrow scores.
    """

    def __init__(self, docs: DataFrame, known: DataFrame):
        self.docs, self.known = docs, known

    def sure(self, fitted: list[View], good: int, bad: int, taken: list[set]) -> list[dict]:
        most = {1: good, 0: bad}

        def run(batches):
            for batch in batches:
                ids, far = batch.column("doc_id").to_pylist(), [[], []]
                for _, views in _batch_views(batch):
                    for k in (0, 1):
                        far[k].append(fitted[k].logit(views[k]))
                for k in (0, 1):
                    logit = np.concatenate(far[k]) if far[k] else np.empty(0)
                    at = np.array([i for i in np.flatnonzero(np.abs(logit) > 1.0) if ids[i] not in taken[1 - k]], np.int64)
                    columns = [pa.array(np.full(len(at), k, np.int32)), pa.array((logit[at] > 0).astype(np.int32)),
                               pa.array([ids[i] for i in at], pa.int64()), pa.array(np.abs(logit[at]))]
                    yield pa.RecordBatch.from_arrays(columns, ["k", "label", "doc_id", "far"])

        found = stored(self.docs.mapInArrow(run, "k int, label int, doc_id long, far double"), "sure")
        found = (found.join(self.known.select("doc_id").distinct(), "doc_id", "left_anti")
                 .groupBy("k", "label", "doc_id").agg(F.max("far").alias("far")))
        chosen = [[{r.doc_id for r in found.filter((F.col("k") == k) & (F.col("label") == label)).orderBy(F.desc("far"), "doc_id").limit(most[label]).collect()}
                   for label in (0, 1)] for k in (0, 1)]
        every = sorted(set().union(*chosen[0], *chosen[1]))
        if not every:
            return [{}, {}]
        ids = self.docs.sparkSession.createDataFrame([(i,) for i in every], "doc_id long")
        rows = (self.docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id")
                .agg(F.min(F.struct(F.xxhash64("text").alias("h"), *_COLUMNS)).alias("m")).select("doc_id", *[f"m.{c}" for c in _COLUMNS]))
        features, at = _collected(rows, every), {i: n for n, i in enumerate(every)}
        return [{i: (label, features[k][at[i]]) for label in (0, 1) for i in sorted(chosen[1 - k][label])} for k in (0, 1)]


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | SparkPool,
            rounds: int = ROUNDS, exchanged: int = EXCHANGED, log_odds: float | None = None) -> QualityModel:
    """Views of the labelled rows, their labels, a flag for rows kept for the blend, and the pool or its views.

    ``log_odds`` are those of a good row where the model is used; by default those of the labelled rows given.
    """
    pool = ArrayPool(pool) if isinstance(pool, tuple) else pool
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return QualityModel(None, None, np.array([0, 0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    own = ~fold if len(set(y[~fold].tolist())) == 2 else np.ones(len(y), bool)
    given: list[dict] = [{}, {}]  # for each view, labels and features of pool rows that the other is sure of
    fitted: list[View] = []
    for turn in range(rounds):
        fitted = []
        for k in (0, 1):
            extra = list(given[k].values())
            blocks = [views[k], np.array([features for _, features in extra], np.float32)] if extra else [views[k]]
            labels = np.concatenate([y, [label for label, _ in extra]])
            seen = np.concatenate([own, np.ones(len(extra), bool)])
            ones = max(1.0, labels[seen].sum())
            balance = np.where(labels == 1, seen.sum() / (2 * ones), seen.sum() / (2 * max(1.0, seen.sum() - ones)))
            trust = np.concatenate([own.astype(float), np.full(len(extra), 0.5)])
            fitted.append(_fit_view(blocks, labels, balance * trust, 1e-4))
        if turn == rounds - 1:
            break
        share = float(y[own].mean())
        new = pool.sure(fitted, max(1, round(exchanged * share)), max(1, round(exchanged * (1 - share))), [set(g) for g in given])
        for k in (0, 1):
            given[k].update(new[k])
    last = fold if len(set(y[fold].tolist())) == 2 else np.ones(len(y), bool)
    both = np.column_stack([fitted[k].logit(views[k][last]) for k in (0, 1)])
    blend = fit_newton(both, y[last], l2=1.0)
    if log_odds is not None:
        share = float(y[last].mean())
        blend[2] += log_odds - math.log(share / (1 - share))
    return QualityModel(fitted[0], fitted[1], blend)


def _batch_views(batch: pa.RecordBatch):
    """Both views of each 256 rows, and where these begin."""
    langs, sources, lengths = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    raws = texts_of(batch.column("text"))
    for at in range(0, len(raws), 256):
        part = range(at, min(len(raws), at + 256))
        yield at, (np.array([content_view(raws[i]) for i in part]),
                   np.array([metadata_view(raws[i], langs[i], sources[i], lengths[i]) for i in part]))


def _collected(rows: DataFrame, known: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of each of ``known``, in that order, made where the texts lie; they come to the driver a partition at a time."""
    def run(batches):
        for batch in batches:
            views = [[row.tobytes() for _, both in _batch_views(batch) for row in both[k]] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.binary()) for v in views)], ["doc_id", "content", "metadata"])

    place = {i: k for k, i in enumerate(known)}
    out = tuple(np.empty((len(known), width), np.float32) for width in ((1 << PAIR_BITS) + (1 << WORD_BITS) + 3, META))
    found = stored(rows.mapInArrow(run, "doc_id long, content binary, metadata binary"), "features")
    for r in found.toLocalIterator():
        for k in (0, 1):
            out[k][place[r.doc_id]] = np.frombuffer(r[1 + k], np.float32)
    return out


def fit_from(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_COLUMNS)
    chosen = labelled_ids(docs, labels, "quality", per_class).collect()
    known = {r.doc_id: r.label for r in sorted(chosen, key=lambda r: r.doc_id)}
    ids = docs.sparkSession.createDataFrame([(i,) for i in known], "doc_id long")
    rows = (docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id")
            .agg(F.min(F.struct(F.xxhash64("text").alias("h"), *_COLUMNS)).alias("m")).select("doc_id", *[f"m.{c}" for c in _COLUMNS]))
    views = _collected(rows, list(known))
    pool = SparkPool(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), labels)
    seen = label_counts(labels, "quality")
    log_odds = math.log(seen[1] / seen[0]) if seen.get(0) and seen.get(1) else None
    fold = np.array([zlib.crc32(f"blend {i}".encode()) % 4 == 0 for i in known], bool)
    return cotrain(views, np.array(list(known.values()), float), fold, pool, log_odds=log_odds)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score``, the probability of good quality; every column of ``docs`` is kept, ``score`` replaced."""
    docs = docs.drop("score")

    def run(batches):
        for batch in batches:
            out = [model.probability(*views) for _, views in _batch_views(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; predicted 1 is good."""
    scored = score(docs.select("doc_id", *_COLUMNS), fit_from(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
