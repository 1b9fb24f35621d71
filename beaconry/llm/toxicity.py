"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  A text is cut into windows of words,
by default of one word each, so that the neighbours' noise stays out.  Each window is compressed under both; the bytes
that the toxic dictionary saves are the window's gain.  A fixed pad that both dictionaries hold is added to each window,
so that the cost of having any match at all is always paid.  Gains above a
threshold add up to the document's evidence, and a logistic curve turns evidence into a score.  Threshold and curve are
calibrated on the labelled sample, each class weighed as often as it is among all labelled rows outside the held-out
fold.

Words that are harmless alone may be toxic together, so two words in a row are one more window where a toxic pair has
their seam; its gain is what a dictionary of the toxic pairs saves over one that holds the same words apart.

Both dictionaries begin with the same dictionary of ordinary language, so that everyday wording cancels out.  The toxic
samples are chosen, not raw toxic text: word stems, and pairs of words without such a stem, that are tied to the label
by lift and by a likelihood ratio over texts and over distinct contexts, which copies of a text do not inflate.  There is no least share
of texts; the ratio grows with the number of stems or pairs it is asked of.

Fitting takes at most ``per_class`` labelled rows of each label, of ``max_chars`` characters in all per label, outside the
held-out fold; long rows take part.  Scoring reads every whole text.

Edge cases: null and empty texts have no window, hence no evidence, and get the score of no evidence.  Without labelled
rows of both classes every row gets the share of toxic rows seen (0 if none).  Repeated rows each get their own row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.logistic import fit_newton, log_loss, sigmoid
from beaconry.llm.sampling import held_out, label_counts, labelled_sample

WINDOW_WORDS, PER_CLASS, MAX_CHARS = 1, 4000, 16_000_000
BASE_BYTES, TOXIC_BYTES = 24 * 1024, 4 * 1024
STEM, MIN_LIFT = 4, 8.0
CACHED = 300_000
_PAD = b" the pad both dictionaries hold, 0123456789 "
_TERM = re.compile(r"[^\W_]+")


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: float
    slope: float
    intercept: float
    window: int = WINDOW_WORDS
    seams: frozenset[str] = frozenset()
    apart: bytes = b""
    paired: bytes = b""

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + self.slope * np.log1p(evidence))


def windows(text: str | None, size: int) -> Iterator[bytes]:
    """The words of a text, lower-cased, in consecutive windows; a very long word is cut so that windows stay small."""
    words = (text or "").lower().split()
    for at in range(0, len(words), size):
        raw = f" {' '.join(words[at : at + size])} ".encode()
        for cut in range(0, len(raw), 4096):
            yield raw[cut : cut + 4096]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=17, hash_log=15, chain_log=15, search_log=4,
        write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


class GainMeter:
    """Bytes saved per window by the toxic dictionary; a bounded memory holds the windows seen last."""

    def __init__(self, model: ToxicityModel):
        self.model, self.one, self.two, self.seen = model, _compressor(model.ordinary), _compressor(model.toxic), {}
        self.apart, self.paired = (_compressor(model.apart), _compressor(model.paired)) if model.seams else (None, None)

    def gain(self, window: bytes) -> int:
        known = self.seen.get(window)
        if known is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            padded = window + _PAD
            known = self.seen[window] = len(self.one.compress(padded)) - len(self.two.compress(padded))
        return known

    def gains(self, text: str | None) -> list[int]:
        found = [self.gain(w) for w in windows(text, self.model.window)]
        if self.model.seams and text:
            terms = _TERM.findall(text.lower())
            for one, two in zip(terms, terms[1:]):
                if _seam(one, two) in self.model.seams:
                    padded = f" {one[-2048:]} {two[:2048]} ".encode() + _PAD
                    found.append(len(self.apart.compress(padded)) - len(self.paired.compress(padded)))
        return found


def _seam(one: str, two: str) -> str:
    return f"{one[-3:]} {two[:3]}"


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; from too few samples to train on, their distinct content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _stems(term: str) -> Iterator[str]:
    """A term and its beginnings of at least STEM letters: inflected words share them."""
    yield from (term[:n] for n in range(min(STEM, len(term)), len(term) + 1))


class _Hashes:
    """A growing set of 64-bit hashes in sorted runs, eight bytes each; a set of Python numbers takes ten times as much."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def holds(self, some: np.ndarray) -> np.ndarray:
        found = np.zeros(len(some), bool)
        for run in self.runs:
            found |= run[np.minimum(np.searchsorted(run, some), len(run) - 1)] == some
        return found

    def add(self, some: np.ndarray) -> None:
        """``some`` are distinct and not held yet."""
        if len(some):
            self.runs.append(np.sort(some))
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            last = self.runs.pop()
            self.runs[-1] = np.sort(np.concatenate([self.runs[-1], last]), kind="stable")


class _Counts:
    """How often each 64-bit hash was added, as sorted arrays; with ``among``, a sorted array, only those in it are counted."""

    def __init__(self, among: np.ndarray | None = None):
        self.among, self.held, self.waiting = among, [], 0
        self.keys = np.empty(0, np.int64) if among is None else among
        self.counts = np.zeros(len(self.keys), np.int64)

    def add(self, hashes: Iterable[int]) -> int:
        """The number of hashes added, counted or not."""
        some = np.fromiter(hashes, np.int64)
        self.held.append(some)
        self.waiting += len(some)
        if self.waiting >= 1 << 20:
            self.done()
        return len(some)

    def done(self) -> _Counts:
        if self.held:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.waiting = [], 0
            if self.among is None:
                every = np.union1d(self.keys, keys)
                old, self.keys, self.counts = (self.keys, self.counts), every, np.zeros(len(every), np.int64)
                self.counts[np.searchsorted(every, old[0])] = old[1]
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                known = self.keys[at] == keys
                self.counts[at[known]] += counts[known]
        return self


def _new_contexts(texts: list[str]) -> Iterator[tuple[list[str], list[tuple[str, str]]]]:
    """Of each text its terms, and each term with the next of the neighbourhoods not seen before.

    A text most of whose neighbourhoods were seen before is a copy of earlier ones and is passed over.
    """
    seen = _Hashes()
    for text in texts:
        terms = _TERM.findall(text.lower())
        own = {hash(c): c[1:] for c in zip(["", *terms[:-1]], terms, [*terms[1:], ""])}
        hashes = np.fromiter(own, np.int64, len(own))
        new = hashes[~seen.holds(hashes)]
        if 2 * len(new) < len(own):
            continue
        yield terms, [own[h] for h in new.tolist()]
        seen.add(new)


def _contexts(texts: list[str], among: np.ndarray | None = None) -> tuple[_Counts, _Counts, int, int]:
    """By hash of each stem: texts that have it; distinct neighbourhoods it stands in.  The latter over all stems, and the texts counted."""
    docs, around, total, counted = _Counts(among), _Counts(among), 0, 0
    for terms, new in _new_contexts(texts):
        docs.add({hash(s) for t in set(terms) for s in _stems(t)})
        total += around.add(hash(s) for term, _ in new for s in _stems(term))
        counted += 1
    return docs.done(), around.done(), total, counted


def _ratio(k: int, m: int, nt: int, no: int) -> float:
    """Likelihood ratio of k of nt against m of no; 0 if k is no more than expected."""
    expected = (k + m) * nt / max(1, nt + no)
    return 2 * (k * math.log(k / expected) + (m * math.log(m / (k + m - expected)) if m else 0.0)) if k > expected else 0.0


def _least_ratio(asked: int) -> float:
    """Chance lifts about one in e**(r / 2) candidates to a ratio of r, so of all asked hardly one gets so far."""
    return 2 * math.log(max(1, asked)) + 4


def toxic_stems(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Stems of toxic texts that are tied to the label."""
    td, tc, nt, toxics = _contexts(toxic)
    od, oc, no, others = _contexts(ordinary, tc.keys)
    docs = td.counts[np.searchsorted(td.keys, tc.keys)]
    least = _least_ratio(int(np.count_nonzero(tc.counts > 2)))
    lifted = np.flatnonzero(docs / max(1, toxics) >= MIN_LIFT * od.counts / max(1, others))
    good = {h for h, k, m, d, o in zip(*(a[lifted].tolist() for a in (tc.keys, tc.counts, oc.counts, docs, od.counts)))
            if min(_ratio(k, m, nt, no), _ratio(d, o, toxics, others)) >= least}
    return {s for text in toxic for t in set(_TERM.findall(text.lower())) for s in _stems(t) if hash(s) in good} if good else set()


def toxic_pairs(toxic: list[str], ordinary: list[str], tied: set[str]) -> set[tuple[str, str]]:
    """Pairs of words in a row, neither with a stem of ``tied``, that are tied to the label; counted by texts that have them."""
    def counts(texts: list[str], among: np.ndarray | None = None) -> tuple[_Counts, int]:
        found, counted = _Counts(among), 0
        for _, new in _new_contexts(texts):
            found.add({hash(pair) for pair in new})
            counted += 1
        return found.done(), counted

    tc, nt = counts(toxic)
    often, times = tc.keys[tc.counts > 2], tc.counts[tc.counts > 2]
    oc, no = counts(ordinary, often)
    least = _least_ratio(len(often))
    good = {h for h, k, m in zip(often.tolist(), times.tolist(), oc.counts.tolist())
            if k / max(1, nt) >= MIN_LIFT * m / max(1, no) and _ratio(k, m, nt, no) >= least}
    return {pair for _, new in _new_contexts(toxic) for pair in new
            if pair[1] and hash(pair) in good and not any(s in tied for t in pair for s in _stems(t))} if good else set()


def fit(rows: list[tuple[str | None, int]], window: int = WINDOW_WORDS, log_odds: float | None = None) -> ToxicityModel:
    """Dictionaries, threshold and curve from (text, label) rows; equal texts count once per label.

    ``log_odds`` are those of a toxic row where the model is used; by default those of the rows given.
    """
    rows = list(dict.fromkeys((t or "", int(y)) for t, y in rows))
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not ordinary:
        share = len(toxic) / len(rows) if rows else 0.0
        return ToxicityModel(b"", b"", 0.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)), window)
    step = max(1, sum(1 for t in ordinary for _ in windows(t, window)) // 40_000)
    base = _trained(list(islice((w for t in ordinary for w in windows(t, window)), 0, None, step)), BASE_BYTES) + _PAD
    tied = toxic_stems(toxic, ordinary)
    found = (max((s for s in _stems(t) if s in tied), key=len, default=None) for text in toxic for t in _TERM.findall(text.lower()))
    phrases = [f" {s}".encode() for s in found if s]
    held = _trained(phrases, TOXIC_BYTES) if phrases else b""
    # Training keeps what is frequent; the rarer windows are held as well.
    held = b"".join(p for p in dict.fromkeys(phrases) if p not in held) + held
    pairs = sorted(toxic_pairs(toxic, ordinary, tied))
    apart = b"".join(f" {word} ".encode() for words in zip(*pairs) for word in words)
    paired = b"".join(f" {one} {two} ".encode() for one, two in pairs)
    model = ToxicityModel(base, base + held, 0.0, 0.0, 0.0, window, frozenset(_seam(*pair) for pair in pairs),
                          base + apart, base + paired.rjust(len(apart)))
    meter = GainMeter(model)
    gains = [np.array([g for g in meter.gains(t) if g > 0], np.int32) for t, _ in rows]
    labels = np.array([y for _, y in rows], float)
    best, weight = np.inf, np.ones(len(labels))
    if log_odds is not None:
        weight[labels == 0] = len(toxic) / len(ordinary) / math.exp(log_odds)
        weight *= len(weight) / weight.sum()
    for threshold in range(6):
        x = np.log1p(np.array([np.maximum(g - threshold, 0).sum() for g in gains], float))
        slope, intercept = fit_newton(x[:, None], labels, weight=weight)
        loss = log_loss(sigmoid(intercept + slope * x), labels, weight)
        if loss < best - 1e-9:
            best, model.threshold, model.slope, model.intercept = loss, float(threshold), float(slope), float(intercept)
    return model


def fit_from(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    rows = labelled_sample(docs, labels, "toxic", per_class, max_chars, ["text"])
    seen = label_counts(labels, "toxic")
    log_odds = math.log(seen[1] / seen[0]) if seen.get(0) and seen.get(1) else None
    return fit([(r.text, r.label) for r in rows], log_odds=log_odds)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``evidence`` and ``score``; every column of ``docs`` is kept, and those two are replaced."""
    docs = docs.drop("evidence", "score")

    def run(batches):
        meter = GainMeter(model)
        for batch in batches:
            evidence = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                evidence[i] = sum(g - model.threshold for g in meter.gains(text.as_py()) if g > model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(evidence), pa.array(model.probability(evidence))],
                                             [*batch.schema.names, "evidence", "score"])

    return docs.mapInArrow(run, docs.withColumn("evidence", F.lit(0.0)).withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs.select("doc_id", "text"), fit_from(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
