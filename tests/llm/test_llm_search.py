"""Ranked search against a plain scorer, over many shapes of trees and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from beaconry.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string, n int, terms string, score double", "item_id long, text string, rank int"


def plain(docs, items, top=50):
    counted = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    N, L = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("riv", "Sto", "éc", "x9", "ß") for b in ("er", "NE", "ole", "日本", "_a", "-b", "q")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for k in range(400)]
    copy = docs[7][1]
    docs += [(500 + k, copy) for k in range(150)] + [(600, None), (601, ""), (602, " .,!"), (None, docs[3][1]), (3, docs[3][1]), (3, "other river")]
    docs += [(700, "river " * 3_000 + "quartz" * 400 + " stone_end")]
    items = [(k, " ".join(rng.sample(vocabulary, rng.randint(1, 9))).upper()) for k in range(30)]
    items += [(40, ""), (41, None), (42, "nowhere"), (43, "river"), (43, "xsto"), (None, "école"), (44, copy), (45, "quartz" * 400)]
    return docs, items


@pytest.mark.parametrize("leaf_docs,tree_docs,block_terms", [(64, 1 << 14, 1 << 15), (1, 50, 20), (5, 1 << 14, 60)])
def test_equals_plain_scorer(spark, leaf_docs, tree_docs, block_terms, monkeypatch):
    monkeypatch.setattr(fptree, "PIECE", 1_000)
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    got = fptree.ranked(frame, asked, 50, block_terms, tree_docs, leaf_docs).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, items)


def test_subtrees_are_left_out_and_none_too_many(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [np.unique(200 - np.minimum(rng.geometric(0.02, 12), 200)) for _ in range(3_000)]
    lengths = np.array([len(v) for v in vectors])
    tree = fptree.Tree(np.arange(3_000), rng.integers(50, 120, 3_000), np.concatenate(([0], np.cumsum(lengths))),
                       np.concatenate(vectors), rng.integers(1, 5, lengths.sum()), 200)
    assert max(h - lo for lo, h, (a, b) in zip(tree.lo, tree.hi, tree.children) if a == b) <= 64
    terms, weights = np.array([20, 50, 120, 199]), np.array([8_000, 4_000, 900, 100])
    scored, formula = [], fptree.saturated
    monkeypatch.setattr(fptree, "saturated", lambda tf, m: scored.append(tf.ndim == 1) or formula(tf, m))
    scores, ids = tree.search(terms, weights, (np.empty(0, np.int64), np.empty(0, np.int64)), 10)
    dense = dict(zip(terms.tolist(), weights.tolist()))
    want = []
    for d in range(3_000):
        a, b = tree.ends[d], tree.ends[d + 1]
        total = sum(dense.get(t, 0) * (1_000_000_000 * f // (1000 * f + 20 * int(tree.m[d]))) for t, f in zip(tree.terms[a:b].tolist(), tree.tfs[a:b].tolist()))
        want.append((-total, int(tree.ids[d])))
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == sorted(want)[:10]
    assert 0 < sum(scored) < len(tree.lo) // 4  # leaves whose documents were scored


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "river", 1)], ITEMS)
    assert fptree.ranked(docs, items).collect() == []
    assert fptree.ranked(spark.createDataFrame([(1, "river", 1, "", 0.5)], DOCS), items.limit(0)).collect() == []
