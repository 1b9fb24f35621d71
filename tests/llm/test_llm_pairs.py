"""Pair operators against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import random

import brute
import numpy as np
import pytest

from beaconry.llm import caps, ngram_join, spotsigs
from beaconry.llm.components import components

DOCS = "doc_id long, text string, lang string, n long, component_id long, token string"


def made_texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, k = [], 0
    for size in (1, 3, 4, 40, 120, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 2, 5, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(120):  # a hot passage: near copies and unlike texts around it
        tail = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((2, 4, 8, 30))))
        rows.append((k, f"{shared}\n{tail}"))
        k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, " \t\n"), (k + 3, "LONG " * 30_000), (k + 4, "long " * 29_999)]
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, None, 1, 9, "x") for i, t in rows] + [(None, rows[0][1], None, None, None, None)], DOCS)
    got = ngram_join.near_duplicates(docs).collect()
    want = brute.jaccard_components(rows)
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_ngram_join_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1}
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []


def test_chosen_matches_grow_with_list_lengths():
    assert ngram_join.choose_matches(np.ones(200), 85) == 1
    assert ngram_join.choose_matches(np.full(200, 500.0), 85) > 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (7, None)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}


def test_caps_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 24))
    near = base[:60] + 0.15 * rng.normal(size=(60, 24)) * np.linalg.norm(base[:60], axis=1, keepdims=True) / np.sqrt(24)
    vectors = [x.tolist() for x in np.concatenate([base, near, base[:5], 3 * base[:5]]).astype(np.float32).astype(float)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows = [(k, v, k % 3, 5) for k, v in enumerate(vectors + odd)] + [(None, vectors[0], 0, 5)]
    got = {r.vec_id: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")).collect()}
    u = np.array(vectors)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    comp = brute.smallest_reachable(range(len(u)), [(int(a), int(b)) for a, b in np.argwhere(close)])
    assert len(got) == len(rows)
    for k in range(len(u)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (int(close[k].sum()), comp[k], comp[k] == k)
    for k in range(len(u), len(rows) - 1):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_vectors(rows):
    """Links and components of rows (vec_id, vector), each row a vector of its own."""
    u = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [(i, j) for i in range(len(u)) for j in range(i) if len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.95]
    count = [sum(i in link for link in links) for i in range(len(u))]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    comp = brute.smallest_reachable(range(len(u)), [(place[i], place[j]) for i, j in links])
    return sorted((rows[i][0], count[i], rows[order[comp[place[i]]]][0]) for i in range(len(u)))


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 7, 8, 64])
def test_caps_in_each_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(60, dim))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-9)
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * side
    rows = [(k, (2.0 * v).tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)


def test_caps_repeated_ids_of_unlike_vectors(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 32))
    rows = [(1, a.tolist()), (1, b.tolist()), (2, a.tolist()), (3, b.tolist()), (4, (a + 0.01 * b).tolist()), (1, a.tolist())]
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)


def test_spot_signatures(spark):
    import hashlib

    rows = [(k * 7, t) for k, t in enumerate(["the cat sat on the mat. It was the best of mats", "The cat sat on the mat. It was the best of mats!", "", None, "the the of the",
                                              "a" * 50_000, "é ü | ñ | ö", "word", "the cat sat on the mat. It was the best of mats"])]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, fingerprint string, n_chars double")
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs, n_anchors=3).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited_text) == (len(t), edited)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[56].fingerprint and got[0].near_next == 1.0
    assert got[14].fingerprint == "" and got[14].near_next == 1.0
    assert spotsigs.fingerprints(docs.limit(0)).collect() == []


def test_spot_signatures_repeated_and_missing_ids(spark):
    rows = [(1, "the cat sat on the mat and the dog ran off"), (1, "the cat sat on the mat and the dog ran off"), (2, None), (None, "the old man and the sea went on"), (None, None)]
    got = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), n_anchors=2).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 31), (1, 42), (1, 42), (2, 0)]
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0] == ones[1] and ones[0].near_next == 0.0 and ones[0].edited_text == rows[0][1][:32]
    assert [r.near_next for r in got if r.doc_id is None] == [None, None]
    for r in got:
        hashes = [int(h, 16) for h in r.fingerprint.split(",") if h]
        assert hashes == sorted(set(hashes)) and all(0 <= h < 2**32 for h in hashes)


def test_spot_signature_pairs(spark):
    rng = random.Random(1)
    sets = [(k, sorted(rng.sample(range(60), rng.randint(8, 40)))) for k in range(60)]
    sets += [(100 + k, s[1:]) for k, s in sets[:25]] + [(200, sets[0][1])]
    got = {tuple(r) for r in spotsigs.similar_pairs(spark.createDataFrame(sets, "doc_id long, hashes array<long>")).collect()}
    first = {}
    for k, s in sets:
        first.setdefault(tuple(s), k)
    want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items()
            if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert got == want


@pytest.mark.parametrize("text,n", [("", 0), (" \n", 0), ("A b", 1), ("a b c d", 1), ("a b c d e", 2), ("a " * 3_000_000, 1)])
def test_shingle_sets(text, n):
    from beaconry.llm.hashing import shingle_set, word_hashes
    assert len(shingle_set(word_hashes(text.encode()), 4)) == n
