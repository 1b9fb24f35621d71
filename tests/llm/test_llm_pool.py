"""Co-training sees all unlabelled rows."""

import numpy as np

from beaconry.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _doc(i, text):
    return i, text, "en", "web", len(text)


def test_surest_rows_come_from_the_whole_pool(spark):
    good, bad = "plain words of a calm and useful page about rivers ", "$$$ win win win $$$ click click "
    rows = [_doc(k, (good if k % 2 else bad) * (1 + k % 5)) for k in range(400)]
    rows += [_doc(9_000 + k, good * 900) for k in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    views = quality._collected(docs.filter("doc_id < 200").select("doc_id", *quality._COLUMNS), list(range(200)))
    y = np.array([k % 2 for k in range(200)], float)
    fitted = [quality._fit_view([x], y, y * 0 + 1, 1e-4) for x in views]
    pool = quality.SparkPool(docs, docs.filter("doc_id < 200"))
    found = pool.sure(fitted, 500, 500, [set(), {201}])
    assert {9_000, 9_001, 9_002} <= set(found[1])  # of 45,900 characters each
    assert 201 not in found[1] and all(label == i % 2 for i, (label, _) in found[1].items() if i < 9_000)
    few = pool.sure(fitted, 2, 3, [set(), set()])
    assert sorted(label for label, _ in few[1].values()) == [0, 0, 0, 1, 1]


def test_scaled_rows_equal_a_scaled_copy():
    rng = np.random.default_rng(3)
    raw = [rng.random((n, 9)).astype(np.float32) for n in (40, 7)]
    share = np.concatenate([(np.arange(40) % 3 > 0), np.ones(7)]).astype(float)
    x = quality.Scaled(raw, share)
    both = np.concatenate(raw).astype(float)
    seen = both[share > 0, :-1]
    assert np.allclose(x.mean, seen.mean(axis=0), atol=1e-5) and np.allclose(x.scale, np.maximum(seen.std(axis=0), 0.01) * np.sqrt(8), atol=1e-5)
    copy = (both[:, :-1] - seen.mean(axis=0)) / x.scale * both[:, -1:]
    v, r = rng.random(8), rng.random(47)
    assert np.allclose(x @ v, copy @ v, atol=1e-5) and np.allclose(x.back(r), copy.T @ r, atol=1e-4)
