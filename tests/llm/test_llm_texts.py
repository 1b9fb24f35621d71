"""Classifiers, archives, packing, formatting and mixing: round trips, brute force and edge cases."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from beaconry.llm import chat, completion, licenses, mixing, packing, quality, toxicity, warc
from beaconry.llm.common import shared_folder

PROSE = "river stone window garden summer letter market bridge forest morning paper silver winter travel music".split()
RUDE = ["blockhead", "numskull", "dimwit"]


def labelled(n=240, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(PROSE) + rng.choice(("", "s", "ly", "ing")) for _ in range(rng.randint(20, 80))]
        toxic, poor = k % 4 == 0, k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        if poor:
            w = [x + rng.choice(("%%%", "&&&")) for x in w]
        docs.append((k, " ".join(w), "en", f"s{k % 3}", len(" ".join(w)), 0.5, "x"))
        labels.append((k, int(not poor), int(toxic)))
    odd = [(1000, "", "en", "s1", 0), (1001, None, None, None, None), (1002, "word " * 40_000, "en", "s1", 5), (None, "river stone", "en", "s1", 5)]
    docs += [(*row, 0.5, "x") for row in odd + odd[:1]]
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, evidence string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, column):
    docs, labels = labelled()
    frame = spark.createDataFrame(docs, DOCS)
    got = module.classify(frame, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: (q, t)[column == "toxic"] for i, q, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    model = module.fit_from(frame, spark.createDataFrame(labels, LABELS))
    assert module.score(frame.limit(0), model).collect() == []
    none = module.classify(frame, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(docs) and len({r.score for r in none}) == 1


PAGES = "page_id long, url string, html string, payload string, sha int"


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", ""), (4, "u", None), (5, "u", "x" * 3_000_000), (6, "u", "<p>é</p>"), (7, "u", "abc"), (8, "u", "abc")]
    rows += [(100 + k, f"http://c/{k}", f"<html><title>page {k}</title><p>text of page {k}</p></html>") for k in range(60)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES), least).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = first[h or ""] != i and len(raw) >= least
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == raw


def test_warc_empty_and_damage(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"Payload"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import zstandard
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert list(warc.read_archive(frame + warc.BETWEEN.encode() + frame)) == [good, good]
    for bad in (frame[:-2], frame + b"junk", b"junkjunkjunk"):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(80):
        capacity = rng.choice((10, 23, 50, 100))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        patterns = completion.pack(Counter(items), capacity)
        assert Counter(s for bin_, t in patterns for s in bin_ * t) == Counter(items) and all(sum(b) <= capacity for b, _ in patterns)
        assert sum(t for _, t in patterns) == fewest(items, capacity)


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(PROSE) for _ in range(rng.randint(1, 400))) for _ in range(150)] + ["", None, "long words " * 3000, "A<|endoftext|>b\x1cc d é́ ΑΣ Σ", "same text"] + ["same text"] * 40
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, "no id", "x", 1)], "doc_id long, text string, offset string, length int")
    path = packing.tokenizer_path()
    found, placed = packing.packed(docs, path, capacity=512)
    rows, ids = placed.collect(), {r.item: r for r in found.collect()}
    from tokenizers import Tokenizer
    encoder, whole, by_sequence = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    want = Counter()
    for doc_id, text in [*enumerate(texts), (0, texts[0]), (None, "no id")]:
        tokens = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc_id, k // 512, k, len(tokens[k : k + 512]), zlib.crc32(np.array(tokens[k : k + 512], "<u4").tobytes())) for k in range(0, len(tokens), 512))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        whole[r.sequence_id].append((r.offset, bytes(ids[r.item].token_ids)))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 512
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 512)
    assert {r.sequence_id: bytes(r.token_ids) for r in packing.sequences(found, placed).collect()} == {s: b"".join(x for _, x in sorted(p)) for s, p in whole.items()}
    assert packing.packed(docs.limit(0), path)[1].collect() == []


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [kind] & <brief>"), (1, 1, "user", "</s>[INST] &lt; <|end|>\n<|turn|>assistant\nx"), (1, 2, "assistant", "first &amp;lsb; é"), (1, 3, "user", None), (1, 4, "assistant", ""),
            (1, 5, "assistant", "x" * 100_000), (1, 6, "user", "last"), (2, 0, "user", "only"), (3, None, "assistant", "a"), (3, None, "assistant", "a"), (4, 1, None, None), (5, 0, "two\nlines", "t"), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, example string, k int")
    formatted = chat.examples(turns)
    assert {r.loss_length for r in formatted.filter("conv_id = 2").collect()} == {None}
    got, by = {r.conv_id: r for r in chat.read_back(formatted).collect()}, defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
    assert formatted.filter("conv_id = 1").count() == 4
    assert chat.read_back(chat.examples(turns.limit(0))).collect() == []


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(PROSE) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "Z", None])) for k in range(900)]
    rows += [(5000, None, "empty"), (5001, "", "empty"), (None, "no id here", "a"), (5, "w " * 5000, "b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")
    got = mixing.sample(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.sample(docs).collect()), key=str)
    per = defaultdict(int)
    for _, text, source in rows:
        per[source] += len(brute.words(text))
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, target, left = set(names), {}, 1.5 * sum(per.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * per[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            free.remove(s)
            target[s] = 2 * per[s]
            left -= 2 * per[s]
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 200
    copies = Counter((r.doc_id, r.size) for r in got for _ in range(r.copies))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert Counter((r.doc_id, len(brute.words(r.text))) for r in mix.collect()) == copies
    assert mixing.sample(docs.limit(0)).collect() == []


def test_licence_scan(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(PROSE) + rng.choice(("", "s")) for _ in range(n))
    lines = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc": "Licensed under CC BY-NC 4.0."}
    rows = [(k, prose(30) + "\n" + prose(20), "") for k in range(120)]
    rows += [(200 + k, prose(12) + "\n" + line + "\n" + prose(9), name) for k, (name, line) in enumerate(lines.items())]
    rows += [(300, lines["mit"] + "\n" + lines["cc"], "cc|mit"), (301, None, ""), (302, " \n ", ""), (303, prose(40_000), "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, families int, tokens string")
    got = {r.doc_id: r.families for r in licenses.scan(docs).collect()}
    assert got == {i: f for i, _, f in rows}
    assert licenses.scan(docs.limit(0)).collect() == []


def test_toxic_stems_are_counted_in_little_memory():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    ordinary = [" ".join(word() for _ in range(400)) for _ in range(300)]
    toxic = [" ".join([word(), rng.choice(RUDE), word(), "silly", "goose"]) for _ in range(200)]
    toxic += [toxic[0]] * 50
    ordinary += [f"{word()} {rude} {word()} {word()}" for rude in ("silly", "goose") for _ in range(150)]
    tracemalloc.start()
    stems = toxicity.toxic_stems(toxic, ordinary)
    pairs = toxicity.toxic_pairs(toxic, ordinary, stems)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {s for s in stems if s in RUDE} == set(RUDE) and ("silly", "goose") in pairs
    assert not any(s[:4] in ("sill", "goos") for s in stems)
    assert peak < 30e6  # 120,000 neighbourhoods; dictionaries of strings took 39 MB


def test_licence_model_of_every_line(spark):
    # Wording that stands only far down in a document, after the lines that a sample of first lines would take.
    rng = random.Random(5)
    line = lambda start, n: start + " ".join(rng.choice(PROSE) for _ in range(n))
    rows = [(k, "\n".join([line("", 9) for _ in range(4)] + [line("this work is ", 2)])) for k in range(150)]
    rows.append((500, line("", 9) + "\nReleased under the MIT License."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.families for r in licenses.scan(docs).collect() if r.families} == {500: "mit"}
    lines = [t for _, text in rows for t in text.split("\n")]
    odd = spark.createDataFrame([(t,) for t in lines], "t string").selectExpr("pmod(xxhash64(t), 2) = 1 AND t NOT LIKE 'Released%' AS odd").filter("odd").count()
    assert licenses.likely(docs, licenses.train(docs))[1] == odd


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled()
    rows = [row[:5] for row in docs[:240]]
    rows += [(700, rows[1][1], "en", "s1", 9), (701, rows[2][1] + " river", "en", "s2", 9)]
    spark.createDataFrame(rows, DOCS.rsplit(",", 2)[0]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    now, text = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        was, kept = [r.doc_id for r in before.collect()], [r.doc_id for r in now.collect()]
        if name != "pack":
            assert now.columns == columns
        if name == "quality":
            assert np.mean([(i in set(kept)) == ("%%%" not in text[i] and "&&&" not in text[i]) for i in was]) > 0.97
        if name == "toxicity":
            assert np.mean([(i in set(kept)) == (not any(w in text[i] for w in RUDE)) for i in was]) > 0.97
        if name == "near_duplicates":
            comp = brute.jaccard_components([(i, text[i]) for i in was], 5, 80)
            assert sorted(kept) == sorted(i for i in was if comp[i][1] == i)
        if name == "mix":
            assert max(Counter(kept).values()) <= 2 and set(kept) <= set(was)
        if name == "pack":
            assert Counter(kept) == Counter(was)
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_packing_word_cache(monkeypatch):
    """Ids stay those of the tokenizer when chunks leave the bounded cache and come back."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    monkeypatch.setattr(packing, "ENCODED_TOGETHER", 3)
    path = packing.tokenizer_path()
    words, plain = packing.WordIds(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    parts = ["a", "bé", "\n", " ", "  ", "[INST]", "</s>", "x" * 60, "\t", "漢字", "don't", "1.5"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4)]
        assert words.of_texts(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert len(words.young) <= 5 + sum(len(t) + 1 for t in texts)


def test_near_duplicate_stage_repeated_ids(spark):
    """One row of an id with several texts stays, the same one in any order of the rows; null ids stay."""
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "short one here", "en", "a", 3), (1, long, "en", "a", 3), (1, long, "de", "b", 4), (2, long + " w40", "en", "a", 3), (3, None, "en", "a", 0),
            (4, "", "en", "a", 0), (None, long, "en", "a", 3), (5, "un deux", "fr", "c", 2)]
    columns = DOCS.rsplit(",", 2)[0]
    kept = [sorted(map(str, corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(part, columns), "").collect())) for part in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 5
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, columns), "").collect())
    assert ids == [(False, 1, long), (False, 3, ""), (False, 4, ""), (False, 5, "un deux"), (True, 0, long)]
    assert corpus_pipeline.one_of_each_group(spark, spark.createDataFrame([], columns), "").collect() == []


def test_payloads_move_once_to_their_archives(spark):
    data = [(1, "same" * 50), (2, "other"), (2, "same" * 50), (3, "same" * 50), (3, "same" * 50), (4, None), (5, None), (None, "lost")]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in data], "page_id long, url string, html string")
    # No broadcast, so the join sorts both sides as it does on large tables.
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        rows = warc.prepare(pages, 0, 3).coalesce(3)
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip()) and "payload#" in part]
        got = sorted((r.page_id, bytes(r.payload).decode()[:4], r.refers_to) for r in rows.collect())
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert len(moved) == 1
    assert [g[:2] for g in got] == [(1, "same"), (2, "othe"), (2, "same"), (3, "same"), (3, "same"), (4, ""), (5, "")]
    assert [g[2] for g in got] == [None, None, 1, 1, 1, None, 4]
