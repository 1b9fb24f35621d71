"""Encoding and decoding against the tokenizers library, and the lexicon against a plain dictionary."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconry.llm import lexicon

PATH = lexicon.tokenizer_path()
LIBRARY, MERGER = Tokenizer.from_file(PATH), lexicon.Merger(PATH)
ODD = ["", " ", "\n\t \x0b\x1c\x1f\x85", "aaaaaaaaaaaaaaaaaaaab aaa", "it's WE'LL don't !'s ''re'", "ΟΔΟΣ Σ ΑΣ.", "İstanbul ŞIK ſ ﬁ Å", "éà ́x", "日本語テスト한국어", "a<|endoftext|>b<|startoftext|>",
       "<|endoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext", "x　y z w​v", "😀👍🏽 \U0001d400", "١٢٣ ½ 42 x9y", "՘ᲉꟋ\U00010d50 힤", "ünïcödé---...!!!???", "\x00\x01<>&", "q" * 3_000, "ab" * 2_000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert MERGER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiourstln'<|> \n.!éß")), max_size=60))
def test_any_text(text):
    words = lexicon._split(text)
    got = [i for ids in MERGER.encode(words) for i in ids.tolist()]
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_numbers_words():
    rng = random.Random(4)
    words = {("".join(rng.choices("abé", k=rng.randint(0, 6))) + rng.choice(("", "ing", "tion", "ers"))).encode(): None for _ in range(3_000)}
    words = {w: np.array([k, -k][: 1 + k % 2]) for k, w in enumerate(words)}
    found = lexicon.Transducer(lexicon.compiled(words))
    asked = [*words, b"", b"zz", b"ab", "aé".encode()[:-1], b"abing" * 9]
    got = found.numbers(asked)
    for word, k in zip(asked, got.tolist()):
        assert (found.ids[found.begin[k] : found.begin[k + 1]].tolist() if k >= 0 else None) == (words[word].tolist() if word in words else None)
    assert sorted(k for k in got[: len(words)]) == list(range(len(words)))
    # States of the minimal automaton are the distinct sets of endings after each prefix.
    after = {}
    for w in words:
        for k in range(len(w) + 1):
            after.setdefault(w[:k], set()).add(w[k:])
    assert len(found.ends) == len({frozenset(s) for s in after.values()})
    assert lexicon.Transducer(lexicon.compiled({})).numbers([b"", b"a"]).tolist() == [-1, -1]


@pytest.mark.parametrize("words,slice_chars,cached", [(100_000, 2_000_000, 150_000), (5, 200, 30), (0, 2_000_000, 150_000)])
def test_round_trip_equals_library(spark, words, slice_chars, cached, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(lexicon, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(lexicon, "CACHED_WORDS", cached)
    texts = [*ODD, None, None, "river stone " * 20_000] + [" ".join(rng.choices(["River", "stone,", "über", "x1", "it's", "\n"], k=50)) for _ in range(60)]
    rows = [(k if k % 9 else 0, t, [1.5], "kept") for k, t in enumerate(texts)] + [(None, "river", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids array<double>, decoded string").repartition(3)
    coded = lexicon.encode(frame, words=words)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    got = lexicon.decode(coded).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t, _, _ in rows)
    for r in got:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    assert lexicon.encode(frame.limit(0)).collect() == []


def test_digests(spark):
    row = lexicon.round_trip(spark.createDataFrame([(1, "It's a river."), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    ids = LIBRARY.encode("It's a river.", add_special_tokens=False).ids
    assert tuple(row[0]) == (1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert tuple(row[1]) == (2, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
