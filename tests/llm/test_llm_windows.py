"""Toxic windows that a least share of texts, or stems alone, would leave out."""

import random

from beaconry.llm import toxicity

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu", "mel", "san") for b in ("do", "ne", "pi", "lu") for c in ("r", "st", "ma", "vi")]


def _texts(rng, n, extra=()):
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(40)]
        at = rng.randrange(40)
        words[at:at] = extra
        out.append(" ".join(words))
    return out


def _evidence(model, text):
    return sum(max(g - model.threshold, 0) for g in toxicity.GainMeter(model).gains(text))


def test_rare_toxic_stem_earns_gain():
    rng = random.Random(5)
    toxic = _texts(rng, 2400, ["zwgfnord"]) + _texts(rng, 20, ["quxhjyp"])
    ordinary = _texts(rng, 2400)
    model = toxicity.fit([(t, 1) for t in toxic] + [(t, 0) for t in ordinary])
    plain = _texts(rng, 1)[0]
    assert _evidence(model, plain + " quxhjyp") > _evidence(model, plain)


def test_toxic_pair_of_harmless_words_earns_gain():
    rng = random.Random(6)
    toxic, ordinary = _texts(rng, 300, ["velvet", "hammers"]), [t for one in ("velvet", "hammers") for t in _texts(rng, 300, [one])]
    model = toxicity.fit([(t, 1) for t in toxic] + [(t, 0) for t in ordinary])
    plain = _texts(rng, 1)[0]
    apart = f"velvet {plain} hammers"
    assert _evidence(model, f"{plain} velvet hammers") > _evidence(model, apart)
    assert model.probability(_evidence(model, f"{plain} velvet hammers")) >= 0.5 > model.probability(_evidence(model, apart))
