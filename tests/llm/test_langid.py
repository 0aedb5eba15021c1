"""The language model against plain follow-the-regularised-leader, weight by weight; its memory with very many labels."""

import math
import os
import sys
import tracemalloc

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_models import sentences  # noqa: E402

from sitespan.llm import langid  # noqa: E402


def plain_fit(rows, epochs=4, alpha=0.5, beta=1.0, l1=langid.L1, l2=langid.L2, seed=7):
    """(weights by (place, language), start values by language), one number at a time."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    grams = []
    for text, lang in rows:
        found = {}
        for p in langid.places(text).tolist():
            found[p] = found.get(p, 0) + 1
        whole = sum(found.values())
        grams.append(({p: n / whole for p, n in found.items()}, languages.index(lang)))
    docs = {}
    for found, _ in grams:
        for p in found:
            docs[p] = docs.get(p, 0) + 1
    idf = {p: math.log((1 + len(rows)) / (1 + n)) + 1 for p, n in docs.items()}
    z, sq = {}, {}

    def weight(at):
        v = z.get(at, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(sq.get(at, 0.0))) / alpha + l2)

    train = [g for k, g in enumerate(grams) if k % 5 != 4]
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            found, y = train[k]
            x = {p: tf * idf[p] * langid.SCALE for p, tf in found.items()} | {"start": 1.0}
            w = {(p, c): weight((p, c)) for p in x for c in range(len(languages))}
            s = [sum(v * w[p, c] for p, v in x.items()) for c in range(len(languages))]
            e = [math.exp(v - max(s)) for v in s]
            for p, v in x.items():
                for c in range(len(languages)):
                    g = v * (e[c] / sum(e) - (c == y))
                    before = sq.get((p, c), 0.0)
                    z[p, c] = z.get((p, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[p, c]
                    sq[p, c] = before + g * g
    return {(p, c): weight((p, c)) * idf[p] for p in docs for c in range(len(languages))}, [weight(("start", c)) for c in range(len(languages))]


@pytest.mark.parametrize("n", [12, 40])
def test_weights_as_by_plain_training(n):
    rows = [(t[:120], lang) for _, t, lang in sentences(5, n)]
    model = langid.fit(rows)
    want, start = plain_fit(rows)
    assert np.allclose(model.bias, start, atol=2e-3)
    differ = [abs(float(model.weights[model.row[p], c]) - w) for (p, c), w in want.items()]
    assert max(differ) < 2e-2 and sum(d > 2e-3 for d in differ) <= 0.01 * len(differ)  # single precision next to the threshold of l1
    zero = sum(w == 0 for w in want.values()) / len(want)
    assert abs(model.zero - zero) < 0.1


def test_two_thousand_labels_stay_below_a_gigabyte():
    rng = np.random.default_rng(1)
    letters = np.array([chr(0x4E00 + k) for k in range(6000)])
    rows = []
    for label in range(2000):
        own = letters[3 * label : 3 * label + 3]
        rows += [("".join(rng.choice(own, 6)) + "".join(rng.choice(letters, 20)), f"l{label:04d}") for _ in range(2)]
    rng.shuffle(rows)
    rows = [tuple(r) for r in rows]
    tracemalloc.start()
    model = langid.fit(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30, peak
    assert len(model.languages) == 2000 and model.weights.shape[1] == 2000 and model.weights.size <= langid.MOST_WEIGHTS + 2000


def test_fewer_places_where_weights_are_bounded():
    rows = [(t, lang) for _, t, lang in sentences(6, 400)]
    model = langid.fit(rows, most_weights=4 * 500)
    assert len(model.weights) <= 501
    right = sum(model.predict(t)[0] == lang for _, t, lang in sentences(8, 200))
    assert right >= 190
