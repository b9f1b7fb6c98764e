"""The network's scores against the same network in plain scalar loops, over every window of whole texts."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as tx
from tidemark.llm.common import text_buffers


def word_input(model, word):
    """A word's input from its own letters: tables are read by hashes of the word alone."""
    raw, at = text_buffers(pa.array([word]))
    bucket, grams, gat, inverse, _ = tx.words_of(raw, at)
    assert len(bucket) == 1 and len(inverse) == 1
    p, mine = model.p, [int(g) for g in grams[gat[0] : gat[1]]]
    assert len(mine) == max(1, len(word.encode()) + 2 - tx.GRAM + 1)
    mean = [sum(float(p["gram"][g][k]) for g in mine) / len(mine) for k in range(tx.DIM)]
    return [float(model.evidence[0][bucket[0]]), *map(float, p["word"][bucket[0]]), max(float(model.evidence[1][g]) for g in mine), *mean]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def gru(p, d, inputs):
    """States of one direction, one number at a time, in the order in which the words are read."""
    w, u, c, size = p[f"w{d}"].tolist(), p[f"u{d}"].tolist(), p[f"c{d}"].tolist(), tx.HIDDEN
    h, out = [0.0] * size, []
    for x in inputs:
        side = [c[j] + sum(x[i] * w[i][j] for i in range(len(x))) for j in range(3 * size)]
        z = [sigmoid(side[j] + sum(h[i] * u[i][j] for i in range(size))) for j in range(size)]
        r = [sigmoid(side[size + j] + sum(h[i] * u[i][size + j] for i in range(size))) for j in range(size)]
        n = [math.tanh(side[2 * size + j] + sum(r[i] * h[i] * u[i][2 * size + j] for i in range(size))) for j in range(size)]
        h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
        out.append(h)
    return out


def window_logit(model, inputs):
    p, size = model.p, tx.HIDDEN
    if not inputs:
        return float(p["bias"][0])
    back = gru(p, "b", inputs[::-1])[::-1]
    states = [f + b for f, b in zip(gru(p, "f", inputs), back, strict=True)]
    att, v = p["att"].tolist(), p["v"].tolist()
    e = [sum(v[j] * math.tanh(sum(s[i] * att[i][j] for i in range(2 * size))) for j in range(size)) for s in states]
    top = max(e)
    share = [math.exp(x - top) for x in e]
    total = sum(share)
    return float(p["bias"][0]) + sum(a / total * sum(s[i] * float(p["out"][i]) for i in range(2 * size)) for a, s in zip(share, states, strict=True))


def score(model, text):
    words = re.findall(r"(?:[A-Za-z]|[^\x00-\x7F])+", text or "")
    inputs = {w: word_input(model, w) for w in set(words)}
    starts = [0] if len(words) <= tx.WINDOW else range(0, len(words) - tx.WINDOW + tx.STRIDE, tx.STRIDE)
    best = max(window_logit(model, [inputs[w] for w in words[s : s + tx.WINDOW]]) for s in starts)
    return 1 / (1 + math.exp(-(model.scale * best + model.shift)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("uno dos tres café ocho nueve Diez once x über".split()) for _ in range(n))
    texts = [f"{say(rng.randint(0, 40))} {rng.choice(['VILE', 'vilest']) if i % 2 else 'kind'} {say(20)}" for i in range(120)]
    return tx.train(texts, [i % 2 for i in range(120)])


@pytest.mark.parametrize("text", [None, "", "... 12 !", "vile", "Uno dos, VILEST!tres", "kind café", "long"])
def test_scores_equal_scalar_loops(model, text):
    rng = random.Random(7)
    if text == "long":  # windows overlap, and the last one is short
        text = " ".join(rng.choice("uno dos tres café kind nueve".split()) for _ in range(151)) + " vile ocho"
    raw, at = text_buffers(pa.array(["before", text, "after it"]))
    got = tx._scores(model, raw, at)[1]
    assert got == pytest.approx(score(model, text), abs=2e-4)


def test_each_direction_and_every_window_count(model):
    """The network is no bag of words, and a text's score is that of its worst window, wherever it stands."""
    of = lambda *texts: tx._scores(model, *text_buffers(pa.array(texts)))
    a, b = of("uno dos vile tres ocho nueve", "nueve ocho tres vile dos uno")
    assert a != b
    calm = " ".join(["uno dos tres ocho"] * 100)
    at = [of(f"{' '.join(calm.split()[:k])} vile vilest {' '.join(calm.split()[k:])}")[0] for k in (0, 150, 400)]
    assert of(calm)[0] < 0.5 < min(at)
    assert np.ptp(at) < 0.5
