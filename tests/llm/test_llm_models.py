"""The two trained models against plain versions of their updates, number by number."""

import math
import random

import numpy as np
import pytest

from driftwell.llm import language_id, toxicity


def test_ftrl_updates(monkeypatch):
    """Per-coordinate steps, elastic net and softmax, with plain numbers."""
    monkeypatch.setattr(language_id, "BITS", 5)
    draw, n_classes, alpha, beta, l1, l2 = random.Random(1), 3, 0.7, 1.0, 0.05, 0.1
    rows = [(draw.randrange(n_classes), np.array(sorted(draw.sample(range(32), 4))), np.array([draw.uniform(0.1, 1) for _ in range(4)])) for _ in range(60)]
    weights, bias = language_id.fit_weights(rows, n_classes, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=5)

    z, n = ({(f, c): 0.0 for f in range(33) for c in range(n_classes)} for _ in range(2))

    def weight(f, c):
        if abs(z[f, c]) <= l1:
            return 0.0
        return (math.copysign(l1, z[f, c]) - z[f, c]) / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            label, at, x = rows[i]
            features = [*zip(at.tolist(), x.tolist()), (32, 1.0)]
            now = {(f, c): weight(f, c) for f, _ in features for c in range(n_classes)}
            scores = [sum(now[f, c] * v for f, v in features) for c in range(n_classes)]
            total = sum(math.exp(s) for s in scores)
            for f, v in features:
                for c in range(n_classes):
                    g = v * (math.exp(scores[c]) / total - (c == label))
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha
                    z[f, c] += g - sigma * now[f, c]
                    n[f, c] += g * g
    assert np.allclose(weights, [[weight(f, c) for c in range(n_classes)] for f in range(32)], atol=1e-9)
    assert np.allclose(bias, [weight(32, c) for c in range(n_classes)], atol=1e-9)
    assert (weights == 0).any() and (weights != 0).any()  # the penalty leaves some out


def test_temperature_is_the_best_of_a_grid():
    draw = np.random.default_rng(3)
    labels = draw.integers(0, 4, 400)
    scores = draw.normal(size=(400, 4))
    scores[np.arange(400), labels] += 1.0
    scores *= 6

    def loss(t):
        s = scores / t
        return (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(400), labels]).mean()

    found = language_id.find_temperature(scores, labels)
    assert loss(found) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.05), np.log(20), 400))) + 1e-9


@pytest.mark.parametrize("prior", [0.05, 0.6])
def test_non_negative_risk(monkeypatch, prior):
    """Steps on the corrected risk; where the part for clean texts falls below zero, steps back on it alone."""
    monkeypatch.setattr(toxicity, "BITS", 5)
    draw = random.Random(2)

    def rows_of(n, among):
        lists = [sorted(draw.sample(among, draw.randint(1, 4))) for _ in range(n)]
        return lists, toxicity.Rows(np.array([f for x in lists for f in x]), np.cumsum([0, *map(len, lists)]).astype(np.int64))

    (pos, p_rows), (unl, u_rows) = rows_of(20, range(0, 14)), rows_of(50, range(8, 32))
    epochs, batches, rate, penalty = 6, 4, 0.05, 1e-3
    model = toxicity.fit_weights(p_rows, u_rows, prior, epochs=epochs, batches=batches, rate=rate, penalty=penalty, seed=3)

    w = [0.0] * 32 + [math.log(prior / (1 - prior))]
    m, v, t, below = [0.0] * 33, [0.0] * 33, 0, 0
    order = np.random.default_rng(3)
    sigmoid, softplus = (lambda x: 1 / (1 + math.exp(-x))), (lambda x: math.log1p(math.exp(x)))
    for epoch in range(epochs):
        parts = [np.array_split(order.permutation(len(x)), batches) for x in (pos, unl)]
        for chosen_p, chosen_u in zip(*parts):
            ps, us = [pos[i] for i in chosen_p], [unl[i] for i in chosen_u]
            f = lambda x: sum(w[k] for k in x) + w[32]
            clean = sum(softplus(f(x)) for x in us) / len(us) - prior * sum(softplus(f(x)) for x in ps) / len(ps)
            g = [0.0] * 33
            for x in ps:
                toxic_part, clean_part = -prior * sigmoid(-f(x)) / len(ps), -prior * sigmoid(f(x)) / len(ps)
                slope = toxic_part + clean_part if clean >= 0 else -clean_part
                for k in (*x, 32):
                    g[k] += slope
            for x in us:
                slope = sigmoid(f(x)) / len(us)
                for k in (*x, 32):
                    g[k] += slope if clean >= 0 else -slope
            below += clean < 0
            t += 1
            scale = rate * (1 - epoch / epochs)
            for k in range(33):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                step = scale / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-4)
                w[k] -= step * m[k] / (1 - 0.9**t)
                if k < 32:
                    w[k] = math.copysign(max(abs(w[k]) - penalty * step, 0.0), w[k])
    assert np.allclose(model.weights, w[:32], atol=1e-9) and model.bias == pytest.approx(w[32], abs=1e-9)
    assert below > 0 or prior < 0.5
