"""Classifier fits against plain dense versions: the same risk, the same dual objective, the same weights."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from test_models import made

from dayglass.llm import quality, toxicity


def dense(slots, values, dims):
    x = np.zeros((len(slots), dims + 1))
    for row, at, v in zip(x, slots, values):
        row[at] = v
        row[-1] = 1.0
    return x


def hinge_dual(x, signs, cost, steps=60_000):
    """Weights from projected gradient steps on the dual, all multipliers at once."""
    z = x * signs[:, None]
    q = z @ z.T
    rate, alpha, ahead, t = 1 / np.linalg.eigvalsh(q).max(), np.zeros(len(x)), np.zeros(len(x)), 1.0
    for _ in range(steps):
        new = np.clip(ahead - rate * (q @ ahead - 1), 0, cost)
        if ((new - alpha) @ (ahead - new)) > 0:  # wrong way: start the momentum again
            t, ahead = 1.0, new
        else:
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, t = new + (t - 1) / t_new * (new - alpha), t_new
        alpha = new
    return z.T @ alpha, alpha @ q @ alpha / 2 - alpha.sum()


def dual_value(w, x, signs, cost):
    """Primal objective of weights: at the optimum minus the dual's."""
    return w @ w / 2 + (cost * np.maximum(0, 1 - signs * (x @ w))).sum()


@pytest.mark.parametrize("seed", range(3))
def test_dual_descent_finds_the_optimum(seed):
    rng = np.random.default_rng(seed)
    n, dims = 40, 12
    slots = [np.sort(rng.choice(dims, rng.integers(1, 6), replace=False)) for _ in range(n)]
    values = [rng.normal(size=len(s)) for s in slots]
    signs = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    cost = rng.uniform(0.2, 2.0, n)
    w = quality.fit_dual(slots, values, signs, dims, cost, 20_000, tolerance=1e-12)
    x = dense(slots, values, dims)
    want, objective = hinge_dual(x, signs, cost)
    assert np.abs(w - want).max() < 1e-6
    assert dual_value(w, x, signs, cost) == pytest.approx(-objective, rel=1e-9)


def test_quality_model_on_made_documents(spark):
    """Ratios over all labelled rows, and weights near the optimum of the same problem."""
    docs, labels = made(spark, 240)
    params = quality.QualityParams()
    model = quality.fit(docs, labels, params)
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    held = {d for d in known if zlib.crc32(str(d).encode()) % 3 == 1}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known and r.doc_id not in held]
    extractor = quality.Extractor(params)
    slots = [extractor.slots(t) for _, t in rows]
    truth = np.array([known[d] for d, _ in rows], dtype=float)
    good, bad = Counter(), Counter()
    for s, y in zip(slots, truth):
        (good if y == 1 else bad).update(s.tolist())
    p, q = (np.full(1 << params.bits, params.smoothing) for _ in range(2))
    for counts, into in ((good, p), (bad, q)):
        for k, n in counts.items():
            into[k] += n
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    seen = sorted(good.keys() | bad.keys())
    assert np.abs(model.ratios[seen] - ratios[seen]).max() < 1e-12
    assert not np.delete(model.ratios, seen).any()


def nnpu_steps(xp, xu, prior, params):
    """Full-batch Adam on the non-negative risk, from dense matrices; also how often it was below zero."""
    dims = xp.shape[1]
    decay = np.append(np.full(dims - 1, params.decay), 0.0)
    w, first, second = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    w[-1], below = np.log(prior / (1 - prior)), 0

    def sigmoid(z):
        return 1 / (1 + np.exp(-z))

    def negative(w):
        return np.logaddexp(0, xu @ w).mean() - prior * np.logaddexp(0, xp @ w).mean()

    def found_slope(w):
        return prior * (-sigmoid(-(xp @ w))[:, None] * xp).mean(axis=0)

    def negative_slope(w):
        return (sigmoid(xu @ w)[:, None] * xu).mean(axis=0) - prior * (sigmoid(xp @ w)[:, None] * xp).mean(axis=0)

    for step in range(1, params.epochs + 1):
        if negative(w) >= 0:
            grad = found_slope(w) + negative_slope(w)
        else:
            below += 1
            grad = -negative_slope(w)
        grad = grad + decay * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8 / np.sqrt(1 - 0.999**step))
    return w, below


@pytest.mark.parametrize(("seed", "prior", "epochs"), [(0, 0.2, 40), (1, 0.5, 80), (2, 0.8, 120)])
def test_nnpu_matches_a_dense_fit(seed, prior, epochs):
    """Weights after many full-batch steps; with a high prior the negative risk does fall below zero."""
    rng = np.random.default_rng(seed)
    dims = 8

    def rows(n, shift):
        slots = [np.sort(rng.choice(dims, rng.integers(1, 5), replace=False)).astype(np.int32) for _ in range(n)]
        slots = [np.unique(np.append(s, shift)).astype(np.int32) if rng.random() < 0.7 else s for s in slots]
        return slots, np.array([1 / np.sqrt(len(s)) for s in slots])

    positive, positive_scale = rows(15, 0)
    unlabelled, unlabelled_scale = rows(30, 5)
    params = toxicity.ToxicityParams(bits=3, epochs=epochs, batch=64)
    weights, bias = toxicity.fit_nnpu(positive, positive_scale, unlabelled, unlabelled_scale, prior, params)
    xp = dense(positive, positive_scale, dims)
    xu = dense(unlabelled, unlabelled_scale, dims)
    want, below = nnpu_steps(xp, xu, prior, params)
    assert below > 0 or prior < 0.8
    assert np.abs(np.append(weights, bias) - want).max() < 1e-6
