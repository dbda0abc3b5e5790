"""The non-negative risk against a plain version: dense rows, the risk by its formula, slopes by differences."""

import numpy as np
import pytest

from tallyspark.llm import toxicity

WORDS = 6


def rows(draw, n, chances):
    return [np.flatnonzero(draw.random(WORDS) < chances).astype(np.int32) for _ in range(n)]


def plain(positive, unlabelled, prior, epochs, rate=0.05, ridge=2e-4):
    """Weights of all words, the bias, and whether each step raised the negative risk instead of lowering the whole."""
    dense = lambda docs: np.array([[float(w in d) for w in range(WORDS)] for d in docs])
    p, u = dense(positive), dense(unlabelled)
    loss = lambda margin, label: np.mean(np.log1p(np.exp(-label * margin)))
    negative = lambda x: loss(u @ x[:-1] + x[-1], -1) - prior * loss(p @ x[:-1] + x[-1], -1)
    whole = lambda x: prior * loss(p @ x[:-1] + x[-1], 1) + negative(x)
    x, m, v, raised = np.append(np.zeros(WORDS), np.log(prior / (1 - prior))), 0.0, 0.0, []
    for epoch in range(1, epochs + 1):
        raised.append(negative(x) < 0)
        goal = (lambda y: -negative(y)) if raised[-1] else whole
        slope = np.array([(goal(x + 1e-5 * e) - goal(x - 1e-5 * e)) / 2e-5 for e in np.eye(WORDS + 1)])
        slope[:-1] += ridge * x[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        x = x - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-7)
    return x[:-1], x[-1], raised


@pytest.mark.parametrize(("prior", "kinds"), [(0.1, {False}), (0.6, {False, True})])
def test_fit_is_that_of_the_plain_risk(monkeypatch, prior, kinds):
    """With a prior far above the share of positives among the unlabelled the negative risk falls below 0 and is raised again."""
    monkeypatch.setattr(toxicity, "LEAST_ERRORS", 0.0)  # every word counts
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 0)
    draw = np.random.default_rng(11)
    bad, good = np.array([0.8, 0.7, 0.5, 0.2, 0.1, 0.5]), np.array([0.1, 0.05, 0.5, 0.6, 0.7, 0.4])
    positive, unlabelled = rows(draw, 60, bad), rows(draw, 20, bad) + rows(draw, 180, good)
    w, bias, raised = plain(positive, unlabelled, prior, 80)
    got, got_bias = toxicity.fit_nnpu(positive, unlabelled, prior, epochs=80)
    assert set(raised) == kinds
    assert np.allclose(got[:WORDS], w, atol=1e-4) and abs(got_bias - bias) < 1e-4 and not got[WORDS:].any()
    assert w[0] > 0.5 > -0.5 > w[4]


def test_words_that_tell_nothing_get_no_weight():
    draw = np.random.default_rng(5)
    positive, unlabelled = rows(draw, 300, np.array([0.9, 0.5, 0.5, 0.5, 0.5, 0.5])), rows(draw, 300, np.full(WORDS, 0.5))
    w, _ = toxicity.fit_nnpu(positive, unlabelled, 0.2, epochs=20)
    assert w[0] > 0 and not w[1:].any()


def test_without_positives_the_prior_stays():
    w, bias = toxicity.fit_nnpu([], [np.array([1], np.int32)], 0.2)
    assert not w.any() and bias == pytest.approx(np.log(0.25))
