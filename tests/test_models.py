import numpy as np
import pytest

from strandloom.plans import models as m

PI = [0.1, 0.2, 0.3, 0.4]


def scaled(q, pi, mu=1):
    q = np.array(q, float)
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q * mu / abs(np.array(pi) @ np.diag(q))


def test_matrices():
    assert np.allclose(m.jc69(0.1, mu=None).q, np.full((4, 4), 0.1) - np.eye(4) * 0.4)
    k = m.k80(0.25, 0.5, mu=None).q
    assert k[0, 1] == k[2, 3] == 0.25 and k[0, 2] == k[1, 3] == 0.5
    assert np.allclose(m.f81(PI).q, scaled(np.tile(PI, (4, 1)), PI))
    h = m.hky85(PI, 0.25, 0.5, mu=None).q
    assert np.isclose(h[0, 1], 0.25 * 0.2) and np.isclose(h[0, 2], 0.5 * 0.3)
    f = m.f84(PI, 0.5, 0.75, mu=None).q
    assert np.isclose(f[0, 1], (1 + 0.75 / 0.3) * 0.5 * 0.2) and np.isclose(f[2, 3], (1 + 0.75 / 0.7) * 0.5 * 0.4)
    t = m.tn93(PI, 0.25, 0.35, 0.5, mu=None).q
    assert np.isclose(t[1, 0], 0.025) and np.isclose(t[3, 2], 0.105) and np.isclose(t[3, 0], 0.05)
    g = m.gtr(PI, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], mu=None).q
    assert np.isclose(g[0, 3], 0.3 * 0.4) and np.isclose(g[3, 2], 0.6 * 0.3)
    u = m.unrest(np.arange(1, 17).reshape(4, 4).T.tolist())
    assert np.allclose(u.pi @ u.q, 0) and np.isclose(u.mean_rate(), 1)


@pytest.mark.parametrize("s", [m.jc69(0.1), m.hky85(PI, 0.25, 0.5), m.gtr(PI, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), m.unrest(np.arange(1, 17).reshape(4, 4).T.tolist())])
def test_transition(s):
    assert np.allclose(s.transition(0), np.eye(4))
    assert np.allclose(s.transition(0.7), m.transition_by_squaring(s.q, 0.7), atol=1e-7)
    assert np.allclose(s.transition(500), np.tile(s.pi, (4, 1)), atol=1e-6)


def test_gamma():
    for shape in (0.5, 1.0, 2.0):
        g = m.discrete_gamma(shape, 5)
        assert np.isclose(g.mean(), 1) and (np.diff(g) > 0).all()
    assert np.isclose(m.chi2_quantile(0.95, 1), 3.841458820694124) and np.isclose(m.gamma_quantile(0.5, 1), np.log(2))
    s = m.jc69(0.1, gamma_shape=1.0, gamma_k=4)
    assert np.allclose(np.mean(s.rate_matrices(), 0), s.q)


def test_indels():
    x = m.indels(0.2, 8).rates
    assert np.isclose(x.sum(), 0.2) and np.allclose(x[1:] / x[:-1], np.exp(-1))
    n = np.arange(1, 11)
    y = (n * 10 / (10 - n + 1)) ** -0.5
    assert np.allclose(m.indels(0.3, 10, a=0.5).rates, y / y.sum() * 0.3)
    assert np.allclose(m.indels(1, rel_rates=[1, 3]).rates, [0.25, 0.75])
    for bad in (lambda: m.indels(-1), lambda: m.indels(1, 0), lambda: m.indels(1, a=1, rel_rates=[1])):
        with pytest.raises(ValueError):
            bad()


def test_arguments():
    for bad in (lambda: m.jc69(-1), lambda: m.f81([1, 1, 1]), lambda: m.jc69(1, invariant=1), lambda: m.jc69(1, gamma_shape=1, gamma_k=1), lambda: m.gtr(PI, [1] * 5), lambda: m.unrest([[1]])):
        with pytest.raises(ValueError):
            bad()


def test_event_weights():
    w = m.event_weights(m.jc69(1), m.indels(0.4, 2), m.indels(0.4, 3))
    assert w.shape == (4, 9) and np.allclose(w.sum(1), 1) and np.allclose(np.diag(w), 0)
