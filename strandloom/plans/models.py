"""Substitution and indel models: rate matrices, their exponentials, and Gamma rate classes.

Bases are always in the order T, C, A, G. A substitution model is scaled so that its
mean rate at equilibrium is mu, unless mu is None.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from .checks import number, numbers_of, whole


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    """Quantile of a Gamma distribution, by bisection."""
    if not 0 <= p < 1:
        return math.inf if p >= 1 else math.nan
    low, high = 0.0, shape + 1.0
    while lower_gamma(shape, high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if lower_gamma(shape, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2 * scale


def chi2_quantile(p: float, df: float) -> float:
    return gamma_quantile(p, df / 2, 2.0)


def discrete_gamma(shape: float, k: int) -> np.ndarray:
    """Means of k equally likely slices of a Gamma distribution with mean 1."""
    cuts = [0.0, *(gamma_quantile(i / k, shape) for i in range(1, k)), math.inf]
    f = [1.0 if c == math.inf else lower_gamma(shape + 1, c) for c in cuts]
    return k * np.diff(f)


@dataclass(frozen=True)
class Substitution:
    """A rate matrix per Gamma class, equilibrium frequencies, and the share of invariant sites."""

    name: str
    q: np.ndarray
    pi: np.ndarray
    gammas: np.ndarray = field(default_factory=lambda: np.ones(1))
    invariant: float = 0.0

    def rate_matrices(self) -> list[np.ndarray]:
        return [self.q * g for g in self.gammas]

    def mean_rate(self) -> float:
        """Mean rate over bases at equilibrium and over Gamma classes; invariant sites are not counted in."""
        return float(-(self.pi @ np.diag(self.q)) * self.gammas.mean())

    def rates_by_base(self) -> np.ndarray:
        return -np.diag(self.q) * self.gammas.mean()

    def eigen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """U, inverse of U and eigenvalues, or None if they are not real."""
        values, u = np.linalg.eig(self.q)
        if np.iscomplexobj(values) and np.abs(values.imag).max() > 1e-12 or np.linalg.cond(u) > 1e12:
            return None
        return u.real, np.linalg.inv(u.real), values.real

    def transition(self, t: float, gamma: float = 1.0) -> np.ndarray:
        """P(t) of a rate class; zero time gives the identity."""
        e = self.eigen()
        p = transition_by_squaring(self.q * gamma, t) if e is None else e[0] @ np.diag(np.exp(e[2] * gamma * t)) @ e[1]
        p = np.clip(p, 0, None)
        return p / p.sum(1, keepdims=True)

    def __repr__(self) -> str:
        return f"<{self.name}: pi={np.round(self.pi, 4).tolist()}, {len(self.gammas)} rate class(es), invariant={self.invariant}>"


def transition_by_squaring(q: np.ndarray, t: float, k: int = 30) -> np.ndarray:
    """(I + x + x^2 / 2)^(2^k) for x = qt / 2^k."""
    x = q * t / 2**k
    p = np.eye(len(q)) + x + x @ x / 2
    for _ in range(k):
        p = p @ p
    return p


def _finish(name: str, q: np.ndarray, pi: np.ndarray, mu: float | None, gamma_shape: float | None, gamma_k: int, invariant: float) -> Substitution:
    q = q.astype(float).copy()
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    if mu is not None:
        mean = abs(pi @ np.diag(q))
        if mean > 0:
            q *= number("mu", mu, 0) / mean
    if not 0 <= number("invariant", invariant) < 1:
        raise ValueError("invariant must be at least 0 and below 1")
    gammas = np.ones(1) if gamma_shape is None else discrete_gamma(number("gamma_shape", gamma_shape, 1e-6), whole("gamma_k", gamma_k, 2, 255))
    return Substitution(name, q, pi, gammas, float(invariant))


def tn93(pi: Sequence[float], alpha_1: float, alpha_2: float, beta: float, mu: float | None = 1, gamma_shape: float | None = None, gamma_k: int = 5, invariant: float = 0, name: str = "TN93") -> Substitution:
    p = np.array(numbers_of("pi", pi, 4))
    p /= p.sum()
    a1, a2, b = (number(n, x, 0) for n, x in (("alpha_1", alpha_1), ("alpha_2", alpha_2), ("beta", beta)))
    r = np.full((4, 4), b)
    r[0, 1] = r[1, 0] = a1
    r[2, 3] = r[3, 2] = a2
    return _finish(name, r * p[None, :], p, mu, gamma_shape, gamma_k, invariant)


def jc69(lambda_: float, **rest) -> Substitution:
    x = 4 * number("lambda_", lambda_, 0)
    return tn93([0.25] * 4, x, x, x, name="JC69", **rest)


def k80(alpha: float, beta: float, **rest) -> Substitution:
    return tn93([0.25] * 4, 4 * alpha, 4 * alpha, 4 * beta, name="K80", **rest)


def f81(pi: Sequence[float], **rest) -> Substitution:
    return tn93(pi, 1, 1, 1, name="F81", **rest)


def hky85(pi: Sequence[float], alpha: float, beta: float, **rest) -> Substitution:
    return tn93(pi, alpha, alpha, beta, name="HKY85", **rest)


def f84(pi: Sequence[float], beta: float, kappa: float, **rest) -> Substitution:
    p = np.array(numbers_of("pi", pi, 4))
    p /= p.sum()
    return tn93(p, (1 + kappa / (p[0] + p[1])) * beta, (1 + kappa / (p[2] + p[3])) * beta, beta, name="F84", **rest)


def gtr(pi: Sequence[float], abcdef: Sequence[float], mu: float | None = 1, gamma_shape: float | None = None, gamma_k: int = 5, invariant: float = 0) -> Substitution:
    """Exchange rates TC, TA, TG, CA, CG, AG times the frequency of the target base."""
    p = np.array(numbers_of("pi", pi, 4))
    p /= p.sum()
    r = np.zeros((4, 4))
    r[np.triu_indices(4, 1)] = numbers_of("abcdef", abcdef, 6)
    return _finish("GTR", (r + r.T) * p[None, :], p, mu, gamma_shape, gamma_k, invariant)


def unrest(q: Sequence[Sequence[float]], mu: float | None = 1, gamma_shape: float | None = None, gamma_k: int = 5, invariant: float = 0) -> Substitution:
    """Any off-diagonal rates; the frequencies solve pi Q = 0."""
    m = np.array(q, float)
    if m.shape != (4, 4):
        raise ValueError("q must be 4 x 4")
    np.fill_diagonal(m, 0)
    numbers_of("q", m.ravel().tolist())
    np.fill_diagonal(m, -m.sum(1))
    a = np.vstack([m.T, np.ones(4)])
    pi = np.clip(np.linalg.lstsq(a, np.array([0, 0, 0, 0, 1.0]), rcond=None)[0], 0, None)
    return _finish("UNREST", m, pi / pi.sum(), mu, gamma_shape, gamma_k, invariant)


@dataclass(frozen=True)
class Indels:
    """Rates of insertions or deletions of 1, 2, ... bases, per base and unit of time."""

    rates: np.ndarray

    def __repr__(self) -> str:
        return f"<indels: total rate {self.rates.sum():.4g}, up to {len(self.rates)} bases>"


def indels(rate: float, max_length: int = 10, a: float | None = None, rel_rates: Sequence[float] | None = None) -> Indels:
    """Rates fall as exp(-length), by Lavalette's law with exponent a, or as given; they sum to rate."""
    rate = number("rate", rate, 0)
    if rel_rates is not None:
        if a is not None:
            raise ValueError("give either a or rel_rates")
        r = np.array(numbers_of("rel_rates", rel_rates))
    else:
        m = whole("max_length", max_length, 1)
        n = np.arange(1, m + 1)
        r = np.exp(-n.astype(float)) if a is None else (n * m / (m - n + 1.0)) ** -number("a", a, 0)
    return Indels(r / r.sum() * rate)


def event_weights(sub: Substitution, ins: Indels, dels: Indels) -> np.ndarray:
    """4 x events: chances of a change to T, C, A, G, of each insertion and of each deletion, by base."""
    q = sub.q * sub.gammas.mean()
    q = q - np.diag(np.diag(q))
    both = np.concatenate([ins.rates, dels.rates]) * 0.25
    w = np.hstack([q, np.tile(both, (4, 1))])
    total = w.sum(1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)
