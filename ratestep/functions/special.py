"""Special functions on arrays, from public formulae; no SciPy."""

from __future__ import annotations

import math

import numpy as np

NEG_INF = -np.inf
#: Bernoulli-number coefficients of Stirling's series, B_2k / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def lgamma(x) -> np.ndarray:
    """log Gamma for positive arguments: recurrence up to 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    z = x.copy()
    small = z < 10
    if small.any():
        prod = np.ones_like(x)
        while True:
            low = z < 10
            if not low.any():
                break
            prod = np.where(low, prod * z, prod)
            z = np.where(low, z + 1, z)
        with np.errstate(divide="ignore"):
            shift = np.where(small, np.log(prod), 0.0)
    inv2, series = 1 / (z * z), np.zeros_like(z)
    for c in reversed(_STIRLING):
        series = series * inv2 + c
    return (z - 0.5) * np.log(z) - z + _HALF_LOG_2PI + series / z - shift


def betaln(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a, dtype=float) + b)


def log_binom(n, k) -> np.ndarray:
    n, k = np.asarray(n, dtype=float), np.asarray(k, dtype=float)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def xlogy(x, y) -> np.ndarray:
    """x log y with 0 log 0 = 0."""
    x, y = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, y)))


def logsumexp(x, axis=None) -> np.ndarray:
    """log of the sum of exponentials; all -inf gives -inf."""
    x = np.asarray(x, dtype=float)
    top = np.max(x, axis=axis, keepdims=True) if x.size else np.full((1,) * x.ndim, NEG_INF)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - safe).sum(axis=axis, keepdims=True)) + safe
    return out.item() if axis is None else np.squeeze(out, axis=axis)


def log_add(a, b) -> np.ndarray:
    return np.logaddexp(a, b)


def _lentz(step, shape: tuple[int, ...], limit: int = 20_000) -> np.ndarray:
    """Modified Lentz evaluation of 1/(1 + a1/(1 + a2/(1 + ...))); ``step(k)`` gives (a_k, b_k)."""
    tiny = 1e-300
    f = np.full(shape, tiny)
    c, d = f.copy(), np.zeros(shape)
    for k in range(1, limit):
        a, b = step(k)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + a / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        ratio = c * d
        f = f * ratio
        if np.all(np.abs(ratio - 1) < 1e-15):
            break
    return f


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), DLMF 8.17.22 on the side where it converges fast."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    yy = np.where(inside, y, 0.5)

    def step(k: int):
        if k == 1:
            return np.ones_like(p), np.ones_like(p)
        m, odd = divmod(k - 1, 2)
        if odd:
            return -(p + m) * (p + q + m) * yy / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(p)
        return m * (q - m) * yy / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(p)

    with np.errstate(over="ignore", under="ignore"):
        front = np.exp(p * np.log(yy) + q * np.log1p(-yy) - betaln(p, q)) / p
        part = np.where(inside, front * _lentz(step, p.shape), np.where(y <= 0, 0.0, 1.0))
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


def betaincc(a, b, x) -> np.ndarray:
    return betainc(b, a, 1 - np.asarray(x, dtype=float))


def _gamma_both(a, x) -> tuple[np.ndarray, np.ndarray]:
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    series = x < a + 1
    positive = x > 0
    xx = np.where(positive, x, 1.0)
    with np.errstate(over="ignore", under="ignore"):
        front = np.exp(a * np.log(xx) - xx - lgamma(a))
    # Series for the lower part.
    term = np.where(series, 1 / a, 0.0)
    total, k = term.copy(), 0
    while np.any(np.abs(term) > np.abs(total) * 1e-17) and k < 100_000:
        k += 1
        term = term * np.where(series, xx / (a + k), 0.0)
        total += term
    lower = front * total
    # Continued fraction for the upper part, DLMF 8.9.2.
    far = np.where(series, a + 2, xx)

    def step(n: int):
        if n == 1:
            return np.ones_like(a), far + 1 - a
        return -(n - 1) * (n - 1 - a), far + 2 * n - 1 - a

    upper = front * _lentz(step, a.shape)
    p = np.where(positive, np.where(series, lower, 1 - upper), 0.0)
    q = np.where(positive, np.where(series, 1 - lower, upper), 1.0)
    return np.clip(p, 0, 1), np.clip(q, 0, 1)


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x)."""
    return _gamma_both(a, x)[0]


def gammaincc(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    return _gamma_both(a, x)[1]


def digamma(x) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        low = x < 10
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def log_rising(u: np.ndarray, y: float) -> np.ndarray:
    """log Gamma(u + y) - log Gamma(u); small whole ``y`` as products, which also loses nothing at large ``u``."""
    if y != int(y) or y > 48:
        return lgamma(u + y) - lgamma(u)
    out, left = np.zeros_like(u), int(y)
    at = u.copy()
    while left:
        prod = at
        for k in range(1, min(left, 8)):
            prod = prod * (at + k)
        out += np.log(prod)
        at = at + min(left, 8)
        left -= min(left, 8)
    return out


def betabinom_logpmf(x, n, u, v) -> np.ndarray:
    x, n = np.asarray(x, dtype=float), np.asarray(n, dtype=float)
    return log_binom(n, x) + betaln(x + u, n - x + v) - betaln(u, v)


def gamma_poisson_logpmf(y, e, u, v) -> np.ndarray:
    """Negative binomial of a count over exposure ``e`` with rate ~ Gamma(u, v)."""
    if np.ndim(y) == 0 and isinstance(u, np.ndarray):
        y = float(y)
        out = log_rising(u, y) - math.lgamma(y + 1) - u * np.log1p(e / v)
        return out + y * np.log(e / (v + e)) if y else out
    y = np.asarray(y, dtype=float)
    return lgamma(y + u) - lgamma(u) - lgamma(y + 1) + xlogy(y, e / (v + e)) - u * np.log1p(e / v)


def beta_negbinom_logpmf(y, e, r, u, v) -> np.ndarray:
    """NB(r e, p) with p ~ Beta(u, v): y events before r e of the other kind."""
    y, s = np.asarray(y, dtype=float), np.asarray(r * e, dtype=float)
    out = lgamma(y + s) - lgamma(s) - lgamma(y + 1) + betaln(u + s, v + y) - betaln(u, v)
    return out


def ks_uniform(u: np.ndarray) -> tuple[float, float]:
    """Kolmogorov distance from the uniform distribution and its asymptotic p-value."""
    u = np.sort(np.asarray(u, dtype=float))
    n = len(u)
    d = float(max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max()))
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))
    return d, float(min(max(p, 0.0), 1.0))
