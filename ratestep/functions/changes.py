"""Endless change-point streams: the posterior of the current segment's length, one interval at a time.

The state is one table of components: run lengths lo..hi of the current segment, the conjugate counts (u, v) of its data, and a matrix of
probabilities with a column for each component and a row for each number of changes so far (one row if the hazard is known). Whatever is
asked of it is a mixture over that table, and all means and spreads of mixtures come from ``blend``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ratestep.functions.special import beta_negbinom_logpmf, betabinom_logpmf, betainc, betaln, gamma_poisson_logpmf, logsumexp

#: The dispersions of a mixture; counts of that many more events spread twice a Poisson's variance.
DISPERSIONS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, math.inf)
_TABLE = np.dtype([("lo", "i8"), ("hi", "i8"), ("u", "f8"), ("v", "f8")])
#: Terms of a distribution function that are added at a time; what a component of less weight adds cannot be seen in a double.
_TERMS, _LEAST = 512, 1e-18


def blend(weight: np.ndarray, mean: np.ndarray, var: np.ndarray, first: np.ndarray | tuple = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, mean and variance of each mixture of consecutive members; ``first`` says where the mixtures begin.

    The variance is that within members plus that of their means about the mixture's, so no large squares are subtracted.
    """
    first = np.asarray(first)
    total = np.add.reduceat(weight, first)
    safe = np.where(total > 0, total, 1.0)
    m = np.add.reduceat(weight * mean, first) / safe
    off = mean - np.repeat(m, np.diff(np.r_[first, len(mean)]))
    return total, m, np.add.reduceat(weight * (var + off * off), first) / safe


def _beta(u, v) -> tuple[np.ndarray, np.ndarray]:
    m = u / (u + v)
    return m, m * (1 - m) / (u + v + 1)


def _gamma(u, v) -> tuple[np.ndarray, np.ndarray]:
    return u / v, u / v**2


def checked(kind: str, x, size) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sizes (exposures, or trials) as arrays; raises before anything is added."""
    x = np.atleast_1d(np.asarray(x, dtype=float))
    if size is None:
        if kind == "bernoulli":
            raise ValueError("the number of trials is missing")
        size = 1.0
    size = np.broadcast_to(np.asarray(size, dtype=float), x.shape)
    if not (np.isfinite(x).all() and np.isfinite(size).all()):
        raise ValueError("counts and sizes must be finite")
    if (x < 0).any() or (size < 0).any() or (x != np.floor(x)).any():
        raise ValueError("counts must be whole and not negative, sizes not negative")
    if kind == "bernoulli" and ((x > size).any() or (size != np.floor(size)).any()):
        raise ValueError("more successes than trials, or trials that are not whole")
    if kind != "bernoulli" and ((x > 0) & (size == 0)).any():
        raise ValueError("events in an interval without exposure")
    return x, size


def negbinomial_prior(alpha: float, beta: float, r: float) -> tuple[float, float]:
    """Beta prior of p for NB(r e, p) whose rate r (1 - p) / p has the mean and variance of Gamma(alpha, beta)."""
    return beta * r + alpha + 2, alpha + alpha * (1 + alpha) / (beta * r)


class Predictor:
    """What streams and mixtures of them share: everything that follows from ``next_logpmf`` and ``next_cdf``."""

    def next_pmf(self, x, size=None) -> np.ndarray:
        return np.exp(self.next_logpmf(x, size))

    def pit(self, x, size=None, u: float | None = None, rng=None) -> float:
        """P(less than x) + u P(x) before x is added; ``u`` is drawn if it is not given."""
        share = float((rng or np.random.default_rng()).random() if u is None else u)
        x = float(np.atleast_1d(np.asarray(x, dtype=float))[0])
        less = float(self.next_cdf(x - 1, size)[0]) if x > 0 else 0.0
        return min(1.0, less + share * float(self.next_pmf(x, size)[0]))


class ChangePointStream(Predictor):
    """Run lengths of the current segment, for streams without end.

    Entries of the probabilities below ``prune`` are dropped, and all but the ``max_runs`` most probable components. Runs longer than
    ``exact_recent`` share components by ``merge_bins`` classes an octave of the longest run, matched in mean and variance; a class that no
    conjugate distribution matches stays apart. Components without any weight go, so the state stays small whatever the options are.
    """

    def __init__(
        self, kind: str, prior: tuple[float, float], expected_run_length: float, prune: float = 1e-12, max_runs: int | None = None, merge_bins: int | None = 32,
        exact_recent: int = 128, dispersion: float | None = None, hazard_strength: float | None = None, lag: int | None = None,
    ):
        if kind not in ("bernoulli", "poisson", "negbin"):
            raise ValueError("unknown kind")
        if not (all(p > 0 for p in prior) and expected_run_length >= 1 and prune >= 0):
            raise ValueError("prior parameters must be positive, the expected run length at least 1")
        if (kind == "negbin") != (dispersion is not None) or (dispersion is not None and not dispersion > 0):
            raise ValueError("dispersion goes with the negative binomial and must be positive")
        if (hazard_strength is not None and not hazard_strength > 0) or (lag is not None and lag < 1) or (max_runs is not None and max_runs < 1):
            raise ValueError("hazard strength, lag and number of runs must be positive")
        if hazard_strength is not None and not expected_run_length > 1:
            raise ValueError("a learnt hazard needs an expected run length over 1")
        self.kind, self.prior, self.expected_run_length, self.prune, self.max_runs = kind, tuple(map(float, prior)), float(expected_run_length), prune, max_runs
        self.merge_bins, self.exact_recent, self.dispersion, self.hazard_strength, self.lag = merge_bins, exact_recent, dispersion, hazard_strength, lag
        self.T, self.log_marginal = 0, 0.0
        # Components by decreasing length; rows of p are numbers of changes from c0 on.
        self.runs, self.p, self.c0 = np.zeros(0, dtype=_TABLE), np.zeros((1, 0)), 0
        self.q = np.zeros((0, 1, 0))
        self._seen: tuple | None = None

    @classmethod
    def bernoulli(cls, expected_run_length: float, sigma: float = 1.0, gamma: float = 1.0, **kw) -> ChangePointStream:
        return cls("bernoulli", (sigma, gamma), expected_run_length, **kw)

    @classmethod
    def poisson(cls, alpha: float, beta: float, expected_run_length: float, **kw) -> ChangePointStream:
        return cls("poisson", (alpha, beta), expected_run_length, **kw)

    @classmethod
    def negbinomial(cls, alpha: float, beta: float, r: float, expected_run_length: float, **kw) -> ChangePointStream:
        return cls("negbin", negbinomial_prior(alpha, beta, r), expected_run_length, dispersion=r, **kw)

    @staticmethod
    def overdispersed(alpha: float, beta: float, expected_run_length: float, dispersions=DISPERSIONS, **kw) -> ChangePointMixture:
        return ChangePointMixture(alpha, beta, expected_run_length, dispersions, **kw)

    # The hazard: known, or Beta with as many changes as the row says

    def _hazard_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Beta counts of change and of no change, by row."""
        changes = self.c0 + np.arange(len(self.p))
        chances = max(self.T - 1, 0)
        return self.hazard_strength + changes, self.hazard_strength * (self.expected_run_length - 1) + chances - changes

    def _hazards(self) -> np.ndarray:
        """P(the next interval starts a segment), by row, as a column."""
        if self.hazard_strength is None:
            return np.array([[1 / self.expected_run_length]])
        a, b = self._hazard_counts()
        return (a / (a + b))[:, None]

    def hazard_posterior(self) -> tuple[float, float]:
        if self.hazard_strength is None:
            return 1 / self.expected_run_length, 0.0
        _, m, var = blend(self.p.sum(1) if self.T else np.ones(1), *_beta(*self._hazard_counts()))
        return float(m[0]), math.sqrt(var[0])

    # Predictions: the components go on, or a new segment begins

    def _posterior(self) -> tuple[np.ndarray, np.ndarray]:
        """Conjugate parameters of every component, and last those of a new segment."""
        return np.r_[self.runs["u"], 0.0] + self.prior[0], np.r_[self.runs["v"], 0.0] + self.prior[1]

    def _weights(self) -> np.ndarray:
        if not self.T:
            return np.ones(1)
        h = self._hazards()
        return np.r_[((1 - h) * self.p).sum(0), (h * self.p).sum()]

    def _logpmf(self, x: float, size: float) -> np.ndarray:
        """log P(x) under each component and a new segment; kept for the update that may follow."""
        if self._seen is None or self._seen[:3] != (self.T, x, size):
            u, v = self._posterior()
            if self.kind == "bernoulli":
                out = betabinom_logpmf(x, size, u, v)
            elif self.kind == "negbin":
                out = beta_negbinom_logpmf(x, size, self.dispersion, u, v)
            else:
                out = gamma_poisson_logpmf(x, size, u, v)
            self._seen = (self.T, x, size, out)
        return self._seen[3]

    def next_logpmf(self, x, size=None) -> np.ndarray:
        x, size = checked(self.kind, x, size)
        with np.errstate(divide="ignore"):
            lw = np.log(self._weights())
        return np.array([logsumexp(lw + self._logpmf(float(k), float(s))) for k, s in zip(x, size, strict=True)])

    def _cdf(self, x: float, size: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """P(at most x) of each component: in closed form where there is one and x is large, else first term and ratios, added in logs."""
        if size == 0 or (self.kind == "bernoulli" and x >= size):
            return np.ones(len(u))
        if self.kind == "poisson":
            if x >= _TERMS:
                return betainc(u, x + 1, v / (v + size))
            last = -u * np.log1p(size / v)
        elif self.kind == "negbin":
            n = self.dispersion * size
            last = betaln(u + n, v) - betaln(u, v)
        else:
            last = betaln(u, v + size) - betaln(u, v)
        total = np.exp(last)
        for lo in range(0, int(x), _TERMS):
            j = np.arange(lo, min(lo + _TERMS, int(x)), dtype=float)[:, None]
            if self.kind == "poisson":
                ratio = (u + j) / (j + 1) * (size / (v + size))
            elif self.kind == "negbin":
                ratio = (n + j) / (j + 1) * ((v + j) / (u + v + n + j))
            else:
                ratio = (size - j) / (j + 1) * ((u + j) / (v + size - 1 - j))
            terms = last + np.cumsum(np.log(ratio), axis=0)
            total, last = total + np.exp(terms).sum(0), terms[-1]
        return total

    def next_cdf(self, x, size=None) -> np.ndarray:
        x, size = checked(self.kind, x, size)
        w, (u, v) = self._weights(), self._posterior()
        at = w > _LEAST
        return np.array([min(1.0, float(w[at] @ self._cdf(float(k), float(s), u[at], v[at]))) for k, s in zip(x, size, strict=True)])

    # Updates

    def update(self, x, size=None) -> ChangePointStream:
        """Add intervals; all are checked before the first is added."""
        x, size = checked(self.kind, x, size)
        for k, s in zip(x, size, strict=True):
            self._add(float(k), float(s))
        return self

    def _add(self, x: float, size: float) -> None:
        pred = self._logpmf(x, size)
        if not self.T:
            self.log_marginal += float(pred[0])
            self.p = np.ones((1, 1))
            if self.lag:
                self.q = np.ones((1, 1, 1))
        else:
            top = float(pred.max())
            h, like = self._hazards(), np.exp(pred - top)
            stay, born = (1 - h) * self.p * like[:-1], (h * self.p).sum(1) * like[-1]
            # With a learnt hazard, a change moves to the next row.
            down = int(self.hazard_strength is not None)
            grown = np.zeros((len(stay) + down, stay.shape[1] + 1))
            grown[: len(stay), :-1], grown[down:, -1] = stay, born
            total = float(grown.sum())
            self.log_marginal += math.log(total) + top
            if self.lag:
                self._age(h, down)
            self.p = grown / total
        self.runs = np.append(self.runs, np.zeros(1, dtype=_TABLE))
        self.runs["lo"] += 1
        self.runs["hi"] += 1
        self.runs["u"] += self.dispersion * size if self.kind == "negbin" else x
        self.runs["v"] += {"bernoulli": size - x, "poisson": size, "negbin": x}[self.kind]
        self._drop()
        if self.merge_bins:
            self._merge()
        self.T += 1

    def _age(self, h: np.ndarray, down: int) -> None:
        """Shares one interval on: q[j, c, i] is P(a segment started j intervals ago | row c, component i)."""
        _, rows, cols = self.q.shape
        keep = self.q[: self.lag - 1]
        q = np.zeros((len(keep) + 1, rows + down, cols + 1))
        q[1:, :rows, :-1] = keep
        # A new segment takes over the mixture of what it may have ended.
        w = h * self.p
        mass = w.sum(1)
        q[1:, down:, -1] = (keep * w).sum(2) / np.where(mass > 0, mass, 1.0)
        q[0, :, -1] = 1.0
        self.q = q

    def _keep(self, columns) -> None:
        self.runs, self.p = self.runs[columns], self.p[:, columns]
        if self.lag:
            self.q = self.q[:, :, columns]

    def _drop(self) -> None:
        """Entries below the least weight become nothing; then components, and rows at either end, without weight go."""
        small = self.p < self.prune
        if small.any():
            small.flat[np.argmax(self.p)] = False
            self.p = np.where(small, 0.0, self.p)
        total = self.p.sum(0)
        if self.max_runs is not None and np.count_nonzero(total) > self.max_runs:
            # Of equal ones the shortest, which come last.
            most = np.sort(np.argsort(total, kind="stable")[-self.max_runs :])
            self._keep(most)
            total = total[most]
        if not (total > 0).all():
            self._keep(total > 0)
        rows = np.flatnonzero(self.p.any(1))
        if rows[-1] - rows[0] + 1 < len(self.p):
            span = slice(rows[0], rows[-1] + 1)
            self.p, self.c0 = self.p[span], self.c0 + int(rows[0])
            if self.lag:
                self.q = self.q[:, span]
        self.p = self.p / self.p.sum()

    def _merge(self) -> None:
        n = int(np.count_nonzero(self.runs["lo"] > self.exact_recent))
        if n < 2:
            return
        old, weight = self.runs[:n], self.p[:, :n].sum(0)
        octave = np.floor(self.merge_bins * np.log2(old["hi"]))
        starts = np.r_[True, octave[1:] != octave[:-1]]
        if starts.all():
            return
        a, b = self.prior
        latent = _gamma if self.kind == "poisson" else _beta
        first = np.flatnonzero(starts)
        _, m, var = blend(weight, *latent(old["u"] + a, old["v"] + b), first)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "poisson":
                u, v = m * m / var, m / var
            else:
                u, v = m * (m * (1 - m) / var - 1), (1 - m) * (m * (1 - m) / var - 1)
        size = np.diff(np.r_[first, n])
        fits = np.isfinite(u) & np.isfinite(v) & (u > 0) & (v > 0)
        # Classes of one, and those that nothing matches, go on as they are.
        joined = np.repeat(fits & (size > 1), size)
        starts |= ~joined
        head = np.flatnonzero(starts)
        new, tail = old[head].copy(), np.r_[head[1:], n] - 1
        which = joined[head]
        new["lo"] = old["lo"][tail]
        new["u"][which], new["v"][which] = (u - a)[fits & (size > 1)], (v - b)[fits & (size > 1)]
        p = np.add.reduceat(self.p[:, :n], head, axis=1)
        if self.lag:
            part = np.add.reduceat(self.q[:, :, :n] * self.p[:, :n], head, axis=2) / np.where(p > 0, p, 1.0)
            self.q = np.concatenate([part, self.q[:, :, n:]], axis=2)
        self.p, self.runs = np.concatenate([p, self.p[:, n:]], axis=1), np.concatenate([new, self.runs[n:]])

    # The state

    @property
    def n_runs(self) -> int:
        return len(self.runs)

    def run_length_ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortest and longest run and probability of each component, by length."""
        by = self.runs[::-1]
        return by["lo"].copy(), by["hi"].copy(), self.p.sum(0)[::-1]

    def run_length_posterior(self) -> tuple[np.ndarray, np.ndarray]:
        """Run lengths and their probabilities; a component's is shared evenly among its lengths. Lengths of several components are added up."""
        lo, hi, p = self.run_length_ranges()
        if not len(lo):
            return lo, p
        n = hi - lo + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length, at = np.unique(np.repeat(lo, n) + within, return_inverse=True)
        return length, np.bincount(at, weights=np.repeat(p / n, n))

    def p_change_within(self, k: int) -> float:
        """P(the current segment is at most k intervals long); the first interval starts one."""
        lo, hi = self.runs["lo"], self.runs["hi"]
        covered = np.maximum(np.minimum(hi, k) + 1 - lo, 0)
        return float((self.p * (covered / (hi + 1 - lo))).sum())

    def p_change_at(self, k: int) -> float:
        """P(a segment started at the k-th latest interval | all data so far), 1 <= k <= lag."""
        if self.lag is None or not 1 <= k <= self.lag or k > self.T:
            raise ValueError("k must be within the lag and the intervals so far")
        return float((self.q[k - 1] * self.p).sum())

    def rate_now(self) -> tuple[float, float]:
        if not self.T:
            raise ValueError("no data yet")
        u, v = (x[:-1] for x in self._posterior())
        if self.kind == "negbin":
            # r (1 - p) / p of p ~ Beta(u, v) is r times a beta prime variable.
            m = self.dispersion * v / (u - 1)
            var = m * (self.dispersion + m) / (u - 2)
        else:
            m, var = (_gamma if self.kind == "poisson" else _beta)(u, v)
        _, mean, spread = blend(self.p.sum(0), m, var)
        return float(mean[0]), math.sqrt(spread[0])


class ChangePointMixture(Predictor):
    """Streams of one prior and several dispersions, weighted by their evidence; infinite dispersion is Poisson."""

    def __init__(self, alpha: float, beta: float, expected_run_length: float, dispersions=DISPERSIONS, **kw):
        if not len(dispersions):
            raise ValueError("no dispersions")
        make = lambda r: ChangePointStream.poisson(alpha, beta, expected_run_length, **kw) if r == math.inf else ChangePointStream.negbinomial(alpha, beta, r, expected_run_length, **kw)
        self.streams = {float(r): make(float(r)) for r in dispersions}

    def _evidences(self) -> np.ndarray:
        return np.array([s.log_marginal for s in self.streams.values()])

    def _over(self, ask: Callable[[ChangePointStream], float | np.ndarray]) -> np.ndarray:
        """The evidence-weighted mean of an answer."""
        return self.dispersion_posterior()[1] @ np.array([ask(s) for s in self.streams.values()])

    def _blended(self, ask: Callable[[ChangePointStream], tuple[float, float]]) -> tuple[float, float]:
        mean, sd = np.array([ask(s) for s in self.streams.values()]).T
        _, m, var = blend(self.dispersion_posterior()[1], mean, sd * sd)
        return float(m[0]), math.sqrt(var[0])

    def dispersion_posterior(self) -> tuple[np.ndarray, np.ndarray]:
        e = self._evidences()
        return np.array(list(self.streams)), np.exp(e - logsumexp(e))

    @property
    def log_marginal(self) -> float:
        return float(logsumexp(self._evidences())) - math.log(len(self.streams))

    @property
    def T(self) -> int:
        return next(iter(self.streams.values())).T

    @property
    def n_runs(self) -> int:
        return sum(s.n_runs for s in self.streams.values())

    def update(self, x, size=None) -> ChangePointMixture:
        x, size = checked("poisson", x, size)
        for s in self.streams.values():
            s.update(x, size)
        return self

    def next_logpmf(self, x, size=None) -> np.ndarray:
        with np.errstate(divide="ignore"):
            lw = np.log(self.dispersion_posterior()[1])
        return logsumexp(lw[:, None] + np.array([s.next_logpmf(x, size) for s in self.streams.values()]), axis=0)

    def next_cdf(self, x, size=None) -> np.ndarray:
        return self._over(lambda s: s.next_cdf(x, size))

    def p_change_within(self, k: int) -> float:
        return float(self._over(lambda s: s.p_change_within(k)))

    def p_change_at(self, k: int) -> float:
        return float(self._over(lambda s: s.p_change_at(k)))

    def rate_now(self) -> tuple[float, float]:
        return self._blended(ChangePointStream.rate_now)

    def hazard_posterior(self) -> tuple[float, float]:
        return self._blended(ChangePointStream.hazard_posterior)
