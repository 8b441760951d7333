"""Ordered replay of tables through the online models: every row's answer uses only the rows before it, or up to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ratestep.functions.live import ChangePointMixture, ChangePointStream, OnlineBinning
from ratestep.operators.fit import kernel

_ONLINE = "series_id string, k int, log_marginal double, m_map int, rate double, rate_std double, start_map int, next_zero double, next_cdf double"


def replay_online(rows: DataFrame, kind: str, max_boundaries: int = 10, *, next_at: float = 10.0, size: float = 1.0) -> DataFrame:
    """After each interval: log marginal, best number of boundaries, rate now, likeliest start of the current bin, and P(next = 0), P(next <= next_at)."""

    def one(r: dict) -> list[dict]:
        o, out = OnlineBinning(kind, (r["p1"], r["p2"]), max_boundaries), []
        for k, (a, b) in enumerate(zip(r["x1"], r["x2"], strict=True)):
            o.update(a, b)
            mean, sd = o.rate_now()
            out.append({"k": k, "log_marginal": o.log_marginal, "m_map": o.m_map, "rate": mean, "rate_std": sd, "start_map": int(np.argmax(o.current_bin_start())), "next_zero": float(o.next_pmf(0, size)[0]), "next_cdf": float(o.next_cdf(next_at, size)[0])})
        return out

    return kernel(rows, one, _ONLINE)


def online_starts(rows: DataFrame, kind: str, max_boundaries: int = 10) -> DataFrame:
    """(series_id, a, p): where the last bin started, after the whole series."""

    def one(r: dict) -> list[dict]:
        p = OnlineBinning(kind, (r["p1"], r["p2"]), max_boundaries).update(r["x1"], r["x2"]).current_bin_start()
        return [{"a": a, "p": float(x)} for a, x in enumerate(p)]

    return kernel(rows, one, "series_id string, a int, p double")


def online_next(rows: DataFrame, kind: str, counts: list[int], max_boundaries: int = 10, *, size: float = 1.0) -> DataFrame:
    """(series_id, x, p): predictive probabilities of the next count, after the whole series."""

    def one(r: dict) -> list[dict]:
        p = OnlineBinning(kind, (r["p1"], r["p2"]), max_boundaries).update(r["x1"], r["x2"]).next_pmf(counts, size)
        return [{"x": x, "p": float(v)} for x, v in zip(counts, p, strict=True)]

    return kernel(rows, one, "series_id string, x int, p double")


def stream_of(kind: str, prior: tuple[float, float], options: dict) -> ChangePointStream | ChangePointMixture:
    """``kind``: bernoulli, poisson, negbin (with ``dispersion``; the prior is that of the rate) or overdispersed."""
    o = dict(options)
    length = o.pop("expected_run_length")
    if kind == "bernoulli":
        return ChangePointStream.bernoulli(length, *prior, **o)
    if kind == "poisson":
        return ChangePointStream.poisson(*prior, length, **o)
    if kind == "negbin":
        return ChangePointStream.negbinomial(*prior, o.pop("dispersion"), length, **o)
    return ChangePointMixture(*prior, length, **o)


ANSWERS = "k int, logpmf double, pit double, rate double, rate_std double, p_change double, p_at_lag double, hazard double, hazard_std double, log_marginal double, n_runs int"


def answer(s: ChangePointStream | ChangePointMixture, k: int, x: float, size: float | None, u: float, within: int, lag: int | None) -> dict:
    """Predict, add the interval, and describe the state."""
    logp = float(s.next_logpmf(x, size)[0])
    pit = s.pit(x, size, u)
    s.update(x, size)
    rate, sd = s.rate_now()
    h, h_sd = s.hazard_posterior()
    return {
        "k": k, "logpmf": logp, "pit": pit, "rate": rate, "rate_std": sd, "p_change": s.p_change_within(within), "p_at_lag": s.p_change_at(lag) if lag and lag <= s.T else None,
        "hazard": h, "hazard_std": h_sd, "log_marginal": s.log_marginal, "n_runs": s.n_runs,
    }


def replay_stream(rows: DataFrame, kind: str, *, within: int = 3, u: float = 0.5, **options) -> DataFrame:
    """Change-point answers for each interval. For Bernoulli rows the columns are successes and failures; ``u`` is the share of a tie in the PIT."""
    lag = options.get("lag")

    def one(r: dict) -> list[dict]:
        s = stream_of(kind, (r["p1"], r["p2"]), options)
        return [answer(s, k, a, a + b if kind == "bernoulli" else b, u, within, lag) for k, (a, b) in enumerate(zip(r["x1"], r["x2"], strict=True))]

    return kernel(rows, one, "series_id string, " + ANSWERS)


def run_lengths(rows: DataFrame, kind: str, **options) -> DataFrame:
    """(series_id, run_length, p) after the whole series."""

    def one(r: dict) -> list[dict]:
        s = stream_of(kind, (r["p1"], r["p2"]), options)
        for a, b in zip(r["x1"], r["x2"], strict=True):
            s.update(a, a + b if kind == "bernoulli" else b)
        return [{"run_length": int(n), "p": float(p)} for n, p in zip(*s.run_length_posterior(), strict=True)]

    return kernel(rows, one, "series_id string, run_length int, p double")


def dispersions(rows: DataFrame, **options) -> DataFrame:
    """(series_id, dispersion, weight) of the overdispersed mixture after the whole series."""

    def one(r: dict) -> list[dict]:
        s = stream_of("overdispersed", (r["p1"], r["p2"]), options).update(r["x1"], r["x2"])
        return [{"dispersion": float(d), "weight": float(w)} for d, w in zip(*s.dispersion_posterior(), strict=True)]

    return kernel(rows, one, "series_id string, dispersion double, weight double")
