"""Operators on gathered series (one row each, see ``plans.exact.gather``) with NumPy kernels in Arrow batches.

A row is one unit of work: ordering and grouping happen once, in the exchange that gathers a series. Where a single series is
the work (cyclic fits, prior grids), its rotations or settings are exploded and dealt out instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ratestep.functions import segments as seg
from ratestep.functions.special import NEG_INF, logsumexp
from ratestep.plans.exact import gather
from ratestep.runtime import ensure_importable

__all__ = ["above_level", "best_prior", "best_prior_grid", "boundary_positions", "by_k", "by_m", "fit", "fit_cyclic", "gather", "held_out", "kernel", "latency", "latency_by_m", "log_marginal", "rate_density", "separation_level"]


def model_of(row: dict, kind: str):
    """The series of a gathered row."""
    x1, x2 = np.array(row["x1"], dtype=float), np.array(row["x2"], dtype=float)
    return seg.Bernoulli(x1, x2, row["p1"], row["p2"]) if kind == "bernoulli" else seg.Poisson(x1, x2, row["p1"], row["p2"])


def kernel(rows: DataFrame, fn: Callable[[dict], list[dict]], schema: str, *, keep: str = "series_id") -> DataFrame:
    """``fn`` of each row, as rows of ``schema`` (which starts with ``keep``)."""
    ensure_importable(rows.sparkSession)
    full = StructType.fromDDL(schema)
    names = full.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(full)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                made = [{keep: row[keep], **x} for row in batch.slice(i, 64).to_pylist() for x in fn(row)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], type=out.field(n).type) for n in names], schema=out)

    return rows.mapInArrow(run, full)


_FIT = (
    "series_id string, log_evidence array<double>, m_posterior array<double>, rate array<double>, rate_std array<double>, "
    "p_boundary array<double>, log_marginal double, m_map int, bins array<array<double>>"
)


def _fitted(f: seg.Fit) -> dict:
    return {
        "log_evidence": f.log_evidence, "m_posterior": f.m_posterior, "rate": f.rate, "rate_std": f.rate_std, "p_boundary": f.boundary_posterior,
        "log_marginal": f.log_marginal, "m_map": f.m_map, "bins": None if f.bin_posterior is None else f.bin_posterior.tolist(),
    }


def fit(rows: DataFrame, kind: str, max_boundaries: int = 10, *, m_mass: float | None = None, min_m_posterior: float = 1e-12, keep_bins: bool = False) -> DataFrame:
    """Evidence and posterior by number of boundaries, rates with standard deviations and boundary probabilities, as arrays."""
    return kernel(rows, lambda r: [_fitted(seg.fit(model_of(r, kind), max_boundaries, m_mass=m_mass, min_m_posterior=min_m_posterior, keep_bins=keep_bins))], _FIT)


def by_k(fits: DataFrame) -> DataFrame:
    """(series_id, k, rate, rate_std, p_boundary) of fitted rows."""
    x = fits.select("series_id", F.posexplode(F.arrays_zip("rate", "rate_std", "p_boundary")).alias("k", "x"))
    return x.select("series_id", "k", "x.rate", "x.rate_std", "x.p_boundary")


def by_m(fits: DataFrame) -> DataFrame:
    """(series_id, m, log_evidence, p)."""
    x = fits.select("series_id", F.posexplode(F.arrays_zip("log_evidence", "m_posterior")).alias("m", "x"))
    return x.select("series_id", "m", "x.log_evidence", F.col("x.m_posterior").alias("p"))


def credible_range(rows: DataFrame, kind: str, max_boundaries: int, mass: float) -> DataFrame:
    def one(r: dict) -> list[dict]:
        m = model_of(r, kind)
        lo, hi = seg.credible_range(seg.log_evidences(m, seg.forward(m, max_boundaries)), mass)
        return [{"m_lo": lo, "m_hi": hi}]

    return kernel(rows, one, "series_id string, m_lo int, m_hi int")


def fit_cyclic(rows: DataFrame, kind: str, max_boundaries: int = 10) -> DataFrame:
    """The circular fit; rotations of a series are dealt out over the cluster and summed again."""
    T = F.col("T")
    dealt = rows.withColumn("s", F.explode(F.sequence(F.lit(0), T - 1))).repartition("series_id", "s")
    M = max_boundaries

    def opened(r: dict) -> list[dict]:
        m = model_of(r, kind)
        x = np.full(max(min(M, m.T), 1), NEG_INF)
        if m.T > 1 and M >= 2:
            y = seg.rotation(m, r["s"], min(M, m.T))
            x[: len(y)] = y
        return [{"s": r["s"], "lam": [float(v) if np.isfinite(v) else None for v in x]}]

    lam = kernel(dealt, opened, "series_id string, s int, lam array<double>")
    lams = lam.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "lam"))), lambda x: x["lam"]).alias("lam"))

    def table(v: list) -> np.ndarray:
        return np.array([[NEG_INF if x is None else x for x in y] for y in v], dtype=float)

    def weighed(r: dict) -> list[dict]:
        m, t = model_of(r, kind), table(r["lam"])
        log_ev = seg.cyclic_evidences(m, t, M)
        c = seg.cyclic_weights(log_ev, t)[r["s"]]
        if not np.isfinite(c).any():
            return []
        sums, ends = seg.rotation_sums(m, r["s"], c)
        return [{"k": k, "c": float(sums[0, k]), "r1": float(sums[1, k]), "r2": float(sums[2, k]), "e": float(ends[k])} for k in range(m.T)]

    parts = kernel(dealt.join(lams, "series_id"), weighed, "series_id string, k int, c double, r1 double, r2 double, e double")
    summed = parts.groupBy("series_id", "k").agg(*(F.sum(x).alias(x) for x in ("c", "r1", "r2", "e")))
    wide = summed.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("k", "c", "r1", "r2", "e"))).alias("parts"))

    def final(r: dict) -> list[dict]:
        m = model_of(r, kind)
        log_ev = seg.cyclic_evidences(m, table(r["lam"]), M)
        p = r["parts"] or []
        made = [(np.array([[x[n] for x in p] for n in ("c", "r1", "r2")]), np.array([x["e"] for x in p]))] if p else []
        f = seg.cyclic_result(m, log_ev, made)
        f.log_evidence = np.where(np.isfinite(log_ev), log_ev, -np.inf)
        return [_fitted(f) | {"log_evidence": [float(x) if np.isfinite(x) else None for x in log_ev]}]

    return kernel(rows.join(lams, "series_id").join(wide, "series_id", "left"), final, _FIT)


def boundary_positions(rows: DataFrame, kind: str, m: int) -> DataFrame:
    """(series_id, j, mean, sd, p): position of the j-th of ``m`` boundaries, with its probability after each interval."""

    def one(r: dict) -> list[dict]:
        p = seg.boundary_positions(model_of(r, kind), m)
        mean, sd = seg.position_moments(p)
        return [{"j": j + 1, "mean": float(mean[j]), "sd": float(sd[j]), "p": p[j]} for j in range(m)]

    return kernel(rows, one, "series_id string, j int, mean double, sd double, p array<double>")


def latency(rows: DataFrame, kind: str, level: float, max_boundaries: int = 10, *, inhibitory: bool = False, excluded: tuple[float, float] | None = None, least_m: int = 0) -> DataFrame:
    """(series_id, k, p): where the rate first crosses ``level``; least_m = 1 leaves out the model without a boundary."""

    def one(r: dict) -> list[dict]:
        p = seg.latency_posterior(model_of(r, kind), level, max_boundaries, inhibitory=inhibitory, excluded=excluded, least_m=least_m)
        return [{"k": k, "p": float(x)} for k, x in enumerate(p)]

    return kernel(rows, one, "series_id string, k int, p double")


def latency_by_m(rows: DataFrame, kind: str, level: float, max_boundaries: int = 10, *, inhibitory: bool = False) -> DataFrame:
    """(series_id, m, k, p): the same for each number of boundaries."""

    def one(r: dict) -> list[dict]:
        m = model_of(r, kind)
        f = seg.forward(m, max_boundaries)
        p = np.exp(seg.latency_by_m(m, level, max_boundaries, inhibitory=inhibitory) - f[:, -1:])
        return [{"m": i, "k": k, "p": float(x)} for i, row in enumerate(p) for k, x in enumerate(row)]

    return kernel(rows, one, "series_id string, m int, k int, p double")


def latency_summary(p: DataFrame) -> DataFrame:
    """(series_id, p_total, mode, mean, sd) of a latency table."""
    total, mean = F.sum("p"), F.sum(F.col("p") * F.col("k")) / F.sum("p")
    var = F.sum(F.col("p") * F.col("k") * F.col("k")) / F.sum("p") - mean * mean
    return p.groupBy("series_id").agg(total.alias("p_total"), F.max_by("k", F.struct("p", -F.col("k"))).alias("mode"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def separation_level(rows: DataFrame, kind: str, max_boundaries: int = 10, *, bounds: tuple[float, float] | None = None, inhibitory: bool = False) -> DataFrame:
    """(series_id, level, p): the level that a crossing separates best."""

    def one(r: dict) -> list[dict]:
        level, p = seg.separation_level(model_of(r, kind), max_boundaries, bounds=bounds, inhibitory=inhibitory)
        return [{"level": level, "p": p}]

    return kernel(rows, one, "series_id string, level double, p double")


def level_scan(rows: DataFrame, kind: str, levels: list[float], max_boundaries: int = 10, *, inhibitory: bool = False) -> DataFrame:
    """(series_id, level, p): probability of a crossing at each level of a stated list, dealt out by level."""
    dealt = rows.withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels)))).repartition("series_id", "level")
    return kernel(dealt, lambda r: [{"level": r["level"], "p": float(seg.latency_posterior(model_of(r, kind), r["level"], max_boundaries, inhibitory=inhibitory).sum())}], "series_id string, level double, p double")


def above_level(rows: DataFrame, kind: str, level: float, max_boundaries: int = 10) -> DataFrame:
    """(series_id, k, p): P(rate > level)."""
    return kernel(rows, lambda r: [{"k": k, "p": float(x)} for k, x in enumerate(seg.above_level(model_of(r, kind), level, max_boundaries))], "series_id string, k int, p double")


def rate_density(rows: DataFrame, kind: str, rate: float, max_boundaries: int = 10) -> DataFrame:
    """(series_id, k, density): posterior density of the rate at ``rate``."""
    return kernel(rows, lambda r: [{"k": k, "density": float(x)} for k, x in enumerate(seg.rate_density(model_of(r, kind), rate, max_boundaries))], "series_id string, k int, density double")


def bursts(rows: DataFrame, kind: str, level: float, t1: int, t2: int, max_boundaries: int = 10) -> DataFrame:
    """(series_id, p_burst, p_quiet): above the level exactly in t1..t2; below it throughout."""

    def one(r: dict) -> list[dict]:
        m = model_of(r, kind)
        return [{"p_burst": seg.burst_probability(m, level, t1, t2, max_boundaries), "p_quiet": seg.quiet_probability(m, level, max_boundaries)}]

    return kernel(rows, one, "series_id string, p_burst double, p_quiet double")


def virtual_rates(rows: DataFrame, kind: str, max_boundaries: int = 10) -> DataFrame:
    """(series_id, k, rate, rate_std) as ratios of evidences with virtual events: the slow second opinion."""

    def one(r: dict) -> list[dict]:
        mean, var = seg.virtual_spike_moments(model_of(r, kind), max_boundaries)
        return [{"k": k, "rate": float(a), "rate_std": float(np.sqrt(v))} for k, (a, v) in enumerate(zip(mean, var, strict=True))]

    return kernel(rows, one, "series_id string, k int, rate double, rate_std double")


def log_marginal(rows: DataFrame, kind: str, max_boundaries: int = 10, *, cyclic: bool = False) -> DataFrame:
    return kernel(rows, lambda r: [{"log_marginal": seg.log_marginal(model_of(r, kind), max_boundaries, cyclic=cyclic)}], "series_id string, log_marginal double")


def best_prior(rows: DataFrame, kind: str, max_boundaries: int = 10, *, cyclic: bool = False, bound: float = 1e5) -> DataFrame:
    """(series_id, p1, p2, log_marginal, at_bound, converged): the prior of largest evidence by the simplex method."""

    def one(r: dict) -> list[dict]:
        m, v, hit, closed = seg.best_prior(model_of(r, kind), max_boundaries, cyclic=cyclic, bound=bound)
        return [{"p1": m.prior[0], "p2": m.prior[1], "log_marginal": v, "at_bound": hit, "converged": closed}]

    return kernel(rows, one, "series_id string, p1 double, p2 double, log_marginal double, at_bound boolean, converged boolean")


def prior_grid(rows: DataFrame, kind: str, grid: list[tuple[float, float]], max_boundaries: int = 10, *, scaled: bool = False) -> DataFrame:
    """(series_id, p1, p2, log_marginal) of every setting, dealt out by setting; ``scaled`` ones multiply the rows' own prior."""
    settings = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in grid)))
    dealt = rows.withColumn("g", settings)
    own: tuple[Column, Column] = (F.col("p1") * F.col("g.a"), F.col("p2") * F.col("g.b")) if scaled else (F.col("g.a"), F.col("g.b"))
    dealt = dealt.withColumns({"p1": own[0], "p2": own[1]}).drop("g").repartition("series_id", "p1", "p2")
    return kernel(dealt, lambda r: [{"p1": r["p1"], "p2": r["p2"], "log_marginal": seg.log_marginal(model_of(r, kind), max_boundaries)}], "series_id string, p1 double, p2 double, log_marginal double")


def best_prior_grid(rows: DataFrame, kind: str, grid: list[tuple[float, float]], max_boundaries: int = 10, *, scaled: bool = False) -> DataFrame:
    """(series_id, p1, p2, log_marginal): the best setting of a stated grid."""
    scored = prior_grid(rows, kind, grid, max_boundaries, scaled=scaled)
    return scored.groupBy("series_id").agg(F.max_by(F.struct("p1", "p2"), "log_marginal").alias("p"), F.max("log_marginal").alias("log_marginal")).select("series_id", "p.p1", "p.p2", "log_marginal")


def held_out(train: DataFrame, whole: DataFrame, kind: str, max_boundaries: int = 10, *, m_mass: float | None = None) -> DataFrame:
    """(series_id, log_p): log predictive probability of what ``whole`` adds to ``train``, both gathered."""
    both = train.join(whole.select("series_id", F.col("x1").alias("w1"), F.col("x2").alias("w2")), "series_id")

    def one(r: dict) -> list[dict]:
        return [{"log_p": seg.held_out(model_of(r, kind), model_of(r | {"x1": r["w1"], "x2": r["w2"]}, kind), max_boundaries, m_mass=m_mass)}]

    return kernel(both, one, "series_id string, log_p double")


def predictive_m(fits: DataFrame) -> DataFrame:
    """(series_id, log_marginal) recomputed from the evidences of fitted rows, for checks."""
    return kernel(fits.select("series_id", "log_evidence"), lambda r: [{"log_marginal": float(logsumexp(np.array(r["log_evidence"])) - np.log(len(r["log_evidence"])))}], "series_id string, log_marginal double")
