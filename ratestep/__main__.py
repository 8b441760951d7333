"""Command line: trial texts in, tables of rates, evidences, boundaries or latencies out.

    python -m ratestep TRIALS --start -100 --end 499 [--max-boundaries 10] [--mass 0.9] [--report rates] [--out FOLDER]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestep.operators import fit
from ratestep.plans import exact
from ratestep.sources import axis, files

REPORTS = ("rates", "evidence", "positions", "latency", "latency-summary", "separation", "prior", "held-out")


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ratestep", description="Exact Bayesian rates of trials of events.")
    p.add_argument("trials", help="text file or folder: a trial a line, a name and event times")
    p.add_argument("--start", type=int, required=True, help="first interval")
    p.add_argument("--end", type=int, required=True, help="last interval, included")
    p.add_argument("--max-boundaries", type=int, default=10)
    p.add_argument("--mass", type=float, default=None, help="average over the credible range of this mass; 0: the most probable number of boundaries")
    p.add_argument("--sigma", type=float, default=1.0)
    p.add_argument("--gamma", type=float, default=32.0)
    p.add_argument("--report", choices=REPORTS, default="rates")
    p.add_argument("--boundaries", type=int, default=1, help="number of boundaries for positions")
    p.add_argument("--level", type=float, default=0.1, help="level for latencies")
    p.add_argument("--inhibitory", action="store_true")
    p.add_argument("--excluded", type=float, nargs=2, default=None, help="interval whose bins need not satisfy the condition before a latency")
    p.add_argument("--train", type=int, default=1, help="trials to learn from, for held-out")
    p.add_argument("--fano", action="store_true")
    p.add_argument("--out", default=None, help="folder; without it the table is shown")
    return p


def report(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    trials = files.read_trials(spark, o.trials)
    gathered = lambda t: exact.gather(axis.spike_counts(t, o.start, o.end), p1=o.sigma, p2=o.gamma)
    rows, m = gathered(trials), o.max_boundaries
    shift = lambda df: df.withColumn("k", F.col("k") + o.start)
    if o.report == "rates":
        out = shift(fit.by_k(fit.fit(rows, "bernoulli", m, m_mass=o.mass)))
        return out.withColumn("fano", 1 - F.col("rate")) if o.fano else out
    if o.report == "evidence":
        return fit.by_m(fit.fit(rows, "bernoulli", m))
    if o.report == "positions":
        return fit.boundary_positions(rows, "bernoulli", o.boundaries).withColumn("mean", F.col("mean") + o.start).drop("p")
    if o.report.startswith("latency"):
        excluded = tuple(x - o.start for x in o.excluded) if o.excluded else None
        p = shift(fit.latency(rows, "bernoulli", o.level, m, inhibitory=o.inhibitory, excluded=excluded, least_m=1))
        return p if o.report == "latency" else fit.latency_summary(p)
    if o.report == "separation":
        return fit.separation_level(rows, "bernoulli", m, inhibitory=o.inhibitory)
    if o.report == "prior":
        return fit.best_prior(rows, "bernoulli", m)
    return fit.held_out(gathered(axis.split_trials(trials, o.train)[0]), rows, "bernoulli", m, m_mass=o.mass)


def main(argv: list[str] | None = None) -> None:
    o = options().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = report(spark, o)
    if o.out:
        files.write_table(out, o.out, "csv")
    else:
        out.orderBy(*[c for c in ("series_id", "k", "m", "j") if c in out.columns]).show(2000, truncate=False)


if __name__ == "__main__":
    main()
