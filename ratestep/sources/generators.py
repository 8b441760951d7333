"""Seeded data with known rates, as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def response_trials(spark: SparkSession, n_trials: int = 30, seed: int = 1, T: int = 600, onset: int = 100) -> DataFrame:
    """Trials of a response: a low rate, a sharp peak after ``onset``, a decay to a plateau."""
    k = np.arange(T)
    rate = np.where(k < onset, 0.01, 0.03 + 0.12 * np.exp(-np.maximum(k - onset, 0) / 40))
    hits = np.random.default_rng(seed).random((n_trials, T)) < rate
    trial, t = np.nonzero(hits)
    rows = [("response", f"{i:05d}", int(x)) for i, x in zip(trial, t, strict=True)]
    rows += [("response", f"{i:05d}", None) for i in range(n_trials) if not hits[i].any()]
    return spark.createDataFrame(rows, "series_id string, trial_id string, t int")


def daily_profile(spark: SparkSession, T: int, seed: int = 4, series: int = 1, slots_a_day: int = 288) -> DataFrame:
    """Counts with a daily profile and a weekly burst, made where the rows are: Poisson by inversion of a hashed uniform."""
    k = F.col("id") % T
    phase = 2 * np.pi / slots_a_day
    rate = 3 + 2 * F.sin(k * phase) + F.when(F.pmod(k, F.lit(7 * slots_a_day)).between(600, 640), 8.0).otherwise(0.0)
    base = spark.range(T * series).select((F.col("id") / T).cast("long").cast("string").alias("series_id"), k.cast("int").alias("k"), rate.alias("r"))
    u = F.pmod(F.xxhash64(F.lit(seed), "series_id", "k"), F.lit(1 << 52)) / float(1 << 52)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(F.exp(-F.col("r")).alias("p"), F.exp(-F.col("r")).alias("c"), F.when(F.exp(-F.col("r")) <= F.col("u"), 1).otherwise(0).alias("n")),
        lambda a, i: F.struct((a["p"] * F.col("r") / i).alias("p"), (a["c"] + a["p"] * F.col("r") / i).alias("c"), (a["n"] + F.when(a["c"] + a["p"] * F.col("r") / i <= F.col("u"), 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )
    return base.withColumn("u", u).select("series_id", "k", cdf.cast("double").alias("y"), F.lit(1.0).alias("e"))


def planted_grid(spark: SparkSession, m: int, n: int, seed: int = 1) -> DataFrame:
    """Counts on a grid: background 1, a disc of rate 4, a corner of rate 0.2."""
    r, c = np.mgrid[:m, :n]
    rate = np.where((r - m / 2) ** 2 + (c - n / 2) ** 2 < (min(m, n) / 4) ** 2, 4.0, 1.0)
    rate[: m // 4, : n // 4] = 0.2
    y = np.random.default_rng(seed).poisson(rate)
    rows = [("planted", int(i), int(j), float(y[i, j]), 1.0) for i in range(m) for j in range(n)]
    return spark.createDataFrame(rows, "grid_id string, r int, c int, y double, e double")
