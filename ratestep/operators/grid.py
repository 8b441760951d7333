"""Two-dimensional operators. A grid's bands, or whole small grids, are the units that are dealt out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.functions import planes
from ratestep.functions.segments import fit
from ratestep.functions.special import NEG_INF, logsumexp
from ratestep.operators.fit import kernel


def _rows(grid: DataFrame) -> DataFrame:
    return grid.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", "y", "e"))).alias("cells"))


def _arrays(cells: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    m, n = max(x["r"] for x in cells) + 1, max(x["c"] for x in cells) + 1
    y, e = np.zeros((m, n)), np.zeros((m, n))
    for x in cells:
        y[x["r"], x["c"]], e[x["r"], x["c"]] = x["y"], x["e"]
    return y, e


def two_level(grid: DataFrame, alpha: float, beta: float, max_r: int, max_c: int, least: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Evidence (grid_id, log_marginal) and rates (grid_id, r, c, rate, rate_std) of rows cut into bands and bands into columns.

    Every band (r0, r1) of every grid is a row of its own: evidences are computed and, where the rows' posterior needs them, rates.
    """
    # Prefix sums down the columns make any band a difference of two rows: a band carries these two and no others.
    down = Window.partitionBy("grid_id", "c").orderBy("r")
    sums = grid.withColumns({"sy": F.sum("y").over(down), "se": F.sum("e").over(down)})
    upto = sums.groupBy("grid_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "sy", "se"))).alias("x"))
    hi = upto.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("r0"), F.col("r").alias("r1"), F.col("x").alias("hi"))
    lo = upto.select("grid_id", (F.col("r") + 1).alias("r0"), F.col("x").alias("lo"))
    bands = hi.join(lo, ["grid_id", "r0"], "left").repartition("grid_id", "r0", "r1")

    def model(r: dict):
        top = np.array([(x["sy"], x["se"]) for x in r["hi"]], dtype=float)
        y, e = (top - np.array([(x["sy"], x["se"]) for x in r["lo"]], dtype=float) if r["lo"] else top).T
        return planes.Poisson(y, e, alpha, beta)

    ev = kernel(bands, lambda r: [{"r0": r["r0"], "r1": r["r1"], "l": planes.band_log_marginal(model(r), max_c)}], "grid_id string, r0 int, r1 int, l double", keep="grid_id")
    tables = ev.groupBy("grid_id").agg(F.collect_list(F.struct("r0", "r1", "l")).alias("t"))

    def rows_fit(r: dict) -> list[dict]:
        n = max(x["r1"] for x in r["t"]) + 1
        table = np.full((n, n), NEG_INF)
        for x in r["t"]:
            table[x["r0"], x["r1"]] = x["l"]
        log_ev, _, w = planes.table_fit(table, max_r)
        total = float(logsumexp(log_ev) - np.log(len(log_ev)))
        return [{"r0": int(a), "r1": int(b), "w": float(w[a, b]), "log_marginal": total} for a, b in zip(*np.nonzero(w > least), strict=True)]

    weights = kernel(tables, rows_fit, "grid_id string, r0 int, r1 int, w double, log_marginal double", keep="grid_id")

    def cells(r: dict) -> list[dict]:
        f = fit(model(r), max_c)
        return [{"r": row, "c": c, "w": r["w"], "m1": float(r["w"] * f.rate[c]), "m2": float(r["w"] * (f.rate_std[c] ** 2 + f.rate[c] ** 2))} for row in range(r["r0"], r["r1"] + 1) for c in range(len(f.rate))]

    parts = kernel(bands.join(weights, ["grid_id", "r0", "r1"]), cells, "grid_id string, r int, c int, w double, m1 double, m2 double", keep="grid_id")
    summed = parts.groupBy("grid_id", "r", "c").agg(F.sum("w").alias("w"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    rate = F.col("m1") / F.col("w")
    rates = summed.select("grid_id", "r", "c", rate.alias("rate"), F.sqrt(F.greatest(F.col("m2") / F.col("w") - rate * rate, F.lit(0.0))).alias("rate_std"))
    return weights.groupBy("grid_id").agg(F.first("log_marginal").alias("log_marginal")), rates


def guillotine(grid: DataFrame, alpha: float, beta: float, rho: float) -> DataFrame:
    """(grid_id, log_evidence) under straight cuts from side to side."""
    return kernel(_rows(grid), lambda r: [{"log_evidence": planes.guillotine(*_arrays(r["cells"]), alpha, beta, rho)}], "grid_id string, log_evidence double", keep="grid_id")


def binary_tree(rows: DataFrame, rho: float) -> DataFrame:
    """(series_id, log_evidence) of gathered series under repeated cuts in two."""
    return kernel(rows, lambda r: [{"log_evidence": planes.binary_tree(np.array(r["x1"]), np.array(r["x2"]), r["p1"], r["p2"], rho)}], "series_id string, log_evidence double")
