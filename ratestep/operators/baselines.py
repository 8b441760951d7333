"""Fixed histograms and kernels, their choice of width, and how well an estimate fits a known rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.functions import planes
from ratestep.operators.fit import kernel


def histogram(series: DataFrame, width: int, offset: int = 0) -> DataFrame:
    """(series_id, bin, n, total, rate): mean count of bins of ``width`` intervals, shifted by ``offset``."""
    b = F.floor((F.col("k") + offset) / width).cast("int")
    return series.groupBy("series_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.avg("y").alias("rate"))


def width_costs(series: DataFrame, widths: list[int]) -> DataFrame:
    """(series_id, width, cost): Shimazaki and Shinomoto's cost of each width, (2 mean - variance) / width**2, averaged over all offsets; full bins only."""
    settings = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(o).alias("o")) for w in widths for o in range(w))))
    first_last = series.groupBy("series_id").agg(F.max("k").alias("last"))
    x = series.join(first_last, "series_id").withColumn("s", settings)
    bin_ = F.floor((F.col("k") - F.col("s.o")) / F.col("s.w")).cast("int")
    x = x.withColumn("bin", bin_).where((F.col("bin") >= 0) & (F.col("s.o") + (F.col("bin") + 1) * F.col("s.w") - 1 <= F.col("last")))
    bins = x.groupBy("series_id", "s", "bin").agg(F.sum("y").alias("y"))
    cost = bins.groupBy("series_id", "s").agg(((2 * F.avg("y") - F.var_pop("y")) / (F.first("s.w") * F.first("s.w"))).alias("c"))
    return cost.groupBy("series_id", F.col("s.w").alias("width")).agg(F.avg("c").alias("cost"))


def best_width(series: DataFrame, widths: list[int]) -> DataFrame:
    """(series_id, width, cost) of least cost; ties go to the narrower."""
    return width_costs(series, widths).groupBy("series_id").agg(F.min_by("width", F.struct("cost", "width")).alias("width"), F.min("cost").alias("cost"))


def kernel_rates(rows: DataFrame, sd: float) -> DataFrame:
    """(series_id, k, rate): Gaussian smoothing of gathered series."""
    return kernel(rows, lambda r: [{"k": k, "rate": float(x)} for k, x in enumerate(planes.kernel_smooth(np.array(r["x1"]), sd))], "series_id string, k int, rate double")


def best_bandwidth(rows: DataFrame, sds: list[float], n_trials: int) -> DataFrame:
    """(series_id, sd, cost): the Gaussian bandwidth of least cost, settings dealt out."""
    dealt = rows.withColumn("sd", F.explode(F.array(*(F.lit(float(x)) for x in sds)))).repartition("series_id", "sd")

    def one(r: dict) -> list[dict]:
        return [{"sd": r["sd"], "cost": planes.kernel_cost(np.array(r["x1"]), n_trials, r["sd"])}]

    costs = kernel(dealt, one, "series_id string, sd double, cost double")
    return costs.groupBy("series_id").agg(F.min_by("sd", F.struct("cost", "sd")).alias("sd"), F.min("cost").alias("cost"))


def rms_error(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(series_id, rms) of rates against true ones by interval."""
    d = F.col("rate") - F.col("true_rate")
    return estimate.join(truth, ["series_id", "k"]).groupBy("series_id").agg(F.sqrt(F.avg(d * d)).alias("rms"))


def coverage(estimate: DataFrame, truth: DataFrame, sds: float = 1.0) -> DataFrame:
    """(series_id, covered): share of intervals whose true rate is within ``sds`` standard deviations."""
    inside = F.abs(F.col("rate") - F.col("true_rate")) <= sds * F.col("rate_std")
    return estimate.join(truth, ["series_id", "k"]).groupBy("series_id").agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("covered"))


def ks_distance(values: DataFrame, col: str = "pit") -> DataFrame:
    """(series_id, n, ks): Kolmogorov distance of a column from the uniform distribution."""
    along = Window.partitionBy("series_id").orderBy(col)
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    x = values.withColumns({"i": F.row_number().over(along), "n": n})
    d = F.greatest(F.col("i") / F.col("n") - F.col(col), F.col(col) - (F.col("i") - 1) / F.col("n"))
    return x.groupBy("series_id").agg(F.max("n").alias("n"), F.max(d).alias("ks"))


def surprises(values: DataFrame, least: float = 0.999, col: str = "pit") -> DataFrame:
    """(series_id, n, alarms, share): intervals in the upper tail."""
    hit = F.when(F.col(col) >= least, 1).otherwise(0)
    return values.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("alarms"), F.avg(hit.cast("double")).alias("share"))
