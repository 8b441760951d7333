"""The exact sums as column expressions: one row a series, no Python and no shuffle beyond the one that gathers a series.

A series is an array of intervals; bins, messages and posteriors are arrays of arrays built by higher-order functions. Impossible
entries are left out instead of being minus infinity: row m of the forward sums begins at interval m. ``let`` binds a
value to a lambda variable, so that it is computed once however often its body uses it. Columns that a lambda reads
again and again are bound in the same way: the optimiser may put a column's expression where it is read, and would
then compute it for every element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """log Gamma of positive numbers: the recurrence by eight steps, then Stirling's series."""

    def series(z: Column) -> Column:
        inv, out = 1 / (z * z), F.lit(_STIRLING[-1])
        for c in reversed(_STIRLING[:-1]):
            out = out * inv + c
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + out / z

    def shifted(v: Column) -> Column:
        prod = v
        for k in range(1, 12):
            prod = prod * (v + k)
        return F.when(v < 1e4, series(v + 12) - F.log(prod)).otherwise(series(v))

    return let(x.cast("double"), shifted)


def log_sum(xs: Column) -> Column:
    """Log of the sum of exponentials of an array; null for an empty one."""
    return let(xs, lambda v: let(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - m)))))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_binom(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def grouped_log_sum(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Log-sum-exp of a column by group with partial aggregation: the maximum first, then the scaled sum."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__m"))
    return df.join(top, keys).groupBy(*keys).agg((F.max("__m") + F.log(F.sum(F.exp(F.col(value) - F.col("__m"))))).alias(out))


def lgamma_table(spark, n: int, shift: float) -> DataFrame:
    """(n, value): log Gamma(n + shift) as a running sum of logarithms."""
    from pyspark.sql.window import Window

    logs = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") == 0, F.lit(math.lgamma(shift))).otherwise(F.log(F.col("id") - 1 + F.lit(shift))).alias("l"))
    return logs.select("n", F.sum("l").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def prefix_sums(values: Column, block: int = 64) -> Column:
    """0 and the running sums of an array. A fold that appends copies what it has, so it runs over blocks, and over their totals."""
    zero = F.lit(0.0)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(block)), lambda k: F.slice(values, k + 1, F.lit(block)))
    step = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    starts = F.aggregate(F.transform(parts, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), F.array(zero), step)
    sums = F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda b, s: F.slice(F.aggregate(b, F.array(s), step), 2, F.size(b))))
    return F.concat(F.array(zero), sums)


def gather(series: DataFrame, prior: DataFrame | None = None, *, weak: float | None = None, **constants: float) -> DataFrame:
    """One row a series: T, prefix sums c1 and c2 (from 0), the first and second column as arrays, and prior parameters p1 and p2.

    The prior comes from a table (series_id and two columns), from constants p1 and p2, or is worth ``weak`` events at the series' mean rate.
    """
    x1, x2 = ("s", "g") if {"s", "g"} <= set(series.columns) else ("y", "e")
    # The number of partitions is set here: a fit costs far more than its bytes suggest, and adaptive execution, which goes by
    # bytes, would put small series on a few cores. Gathering needs this exchange anyway.
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = series.repartition(parts, "series_id").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("k", F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2")))).alias("r"))
    running = lambda name: prefix_sums(F.transform("r", lambda x: x[name]))
    out = rows.select("series_id", F.size("r").alias("T"), running("x1").alias("c1"), running("x2").alias("c2"), F.transform("r", lambda x: x["x1"]).alias("x1"), F.transform("r", lambda x: x["x2"]).alias("x2"))
    if prior is not None:
        p = [c for c in prior.columns if c != "series_id"]
        return out.join(prior.select("series_id", F.col(p[0]).alias("p1"), F.col(p[1]).alias("p2")), "series_id")
    if weak is not None:
        mean = F.greatest(F.element_at("c1", -1), F.lit(0.5)) / F.element_at("c2", -1)
        return out.withColumns({"p1": F.lit(float(weak)), "p2": F.lit(float(weak)) / mean})
    return out.withColumns({"p1": F.lit(float(constants["p1"])), "p2": F.lit(float(constants["p2"]))})


def _norm(kind: str) -> Column:
    p1, p2 = F.col("p1"), F.col("p2")
    return p1 * F.log(p2) - log_gamma(p1) if kind == "poisson" else log_gamma(p1 + p2) - log_gamma(p1) - log_gamma(p2)


def _bin(kind: str, c1: Column, c2: Column, a: Column, b: Column, norm: Column) -> Column:
    n1 = F.get(c1, b + 1) - F.get(c1, a) + F.col("p1")
    n2 = F.get(c2, b + 1) - F.get(c2, a) + F.col("p2")
    if kind == "poisson":
        return norm + log_gamma(n1) - n1 * F.log(n2)
    return norm + log_gamma(n1) + log_gamma(n2) - log_gamma(n1 + n2)


def with_bins(gathered: DataFrame, kind: str) -> DataFrame:
    """``L``: for each interval b the log evidences of the bins a..b, a = 0..b."""
    ends = F.sequence(F.lit(0), F.col("T") - 1)
    rows = lambda c1, c2, n: F.transform(ends, lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: _bin(kind, c1, c2, a, b, n)))
    return gathered.withColumn("L", let(F.col("c1"), lambda c1: let(F.col("c2"), lambda c2: let(_norm(kind), lambda n: rows(c1, c2, n)))))


def bin_rows(gathered: DataFrame, kind: str) -> DataFrame:
    """(series_id, a, b, log_evidence, m1, m2): the bin table as rows."""
    rows = with_bins(gathered, kind).select("series_id", "c1", "c2", "p1", "p2", F.posexplode("L").alias("b", "Lb")).select("*", F.posexplode("Lb").alias("a", "log_evidence"))
    n1 = F.get("c1", F.col("b") + 1) - F.get("c1", "a") + F.col("p1")
    n2 = F.get("c2", F.col("b") + 1) - F.get("c2", "a") + F.col("p2")
    if kind == "poisson":
        m1, m2 = n1 / n2, n1 * (n1 + 1) / (n2 * n2)
    else:
        m1, m2 = n1 / (n1 + n2), n1 * (n1 + 1) / ((n1 + n2) * (n1 + n2 + 1))
    return rows.select("series_id", "a", "b", "log_evidence", m1.alias("m1"), m2.alias("m2"))


def data_constant(kind: str) -> Column:
    if kind != "poisson":
        return F.lit(0.0)
    return F.aggregate(F.arrays_zip("x1", "x2"), F.lit(0.0), lambda s, r: s + F.when(r["x1"] > 0, r["x1"] * F.log(r["x2"])).otherwise(F.lit(0.0)) - log_gamma(r["x1"] + 1))


def with_forward(df: DataFrame, max_m: int) -> DataFrame:
    """``f``: row m holds the log sums over segmentations of 0..k with m boundaries, k = m..T - 1; at most T rows."""
    steps = F.filter(F.sequence(F.lit(0), F.least(F.lit(max_m), F.col("T") - 1)), lambda m: m > 0)

    def row(L: Column, before: Column, m: Column) -> Column:
        return F.transform(
            F.sequence(m, F.col("T") - 1), lambda k: log_sum(F.zip_with(F.slice(before, F.lit(1), k - m + 1), F.slice(F.get(L, k), m + 1, k - m + 1), lambda x, y: x + y))
        )

    def solve(L: Column) -> Column:
        first = F.transform(L, lambda lb: F.get(lb, F.lit(0)))
        return F.aggregate(steps, F.array(first), lambda acc, m: let(F.element_at(acc, -1), lambda before: F.array_append(acc, row(L, before, m))))

    return df.withColumn("f", let(F.col("L"), solve))


def with_backward(df: DataFrame, max_m: int) -> DataFrame:
    """``g``: row j holds the log sums over segmentations of k + 1..T - 1 with j boundaries, k = 0..T - 2 - j."""
    steps = F.filter(F.sequence(F.lit(0), F.least(F.lit(max_m), F.col("T") - 2)), lambda j: j > 0)

    def row(L: Column, after: Column, j: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.col("T") - 2 - j),
            lambda k: log_sum(F.transform(F.sequence(k + 1, F.col("T") - 1 - j), lambda r: F.get(F.get(L, r), k + 1) + F.get(after, r))),
        )

    def solve(L: Column) -> Column:
        last = F.transform(F.filter(F.sequence(F.lit(0), F.col("T") - 1), lambda k: k > 0), lambda a: F.get(F.get(L, F.col("T") - 1), a))
        return F.aggregate(steps, F.array(last), lambda acc, j: let(F.element_at(acc, -1), lambda after: F.array_append(acc, row(L, after, j))))

    return df.withColumn("g", let(F.col("L"), solve))


def with_evidences(df: DataFrame, kind: str) -> DataFrame:
    """``ev``: log evidence of each number of boundaries; ``post``: their posterior."""
    ev = let(data_constant(kind), lambda c: F.transform("f", lambda row, m: F.element_at(row, -1) - log_binom(F.col("T") - 1, m) + c))
    return df.withColumn("ev", ev).withColumn("post", let(log_sum(F.col("ev")), lambda t: F.transform("ev", lambda x: F.exp(x - t))))


def by_m(df: DataFrame) -> DataFrame:
    """(series_id, m, log_evidence, p)."""
    return df.select("series_id", F.posexplode(F.arrays_zip("ev", "post")).alias("m", "x")).select("series_id", "m", F.col("x.ev").alias("log_evidence"), F.col("x.post").alias("p"))


def summary(df: DataFrame) -> DataFrame:
    """(series_id, log_marginal, m_map); ties go to fewer boundaries."""
    return df.select(
        "series_id", (log_sum(F.col("ev")) - F.log(F.size("ev"))).alias("log_marginal"), (F.array_position("ev", F.array_max("ev")) - 1).cast("int").alias("m_map")
    )


def credible_range(df: DataFrame, mass: float) -> DataFrame:
    """(series_id, m_lo, m_hi): from the most probable number of boundaries outwards, upwards on a tie, until ``mass`` is held."""
    top = (F.array_position("post", F.array_max("post")) - 1).cast("int")
    start = F.struct(top.alias("lo"), top.alias("hi"), F.array_max("post").alias("p"))

    def step(acc: Column, _: Column) -> Column:
        below = F.when(acc["lo"] > 0, F.get("post", acc["lo"] - 1)).otherwise(F.lit(-1.0))
        above = F.when(acc["hi"] < F.size("post") - 1, F.get("post", acc["hi"] + 1)).otherwise(F.lit(-1.0))
        up = above >= below
        grown = F.struct(
            F.when(up, acc["lo"]).otherwise(acc["lo"] - 1).alias("lo"), F.when(up, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"), (acc["p"] + F.greatest(above, below)).alias("p")
        )
        return F.when((acc["p"] < mass) & (F.greatest(above, below) >= 0), grown).otherwise(acc)

    return df.withColumn("x", F.aggregate("post", start, step)).select("series_id", F.col("x.lo").alias("m_lo"), F.col("x.hi").alias("m_hi"))


def boundary_positions(df: DataFrame, m: int) -> DataFrame:
    """(series_id, j, k, p): P(the j-th of ``m`` boundaries is after interval k); needs ``f`` and ``g``."""

    def solve(f: Column, g: Column) -> Column:
        total = F.element_at(F.get(f, F.lit(m)), -1)
        one = lambda j, k: F.struct(j.alias("j"), k.alias("k"), F.exp(F.get(F.get(f, j - 1), k - j + 1) + F.get(F.get(g, F.lit(m) - j), k) - total).alias("p"))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: F.transform(F.sequence(j - 1, F.col("T") - 2 - (m - j)), lambda k: one(j, k))))

    p = let(F.col("f"), lambda f: let(F.col("g"), lambda g: solve(f, g)))
    return df.select("series_id", F.explode(p).alias("x")).select("series_id", "x.j", "x.k", "x.p")


def bin_posterior(df: DataFrame, kind: str, least: float = 1e-12) -> DataFrame:
    """(series_id, T, a, b, w, m1, m2): posterior probability of each bin, averaged over the numbers of boundaries of posterior ``least`` or more."""
    n = F.col("T")
    used = lambda post: F.aggregate(post, F.lit(0.0), lambda s, p: s + F.when(p >= least, p).otherwise(F.lit(0.0)))

    def weights(post: Column, f: Column) -> Column:
        return let(used(post), lambda t: F.transform(post, lambda p, m: F.when(p >= least, F.log(p / t) - F.element_at(F.get(f, m), -1))))

    def right(g: Column, j: Column, b: Column) -> Column:
        return F.when(j == 0, F.when(b == n - 1, F.lit(0.0))).otherwise(F.when((b >= 0) & (b <= n - 1 - j), F.get(F.get(g, j - 1), b)))

    def left(f: Column, i: Column, a: Column) -> Column:
        return F.when(i == 0, F.when(a == 0, F.lit(0.0))).otherwise(F.when(a >= i, F.get(F.get(f, i - 1), a - i)))

    def folded(c: Column, g: Column) -> Column:
        """R[i][b]: what follows a bin that ends at b, over the numbers of boundaries after it."""

        def one(i: Column, b: Column) -> Column:
            terms = F.transform(F.sequence(F.lit(0), F.size(c) - 1 - i), lambda j: F.get(c, i + j) + right(g, j, b))
            return log_sum(F.filter(terms, lambda x: x.isNotNull()))

        return F.transform(c, lambda _, i: F.transform(F.sequence(F.lit(0), n - 1), lambda b: one(i, b)))

    def chances(L: Column, f: Column, R: Column) -> Column:
        def one(ev: Column, a: Column, b: Column) -> Column:
            return F.exp(log_sum(F.filter(F.transform(R, lambda r, i: left(f, i, a) + F.get(r, b)), lambda x: x.isNotNull())) + ev)

        return F.transform(L, lambda lb, b: F.transform(lb, lambda ev, a: one(ev, a, b)))

    def solve(L: Column, f: Column, g: Column, post: Column) -> Column:
        return let(weights(post, f), lambda c: let(folded(c, g), lambda R: chances(L, f, R)))

    prob = let(F.col("L"), lambda L: let(F.col("f"), lambda f: let(F.col("g"), lambda g: let(F.col("post"), lambda post: solve(L, f, g, post)))))
    out = df.select("series_id", "T", "c1", "c2", "p1", "p2", F.posexplode(prob).alias("b", "ws")).select("*", F.posexplode("ws").alias("a", "w")).where("w IS NOT NULL")
    n1 = F.get("c1", F.col("b") + 1) - F.get("c1", "a") + F.col("p1")
    n2 = F.get("c2", F.col("b") + 1) - F.get("c2", "a") + F.col("p2")
    if kind == "poisson":
        m1, m2 = n1 / n2, n1 * (n1 + 1) / (n2 * n2)
    else:
        m1, m2 = n1 / (n1 + n2), n1 * (n1 + 1) / ((n1 + n2) * (n1 + n2 + 1))
    return out.select("series_id", "T", "a", "b", "w", m1.alias("m1"), m2.alias("m2"))


def rates(bins: DataFrame) -> DataFrame:
    """(series_id, k, rate, rate_std, p_boundary) from bins: a bin adds where it starts and subtracts after its end, instead of being joined with its intervals."""
    from pyspark.sql.window import Window

    start = bins.select("series_id", "T", F.col("a").alias("k"), "w", (F.col("w") * F.col("m1")).alias("w1"), (F.col("w") * F.col("m2")).alias("w2"), F.lit(0.0).alias("end"))
    stop = bins.select("series_id", "T", (F.col("b") + 1).alias("k"), -F.col("w"), -F.col("w") * F.col("m1"), -F.col("w") * F.col("m2"), F.lit(0.0))
    ends = bins.select("series_id", "T", F.col("b").alias("k"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("w"))
    steps = start.union(stop).union(ends).groupBy("series_id", "T", "k").agg(*(F.sum(c).alias(c) for c in ("w", "w1", "w2", "end")))
    along = Window.partitionBy("series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select("series_id", "T", "k", "end", *(F.sum(c).over(along).alias(c) for c in ("w", "w1", "w2"))).where(F.col("k") < F.col("T"))
    rate = F.col("w1") / F.col("w")
    return run.select(
        "series_id", "k", rate.alias("rate"), F.sqrt(F.greatest(F.col("w2") / F.col("w") - rate * rate, F.lit(0.0))).alias("rate_std"), F.when(F.col("k") < F.col("T") - 1, F.col("end")).alias("p_boundary")
    )


def fit(series: DataFrame, kind: str, max_boundaries: int, prior: DataFrame | None = None, **constants: float | None) -> DataFrame:
    """The gathered series with bins, forward and backward sums and evidences: one exchange in all."""
    df = with_bins(gather(series, prior, **constants), kind)
    return with_evidences(with_backward(with_forward(df, max_boundaries), max_boundaries), kind)
