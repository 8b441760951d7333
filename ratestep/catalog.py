"""Queries over the test tables, one or more for each operator, and the SQL that each is compared with.

``daily`` series are events of each type by day (30 days), ``hourly`` ones by hour (720), ``folded`` ones by hour of the day (24); ``users`` has
a trial for each day of each user with events, over the 24 hours; grids are the orders of a year by region and month. Logs, rates and probabilities are rounded to
six digits on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestep import oracle as o
from ratestep.functions import sql
from ratestep.operators import baselines, fit, grid, live, tree
from ratestep.plans import exact
from ratestep.runtime import Scratch
from ratestep.sources import axis, files, generators
from ratestep.streaming import live as watched

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
START = "2024-01-01 00:00:00"
M = 3
_ROUND = 6


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, _ROUND) + F.lit(0.0)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day() -> Column:
    return axis.hours_between("ts", START, "1 day")


def hour() -> Column:
    return axis.hours_between("ts", START)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isNotNull())
    return axis.densify(axis.interval_counts(events, F.col("event_type"), day()), 0, 29)


def hourly(spark: SparkSession, sf_dir: str, last: int = 719) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isNotNull())
    return axis.densify(axis.interval_counts(events, F.col("event_type"), hour()), 0, last)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.fold_periods(hourly(spark, sf_dir), 24)


def user_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial for each day of each user with events, over the hours of the day; repeats within an hour are one event."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    trial = F.concat(F.lpad(F.col("user_id").cast("string"), 12, "0"), F.date_format("ts", "-yyyy-MM-dd")).alias("trial_id")
    return e.select(F.lit("users").alias("series_id"), trial, F.hour("ts").alias("t")).distinct()


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.spike_counts(user_trials(spark, sf_dir), 0, 23)


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.gather(daily(spark, sf_dir), weak=1.0)


def fitted(spark: SparkSession, sf_dir: str, m: int = M) -> DataFrame:
    return exact.fit(daily(spark, sf_dir), "poisson", m, weak=1.0)


FULL = o.full(30, M)
FOLD = o.full(24, M)

# Sources and the axis


@register("interval_counts", "SELECT event_type AS series_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000)::INTEGER AS k, count(*)::DOUBLE AS y FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2")
def interval_counts(spark, sf_dir):
    return axis.interval_counts(table(spark, sf_dir, "events").where("event_type IS NOT NULL"), F.col("event_type"), hour())


@register("densify", o.query(o.DAILY, select="SELECT series_id, k, y, e FROM ser"))
def densify(spark, sf_dir):
    return daily(spark, sf_dir)


@register("fold_hour_of_day", o.query(o.FOLDED, select="SELECT series_id, k::INTEGER AS k, y, e FROM ser"))
def fold_hour_of_day(spark, sf_dir):
    return folded(spark, sf_dir)


@register("spike_counts", o.query(o.USERS, o.user_series("ser", "true"), select="SELECT series_id, k, y AS s, e AS g FROM ser"))
def spike_counts(spark, sf_dir):
    return users(spark, sf_dir)


@register("split_trials", o.query(o.USERS, o.user_series("ser", "r <= 75"), select="SELECT series_id, k, y AS s, e AS g FROM ser"))
def split_trials(spark, sf_dir):
    return axis.spike_counts(axis.split_trials(user_trials(spark, sf_dir), 75)[0], 0, 23)


@register("add_trials", o.query(o.USERS, o.user_series("ser", "true"), select="SELECT series_id, k, y AS s, e AS g FROM ser"))
def add_trials(spark, sf_dir):
    first, rest = axis.split_trials(user_trials(spark, sf_dir), 75)
    return axis.add_trials(axis.spike_counts(first, 0, 23), axis.spike_counts(rest, 0, 23))


@register("text_trials", o.query(o.USERS, select="SELECT 'users' AS series_id, k AS t, count(*)::BIGINT AS n FROM once GROUP BY 2"))
def text_trials(spark, sf_dir):
    path = Scratch(spark, "trials").path("text")
    files.write_trials(user_trials(spark, sf_dir).where("t IS NOT NULL"), path)
    return files.read_trials(spark, path).groupBy("series_id", "t").agg(F.count(F.lit(1)).alias("n"))


@register("predicate_scan", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50")
def predicate_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click' AND value > 50").select("event_id", "value")


@register("record_span", "SELECT min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS days FROM events")
def record_span(spark, sf_dir):
    return axis.span(table(spark, sf_dir, "events"), "ts").withColumn("days", F.round("days", 6))


@register("coarsen_parent", "SELECT r_name AS cell, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def coarsen_parent(spark, sf_dir):
    up = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("cell"))
    return table(spark, sf_dir, "customer").join(up, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("quad_cells", """
    SELECT cell, count(*)::BIGINT AS n FROM (SELECT list_aggregate(list_transform([2, 1, 0], lambda i: ((x // (1 << i)) % 2 + 2 * ((y // (1 << i)) % 2))::VARCHAR), 'string_agg', '') AS cell
    FROM (SELECT least(floor(((user_id % 360) - 180 + 180) / 360.0 * 8), 7)::BIGINT AS x, least(floor(((event_id % 180) - 90 + 90) / 180.0 * 8), 7)::BIGINT AS y FROM events)) GROUP BY 1""")
def quad_cells(spark, sf_dir):
    cell = files.quad_cell((F.col("event_id") % 180 - 90).cast("double"), (F.col("user_id") % 360 - 180).cast("double"), 6)
    return table(spark, sf_dir, "events").select(files.coarsen(cell, 3).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("rebin_unequal", o.query(o.DAILY, select="SELECT series_id, CASE WHEN k < 7 THEN 0 WHEN k < 10 THEN 1 WHEN k < 20 THEN 2 ELSE 3 END AS k, sum(y) AS y, sum(e) AS e FROM ser GROUP BY 1, 2"))
def rebin_unequal(spark, sf_dir):
    return axis.rebin(daily(spark, sf_dir), [0, 7, 10, 20, 30])


@register("window_reverse_rotate", o.query(o.DAILY, select="SELECT series_id, ((29 - k - 5 + 30) % 30)::INTEGER AS k, y, e FROM ser WHERE k BETWEEN 3 AND 25"))
def window_reverse_rotate(spark, sf_dir):
    return axis.rotate(axis.reverse(axis.within(daily(spark, sf_dir), 3, 25), 30), 30, 5)


@register("series_totals", o.query(o.DAILY, select='SELECT series_id, count(*)::INTEGER AS "T", sum(y) AS y, sum(e) AS e FROM ser GROUP BY 1'))
def series_totals(spark, sf_dir):
    return axis.totals(daily(spark, sf_dir))


@register("weak_prior", o.query(o.DAILY, select=f"SELECT series_id, p1 AS alpha, {o.rounded('p2', 9)} AS beta FROM prior"))
def weak_prior(spark, sf_dir):
    return axis.weak_prior(daily(spark, sf_dir)).withColumn("beta", F.round("beta", 9) + F.lit(0.0))


@register("generated_series")
def generated_series(spark, sf_dir):
    return generators.daily_profile(spark, 2016, series=4)


# Aggregates and bins


@register("log_sum_exp", "SELECT l_returnflag, round(max(x) + ln(sum(exp(x - mx))), 6) + 0.0 AS v FROM (SELECT l_returnflag, l_extendedprice / 1000 AS x, max(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS mx FROM lineitem) GROUP BY 1")
def log_sum_exp(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"))
    return exact.grouped_log_sum(x, ["l_returnflag"], "x", "v").withColumn("v", F.round("v", 6) + F.lit(0.0))


@register("log_gamma_table", "SELECT n, round(lgamma(n + 0.5), 6) + 0.0 AS value, round(lgamma(n + 0.5), 6) + 0.0 AS direct FROM (SELECT unnest(range(2000))::BIGINT AS n)")
def log_gamma_table(spark, sf_dir):
    return exact.lgamma_table(spark, 2000, 0.5).select("n", r6("value", "value"), r6(exact.log_gamma(F.col("n") + 0.5), "direct"))


@register("data_constant", o.query(o.DAILY, select=f"SELECT series_id, {o.rounded('sum(-lgamma(y + 1))')} AS c FROM ser GROUP BY 1"))
def data_constant(spark, sf_dir):
    return gathered(spark, sf_dir).select("series_id", r6(exact.data_constant("poisson"), "c"))


@register("prefix_sums", o.query(o.DAILY, select="SELECT series_id, k, sum(y) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM ser"))
def prefix_sums(spark, sf_dir):
    return gathered(spark, sf_dir).select("series_id", F.posexplode(F.slice("c1", 2, 30)).alias("k", "c"))


_BINS = f"SELECT series_id, a, b, {o.rounded('l')} AS log_evidence, {o.rounded('m1')} AS m1, {o.rounded('m2')} AS m2 FROM bins"


def _bin_rows(df: DataFrame) -> DataFrame:
    return df.select("series_id", "a", "b", r6("log_evidence", "log_evidence"), r6("m1", "m1"), r6("m2", "m2"))


@register("bins_poisson", o.query(o.DAILY, o.Chain(30, M).bins(), select=_BINS))
def bins_poisson(spark, sf_dir):
    return _bin_rows(exact.bin_rows(gathered(spark, sf_dir), "poisson"))


_USER_PRIOR = "prior AS (SELECT 'users' AS series_id, 1.0::DOUBLE AS p1, 32.0::DOUBLE AS p2)"


@register("bins_bernoulli", o.query(o.USERS, o.user_series("ser", "true"), _USER_PRIOR, o.Chain(24, M, "bernoulli").bins(), select=_BINS))
def bins_bernoulli(spark, sf_dir):
    return _bin_rows(exact.bin_rows(exact.gather(users(spark, sf_dir), p1=1.0, p2=32.0), "bernoulli"))


@register("bins_excluded", o.query(o.DAILY, o.Chain(30, M).bins(), select="SELECT series_id, count(*)::BIGINT AS n FROM bins WHERE NOT (a > 10 AND b < 20) GROUP BY 1"))
def bins_excluded(spark, sf_dir):
    return axis.outside_excluded(exact.bin_rows(gathered(spark, sf_dir), "poisson"), 10, 20).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


# The exact sums as column expressions


def _union(prefix: str, n: int, col: str) -> str:
    return " UNION ALL ".join(f"SELECT series_id, {m} AS {col}, k, {o.rounded('v')} AS v FROM {prefix}{m}" for m in range(n))


@register("forward", o.query(o.DAILY, o.Chain(30, M).bins().forward(), select=_union("f", M + 1, "m")))
def forward(spark, sf_dir):
    rows = fitted(spark, sf_dir).select("series_id", F.posexplode("f").alias("m", "x")).select("series_id", "m", F.posexplode("x").alias("i", "v"))
    return rows.select("series_id", "m", (F.col("i") + F.col("m")).alias("k"), r6("v", "v"))


@register("backward", o.query(o.DAILY, o.Chain(30, M).bins().backward(), select=_union("g", M + 1, "j")))
def backward(spark, sf_dir):
    rows = fitted(spark, sf_dir).select("series_id", F.posexplode("g").alias("j", "x")).select("series_id", "j", F.posexplode("x").alias("k", "v"))
    return rows.select("series_id", "j", "k", r6("v", "v"))


_BY_M = f"SELECT series_id, m, {o.rounded('ev')} AS log_evidence, {o.rounded('p')} AS p FROM post"


def _by_m(df: DataFrame) -> DataFrame:
    return df.select("series_id", "m", r6("log_evidence", "log_evidence"), r6("p", "p"))


@register("evidence_by_m", o.query(o.DAILY, o.Chain(30, M).bins().forward().evidences(), select=_BY_M))
def evidence_by_m(spark, sf_dir):
    return _by_m(exact.by_m(fitted(spark, sf_dir)))


_SUMMARY = f"SELECT series_id, {o.rounded(f'any_value(total) - ln({M + 1})')} AS log_marginal, arg_max(m, (ev, -m)) AS m_map FROM post GROUP BY 1"


@register("log_marginal_and_map", o.query(o.DAILY, o.Chain(30, M).bins().forward().evidences(), select=_SUMMARY))
def log_marginal_and_map(spark, sf_dir):
    return exact.summary(fitted(spark, sf_dir)).select("series_id", r6("log_marginal", "log_marginal"), "m_map")


_RANGES = " UNION ALL ".join(f"SELECT {a} AS lo, {b} AS hi" for a in range(M + 1) for b in range(a, M + 1))


@register("credible_range", o.query(o.DAILY, o.Chain(30, M).bins().forward().evidences(), f"""
    best AS (SELECT series_id, arg_max(m, (ev, -m)) AS top FROM post GROUP BY 1),
    grow AS (SELECT series_id, top AS lo, top AS hi, p, 0 AS step FROM best JOIN post USING (series_id) WHERE m = top
        UNION ALL SELECT g.series_id, CASE WHEN coalesce(u.p, -1) >= coalesce(d.p, -1) THEN lo ELSE lo - 1 END, CASE WHEN coalesce(u.p, -1) >= coalesce(d.p, -1) THEN hi + 1 ELSE hi END,
            g.p + greatest(coalesce(u.p, -1), coalesce(d.p, -1)), step + 1
        FROM grow g LEFT JOIN post d ON d.series_id = g.series_id AND d.m = lo - 1 LEFT JOIN post u ON u.series_id = g.series_id AND u.m = hi + 1
        WHERE g.p < 0.95 AND (d.p IS NOT NULL OR u.p IS NOT NULL))""", recursive=True, select="SELECT series_id, arg_max(lo, step) AS m_lo, arg_max(hi, step) AS m_hi FROM grow GROUP BY 1"))
def credible_range(spark, sf_dir):
    return exact.credible_range(fitted(spark, sf_dir), 0.95)


@register("bin_posterior", o.query(o.DAILY, FULL, select=f"SELECT series_id, a, b, {o.rounded('w')} AS w FROM w"))
def bin_posterior(spark, sf_dir):
    return exact.bin_posterior(fitted(spark, sf_dir), "poisson").select("series_id", "a", "b", r6("w", "w"))


_RATES = f"SELECT series_id, k, {o.rounded('rate')} AS rate, {o.rounded('rate_std')} AS rate_std, {o.rounded('p_boundary')} AS p_boundary FROM rates"


def _rates(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.col("k").cast("int").alias("k"), r6("rate", "rate"), r6("rate_std", "rate_std"), r6("p_boundary", "p_boundary"))


@register("rates_relational", o.query(o.DAILY, FULL, select=_RATES))
def rates_relational(spark, sf_dir):
    return _rates(exact.rates(exact.bin_posterior(fitted(spark, sf_dir), "poisson")))


def _positions(m: int) -> str:
    parts = " UNION ALL ".join(f"SELECT f.series_id, {j} AS j, f.k, exp(f.v + g.v - t.v) AS p FROM f{j - 1} f JOIN g{m - j} g ON g.series_id = f.series_id AND g.k = f.k JOIN f{m} t ON t.series_id = f.series_id AND t.k = 29" for j in range(1, m + 1))
    return f"pos AS ({parts})"


@register("boundary_positions", o.query(o.DAILY, o.Chain(30, M).bins().forward().backward(), _positions(2), select=f"SELECT series_id, j, k, {o.rounded('p')} AS p FROM pos"))
def boundary_positions(spark, sf_dir):
    return exact.boundary_positions(fitted(spark, sf_dir), 2).select("series_id", "j", "k", r6("p", "p"))


@register("boundary_moments", o.query(o.DAILY, o.Chain(30, M).bins().forward().backward(), _positions(2), select=f"SELECT series_id, j, {o.rounded('sum(k * p)')} AS mean, {o.rounded('sqrt(greatest(sum(k * k * p) - sum(k * p) * sum(k * p), 0))')} AS sd FROM pos GROUP BY 1, 2"))
def boundary_moments(spark, sf_dir):
    return fit.boundary_positions(gathered(spark, sf_dir), "poisson", 2).select("series_id", "j", r6("mean", "mean"), r6("sd", "sd"))


# Grouped kernels


@register("fit_by_event_type", o.query(o.DAILY, FULL, select=_RATES))
def fit_by_event_type(spark, sf_dir):
    return _rates(fit.by_k(fit.fit(gathered(spark, sf_dir), "poisson", M)))


@register("fit_evidence", o.query(o.DAILY, o.Chain(30, M).bins().forward().evidences(), select=_BY_M))
def fit_evidence(spark, sf_dir):
    return _by_m(fit.by_m(fit.fit(gathered(spark, sf_dir), "poisson", M)))


@register("fit_bernoulli", o.query(o.USERS, o.user_series("ser", "true"), _USER_PRIOR, o.full(24, M, "bernoulli"), select=_RATES))
def fit_bernoulli(spark, sf_dir):
    return _rates(fit.by_k(fit.fit(exact.gather(users(spark, sf_dir), p1=1.0, p2=32.0), "bernoulli", M)))


@register("fit_varying_exposure", o.query(o.FOLDED.replace("ser AS (SELECT series_id, k % 24 AS k, sum(y) AS y, sum(e) AS e", "ser AS (SELECT series_id, k % 24 AS k, sum(y) AS y, sum(e) + (k % 24) / 4.0 AS e"), FOLD, select=_RATES))
def fit_varying_exposure(spark, sf_dir):
    x = folded(spark, sf_dir).withColumn("e", F.col("e") + F.col("k") / 4.0)
    return _rates(fit.by_k(fit.fit(exact.gather(x, weak=1.0), "poisson", M)))


@register("credible_fit", o.query(o.DAILY, o.Chain(30, M).bins().forward().backward().evidences().bin_posterior().rates(), select=_RATES).replace("WHERE p >= 1e-12", "WHERE m = (SELECT arg_max(z.m, (z.ev, -z.m)) FROM post z WHERE z.series_id = post.series_id)"))
def credible_fit(spark, sf_dir):
    """The most probable number of boundaries alone."""
    return _rates(fit.by_k(fit.fit(gathered(spark, sf_dir), "poisson", M, m_mass=0.0)))


@register("fano_of_intervals", o.query(o.USERS, o.user_series("ser", "true"), _USER_PRIOR, o.full(24, M, "bernoulli"), select=f"SELECT series_id, k, {o.rounded('1 - rate')} AS fano FROM rates"))
def fano_of_intervals(spark, sf_dir):
    f = fit.by_k(fit.fit(exact.gather(users(spark, sf_dir), p1=1.0, p2=32.0), "bernoulli", M))
    return f.select("series_id", "k", r6(1 - F.col("rate"), "fano"))


@register("virtual_events", o.query(o.DAILY, FULL, select=f"SELECT series_id, k, {o.rounded('rate')} AS rate, {o.rounded('rate_std', 4)} AS rate_std FROM rates"))
def virtual_events(spark, sf_dir):
    return fit.virtual_rates(gathered(spark, sf_dir), "poisson", M).select("series_id", "k", r6("rate", "rate"), (F.round("rate_std", 4) + F.lit(0.0)).alias("rate_std"))


_ROTATED = """
    spun AS (SELECT s.series_id || '#' || r.s AS series_id, s.series_id AS own, r.s, ((s.k - r.s + 24) % 24)::INTEGER AS k, y, e FROM ser s CROSS JOIN (SELECT unnest(range(24)) AS s) r),
    spun_prior AS (SELECT DISTINCT spun.series_id, p1, p2 FROM spun JOIN prior ON prior.series_id = own)"""
_CYC = o.Chain(24, M - 1, ser="spun", prior="spun_prior", p="c_").bins().forward()
_CYC_EV = f"""
    lam AS ({" UNION ALL ".join(f"SELECT series_id, {m} AS m, v FROM c_f{m} WHERE k = 23" for m in range(1, M))}),
    own_lam AS (SELECT DISTINCT own AS series_id, lam.series_id AS spin, m, v FROM lam JOIN spun USING (series_id)),
    con AS (SELECT series_id, sum(CASE WHEN y > 0 THEN y * ln(e) ELSE 0 END - lgamma(y + 1)) AS c FROM ser GROUP BY 1),
    cyc AS (SELECT own AS series_id, 0 AS m, any_value(v) AS u FROM c_f0 JOIN (SELECT DISTINCT series_id, own, s FROM spun) USING (series_id) WHERE k = 23 AND s = 0 GROUP BY 1
        UNION ALL SELECT series_id, m + 1, v - ln(24) - (lgamma(24) - lgamma(m + 1) - lgamma(24 - m)) FROM ({o.lse("SELECT series_id, m, v AS x FROM own_lam", "series_id, m")}))"""


@register("cyclic_evidence", o.query(o.FOLDED, _ROTATED, _CYC, _CYC_EV, select=f"SELECT cyc.series_id, m::INTEGER AS m, {o.rounded('u + c')} AS log_evidence FROM cyc JOIN con USING (series_id)"))
def cyclic_evidence(spark, sf_dir):
    f = fit.by_m(fit.fit_cyclic(exact.gather(folded(spark, sf_dir), weak=1.0), "poisson", M))
    return f.where("log_evidence IS NOT NULL").select("series_id", "m", r6("log_evidence", "log_evidence"))


def _cyclic_rates() -> list[str | o.Chain]:
    a = o.Chain(24, M - 1, ser="spun", prior="spun_prior", p="c_").bins().forward().backward()
    b = o.Chain(24, M - 1, ser="spun", prior="spun_prior", p="c_").bin_posterior(weights=False)
    return [o.FOLDED, _ROTATED, a, _CYC_EV, f"""
    cyc_post AS (SELECT series_id, m, exp(u - mx) / sum(exp(u - mx)) OVER (PARTITION BY series_id) AS p FROM (SELECT *, max(u) OVER (PARTITION BY series_id) AS mx FROM cyc)),
    lam_all AS ({o.lse("SELECT series_id, m, v AS x FROM own_lam", "series_id, m")}),
    c_c AS (SELECT spin AS series_id, w.m, ln(p) - t.v AS c FROM (SELECT DISTINCT series_id, spin, m FROM own_lam) w JOIN cyc_post q ON q.series_id = w.series_id AND q.m = w.m + 1 JOIN lam_all t ON t.series_id = w.series_id AND t.m = w.m),
    c_post AS (SELECT DISTINCT series_id, 0 AS m FROM spun)""", b, """
    turned AS (SELECT DISTINCT series_id, own, s FROM spun),
    parts AS (SELECT t.own AS series_id, (z.k + t.s) % 24 AS k, w, w * m1 AS w1, w * m2 AS w2, CASE WHEN b = z.k THEN w ELSE 0 END AS e
        FROM c_w q JOIN turned t USING (series_id) JOIN (SELECT unnest(range(24)) AS k) z ON z.k BETWEEN q.a AND q.b
        UNION ALL SELECT s.series_id, s.k, q.p, q.p * n1 / n2, q.p * n1 * (n1 + 1) / (n2 * n2), 0 FROM ser s JOIN cyc_post q ON q.series_id = s.series_id AND q.m = 0
        JOIN (SELECT series_id, sum(y) + any_value(p1) AS n1, sum(e) + any_value(p2) AS n2 FROM ser JOIN prior USING (series_id) GROUP BY 1) t ON t.series_id = s.series_id)"""]


@register("cyclic_rates", o.query(*_cyclic_rates(), select=f"SELECT series_id, k::INTEGER AS k, {o.rounded('sum(w1) / sum(w)')} AS rate, {o.rounded('sqrt(greatest(sum(w2) / sum(w) - (sum(w1) / sum(w)) * (sum(w1) / sum(w)), 0))')} AS rate_std, {o.rounded('sum(e)')} AS p_boundary FROM parts GROUP BY 1, 2"))
def cyclic_rates(spark, sf_dir):
    return _rates(fit.by_k(fit.fit_cyclic(exact.gather(folded(spark, sf_dir), weak=1.0), "poisson", M)))


LEVEL = 66.0


def _latency(inhibitory: bool = False, excluded: tuple[int, int] | None = None) -> o.Chain:
    hi, lo = f"CASE WHEN up > 0 THEN ln(least(up, 1)) ELSE -1e300 END", "CASE WHEN up < 1 THEN ln(1 - up) ELSE -1e300 END"
    if inhibitory:
        hi, lo = lo, hi
    if excluded:
        lo = f"CASE WHEN a > {excluded[0]} AND b < {excluded[1]} THEN 0 ELSE {lo} END"
    c = o.Chain(30, M).bins().forward().backward().evidences()
    c.ctes.append(f"tails AS MATERIALIZED (SELECT series_id, a, b, l, {o.gamma_tail(LEVEL)} AS up FROM bins)")
    c.ctes.append(f"under AS MATERIALIZED (SELECT series_id, a, b, l + {lo} AS l, l + {hi} AS lh FROM tails)")
    c.forward("d", "l", "under", M - 1)
    right = "SELECT series_id, 0 AS j, 29 AS b, 0.0::DOUBLE AS v FROM post WHERE m = 0" + "".join(f" UNION ALL SELECT series_id, {m}, k, v FROM g{m - 1}" for m in range(1, M + 1))
    left = "SELECT series_id, 0 AS n, 0 AS t, 0.0::DOUBLE AS v FROM post WHERE m = 0" + "".join(f" UNION ALL SELECT series_id, {m}, k + 1, v FROM d{m - 1} WHERE k < 29" for m in range(1, M + 1))
    c.ctes += [f"rgt AS ({right})", f"lft AS ({left})"]
    c.ctes.append(f"aft AS MATERIALIZED ({o.lse('SELECT u.series_id, j, a AS t, lh + v AS x FROM under u JOIN rgt ON rgt.series_id = u.series_id AND rgt.b = u.b', 'series_id, j, t')})")
    c.ctes.append("lat AS (SELECT l.series_id, l.t AS k, sum(exp(ln(p.p) - p.last + l.v + q.v)) AS p FROM lft l JOIN aft q ON q.series_id = l.series_id AND q.t = l.t JOIN post p ON p.series_id = l.series_id AND p.m = l.n + q.j GROUP BY 1, 2)")
    return c


@register("latency", o.query(o.DAILY, _latency(), select=f"SELECT series_id, k::INTEGER AS k, {o.rounded('p')} AS p FROM lat"))
def latency(spark, sf_dir):
    return fit.latency(gathered(spark, sf_dir), "poisson", LEVEL, M).select("series_id", "k", r6("p", "p"))


@register("latency_inhibitory", o.query(o.DAILY, _latency(True), select=f"SELECT series_id, k::INTEGER AS k, {o.rounded('p')} AS p FROM lat"))
def latency_inhibitory(spark, sf_dir):
    return fit.latency(gathered(spark, sf_dir), "poisson", LEVEL, M, inhibitory=True).select("series_id", "k", r6("p", "p"))


@register("latency_summary", o.query(o.DAILY, _latency(), select=f"SELECT series_id, {o.rounded('sum(p)')} AS p_total, {o.rounded('sum(p * k) / sum(p)', 4)} AS mean FROM lat GROUP BY 1"))
def latency_summary(spark, sf_dir):
    return fit.latency_summary(fit.latency(gathered(spark, sf_dir), "poisson", LEVEL, M)).select("series_id", r6("p_total", "p_total"), (F.round("mean", 4) + F.lit(0.0)).alias("mean"))


@register("latency_by_m", o.query(o.DAILY, _latency(), f"""
    each AS (SELECT l.series_id, p.m, l.t AS k, sum(exp(l.v + q.v - p.last)) AS p FROM lft l JOIN aft q ON q.series_id = l.series_id AND q.t = l.t JOIN post p ON p.series_id = l.series_id AND p.m = l.n + q.j GROUP BY 1, 2, 3)""",
    select=f"SELECT p.series_id, p.m::INTEGER AS m, s.k, {o.rounded('coalesce(each.p, 0)')} AS p FROM post p JOIN ser s ON s.series_id = p.series_id LEFT JOIN each ON each.series_id = p.series_id AND each.m = p.m AND each.k = s.k"))
def latency_by_m(spark, sf_dir):
    return fit.latency_by_m(gathered(spark, sf_dir), "poisson", LEVEL, M).select("series_id", "m", "k", r6("p", "p"))


@register("latency_excluded", o.query(o.DAILY, _latency(True, (0, 5)), """
    lat1 AS (SELECT l.series_id, l.t AS k, sum(p.p / w.p * exp(l.v + q.v - p.last)) AS p FROM lft l JOIN aft q ON q.series_id = l.series_id AND q.t = l.t
        JOIN post p ON p.series_id = l.series_id AND p.m = l.n + q.j JOIN (SELECT series_id, sum(p) AS p FROM post WHERE m >= 1 GROUP BY 1) w ON w.series_id = l.series_id WHERE p.m >= 1 GROUP BY 1, 2)""",
    select=f"SELECT series_id, k::INTEGER AS k, {o.rounded('p')} AS p FROM lat1"))
def latency_excluded(spark, sf_dir):
    return fit.latency(gathered(spark, sf_dir), "poisson", LEVEL, M, inhibitory=True, excluded=(0.0, 5.0), least_m=1).select("series_id", "k", r6("p", "p"))


@register("above_level", o.query(o.DAILY, FULL, f"tail AS (SELECT series_id, a, b, w, {o.gamma_tail(LEVEL)} AS up FROM w)", select=f"SELECT s.series_id, s.k, {o.rounded('least(sum(w * up) / sum(w), 1)')} AS p FROM ser s JOIN tail q ON q.series_id = s.series_id AND q.a <= s.k AND q.b >= s.k GROUP BY 1, 2"))
def above_level(spark, sf_dir):
    return fit.above_level(gathered(spark, sf_dir), "poisson", LEVEL, M).select("series_id", "k", r6("p", "p"))


@register("rate_density", o.query(o.DAILY, FULL, "den AS (SELECT series_id, a, b, w, exp(n1 * ln(n2) + (n1 - 1) * ln(66.0) - n2 * 66.0 - lgamma(n1)) AS d FROM w)", select=f"SELECT s.series_id, s.k, {o.rounded('sum(w * d) / sum(w)')} AS density FROM ser s JOIN den q ON q.series_id = s.series_id AND q.a <= s.k AND q.b >= s.k GROUP BY 1, 2"))
def rate_density(spark, sf_dir):
    return fit.rate_density(gathered(spark, sf_dir), "poisson", LEVEL, M).select("series_id", "k", r6("density", "density"))


def _bursts() -> o.Chain:
    c = o.Chain(30, M).bins().forward().evidences()
    c.ctes.append(f"tails AS MATERIALIZED (SELECT series_id, a, b, l, {o.gamma_tail(LEVEL)} AS up FROM bins)")
    lo, hi = "CASE WHEN up < 1 THEN ln(1 - up) ELSE -1e300 END", "CASE WHEN up > 0 THEN ln(least(up, 1)) ELSE -1e300 END"
    c.ctes.append(f"in_burst AS MATERIALIZED (SELECT series_id, a, b, l + CASE WHEN a >= 10 AND b <= 19 THEN {hi} WHEN b < 10 OR a > 19 THEN {lo} ELSE -1e300 END AS l FROM tails)")
    c.ctes.append(f"in_quiet AS MATERIALIZED (SELECT series_id, a, b, l + {lo} AS l FROM tails)")
    c.forward("u", "l", "in_burst").forward("q", "l", "in_quiet")
    for name in "uq":
        parts = " UNION ALL ".join(f"SELECT series_id, {m} AS m, v FROM {name}{m} WHERE k = 29" for m in range(M + 1))
        c.ctes.append(f"p_{name} AS (SELECT z.series_id, sum(p.p * exp(greatest(z.v, -1e290) - p.last)) AS p FROM ({parts}) z JOIN post p ON p.series_id = z.series_id AND p.m = z.m GROUP BY 1)")
    return c


@register("bursts", o.query(o.DAILY, _bursts(), select=f"SELECT p_u.series_id, {o.rounded('p_u.p')} AS p_burst, {o.rounded('p_q.p')} AS p_quiet FROM p_u JOIN p_q ON p_q.series_id = p_u.series_id"))
def bursts(spark, sf_dir):
    return fit.bursts(gathered(spark, sf_dir), "poisson", LEVEL, 10, 19, M).select("series_id", r6("p_burst", "p_burst"), r6("p_quiet", "p_quiet"))


@register("separation_level")
def separation_level(spark, sf_dir):
    return fit.separation_level(gathered(spark, sf_dir), "poisson", M)


@register("level_scan", o.query(o.DAILY, _latency(), select=f"SELECT series_id, {LEVEL}::DOUBLE AS level, {o.rounded('sum(p)')} AS p FROM lat GROUP BY 1"))
def level_scan(spark, sf_dir):
    return fit.level_scan(gathered(spark, sf_dir), "poisson", [LEVEL], M).select("series_id", "level", r6("p", "p"))


@register("best_prior")
def best_prior(spark, sf_dir):
    return fit.best_prior(gathered(spark, sf_dir), "poisson", M)


_GRID = [(a, b) for a in (0.5, 1.0, 2.0, 8.0) for b in (0.5, 1.0, 2.0, 8.0)]
_GRID_SQL = f"""
    grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _GRID)}) t(ga, gb)),
    gser AS (SELECT series_id || '#' || ga || '#' || gb AS series_id, k, y, e FROM ser CROSS JOIN grid),
    gprior AS (SELECT series_id || '#' || ga || '#' || gb AS series_id, series_id AS own, p1 * ga AS p1, p2 * gb AS p2 FROM prior CROSS JOIN grid)"""


@register("best_prior_grid", o.query(o.DAILY, _GRID_SQL, o.Chain(30, M, ser="gser", prior="gprior", p="q_").bins().forward().evidences(),
    select=f"SELECT own AS series_id, {o.rounded('arg_max(p1, t)')} AS p1, {o.rounded('arg_max(p2, t)')} AS p2, {o.rounded(f'max(t) - ln({M + 1})')} AS log_marginal FROM (SELECT series_id, any_value(total) AS t FROM q_post GROUP BY 1) JOIN gprior USING (series_id) GROUP BY 1"))
def best_prior_grid(spark, sf_dir):
    return fit.best_prior_grid(gathered(spark, sf_dir), "poisson", _GRID, M, scaled=True).select("series_id", r6("p1", "p1"), r6("p2", "p2"), r6("log_marginal", "log_marginal"))


@register("held_out_trials", o.query(o.USERS, o.user_series("tr", "r <= 75"), o.user_series("al", "true"), _USER_PRIOR, o.Chain(24, M, "bernoulli", ser="tr", p="t_").bins().forward().evidences(), o.Chain(24, M, "bernoulli", ser="al", p="a_").bins().forward().evidences(),
    select=f"SELECT 'users' AS series_id, {o.rounded('(SELECT any_value(total) FROM a_post) - (SELECT any_value(total) FROM t_post)')} AS log_p"))
def held_out_trials(spark, sf_dir):
    t = user_trials(spark, sf_dir)
    rows = [exact.gather(axis.spike_counts(x, 0, 23), p1=1.0, p2=32.0) for x in (axis.split_trials(t, 75)[0], t)]
    return fit.held_out(*rows, "bernoulli", M).select("series_id", r6("log_p", "log_p"))


# Online models


_START = f"""
    st AS ({o.lse("SELECT series_id, a, v - (lgamma(30) - lgamma(i + 1) - lgamma(30 - i)) AS x FROM lft WHERE i <= 3", "series_id, a")}),
    now AS (SELECT series_id, a, x, n1, n2, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY series_id) AS p FROM (SELECT *, max(x) OVER (PARTITION BY series_id) AS mx FROM
        (SELECT st.series_id, st.a, st.v + q.l AS x, n1, n2 FROM st JOIN bins q ON q.series_id = st.series_id AND q.a = st.a AND q.b = 29)))"""


@register("online_bin_start", o.query(o.DAILY, FULL, _START, select=f"SELECT series_id, a, {o.rounded('p')} AS p FROM now"))
def online_bin_start(spark, sf_dir):
    return live.online_starts(gathered(spark, sf_dir), "poisson", M).select("series_id", "a", r6("p", "p"))


@register("online_rate_now", o.query(o.DAILY, FULL, _START, f"mean AS (SELECT series_id, sum(p * n1 / n2) AS rate FROM now GROUP BY 1)",
    select=f"SELECT series_id, {o.rounded('any_value(rate)')} AS rate, {o.rounded('sqrt(sum(p * n1 / (n2 * n2)) + sum(p * (n1 / n2 - rate) * (n1 / n2 - rate)))')} AS rate_std FROM now JOIN mean USING (series_id) GROUP BY 1"))
def online_rate_now(spark, sf_dir):
    return live.replay_online(gathered(spark, sf_dir), "poisson", M).where("k = 29").select("series_id", r6("rate", "rate"), r6("rate_std", "rate_std"))


_NEXT = f"""
    lft2 AS (SELECT series_id, i, a, v FROM lft UNION ALL {" UNION ALL ".join(f"SELECT series_id, {m}, 30, v FROM f{m - 1} WHERE k = 29" for m in range(1, M + 1))}),
    st2 AS ({o.lse("SELECT series_id, a, v - (lgamma(31) - lgamma(i + 1) - lgamma(31 - i)) AS x FROM lft2", "series_id, a")}),
    cmp AS (SELECT st2.series_id, st2.v + coalesce(q.l, 0) AS x, coalesce(n1, p1) AS u, coalesce(n2, p2) AS w2 FROM st2 JOIN prior USING (series_id) LEFT JOIN bins q ON q.series_id = st2.series_id AND q.a = st2.a AND q.b = 29),
    wts AS (SELECT *, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY series_id) AS p FROM (SELECT *, max(x) OVER (PARTITION BY series_id) AS mx FROM cmp))"""


@register("online_next_pmf", o.query(o.DAILY, FULL, _NEXT, select=f"SELECT series_id, y::INTEGER AS x, {o.rounded('sum(p * exp(lgamma(y + u) - lgamma(u) - lgamma(y + 1) + y * ln(1 / (w2 + 1)) + u * ln(w2 / (w2 + 1))))')} AS p FROM wts CROSS JOIN (SELECT unnest([40, 60, 66, 80]) AS y) GROUP BY 1, 2"))
def online_next_pmf(spark, sf_dir):
    return live.online_next(gathered(spark, sf_dir), "poisson", [40, 60, 66, 80], M).select("series_id", "x", r6("p", "p"))


_PREFIX = f"""
    msg AS ({" UNION ALL ".join(f"SELECT series_id, {m} AS m, k, v FROM f{m}" for m in range(M + 1))}),
    cst AS (SELECT series_id, k, sum(CASE WHEN y > 0 THEN y * ln(e) ELSE 0 END - lgamma(y + 1)) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM ser),
    pev AS (SELECT series_id, k, m, v - (lgamma(k + 1) - lgamma(m + 1) - lgamma(k - m + 1)) + c AS ev FROM msg JOIN cst USING (series_id, k) WHERE m <= k),
    pall AS (SELECT z.series_id, z.k, z.v - ln(least({M}, z.k) + 1) AS log_marginal, t.m_map FROM ({o.lse("SELECT series_id, k, ev AS x FROM pev", "series_id, k")}) z
        JOIN (SELECT series_id, k, arg_max(m, (ev, -m))::INTEGER AS m_map FROM pev GROUP BY 1, 2) t USING (series_id, k)),
    lbeg AS (SELECT series_id, 0 AS i, 0 AS a, 0.0::DOUBLE AS v FROM prior UNION ALL SELECT series_id, m + 1, k + 1, v FROM msg WHERE m < {M}),
    pnow AS (SELECT series_id, a, k, x, n1, n2, exp(x - max(x) OVER w) AS u FROM (SELECT s.series_id, s.a, s.k, s.v + q.l AS x, n1, n2 FROM
        ({o.lse("SELECT l.series_id, l.a, s.k, l.v - (lgamma(s.k + 1) - lgamma(l.i + 1) - lgamma(s.k - l.i + 1)) AS x FROM lbeg l JOIN ser s ON s.series_id = l.series_id AND l.a <= s.k", "series_id, a, k")}) s
        JOIN bins q ON q.series_id = s.series_id AND q.a = s.a AND q.b = s.k) WINDOW w AS (PARTITION BY series_id, k)),
    pmean AS (SELECT series_id, k, sum(u * n1 / n2) / sum(u) AS rate, arg_max(a, (round(u, 12), -a))::INTEGER AS start_map FROM pnow GROUP BY 1, 2),
    pstd AS (SELECT series_id, k, sqrt((sum(u * n1 / (n2 * n2)) + sum(u * (n1 / n2 - rate) * (n1 / n2 - rate))) / sum(u)) AS rate_std FROM pnow JOIN pmean USING (series_id, k) GROUP BY 1, 2),
    pnxt AS (SELECT series_id, k, x, coalesce(n1, p1) AS n1, coalesce(n2, p2) AS n2, exp(x - max(x) OVER w) AS u FROM (SELECT s.series_id, s.k, s.v + coalesce(q.l, 0) AS x, n1, n2, p1, p2 FROM
        ({o.lse("SELECT l.series_id, l.a, s.k, l.v - (lgamma(s.k + 2) - lgamma(l.i + 1) - lgamma(s.k + 2 - l.i)) AS x FROM lbeg l JOIN ser s ON s.series_id = l.series_id AND l.a <= s.k + 1", "series_id, a, k")}) s
        JOIN prior USING (series_id) LEFT JOIN bins q ON q.series_id = s.series_id AND q.a = s.a AND q.b = s.k) WINDOW w AS (PARTITION BY series_id, k)),
    pcdf AS (SELECT series_id, k, sum(u * exp(n1 * ln(n2 / (n2 + 1)))) / sum(u) AS next_zero,
        sum(u * list_sum(list_transform(range(11), lambda j: exp(lgamma(j + n1) - lgamma(n1) - lgamma(j + 1) - j * ln(n2 + 1) + n1 * ln(n2 / (n2 + 1)))))) / sum(u) AS next_cdf FROM pnxt GROUP BY 1, 2)"""


@register("online_replay", o.query(o.DAILY, o.Chain(30, M).bins().forward(), _PREFIX,
    select=f"SELECT series_id, k, {o.rounded('log_marginal')} AS log_marginal, m_map, {o.rounded('rate')} AS rate, {o.rounded('rate_std')} AS rate_std, start_map, {o.rounded('next_zero')} AS next_zero, {o.rounded('next_cdf')} AS next_cdf FROM pall JOIN pmean USING (series_id, k) JOIN pstd USING (series_id, k) JOIN pcdf USING (series_id, k)"))
def online_replay(spark, sf_dir):
    out = live.replay_online(gathered(spark, sf_dir), "poisson", M)
    return out.select("series_id", "k", "m_map", "start_map", *(r6(c, c) for c in ("log_marginal", "rate", "rate_std", "next_zero", "next_cdf")))


# Change-point streams

_H = 1 / 10
_FULL_BINS = """
    full_bins AS (SELECT q.series_id, q.a, q.b, l - (z.c1 - x.c1 + x.lf) AS l, n1, n2 FROM bins q
        JOIN lfs x ON x.series_id = q.series_id AND x.k = q.a JOIN lfs z ON z.series_id = q.series_id AND z.k = q.b)"""


def _recursion(h: float) -> str:
    """Evidence of every prefix under runs that end with probability ``h``, from the full evidences of all segments: zz[t + 2] is that of 0..t."""
    return f"""
    ends AS (SELECT series_id, b, list(l + (b - a) * ln({1 - h}) + CASE WHEN a > 0 THEN ln({h}) ELSE 0 END ORDER BY a) AS ls FROM full_bins GROUP BY 1, 2),
    z AS (SELECT series_id, 0 AS t, [0.0, ls[1]] AS zz, [ls[1]] AS terms FROM ends WHERE b = 0
        UNION ALL SELECT series_id, t, list_append(zz, mx + ln(list_sum(list_transform(terms, lambda v: exp(v - mx))))), terms
        FROM (SELECT *, list_max(terms) AS mx FROM (SELECT z.series_id, z.t + 1 AS t, zz, list_transform(list_zip(zz, ls), lambda v: v[1] + v[2]) AS terms
            FROM z JOIN ends ON ends.series_id = z.series_id AND ends.b = z.t + 1)))"""


_STREAM = _FULL_BINS + "," + _recursion(_H)
_LFS = "lfs AS (SELECT series_id, k, lgamma(y + 1) AS lf, sum(lgamma(y + 1)) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS c1 FROM ser)"
_EXACT_STREAM = {"expected_run_length": 10.0, "prune": 0.0, "merge_bins": None}


@register("stream_log_marginal", o.query(o.DAILY, o.Chain(30, M).bins(), _LFS, _STREAM, recursive=True, select=f"SELECT series_id, t::INTEGER AS k, {o.rounded('zz[t + 2]')} AS log_marginal FROM z"))
def stream_log_marginal(spark, sf_dir):
    return live.replay_stream(gathered(spark, sf_dir), "poisson", **_EXACT_STREAM).select("series_id", "k", r6("log_marginal", "log_marginal"))


_RUNS = "runs AS (SELECT series_id, t, unnest(range(t + 1)) AS a, unnest(list_transform(terms, lambda v: exp(v - zl))) AS p FROM (SELECT *, zz[t + 2] AS zl FROM z))"


@register("stream_run_lengths", o.query(o.DAILY, o.Chain(30, M).bins(), _LFS, _STREAM, _RUNS, recursive=True, select=f"SELECT series_id, (30 - a)::INTEGER AS run_length, {o.rounded('p')} AS p FROM runs WHERE t = 29"))
def stream_run_lengths(spark, sf_dir):
    return live.run_lengths(gathered(spark, sf_dir), "poisson", **_EXACT_STREAM).select("series_id", "run_length", r6("p", "p"))


@register("stream_rate_now", o.query(o.DAILY, o.Chain(30, M).bins(), _LFS, _STREAM, _RUNS, "at AS (SELECT r.series_id, r.t, p, n1 / n2 AS m1, n1 / (n2 * n2) AS v, r.t - r.a + 1 AS len FROM runs r JOIN bins q ON q.series_id = r.series_id AND q.a = r.a AND q.b = r.t)".replace("at AS", "state AS"),
    "mean AS (SELECT series_id, t, sum(p * m1) AS rate FROM state GROUP BY 1, 2)", recursive=True,
    select=f"SELECT s.series_id, s.t::INTEGER AS k, {o.rounded('any_value(rate)')} AS rate, {o.rounded('sqrt(sum(p * v) + sum(p * (m1 - rate) * (m1 - rate)))')} AS rate_std, {o.rounded('sum(CASE WHEN len <= 3 THEN p ELSE 0 END)')} AS p_change FROM state s JOIN mean USING (series_id, t) GROUP BY 1, 2"))
def stream_rate_now(spark, sf_dir):
    return live.replay_stream(gathered(spark, sf_dir), "poisson", **_EXACT_STREAM).select("series_id", "k", r6("rate", "rate"), r6("rate_std", "rate_std"), r6("p_change", "p_change"))


@register("stream_default")
def stream_default(spark, sf_dir):
    return live.replay_stream(exact.gather(hourly(spark, sf_dir), weak=1.0), "poisson", expected_run_length=200.0, lag=12)


@register("stream_learnt_hazard")
def stream_learnt_hazard(spark, sf_dir):
    return live.replay_stream(exact.gather(hourly(spark, sf_dir), weak=1.0), "poisson", expected_run_length=100.0, hazard_strength=1.0)


def _negbin(r: float) -> str:
    beta = "lgamma({0}) + lgamma({1}) - lgamma({0} + {1})".format
    return f"""
    nbp AS (SELECT series_id, p2 * {r} + p1 + 2 AS na, p1 + p1 * (1 + p1) / (p2 * {r}) AS nb FROM prior),
    nbc AS (SELECT ser.series_id, k, y, na, nb, sum(y) OVER w AS cy, sum(lgamma(y + {r}) - lgamma({r}) - lgamma(y + 1)) OVER w AS cc, lgamma(y + {r}) - lgamma({r}) - lgamma(y + 1) AS own
        FROM ser JOIN nbp ON nbp.series_id = ser.series_id WINDOW w AS (PARTITION BY ser.series_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
    full_bins AS (SELECT x.series_id, x.k AS a, z.k AS b, z.cc - x.cc + x.own + {beta(f"(x.na + {r} * (z.k - x.k + 1))", "(x.nb + z.cy - x.cy + x.y)")} - ({beta("x.na", "x.nb")}) AS l
        FROM nbc x JOIN nbc z ON z.series_id = x.series_id AND z.k >= x.k)"""


_PREFIXES = f"SELECT series_id, t::INTEGER AS k, {o.rounded('zz[t + 2]')} AS log_marginal FROM z"


@register("stream_negbin", o.query(o.DAILY, _negbin(4.0), _recursion(1 / 100), recursive=True, select=_PREFIXES))
def stream_negbin(spark, sf_dir):
    return live.replay_stream(gathered(spark, sf_dir), "negbin", expected_run_length=100.0, dispersion=4.0, prune=0.0).select("series_id", "k", r6("log_marginal", "log_marginal"))


_HITS = "full_bins AS (SELECT q.series_id, q.a, q.b, l + z.c1 - x.c1 + x.lf AS l FROM bins q JOIN lfs x ON x.k = q.a JOIN lfs z ON z.k = q.b)"


@register("stream_bernoulli", o.query(o.USERS, o.user_series("ser", "true"), _USER_PRIOR.replace("32.0", "1.0"), o.Chain(24, M, "bernoulli").bins(),
    "lfs AS (SELECT k, lgamma(y + e + 1) - lgamma(y + 1) - lgamma(e + 1) AS lf, sum(lgamma(y + e + 1) - lgamma(y + 1) - lgamma(e + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS c1 FROM ser)",
    _HITS, _recursion(1 / 12), recursive=True, select=_PREFIXES))
def stream_bernoulli(spark, sf_dir):
    return live.replay_stream(exact.gather(users(spark, sf_dir), p1=1.0, p2=1.0), "bernoulli", expected_run_length=12.0, prune=0.0).select("series_id", "k", r6("log_marginal", "log_marginal"))


@register("stream_dispersions")
def stream_dispersions(spark, sf_dir):
    return live.dispersions(exact.gather(hourly(spark, sf_dir), weak=1.0), expected_run_length=100.0)


_HOURLY_RUNS = ["runs AS (SELECT series_id, t, unnest(range(t + 1)) AS a, unnest(list_transform(terms, lambda v: exp(v - zl))) AS p FROM (SELECT *, zz[t + 2] AS zl FROM z))", """
    live_runs AS MATERIALIZED (SELECT r.series_id, r.t, r.p, n1, n2, r.t - r.a + 1 AS len FROM runs r JOIN bins q ON q.series_id = r.series_id AND q.a = r.a AND q.b = r.t WHERE r.p >= 1e-12),
    before AS (SELECT series_id, t + 1 AS t, p * {stay} AS p, n1, n2 FROM live_runs UNION ALL SELECT series_id, k, CASE WHEN k = 0 THEN 1.0 ELSE {h} END, p1, p2 FROM ser JOIN prior USING (series_id)),
    pits AS (SELECT b.series_id, t, sum(p * (coalesce(list_sum(list_transform(range(y::BIGINT), lambda j: exp(lgamma(j + n1) - lgamma(n1) - lgamma(j + 1) - j * ln(n2 + 1) + n1 * ln(n2 / (n2 + 1))))), 0)
        + 0.5 * exp(lgamma(y + n1) - lgamma(n1) - lgamma(y + 1) - y * ln(n2 + 1) + n1 * ln(n2 / (n2 + 1))))) AS pit FROM before b JOIN ser s ON s.series_id = b.series_id AND s.k = b.t GROUP BY 1, 2)""".format(h=1 / 200, stay=1 - 1 / 200)]
_HOURLY = [o.HOURS, o.Chain(720, M).bins(), _LFS, _FULL_BINS, _recursion(1 / 200), *_HOURLY_RUNS]
#: All options at their defaults but for merging, which SQL has no counterpart for.
_UNMERGED = {"expected_run_length": 200.0, "merge_bins": None}


@register("stream_hourly", o.query(*_HOURLY, "at_t AS (SELECT series_id, t, sum(p * n1 / n2) / sum(p) AS rate FROM live_runs GROUP BY 1, 2)", recursive=True,
    select=f"SELECT s.series_id, s.t::INTEGER AS k, {o.rounded('any_value(zz[s.t + 2])', 5)} AS log_marginal, {o.rounded('any_value(pit)', 5)} AS pit, {o.rounded('any_value(rate)', 5)} AS rate, {o.rounded('sqrt(sum(p * n1 / (n2 * n2)) + sum(p * (n1 / n2 - rate) * (n1 / n2 - rate)))', 5)} AS rate_std, {o.rounded('sum(CASE WHEN len <= 3 THEN p ELSE 0 END)', 5)} AS p_change FROM live_runs s JOIN at_t USING (series_id, t) JOIN pits USING (series_id, t) JOIN z ON z.series_id = s.series_id AND z.t = s.t GROUP BY 1, 2"))
def stream_hourly(spark, sf_dir):
    """All 720 hours, improbable runs pruned as by default."""
    out = live.replay_stream(exact.gather(hourly(spark, sf_dir), weak=1.0), "poisson", **_UNMERGED)
    return out.select("series_id", "k", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("log_marginal", "pit", "rate", "rate_std", "p_change")))


_LEARNT = f"""
    hz AS (SELECT series_id, m AS c, k, v + lgamma(1 + m) + lgamma(99 + k - m) - lgamma(100 + k) - lgamma(1) - lgamma(99) + lgamma(100) + cst AS x FROM
        (SELECT q.series_id, q.m, q.k, q.v, c.cst FROM ({" UNION ALL ".join(f"SELECT series_id, {m} AS m, k, v FROM f{m}" for m in range(30))}) q
        JOIN (SELECT series_id, k, sum(-lgamma(y + 1)) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS cst FROM ser) c USING (series_id, k))),
    hw AS (SELECT series_id, k, c, x, max(x) OVER w AS mx FROM hz WINDOW w AS (PARTITION BY series_id, k))"""


@register("stream_learnt_hazard_daily", o.query(o.DAILY, o.Chain(30, 29).bins().forward(), _LEARNT,
    select=f"SELECT series_id, k::INTEGER AS k, {o.rounded('any_value(mx) + ln(sum(exp(x - mx)))')} AS log_marginal, {o.rounded('sum(exp(x - mx) * (1 + c) / (100 + k)) / sum(exp(x - mx))')} AS hazard FROM hw GROUP BY 1, 2"))
def stream_learnt_hazard_daily(spark, sf_dir):
    out = live.replay_stream(gathered(spark, sf_dir), "poisson", expected_run_length=100.0, hazard_strength=1.0, prune=0.0)
    return out.select("series_id", "k", r6("log_marginal", "log_marginal"), r6("hazard", "hazard"))


_SPREADS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
_LB = "(lgamma({0}) + lgamma({1}) - lgamma({0} + {1}))".format
_DISPERSED = f"""
    spread AS (SELECT unnest({_SPREADS}::DOUBLE[]) AS r),
    nbp AS (SELECT series_id, r, p2 * r + p1 + 2 AS na, p1 + p1 * (1 + p1) / (p2 * r) AS nb FROM prior CROSS JOIN spread),
    nbc AS (SELECT ser.series_id, r, k, y, na, nb, sum(y) OVER w AS cy, sum(lgamma(y + r) - lgamma(r) - lgamma(y + 1)) OVER w AS cc, lgamma(y + r) - lgamma(r) - lgamma(y + 1) AS own
        FROM ser JOIN nbp ON nbp.series_id = ser.series_id WINDOW w AS (PARTITION BY ser.series_id, r ORDER BY k ROWS UNBOUNDED PRECEDING)),
    full_bins AS (SELECT x.series_id || '#' || x.r AS series_id, x.k AS a, z.k AS b, z.cc - x.cc + x.own + {_LB("(x.na + x.r * (z.k - x.k + 1))", "(x.nb + z.cy - x.cy + x.y)")} - {_LB("x.na", "x.nb")} AS l
        FROM nbc x JOIN nbc z ON z.series_id = x.series_id AND z.r = x.r AND z.k >= x.k
        UNION ALL SELECT q.series_id || '#inf', q.a, q.b, l - (z.c1 - x.c1 + x.lf), FROM bins q JOIN lfs x ON x.series_id = q.series_id AND x.k = q.a JOIN lfs z ON z.series_id = q.series_id AND z.k = q.b)"""


@register("stream_dispersions_daily", o.query(o.DAILY, o.Chain(30, M).bins(), _LFS, _DISPERSED, _recursion(1 / 100), """
    whole AS (SELECT split_part(series_id, '#', 1) AS series_id, CASE WHEN split_part(series_id, '#', 2) = 'inf' THEN 0.0 ELSE 1 / split_part(series_id, '#', 2)::DOUBLE END AS inverse, zz[31] AS v FROM z WHERE t = 29)""", recursive=True,
    select=f"SELECT series_id, {o.rounded('inverse')} AS inverse, {o.rounded('exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY series_id)')} AS weight FROM (SELECT *, max(v) OVER (PARTITION BY series_id) AS mx FROM whole)"))
def stream_dispersions_daily(spark, sf_dir):
    """Weights by the inverse of the dispersion (0: Poisson)."""
    out = live.dispersions(gathered(spark, sf_dir), expected_run_length=100.0, prune=0.0)
    return out.select("series_id", r6(1 / F.col("dispersion"), "inverse"), r6("weight", "weight"))


@register("pit_uniformity", o.query(*_HOURLY, "ranked AS (SELECT series_id, pit, row_number() OVER (PARTITION BY series_id ORDER BY pit) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM pits)", recursive=True,
    select=f"SELECT series_id, any_value(n) AS n, {o.rounded('max(greatest(i / n - pit, pit - (i - 1) / n))')} AS ks FROM ranked GROUP BY 1"))
def pit_uniformity(spark, sf_dir):
    ks = baselines.ks_distance(live.replay_stream(exact.gather(hourly(spark, sf_dir), weak=1.0), "poisson", **_UNMERGED))
    return ks.select("series_id", F.col("n").cast("long").alias("n"), r6("ks", "ks"))


@register("surprise_summary", o.query(*_HOURLY, recursive=True,
    select=f"SELECT series_id, count(*) AS n, sum(CASE WHEN pit >= 0.99 THEN 1 ELSE 0 END)::BIGINT AS alarms, {o.rounded('avg(CASE WHEN pit >= 0.99 THEN 1.0 ELSE 0.0 END)')} AS share FROM pits GROUP BY 1"))
def surprise_summary(spark, sf_dir):
    out = baselines.surprises(live.replay_stream(exact.gather(hourly(spark, sf_dir), weak=1.0), "poisson", **_UNMERGED), 0.99)
    return out.select("series_id", F.col("n").cast("long").alias("n"), F.col("alarms").cast("long").alias("alarms"), r6("share", "share"))


# Structured Streaming


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, the path may be a file as well as a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").where(F.col("event_type").isNotNull())


def _drained(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Runs a stream until its source is used up, and returns what it wrote."""
    out, marks = scratch.path(name), scratch.path(f"{name}-marks")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


@register("streamed_counts", """
    SELECT event_type AS series_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000)::INTEGER AS k, count(*)::DOUBLE AS y FROM events WHERE event_type IS NOT NULL
    GROUP BY 1, 2 HAVING TIMESTAMP '2024-01-01' + to_hours(k + 1) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def streamed_counts(spark, sf_dir):
    counts = watched.closed_counts(_event_stream(spark, sf_dir), F.col("event_type"), "ts")
    return _drained(counts, Scratch(spark, "stream"), "counts").select("series_id", axis.hours_between("start", START).alias("k"), "y")


@register("streamed_change_points")
def streamed_change_points(spark, sf_dir):
    rows = watched.timed(_event_stream(spark, sf_dir), F.col("event_type"), "ts")
    return _drained(watched.watch(rows, "poisson", (1.0, 0.3), expected_run_length=200.0), Scratch(spark, "stream"), "watched")


# Grids and hierarchies


def month_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and month, a grid of twelve months for each year from the first to the last."""
    up = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("r"))
    made = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("at"))
    counts = made.join(up, F.col("o_custkey") == F.col("c_custkey")).groupBy("r", "at").agg(F.count(F.lit(1)).cast("double").alias("y"))
    axis_ = made.agg(F.trunc(F.min("at"), "year").alias("first"), F.add_months(F.trunc(F.max("at"), "year"), 11).alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("at"))
    cells = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r")).crossJoin(axis_)
    return cells.join(counts, ["r", "at"], "left").select(F.year("at").cast("string").alias("grid_id"), F.col("r").cast("int").alias("r"), (F.month("at") - 1).cast("int").alias("c"), F.coalesce("y", F.lit(0.0)).alias("y"), F.lit(1.0).alias("e"))


_MONTHS = """
    years AS (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders),
    made AS (SELECT year(o_orderdate) AS year, n_regionkey AS r, (month(o_orderdate) - 1)::INTEGER AS c, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
    cells AS MATERIALIZED (SELECT years.year::VARCHAR AS grid_id, r_regionkey::INTEGER AS r, m.c::INTEGER AS c, coalesce(y, 0.0)::DOUBLE AS y, 1.0::DOUBLE AS e FROM region CROSS JOIN years CROSS JOIN (SELECT unnest(range(12)) AS c) m
        LEFT JOIN made ON made.year = years.year AND made.r = r_regionkey AND made.c = m.c)"""


@register("month_grid", o.query(_MONTHS, select="SELECT * FROM cells"))
def month_grid(spark, sf_dir):
    return month_grids(spark, sf_dir)


def _two_level() -> list[str | o.Chain]:
    bands = """
    ser AS (SELECT x.grid_id || '-' || x.r || '-' || z.r AS series_id, x.grid_id, x.r AS r0, z.r AS r1, g.c::INTEGER AS k, sum(g.y) AS y, count(*)::DOUBLE AS e FROM (SELECT DISTINCT grid_id, r FROM cells) x
        JOIN (SELECT DISTINCT grid_id, r FROM cells) z ON z.grid_id = x.grid_id AND z.r >= x.r JOIN cells g ON g.grid_id = x.grid_id AND g.r BETWEEN x.r AND z.r GROUP BY 1, 2, 3, 4, 5),
    prior AS (SELECT DISTINCT series_id, 1.0::DOUBLE AS p1, 0.02::DOUBLE AS p2 FROM ser)"""
    columns = o.full(12, 4)
    parts = " UNION ALL ".join(f"SELECT series_id, v - (lgamma(12) - lgamma({m + 1}) - lgamma({12 - m})) AS x FROM f{m} WHERE k = 11" for m in range(5))
    columns.ctes.append(f"marg AS ({o.lse(parts, 'series_id')})")
    columns.ctes.append("r_ser AS (SELECT DISTINCT grid_id AS series_id, r0 AS k, 0.0::DOUBLE AS y, 1.0::DOUBLE AS e FROM ser)")
    columns.ctes.append("r_bins AS MATERIALIZED (SELECT DISTINCT grid_id AS series_id, r0 AS a, r1 AS b, v - ln(5) AS l, 0.0 AS m1, 0.0 AS m2, 0.0 AS n1, 0.0 AS n2 FROM marg JOIN ser USING (series_id))")
    rows = o.Chain(5, 4, ser="r_ser", p="r_").forward().backward().evidences().bin_posterior()
    return [_MONTHS, bands, columns, rows]


@register("two_level_evidence", o.query(*_two_level(), select=f"SELECT series_id AS grid_id, {o.rounded('any_value(total) - ln(5)')} AS log_marginal FROM r_post GROUP BY 1"))
def two_level_evidence(spark, sf_dir):
    return grid.two_level(month_grids(spark, sf_dir), 1.0, 0.02, 4, 4)[0].select("grid_id", r6("log_marginal", "log_marginal"))


@register("two_level_rates", o.query(*_two_level(), """
    mixed AS (SELECT g.grid_id, g.r, q.k AS c, sum(w) AS w, sum(w * rate) AS w1, sum(w * (rate * rate + rate_std * rate_std)) AS w2 FROM (SELECT DISTINCT grid_id, r FROM cells) g
        JOIN r_w b ON b.series_id = g.grid_id AND g.r BETWEEN b.a AND b.b JOIN rates q ON q.series_id = b.series_id || '-' || b.a || '-' || b.b GROUP BY 1, 2, 3)""",
    select=f"SELECT grid_id, r, c::INTEGER AS c, {o.rounded('w1 / w', 5)} AS rate, {o.rounded('sqrt(greatest(w2 / w - (w1 / w) * (w1 / w), 0))', 5)} AS rate_std FROM mixed"))
def two_level_rates(spark, sf_dir):
    out = grid.two_level(month_grids(spark, sf_dir), 1.0, 0.02, 4, 4)[1]
    return out.select("grid_id", "r", "c", *((F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("rate", "rate_std")))


def _guillotine(h: int, w: int, rho: float, alpha: str, beta: str) -> list[str]:
    """Rectangles by size: every size from the sizes below it. ``cells`` has grid_id, r, c, y, e, p1, p2."""
    out = ["""area AS MATERIALIZED (SELECT x.grid_id, x.r, x.c, z.r - x.r + 1 AS h, z.c - x.c + 1 AS w, sum(g.y) AS y, sum(g.e) AS e, any_value(x.p1) AS p1, any_value(x.p2) AS p2 FROM cells x JOIN cells z ON z.grid_id = x.grid_id AND z.r >= x.r AND z.c >= x.c
        JOIN cells g ON g.grid_id = x.grid_id AND g.r BETWEEN x.r AND z.r AND g.c BETWEEN x.c AND z.c GROUP BY 1, 2, 3, 4, 5)""",
        f"own AS MATERIALIZED (SELECT *, {alpha} * ln({beta}) - lgamma({alpha}) + lgamma(y + {alpha}) - (y + {alpha}) * ln(e + {beta}) AS l FROM area)",
        "z1x1 AS (SELECT grid_id, h, w, r, c, l AS v FROM own WHERE h = 1 AND w = 1)"]
    name = lambda i, j: f"z{i}x{j}"
    for i in range(1, h + 1):
        for j in range(1, w + 1):
            if i == j == 1:
                continue
            ways = (i > 1) + (j > 1)
            parts = [f"SELECT x.grid_id, x.r, x.c, x.v + z.v - ln({i - 1}) AS x FROM {name(k, j)} x JOIN {name(i - k, j)} z ON z.grid_id = x.grid_id AND z.r = x.r + {k} AND z.c = x.c" for k in range(1, i)]
            parts += [f"SELECT x.grid_id, x.r, x.c, x.v + z.v - ln({j - 1}) AS x FROM {name(i, k)} x JOIN {name(i, j - k)} z ON z.grid_id = x.grid_id AND z.r = x.r AND z.c = x.c + {k}" for k in range(1, j)]
            both = f"greatest(ln({rho}) + l, s) + ln(1 + exp(-abs(ln({rho}) + l - s)))"
            out.append(f"{name(i, j)} AS MATERIALIZED (SELECT grid_id, h, w, r, c, {both} AS v FROM (SELECT own.*, ln({1 - rho}) - ln({ways}) + q.v AS s FROM own JOIN ({o.lse(' UNION ALL '.join(parts), 'grid_id, r, c')}) q USING (grid_id, r, c) WHERE h = {i} AND w = {j}))")
    return out


@register("guillotine", o.query(_MONTHS.replace("1.0::DOUBLE AS e FROM region", "1.0::DOUBLE AS e, 1.0 AS p1, 0.02 AS p2 FROM region"), *_guillotine(5, 12, 0.5, "p1", "p2"), select=f"SELECT grid_id, {o.rounded('v')} AS log_evidence FROM z5x12"))
def guillotine(spark, sf_dir):
    return grid.guillotine(month_grids(spark, sf_dir), 1.0, 0.02, 0.5).select("grid_id", r6("log_evidence", "log_evidence"))


@register("binary_tree", o.query(o.DAILY, "cells AS (SELECT series_id AS grid_id, 0 AS r, k AS c, y, e, p1, p2 FROM ser JOIN prior USING (series_id))", *_guillotine(1, 30, 0.5, "p1", "p2"), select=f"SELECT grid_id AS series_id, {o.rounded('v')} AS log_evidence FROM z1x30"))
def binary_tree(spark, sf_dir):
    return grid.binary_tree(gathered(spark, sf_dir), 0.5).select("series_id", r6("log_evidence", "log_evidence"))


_TREE = """
    leaf AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent, count(o_orderkey)::DOUBLE AS y, 1.0::DOUBLE AS e FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    mid AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, coalesce(sum(y), 0) AS y, coalesce(sum(e), 0) AS e FROM nation LEFT JOIN leaf ON parent = 'n' || n_nationkey GROUP BY 1, 2),
    top AS (SELECT 'r' || r_regionkey AS node, 'world' AS parent, coalesce(sum(y), 0) AS y, coalesce(sum(e), 0) AS e FROM region LEFT JOIN mid ON parent = 'r' || r_regionkey GROUP BY 1, 2),
    root AS (SELECT 'world' AS node, NULL AS parent, sum(y) AS y, sum(e) AS e FROM top)"""
_TA, _TB, _RHO = 2.0, 0.2, 0.5


def _tree_l(a: float = _TA, b: float = _TB) -> str:
    return f"({a} * ln({b}) - lgamma({a}) + lgamma(y + {a}) - (y + {a}) * ln(e + {b}))"


def _tree_z(best: bool = False) -> str:
    ways = f"greatest(ln({_RHO}) + l, ln({1 - _RHO}) + zc)" if best else f"greatest(ln({_RHO}) + l, ln({1 - _RHO}) + zc) + ln(1 + exp(-abs(ln({_RHO}) + l - ln({1 - _RHO}) - zc)))"
    z = f"CASE WHEN zc IS NULL OR y = 0 THEN l ELSE {ways} END"
    out = [f"leaf_z AS (SELECT node, parent, y, e, {_tree_l()} AS l, {_tree_l()} AS z, NULL::DOUBLE AS zc FROM leaf)"]
    for name, below in (("mid", "leaf"), ("top", "mid"), ("root", "top")):
        out.append(f"{name}_z AS (SELECT node, parent, y, e, l, {z} AS z, CASE WHEN y > 0 THEN zc END AS zc FROM (SELECT t.*, {_tree_l()} AS l, zc FROM {name} t LEFT JOIN (SELECT parent AS up, sum(z) AS zc FROM {below}_z GROUP BY 1) ON up = node))")
    return ",\n    ".join(out)


def customers_tree(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """World, regions, nations, customers; the count of a customer is that of their orders, the exposure 1."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    n = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    leaf = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.coalesce("y", F.lit(0.0)).alias("y"), F.lit(1.0).alias("exposure"))
    mid = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), none("y", "double"), none("exposure", "double"))
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit("world").alias("parent"), none("y", "double"), none("exposure", "double"))
    root = spark.range(1).select(F.lit("world").alias("node"), none("parent", "string"), none("y", "double"), none("exposure", "double"))
    return leaf.unionByName(mid).unionByName(top).unionByName(root)


_EACH = (("root", 0), ("top", 1), ("mid", 2), ("leaf", 3))


@register("tree_evidence", o.query(_TREE, _tree_z(), select=" UNION ALL ".join(f"SELECT node, {k} AS level, y, e AS exposure, {o.rounded('l')} AS log_bin, {o.rounded('z')} AS log_z FROM {n}_z" for n, k in _EACH)))
def tree_evidence(spark, sf_dir):
    return tree.tree_evidence(customers_tree(spark, sf_dir), _TA, _TB, _RHO).select("node", "level", "y", "exposure", r6("log_bin", "log_bin"), r6("log_z", "log_z"))


def _tree_down() -> str:
    own = f"CASE WHEN zc IS NULL THEN 1.0 ELSE exp(ln({_RHO}) + l - z) END"
    out = [f"root_p AS (SELECT node, parent, 1.0 * {own} AS p, 1.0 - {own} AS r, y, e FROM root_z)"]
    for name, above in (("top", "root"), ("mid", "top"), ("leaf", "mid")):
        out.append(f"{name}_p AS (SELECT x.node, x.parent, u.r * {own} AS p, u.r * (1 - {own}) AS r, x.y, x.e FROM {name}_z x JOIN {above}_p u ON u.node = x.parent)")
    return ",\n    ".join(out)


@register("tree_posterior", o.query(_TREE, _tree_z(), _tree_down(), select=" UNION ALL ".join(f"SELECT node, {k} AS level, {o.rounded('p')} AS p_bin, {o.rounded(f'(y + {_TA}) / (e + {_TB})')} AS rate FROM {n}_p" for n, k in _EACH)))
def tree_posterior(spark, sf_dir):
    return tree.tree_posterior(customers_tree(spark, sf_dir), _TA, _TB, _RHO).select("node", "level", r6("p_bin", "p_bin"), r6("rate", "rate"))


@register("tree_leaf_rates", o.query(_TREE, _tree_z(), _tree_down(), f"""
    rt AS ({" UNION ALL ".join(f"SELECT node, parent, p * (y + {_TA}) / (e + {_TB}) AS x FROM {n}_p" for n, _ in _EACH)})""",
    select=f"SELECT l.node, {o.rounded('l.x + m.x + t.x + r.x')} AS rate FROM rt l JOIN rt m ON m.node = l.parent JOIN rt t ON t.node = m.parent JOIN rt r ON r.node = t.parent WHERE l.node LIKE 'c%'"))
def tree_leaf_rates(spark, sf_dir):
    p = tree.tree_posterior(customers_tree(spark, sf_dir), _TA, _TB, _RHO)
    return tree.leaf_rates(p, 4).where("node LIKE 'c%'").select("node", r6("rate", "rate"))


def _tree_best() -> str:
    cut = f"coalesce(ln({1 - _RHO}) + zc > ln({_RHO}) + l, false)"
    out = [f"root_b AS (SELECT node, y, e, {cut} AS cut FROM root_z)"]
    for name, above in (("top", "root"), ("mid", "top"), ("leaf", "mid")):
        out.append(f"{name}_b AS (SELECT x.node, x.y, x.e, {cut} AS cut FROM {name}_z x JOIN {above}_b u ON u.node = x.parent AND u.cut)")
    return ",\n    ".join(out)


@register("tree_best_partition", o.query(_TREE, _tree_z(True), _tree_best(), select=" UNION ALL ".join(f"SELECT node, {k} AS level, y, e AS exposure FROM {n}_b WHERE NOT cut" for n, k in _EACH)))
def tree_best_partition(spark, sf_dir):
    return tree.best_partition(customers_tree(spark, sf_dir), _TA, _TB, _RHO)


_SETTINGS = [(a, b, r) for a in (1.0, 2.0, 8.0) for b in (0.1, 0.2, 0.8) for r in (0.2, 0.5, 0.8)]


def _tree_settings() -> str:
    ev = "(ga * ln(gb) - lgamma(ga) + lgamma(y + ga) - (y + ga) * ln(e + gb))"
    z = "CASE WHEN zc IS NULL OR y = 0 THEN l ELSE greatest(ln(gr) + l, ln(1 - gr) + zc) + ln(1 + exp(-abs(ln(gr) + l - ln(1 - gr) - zc))) END"
    out = [f"g AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {r}::DOUBLE)' for a, b, r in _SETTINGS)}) t(ga, gb, gr))"]
    out.append(f"leaf_g AS (SELECT ga, gb, gr, parent, sum{ev} AS zc FROM leaf CROSS JOIN g GROUP BY ALL)")
    for name, below in (("mid", "leaf"), ("top", "mid")):
        out.append(f"{name}_g AS (SELECT ga, gb, gr, parent, sum({z}) AS zc FROM (SELECT t.*, g.*, {ev} AS l, zc FROM {name} t CROSS JOIN g LEFT JOIN {below}_g b USING (ga, gb, gr) WHERE b.parent = node OR b.parent IS NULL) GROUP BY ALL)")
    out.append(f"root_g AS (SELECT ga, gb, gr, {z} AS z FROM (SELECT t.*, g.*, {ev} AS l, zc FROM root t CROSS JOIN g JOIN top_g b USING (ga, gb, gr)))")
    return ",\n    ".join(out)


@register("tree_prior_search", o.query(_TREE, _tree_settings(), select=f"SELECT ga AS alpha, gb AS beta, gr AS rho, {o.rounded('z')} AS log_z FROM root_g"))
def tree_prior_search(spark, sf_dir):
    return tree.prior_search(customers_tree(spark, sf_dir), _SETTINGS).select("alpha", "beta", "rho", r6("log_z", "log_z"))


@register("tree_best_prior", o.query(_TREE, _tree_settings(), select=f"SELECT arg_max(ga, z) AS alpha, arg_max(gb, z) AS beta, arg_max(gr, z) AS rho, {o.rounded('max(z)')} AS log_z FROM root_g"))
def tree_best_prior(spark, sf_dir):
    return tree.best_prior(customers_tree(spark, sf_dir), _SETTINGS).select("alpha", "beta", "rho", r6("log_z", "log_z"))


def _half(text: str, prefix: str) -> str:
    """The same tables for the orders that are learnt from, with names of their own."""
    text = re.sub(r"\b(leaf|mid|top|root)(_[zb])?\b", rf"{prefix}_\1\2", text)
    return text.replace("LEFT JOIN orders ON o_custkey = c_custkey", "LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o_custkey = c_custkey")


_GAINS = " UNION ALL ".join(f"SELECT x.l - t.l AS gain FROM {n}_z x JOIN b_{n}_z t ON t.node = x.node JOIN b_{n}_b b ON b.node = x.node WHERE NOT b.cut" for n, _ in _EACH)


@register("tree_held_out", o.query(_TREE, _tree_z(), _half(_TREE, "h"), _half(_tree_z(), "h"), _half(_TREE, "b"), _half(_tree_z(True), "b"), _half(_tree_best(), "b"),
    select=f"SELECT {o.rounded('(SELECT z FROM root_z) - (SELECT z FROM h_root_z)')} AS log_p_tree, {o.rounded(f'(SELECT sum(gain) FROM ({_GAINS}))')} AS log_p_best"))
def tree_held_out(spark, sf_dir):
    """What all orders add to the even ones, averaged over cuts and in the best partition of the even ones."""
    first = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    out = tree.held_out(customers_tree(spark, sf_dir, first), customers_tree(spark, sf_dir), _TA, _TB, _RHO)
    return out.select(r6("log_p_tree", "log_p_tree"), r6("log_p_best", "log_p_best"))


@register("tree_lookup", o.query(_TREE, _tree_z(True), _tree_best(), select="""
    SELECT l.node AS place, CASE WHEN NOT r.cut THEN r.node WHEN NOT t.cut THEN t.node WHEN NOT m.cut THEN m.node ELSE l.node END AS node
    FROM leaf l JOIN mid mm ON mm.node = l.parent JOIN top tt ON tt.node = mm.parent CROSS JOIN root_b r LEFT JOIN top_b t ON t.node = tt.node LEFT JOIN mid_b m ON m.node = mm.node"""))  # fmt: skip
def tree_lookup(spark, sf_dir):
    """The bin of the best partition that holds each customer."""
    nodes = customers_tree(spark, sf_dir)
    bins = Scratch(spark, "lookup").cut(tree.best_partition(nodes, _TA, _TB, _RHO))
    return tree.lookup(nodes, bins, nodes.where("node LIKE 'c%'").select(F.col("node").alias("place"), "node"), 3)


@register("merge_neighbours")
def merge_neighbours(spark, sf_dir):
    """Neighbouring months of a region's orders over all years, joined greedily; months are numbered from the year 0."""
    name = lambda n: F.lpad(n.cast("string"), 6, "0")
    g = month_grids(spark, sf_dir).withColumn("n", F.col("grid_id").cast("int") * 12 + F.col("c"))
    bins = g.select(F.col("r").cast("string").alias("region"), name(F.col("n")).alias("node"), "y", F.col("e").alias("exposure"))
    # The pair after the last month has no bin, so the operator leaves it out.
    edges = g.select(F.col("r").cast("string").alias("region"), name(F.col("n")).alias("a"), name(F.col("n") + 1).alias("b"))
    return tree.merge_neighbours(bins, edges, 1.0, 0.02)


def _dyadic(levels: int) -> str:
    ev = "(2.0 * ln(0.5) - lgamma(2.0) + lgamma(y + 2.0) - (y + 2.0) * ln(e + 0.5))"
    out = [f"d0 AS (SELECT series_id, k, y, e, {ev} AS z FROM flat)"]
    for d in range(1, levels + 1):
        out.append(f"d{d} AS (SELECT series_id, k, y, e, greatest({ev}, zc) + ln(1 + exp(-abs({ev} - zc))) + ln(0.5) AS z FROM (SELECT series_id, k // 2 AS k, sum(y) AS y, sum(e) AS e, sum(z) AS zc FROM d{d - 1} GROUP BY 1, 2))")
    return ",\n    ".join(out)


@register("dyadic_tree", o.query(o.HOURLY, "flat AS (SELECT types.series_id, r.k, coalesce(y, 0.0)::DOUBLE AS y, 1.0::DOUBLE AS e FROM types CROSS JOIN (SELECT unnest(range(720)) AS k) r LEFT JOIN counted c ON c.series_id = types.series_id AND c.k = r.k)", _dyadic(10), select=f"SELECT series_id, {o.rounded('z')} AS log_evidence FROM d10"))
def dyadic_tree(spark, sf_dir):
    # The 304 places after the last hour have no exposure: their evidence is 1.
    return tree.dyadic(hourly(spark, sf_dir), 1024, 2.0, 0.5, 0.5).select("series_id", r6("log_evidence", "log_evidence"))


# Baselines


@register("histogram", o.query(o.DAILY, select=f"SELECT series_id, ((k + 2) // 5)::INTEGER AS bin, count(*)::BIGINT AS n, sum(y) AS total, {o.rounded('avg(y)')} AS rate FROM ser GROUP BY 1, 2"))
def histogram(spark, sf_dir):
    return baselines.histogram(daily(spark, sf_dir), 5, 2).withColumn("rate", F.round("rate", 6) + F.lit(0.0))


_WIDTHS = [2, 3, 5, 6, 10]


_COSTS = f"""
    settings AS (SELECT w, unnest(range(w)) AS off FROM (SELECT unnest({_WIDTHS}) AS w)),
    full_bins AS (SELECT series_id, w, off, (k - off) // w AS bin, sum(y) AS y FROM ser, settings WHERE k >= off AND off + ((k - off) // w + 1) * w - 1 <= 29 GROUP BY 1, 2, 3, 4),
    costs AS (SELECT series_id, w, off, (2 * avg(y) - var_pop(y)) / (w * w) AS c FROM full_bins GROUP BY 1, 2, 3),
    by_width AS (SELECT series_id, w::INTEGER AS width, avg(c) AS cost FROM costs GROUP BY 1, 2)"""


@register("width_choice", o.query(o.DAILY, _COSTS, select=f"SELECT series_id, width, {o.rounded('cost')} AS cost FROM by_width"))
def width_choice(spark, sf_dir):
    return baselines.width_costs(daily(spark, sf_dir), _WIDTHS).select("series_id", "width", r6("cost", "cost"))


@register("best_width", o.query(o.DAILY, _COSTS, select=f"SELECT series_id, arg_min(width, (cost, width)) AS width, {o.rounded('min(cost)')} AS cost FROM by_width GROUP BY 1"))
def best_width(spark, sf_dir):
    return baselines.best_width(daily(spark, sf_dir), _WIDTHS).select("series_id", "width", r6("cost", "cost"))


@register("kernel_rates", o.query(o.DAILY, select=f"SELECT x.series_id, x.k, {o.rounded('sum(exp(-0.5 * ((x.k - z.k) / 2.0) ** 2) * z.y) / sum(exp(-0.5 * ((x.k - z.k) / 2.0) ** 2))')} AS rate FROM ser x JOIN ser z ON z.series_id = x.series_id GROUP BY 1, 2"))
def kernel_rates(spark, sf_dir):
    return baselines.kernel_rates(gathered(spark, sf_dir), 2.0).select("series_id", "k", r6("rate", "rate"))


@register("fit_coverage", o.query(o.DAILY, FULL, "truth AS (SELECT series_id, avg(y) AS t FROM ser GROUP BY 1)", select=f"SELECT series_id, {o.rounded('sqrt(avg((rate - t) * (rate - t)))')} AS rms, {o.rounded('avg(CASE WHEN abs(rate - t) <= 2 * rate_std THEN 1.0 ELSE 0.0 END)')} AS covered FROM rates JOIN truth USING (series_id) GROUP BY 1"))
def fit_coverage(spark, sf_dir):
    d = daily(spark, sf_dir)
    truth = d.join(d.groupBy("series_id").agg(F.avg("y").alias("true_rate")), "series_id").select("series_id", "k", "true_rate")
    rates = fit.by_k(fit.fit(exact.gather(d, weak=1.0), "poisson", M))
    return baselines.rms_error(rates, truth).join(baselines.coverage(rates, truth, 2.0), "series_id").select("series_id", r6("rms", "rms"), r6("covered", "covered"))


_SDS = [0.7, 1.5, 3.0, 6.0]


@register("best_bandwidth", o.query(o.DAILY, f"""
    tried AS (SELECT x.series_id, sd, sum(x.y * z.y * exp(-((x.k - z.k) ** 2) / (4 * sd * sd))) / (2 * sqrt(pi()) * sd) - 2 * (sum(x.y * z.y * exp(-((x.k - z.k) ** 2) / (2 * sd * sd))) - sum(CASE WHEN x.k = z.k THEN x.y ELSE 0 END)) / (sqrt(2 * pi()) * sd) AS cost
        FROM ser x JOIN ser z ON z.series_id = x.series_id CROSS JOIN (SELECT unnest({_SDS}::DOUBLE[]) AS sd) GROUP BY 1, 2)""", select=f"SELECT series_id, arg_min(sd, cost) AS sd, {o.rounded('min(cost) / 100', 4)} AS cost FROM tried GROUP BY 1"))  # fmt: skip
def best_bandwidth(spark, sf_dir):
    return baselines.best_bandwidth(gathered(spark, sf_dir), _SDS, 10).select("series_id", "sd", (F.round("cost", 4) + F.lit(0.0)).alias("cost"))


@register("sliding_windows", """
    SELECT event_type AS series_id, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(back) AS start, count(*)::DOUBLE AS y FROM events CROSS JOIN (SELECT unnest([0, 1]) AS back) WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    out = watched.sliding_counts(table(spark, sf_dir, "events").where("event_type IS NOT NULL"), F.col("event_type"), "ts", "2 hours", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("session_windows", """
    WITH marked AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    named AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT event_type AS series_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS "end", count(*)::DOUBLE AS y FROM named GROUP BY event_type, s""")
def session_windows(spark, sf_dir):
    out = watched.session_counts(table(spark, sf_dir, "events").where("event_type IS NOT NULL"), F.col("event_type"), "ts", "15 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("sql_table_function", o.query(o.DAILY, FULL, select=_RATES))
def sql_table_function(spark, sf_dir):
    sql.register(spark)
    daily(spark, sf_dir).createOrReplaceTempView("daily_series")
    return _rates(spark.sql(f"SELECT * FROM bin_fit(TABLE(daily_series), {M})"))


@register("sql_functions", f"""
    WITH q AS (SELECT DISTINCT l_quantity::DOUBLE AS a, l_linenumber::DOUBLE AS b FROM lineitem)
    SELECT a, b, {o.rounded('lgamma(a + 0.5)')} AS lg, {o.rounded('lgamma(a) + lgamma(b) - lgamma(a + b)')} AS lb, {o.rounded('a * ln(b)')} AS xl, {o.rounded('lgamma(a + b + 1) - lgamma(b + 1) - lgamma(a + 1)')} AS lc,
        {o.rounded('greatest(a, b) + ln(1 + exp(-abs(a - b)))')} AS la, {o.rounded('list_sum(list_transform(range(b::BIGINT), lambda j: exp(j * ln(a / 5) - a / 5 - lgamma(j + 1))))')} AS gq,
        {o.rounded('1 - list_sum(list_transform(range(b::BIGINT), lambda j: exp(j * ln(a / 5) - a / 5 - lgamma(j + 1))))')} AS gp,
        {o.rounded('list_sum(list_transform(range(a::BIGINT, (a + b)::BIGINT), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j) + j * ln(0.7123) + (a + b - 1 - j) * ln(0.2877))))')} AS ib FROM q""")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "lineitem").selectExpr("CAST(l_quantity AS DOUBLE) AS a", "CAST(l_linenumber AS DOUBLE) AS b").distinct().createOrReplaceTempView("quantities")
    out = spark.sql("SELECT a, b, lgamma(a + 0.5) AS lg, betaln(a, b) AS lb, xlogy(a, b) AS xl, log_binom(a + b, b) AS lc, log_add(a, b) AS la, gammaincc(b, a / 5) AS gq, gammainc(b, a / 5) AS gp, betainc(a, b, CAST(0.7123 AS DOUBLE)) AS ib FROM quantities")
    return out.select("a", "b", *(r6(c, c) for c in ("lg", "lb", "xl", "lc", "la", "gq", "gp", "ib")))
