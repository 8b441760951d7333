"""From events and trials to dense series, and changes of the axis. Everything is a DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.schema import require


def hours_between(ts: str, start: str, width: str = "1 hour") -> Column:
    """Number of the interval of ``width`` (seconds, or a fixed interval) that holds ``ts``, from ``start``."""
    seconds = {"1 hour": 3600, "1 day": 86400}.get(width) or int(width.split()[0])
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(start)))) / (seconds * 1_000_000)).cast("int")


def interval_counts(events: DataFrame, series: Column, k: Column, weight: Column | None = None) -> DataFrame:
    """(series_id, k, y): events, or the sum of ``weight``, of each interval that has any; one partial aggregate."""
    y = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return events.select(series.cast("string").alias("series_id"), k.alias("k"), *([weight.alias("w")] if weight is not None else [])).groupBy("series_id", "k").agg(
        (y if weight is None else F.sum("w")).cast("double").alias("y")
    )


def densify(counts: DataFrame, first: int, last: int, *, fill: dict[str, float] | None = None) -> DataFrame:
    """One row for each series and interval first..last; missing counts become ``fill`` (y = 0, e = 1).

    A series' counts are gathered and laid out again, so the source is read once. Rows that repeat an interval are an error.
    """
    fill = fill or {"y": 0.0, "e": 1.0}
    have = [c for c in fill if c in counts.columns]
    rows = counts.where(F.col("k").between(first, last)).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(*have).alias("v")))).alias("m"))
    every = rows.select("series_id", F.explode(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.struct(k.alias("k"), F.element_at("m", k).alias("v")))).alias("x"))
    return every.select("series_id", F.col("x.k").alias("k"), *(F.coalesce(F.col(f"x.v.{c}"), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in fill.items()))


def spike_counts(trials: DataFrame, t_start: int, t_end: int, *, n_trials: DataFrame | None = None) -> DataFrame:
    """(series_id, k, s, g) from trials (series_id, trial_id, t): trials with and without an event in each interval t_start..t_end.

    Both ends are included; events outside are left out; two events of one trial in one interval are an error. A trial
    without events has one row with a null t, or ``n_trials`` (series_id, n) gives the number of trials.
    """
    inside = trials.where((F.col("t") >= t_start) & (F.col("t") <= t_end))
    once = inside.groupBy("series_id", "trial_id", "t").agg(F.count(F.lit(1)).alias("n"))
    once = require(once, F.col("n") == 1, "two events of one trial in one interval")
    s = once.groupBy("series_id", "t").agg(F.count(F.lit(1)).cast("double").alias("s"))
    n = n_trials if n_trials is not None else trials.select("series_id", "trial_id").distinct().groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    axis = n.select("series_id", "n", F.explode(F.sequence(F.lit(t_start), F.lit(t_end))).alias("t"))
    out = axis.join(s, ["series_id", "t"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return out.select("series_id", (F.col("t") - t_start).cast("int").alias("k"), "s", (F.col("n") - F.col("s")).alias("g"))


def add_trials(series: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of two sets of trials over one axis."""
    cols = [c for c in series.columns if c not in ("series_id", "k")]
    return series.unionByName(more).groupBy("series_id", "k").agg(*(F.sum(c).alias(c) for c in cols))


def split_trials(trials: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` trials of each series, by id, and the rest; only ids are ranked."""
    ids = trials.select("series_id", "trial_id").distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy("trial_id"))).where(F.col("r") <= n).drop("r")
    return trials.join(first, ["series_id", "trial_id"], "left_semi"), trials.join(first, ["series_id", "trial_id"], "left_anti")


def within(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("k").between(first, last))


def outside_excluded(bins: DataFrame, t1: float, t2: float) -> DataFrame:
    """Bins that are not wholly inside the open interval (t1, t2)."""
    return bins.where(~((F.col("a") > t1) & (F.col("b") < t2)))


def reverse(series: DataFrame, T: int) -> DataFrame:
    return series.withColumn("k", F.lit(T - 1) - F.col("k"))


def rotate(series: DataFrame, T: int, s: int | Column) -> DataFrame:
    """The axis opened before interval ``s``."""
    return series.withColumn("k", F.pmod(F.col("k") - s, F.lit(T)).cast("int"))


def fold_periods(series: DataFrame, period: int) -> DataFrame:
    """Counts by phase; exposure is that of the periods that were observed."""
    return series.groupBy("series_id", F.pmod("k", F.lit(period)).cast("int").alias("k")).agg(F.sum("y").alias("y"), F.sum("e").alias("e"))


def rebin(series: DataFrame, edges: list[int]) -> DataFrame:
    """Unequal intervals edges[i]..edges[i + 1] - 1 with their summed exposure."""
    k = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        k = F.when((F.col("k") >= edges[i]) & (F.col("k") < edges[i + 1]), F.lit(i)).otherwise(k)
    out = series.withColumn("k", k).where(F.col("k").isNotNull())
    return out.groupBy("series_id", "k").agg(F.sum("y").alias("y"), F.sum("e").alias("e"))


def span(events: DataFrame, ts: str) -> DataFrame:
    """First and last time of a record and its length in days."""
    return events.agg(F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn(
        "days", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400_000_000.0
    )


def totals(series: DataFrame) -> DataFrame:
    cols = [c for c in series.columns if c not in ("series_id", "k")]
    return series.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("T"), *(F.sum(c).alias(c) for c in cols))


def weak_prior(series: DataFrame, weight: float = 1.0) -> DataFrame:
    """(series_id, alpha, beta): a Gamma prior worth ``weight`` events at each series' mean rate."""
    return series.groupBy("series_id").agg(F.sum("y").alias("y"), F.sum("e").alias("e")).select(
        "series_id", F.lit(float(weight)).alias("alpha"), (F.lit(float(weight)) / (F.greatest(F.col("y"), F.lit(0.5)) / F.col("e"))).alias("beta")
    )
