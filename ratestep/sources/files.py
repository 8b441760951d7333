"""Files: trial texts, event folders, result tables, and cells of a quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trials(spark: SparkSession, path: str, *, series_id: str | None = None) -> DataFrame:
    """(series_id, trial_id, t) from text files with a trial a line: a name, then event times, apart by blanks.

    ``series_id`` defaults to the name. Blank lines are no trials; a name alone is a trial without events and has one row
    with a null t.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.trim(F.translate("value", "\t\r", "  ")).alias("v"))
    lines = lines.where("v != ''").select("f", F.monotonically_increasing_id().alias("n"), F.split("v", " +").alias("w"))
    name = F.lit(series_id) if series_id is not None else F.col("w")[0]
    trial = F.concat_ws("#", F.element_at(F.split("f", "/"), -1), F.lpad(F.col("n").cast("string"), 20, "0"))
    return lines.select(name.alias("series_id"), trial.alias("trial_id"), F.explode_outer(F.transform(F.slice("w", F.lit(2), F.size("w")), lambda x: x.cast("int"))).alias("t"))


def write_trials(trials: DataFrame, path: str) -> None:
    """The reverse of ``read_trials``."""
    by = trials.groupBy("series_id", "trial_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    by.select(F.concat_ws(" ", F.col("series_id"), F.array_join("t", " ")).alias("value")).write.text(path)


def read_events(spark: SparkSession, path: str, *, time: str = "time", lat: str = "latitude", lng: str = "longitude", level: int = 8) -> DataFrame:
    """(ts, cell, n) of a folder of CSV files with a header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.to_timestamp(time).alias("ts"), quad_cell(F.col(lat).cast("double"), F.col(lng).cast("double"), level).alias("cell"), F.lit(1.0).alias("n"))


def read_bins(spark: SparkSession, path: str, stream_id: str) -> DataFrame:
    """Counts of one stream from a Parquet folder; the predicate reaches the scan."""
    return spark.read.parquet(path).where(F.col("stream_id") == stream_id).select("cell", "bin_start", "n")


def quad_cell(lat: Column, lng: Column, level: int) -> Column:
    """A quadtree cell as a string of ``level`` digits 0 to 3; a parent is a prefix."""
    side = 1 << level
    x = F.least(F.floor((lng + 180) / 360 * side), F.lit(side - 1))
    y = F.least(F.floor((lat + 90) / 180 * side), F.lit(side - 1))
    digit = lambda i: F.pmod(F.floor(x / (1 << i)), F.lit(2)) + 2 * F.pmod(F.floor(y / (1 << i)), F.lit(2))
    return F.concat(*(digit(i).cast("string") for i in range(level - 1, -1, -1))) if level else F.lit("")


def coarsen(cell: Column, level: int) -> Column:
    """The ancestor of a cell at ``level``."""
    return F.substring(cell, 1, level)


def write_rates(rates: DataFrame, path: str, *, offset: int = 0, spread: bool = True, fano: bool = False) -> None:
    """A text table for each run: interval, rate, and on demand rate + sd, rate - sd and the Fano factor of single intervals."""
    cols = [F.col("k") + offset, F.col("rate")]
    cols += [F.col("rate") + F.col("rate_std"), F.col("rate") - F.col("rate_std")] if spread else []
    cols += [1 - F.col("rate")] if fano else []
    line = F.concat_ws("\t", F.col("series_id"), *(c.cast("string") for c in cols))
    rates.repartitionByRange("series_id", "k").sortWithinPartitions("series_id", "k").select(line.alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON, CSV or Parquet."""
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(path)
