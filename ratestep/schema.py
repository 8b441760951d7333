"""Row types and checks. A check is a projection that raises; it runs where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_field = T.StructField
POISSON_SERIES = T.StructType([_field("series_id", T.StringType()), _field("k", T.IntegerType()), _field("y", T.DoubleType()), _field("e", T.DoubleType())])
BERNOULLI_SERIES = T.StructType([_field("series_id", T.StringType()), _field("k", T.IntegerType()), _field("s", T.DoubleType()), _field("g", T.DoubleType())])
TRIALS = T.StructType([_field("series_id", T.StringType()), _field("trial_id", T.StringType()), _field("t", T.IntegerType())])
GRID = T.StructType([_field("grid_id", T.StringType()), _field("r", T.IntegerType()), _field("c", T.IntegerType()), _field("y", T.DoubleType()), _field("e", T.DoubleType())])
TREE = T.StructType([_field("node", T.StringType()), _field("parent", T.StringType()), _field("exposure", T.DoubleType()), _field("y", T.DoubleType())])


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, raising ``message`` for the first row where ``condition`` does not hold."""
    probe = df.columns[0]
    return df.withColumn(probe, F.when(F.coalesce(condition, F.lit(False)), F.col(probe)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[probe].dataType)))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def checked_poisson(df: DataFrame) -> DataFrame:
    y, e = F.col("y").cast("double"), F.col("e").cast("double")
    df = require(df, _finite(y) & _finite(e) & (y >= 0) & (e >= 0), "counts and exposures must be finite and not negative")
    return require(df, (y == 0) | (e > 0), "events in an interval without exposure")


def checked_bernoulli(df: DataFrame) -> DataFrame:
    s, g = F.col("s").cast("double"), F.col("g").cast("double")
    return require(df, _finite(s) & _finite(g) & (s >= 0) & (g >= 0), "counts must be finite and not negative")


def checked(df: DataFrame) -> DataFrame:
    """A series table of either kind, by its columns."""
    return checked_bernoulli(df) if {"s", "g"} <= set(df.columns) else checked_poisson(df)
