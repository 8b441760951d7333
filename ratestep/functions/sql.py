"""The SQL surface: scalar functions, an aggregate, and a table function over a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ratestep.functions import segments, special
from ratestep.runtime import ensure_importable

_ONE = {"lgamma": special.lgamma, "digamma": special.digamma}
_TWO = {"betaln": special.betaln, "gammainc": special.gammainc, "gammaincc": special.gammaincc, "xlogy": special.xlogy, "log_binom": special.log_binom, "log_add": special.log_add}
_THREE = {"betainc": special.betainc, "betaincc": special.betaincc}


def _scalar(f, n: int):
    if n == 1:

        def call(a: pd.Series) -> pd.Series:
            return pd.Series(np.atleast_1d(f(a.to_numpy(dtype=float))))
    elif n == 2:

        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(np.atleast_1d(f(a.to_numpy(dtype=float), b.to_numpy(dtype=float))))
    else:

        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(np.atleast_1d(f(a.to_numpy(dtype=float), b.to_numpy(dtype=float), c.to_numpy(dtype=float))))

    return F.pandas_udf(call, DoubleType())


def _logsumexp(x: pd.Series) -> float:
    v = x.to_numpy(dtype=float)
    return float(special.logsumexp(v)) if len(v) else float("-inf")


class BinFit:
    """``SELECT * FROM bin_fit(TABLE(series), max_boundaries)``: rates of every series of a table with series_id, k, and y, e or s, g.

    The table is partitioned by series_id and ordered by k. Poisson series get a prior worth one event at their mean rate,
    Bernoulli ones Beta(1, 32).
    """

    @staticmethod
    def analyze(table, max_boundaries) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields]
        if not {"series_id", "k"} <= set(names) or not ({"y"} <= set(names) or {"s", "g"} <= set(names)):
            raise ValueError("the table needs series_id, k, and y (with e on demand) or s and g")
        schema = StructType().add("series_id", "string").add("k", IntegerType()).add("rate", DoubleType()).add("rate_std", DoubleType()).add("p_boundary", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("series_id")], orderBy=[OrderingColumn("k")])

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.m = 10

    def eval(self, row: Row, max_boundaries: int) -> None:
        d = row.asDict()
        self.m = max_boundaries
        self.kind = "bernoulli" if "s" in d else "poisson"
        self.rows.append((d["series_id"], d["k"], d["s"], d["g"]) if self.kind == "bernoulli" else (d["series_id"], d["k"], d["y"], d.get("e", 1.0)))

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        x1, x2 = (np.array([r[i] for r in self.rows], dtype=float) for i in (2, 3))
        model = segments.Bernoulli(x1, x2) if self.kind == "bernoulli" else segments.Poisson.weak_prior(x1, x2)
        f = segments.fit(model, self.m)
        for i, r in enumerate(self.rows):
            yield str(r[0]), int(r[1]), float(f.rate[i]), float(f.rate_std[i]), float(f.boundary_posterior[i]) if i < len(self.rows) - 1 else None


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: lgamma, digamma, betaln, betainc, betaincc, gammainc, gammaincc, xlogy, log_binom, log_add, logsumexp, bin_fit."""
    ensure_importable(spark)
    for n, group in ((1, _ONE), (2, _TWO), (3, _THREE)):
        for name, f in group.items():
            spark.udf.register(name, _scalar(f, n))
    spark.udf.register("logsumexp", F.pandas_udf(_logsumexp, DoubleType()))
    spark.udtf.register("bin_fit", F.udtf(BinFit))
