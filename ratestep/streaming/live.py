"""Structured Streaming: closed intervals of an event stream, and stateful models that answer for each of them.

Events are counted in event time under a watermark; an interval is final when the watermark passes its end, later events are
dropped. A stateful processor per series counts events until then and takes final intervals in order; the gap before an
interval with events is filled with empty ones. Answers equal those of a replay of the same counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ratestep.functions.live import OnlineBinning
from ratestep.operators.live import ANSWERS, answer, stream_of
from ratestep.runtime import ensure_importable


def closed_counts(events: DataFrame, series: Column, ts: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(series_id, start, y) of every window with events; in append mode a row appears once its window is final."""
    timed = events.select(series.cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"))
    win = timed.withWatermark("ts", lateness).groupBy("series_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return win.select("series_id", F.col("w.start").alias("start"), "y")


def sliding_counts(events: DataFrame, series: Column, ts: str, width: str, slide: str, lateness: str = "10 minutes") -> DataFrame:
    timed = events.select(series.cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"))
    win = timed.withWatermark("ts", lateness).groupBy("series_id", F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return win.select("series_id", F.col("w.start").alias("start"), "y")


def session_counts(events: DataFrame, series: Column, ts: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    timed = events.select(series.cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"))
    win = timed.withWatermark("ts", lateness).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return win.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "y")


def timed(events: DataFrame, series: Column, ts: str, *, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """(series_id, ts, n): events with a watermark and the number of their interval, counted from the epoch."""
    rows = events.select(series.cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return rows.withColumn("n", F.floor(F.unix_timestamp("ts") / seconds).cast("long"))


def _closed(frames: Iterator[pd.DataFrame], state: GroupState, pending: dict[int, float], last: int | None, seconds: int) -> list[tuple[int, float]]:
    """Adds events to ``pending`` and takes from it what the watermark has closed, with empty intervals in gaps; sets the next timer."""
    for f in frames:
        for n, c in f.groupby("n").size().items():
            if last is None or n > last:
                pending[int(n)] = pending.get(int(n), 0.0) + float(c)
    mark = state.getCurrentWatermarkMs()
    out = []
    for n in sorted(n for n in pending if (n + 1) * seconds * 1000 <= mark):
        out += [(i, 0.0) for i in range(n if last is None else last + 1, n)] + [(n, pending.pop(n))]
        last = n
    if pending:
        state.setTimeoutTimestamp(max((min(pending) + 1) * seconds * 1000, mark + 1))
    return out


def watch(rows: DataFrame, kind: str, prior: tuple[float, float], *, seconds: int = 3600, within: int = 3, u: float = 0.5, **options) -> DataFrame:
    """Change-point answers for every closed interval of every series of ``timed`` events, with state in the state store.

    Columns: series_id, n, y, and those of a replay. Events are counted in the state until the watermark has passed the end of
    their interval; later ones are dropped. The prior must be given: one chosen from all data would not be known yet. A
    series begins with its first event; gaps count as empty intervals of full exposure.
    """
    ensure_importable(rows.sparkSession)
    lag = options.get("lag")
    shape = "series_id string, n long, y double, " + ANSWERS
    names = [c.split()[0] for c in shape.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, last, k, pending = pickle.loads(state.get[0]) if state.exists else (stream_of(kind, prior, options), None, 0, {})
        out = []
        for n, y in _closed(frames, state, pending, last, seconds):
            out.append({"series_id": key[0], "n": n, "y": y, **answer(model, k, y, 1.0, u, within, lag)})
            last, k = n, k + 1
        state.update((pickle.dumps((model, last, k, pending)),))
        yield pd.DataFrame(out, columns=names).astype({"p_at_lag": float})

    return rows.select("series_id", "ts", "n").groupBy("series_id").applyInPandasWithState(step, shape, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def watch_binning(rows: DataFrame, prior: tuple[float, float], max_boundaries: int = 10, *, seconds: int = 3600) -> DataFrame:
    """The exact posterior of the whole series so far, for every closed interval: (series_id, n, y, log_marginal, m_map, rate, rate_std).

    State grows with the series; for endless ones use ``watch``.
    """
    ensure_importable(rows.sparkSession)
    shape = "series_id string, n long, y double, log_marginal double, m_map int, rate double, rate_std double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, last, pending = pickle.loads(state.get[0]) if state.exists else (OnlineBinning("poisson", prior, max_boundaries), None, {})
        out = []
        for n, y in _closed(frames, state, pending, last, seconds):
            model.update(y)
            out.append((key[0], n, y, model.log_marginal, model.m_map, *model.rate_now()))
            last = n
        state.update((pickle.dumps((model, last, pending)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    return rows.select("series_id", "ts", "n").groupBy("series_id").applyInPandasWithState(step, shape, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
