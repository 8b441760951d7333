import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratestep.functions.live import ChangePointStream, OnlineBinning
from ratestep.streaming import live, pooled

T0 = dt.datetime(2024, 1, 1)


def events(spark, folder, hours, counts, late=()):
    rows = [("a", T0 + dt.timedelta(hours=h, seconds=i)) for h, n in zip(hours, counts, strict=True) for i in range(n)]
    rows += [("a", T0 + dt.timedelta(hours=h)) for h in late]
    spark.createDataFrame(rows, "series_id string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def run(df, path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def source(spark, folder):
    return spark.readStream.schema("series_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_replay_with_gaps_and_late_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    counts = [3, 1, 0, 4, 9, 8, 10, 2]
    events(spark, folder, range(4), counts[:4])
    events(spark, folder, range(4, 8), counts[4:])
    events(spark, folder, [30], [1], late=[0, 1])
    rows = live.timed(source(spark, folder), F.col("series_id"), "ts")
    run(live.watch(rows, "poisson", (1.0, 0.5), expected_run_length=10.0, lag=2), tmp_path, "watched")
    got = spark.table("watched").orderBy("n").toPandas()
    assert got.y.tolist() == counts and got.k.tolist() == list(range(8))
    s = ChangePointStream.poisson(1.0, 0.5, 10.0, lag=2)
    for y, row in zip(counts, got.itertuples(), strict=True):
        assert row.pit == pytest.approx(s.pit(y, u=0.5))
        s.update(y)
        assert (row.rate, row.rate_std) == pytest.approx(s.rate_now()) and row.log_marginal == pytest.approx(s.log_marginal)


def test_restart_from_a_checkpoint(spark, tmp_path):
    folder = str(tmp_path / "in")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def go():
        rows = live.timed(source(spark, folder), F.col("series_id"), "ts")
        q = live.watch_binning(rows, (1.0, 0.5), 4).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    events(spark, folder, range(4), [2, 3, 2, 9])
    go()
    events(spark, folder, range(4, 8), [8, 9, 1, 1])
    go()
    events(spark, folder, [40], [1])
    go()
    got = spark.read.parquet(out).orderBy("n").toPandas()
    o = OnlineBinning.poisson(1.0, 0.5, 4)
    assert got.y.tolist()[:8] == [2, 3, 2, 9, 8, 9, 1, 1]
    for row in got.iloc[:8].itertuples():
        o.update(row.y)
        assert row.log_marginal == pytest.approx(o.log_marginal) and row.rate == pytest.approx(o.rate_now()[0])


def test_sliding_and_session_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, folder, range(6), [1, 2, 3, 0, 0, 1])
    events(spark, folder, [50], [1])
    run(live.sliding_counts(source(spark, folder), F.col("series_id"), "ts", "2 hours", "1 hour"), tmp_path, "slid")
    got = {(r.start - T0).total_seconds() / 3600: r.y for r in spark.table("slid").collect()}
    assert got[0] == 3 and got[1] == 5 and got[-1] == 1
    run(live.session_counts(source(spark, folder), F.col("series_id"), "ts", "90 minutes"), tmp_path, "sessions")
    assert sorted(r.y for r in spark.table("sessions").collect())[-1] == 6
    run(live.closed_counts(source(spark, folder), F.col("series_id"), "ts"), tmp_path, "hours")
    assert sorted(r.y for r in spark.table("hours").collect()) == [1, 1, 2, 3]


def test_pooled_tree_replay(spark):
    parents = {"root": None, "x": "root", "y": "root"} | {f"{p}{i}": p for p in "xy" for i in range(3)}
    rng = np.random.default_rng(0)
    exposure = {k: 1.0 for k in parents if len(k) == 2}
    rows = [("t", n, leaf, float(rng.poisson(0.3 if leaf[0] == "x" else 2.0))) for n in range(40) for leaf in exposure]
    df = spark.createDataFrame(rows, "tree string, n long, leaf string, y double")
    out = pooled.replay_pooled(df, parents, exposure, (1.0, 1.0), 1000.0).toPandas()
    assert len(out) == 240 and np.isfinite(out.pooled).all()
    assert out.pooled.sum() > out.alone.sum()
    t = pooled.PooledTree(parents, exposure, (1.0, 1.0), 100.0, half_life=5)
    assert sum(t.weights("x0").values()) == pytest.approx(1)
    assert np.exp([x[3] for x in [t.step({"x0": 2.0})[0]]])[0] <= 1


def test_an_interval_in_two_batches_is_whole(spark, tmp_path):
    """Leaves of one hour come in different micro-batches; the answers are those of a replay of the whole counts."""
    parents, exposure = {"root": None, "a": "root", "b": "root"}, {"a": 1.0, "b": 2.0}
    folder = str(tmp_path / "in")
    counts = [(n, leaf, float((3 * n + len(leaf) + (leaf == "b")) % 5)) for n in range(6) for leaf in "ab"]
    at = lambda n: T0 + dt.timedelta(hours=n, minutes=5)
    table = lambda part: spark.createDataFrame([("t", at(n), leaf, y) for n, leaf, y in part], "tree string, ts timestamp, leaf string, y double")
    parts = [counts[:3], counts[3:7], counts[7:], [(20, "a", 1.0)], [(0, "a", 7.0), (30, "a", 1.0)], [(40, "a", 1.0)], [(50, "a", 1.0)]]
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for part in parts:
        table(part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("tree string, ts timestamp, leaf string, y double").parquet(folder).withWatermark("ts", "10 minutes")
        watched = pooled.watch_pooled(stream, parents, exposure, (1.0, 1.0), 50.0)
        watched.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).toPandas()
    got["n"] -= got["n"].min()
    want = pooled.replay_pooled(spark.createDataFrame([("t", *c) for c in [*counts, (20, "a", 1.0)]], "tree string, n long, leaf string, y double"), parents, exposure, (1.0, 1.0), 50.0).toPandas()
    got = got[got.n <= 20].sort_values(["n", "leaf"]).reset_index(drop=True)
    want = want.sort_values(["n", "leaf"]).reset_index(drop=True)
    assert got.y.tolist() == want.y.tolist() and np.allclose(got.pooled, want.pooled) and np.allclose(got.alone, want.alone)
