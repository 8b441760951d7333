"""Queries without SQL read the whole axis of their table."""

import pytest
from pyspark.sql import functions as F

from ratestep import catalog


@pytest.mark.parametrize("name, operator", [("stream_dispersions", "dispersions"), ("stream_learnt_hazard", "replay_stream")])
def test_streams_read_all_hours(spark, sf, monkeypatch, name, operator):
    monkeypatch.setattr(catalog.live, operator, lambda rows, *a, **k: rows)
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows and all(len(r["x1"]) == 720 for r in rows)
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_type IS NOT NULL")
    assert sum(sum(r["x1"]) for r in rows) == events.where(F.col("ts") < "2024-01-31").count()


def test_grids_and_trials_read_all_rows(spark, sf):
    assert catalog.month_grids(spark, sf).agg(F.sum("y")).first()[0] == spark.read.parquet(f"{sf}/orders.parquet").count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    seen = events.select("user_id", F.date_trunc("hour", "ts")).distinct().count()
    assert catalog.spike_counts(spark, sf).agg(F.sum("s")).first()[0] == seen
    assert catalog.hourly(spark, sf).agg(F.sum("y")).first()[0] == events.where("event_type IS NOT NULL").count()


def test_grids_of_the_years(spark, sf):
    rates = catalog.two_level_rates(spark, sf).groupBy("grid_id").count().collect()
    first, last = spark.read.parquet(f"{sf}/orders.parquet").agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    assert sorted(r.grid_id for r in rates) == [str(y) for y in range(first, last + 1)]
    merged = catalog.merge_neighbours(spark, sf)
    assert merged.count() == catalog.month_grids(spark, sf).count() and merged.where("node IS NULL OR merged > node").count() == 0
    assert catalog.guillotine(spark, sf).where("isnan(log_evidence)").count() == 0 and catalog.month_grids(spark, sf).groupBy("grid_id").count().where("count <> 60").count() == 0
