"""All queries of the library against their SQL, on the smallest data."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ratestep import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    got, want = ordered(catalog.QUERIES[name](spark, sf).toPandas()), ordered(con.execute(catalog.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=1e-9, atol=2e-6, equal_nan=True), c
        elif "datetime" not in str(got[c].dtype):
            assert (got[c].str[:19] == want[c].str[:19]).all(), c


def test_virtual_events_equal_sql_at_large_counts(spark, tmp_path):
    """About 20,000 events a day; every digit that the query returns."""
    path, con = f"{tmp_path}/events.parquet", duckdb.connect()
    day = "pmod(hash(id), 30) + IF(pmod(id, 97) = 0, 30, 0) / 4"
    spark.range(600_000).selectExpr("'a' AS event_type", f"timestamp_ntz'2024-01-01' + make_dt_interval(cast({day} AS int)) AS ts").coalesce(1).write.parquet(path)
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    got, want = ordered(catalog.virtual_events(spark, str(tmp_path)).toPandas()), ordered(con.execute(catalog.ORACLE["virtual_events"]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) == 30
    got, want = got.sort_values("k"), want.sort_values("k")
    for c, digit in (("k", 0), ("rate", 1e-6), ("rate_std", 1e-4)):
        assert np.allclose(got[c].to_numpy(), want[c].to_numpy(), rtol=0, atol=1.01 * digit), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry_works_without_the_optional_part(spark, sf):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 150
