"""Registered queries against their SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rillwise import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if x is None or x is pd.NaT or x is pd.NA or x != x else repr(float(x)) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else str(x) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, db, name):
    got = normal(plans.queries()[name](spark, SF).toPandas())
    want = normal(db.execute(plans.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)
