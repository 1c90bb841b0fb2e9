"""Registered queries against their SQL on tables with large numbers and calls within a second."""

import duckdb
import pytest

from rillwise import plans


def both(spark, folder, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rows = lambda r: sorted(tuple(x) for x in r)
    query = plans.queries()[name](spark, str(folder))
    order = ", ".join(f'"{c}"' for c in query.columns)
    return rows(query.collect()), rows(db.execute(f"SELECT {order} FROM ({plans.oracle_sql()[name]})").fetchall())


def test_calls_of_one_second_are_one_observation(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id % 7 AS user_id, TIMESTAMP '2024-01-01' + to_milliseconds(event_id * 30) AS ts) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    got, want = both(spark, tmp_path, "T1_weather_stream", ["events"])
    assert got == want and len(got) < duckdb.sql(f"SELECT count(*) FROM '{tmp_path}/events.parquet'").fetchall()[0][0]


@pytest.mark.parametrize("shift", [0, 1_000_000 - 100])
def test_plots_whose_numbers_run_into_those_of_copies(spark, tmp_path, shift):
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + i * {shift} AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet', range(2) r(i) WHERE i = 0 OR {shift} > 0) TO '{tmp_path}/part.parquet'")
    got, want = both(spark, tmp_path, "S1_read_geojson", ["part"])
    assert got == want and len(got) == 4


@pytest.mark.parametrize("name", ["J17_dedupe_lines", "E9_merge_layers"])
def test_lines_whose_numbers_run_into_those_of_other_sheets(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + i * 999900 AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet', range(2) r(i)) TO '{tmp_path}/part.parquet'")
    got, want = both(spark, tmp_path, name, ["part"])
    assert got == want and len({r[0] for r in got}) < len(got)
