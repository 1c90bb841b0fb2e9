"""Queries by name, each with the SQL that it is compared with (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Tables are broadcast where the code says so, or where they were measured to be small: a file of a few MB can hold millions
#: of rows, and the driver, through which they would pass, can't hold what they are dealt to.
BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8MB"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k, v in BROADCAST.items():
                spark.conf.set(k, v)  # when the lazy result is planned they must still hold
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add
