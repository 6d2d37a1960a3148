"""Where queries and the SQL that each must equal are entered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Enter a query under its name; without SQL it is held against brute force in the tests."""

    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"two queries are called {fn.__name__}")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
