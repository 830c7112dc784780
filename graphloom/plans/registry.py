"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its oracle."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add


def scalar(name: str, table: str, key: str, given: str, function: Callable[[Column], Column], sql: str) -> None:
    """Register a scalar function over a table: key, input, output. ``given`` is an
    expression that both engines read; ``sql`` has {x} for it."""
    query(name, f"SELECT {key}, input, {sql.replace('{x}', 'input')} AS output FROM (SELECT {key}, {given} AS input FROM {table})")(
        lambda t: getattr(t, table).select(key, F.expr(given).alias("input")).select(key, "input", function(F.col("input")).alias("output"))
    )
