"""Where the query modules put what they define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def query(sql: str | None = None, name: str | None = None):
    """Decorator form of `register`."""

    def add(run):
        register(name or run.__name__, run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL both engines understand: the order key as text, padded to n digits.
def key_digits(n: int, column: str = "o_orderkey") -> str:
    return f"lpad(cast({column} % {10 ** n} as string), {n}, '0')"


from maskframe.catalog import files, guards, masks, rules, streams, tables, tokens  # noqa: E402, F401
