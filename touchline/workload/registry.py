"""Registry of named queries and, where SQL can express them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.workload.sqltext import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query; ``oracle`` is SQL over the shared named views it mentions."""

    def wrap(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return wrap


def r6(value) -> Column:
    """Round to six decimals; half-way values (up to float noise) go up, as in the oracle."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.floor(x * 1e6 + 0.5001) / 1e6


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def oracles() -> dict[str, str]:
    """Oracle text per key with the shared views it needs."""
    return {key: compose(sql) for key, sql in ORACLES.items()}
