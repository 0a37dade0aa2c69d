"""Registered queries: a function of (spark, folder), and the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounds: str = "", digits: int = 6):
    """Register a query.  The columns of ``rounds`` are rounded on both sides; adding 0.0 makes a negative zero a plain one."""
    names = rounds.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names}) if names else df

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return add
