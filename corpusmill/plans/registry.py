"""Where queries register, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.fixtures import Inputs, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of ``Inputs`` under its name; ``oracle`` may use the views by their names."""

    def put(f: Callable[[Inputs], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[key] = duck(oracle)
        return f

    return put
