"""Named queries with their SQL twins."""

from __future__ import annotations

from inkspan.session import tune

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the DuckDB statement that must agree."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
