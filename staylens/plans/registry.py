"""Registry of named queries: a Spark plan and, where SQL can express it, a DuckDB oracle.

Every query reads the given tables (through the ``listings_raw`` fixture).
Results are compared order-insensitively; double columns listed in
``rounding`` are rounded on both sides so that last-bit differences between
engines (summation order, log1p vs ln(1 + x), interpolation formula) do not
count as mismatches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.plans.oracle_base import with_ctes


@dataclass
class Query:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rounding: dict = field(default_factory=dict)
    extra_ctes: str = ""


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, rounding: dict | None = None, extra: str = ""):
    def deco(fn):
        REGISTRY[key] = Query(key, fn, sql, dict(rounding or {}), extra)
        return fn
    return deco


def _quote(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def spark_query(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q.run(spark, sf_dir)
        if q.rounding:
            df = df.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in q.rounding.items()})
        return df
    run.__name__ = q.key
    return run


def oracle_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    inner = q.sql.strip()
    if q.rounding:
        rep = ", ".join(f"round({_quote(c)}, {d}) AS {_quote(c)}" for c, d in q.rounding.items())
        inner = f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS oracle_q"
    return with_ctes(inner, q.extra_ctes)


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from staylens.plans import q_sources, q_cleaning, q_features, q_models, q_metrics, q_explore  # noqa: F401
    return REGISTRY
