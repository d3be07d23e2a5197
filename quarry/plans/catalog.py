"""Query catalogue: every registered query takes (spark, sf_dir) and returns a
DataFrame over the whole provided tables; `sql` is the DuckDB oracle text
(views named after the parquet tables) or None when the operator is not
expressible in SQL (training, streaming, file round trips)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their @register calls run."""
    from quarry.plans import (  # noqa: F401
        q_drift,
        q_evaluate,
        q_features,
        q_io,
        q_profile,
        q_rules,
        q_split,
        q_train,
        q_serving,
        q_series,
        q_stream,
    )


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
