"""Registry of queries: a Spark plan and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet.plans.bind import CTES
from filamet.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a plan; ``ctes`` names the shared table bindings its SQL starts from."""

    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = wraps(fn)(lambda spark, sf: (tune(spark), fn(spark, sf))[1])
        if sql is not None:
            body = sql.strip()
            # bindings are read more than once: computed once
            shared = ", ".join(f"{c} AS MATERIALIZED ({CTES[c]})" for c in ctes)
            if not shared:
                SQL[name] = body
            elif body.upper().startswith("WITH RECURSIVE"):
                SQL[name] = f"WITH RECURSIVE {shared}, {body[14:]}"
            elif body.upper().startswith("WITH"):
                SQL[name] = f"WITH {shared}, {body[4:]}"
            else:
                SQL[name] = f"WITH {shared} {body}"
        return fn

    return add


def r(col: Column | str, digits: int = 6) -> Column:
    """Round for comparing engines; adding zero turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)
