"""The queries of the general operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, rates
from . import carriers, evaluation, statistics, studies

Query = Callable[[SparkSession, str], DataFrame]
#: Decimals of the doubles in results and in their SQL.
DECIMALS = 6


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry features of every vector beside the rate of its category."""
    v = carriers.vectors(spark, sf_dir)
    by = v.groupBy("category").agg(F.avg("is_hallucinated").alias("category_rate"), F.count("*").alias("category_n"))
    return geometry.features(v).join(v.select("id", "category"), "id").join(F.broadcast(by), "category")


def _rounded(fn: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = fn(spark, d)
        return df.select(*[(F.round(F.nanvl(c, F.lit(None).cast("double")), DECIMALS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    return run


def _entries() -> dict[str, tuple[Query, str | None]]:
    return {**evaluation.ENTRIES, **statistics.ENTRIES, **studies.ENTRIES, "geometry_flagship": (flagship, None)}


def queries() -> dict[str, Query]:
    return {k: _rounded(q) for k, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    """Doubles are rounded like the results': COLUMNS picks them by type at run time."""
    out = {}
    for k, (_, sql) in _entries().items():
        if sql:
            doubles, body = sql
            out[k] = f"SELECT * REPLACE ({', '.join(f'round(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, {DECIMALS}) + 0.0 AS {c}' for c in doubles)}) FROM ({body}) AS q" if doubles else body
    return out


__all__ = ["flagship", "oracle_sql", "queries", "rates"]
