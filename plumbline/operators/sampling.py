"""Deterministic sampling: order by a hash of seed and key, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def uniform(*parts: Column | str | int) -> Column:
    """u in [0, 1) from the md5 of the parts joined by ~."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("~", *[c.cast("string") for c in cols]).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _order(key: str, seed: str | int) -> list[Column]:
    return [uniform(seed, F.col(key)), F.col(key)]


def _numbered(df: DataFrame, strata: list[str], key: str, seed: str | int | None = None) -> DataFrame:
    """``df`` with ``_d``, the place of a row in its stratum, counted by ranges so that no task holds a whole stratum."""
    order = [F.col(key).asc()] if seed is None else [o.asc() for o in _order(key, seed)]
    return running(df.withColumn("_1", F.lit(1)), order, {"_d": "_1"}, *strata).drop("_1")


def per_stratum(df: DataFrame, stratum: str, key: str, n: Column | int, seed: str | int | None = None) -> DataFrame:
    """The first ``n`` rows of each stratum by key (no seed) or by hash."""
    return _numbered(df, [stratum], key, seed).where(F.col("_d") <= n).drop("_d")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: str | int | None = None) -> DataFrame:
    """Depth-major over sorted strata until ``n`` rows: a depth of at most n rows per stratum, then one small sort."""
    return _numbered(df, [stratum], key, seed).withColumnRenamed("_d", "depth").where(F.col("depth") <= n).orderBy("depth", stratum).limit(n)


def proportional(df: DataFrame, stratum: str, key: str, n: int, seed: str | int) -> DataFrame:
    """max(1, half-even round of n x share) rows per stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.col("_n") / F.col("_t") * n, 0).cast("int")).alias("_q"))
    return per_stratum(df.join(F.broadcast(quota), stratum), stratum, key, F.col("_q"), seed).drop("_q")


def stratified_weights(df: DataFrame, strata: list[str], key: str, n: int, seed: str | int) -> DataFrame:
    """``n`` rows of each cell by hash, weighted by cell population over cell sample."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("cell_population"))
    d = _numbered(df, strata, key, seed).where(F.col("_d") <= n).join(F.broadcast(sizes), strata)
    return d.withColumn("cell_sampled", F.least(F.col("cell_population"), F.lit(n))).withColumn("weight", F.col("cell_population") / F.col("cell_sampled")).drop("_d")


def groups_sample(df: DataFrame, stratum: str, group: str, n: int, seed: str | int) -> DataFrame:
    """All rows of the first ``n`` groups of each stratum by hash."""
    g = df.select(stratum, group).where(F.col(group).isNotNull()).distinct()
    return df.join(per_stratum(g, stratum, group, n, seed), [stratum, group], "left_semi")


def split3(df: DataFrame, stratum: str, key: str, seed: str | int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``df`` with ``part``: per stratum the first rows by hash train, then validation, then test."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    r = (F.col("_d") - 1) / F.col("_n")
    d = _numbered(df, [stratum], key, seed).join(F.broadcast(sizes), stratum)
    return d.withColumn("part", F.when(r < train, "train").when(r < train + validation, "validation").otherwise("test")).select(*df.columns, "part")


def apportion(weights: dict[str, float], capacity: dict[str, int], n: int) -> dict[str, int]:
    """Largest remainders within capacities: floors first, then the largest remainders by name on ties. Driver-side, one entry per category."""
    total = sum(weights.values()) or 1.0
    exact = {k: n * w / total for k, w in weights.items()}
    out = {k: min(int(x), capacity[k]) for k, x in exact.items()}
    while sum(out.values()) < min(n, sum(capacity.values())):
        k = max((k for k in out if out[k] < capacity[k]), key=lambda k: (exact[k] - out[k], k))
        out[k] += 1
    return out


def last_remainder(df: DataFrame, stratum: str, key: str, n: int, seed: str | int) -> DataFrame:
    """floor(n x share) rows per stratum; the last stratum by name takes what is left of ``n``. Sizes are one row per stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    last = sizes.agg(F.max(stratum).alias("_last"), F.sum("_n").alias("_t"))
    q = sizes.crossJoin(F.broadcast(last)).withColumn("_f", F.floor(F.lit(float(n)) * F.col("_n") / F.col("_t")))
    others = q.agg(F.coalesce(F.sum(F.when(F.col(stratum) != F.col("_last"), F.col("_f"))), F.lit(0)).alias("_o"))
    quota = q.crossJoin(F.broadcast(others)).select(stratum, F.when(F.col(stratum) == F.col("_last"), F.lit(n) - F.col("_o")).otherwise(F.col("_f")).alias("_q"))
    return per_stratum(df.join(F.broadcast(quota), stratum), stratum, key, F.col("_q"), seed).drop("_q")


def verify_sample(df: DataFrame, source: str, failing: Column, key: str, n: int, seed: str | int) -> DataFrame:
    """Per source half of ``n`` rows that fail and half that don't, as far as there are any."""
    d = df.withColumn("failing", failing)
    w = Window.partitionBy(source, "failing").orderBy(*_order(key, seed))
    return d.withColumn("_d", F.row_number().over(w)).where(F.col("_d") <= n // 2).select(key, source, "failing")
