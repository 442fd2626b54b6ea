"""Bootstrap and permutation over distributed cells.

Rows are reduced to cells of value and count. A replicate of a mean, of a rank
correlation or of a relabelling is drawn where the cells lie and only its sums
leave a task, so that the number of distinct values has no bound. Replicates of
the nested bootstrap are tasks over a broadcast table of checked size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .ranks import average_rank

REPLICATES_PER_TASK = 50
#: Rows of a table that is sent to every task of a nested bootstrap.
MAX_SENT = 2_000_000


def _sums(cells: DataFrame, draw, width: int) -> DataFrame:
    """``t, s0..``: per replicate, sums over the cells; ``draw(pdf, pid)`` gives a (replicates x width) matrix for one batch of cells."""
    schema = "t int, " + ", ".join(f"s{i} double" for i in range(width))

    def run(batches):
        total = None
        for n, pdf in enumerate(batches):
            part = draw(pdf, int(pdf["_p"].iloc[0]) * 1_000_003 + n if len(pdf) else 0)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"t": np.arange(len(total)), **{f"s{i}": total[:, i] for i in range(width)}})

    return cells.withColumn("_p", F.spark_partition_id()).mapInPandas(run, schema).groupBy("t").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def _interval(reps: DataFrame, value: Column, *probs: float) -> DataFrame:
    return reps.select(value.alias("m")).where("m is not null and not isnan(m)").agg(F.percentile("m", F.array(*[F.lit(p) for p in probs])).alias("q"))


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """estimate, low, high: mean and its 95 % percentile interval by the Poisson bootstrap; nulls without rows."""
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame, at: int) -> np.ndarray:
        rng, out = np.random.default_rng([seed, at]), np.zeros((replicates, 2))
        x, n = pdf.x.to_numpy(float), pdf.n.to_numpy(float)
        for i in range(0, replicates, 100):
            k = rng.poisson(n, (min(100, replicates - i), len(n)))
            out[i : i + 100] = np.c_[k @ x, k.sum(axis=1)]
        return out

    q = _interval(_sums(cells, draw, 2), F.try_divide("s0", "s1"), 0.025, 0.975)
    return cells.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("estimate")).crossJoin(q).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_spearman(df: DataFrame, x: str, y: str, fraction: float = 0.8, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """median, low, high of Spearman's rho over resamples of a fraction of the rows; under 10 rows nulls.

    Ranks are exact over all rows; a resample weighs each pair of ranks by a
    Poisson count of mean ``fraction``.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    r = average_rank(average_rank(d, x, out="_a"), y, out="_b").groupBy(F.col("_a").alias("x"), F.col("_b").alias("y")).agg(F.count("*").alias("n"))
    mid = r.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_mid"), F.sum("n").alias("_all"))
    cells = r.crossJoin(F.broadcast(mid)).where("_all >= 10").select((F.col("x") / F.col("_mid") - 1).alias("x"), (F.col("y") / F.col("_mid") - 1).alias("y"), "n")

    def draw(pdf: pd.DataFrame, at: int) -> np.ndarray:
        rng, out = np.random.default_rng([seed, at]), np.zeros((replicates, 6))
        a, b, n = pdf.x.to_numpy(float), pdf.y.to_numpy(float), pdf.n.to_numpy(float)
        terms = np.c_[np.ones_like(a), a, b, a * a, b * b, a * b]
        for i in range(0, replicates, 100):
            out[i : i + 100] = rng.poisson(fraction * n, (min(100, replicates - i), len(n))) @ terms
        return out

    s = [F.col(f"s{i}") for i in range(6)]
    rho = (s[5] - s[1] * s[2] / s[0]) / F.sqrt((s[3] - s[1] * s[1] / s[0]) * (s[4] - s[2] * s[2] / s[0]))
    q = _interval(_sums(cells, draw, 6).where("s0 > 0"), rho, 0.5, 0.025, 0.975)
    return q.select(F.col("q")[0].alias("median"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))


def permutation_difference(df: DataFrame, value: str, group: str, replicates: int = 10_000, seed: int = 2025) -> DataFrame:
    """Observed difference of group means and the share of relabellings with at least as large a one.

    A relabelling splits the first group's size over the partitions of the cells,
    and each share over the cells of its partition: hypergeometric draws throughout,
    so that together they are one draw over all cells.
    """
    spark = df.sparkSession
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(group).alias("k"))
    cells = Scratch(spark, "permutation").cut(cells.withColumn("part", F.spark_partition_id()))
    parts = cells.groupBy("part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("x") * F.col("n")).alias("xn"), F.sum(F.col("x") * F.col("k")).alias("xk")).orderBy("part").toPandas()
    n1, n = int(parts.k.sum()), int(parts.n.sum())
    if not n1 or n1 == n:
        return spark.createDataFrame([(None, None)], "difference double, p double")
    rng = np.random.default_rng(seed)
    shares = rng.multivariate_hypergeometric(parts.n.to_numpy(int), n1, size=replicates, method="marginals")
    sent = spark.sparkContext.broadcast({int(p): shares[:, i] for i, p in enumerate(parts.part)})

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        r, counts, x = np.random.default_rng([seed, part]), pdf.n.to_numpy(int), pdf.x.to_numpy(float)
        order = np.argsort(x)
        return pd.DataFrame({"t": np.arange(replicates), "s": [float(r.multivariate_hypergeometric(counts[order], int(k), method="marginals") @ x[order]) for k in sent.value[part]]})

    total, seen = float(parts.xn.sum()), float(parts.xk.sum() / n1 - (parts.xn.sum() - parts.xk.sum()) / (n - n1))
    reps = cells.groupBy("part").applyInPandas(draw, "t int, s double").groupBy("t").agg(F.sum("s").alias("s"))
    diff = F.col("s") / n1 - (F.lit(total) - F.col("s")) / (n - n1)
    return reps.agg(F.avg((F.abs(diff) >= abs(seen) - 1e-9 * max(1.0, abs(seen))).cast("double")).alias("p")).select(F.lit(seen).alias("difference"), "p")


def _checked(df: DataFrame) -> pd.DataFrame:
    """``df`` on the driver, if it has at most ``MAX_SENT`` rows; else an error."""
    rows = df.limit(MAX_SENT + 1).toPandas()
    if len(rows) > MAX_SENT:
        raise ValueError(f"more than {MAX_SENT} rows in a table that every task of the bootstrap needs")
    return rows


def _replicates(df: DataFrame, cells, one, replicates: int, seed: int, schema: str) -> DataFrame:
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(cells)
    tasks = -(-replicates // REPLICATES_PER_TASK)

    def run(batches):
        for pdf in batches:
            for t in pdf["id"]:
                rng = np.random.default_rng([seed, int(t)])
                n = min(REPLICATES_PER_TASK, replicates - int(t) * REPLICATES_PER_TASK)
                yield pd.DataFrame([one(sent.value, rng) for _ in range(n)], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(tasks, numPartitions=tasks).mapInPandas(run, schema)


def _inversions(y: np.ndarray, n: np.ndarray) -> int:
    """Pairs (each as often as its counts say) of a greater code before a smaller one; one stable pass per bit of the codes."""
    total = 0
    for bit in range(int(y.max()).bit_length() if len(y) else 0):
        at = np.argsort(y >> (bit + 1), kind="stable")
        head, one, w = y[at] >> (bit + 1), (y[at] >> bit & 1).astype(bool), n[at]
        ones = np.cumsum(np.where(one, w, 0))
        first = np.searchsorted(head, head[~one])
        before = np.where(first > 0, ones[first - 1], 0)
        total += int((w[~one] * (ones[~one] - before)).sum())
    return total


def tau_b(x: np.ndarray, y: np.ndarray, strata: list[np.ndarray]) -> float:
    """Tau-b over the pairs within each stratum (arrays of places), exactly and without a pair of rows: inversions of the sorted distinct cells."""
    if np.isnan(x).any() or np.isnan(y).any():
        return float("nan")
    pairs = lambda n: int((n * (n - 1) // 2).sum())
    num = dx = dy = 0
    for at in strata:
        (a, b), rows = (np.unique(v[at], return_inverse=True)[1] for v in (x, y)), len(at)
        if rows < 2:
            continue
        width = int(b.max()) + 1
        cell, n = np.unique(a.astype(np.int64) * width + b, return_counts=True)
        whole, tx, ty = rows * (rows - 1) // 2, pairs(np.bincount(a)), pairs(np.bincount(b))
        num += whole - tx - ty + pairs(n) - 2 * _inversions(cell % width, n)
        dx, dy = dx + whole - tx, dy + whole - ty
    return num / np.sqrt(float(dx) * float(dy)) if dx and dy else float("nan")


def nested_bootstrap_tau(pair: DataFrame, strata: str, x: str, kx: str, y: str, ky: str, replicates: int = 500, seed: int = 1) -> DataFrame:
    """mean, low, high of blocked tau-b: prompts are drawn within their stratum, then both models' counts within the prompt.

    Tasks are sent the distinct prompts with their counts.
    """
    cells = _checked(pair.groupBy(F.col(strata).alias("s"), F.col(x).alias("x"), F.col(kx).cast("int").alias("kx"), F.col(y).alias("y"), F.col(ky).cast("int").alias("ky")).agg(F.count("*").alias("n")).orderBy("s", "x", "y", "kx", "ky"))
    groups = [g.index.to_numpy() for _, g in cells.groupby("s")]
    data = (groups, *(cells[c].to_numpy() for c in ("x", "kx", "y", "ky", "n")))

    def one(d, rng):
        parts, vx, nx, vy, ny, n = d
        drawn = [rng.choice(np.repeat(g, n[g]), int(n[g].sum())) for g in parts]
        at = np.concatenate(drawn) if drawn else np.zeros(0, int)
        ends = np.cumsum([len(g) for g in drawn])
        places = [np.arange(e - len(g), e) for g, e in zip(drawn, ends)]
        return (tau_b(rng.binomial(nx[at], vx[at]) / nx[at], rng.binomial(ny[at], vy[at]) / ny[at], places),)

    reps = _replicates(pair, data, one, replicates, seed, "m double").where("not isnan(m)")
    return reps.agg(F.avg("m").alias("mean"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def nested_bootstrap(per: DataFrame, strata: str, k: str, p: str, replicates: int = 500, seed: int = 1) -> DataFrame:
    """Two levels: prompts within stratum, then binomial counts within prompt; interval of the mean rate."""
    cells = per.groupBy(F.col(strata).alias("s"), F.col(k).cast("int").alias("k"), F.col(p).alias("p")).agg(F.count("*").alias("n")).orderBy("s", "k", "p")
    cells = _checked(cells)
    parts = [g for _, g in cells.groupby("s")]

    def one(_, rng):
        tot = rate = 0.0
        for g in parts:
            n = g.n.to_numpy()
            draw = rng.multinomial(n.sum(), n / n.sum())
            for c, kk, pp in zip(draw, g.k.to_numpy(), g.p.to_numpy()):
                if c and kk:
                    rate += rng.binomial(kk, pp, c).sum() / kk
            tot += n.sum()
        return (float(rate / tot),)

    reps = _replicates(per, cells, one, replicates, seed, "m double")
    return reps.agg(F.avg("m").alias("mean"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
