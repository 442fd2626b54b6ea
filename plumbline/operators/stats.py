"""Correlation, stratified association, contingency and error-rate statistics. Undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_rank

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of k out of n, clamped to [0, 1]; null for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, r, n for each pair, over rows with both, in one pass."""
    one = df.agg(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(pairs))])).alias("c")).select("c.*")


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson correlation of average ranks; fewer than 10 rows have none."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    r = average_rank(average_rank(d, a, *by, out="_ra"), b, *by, out="_rb")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho")).withColumn("rho", F.when(F.col("n") >= 10, F.col("rho")))


def pairwise_binary(df: DataFrame, item: str, by: str, value: str) -> DataFrame:
    """Kendall tau-b (for 0/1 values Pearson's r) of every pair of ``by`` over shared items, diagonal included."""
    d = df.select(item, by, value)
    j = d.select(item, F.col(by).alias("a"), F.col(value).alias("x")).join(d.select(item, F.col(by).alias("b"), F.col(value).alias("y")), item)
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("tau"))


def tau_summary(m: DataFrame) -> DataFrame:
    """Mean, median, extremes and population deviation of the upper triangle."""
    return m.where("a < b").agg(F.avg("tau").alias("mean"), F.median("tau").alias("median"), F.min("tau").alias("min"), F.max("tau").alias("max"), F.stddev_pop("tau").alias("std"))


def tau_parts(df: DataFrame, x: str, y: str, stratum: str) -> DataFrame:
    """Per stratum: n, pairs, concordant minus discordant, pairs untied in x and in y.

    Pairs are formed between distinct (x, y) cells with their counts, exactly and
    without a pair of rows; rates of k samples have at most (k+1)^2 cells.
    """
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(stratum).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    o = c.select("s", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    j = c.join(o, "s").where("x < x2 or (x = x2 and y < y2)")
    w = F.col("n") * F.col("n2")
    p = j.groupBy("s").agg(
        F.sum(w * F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2"))).alias("num"),
        F.sum(F.when(F.col("x") != F.col("x2"), w).otherwise(0)).alias("dx"), F.sum(F.when(F.col("y") != F.col("y2"), w).otherwise(0)).alias("dy"),
    )
    n = c.groupBy("s").agg(F.sum("n").alias("n")).where("n >= 2")
    return n.join(p, "s", "left").select("s", "n", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in ("num", "dx", "dy")])


def tau_blocked(df: DataFrame, x: str, y: str, stratum: str) -> DataFrame:
    """Tau-b over within-stratum pairs: n, pairs, tau, the largest reachable tau, tied share."""
    g = tau_parts(df, x, y, stratum).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in ("pairs", "num", "dx", "dy")])
    d = F.sqrt(F.col("dx") * F.col("dy"))
    return g.select(
        "n", "pairs", F.when(d > 0, F.col("num") / d).alias("tau"), F.when(d > 0, F.sqrt(F.least("dx", "dy") / F.greatest("dx", "dy"))).alias("ceiling"),
        F.try_divide(F.col("pairs") - F.col("dx"), F.col("pairs")).alias("tied_x"), F.try_divide(F.col("pairs") - F.col("dy"), F.col("pairs")).alias("tied_y"),
    )


def spearman_blocked(df: DataFrame, x: str, y: str, stratum: str) -> DataFrame:
    """Average ranks within strata, centred there, then one pooled cosine."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(stratum, x, y)
    r = average_rank(average_rank(d, x, stratum, out="rx"), y, stratum, out="ry")
    m = r.groupBy(stratum).agg(F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.count("*").alias("m"))
    c = r.join(m, stratum).where("m >= 2").select((F.col("rx") - F.col("mx")).alias("a"), (F.col("ry") - F.col("my")).alias("b"))
    g = c.agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return g.select("n", F.when(F.col("aa") * F.col("bb") > 0, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def spearman_brown(r: Column) -> Column:
    return F.when(r > -1, 2 * r / (1 + r))


def disattenuate(r: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), r / F.sqrt(a * b))


def residualise(df: DataFrame, y: str, z: str, stratum: str) -> DataFrame:
    """``df`` with ``residual``: both demeaned per stratum, one pooled slope removed."""
    m = df.groupBy(stratum).agg(F.avg(y).alias("_my"), F.avg(z).alias("_mz"))
    c = df.join(m, stratum).withColumn("_y", F.col(y) - F.col("_my")).withColumn("_z", F.col(z) - F.col("_mz"))
    s = c.agg(F.try_divide(F.sum(F.col("_y") * F.col("_z")), F.sum(F.col("_z") * F.col("_z"))).alias("slope"))
    return c.crossJoin(F.broadcast(s)).withColumn("residual", F.col("_y") - F.coalesce("slope", F.lit(0.0)) * F.col("_z")).drop("_my", "_mz", "_y", "_z", "slope")


def cmh(tables: DataFrame) -> DataFrame:
    """Cochran-Mantel-Haenszel over 2x2 tables (a, b, c, d): statistic with continuity correction, common odds ratio, tables used."""
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    n, r1, r2, c1, c2 = a + b + c + d, a + b, c + d, a + c, b + d
    t = tables.where((r1 > 0) & (r2 > 0) & (c1 > 0) & (c2 > 0) & (n > 1))
    g = t.agg(F.count("*").alias("tables"), F.sum(a - r1 * c1 / n).alias("diff"), F.sum(r1 * r2 * c1 * c2 / (n * n * (n - 1))).alias("var"), F.sum(a * d / n).alias("up"), F.sum(b * c / n).alias("down"))
    dd = F.abs("diff") - 0.5
    return g.select("tables", F.when(F.col("var") > 0, dd * dd / F.col("var")).alias("chi2"), F.when(F.col("down") > 0, F.col("up") / F.col("down")).alias("odds_ratio"))


def kappa(df: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Weighted agreement and Cohen's kappa; null when chance agreement is total. One pass over the cells."""
    w = weight if weight is not None else F.lit(1.0)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(w).alias("w"))
    tot = cells.agg(F.sum("w").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("hit"))
    pa = cells.groupBy(F.col("a").alias("k")).agg(F.sum("w").alias("wa"))
    pb = cells.groupBy(F.col("b").alias("k")).agg(F.sum("w").alias("wb"))
    pe = pa.join(pb, "k").agg(F.sum(F.col("wa") * F.col("wb")).alias("e"))
    return tot.crossJoin(pe).select((F.col("hit") / F.col("t")).alias("agreement"), (F.coalesce("e", F.lit(0.0)) / (F.col("t") * F.col("t"))).alias("_pe")).select(
        "agreement", F.when(F.col("_pe") < 1, (F.col("agreement") - F.col("_pe")) / (1 - F.col("_pe"))).alias("kappa")
    )


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("human"), F.col(b).alias("judge")).agg(F.count("*").alias("n"))


def dispersion(per: DataFrame, *by: str) -> DataFrame:
    """Chi-square of counts against one common rate, and per degree of freedom."""
    t = per.groupBy(*by).agg((F.sum("n2") / F.sum("k_eff")).alias("p"))
    j = per.join(F.broadcast(t), list(by))
    e, v = F.col("k_eff") * F.col("p"), F.col("k_eff") * F.col("p") * (1 - F.col("p"))
    g = j.where("p > 0 and p < 1").groupBy(*by).agg(F.sum(F.pow(F.col("n2") - e, F.lit(2)) / v).alias("chi2"), (F.count("*") - 1).alias("df"))
    return g.withColumn("per_df", F.try_divide("chi2", "df"))


def bh_fdr(df: DataFrame, p: str, *by: str) -> DataFrame:
    """``df`` with Bonferroni and Benjamini-Hochberg adjusted values per family; ties share the larger rank."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_m", F.count(p).over(w)).withColumn("_r", F.rank().over(w.orderBy(p)) + F.count("*").over(w.partitionBy(*by, p)) - 1)
    q = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(w.orderBy(F.desc(p)))
    return d.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).withColumn("q", F.least(F.lit(1.0), q)).drop("_m", "_r")


def paired_t(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """t, degrees of freedom and Cohen's d of paired differences."""
    x = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean_diff"), F.stddev_samp(x).alias("sd"))
    d = F.try_divide("mean_diff", "sd")
    return g.select(*by, "n", "mean_diff", d.alias("d"), (d * F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))


def pooled_t(df: DataFrame, value: str, group: Column, *by: str) -> DataFrame:
    """Equal-variance two-sample t and d of group against the others; groups under two rows have none."""
    x, y = F.when(group, F.col(value)), F.when(~group, F.col(value))
    g = df.groupBy(*by).agg(*[f(v).alias(f"{k}{i}") for i, v in ((1, x), (2, y)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2 = F.col("n1"), F.col("n2")
    sp = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    ok = (n1 >= 2) & (n2 >= 2) & (sp > 0)
    diff = F.col("m1") - F.col("m2")
    return g.select(*by, "n1", "n2", F.when(ok, diff / (sp * F.sqrt(1 / n1 + 1 / n2))).alias("t"), F.when(ok, diff / sp).alias("d"), (n1 + n2 - 2).alias("df"))


def verdict(reliability: Column, floor: Column, tau: Column, low: Column) -> Column:
    """Ordered rules: unreliable, floored, undefined, then the two thresholds."""
    return (
        F.when(reliability <= 0.40, "FAILURE").when(floor, "INCONCLUSIVE").when(tau.isNull() | F.isnan(tau), "FAILURE")
        .when((tau >= 0.5) & (low >= 0.3), "GO").otherwise("NO-GO")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def stratified_apply(df: DataFrame, by: str, fn, schema: str) -> DataFrame:
    """A user's pandas function per stratum; a stratum in which it fails gives no rows."""

    def run(pdf):
        try:
            return fn(pdf)
        except Exception:
            return pdf.iloc[:0].reindex(columns=[c.split()[0] for c in schema.split(",")])

    return df.groupBy(by).applyInPandas(run, schema)


def residual_null_band(df: DataFrame, key: str, x: str, y: str, stratum: str, draws: int, seed: int = 20260831) -> DataFrame:
    """``draws, mean, sd, p05, p50, p95``: blocked tau-b after residualising on normal covariates that tell nothing.

    The covariate of a row and draw comes from its hash, so that it is the same in
    every run. A draw is one group; strata keep their pairs apart.
    """
    u = lambda n: (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col(key), F.col("draw")), F.lit(2**31 - 1)) + 1) / F.lit(2.0**31)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y, F.col(stratum).alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    d = d.withColumn("_z", F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.lit(3.141592653589793) * u(2)))
    w = Window.partitionBy("draw", "_s")
    d = d.select("draw", "_s", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in (x, y, "_z")])
    g = d.groupBy("draw").agg(*[F.try_divide(F.sum(F.col(c) * F.col("_z")), F.sum(F.col("_z") * F.col("_z"))).alias(f"_b{c}") for c in (x, y)])
    r = d.join(F.broadcast(g), "draw").select("draw", F.struct("draw", "_s").alias("s"), *[F.round(F.col(c) - F.coalesce(f"_b{c}", F.lit(0.0)) * F.col("_z"), 9).alias(c) for c in (x, y)])
    p = tau_parts(r, x, y, "s").groupBy("s.draw").agg(*[F.sum(k).alias(k) for k in ("num", "dx", "dy")])
    t = p.select(F.when(F.col("dx") * F.col("dy") > 0, F.col("num") / F.sqrt(F.col("dx") * F.col("dy"))).alias("t")).where("t is not null")
    q = t.agg(F.count("*").alias("draws"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("sd"), F.percentile("t", F.array(*[F.lit(v) for v in (0.05, 0.5, 0.95)])).alias("q"))
    return q.select("draws", "mean", "sd", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"))
