"""Ranks, bins and threshold tables.

Ranks come from counts per distinct value: a group's rows are combined before any
window runs, so ties cost nothing and a window sees distinct values only. Running
sums over a whole table, or over a group that may be most of it, are taken per
range of the order and then shifted by the sums of the ranges before, so that no
task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def running(df: DataFrame, order: list[Column], sums: dict[str, str], *by: str) -> DataFrame:
    """``df`` with, for each ``out: column``, the sum over all rows up to and with this one in ``order`` (a total order), within ``by``.

    Rows are range partitioned by (by, order) and written once, as two readers need
    the same ranges; the ranges' sums are as few as partitions and groups in them.
    """
    d = df.repartitionByRange(*[F.col(b).asc() for b in by], *order).withColumn("_range", F.spark_partition_id())
    d = Scratch(df.sparkSession, "ranges").cut(d)
    part = d.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.select("_range", *by, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(here).alias(f"_h_{o}") for o, c in sums.items()])
    same = [d[b].eqNullSafe(shift[b]) for b in by]
    cond = d["_range"] == shift["_range"]
    for x in same:
        cond = cond & x
    return d.join(F.broadcast(shift), cond).select(*[d[c] for c in df.columns], *[(F.col(f"_h_{o}") + F.col(f"_b_{o}")).alias(o) for o in sums])


def value_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, value, n, below, total: rows below each distinct value of a group."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    r = running(c, [F.col(value).asc()], {"_upto": "n"}, *by)
    t = c.groupBy(*by).agg(F.sum("n").alias("total"))
    j = r.crossJoin(F.broadcast(t)) if not by else r.alias("r").join(t.alias("t"), [F.col(f"r.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]).select("r.*", "t.total")
    return j.withColumn("below", F.col("_upto") - F.col("n")).drop("_upto")


def average_rank(df: DataFrame, value: str, *by: str, out: str = "rank") -> DataFrame:
    """``df`` with 1-based ranks, ties at the mean of their positions; null values have none."""
    r = value_ranks(df, value, *by).select(*by, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(r, [*by, value], "left")


def percentile_rank(df: DataFrame, value: str, ref: DataFrame, ref_value: str) -> DataFrame:
    """Per row, 100 x the share of reference values strictly below."""
    marked = df.select(F.col(value).alias("v")).distinct().withColumn("c", F.lit(0)).unionByName(ref.select(F.col(ref_value).alias("v"), F.lit(1).alias("c")))
    c = marked.where("v is not null").groupBy("v").agg(F.sum("c").alias("c"))
    total = c.agg(F.sum("c").alias("t"))
    r = running(c, [F.col("v").asc()], {"upto": "c"}).crossJoin(F.broadcast(total))
    return df.join(r.select(F.col("v").alias(value), (100.0 * (F.col("upto") - F.col("c")) / F.col("t")).alias("percentile")), value, "left")


def equal_frequency(df: DataFrame, value: str, q: int) -> DataFrame:
    """``df`` with a bin 0..: edges are exact interpolated quantiles without repeats, right-closed, the lowest value included.

    Fewer rows than bins give no rows.
    """
    r = value_ranks(df.select(value), value)
    n = r.agg(F.max("total").alias("n")).first().n
    if not n or n < q:
        return df.withColumn("bin", F.lit(0)).where(F.lit(False))
    # at most two values for each of the q + 1 quantiles
    at = [(n - 1) * i / q for i in range(q + 1)]
    places = sorted({int(x) for x in at} | {min(n - 1, int(x) + 1) for x in at})
    held = F.filter(F.array(*[F.lit(p) for p in places]), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n")))
    found = {p: float(x[value]) for x in r.withColumn("at", held).where(F.size("at") > 0).select(value, "at").collect() for p in x["at"]}
    edges = []
    for x in at:
        lo, hi = found[int(x)], found[min(n - 1, int(x) + 1)]
        e = lo + (hi - lo) * (x - int(x))
        if not edges or e != edges[-1]:
            edges.append(e)
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    return df.where(F.col(value).isNotNull()).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(value))))


def equal_width(value: Column, bins: int = 10) -> Column:
    """Bin 1..bins of (a, b] intervals over [0, 1]; 0 and values outside have none."""
    return F.when((value > 0) & (value <= 1), F.ceil(value * bins).cast("int"))


def mann_whitney(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """n1, n2, u, effect and the tie-corrected z of group 1 against group 0 (``group`` is 0/1).

    u is the first sample's; effect = 1 - 2u/(n1 n2) is negative when group 1 is larger; auc = u/(n1 n2).
    """
    c = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.sum(group).alias("k"))
    c = running(c, [F.col(value).asc()], {"_upto": "n"}, *by).withColumn("r", F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2)
    g = c.groupBy(*by).agg(F.sum(F.col("r") * F.col("k")).alias("r1"), F.sum("k").alias("n1"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mu, sd = n1 * n2 / 2, F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return g.where((n1 > 0) & (n2 > 0)).select(
        *by, "n1", n2.alias("n2"), u.alias("u"), (1 - 2 * u / (n1 * n2)).alias("effect"), (u / (n1 * n2)).alias("auc"),
        F.when(sd > 0, (F.abs(u - mu) - 0.5) / sd).alias("z"),
    )


def threshold_table(df: DataFrame, score: str, target: str, fractions: list[float], tie: str) -> DataFrame:
    """Flag the top int(n * fraction) rows by score: flagged, hits, recall, precision, false positive rate.

    A fraction of less than a row flags none. Rows are ordered by (score, tie) in
    ranges; ``tie`` orders equal scores, smallest first.
    """
    r = running(df.select(score, target, tie).withColumn("_1", F.lit(1)), [F.desc(score), F.asc(tie)], {"i": "_1"})
    t = df.agg(F.count("*").alias("n"), F.sum(target).alias("pos"))
    out = r.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(df.sparkSession.createDataFrame([(f,) for f in fractions], "fraction double")))
    f = F.col("i") <= F.floor(F.col("n") * F.col("fraction") + 1e-9)
    g = out.groupBy("fraction", "n", "pos").agg(F.count_if(f).alias("flagged"), F.count_if(f & (F.col(target) == 1)).alias("tp"))
    return g.select(
        "fraction", "flagged", "tp", F.try_divide("tp", "pos").alias("recall"), F.try_divide("tp", "flagged").alias("precision"),
        F.try_divide(F.col("flagged") - F.col("tp"), F.col("n") - F.col("pos")).alias("fpr"),
    )


def roc_points(df: DataFrame, score: str, target: str) -> DataFrame:
    """Cumulative counts and rates at each distinct score, highest first."""
    c = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(target).alias("k"))
    r = running(c, [F.desc(score)], {"tp": "k", "_all": "n"}).withColumn("fp", F.col("_all") - F.col("tp"))
    t = c.agg(F.sum("k").alias("p"), (F.sum("n") - F.sum("k")).alias("q"))
    return r.crossJoin(F.broadcast(t)).select(score, "tp", "fp", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "q").alias("fpr"), (F.col("tp") / F.col("_all")).alias("precision"))


def classification_metrics(df: DataFrame, actual: Column, predicted: Column, *by: str) -> DataFrame:
    """Counts and zero-guarded accuracy, precision, recall and F1."""
    g = df.groupBy(*by).agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & ~predicted).alias("tn"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = z(tp, tp + fp), z(tp, tp + fn)
    return g.withColumns({"accuracy": z(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "f1": z(2 * p * r, p + r)})


def enrichment(df: DataFrame, flag: Column, target: str) -> DataFrame:
    """Target rates of flagged and other rows and their ratio."""
    g = df.agg(F.avg(F.when(flag, F.col(target))).alias("flagged_rate"), F.avg(F.when(~flag, F.col(target))).alias("other_rate"))
    return g.withColumn("enrichment", F.try_divide("flagged_rate", "other_rate"))
