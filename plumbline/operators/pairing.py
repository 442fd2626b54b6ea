"""Paired comparisons: before/after tables, McNemar tests, outcome tags, best-of selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Preference among labels: correct, partial, refused, hallucinated.
PRIORITY = {0: 0, 1: 1, 3: 2, 2: 3}


def priority(label: Column, unknown: int = 99) -> Column:
    out = F.lit(unknown)
    for k, p in PRIORITY.items():
        out = F.when(label == k, p).otherwise(out)
    return out


def paired(df: DataFrame, key: str, cond: str, before: object, keep: list[str] | None = None, label: str = "label") -> DataFrame:
    """Each condition other than ``before`` beside it: key, cond, before, after. Keys missing on a side drop out."""
    base = df.where(F.col(cond) == before).select(key, F.col(label).alias("before"), *(keep or []))
    return df.where(F.col(cond) != before).select(key, cond, F.col(label).alias("after")).join(base, key)


def mcnemar(pairs: DataFrame, *by: str, fails: int = 2) -> DataFrame:
    """Discordant counts and the three statistics: uncorrected, Yates-corrected, and which of exact or Yates applies.

    b: failed before only, c: failed after only. No discordant pair gives 0.
    """
    x, y = F.col("before") == fails, F.col("after") == fails
    g = pairs.groupBy(*by).agg(
        F.count("*").alias("n_common"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.avg(x.cast("double")).alias("rate_before"), F.avg(y.cast("double")).alias("rate_after")
    )
    d, s = F.col("b") - F.col("c"), F.col("b") + F.col("c")
    return g.withColumns({
        "chi2_plain": F.when(s == 0, 0.0).otherwise(d * d / s),
        "chi2_yates": F.when(s == 0, 0.0).otherwise(F.pow(F.abs(d) - 1, 2) / s),
        "exact": s < 25,
        "reduction": F.col("rate_before") - F.col("rate_after"),
        "relative_reduction": F.try_divide(F.col("rate_before") - F.col("rate_after"), F.col("rate_before")),
    })


def outcome_per_condition(before: Column, after: Column) -> Column:
    """fixed, still_broken, regressed, already_correct or other, against one condition; fixed means not hallucinated any more."""
    return (
        F.when((before == 2) & (after != 2), "fixed").when((before == 2) & (after == 2), "still_broken").when((before != 2) & (after == 2), "regressed")
        .when((before == 0) & (after == 0), "already_correct").otherwise("other")
    )


def outcome_any(pairs: DataFrame, key: str) -> DataFrame:
    """Outcome over all conditions: one that helps fixes, all must fail to stay broken, one that fails regresses."""
    g = pairs.groupBy(key).agg(
        F.min("before").alias("before"), F.count("*").alias("n_tested"), F.count_if(F.col("after") != 2).alias("n_fixed"),
        F.bool_and(F.col("after") == 0).alias("_all0"), F.bool_or(F.col("after") == 2).alias("_any2"),
    )
    tag = (
        F.when((F.col("before") == 2) & (F.col("n_fixed") > 0), "fixed").when(F.col("before") == 2, "still_broken").when(F.col("_any2"), "regressed")
        .when((F.col("before") == 0) & F.col("_all0"), "already_correct").otherwise("other")
    )
    return g.select(key, "before", "n_tested", "n_fixed", tag.alias("outcome"))


def outcome_tuned(before: Column, after: Column) -> Column:
    """Fine-tuning outcome: fixed needs a correct answer; broken is correct before and not after."""
    return (
        F.when((before == 2) & (after == 0), "fixed").when((before == 2) & (after == 2), "still_broken").when((before == 0) & (after != 0), "broken_by_tuning")
        .when((before == 0) & (after == 0), "always_correct").otherwise("other")
    )


def best_source(df: DataFrame, key: str, source: str, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Best answer per key by (priority, -confidence, source); nulls if the best is hallucinated."""
    order = F.struct(priority(F.col(label)).alias("p"), (-F.coalesce(F.col(confidence), F.lit(0.0))).alias("c"), F.col(source).alias("s"))
    g = df.groupBy(key).agg(F.min(order).alias("o"), F.min(priority(F.col(label))).alias("p"), F.count("*").alias("n_sources"))
    ok = F.col("p") < PRIORITY[2]
    return g.select(key, F.when(ok, F.col("o.s")).alias("source"), F.when(ok, -F.col("o.c")).alias("confidence"), "n_sources", F.col("p").alias("oracle_priority"))


def unique_contribution(df: DataFrame, key: str, source: str, label: str = "label") -> DataFrame:
    """Keys per source for which it alone is correct."""
    good = df.where(F.col(label) == 0).groupBy(key).agg(F.countDistinct(source).alias("d"), F.min(source).alias(source))
    return good.where("d = 1").groupBy(source).agg(F.count("*").alias("unique_correct"))


def arg_best(df: DataFrame, key: str, cond: str, rate: str, order: str) -> DataFrame:
    """Condition with the highest rate per key; the first in ``order`` wins ties."""
    return df.groupBy(key).agg(F.max_by(cond, F.struct(F.col(rate), (-F.col(order)).alias("o"))).alias("best"), F.max(rate).alias("best_rate"))


def last_wins(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")


def first_wins(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")
