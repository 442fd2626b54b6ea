"""Label rates and other relational roll-ups. Labels: 0 correct, 1 partial, 2 hallucinated, 3 refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE_NAMES = ("correct_rate", "partial_rate", "hallucinated_rate", "refused_rate")


def share(cond: Column) -> Column:
    """Share of rows for which ``cond`` holds; null conditions don't count as rows."""
    return F.avg(cond.cast("double"))


def rate_columns(label: str = "label") -> list[Column]:
    return [F.count("*").alias("n"), *[share(F.col(label) == k).alias(n) for k, n in enumerate(RATE_NAMES)]]


def label_rates(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """Rates per key, with safety = 1 - hallucinated rate."""
    return df.groupBy(*keys).agg(*rate_columns(label)).withColumn("safety", 1 - F.col("hallucinated_rate"))


def overall_and_by(df: DataFrame, key: str, by: str, total: str = "ALL", label: str = "label") -> DataFrame:
    """Rates per key over all rows (``by`` = total) and per (key, by), in one grouping-sets pass."""
    g = df.groupingSets([[key], [key, by]], key, by).agg(F.grouping(by).alias("_all"), *rate_columns(label))
    return g.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by))).drop("_all")


def label_counts(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """Total, counts by label, accuracy and hallucination rate."""
    counts = [F.count_if(F.col(label) == k).alias(f"n{k}") for k in range(4)]
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *counts).withColumns(
        {"accuracy": F.try_divide("n0", "total"), "hallucination_rate": F.try_divide("n2", "total")}
    )


def flags(df: DataFrame, label: str = "label") -> DataFrame:
    """0/1 flags and the severity map; labels outside the map have none."""
    is_ = lambda k: (F.col(label) == k).cast("int")
    severity = F.create_map(*[F.lit(x) for kv in ((0, 0.0), (1, 0.33), (2, 0.67), (3, 1.0)) for x in kv])
    return df.withColumns({"is_hallucinated": is_(2), "is_correct": is_(0), "is_refused": is_(3), "severity": F.try_element_at(severity, F.col(label))})


def performance(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Count, hallucinations and their percentage with two decimals, lowest first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 2).alias("hallucinations"), share(F.col(label) == 2).alias("_r")).select(
        key, "n", "hallucinations", F.round(F.round("_r", 4) * 100, 2).alias("rate_pct")
    )


def hard_items(df: DataFrame, item: str, by: str, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Items whose mean failure over ``by`` (first row of each by label order) exceeds the threshold."""
    one = df.groupBy(item, by).agg(F.max((F.col(label) == 2).cast("int")).alias("failed"))
    return one.groupBy(item).agg(F.avg("failed").alias("failure_rate"), F.count("*").alias("n")).where(F.col("failure_rate") > threshold)


def pivot_labels(df: DataFrame, item: str, by: str, values: list[str], label: str = "label") -> DataFrame:
    """One column per value of ``by`` with the smallest label."""
    return df.groupBy(item).pivot(by, values).agg(F.min(label))


def transitions(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Cells, row and column totals and the grand total of a transition matrix; -1 stands for a total."""
    g = pairs.cube(before, after).agg(F.count("*").alias("n"), F.grouping(before).alias("_b"), F.grouping(after).alias("_a"))
    tot = lambda c, k: F.when(F.col(k) == 1, F.lit(-1)).otherwise(F.col(c)).alias(c)
    return g.select(tot(before, "_b"), tot(after, "_a"), "n")


def describe_by(df: DataFrame, by: str, features: list[str]) -> DataFrame:
    """Mean, sample deviation, exact median and count per feature, in long form; nulls are skipped per feature."""
    long = df.unpivot([by], features, "feature", "value").where("value is not null")
    return long.groupBy(by, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.count("*").alias("n")
    )


def scaled_long(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Unpivoted features scaled to [0, 1]; a constant feature keeps its values. The ranges are one small aggregate."""
    long = df.unpivot([key], features, "feature", "value")
    ext = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value"))
    return long.join(F.broadcast(ext), "feature").select(key, "feature", scaled.alias("scaled"))


def confidence_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, extremes and population deviation."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std")
    )


def agreement_summary(df: DataFrame, key: str, agreement: str, confidence: str) -> DataFrame:
    """Mean and median agreement, unanimous share, majority (two thirds) share, mean confidence."""
    a = F.col(agreement)
    return df.groupBy(key).agg(
        F.avg(a).alias("mean_agreement"), F.median(a).alias("median_agreement"), share(a == 1.0).alias("unanimous"),
        share(a >= 2 / 3 - 1e-9).alias("majority"), F.avg(confidence).alias("mean_confidence"), F.count("*").alias("n"),
    )


def per_pair(samples: DataFrame, uid: str = "uid", model: str = "model") -> DataFrame:
    """Measures of the repeated samples of each (uid, model): one map-side combined aggregate.

    p_half and p_full count a partial answer half and fully; even and odd are the
    rates of the halves by sample index; empty completions count as refusals.
    """
    lab, even = F.col("label"), F.col("sample_idx") % 2 == 0
    hall = (lab == 2).cast("double")
    return samples.groupBy(uid, model).agg(
        F.min("stratum").alias("stratum"), F.count("*").alias("k_eff"), *[F.count_if(lab == k).alias(f"n{k}") for k in range(4)],
        F.avg(hall).alias("p_hat"), F.avg(hall + 0.5 * (lab == 1).cast("double")).alias("p_half"), F.avg(hall + (lab == 1).cast("double")).alias("p_full"),
        share(lab == 3).alias("refusal_rate"), F.avg(F.when(even, hall)).alias("p_even"), F.avg(F.when(~even, hall)).alias("p_odd"),
        share(F.col("truncated")).alias("truncation_rate"), F.avg("output_tokens").alias("mean_tokens"), F.median("output_tokens").alias("median_tokens"),
    )


def marginal_rates(samples: DataFrame, model: str = "model") -> DataFrame:
    """Completion-level hallucination rate with its Wilson interval, and the mean of the per-prompt rates."""
    from .stats import wilson

    per = per_pair(samples)
    g = per.groupBy(model).agg(
        F.sum("k_eff").alias("n"), F.sum("n2").alias("k"), F.avg("p_hat").alias("mean_p_hat"), F.avg("refusal_rate").alias("mean_refusal")
    )
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(model, "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("low"), hi.alias("high"), "mean_p_hat", "mean_refusal")


def floor_effects(per: DataFrame, keys: list[str]) -> DataFrame:
    """Share of zero rates, median, 90th percentile and distinct values of p_hat."""
    return per.groupBy(*keys).agg(
        share(F.col("p_hat") == 0).alias("zero_share"), F.median("p_hat").alias("median"), F.percentile("p_hat", F.lit(0.9)).alias("p90"), F.countDistinct("p_hat").alias("distinct_values")
    )


def floor_check(per: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of zero rates per model and whether it trips the floor."""
    return per.groupBy("model").agg(share(F.col("p_hat") == 0).alias("zero_share")).withColumn("tripped", F.col("zero_share") > threshold)


def attrition(per: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Requested, dropped and kept uids per stratum under the rule min(k_a, k_b) >= least."""
    k = per.groupBy("stratum", "uid").agg(F.max(F.when(F.col("model") == a, F.col("k_eff"))).alias("ka"), F.max(F.when(F.col("model") == b, F.col("k_eff"))).alias("kb"))
    keep = F.coalesce(F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) >= least, F.lit(False))
    return k.groupBy("stratum").agg(F.count("*").alias("requested"), F.count_if(~keep).alias("dropped"), F.count_if(keep).alias("final"))


def degenerate_strata(per: DataFrame, a: str, b: str, least_n: int = 2, least_values: int = 5) -> DataFrame:
    """Strata that lack rows or distinct rates for either model."""
    return (
        per.where(F.col("model").isin(a, b)).groupBy("stratum", "model").agg(F.count("*").alias("n"), F.countDistinct("p_hat").alias("d"))
        .groupBy("stratum").agg(F.min("n").alias("min_n"), F.min("d").alias("min_distinct"), F.count("*").alias("models"))
        .withColumn("degenerate", (F.col("min_n") < least_n) | (F.col("min_distinct") < least_values) | (F.col("models") < 2))
    )


def paired_difference(pairs: DataFrame, by: str, least: int = 10, band: float = 0.05) -> DataFrame:
    """Hallucination rates before and after per group, their difference and its direction."""
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), share(F.col("before") == 2).alias("rate_before"), share(F.col("after") == 2).alias("rate_after"))
    d = F.col("rate_after") - F.col("rate_before")
    return g.where(F.col("n") >= least).withColumn("diff", d).withColumn("direction", F.when(d < -band, "improved").when(d > band, "worsened").otherwise("unchanged"))


def attack_summary(df: DataFrame, key: str) -> DataFrame:
    """Attack success and mean shifts of density and centrality."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("is_hallucinated").alias("success_rate"), F.avg("density_change").alias("density_change"), F.avg("centrality_change").alias("centrality_change"),
        F.corr(F.col("is_hallucinated").cast("double"), F.col("density_change")).alias("r_density"),
    )


def version_comparison(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two metric tables side by side; missing sides stay null."""
    return a.select(*keys, F.col(value).alias("old")).join(b.select(*keys, F.col(value).alias("new")), keys, "full_outer").withColumn("delta", F.col("new") - F.col("old"))


def train_test_gap(df: DataFrame, key: str, part: str) -> DataFrame:
    """Accuracy on train and test and the band of the gap in points: <= 5, <= 15, beyond."""
    acc = lambda v: F.avg(F.when(F.col(part) == v, (F.col("label") == 0).cast("double"))) * 100
    g = df.groupBy(key).agg(acc("train").alias("train_acc"), acc("test").alias("test_acc"))
    gap = F.col("train_acc") - F.col("test_acc")
    return g.withColumn("gap", gap).withColumn("band", F.when(gap <= 5, "small").when(gap <= 15, "moderate").otherwise("large"))


def entity_impact(df: DataFrame, entity: str, uid: str, pa: str, pb: str) -> DataFrame:
    """Prompts, mean rates, gap and impact = n * |gap| per entity, with its sorted uids."""
    g = df.groupBy(entity).agg(
        F.count("*").alias("n"), F.avg(pa).alias("mean_a"), F.avg(pb).alias("mean_b"), F.array_join(F.array_sort(F.collect_set(F.col(uid).cast("string"))), ";").alias("uids")
    )
    return g.withColumn("gap", F.col("mean_a") - F.col("mean_b")).withColumn("impact", F.col("n") * F.abs(F.col("gap")))


def template_overlap(df: DataFrame, template: str, seen: DataFrame) -> DataFrame:
    """Accuracy on seen, novel and template-free rows."""
    j = df.join(seen.select(F.col(template)).distinct().withColumn("_s", F.lit(1)), template, "left")
    kind = F.when(F.col(template).isNull(), "no_template").when(F.col("_s") == 1, "seen").otherwise("novel").alias("kind")
    return j.groupBy(kind).agg(F.count("*").alias("n"), share(F.col("label") == 0).alias("accuracy"))


def validity_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(F.col(key), F.col(value)).agg(F.count("*").alias("n"))


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    c = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.max_by(value, F.struct("n", (-F.xxhash64(value)).alias("h"))).alias("_x"), F.max("n").alias("n")).join(
        c.withColumnRenamed(value, "mode"), [key, "n"]
    ).groupBy(key, "n").agg(F.min("mode").alias("mode"))


def nearest_index(values: Column, p: float | None = None) -> Column:
    """Upper median (element n div 2), or the element at index min(n-1, floor(p*n)), of a group's values.

    The group's values are sorted in one place: for groups of bounded size, such
    as the samples of a prompt.
    """
    s = F.array_sort(F.collect_list(values))
    n = F.size(s)
    i = (n / 2).cast("int") if p is None else F.least(n - 1, F.floor(n * p).cast("int"))
    return F.get(s, i)
