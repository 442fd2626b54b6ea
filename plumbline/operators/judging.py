"""Judged logs and their checks: load, best rows, states, agreement bundles, corrections, joins with stated collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the order wanted."""
    return df.select(*[c for c in wanted if c in df.columns])


def drop_present(df: DataFrame, unwanted: list[str]) -> DataFrame:
    return df.drop(*[c for c in unwanted if c in df.columns])


def mentions(keywords: tuple[str, ...], *cols: Column) -> Column:
    """Does any column hold any keyword, ignoring case? Nulls hold none."""
    return F.coalesce(F.array_max(F.array(*[F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k.lower())) for c in cols for k in keywords])), F.lit(False))


def remove_with_dependants(df: DataFrame, key: str, bad: Column, dependants: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """``df`` without its bad rows, and each dependent table without the rows that refer to them."""
    gone = df.where(bad).select(F.col(key).alias("_gone")).distinct()
    return {"": df.where(~bad)} | {n: t.join(gone, t[k] == gone["_gone"], "left_anti") for n, (t, k) in dependants.items()}


def failure_cause(failed: Column, error: Column, behavioural: str = "empty completion (finish_reason=") -> Column:
    """infrastructure (can be tried again), behavioural (an outcome of the model) or null."""
    return F.when(failed, F.when(F.contains(F.coalesce(error, F.lit("")), F.lit(behavioural)), "behavioural").otherwise("infrastructure"))


def families(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """All family tokens that the needles found in ``name`` imply."""
    hit = [F.when(F.contains(F.lower(name), F.lit(k)), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in table.items()]
    return F.array_distinct(F.flatten(F.array(*hit)))


def independence(judges: DataFrame, judge: str, models: DataFrame, model: str, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """``judge, model, shared, verdict``: unknown families and shared ones are both refusals. Both sides are distinct names."""
    a = judges.select(F.col(judge).alias("judge")).distinct().withColumn("_a", families(F.col("judge"), table))
    b = models.select(F.col(model).alias("model")).distinct().withColumn("_b", families(F.col("model"), table))
    shared = F.array_sort(F.array_intersect("_a", "_b"))
    verdict = F.when((F.size("_a") == 0) | (F.size("_b") == 0), "unknown family").when(F.size(shared) > 0, "shared family").otherwise("independent")
    return a.crossJoin(b).select("judge", "model", F.array_join(shared, "+").alias("shared"), verdict.alias("verdict"))


def risk_flags(entity: Column, subset: Column, known: tuple[str, ...] = ()) -> Column:
    """Flags of an entity that can't safely be called invented, joined by "; "."""
    words = F.size(F.filter(F.split(F.replace(entity, F.lit("The "), F.lit("")), r"\s+"), lambda x: x != ""))
    rules = [
        ("known to be real", entity.isin(*known) if known else F.lit(False)), ("human name", subset == "people"), ("short place name", (subset == "places") & (words <= 2)),
        ("short title", (subset == "books") & (words <= 4)),
    ]
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull()), "; ")


def left_with_suffix(a: DataFrame, b: DataFrame, key: str, suffix: str = "_right", fan_out: bool = False) -> DataFrame:
    """Left join; columns of both sides keep the left's name, the right's get a suffix.

    A key that comes several times on the right multiplies rows only if asked for;
    else the first right row in the order of its columns counts.
    """
    cols = [c for c in b.columns if c != key]
    if not fan_out:
        b = b.groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*")
    return a.join(b.select(key, *[F.col(c).alias(c + suffix if c in a.columns else c) for c in cols]), key, "left")


def inner_coalescing(a: DataFrame, b: DataFrame, key: str, *prefer_right: str) -> DataFrame:
    """Inner join on the keys as strings; of columns on both sides the right's value wins where it isn't null."""
    l, r = a.withColumn("_k", F.col(key).cast("string")), b.select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in b.columns if c != key])  # noqa: E741
    j = l.join(r, "_k").drop("_k")
    for c in [c for c in b.columns if c != key]:
        j = j.withColumn(c, F.coalesce(f"_r_{c}", c) if c in prefer_right and c in a.columns else F.col(f"_r_{c}")).drop(f"_r_{c}")
    return j


def asserted_size(df: DataFrame, n: Column) -> DataFrame:
    """``n, expected`` of a paired table; reading it fails if they differ."""
    g = df.agg(F.count("*").alias("n")).withColumn("expected", n.cast("long"))
    return g.where(F.assert_true(F.col("n") == F.col("expected"), F.concat(F.lit("rows: "), F.col("n"))).isNull())


def load_judged(completions: DataFrame, log: DataFrame, known: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(labelled ``keys, label, tokens, truncated``; one row of counters).

    Of the successes of a key the first in ``order`` counts, later ones are
    duplicates; failures and null labels are no labels; rows of unknown ids or
    without a completion are counted and left out.
    """
    done = completions.groupBy(*keys).agg(F.max_by(F.struct("output_tokens", "truncated", "generation_failed", "error"), "pos").alias("c"))
    rows = log.join(known.select(keys[0]).distinct().withColumn("_known", F.lit(True)), keys[0], "left").join(done, keys, "left")
    ok = F.coalesce("_known", F.lit(False))
    good = ok & ~F.coalesce("judge_failed", F.lit(False)) & F.col("label").isNotNull()
    usable = rows.where(good & F.col("c").isNotNull())
    first = usable.groupBy(*keys).agg(F.min_by("label", order).alias("label"), F.min("c").alias("c"), F.count("*").alias("_n"))
    counts = rows.agg(
        F.count("*").alias("rows"), F.count_if(~ok).alias("unknown"), F.count_if(ok & ~good).alias("failed"), F.count_if(good & F.col("c").isNull()).alias("orphans")
    )
    labelled = first.agg(F.count("*").alias("labelled"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    empty = done.where("c.generation_failed and startswith(c.error, 'empty completion')").join(first, keys, "left_anti").agg(F.count("*").alias("empty_completions"))
    out = first.select(*keys, "label", "c.output_tokens", "c.truncated")
    return out, counts.crossJoin(labelled).crossJoin(empty)


def best_completion(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Per key the first row with a text, else the first row."""
    rank = F.struct((F.length(F.coalesce(text, F.lit(""))) == 0).alias("e"), F.col(order).alias("o"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(text, order), rank).alias("r")).select(*keys, "r.*")


def rekey(old: DataFrame, new: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(old rows with the new key, old rows without one), matched on the trimmed text; of equal texts the smallest new key counts."""
    m = new.groupBy(F.trim(text).alias("_t")).agg(F.min(key).alias(f"new_{key}"))
    j = old.withColumn("_t", F.trim(text)).join(m, "_t", "left").drop("_t")
    return j.where(F.col(f"new_{key}").isNotNull()), j.where(F.col(f"new_{key}").isNull()).drop(f"new_{key}")


def top_up(kept: DataFrame, pool: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """``key, origin``: what is kept, and the pool without the excluded and what is taken."""
    a = kept.select(key).distinct()
    b = pool.select(key).distinct().join(excluded.select(key).distinct(), key, "left_anti").join(a, key, "left_anti")
    return a.withColumn("origin", F.lit("kept")).unionByName(b.withColumn("origin", F.lit("pool")))


def first_match(c: Column, *patterns: str) -> Column:
    """First group of the first pattern that matches; null without one."""
    return F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, p, 1)) for p in patterns])


def generation_state(frame: DataFrame, log: DataFrame, keys: list[str], want: int, least: int) -> DataFrame:
    """One row: pairs short of ``want`` samples, with none, below the least, and prompts that lost a model; pairs without any row count as 0."""
    n = log.where("not coalesce(generation_failed, false)").groupBy(*keys).agg(F.count("*").alias("k"))
    k = frame.join(n, keys, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return k.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("k") < want).alias("short"), F.count_if(F.col("k") == 0).alias("zero"), F.count_if(F.col("k") < least).alias("below_least"),
        F.count_distinct(F.when(F.col("k") == 0, F.col(keys[0]))).alias("lost_prompts"),
    )


def truncation_gap(log: DataFrame, model: str, gap: float = 0.05) -> DataFrame:
    """``low, high, gap, wide``: extremes of the models' truncation rates over rows that did not fail."""
    r = log.where("not coalesce(generation_failed, false)").groupBy(model).agg(F.avg(F.col("truncated").cast("double")).alias("r"))
    g = r.agg(F.min("r").alias("low"), F.max("r").alias("high"))
    return g.select("low", "high", (F.col("high") - F.col("low")).alias("gap"), (F.col("high") - F.col("low") > gap).alias("wide"))


def judging_state(completions: DataFrame, log: DataFrame, keys: list[str], abort: float = 0.02) -> DataFrame:
    """One row: judgeable and unrecovered keys, their rate against the limit, failed rows in the log and k_eff below 16."""
    can = completions.where("not coalesce(generation_failed, false)").select(*keys).distinct()
    ok = log.where("not coalesce(judge_failed, false) and label is not null").select(*keys).distinct().withColumn("_ok", F.lit(1))
    j = can.join(ok, keys, "left")
    per = j.groupBy(*keys[:-1]).agg(F.count("_ok").alias("k"))
    a = j.agg(F.count("*").alias("judgeable"), F.count_if(F.col("_ok").isNull()).alias("unrecovered"))
    b = log.agg(F.count_if(F.coalesce("judge_failed", F.lit(False)) | F.col("label").isNull()).alias("failed_rows"), F.count("*").alias("rows"))
    c = per.agg(F.count_if(F.col("k") < 16).alias("pairs_below_16"))
    rate = F.try_divide("unrecovered", "judgeable")
    return a.crossJoin(b).crossJoin(c).select("judgeable", "unrecovered", rate.alias("rate"), (rate > abort).alias("abort"), "failed_rows", "rows", "pairs_below_16")


def agreement_bundle(df: DataFrame, human: str, judge: str, weight: str, *by: str, fails: int = 2) -> DataFrame:
    """Per slice: n, agreement and kappa over four labels and over the failing one, plain and weighted. One pass over label cells."""
    cells = df.groupBy(*by, F.col(human).alias("h"), F.col(judge).alias("j")).agg(F.count("*").cast("double").alias("c"), F.sum(weight).alias("w"))
    labels = (0, 1, 2, 3)
    cols = [F.sum("c").cast("long").alias("n")]

    def stats(m: str, tag: str) -> list[Column]:
        total = F.sum(m)
        four = F.sum(F.when(F.col("h") == F.col("j"), F.col(m)).otherwise(0.0)) / total
        two = F.sum(F.when((F.col("h") == fails) == (F.col("j") == fails), F.col(m)).otherwise(0.0)) / total
        part = lambda c, k: F.sum(F.when(F.col(c) == k, F.col(m)).otherwise(0.0)) / total
        e4 = sum((part("h", k) * part("j", k) for k in labels), F.lit(0.0))
        e2 = part("h", fails) * part("j", fails) + (1 - part("h", fails)) * (1 - part("j", fails))
        k = lambda po, pe: F.when(pe < 1, (po - pe) / (1 - pe))
        return [four.alias(f"agree_{tag}"), k(four, e4).alias(f"kappa_{tag}"), two.alias(f"binary_agree_{tag}"), k(two, e2).alias(f"binary_kappa_{tag}")]

    return cells.groupBy(*by).agg(*cols, *stats("c", "plain"), *stats("w", "weighted"))


def retest(first: DataFrame, second: DataFrame, key: str, label: str, stratum: str, fails: int = 2) -> DataFrame:
    """``stratum, n, agree, agree_boundary`` of two labellings of the same items, with a row of all."""
    j = first.select(key, stratum, F.col(label).alias("a")).join(second.select(key, F.col(label).alias("b")), key)
    g = j.groupingSets([[], [F.col(stratum)]], F.col(stratum)).agg(
        F.grouping(stratum).alias("_g"), F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"),
        F.avg(((F.col("a") == fails) == (F.col("b") == fails)).cast("double")).alias("agree_boundary"),
    )
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(stratum).cast("string")).alias("stratum"), "n", "agree", "agree_boundary")


def determinism(df: DataFrame, keys: list[str], label: str, prior: str) -> DataFrame:
    """``n_keys, repeated, unstable, differs_from_prior``: do repeats of one input get one label, and the earlier one?"""
    g = df.groupBy(*keys).agg(F.count(label).alias("n"), F.count_distinct(label).alias("d"), F.bool_or(F.col(label) != F.col(prior)).alias("x"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("d") > 1).alias("unstable"), F.count_if("x").alias("differs_from_prior"))


def mixed_flags(votes: DataFrame, label: str, mixed: str, *by: str, fails: int = 2) -> DataFrame:
    """Failing votes per key, and those of them that first reject and then invent."""
    bad = F.col(label) == fails
    return votes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_failing"), F.count_if(bad & F.coalesce(F.col(mixed), F.lit(False))).alias("n_mixed"))


def corrected(labels: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """Labels after correction events (key, kind, value, order): fixes change the label and keep the old one, doubts are flagged; the last of each kind counts."""
    fix = events.where("kind = 'fix'").groupBy(key).agg(F.max_by("value", order).alias("_v"))
    doubt = events.where("kind = 'doubt'").groupBy(key).agg(F.lit(True).alias("_d"))
    j = labels.join(fix, key, "left").join(doubt, key, "left")
    changed = F.col("_v").isNotNull() & (F.col("_v") != F.col("label"))
    return j.select(
        *[c for c in labels.columns if c != "label"], F.coalesce("_v", "label").alias("label"), F.when(changed, F.col("label")).alias("corrected_from"), F.coalesce("_d", F.lit(False)).alias("gt_doubt")
    )


def promoted(first: DataFrame, relabel: DataFrame, redo: DataFrame, key: str) -> DataFrame:
    """``key, label, redone_from, redone_via``: a redo overrides a relabelling, which overrides the first label."""
    j = first.select(key, F.col("label").alias("a")).join(relabel.select(key, F.col("label").alias("b")), key, "left").join(redo.select(key, F.col("label").alias("c")), key, "left")
    new = F.coalesce("c", "b")
    return j.select(key, F.coalesce(new, "a").alias("label"), F.when(new.isNotNull(), F.col("a")).alias("redone_from"), F.when(F.col("c").isNotNull(), "redo").when(F.col("b").isNotNull(), "relabel").alias("redone_via"))


def first_per(df: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    """The first n rows per class: a report of examples."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= n)


def around(df: DataFrame, order: str, key: str, at: Column, reach: int = 2) -> DataFrame:
    """Rows within ``reach`` places of those that match, by order of first appearance within their key's partition."""
    w = Window.partitionBy(key).orderBy(order)
    n = df.withColumn("place", F.row_number().over(w))
    spots = n.where(at).select(key, F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place")).distinct()
    return n.join(spots, [key, "place"], "left_semi")


def rows_by_power(n: Column) -> Column:
    """How far a slice can be read, by its size."""
    return F.when(n >= 30, "GOOD").when(n >= 20, "OK").when(n >= 5, "POOR").otherwise("NONE")


def substituted_entities(m: Column, dropped: tuple[str, ...] = ("[profession]", "[topic]")) -> Column:
    """Sorted distinct values of a substitution map, lower case and trimmed, without the dropped ones."""
    v = F.transform(F.map_values(m), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(v, lambda x: x.isNotNull() & (x != "") & ~x.isin(*dropped))))


def is_partition(mapping: DataFrame, fine: str, coarse: str) -> DataFrame:
    """``n_fine, n_coarse, split``: fine strata that several coarse ones claim; 0 makes it a partition."""
    g = mapping.groupBy(fine).agg(F.count_distinct(coarse).alias("d"))
    return g.agg(F.count("*").alias("n_fine"), F.count_if(F.col("d") > 1).alias("split")).crossJoin(mapping.agg(F.count_distinct(coarse).alias("n_coarse")))


def subset_violations(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``small, large, outside``: for each two neighbours of a rising chain, keys of the smaller that the larger lacks."""
    names = list(parts)
    out = None
    for a, b in zip(names, names[1:]):
        n = parts[a].select(key).distinct().join(parts[b].select(key).distinct(), key, "left_anti").agg(F.count("*").alias("outside"))
        row = n.select(F.lit(a).alias("small"), F.lit(b).alias("large"), "outside")
        out = row if out is None else out.unionByName(row)
    return out


def label_plan(cells: DataFrame, model: str, label: str, category: str, per_model: int, rare: tuple[int, ...] = (1, 3), least_rare: int = 10, fails: int = 2, share: float = 0.5) -> DataFrame:
    """``model, label, category, population, quota``: a label-balanced sample plan from a table of cell sizes.

    Half of a model's quota goes to the failing label, rare labels get a floor, the
    rest is apportioned by largest remainders, and so are the categories of a cell.
    A model's cells are a bounded group: categories times labels.
    """
    import pandas as pd

    def apportion(total: int, sizes: dict) -> dict:
        live = {k: v for k, v in sizes.items() if v > 0}
        pool = sum(live.values())
        if total <= 0 or not pool:
            return {}
        want = {k: total * v / pool for k, v in live.items()}
        got = {k: min(live[k], int(want[k])) for k in live}
        order = sorted(live, key=lambda k: (-(want[k] - int(want[k])), str(k)))
        left = min(total, pool) - sum(got.values())
        while left > 0:
            for k in order:
                if left > 0 and got[k] < live[k]:
                    got[k] += 1
                    left -= 1
        return got

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.groupby(label)["population"].sum().to_dict()
        quota = {fails: min(sizes.get(fails, 0), int(round(per_model * share)))}
        for k in sorted(rare):
            quota[k] = max(0, min(sizes.get(k, 0), least_rare, per_model - sum(quota.values())))
        rest = {k: v - quota.get(k, 0) for k, v in sizes.items() if k != fails}
        for k, n in apportion(per_model - sum(quota.values()), rest).items():
            quota[k] = quota.get(k, 0) + n
        rows = []
        for k, part in pdf.groupby(label):
            got = apportion(quota.get(k, 0), dict(zip(part[category], part["population"])))
            rows += [(pdf[model].iloc[0], int(k), c, int(n), int(got.get(c, 0))) for c, n in zip(part[category], part["population"])]
        return pd.DataFrame(rows, columns=["model", "label", "category", "population", "quota"])

    return cells.groupBy(model).applyInPandas(plan, "model string, label int, category string, population long, quota long")
