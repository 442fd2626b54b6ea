"""Reconciliation of judge panels: arrays of votes (label, confidence, justification, failed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = (0, 1, 2, 3)


def failed_vote(v: Column) -> Column:
    """Flagged as failed, or confidence 0 with an error text."""
    text = F.lower(F.coalesce(v["justification"], F.lit("")))
    return F.coalesce(v["failed"], F.lit(False)) | ((F.coalesce(v["confidence"], F.lit(1.0)) == 0.0) & text.contains("error"))


def real_votes(votes: Column) -> Column:
    """Votes that did not fail and have a label."""
    return F.filter(votes, lambda v: ~failed_vote(v) & v["label"].isNotNull())


def _count(votes: Column, k: int) -> Column:
    return F.size(F.filter(votes, lambda v: v["label"] == k))


def _first(votes: Column, k: int) -> Column:
    return F.coalesce(F.array_position(F.transform(votes, lambda v: v["label"]), F.lit(k)), F.lit(0))


def majority(votes: Column) -> Column:
    """Struct (label, agreement, confidence): most votes, ties to the vote that came first.

    Failed votes are left out; if all failed, all labelled votes count. No vote: nulls.
    """
    used = F.when(F.size(real_votes(votes)) > 0, real_votes(votes)).otherwise(F.filter(votes, lambda v: v["label"].isNotNull()))
    n = F.size(used)
    best = F.greatest(*[F.struct(_count(used, k).alias("c"), (-_first(used, k)).alias("p"), F.lit(k).alias("k")) for k in LABELS])
    agree = best["c"] / n
    mean = F.aggregate(used, F.lit(0.0), lambda a, v: a + F.coalesce(v["confidence"], F.lit(0.0))) / n
    return F.when(n > 0, F.struct(best["k"].alias("label"), agree.alias("agreement"), (agree * mean).alias("confidence")))


def recompute(votes: Column) -> Column:
    """Struct (label, confidence, agreement, method) from the votes that did not fail.

    None or one: nulls. Two: equal labels keep the mean confidence; else the more
    confident (ties: the first) at half the mean. Three or more: majority.
    """
    r = real_votes(votes)
    n, a, b = F.size(r), F.get(r, F.lit(0)), F.get(r, F.lit(1))
    mean = F.aggregate(r, F.lit(0.0), lambda s, v: s + F.coalesce(v["confidence"], F.lit(0.0))) / F.greatest(n, F.lit(1))
    s = lambda lab, conf, agr, m: F.struct(lab.cast("int").alias("label"), conf.alias("confidence"), agr.alias("agreement"), F.lit(m).alias("method"))
    none = F.lit(None).cast("double")
    m = majority(votes)
    return (
        F.when(n < 2, s(F.lit(None), none, none, "insufficient"))
        .when((n == 2) & (a["label"] == b["label"]), s(a["label"], mean, F.lit(1.0), "two_agree"))
        .when(n == 2, s(F.when(b["confidence"] > a["confidence"], b["label"]).otherwise(a["label"]), 0.5 * mean, F.lit(0.5), "higher_confidence"))
        .otherwise(s(m["label"], m["confidence"], m["agreement"], "majority"))
    )


def correction_class(votes: Column) -> Column:
    """none, clean, one_failure_agree, one_failure_disagree or several_failures."""
    n, f = F.size(votes), F.size(votes) - F.size(real_votes(votes))
    r = real_votes(votes)
    return (
        F.when(votes.isNull() | (n == 0), "none").when(f == 0, "clean").when(f >= 2, "several_failures")
        .when(F.get(r, F.lit(0))["label"] == F.get(r, F.lit(1))["label"], "one_failure_agree").otherwise("one_failure_disagree")
    )


def leave_one_out(df: DataFrame, votes: str, label: str) -> DataFrame:
    """One row per record and excluded judge: the label of the others' majority, the old label if none is left."""
    x = df.withColumn("excluded", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    left = F.filter(F.transform(F.col(votes), lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["i"] != F.col("excluded"))
    rest = F.transform(left, lambda s: s["v"])
    return x.withColumn("relabel", F.coalesce(majority(rest)["label"], F.col(label)))


def agreement_type(votes: Column) -> Column:
    """unanimous, majority (two or more agree) or split, over labelled votes."""
    labs = F.filter(F.transform(votes, lambda v: v["label"]), lambda x: x.isNotNull())
    top = F.greatest(*[_count(F.filter(votes, lambda v: v["label"].isNotNull()), k) for k in LABELS])
    return F.when(F.size(labs) == 0, F.lit(None)).when(F.size(F.array_distinct(labs)) == 1, "unanimous").when(top >= 2, "majority").otherwise("split")


def parse_response(text: Column) -> Column:
    """Struct (label, confidence, justification, mixed, error) of a judge's JSON reply, fences stripped.

    Instead of raising, a reply without the three fields or out of range has ``error``.
    """
    body = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
    j = F.from_json(body, "label int, confidence double, justification string, mixed_rejection_then_fabrication boolean")
    err = (
        F.when(j.isNull() | (j["label"].isNull() & j["confidence"].isNull() & j["justification"].isNull()), "not json")
        .when(j["label"].isNull() | j["confidence"].isNull() | j["justification"].isNull(), "missing field")
        .when(~j["label"].between(0, 3), "label out of range").when(~j["confidence"].between(0, 1), "confidence out of range")
    )
    return F.struct(
        j["label"].alias("label"), j["confidence"].alias("confidence"), j["justification"].alias("justification"),
        F.coalesce(j["mixed_rejection_then_fabrication"], F.lit(False)).alias("mixed"), err.alias("error"),
    )
