"""Integrity audits, set comparisons, merges and resumption of keyed logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, name: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """``dataset, issue, n``: rows that fail each check, plus rows and duplicate keys, in one pass and one key aggregate."""
    marks = [F.struct(F.lit(k).alias("issue"), F.coalesce(c, F.lit(False)).alias("bad")) for k, c in checks.items()]
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(m["bad"]).alias(f"c{i}") for i, m in enumerate(marks)])
    cells = [F.struct(F.lit("rows").alias("issue"), F.col("rows").alias("n")), *[F.struct(F.lit(k).alias("issue"), F.col(f"c{i}").alias("n")) for i, k in enumerate(checks)]]
    dup = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_key").alias("issue"), "n")
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.issue", "x.n").unionByName(dup).select(F.lit(name).alias("dataset"), "issue", "n")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return x.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def remaining(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unrecovered(log: DataFrame, keys: list[str], ok: Column, order: str, error: str) -> DataFrame:
    """Keys without any success, with the error of their last attempt."""
    g = log.groupBy(*keys).agg(F.bool_or(ok).alias("_ok"), F.max_by(error, order).alias("last_error"), F.count("*").alias("attempts"))
    return g.where(~F.coalesce("_ok", F.lit(False))).drop("_ok")


def merge_membership(parts: dict[str, DataFrame], key: str, *cols: str) -> DataFrame:
    """Union by key with one membership flag per part; columns come from the first part that has the key."""
    u = None
    for i, (name, df) in enumerate(parts.items()):
        p = df.select(key, *cols).withColumns({"_o": F.lit(i), **{f"in_{n}": F.lit(n == name) for n in parts}})
        u = p if u is None else u.unionByName(p)
    return u.groupBy(key).agg(F.min_by(F.struct(*cols), "_o").alias("r"), *[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in parts]).select(key, "r.*", *[f"in_{n}" for n in parts])


def first_by_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per trimmed text, the one with the smallest key."""
    return df.where(F.col(text).isNotNull()).groupBy(F.trim(text).alias("norm")).agg(F.min(F.col(key).cast("string")).alias(key), F.count("*").alias("copies"))


def renumber(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``new_idx`` from 0 within each key."""
    return df.withColumn("new_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def encode_id(prompt: Column, code: Column, sample: Column) -> Column:
    """prompt-CODE-02d."""
    return F.format_string("%s-%s-%02d", prompt, code, sample)


def decode_id(c: Column) -> Column:
    p = r"^(.*)-([^-]+)-(\d+)$"
    return F.struct(F.regexp_extract(c, p, 1).alias("prompt"), F.regexp_extract(c, p, 2).alias("code"), F.regexp_extract(c, p, 3).cast("int").alias("sample"))


def substitution_key(m: Column) -> Column:
    """A set-valued key of a map: its entries sorted, as JSON."""
    return F.to_json(F.array_sort(F.map_entries(m)))


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, least: int = 4, limit: int = 50_000) -> DataFrame:
    """Texts that contain a term, ignoring case.

    Terms are a dimension whose size is checked: they are broadcast in blocks of
    about ``limit``, each matched as a substring.
    """
    t = terms.where(F.length(term) >= least).select(F.lower(term).alias("_t")).distinct()
    low = texts.withColumn("_x", F.lower(F.coalesce(text, F.lit(""))))
    blocks = max(1, -(-t.count() // limit))
    block = F.pmod(F.xxhash64("_t"), F.lit(blocks))
    parts = [low.join(F.broadcast(t.where(block == i)), F.contains(F.col("_x"), F.col("_t"))) for i in range(blocks)]
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("_t", "term").drop("_x")
