"""Splits that keep related records together (problem 2).

Records that share an entity or a template, directly or through others, form a
component; a component gets one split. Components come from a contracted graph:
its nodes are the keys, its edges the distinct (entity, template) pairs, so a key
that holds a third of all rows is one node. Labels spread by alternating
large-star and small-star rounds, a logarithmic number of them, each written to
the shared folder.

Splits are placed by grouped iterative stratification: label counts are summed
per component; components are taken with the rarest outstanding label first and
go to the split that needs that label most. Components above a fixed share of
all records number at most the inverse of that share and are placed first, on
the driver; the others are placed in parallel lanes, each lane filling its part
of what the large ones left open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .text import entity_key, template_key, vectorised

#: A component with more than this share of all records is placed on the driver: at most 1/share of them.
LARGE_SHARE = 1e-3
#: Records per lane; lanes are independent tasks.
LANE_RECORDS = 200_000
MAX_ROUNDS = 40


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node of ``edges`` (u, v: strings or 16-byte keys); root is the component's smallest node.

    Null ends and self-loops are dropped. A node's neighbourhood is never
    gathered: the minimum is a map-side combined aggregate that is joined back,
    and the adaptive planner splits a skewed join.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = scratch.cut(now.distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = scratch.cut(small)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def related_groups(
    df: DataFrame, id_col: str = "id", entity: Column | str = "entity", template: Column | str = "metadata.template"
) -> DataFrame:
    """``id, root``: every record with the smallest id of its group.

    Null, blank and placeholder entities and templates link nothing; a record
    without links is its own group. Repeated rows are one record; if versions of
    a record differ, all their links count. A null id is no record.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "groups")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keyed = scratch.cut(
        df.where(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).cast("string").alias("id"),
            F.unhex(F.md5(F.concat(F.lit("e"), vectorised(entity_key)(col(entity))))).alias("e"),
            F.unhex(F.md5(F.concat(F.lit("t"), vectorised(template_key)(col(template))))).alias("t"),
        )
    )
    repeated = keyed.groupBy("id").agg(F.count("*").alias("n"), F.min("e").alias("e"), F.min("t").alias("t")).where("n > 1")
    # versions of one record: each of their keys is tied to the record's first key
    ties = keyed.join(repeated.select("id", F.coalesce("e", "t").alias("k")), "id").select(
        F.explode(F.array("e", "t")).alias("u"), F.col("k").alias("v")
    )
    pairs = keyed.groupBy("e", "t").agg(F.min("id").alias("id"))
    root = components(pairs.select(F.col("e").alias("u"), F.col("t").alias("v")).unionByName(ties), scratch)
    key = F.coalesce("e", "t")
    smallest = (
        pairs.select(key.alias("node"), "id")
        .where("node is not null")
        .join(root, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("id").alias("first"))
    )
    named = (
        pairs.select("e", "t", key.alias("node"))
        .where("node is not null")
        .join(root, "node", "left")
        .select("e", "t", F.coalesce("root", "node").alias("root"))
        .join(smallest, "root")
        .select(key.alias("node"), "first")
        .distinct()
    )
    return (
        keyed.select("id", key.alias("node"))
        .distinct()
        .join(named, "node", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("first", "id")).alias("root"))
    )


def group_pairs(df: DataFrame, **cols: str) -> DataFrame:
    """``id_a, id_b``: each record that is not the smallest id of its group, with that smallest id."""
    return related_groups(df, **cols).where("id <> root").select(F.col("root").alias("id_a"), F.col("id").alias("id_b"))


def place(counts: np.ndarray, need: np.ndarray, total_need: np.ndarray) -> np.ndarray:
    """Split index per row of ``counts`` (components x labels); ``need`` (splits x labels) is used up.

    The rarest label still outstanding is served first; within it larger
    components come first. Ties go to the split with the larger open total, then
    to the earlier split.
    """
    out = np.full(len(counts), -1)
    left = counts.sum(axis=0).astype(float)
    size = counts.sum(axis=1)
    has = [np.flatnonzero(counts[:, k])[np.argsort(-counts[counts[:, k] > 0, k], kind="stable")] for k in range(counts.shape[1])]
    at = [0] * counts.shape[1]
    todo = len(counts)
    while todo:
        live = np.flatnonzero(left > 1e-9)
        if not len(live):
            for i in np.flatnonzero(out < 0):
                s = int(np.argmax(total_need))
                out[i] = s
                total_need[s] -= size[i]
            break
        k = int(live[np.argmin(left[live])])
        rows = has[k]
        while at[k] < len(rows) and out[rows[at[k]]] >= 0:
            at[k] += 1
        if at[k] >= len(rows):
            left[k] = 0
            continue
        i = rows[at[k]]
        s = max(range(len(need)), key=lambda j: (need[j, k], total_need[j], -j))
        out[i] = s
        need[s] -= counts[i]
        total_need[s] -= size[i]
        left -= counts[i]
        todo -= 1
    return out


def assign_splits(
    records: DataFrame,
    groups: DataFrame,
    label: str,
    proportions: dict[str, float] | None = None,
    large_share: float = LARGE_SHARE,
    lane_records: int = LANE_RECORDS,
) -> DataFrame:
    """``root, split, n`` for every group of ``groups`` (id, root).

    ``label`` (a column of ``records``; null is a label of its own) must have a
    bounded number of values: they are counted on the driver. An empty input
    gives no rows.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    names, share = list(proportions), np.array(list(proportions.values()), float)
    share = share / share.sum()
    spark = records.sparkSession
    scratch = Scratch(spark, "splits")
    once = records.groupBy(F.col("id").cast("string").alias("id")).agg(
        F.coalesce(F.min(F.col(label).cast("string")), F.lit("\0")).alias("label")
    )
    cells = scratch.cut(groups.join(once, "id").groupBy("root", "label").agg(F.count("*").alias("n")))
    totals = {r.label: r.n for r in cells.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()}
    schema = "root string, split string, n long"
    if not totals:
        return spark.createDataFrame([], schema)
    labels = list(totals)
    sums = np.array([totals[x] for x in labels], float)
    whole = cells.groupBy("root").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"l{k}") for k, x in enumerate(labels)], F.sum("n").alias("n"))
    whole = scratch.cut(whole)
    bound = max(1.0, large_share * sums.sum())
    big = whole.where(F.col("n") > bound).orderBy(F.desc("n"), "root").toPandas() if large_share < 1 else whole.limit(0).toPandas()
    need = share[:, None] * sums[None, :]
    open_ = share * sums.sum()
    cols = [f"l{k}" for k in range(len(labels))]
    rows = big[cols].to_numpy(float)
    chosen = place(rows, need, open_) if len(big) else []
    fixed = spark.createDataFrame([(r, names[s], int(n)) for r, s, n in zip(big.get("root", []), chosen, big.get("n", []))], schema)
    rest = whole.where(F.col("n") <= bound)
    lanes = int(max(1, np.ceil((sums.sum() - rows.sum()) / lane_records)))
    share_left = np.maximum(need, 0) / np.maximum(np.maximum(need, 0).sum(axis=0), 1e-9)
    open_left = np.maximum(open_, 0) / max(np.maximum(open_, 0).sum(), 1e-9)

    def lane(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "root"], ascending=[False, True])
        c = pdf[cols].to_numpy(float)
        s = place(c, share_left * c.sum(axis=0), open_left * c.sum())
        return pd.DataFrame({"root": pdf.root, "split": [names[k] for k in s], "n": pdf.n})

    small = (
        rest.withColumn("lane", F.pmod(F.xxhash64("root"), F.lit(lanes)))
        .groupBy("lane")
        .applyInPandas(lambda pdf: lane(pdf), schema)
    )
    return fixed.unionByName(small)


def split_records(df: DataFrame, label: str = "category") -> DataFrame:
    """``id, root, assigned`` for each record."""
    groups = related_groups(df)
    groups = Scratch(df.sparkSession, "members").cut(groups)
    placed = assign_splits(df.select("id", label), groups, label)
    return groups.join(placed.select("root", F.col("split").alias("assigned")), "root").select("id", "root", "assigned")


def split_report(df: DataFrame, label: str = "category") -> DataFrame:
    """``assigned, records, groups, share, label_gap`` of each split.

    ``label_gap`` is the largest difference, over the labels, between the split's
    share of a label's records and its share of all records: 0 is a perfect
    stratification. Groups that hold much of a label set a floor to it.
    """
    spark = df.sparkSession
    placed = Scratch(spark, "report").cut(split_records(df, label))
    once = df.groupBy(F.col("id").cast("string").alias("id")).agg(F.coalesce(F.min(F.col(label).cast("string")), F.lit("\0")).alias("label"))
    cells = placed.join(once, "id").groupBy("assigned", "label").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("label")
    by_split = Window.partitionBy("assigned")
    gaps = (
        cells.withColumn("of_label", F.col("n") / F.sum("n").over(by_label)).withColumn("records", F.sum("n").over(by_split))
        .join(F.broadcast(cells.agg(F.sum("n").alias("total"))), F.lit(True))
        .groupBy("assigned").agg(F.max("records").alias("records"), F.max("total").alias("total"), F.max(F.abs(F.col("of_label") - F.col("records") / F.col("total"))).alias("label_gap"))
    )
    groups = placed.groupBy("assigned").agg(F.countDistinct("root").alias("groups"))
    return gaps.join(groups, "assigned").select("assigned", "records", "groups", (F.col("records") / F.col("total")).alias("share"), "label_gap")
