"""Vector geometry: exact neighbours, intrinsic dimension, density, centrality, curvature, oppositeness.

Exact neighbours run as blocks: the vectors are cut into blocks of bounded size,
every block of queries meets every block of the corpus in one matrix product. A
task keeps the k best of a block of queries over all the blocks it sees, so that
few candidates leave it; it holds two blocks at a time, whatever the size of the
table. Their work is quadratic. For large tables there is an index of inverted
lists: centres are fitted on a bounded sample, every row is in the list of its
nearest centre, and a query looks into the lists of its nearest centres only;
``index_recall`` measures it against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Vectors per block.
BLOCK = 4096
EPS = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _blocks(df: DataFrame, id_col: str, vec: str, n: int, names: tuple[str, str, str]) -> DataFrame:
    b, i, v = names
    return (
        df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(b), F.col(id_col).alias("_i"), F.col(vec).cast("array<double>").alias("_v"))
        .groupBy(b).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_r"))
        .select(b, F.transform("_r", lambda r: r["_i"]).alias(i), F.transform("_r", lambda r: r["_v"]).alias(v))
    )


def knn(
    queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vec: str = "v", metric: str = "cosine", exclude_self: bool = True, block: int = BLOCK
) -> DataFrame:
    """``id, rank, nbr, dist``: the k nearest rows of ``corpus`` per query, ties to the smaller id.

    Null and empty vectors take no part. ``exclude_self`` drops the row of the same id.
    """
    nq, nc = (max(1, -(-d.count() // block)) for d in (queries, corpus))
    left, right = _blocks(queries, id_col, vec, nq, ("qb", "qi", "qv")), _blocks(corpus, id_col, vec, nc, ("cb", "ci", "cv"))
    # every block of queries against every block of the corpus: a block is one row
    jobs = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).join(right, "cb")
    return _nearest(jobs.withColumn("job", F.col("qb")), k, nq, nc, queries.schema[id_col].dataType.simpleString(), metric, exclude_self)


def _nearest(jobs: DataFrame, k: int, blocks: int, each: int, kind: str, metric: str, exclude_self: bool) -> DataFrame:
    """The k nearest per query over jobs ``job, qi, qv, cb, ci, cv``; a job is a block of queries, met by ``each`` blocks at most.

    The blocks of a job are spread over as many lanes as the cluster has use for;
    a lane keeps its k best.
    """
    lanes = int(max(1, min(each, -(-4 * jobs.sparkSession.sparkContext.defaultParallelism // max(1, blocks)))))
    laid = jobs.select("job", F.pmod(F.xxhash64("cb"), F.lit(lanes)).alias("lane"), "qi", "qv", "ci", "cv").repartition(max(1, min(blocks * lanes, 20_000)), "job", "lane").sortWithinPartitions("job", "lane")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, best_d, best_i = None, None, None, None

        def out() -> pd.DataFrame:
            ok = np.isfinite(best_d)
            return pd.DataFrame({"id": np.repeat(ids, ok.sum(axis=1)), "nbr": best_i[ok], "dist": best_d[ok]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, c = np.vstack(list(r.qv)), np.vstack(list(r.cv))
                if metric == "cosine":
                    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                    d = 1 - q @ c.T
                else:
                    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * q @ c.T, 0))
                qi, ci = np.asarray(r.qi), np.asarray(r.ci)
                if exclude_self:
                    d[qi[:, None] == ci[None]] = np.inf
                # more than k, as equal vectors differ in the last bits
                m = min(k + 8, d.shape[1])
                top = np.argpartition(d, m - 1, axis=1)[:, :m]
                dist, nbr = np.take_along_axis(d, top, axis=1), ci[top]
                if (r.job, r.lane) != held:
                    if held is not None:
                        yield out()
                    held, ids, best_d, best_i = (r.job, r.lane), qi, dist, nbr
                    continue
                dist, nbr = np.hstack([best_d, dist]), np.hstack([best_i, nbr])
                keep = np.argpartition(dist, min(k + 8, dist.shape[1]) - 1, axis=1)[:, : k + 8]
                best_d, best_i = np.take_along_axis(dist, keep, axis=1), np.take_along_axis(nbr, keep, axis=1)
        if held is not None:
            yield out()

    near = laid.mapInPandas(run, f"id {kind}, nbr {kind}, dist double")
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.collect_list(F.struct("dist", "nbr")))), 1, k).alias("b"))
    return best.select("id", F.posexplode("b").alias("p", "x")).select("id", (F.col("p") + 1).alias("rank"), F.col("x.nbr").alias("nbr"), F.col("x.dist").alias("dist"))


#: Rows on which the centres of an index are fitted, and the most lists it has: centres are sent to all tasks.
INDEX_SAMPLE, MAX_LISTS = 50_000, 4096


def fit_index(corpus: DataFrame, k: int = 10, target: float = 0.95, lists: int | None = None, id_col: str = "id", vec: str = "v", rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, int]:
    """(centres, probes) of an index, fitted on at most ``INDEX_SAMPLE`` rows in the order of their hash.

    Centres come from k-means on directions. ``probes`` is the least number of
    lists in which the rows of the sample find ``target`` of their k exact
    neighbours within the sample, so that it rises where vectors form no clusters.
    """
    d = corpus.where(F.col(vec).isNotNull() & (F.size(vec) > 0))
    n = d.count()
    lists = min(MAX_LISTS, lists or max(1, int(np.sqrt(n))))
    rows = d.select(F.xxhash64(id_col).alias("h"), F.col(vec).cast("array<double>").alias("v")).orderBy("h").limit(INDEX_SAMPLE).toPandas()
    if not len(rows):
        return np.zeros((1, 1)), 1
    x = np.vstack(list(rows["v"]))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    asked = x[:500]
    near = -(asked @ x.T)
    near[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = max(1, min(k, len(x) - 1))
    nbrs = np.argpartition(near, k - 1, axis=1)[:, :k]
    home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[nbrs], axis=1).ravel()) + 1
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def in_lists(df: DataFrame, centres: np.ndarray, probes: int, id_col: str = "id", vec: str = "v") -> DataFrame:
    """``id, v, list``: each row once for each of its ``probes`` nearest lists; null and empty vectors are in none."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(centres)
    probes = min(probes, len(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for pdf in batches:
            if len(pdf):
                x = np.vstack(list(pdf["v"]))
                near = np.argpartition(-(x @ c.T), probes - 1, axis=1)[:, :probes]
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), probes), "v": [v for v in pdf["v"] for _ in range(probes)], "list": near.ravel().astype("int32")})

    rows = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"id {kind}, v array<double>, list int")


def knn_index(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, probes: int, id_col: str = "id", vec: str = "v", block: int = BLOCK) -> DataFrame:
    """``id, rank, nbr, dist`` by the index. Every row of ``corpus`` is indexed; a long list is cut into blocks, none is capped."""
    kind = queries.schema[id_col].dataType.simpleString()
    q, c = in_lists(queries, centres, probes, id_col, vec), in_lists(corpus, centres, 1, id_col, vec)

    def cut(df: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        n = df.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_n"))
        d = df.join(F.broadcast(n), "list").select("list", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias(names[0]), "id", "v")
        g = d.groupBy("list", names[0]).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("_r"))
        return g.select("list", names[0], F.transform("_r", lambda r: r["id"]).alias(names[1]), F.transform("_r", lambda r: r["v"]).alias(names[2]))

    jobs = cut(q, ("qb", "qi", "qv")).join(cut(c, ("cb", "ci", "cv")), "list").withColumn("job", F.xxhash64("list", "qb"))
    return _nearest(jobs, k, len(centres), 1, kind, "cosine", True)


def index_recall(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """``neighbours, found, recall`` of the index against the exact search."""
    a = knn(queries, corpus, k).select("id", "nbr")
    b = knn_index(queries, corpus, k, centres, probes).select("id", "nbr").withColumn("_hit", F.lit(1))
    g = a.join(b, ["id", "nbr"], "left").agg(F.count("*").alias("neighbours"), F.count("_hit").alias("found"))
    return g.withColumn("recall", F.try_divide("found", "neighbours"))


def knn_expressions(df: DataFrame, k: int, id_col: str = "id", vec: str = "v") -> DataFrame:
    """The same neighbours stated with expressions alone, as a check of ``knn``; the planner chooses the join."""
    u = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).withColumn("n", norm(F.col("v")))
    o = u.select(F.col("id").alias("nbr"), F.col("v").alias("w"), F.col("n").alias("m"))
    d = u.join(o, F.col("id") != F.col("nbr")).select("id", "nbr", (1 - dot(F.col("v"), F.col("w")) / (F.col("n") * F.col("m"))).alias("dist"))
    return d.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "nbr"))), 1, k).alias("b"))


def local_id(nn: DataFrame) -> DataFrame:
    """TwoNN dimension per point: 1 / ln(r2 / r1); null unless 0 < r1 < r2."""
    g = nn.where("rank <= 2").groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("r2"))
    return g.select("id", F.when((F.col("r1") > 0) & (F.col("r1") < F.col("r2")), 1 / F.log(F.col("r2") / F.col("r1"))).alias("local_id"))


def twonn(nn: DataFrame) -> DataFrame:
    """Global maximum-likelihood dimension over the valid points."""
    return local_id(nn).where("local_id is not null").agg(F.count("*").alias("n"), (1 / F.avg(1 / F.col("local_id"))).alias("dimension"))


def density(nn_with_self: DataFrame) -> DataFrame:
    """1 / (mean distance of the k nearest, the point itself among them)."""
    return nn_with_self.groupBy("id").agg((1 / (F.avg("dist") + EPS)).alias("density"))


def corpus_mean(df: DataFrame, vec: str = "v") -> DataFrame:
    """One row: per-dimension mean and population deviation as arrays."""
    d = df.select(F.posexplode(F.col(vec)).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    return d.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("a")).select(F.transform("a", lambda r: r["m"]).alias("mean"), F.transform("a", lambda r: r["s"]).alias("std"))


def centrality(df: DataFrame, id_col: str = "id", vec: str = "v", metric: str = "cosine") -> DataFrame:
    """Distance of every vector to the mean; the mean is one row."""
    j = df.crossJoin(F.broadcast(corpus_mean(df, vec).select("mean")))
    v, m = F.col(vec), F.col("mean")
    if metric == "cosine":
        c = 1 - dot(v, m) / ((norm(v) + EPS) * (norm(m) + EPS))
    elif metric == "euclidean":
        c = F.sqrt(F.aggregate(F.zip_with(v, m, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    else:
        raise ValueError(f"unknown metric {metric}")
    return j.select(F.col(id_col).alias("id"), c.alias("centrality"))


def z_normalise(df: DataFrame, value: str) -> DataFrame:
    s = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def curvature(df: DataFrame, nn: DataFrame, dims: DataFrame, id_col: str = "id", vec: str = "v") -> DataFrame:
    """1 - variance explained by the leading components of a point and its neighbours.

    The number of components is the local dimension clipped to [1, k] and cut to
    an integer (k // 2 if undefined), at most points - 1 and the vector size. A
    neighbourhood is k + 1 vectors; its eigenvalues come from the Gram matrix.
    """
    kind = df.schema[id_col].dataType.simpleString()
    v = df.select(F.col(id_col).alias("nbr"), F.col(vec).cast("array<double>").alias("w"))
    own = df.select(F.col(id_col).alias("id"), F.col(id_col).alias("nbr"))
    sets = nn.select("id", "nbr").unionByName(own).join(v, "nbr").groupBy("id").agg(F.collect_list("w").alias("ws")).join(dims, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.vstack(list(r.ws))
                n, k = len(x), len(x) - 1
                c = k // 2 if r.local_id is None or not np.isfinite(r.local_id) else int(np.clip(r.local_id, 1, k))
                c = min(c, n - 1, x.shape[1])
                x = x - x.mean(axis=0)
                e = np.clip(np.linalg.eigvalsh(x @ x.T)[::-1], 0, None)
                out.append(None if n < 2 or c < 1 or e.sum() <= 1e-15 else float(1 - e[:c].sum() / e.sum()))
            yield pd.DataFrame({"id": pdf["id"], "curvature": pd.array(out, "Float64")})

    return sets.select("id", "ws", "local_id").mapInPandas(run, f"id {kind}, curvature double")


def global_pca(df: DataFrame, n: int, vec: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained variance) from the second moments, summed per partition: dim x dim numbers each."""
    dim = df.select(F.size(vec)).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, m, c = np.zeros(dim), np.zeros((dim, dim)), 0
        for pdf in batches:
            if len(pdf):
                x = np.vstack([np.asarray(a, float) for a in pdf.iloc[:, 0]])
                s, m, c = s + x.sum(0), m + x.T @ x, c + len(x)
        flat = np.r_[c, s, m.ravel()]
        yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    flat = df.select(F.col(vec).cast("array<double>")).mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i").x.to_numpy()
    c, s, m = flat[0], flat[1 : dim + 1], flat[dim + 1 :].reshape(dim, dim)
    mean = s / c
    cov = (m - c * np.outer(mean, mean)) / max(1, c - 1)
    val, vecs = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:n]
    return mean, vecs[:, order].T, val[order]


def oppositeness(df: DataFrame, n_components: int, n_flip: int, id_col: str = "id", vec: str = "v") -> DataFrame:
    """Distance from a point, reflected in its first ``n_flip`` principal coordinates, to the nearest vector (itself allowed)."""
    mean, comp, _ = global_pca(df, n_components, vec)
    kind = df.schema[id_col].dataType.simpleString()

    def flip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack([np.asarray(a, float) for a in pdf["v"]])
            p = (x - mean) @ comp.T
            p[:, :n_flip] *= -1
            yield pd.DataFrame({"id": pdf["id"], "v": list(p @ comp + mean)})

    base = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    turned = base.mapInPandas(flip, f"id {kind}, v array<double>")
    return knn(turned, base, 1, exclude_self=False).select("id", F.col("dist").alias("oppositeness"))


def risk_score(density_: Column, centrality_: Column) -> Column:
    """Mean of 1 / (1 + density) and centrality; from 0.5 on risky."""
    return (1 / (1 + density_) + centrality_) / 2


def steering_choice(candidates: DataFrame, item: str, original: str, least: float = 0.1) -> DataFrame:
    """Per item the rephrasing with the least risk (first on ties), its reduction, and success if it is large enough."""
    g = candidates.groupBy(item).agg(F.min(original).alias("original_risk"), F.min_by("choice", F.struct("risk", "choice")).alias("choice"), F.min("risk").alias("risk"))
    red = F.greatest(F.col("original_risk") - F.col("risk"), F.lit(0.0))
    return g.withColumn("reduction", red).withColumn("success", red > least)


def features(df: DataFrame, k_dim: int = 20, k_curve: int = 20, k_density: int = 10, n_flip: int = 3, id_col: str = "id", vec: str = "v") -> DataFrame:
    """local_id, density, centrality and curvature per vector from one neighbour search."""
    base = df.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    near = Scratch(df.sparkSession, "neighbours").cut(knn(base, base, max(k_dim, k_curve, k_density)))
    self_rows = base.select("id", F.lit(0.0).alias("dist"))
    dens = density(near.where(F.col("rank") <= k_density - 1).select("id", "dist").unionByName(self_rows))
    dims = local_id(near)
    curve = curvature(base, near.where(F.col("rank") <= k_curve), dims)
    return dims.join(dens, "id").join(centrality(base), "id").join(curve, "id", "left")


def grid_counts(df: DataFrame, x: Column, y: Column, cells: int) -> DataFrame:
    """Rows per cell of a grid over [-1, 1]^2."""
    cell = lambda c: F.least(F.greatest(F.floor((c + 1) / 2 * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    return df.groupBy(cell(x).alias("gx"), cell(y).alias("gy")).agg(F.count("*").alias("n"))
