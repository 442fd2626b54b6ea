"""Consensus from several annotators' labels (problem 5).

Minimax conditional entropy: given an item's label c, annotator i answers k on
item j with probability proportional to exp(sigma_i[c, k] + tau_j[c, k]). The
tilting parameters sigma (annotators) and tau (items) are fitted by regularised
dual coordinate ascent, alternating with the posteriors of the labels. tau_j and
the posterior of an item depend on sigma and the item's votes only, so items with
the same votes are one row with a count; a round is one pass over those rows that
returns, for each annotator seen, gradient and Hessian of a fixed size. Each row of
sigma is a block of the ascent and takes its full Newton step; a round that lowers
the dual objective is undone and its step halved. The fit ends when no parameter
moves by more than ``TOLERANCE``, however many rounds that takes, or when the
objective can't be raised any more; rounds and last change are reported.

The agreement of the votes is reported separately and takes no part in the fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

LABELS = 4
#: Regularisation of annotator and item parameters.
ALPHA, BETA = 2.0, 20.0
#: Newton steps of the items' parameters within a pass, and the change of sigma that ends the fit.
INNER, TOLERANCE = 2, 1e-3
#: Step below which an ascent that doesn't raise the objective any more has ended.
LEAST_STEP = 1e-4
#: Annotators whose parameters fit the driver: 50,000 x 96 doubles are 38 MB. More are refused.
MAX_ANNOTATORS = 50_000


def panel_votes(judged: DataFrame) -> DataFrame:
    """``item_id, annotator, label`` of the valid votes of the panels.

    The k-th vote is that of the k-th judge named in ``judge_model``. Failed
    votes - flagged, or of confidence 0 with an error text - and labels outside
    0..3 are no votes. Of differing rows of an item the one with most votes counts, then the
    first by judges and votes.
    """
    one = judged.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.min_by(F.struct("judge_model", "individual_judgments"), F.struct(-F.coalesce(F.size("individual_judgments"), F.lit(0)), F.col("judge_model"), F.to_json("individual_judgments"))).alias("r")
    )
    v = one.select(
        "item_id", F.split("r.judge_model", r"\+").alias("judges"), F.posexplode("r.individual_judgments").alias("at", "vote")
    )
    failed = F.coalesce(F.col("vote.failed"), F.lit(False)) | (
        (F.coalesce(F.col("vote.confidence"), F.lit(1.0)) == 0) & F.lower(F.coalesce(F.col("vote.justification"), F.lit(""))).contains("error")
    )
    return v.where(~failed & F.col("vote.label").between(0, LABELS - 1)).select(
        "item_id", F.concat(F.lit("judge:"), F.coalesce(F.get("judges", F.col("at")), F.col("at").cast("string"))).alias("annotator"),
        F.col("vote.label").cast("int").alias("label"),
    )


def human_votes(human: DataFrame) -> DataFrame:
    """``item_id, annotator, label``: per item and annotator the last label, if it is valid."""
    last = F.max_by("human_label", F.struct("labelled_at", F.coalesce("human_label", F.lit(-1))))
    return (
        human.where("item_id is not null and annotator is not null")
        .groupBy("item_id", F.concat(F.lit("human:"), F.col("annotator")).alias("annotator"))
        .agg(last.alias("label"))
        .where(F.col("label").between(0, LABELS - 1))
        .select("item_id", "annotator", F.col("label").cast("int").alias("label"))
    )


def all_votes(judged: DataFrame, human: DataFrame) -> DataFrame:
    """Votes on the items of ``judged``; human labels on unknown items are dropped."""
    known = judged.select("item_id").distinct()
    return panel_votes(judged).unionByName(human_votes(human).join(known, "item_id", "left_semi"))


def vote_patterns(votes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[str]]:
    """(``item_id, pattern, valid, top, distinct``, ``pattern, n``, annotators); a pattern is the sorted list of annotator*LABELS+label."""
    names = [r.annotator for r in votes.select("annotator").distinct().orderBy("annotator").limit(MAX_ANNOTATORS + 1).collect()]
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    ids = votes.sparkSession.createDataFrame([(a, i) for i, a in enumerate(names)], "annotator string, a int")
    coded = votes.join(F.broadcast(ids), "annotator").select("item_id", (F.col("a") * LABELS + F.col("label")).alias("v"), "label")
    items = coded.groupBy("item_id").agg(
        F.array_sort(F.collect_list("v")).alias("pattern"),
        *[F.count_if(F.col("label") == k).cast("int").alias(f"n{k}") for k in range(LABELS)],
    )
    items = scratch.cut(items)
    lanes = max(1, votes.sparkSession.sparkContext.defaultParallelism)
    return items, scratch.cut(items.groupBy("pattern").agg(F.count("*").alias("n")).repartition(lanes, "pattern")), names


def packed(votes: pa.ListArray) -> np.ndarray:
    """Lists of votes as rows of equal width, filled up with -1."""
    size = np.diff(votes.offsets.to_numpy())
    out = np.full((len(size), max(1, size.max(initial=1))), -1)
    out[np.arange(out.shape[1]) < size[:, None]] = votes.flatten().to_numpy(zero_copy_only=False)
    return out


class Items:
    """Posteriors and tilting parameters of items with the packed votes ``v``, for given sigma and prior."""

    def __init__(self, v: np.ndarray, sigma: np.ndarray, prior: np.ndarray, beta: float, inner: int = INNER) -> None:
        K, live = LABELS, v >= 0
        self.live, self.who, self.said = live, np.where(live, v // K, 0), np.where(live, v % K, 0)
        self.e = np.exp(sigma - sigma.max(axis=2, keepdims=True))[self.who]  # items, votes, true, said
        self.told = np.log(np.take_along_axis(self.e, self.said[:, :, None, None], axis=3)[..., 0])
        self.counts = ((self.said[:, :, None] == np.arange(K)) & live[:, :, None]).sum(axis=1).astype(float)
        self.log_prior, self.tau = np.log(prior), np.zeros((len(v), K, K))
        self._solve()
        for _ in range(inner):
            share = np.where(live[:, :, None], 1 / self.z, 0)
            p = np.einsum("nwck,nwc->nck", self.e, share) * self.t
            p2 = np.einsum("nwck,nwc->nck", self.e**2, share**2) * self.t**2
            g = self.q[:, :, None] * (self.counts[:, None, :] - p) - beta * self.tau
            self.tau = self.tau + g / (self.q[:, :, None] * (p - p2) + beta)
            self._solve()
        #: The dual objective of each item.
        self.value = self.log_mass - 0.5 * beta * (self.tau**2).sum(axis=(1, 2))

    def _solve(self) -> None:
        self.t = np.exp(self.tau)
        self.z = np.einsum("nwck,nck->nwc", self.e, self.t)
        ll = np.where(self.live[:, :, None], self.told - np.log(self.z), 0).sum(axis=1)
        ll += np.einsum("nk,nck->nc", self.counts, self.tau) + self.log_prior
        top = ll.max(axis=1, keepdims=True)
        q = np.exp(ll - top)
        mass = q.sum(axis=1, keepdims=True)
        self.q, self.log_mass = q / mass, (top + np.log(mass))[:, 0]

    def sums(self, weights: np.ndarray, annotators: int) -> np.ndarray:
        """Per annotator: expected answers observed and modelled, and the second moments of the model (6 blocks of K x K)."""
        K = LABELS
        w = np.where(self.live, 1.0, 0.0)[:, :, None] * (weights[:, None] * self.q)[:, None, :]
        p = self.e * self.t[:, None] / self.z[..., None]
        seen = np.zeros_like(p)
        np.put_along_axis(seen, self.said[:, :, None, None], 1.0, axis=3)
        wp = w[..., None] * p
        flat = np.concatenate([(w[..., None] * seen)[..., None], wp[..., None], wp[..., None] * p[..., None, :]], axis=4).reshape(-1, K * K * (K + 2))
        out = np.zeros((annotators, flat.shape[1]))
        who = self.who.ravel()
        order = np.argsort(who, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(who[order]) > 0]) if len(order) else np.zeros(0, int)
        if len(first):
            out[who[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        return out.reshape(annotators, K, K, K + 2)


#: Rows that are worked on at once.
_CHUNK = 4000


def one_round(patterns: DataFrame, sigma: np.ndarray, prior: np.ndarray, beta: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(dual objective of the items, expected label counts, sums per annotator) of one pass over the patterns."""
    sc = patterns.sparkSession.sparkContext
    sent = sc.broadcast((sigma, prior))
    K, size = LABELS, LABELS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pr = sent.value
        head, total = np.zeros(size), np.zeros((len(s), K, K, K + 2))
        for b in batches:
            v, w = packed(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False), float)
            for i in range(0, len(v), _CHUNK):
                items, wi = Items(v[i : i + _CHUNK], s, pr, beta), w[i : i + _CHUNK]
                total += items.sums(wi, len(s))
                head += np.r_[wi @ items.value, wi @ items.q]
        flat = np.r_[head, total.ravel()]
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.float64())], names=["i", "x"])

    rows = patterns.select("pattern", "n").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    sent.destroy()
    flat = np.zeros(size + sigma.size * (K + 2))
    flat[rows.i.to_numpy(int)] = rows.x.to_numpy()
    return flat[0], flat[1:size], flat[size:].reshape(*sigma.shape, K + 2)


class Fit:
    """Result of ``fit``: sigma, prior, expected answers per annotator, rounds, last change, objective of each round."""

    def __init__(self, sigma: np.ndarray, prior: np.ndarray) -> None:
        self.sigma, self.prior, self.observed = sigma, prior, np.zeros_like(sigma)
        self.rounds, self.change, self.objective = 0, math.inf, []


def fit(patterns: DataFrame, annotators: int, alpha: float = ALPHA, beta: float = BETA, tolerance: float = TOLERANCE) -> Fit:
    """Dual coordinate ascent until no parameter moves by more than ``tolerance``."""
    K = LABELS
    out = Fit(np.zeros((annotators, K, K)) + np.eye(K) * 1.5, np.full(K, 1 / K))
    base, step, size = None, None, 1.0
    while True:
        value, mass, sums = one_round(patterns, out.sigma, out.prior, beta)
        value -= 0.5 * alpha * (out.sigma**2).sum()
        out.rounds += 1
        if out.objective and value < out.objective[-1] - 1e-9 * abs(out.objective[-1]):
            # undone and tried again with half the step
            size /= 2
            out.sigma, out.prior = base[0] + size * step, base[1]
            if size < LEAST_STEP:
                out.sigma = base[0]
                break
            continue
        out.objective.append(value)
        out.observed = sums[..., 0]
        grad = sums[..., 0] - sums[..., 1] - alpha * out.sigma
        hess = -sums[..., 2:]
        hess[..., np.arange(K), np.arange(K)] += sums[..., 1] + alpha
        step = np.clip(np.linalg.solve(hess, grad[..., None])[..., 0], -1, 1)
        out.change = float(np.abs(step).max())
        prior = (mass + 1) / (mass.sum() + K)
        base, size = (out.sigma, prior), 1.0
        out.sigma, out.prior = out.sigma + step, prior
        if out.change < tolerance:
            break
    return out


def consensus(judged: DataFrame, human: DataFrame, **knobs: float) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: ``item_id, label, posterior, n_valid, agreement, disputed`` of every
    item with a valid vote; agreement is the share of the most frequent label and
    disputed marks three or more valid votes that are not all equal. annotators:
    ``annotator, n_votes, reliability, common_error, rounds, last_change`` with
    the expected share of right answers, the commonest confusion as "true>said",
    and how the fit ended.
    """
    spark = judged.sparkSession
    scratch = Scratch(spark, "consensus")
    votes = scratch.cut(all_votes(judged, human))
    items, patterns, names = vote_patterns(votes, scratch)
    kind = "item_id string, label int, posterior double, n_valid int, agreement double, disputed boolean"
    who = "annotator string, n_votes long, reliability double, common_error string, rounds int, last_change double"
    if not names:
        return spark.createDataFrame([], kind), spark.createDataFrame([], who)
    beta = knobs.setdefault("beta", BETA)
    found = fit(patterns, len(names), **knobs)
    sent = spark.sparkContext.broadcast((found.sigma, found.prior))
    counts = [f"n{k}" for k in range(LABELS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pr = sent.value
        for b in batches:
            # equal votes are solved once per batch
            v, back = np.unique(packed(b.column("pattern")), axis=0, return_inverse=True)
            parts = [Items(v[i : i + _CHUNK], s, pr, beta).q for i in range(0, len(v), _CHUNK)]
            q = np.concatenate(parts)[back.ravel()] if parts else np.zeros((0, LABELS))
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), *[b.column(c) for c in counts], pa.array(q.argmax(axis=1), pa.int32()), pa.array(q.max(axis=1, initial=0), pa.float64())],
                names=["item_id", *counts, "label", "posterior"],
            )

    solved = items.mapInArrow(run, "item_id string, " + ", ".join(f"{c} int" for c in counts) + ", label int, posterior double")
    valid = sum((F.col(c) for c in counts), F.lit(0))
    top = F.greatest(*counts)
    out = solved.select("item_id", "label", "posterior", valid.alias("n_valid"), (top / valid).alias("agreement"), ((valid >= 3) & (top < valid)).alias("disputed"))
    rows = []
    for a, o in zip(names, found.observed):
        off = o * (1 - np.eye(LABELS))
        c, k = np.unravel_index(off.argmax(), off.shape)
        rows.append((a, int(round(o.sum())), float(np.trace(o) / max(o.sum(), 1e-9)), f"{c}>{k}" if off.max() >= 1 else None, found.rounds, found.change))
    return out, spark.createDataFrame(rows, who)


def agreement_report(judged: DataFrame, human: DataFrame) -> DataFrame:
    """``item_id, agreement, agreement_rate, stale``: measured agreement of the panel beside the stored rate."""
    votes = panel_votes(judged).groupBy("item_id", "label").agg(F.count("*").alias("n"))
    own = votes.groupBy("item_id").agg((F.max("n") / F.sum("n")).alias("agreement"))
    stored = judged.groupBy("item_id").agg(F.min("agreement_rate").alias("agreement_rate"))
    return stored.join(own, "item_id", "left").select(
        "item_id", "agreement", "agreement_rate", (F.abs(F.col("agreement") - F.col("agreement_rate")) > 1e-6).alias("stale")
    )
