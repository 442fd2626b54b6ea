"""Judged logs, ranges, resampling, index and plans against brute force and defined edge cases."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pvalues, text
from plumbline.operators import corpus, geometry, judging, ranks, resample, sampling, stats


def test_running_sums_over_ranges_against_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if i % 7 else None, rng.randrange(50), i, 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, t int, n int")
    got = {(r.g, r.t): r.s for r in ranks.running(df, [F.desc("v"), F.asc("t")], {"s": "n"}, "g").collect()}
    p = pd.DataFrame(rows, columns=list("gvtn")).sort_values(["v", "t"], ascending=[False, True])
    p["s"] = p.groupby("g", dropna=False)["n"].cumsum()
    assert got == {(r.g if isinstance(r.g, str) else None, r.t): r.s for r in p.itertuples()}
    assert ranks.running(df.limit(0), [F.asc("v")], {"s": "n"}).count() == 0


def test_equal_frequency_against_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=200), np.zeros(40)].round(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id int, x double")
    got = {r.id: r.bin for r in ranks.equal_frequency(df, "x", 5).collect()}
    want = pd.qcut(x, 5, labels=False, duplicates="drop")
    assert got == dict(enumerate(want.tolist()))
    assert ranks.equal_frequency(df.limit(3), "x", 5).count() == 0


def test_top_fraction_and_roc_against_sorting(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(20) / 20, rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    best = sorted(rows, key=lambda r: (-r[1], r[0]))
    for r in ranks.threshold_table(df, "s", "y", [0.001, 0.1, 0.5], "id").collect():
        n = int(300 * r.fraction + 1e-9)
        assert (r.flagged, r.tp) == (n, sum(x[2] for x in best[:n]))
    for r in ranks.roc_points(df, "s", "y").collect():
        assert r.tp == sum(y for _, s, y in rows if s >= r.s) and r.fp == sum(1 - y for _, s, y in rows if s >= r.s)


def test_fisher_against_enumeration():
    def brute(a, b, c, d):
        r1, r2, c1 = a + b, c + d, a + c
        if 0 in (r1, r2, c1, b + d):
            return 1.0
        p = {x: math.comb(r1, x) * math.comb(r2, c1 - x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
        return sum(v for v in p.values() if v <= p[a]) / sum(p.values())

    rng = random.Random(2)
    for _ in range(60):
        t = [rng.randrange(12) for _ in range(4)]
        assert pvalues.fisher(*t) == pytest.approx(brute(*t), abs=1e-9)
    assert 0 < pvalues.fisher(50_000, 51_000, 49_000, 50_500) < 1


def test_load_of_a_judged_log(spark):
    keys = ["uid", "model", "sample_idx"]
    done = spark.createDataFrame([(1, "m", 0, 10, False, False, None, 1), (1, "m", 1, 11, True, False, None, 2), (2, "m", 0, 0, False, True, "empty completion (finish_reason=length)", 3)], "uid int, model string, sample_idx int, output_tokens int, truncated boolean, generation_failed boolean, error string, pos int")
    log = spark.createDataFrame(
        [(1, "m", 0, 1, True, None), (1, "m", 0, 2, False, 2), (1, "m", 0, 3, False, 0), (1, "m", 1, 4, None, None), (1, "m", 7, 5, False, 1), (9, "m", 0, 6, False, 1)], "uid int, model string, sample_idx int, pos int, judge_failed boolean, label int"
    )
    out, counts = judging.load_judged(done, log, spark.createDataFrame([(1,), (2,)], "uid int"), keys, "pos")
    assert [tuple(r) for r in out.collect()] == [(1, "m", 0, 2, 10, False)]
    assert counts.first().asDict() == {"rows": 6, "unknown": 1, "failed": 2, "orphans": 1, "labelled": 1, "duplicates": 1, "empty_completions": 1}
    assert judging.load_judged(done, log.limit(0), done.select("uid"), keys, "pos")[1].first().labelled == 0


def test_joins_state_their_collisions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, c string")
    b = spark.createDataFrame([(1, None, 5), (1, "w", 6)], "id int, c string, v int")
    assert judging.left_with_suffix(a, b, "id").count() == 2 and judging.left_with_suffix(a, b, "id", fan_out=True).count() == 3
    assert judging.left_with_suffix(a, b, "id").columns == ["id", "c", "c_right", "v"]
    assert sorted(r.c for r in judging.inner_coalescing(a, b, "id", "c").collect()) == ["w", "x"]
    assert judging.asserted_size(a, F.lit(2)).count() == 1
    with pytest.raises(Exception, match="rows"):
        judging.asserted_size(a, F.lit(3)).collect()


def test_label_plan_respects_quotas(spark):
    cells = spark.createDataFrame([("m", k, c, n) for k, n in ((0, 400), (1, 3), (2, 200), (3, 40)) for c in ("a", "b")], "model string, label int, category string, population long")
    p = judging.label_plan(cells, "model", "label", "category", 100).toPandas()
    by = p.groupby("label").quota.sum()
    assert p.quota.sum() == 100 and by[2] == 50 and by[1] == 6 and by[3] >= 10 and (p.quota <= p.population).all()


def test_samples_take_the_remainder_and_halves(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 4) for i in range(90)], "id int, s string, y int")
    got = sampling.last_remainder(df, "s", "id", 31, 1).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"a": 10, "b": 10, "c": 11}
    v = sampling.verify_sample(df, "s", F.col("y") == 2, "id", 10, 1).groupBy("s", "failing").count().collect()
    assert all(r["count"] == 5 for r in v) and len(v) == 6


def test_resampling_where_the_cells_lie(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 1, 800).round(3)
    y = (x + rng.normal(0, 1, 800)).round(3)
    df = spark.createDataFrame([(float(a), float(b), int(a > 3)) for a, b in zip(x, y)], "x double, y double, g int").repartition(5)
    m = resample.bootstrap_mean(df, "x", 400).first()
    se = x.std() / np.sqrt(len(x))
    assert m.estimate == pytest.approx(x.mean()) and m.low == pytest.approx(x.mean() - 1.96 * se, abs=0.02) and m.high == pytest.approx(x.mean() + 1.96 * se, abs=0.02)
    rho = pd.Series(x).rank().corr(pd.Series(y).rank())
    s = resample.bootstrap_spearman(df, "x", "y", replicates=200).first()
    assert s.low < rho < s.high and s.median == pytest.approx(rho, abs=0.01)
    p = resample.permutation_difference(df.withColumn("z", (F.rand(3) > 0.5).cast("int")), "y", "z", 400).first()
    assert 0.005 < p.p <= 1 and resample.permutation_difference(df, "y", "g", 300).first().p == 0
    assert resample.bootstrap_mean(df.limit(0), "x", 10).first().estimate is None
    t = resample.tau_b(x[:80], y[:80], [np.arange(40), np.arange(40, 80)])
    c = [np.sign((x[i] - x[j]) * (y[i] - y[j])) for a in (range(40), range(40, 80)) for i in a for j in a if i < j]
    assert t == pytest.approx(np.mean(c), abs=0.01)


def test_tau_of_many_rows_forms_no_pairs():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 40, 150):
        k = rng.integers(1, 9, (2, n))
        x, y = rng.binomial(k, 0.4) / k
        at = [a for a in np.array_split(rng.permutation(n), 3)]
        s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for a in at for m, i in enumerate(a) for j in a[:m]]
        num, dx, dy = sum(a * b for a, b in s), sum(abs(a) for a, _ in s), sum(abs(b) for _, b in s)
        assert resample.tau_b(x, y, at) == pytest.approx(num / math.sqrt(dx * dy) if dx * dy else math.nan, abs=1e-12, nan_ok=True)
    n, block = 60_000, 100
    y = np.arange(n).reshape(-1, block)[:, ::-1].ravel() / n
    began = time.process_time()
    assert resample.tau_b(np.arange(n) / n, y, [np.arange(n)]) == pytest.approx(1 - 2 * (block - 1) / (n - 1), abs=1e-12)
    assert time.process_time() - began < 15


def test_nested_bootstrap_of_tau_is_sent_distinct_prompts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = sorted((int(s), x / 4, x / 4 if same else (4 - x) / 8, 4, 8) for s, x, same in zip(*(v.tolist() for v in (rng.integers(0, 2, 400), rng.integers(0, 5, 400), rng.random(400) < 0.7))))
    df = spark.createDataFrame(rows, "s int, x double, y double, kx long, ky long").repartition(3)
    monkeypatch.setattr(resample, "MAX_SENT", 30)
    got = resample.nested_bootstrap_tau(df, "s", "x", "kx", "y", "ky", replicates=60).first()
    s, x, y, kx, ky = (np.array(c) for c in zip(*rows))
    want = []
    for task, size in ((0, 50), (1, 10)):
        r = np.random.default_rng([1, task])
        for _ in range(size):
            at = np.concatenate([r.choice(np.flatnonzero(s == g), (s == g).sum()) for g in (0, 1)])
            a, b = r.binomial(kx[at], x[at]) / kx[at], r.binomial(ky[at], y[at]) / ky[at]
            one = (s[at][:, None] == s[at]) * np.sign(a[:, None] - a), np.sign(b[:, None] - b) * (s[at][:, None] == s[at])
            want.append((one[0] * one[1]).sum() / np.sqrt(np.abs(one[0]).sum() * np.abs(one[1]).sum()))
    assert tuple(got) == pytest.approx((np.mean(want), *np.percentile(want, [2.5, 97.5])), abs=1e-9)
    assert tuple(resample.nested_bootstrap_tau(df.limit(0), "s", "x", "kx", "y", "ky", replicates=60).first()) == (None, None, None)
    monkeypatch.setattr(resample, "MAX_SENT", 5)
    with pytest.raises(ValueError):
        resample.nested_bootstrap_tau(df, "s", "x", "kx", "y", "ky", replicates=60)


def test_null_band_is_around_the_plain_agreement(spark):
    rng = np.random.default_rng(8)
    base = rng.random(120)
    rows = [(i, float(b), float(b + rng.normal(0, 0.3)), i % 3) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "uid int, x double, y double, stratum int")
    tau = stats.tau_blocked(df, "x", "y", "stratum").first().tau
    b = stats.residual_null_band(df, "uid", "x", "y", "stratum", 20).first()
    assert b.draws == 20 and b.p05 <= b.p50 <= b.p95 and abs(b.p50 - tau) < 0.1


def test_index_finds_what_the_exact_search_finds(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=16)]) for i in range(900)] + [(5000, None), (5001, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    c, probes = geometry.fit_index(df, 5)
    r = geometry.index_recall(df.where("id < 200"), df, 5, c, probes).first()
    assert r.neighbours == 1000 and r.recall >= 0.9
    small = geometry.knn_index(df.where("id < 200"), df, 5, c, len(c), block=50)
    assert {(x.id, x.nbr) for x in small.collect()} == {(x.id, x.nbr) for x in geometry.knn(df.where("id < 200"), df, 5, block=100).collect()}


def test_generated_questions_respect_the_caps(spark):
    t = spark.createDataFrame([("e", f"What of {{entity}} {i}?") for i in range(20)], "kind string, template string")
    e = spark.createDataFrame([("e", f"Place {i}") for i in range(30)], "kind string, entity string")
    q = corpus.generate(t, e, 4, 3, "s").collect()
    assert max(pd.Series([r.template for r in q]).value_counts()) <= 4 and max(pd.Series([r.entity for r in q]).value_counts()) <= 3 and len({r.question for r in q}) == len(q)


@pytest.mark.parametrize(
    "category, question, rule",
    [("impossible", "Prove the Riemann Hypothesis", "open problem"), ("impossible", "the largest prime", "no such object"), ("impossible", "the largest town", "not specified"), ("factual", "Who wrote it?", "author"), ("other", "x", "not specified"), ("nonexistent", None, "invented")],
)
def test_ground_truth_rules(spark, category, question, rule):
    df = spark.createDataFrame([(category, question)], "c string, q string")
    assert df.select(text.ground_truth_rule(F.col("c"), F.col("q"), F.lit(None).cast("map<string,string>"))).first()[0] == rule


def test_corrections_and_promotions(spark):
    lab = spark.createDataFrame([("a", 1), ("b", 2)], "k string, label int")
    ev = spark.createDataFrame([("a", "fix", 0, 1), ("a", "fix", 3, 2), ("b", "doubt", None, 1)], "k string, kind string, value int, o int")
    got = {r.k: (r.label, r.corrected_from, r.gt_doubt) for r in judging.corrected(lab, ev, "k", "o").collect()}
    assert got == {"a": (3, 1, False), "b": (2, None, True)}
    p = {r.k: (r.label, r.redone_from, r.redone_via) for r in judging.promoted(lab, lab.withColumn("label", F.lit(0)), lab.where("k = 'a'").withColumn("label", F.lit(3)), "k").collect()}
    assert p == {"a": (3, 1, "redo"), "b": (0, 2, "relabel")}
