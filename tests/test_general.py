"""Hand-computed values of the general operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pvalues, text
from plumbline.operators import audit, consensus, corpus, geometry, pairing, ranks, rates, resample, sampling, stats
from plumbline.plans import registry
from plumbline.sources import files
from plumbline.streaming import logs

VOTE = "array<struct<label:int,confidence:double,justification:string,failed:boolean>>"


def votes(spark, *panels):
    return spark.createDataFrame([(i, p) for i, p in enumerate(panels)], f"i int, votes {VOTE}")


def test_rates_and_totals(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", "x", 2), ("a", "y", 2), ("b", "y", 3)], "m string, c string, label int")
    got = {(r.m, r.c): (r.n, r.hallucinated_rate) for r in rates.overall_and_by(df, "m", "c").collect()}
    assert got == {("a", "ALL"): (3, 2 / 3), ("a", "x"): (2, 0.5), ("a", "y"): (1, 1.0), ("b", "ALL"): (1, 0.0), ("b", "y"): (1, 0.0)}
    assert rates.label_rates(df.limit(0), "m").count() == 0


def test_majority_ties_and_failures(spark):
    df = votes(
        spark,
        [(1, 0.5, "", False), (0, 0.9, "", None)],  # tie: the first vote
        [(2, 0.0, "Error: timeout", None), (0, 0.8, "", None), (2, 0.0, "x", True)],  # failures left out
        [(2, 0.0, "judge error", None)],  # all failed: they vote
        [],
    )
    m = consensus.majority(F.col("votes"))
    assert [r[0] for r in df.orderBy("i").select(m["label"]).collect()] == [1, 0, 2, None]
    r = consensus.recompute(F.col("votes"))
    assert [x[0] for x in df.orderBy("i").select(r["method"]).collect()] == ["higher_confidence", "insufficient", "insufficient", "insufficient"]


def test_parse_response(spark):
    df = spark.createDataFrame([('```json\n{"label": 1, "confidence": 0.5, "justification": "x"}\n```',), ('{"label": 7, "confidence": 1, "justification": "x"}',), ("no",)], "t string")
    p = consensus.parse_response(F.col("t"))
    assert [tuple(r) for r in df.select(p["label"], p["error"]).collect()] == [(1, None), (7, "label out of range"), (None, "not json")]


def test_mcnemar_variants(spark):
    rows = [(2, 0)] * 186 + [(0, 2)] * 75 + [(0, 0)] * 10
    df = spark.createDataFrame(rows, "before int, after int")
    r = pairing.mcnemar(df).first()
    assert (r.b, r.c) == (186, 75) and not r.exact
    assert r.chi2_plain == pytest.approx(111**2 / 261) and r.chi2_yates == pytest.approx(110**2 / 261)


def test_best_source_rejects_hallucinations(spark):
    df = spark.createDataFrame([(1, "a", 2, 0.9), (1, "b", 2, 0.8), (2, "a", 1, 0.4), (2, "b", 0, 0.1), (2, "c", 0, 0.3)], "id int, s string, label int, confidence double")
    got = {r.id: r.source for r in pairing.best_source(df, "id", "s").collect()}
    assert got == {1: None, 2: "c"}


def test_average_rank_and_mann_whitney(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "v double, g long")
    assert sorted(r.rank for r in ranks.average_rank(df, "v").collect()) == [1.0, 2.5, 2.5, 4.0]
    r = ranks.mann_whitney(df, "v", "g").first()
    assert r.u == 3.5 and r.auc == 0.875 and r.effect == pytest.approx(-0.75)


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert [r.n for r in ranks.equal_frequency(df, "v", 5).groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()] == [2] * 5
    assert ranks.equal_frequency(df.limit(3), "v", 5).count() == 0
    w = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (1.0,)], "v double").select(ranks.equal_width(F.col("v")).alias("b"))
    assert [r.b for r in w.collect()] == [None, 1, 2, 10]


def test_threshold_table_flags_none_below_one_row(spark):
    df = spark.createDataFrame([(i, 1.0 - i / 4, int(i < 2)) for i in range(4)], "id int, s double, y int")
    got = {r.fraction: (r.flagged, r.tp) for r in ranks.threshold_table(df, "s", "y", [0.1, 0.5], "id").collect()}
    assert got == {0.1: (0, 0), 0.5: (2, 2)}


def brute_tau(rows):
    num = dx = dy = 0
    for i, (s, x, y) in enumerate(rows):
        for s2, x2, y2 in rows[:i]:
            if s == s2:
                a, b = (x > x2) - (x < x2), (y > y2) - (y < y2)
                num, dx, dy = num + a * b, dx + (a != 0), dy + (b != 0)
    return num / math.sqrt(dx * dy)


def test_blocked_tau_against_brute_force(spark):
    rows = [(i % 3, float((i * 7) % 5), float((i * i) % 4)) for i in range(60)]
    r = stats.tau_blocked(spark.createDataFrame(rows, "s int, x double, y double"), "x", "y", "s").first()
    assert r.tau == pytest.approx(brute_tau(rows))
    one = stats.tau_blocked(spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0)], "s int, x double, y double"), "x", "y", "s").first()
    assert one.tau is None


def test_kappa_wilson_fdr(spark):
    df = spark.createDataFrame([(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15, "a int, b int")
    r = stats.kappa(df, "a", "b").first()
    assert r.agreement == pytest.approx(0.7) and r.kappa == pytest.approx(0.4)
    lo, hi = stats.wilson(F.lit(8), F.lit(10))
    x = spark.range(1).select(lo.alias("l"), hi.alias("h")).first()
    assert (x.l, x.h) == (pytest.approx(0.4901625, abs=1e-6), pytest.approx(0.9433178, abs=1e-6))
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    assert sorted(round(r.q, 4) for r in stats.bh_fdr(p, "p").collect()) == [0.04, 0.0533, 0.0533, 0.5]


def test_pvalues():
    assert pvalues.chi2_sf1(3.841458820694124) == pytest.approx(0.05)
    assert pvalues.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)
    assert pvalues.binom_two_sided(2, 10) == pytest.approx(0.109375)
    assert pvalues.fisher(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert pvalues.fisher(0, 0, 1, 3) == 1.0 and pvalues.chi2_sf1(float("nan")) == 1.0


def test_knn_matches_expressions_and_blocks(spark):
    rows = [(i, [float((i * 37) % 11), float((i * 17) % 7) + 1, float(i % 5)]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    a = {(r.id, r["rank"]): (r.nbr, round(r.dist, 9)) for r in geometry.knn(df, df, 3, block=16).collect()}
    want = {}
    for r in geometry.knn_expressions(df.where("v is not null"), 3).collect():
        for k, x in enumerate(r.b):
            want[r.id, k + 1] = round(x.dist, 9)
    assert {k: v[1] for k, v in a.items()} == pytest.approx(want, abs=1e-7) and len(a) == 150


def test_curvature_of_a_line_is_zero(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(8)], "id int, v array<double>")
    nn = geometry.knn(df, df, 3, metric="euclidean")
    out = geometry.curvature(df, nn, spark.createDataFrame([], "id int, local_id double")).collect()
    assert all(abs(r.curvature) < 1e-9 for r in out)


def test_sampling_is_deterministic(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id int, s string")
    a = [r.id for r in sampling.round_robin(df, "s", "id", 5).collect()]
    assert a == [0, 1, 2, 3, 4]
    w = sampling.stratified_weights(df, ["s"], "id", 4, 1).collect()
    assert len(w) == 8 and sum(r.weight for r in w) == 40
    assert sampling.apportion({"a": 1, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 0}, 4) == {"a": 2, "b": 2, "c": 0}


def test_audit_and_merge(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 9)], "id int, label int")
    got = {r.issue: r.n for r in audit.issues(df, "d", "id", {"null": F.col("label").isNull(), "range": F.col("label") > 3}).collect()}
    assert got == {"rows": 3, "null": 1, "range": 1, "duplicate_key": 1}
    e = spark.createDataFrame([("abc", "m-1", 7)], "p string, c string, s int").select(audit.encode_id(F.col("p"), F.col("c"), F.col("s")).alias("x"))
    assert e.first().x == "abc-m-1-07"


def test_text_functions(spark):
    df = spark.createDataFrame([("k", "Who is who? 12 and 3"), ("e", None)], "id string, t string")
    r = {x.id: x for x in text.text_features(df, "id", "t").collect()}
    assert (r["k"].n_tokens, r["k"].n_numbers, r["k"].question_word) == (6, 2, "who") and r["e"].n_tokens == 0
    f = spark.range(1).select(text.fill(F.lit("a {x} {y}"), F.create_map(F.lit("x"), F.lit("1"))).alias("f")).first().f
    assert f == "a 1 [y]"
    h = {x.id: x.entropy for x in text.trigram_entropy(spark.createDataFrame([("a", "abab"), ("b", "aaaa"), ("c", "ab")], "id string, t string"), "id", "t").collect()}
    assert h == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.0})


def test_contains_join_is_the_same_in_blocks(spark):
    texts = spark.createDataFrame([(1, "The windmills of Tamor ---- 1801"), (2, "A MILL"), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("mills of",), ("----",), ("Mill",), ("mill",), ("tamor",), ("abc",), (None,)], "term string")
    for limit in (50_000, 3, 1):
        got = sorted((r.id, r.term) for r in audit.contains_join(texts, "text", terms, "term", limit=limit).collect())
        assert got == [(1, "----"), (1, "mill"), (1, "mills of"), (1, "tamor"), (2, "mill")]


def test_capacity_of_any_writing_and_unknown_pools(spark):
    t = spark.createDataFrame([("{ENTITY} in {year}",), ("{entity} and {Entity}",), ("[ entity ] of {other}",), ("{other}",), ("none at all",)], "template string")
    got = {r.template: r.capacity for r in corpus.capacity(t, spark.createDataFrame([("entity", 5), ("year", 3)], "pool string, size int")).collect()}
    assert got == {"{ENTITY} in {year}": 15, "{entity} and {Entity}": 20, "[ entity ] of {other}": 5, "{other}": 1, "none at all": 1}


def test_capacity_counts_its_pools(spark, tmp_path):
    rows = [("1", "A", ("In {entity} of {year}?", {"entity": "A", "year": "1801"}), "train"), ("2", "B", ("WHERE IS {ENTITY}?", {"year": "1802"}), "test"), ("3", " C", ("tbd", None), None), ("4", "n/a", (None, None), "train")]
    schema = "id string, entity string, metadata struct<template:string,substitutions:map<string,string>>, split string"
    more = {"category": F.lit("x"), "question": F.lit("q"), "ground_truth": F.lit("g"), "metadata": F.col("metadata").withField("source", F.lit("s")).withField("generation_seed", F.lit(1))}
    spark.createDataFrame(rows, schema).withColumns(more).write.parquet(str(tmp_path / "borderline_edge_factual.parquet"))
    got = {r.template: r.capacity for r in registry.queries()["template_capacity"](spark, str(tmp_path)).collect()}
    assert got == {"In {entity} of {year}?": 6, "WHERE IS {ENTITY}?": 3}


def test_corpus_caps(spark):
    t = spark.createDataFrame([("k", "Where is {entity}?"), ("k", "Who built {entity}?")], "kind string, template string")
    e = spark.createDataFrame([("k", f"E{i}") for i in range(6)], "kind string, entity string")
    g = corpus.generate(t, e, 4, 1, "s")
    rows = g.collect()
    assert len({r.question for r in rows}) == len(rows) and max(pd.Series([r.entity for r in rows]).value_counts()) == 1


def test_resampling(spark):
    df = spark.createDataFrame([(float(i % 4) / 4, int(i % 4 > 1)) for i in range(200)], "v double, g long")
    r = resample.bootstrap_mean(df, "v", 400).first()
    assert r.low < r.estimate < r.high and r.estimate == pytest.approx(0.375)
    assert resample.permutation_difference(df, "v", "g", 400).first().p < 0.01


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path / "a")
    files.write_jsonl(spark.createDataFrame([(1, "x")], "i int, s string"), p, compress=True)
    assert files.read_jsonl(spark, p, "i int, s string").collect()[0].s == "x"
    assert files.read_jsonl(spark, str(tmp_path / "none"), "i int", missing="empty").count() == 0
    (tmp_path / "b.jsonl").write_text('{"i": 1}\nbroken\n\n')
    good, bad = files.read_jsonl_tolerant(spark, str(tmp_path / "b.jsonl"), "i int")
    assert good.count() == 1 and bad.first().error_line == "broken"


def test_stream_equals_batch_and_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 0, 2)], "uid int, sample_idx int, label int")
    df.write.parquet(str(tmp_path / "in"))
    st = logs.read_log(spark, str(tmp_path / "in"), df.schema)
    got = {r.uid: r.p for r in logs.run_to_table(st.groupBy("uid").agg(F.avg((F.col("label") == 2).cast("int")).alias("p")), "t1").collect()}
    assert got == {1: 0.5, 2: 1.0}
    q = logs.merge_into(logs.read_log(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), ["uid"], "sample_idx", str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/v=0")).count() == 2
    logs.check_settings(spark, str(tmp_path / "set"), {"k": "20"})
    with pytest.raises(ValueError):
        logs.check_settings(spark, str(tmp_path / "set"), {"k": "10"})
