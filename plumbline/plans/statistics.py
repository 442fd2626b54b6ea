"""Ranks, correlations, contingency, geometry, prediction, resampling and streams: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pvalues
from ..operators import geometry, ml, pairing, ranks, rates, resample, sampling, stats
from ..session import Scratch
from ..sources.tables import table
from ..streaming import logs
from . import carriers as c
from .evaluation import _PAIRED, _pairs


def _per(s, d):
    return rates.per_pair(c.samples(s, d))


def _pair(s, d):
    return c.pair(_per(s, d))


def _judge_human(s, d):
    return c.answers(s, d).where("label is not null").groupBy("item_id").agg(F.min("label").alias("judge"), F.min("model").alias("model")).join(c.humans(s, d), "item_id")


_JH = f"{c.ANSWERS}, {c.HUMANS}, jh AS (SELECT a.item_id, a.judge, a.model, h.annotator, h.human FROM (SELECT item_id, min(label) AS judge, min(model) AS model FROM answers WHERE label IS NOT NULL GROUP BY item_id) a JOIN humans h ON a.item_id = h.item_id)"
_AR = "rank() OVER ({w} ORDER BY {v}) + (count(*) OVER ({p} {v}) - 1) / 2.0"


def q_mcnemar(s, d):
    return pairing.mcnemar(_pairs(s, d), "cond", "model")


def q_mcnemar_p(s, d):
    m = pairing.mcnemar(_pairs(s, d), "cond", "category")
    return m.select("cond", "category", "b", "c", pvalues.mcnemar_p("b", "c").alias("p"), pvalues.chi2_p("chi2_plain").alias("p_plain"), stats.stars(pvalues.mcnemar_p("b", "c")).alias("stars"))


def q_cmh(s, d):
    t = c.samples(s, d).groupBy("uid").agg(
        F.count_if((F.col("model") == "view") & (F.col("label") == 2)).alias("a"), F.count_if((F.col("model") == "view") & (F.col("label") != 2)).alias("b"),
        F.count_if((F.col("model") == "click") & (F.col("label") == 2)).alias("c"), F.count_if((F.col("model") == "click") & (F.col("label") != 2)).alias("d"),
    )
    return stats.cmh(t)


def q_fisher(s, d):
    t = c.samples(s, d).groupBy("uid", "model").agg(
        *[F.count_if(cond).alias(k) for k, cond in zip("abcd", (F.col("truncated") & (F.col("label") == 2), F.col("truncated") & (F.col("label") != 2), ~F.col("truncated") & (F.col("label") == 2), ~F.col("truncated") & (F.col("label") != 2)))]
    )
    return t.select("uid", "model", pvalues.fisher_p("a", "b", "c", "d").alias("p"))


def q_verdict(s, d):
    """The verdict on the measured agreement: reliability by halves, floor by the share of prompts at zero, interval by the nested bootstrap."""
    p = Scratch(s, "verdict").cut(_pair(s, d).select("stratum", "x", "ka", "y", "kb", "p_even", "p_odd"))
    t = stats.tau_blocked(p, "x", "y", "stratum")
    r = stats.tau_blocked(p, "p_even", "p_odd", "stratum").select(stats.spearman_brown(F.col("tau")).alias("reliability"))
    floor = p.agg(F.coalesce(F.greatest(rates.share(F.col("x") == 0), rates.share(F.col("y") == 0)) > 0.5, F.lit(False)).alias("floor"))
    low = resample.nested_bootstrap_tau(p, "stratum", "x", "ka", "y", "kb", replicates=200).select("low", "high")
    j = t.crossJoin(r).crossJoin(floor).crossJoin(low)
    return j.select("tau", "reliability", "low", "high", "floor", stats.disattenuate(F.col("tau"), F.col("reliability"), F.col("reliability")).alias("corrected"), stats.verdict(F.col("reliability"), F.col("floor"), F.col("tau"), F.col("low")).alias("verdict"))


def q_inflation(s, d):
    p = _pair(s, d)
    a = stats.tau_blocked(p, "x", "y", "stratum").select(F.col("tau").alias("blocked"))
    b = stats.tau_blocked(p.withColumn("one", F.lit(1)), "x", "y", "one").select(F.col("tau").alias("pooled"))
    return a.crossJoin(b).withColumn("inflation", F.col("pooled") - F.col("blocked"))


def q_residual(s, d):
    r = stats.residualise(_pair(s, d), "x", "z", "stratum")
    r = stats.residualise(r.withColumnRenamed("residual", "rx"), "y", "z", "stratum").withColumnRenamed("residual", "ry")
    return r.groupBy("stratum").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r"))


def q_mann_whitney(s, d):
    x = c.results(s, d).where("is_hallucinated is not null").unpivot(["id", "is_hallucinated"], ["density_change", "centrality_change"], "feature", "value")
    return ranks.mann_whitney(x.withColumn("g", F.col("is_hallucinated").cast("long")), "value", "g", "feature").drop("z")


def q_percentile(s, d):
    r = c.results(s, d)
    return ranks.percentile_rank(r.where("perturbed_density is not null").select("id", "perturbed_density"), "perturbed_density", r, "original_density").groupBy("id").agg(F.min("percentile").alias("percentile"))


def q_qcut(s, d):
    b = ranks.equal_frequency(c.results(s, d).where("is_hallucinated is not null"), "original_density", 5)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("is_hallucinated").alias("rate"), F.min("original_density").alias("low"), F.max("original_density").alias("high"))


def q_threshold(s, d):
    x = c.results(s, d).where("is_hallucinated is not null and original_density is not null").groupBy("id").agg(F.max("is_hallucinated").alias("y"), geometry.risk_score(F.max("original_density"), F.max("original_centrality")).alias("score"))
    return ranks.threshold_table(x.where("score is not null"), "score", "y", [0.1, 0.3, 0.4, 0.5], "id")


def q_metrics(s, d):
    return ranks.classification_metrics(_judge_human(s, d), F.col("human") == 2, F.col("judge") == 2, "annotator")


def q_spearman(s, d):
    return stats.spearman(c.results(s, d).where("density_change is not null and centrality_change is not null"), "density_change", "centrality_change", "prefix")


def q_tau_matrix(s, d):
    x = c.results(s, d).where("label is not null and question is not null and model is not null").groupBy("question", "model").agg(F.max((F.col("label") == 2).cast("int")).alias("f"))
    return stats.pairwise_binary(x, "question", "model", "f")


def q_fdr(s, d):
    m = pairing.mcnemar(_pairs(s, d), "cond", "model").select("cond", "model", F.round(pvalues.mcnemar_p("b", "c"), 9).alias("p"))
    return stats.bh_fdr(m, "p", "cond")


def q_knn(s, d):
    return geometry.knn(c.vectors(s, d), c.vectors(s, d), 5)


def _nn(s, d, k=20):
    return geometry.knn(c.vectors(s, d), c.vectors(s, d), k)


def q_density(s, d):
    n = _nn(s, d, 9).select("id", "dist").unionByName(c.vectors(s, d).select("id", F.lit(0.0).alias("dist")))
    return geometry.density(n)


def q_mean(s, d):
    return geometry.corpus_mean(c.vectors(s, d)).select(F.posexplode("mean").alias("i", "mean"))


def q_curvature(s, d):
    nn = Scratch(s, "nn").cut(_nn(s, d))
    return geometry.curvature(c.vectors(s, d), nn, geometry.local_id(nn))


def q_drift(s, d):
    a, b = _nn(s, d, 5).groupBy("id").agg(F.avg("dist").alias("a")), _nn(s, d, 10).groupBy("id").agg(F.avg("dist").alias("b"))
    return a.join(b, "id").agg(F.corr("a", "b").alias("r"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_diff"))


def _ml(s, d):
    return c.results(s, d).where("is_hallucinated is not null").select("id", "model", "prefix", "category", "question", F.col("is_hallucinated").cast("double").alias("y"), "original_density", "original_centrality", "density_change", "centrality_change")


_NUM = ["original_density", "original_centrality", "density_change", "centrality_change"]


def q_cv(s, d):
    cv = ml.cross_validate(_ml(s, d), "id", "y", {"category": ([], ["prefix"]), "geometry": (_NUM, []), "combined": (_NUM, ["prefix"])}, folds=3)
    return ml.cv_summary(cv)


def q_forest(s, d):
    x = sampling.split3(_ml(s, d), "y", "id", 5)
    sc = ml.scored(x.where("part = 'train'"), x.where("part <> 'train'"), "forest", _NUM, ["prefix"], "y")
    return ranks.mann_whitney(sc.withColumn("g", F.col("y").cast("long")), "score", "g", "part")


def q_logit(s, d):
    return ml.logit_inference(_ml(s, d).na.drop(), _NUM, "y")


def q_lrt(s, d):
    r = ml.likelihood_ratio(_ml(s, d), ([], ["prefix"]), (_NUM, ["prefix"]), "y", len(_NUM))
    return s.createDataFrame([(float(r["statistic"]), int(r["df"]), float(r["p"]))], "statistic double, df int, p double")


def q_stream(s, d):
    """The running rates of a file stream, read to its end."""
    scratch = Scratch(s, "stream")
    src = scratch.write(c.samples(s, d).join(table(s, d, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("model")).agg(F.min("ts").alias("ts")), ["uid", "model"]))
    stream = logs.read_log(s, src, s.read.parquet(src).schema)
    return logs.run_to_table(stream.groupBy("uid", "model").agg(F.count("*").alias("k"), F.avg((F.col("label") == 2).cast("double")).alias("p_hat")), f"running_{scratch.root[-6:]}")


_TAU = c.PAIR + """, pp AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS num, CAST(sum(CAST(a.x <> b.x AS INT)) AS DOUBLE) AS dx, CAST(sum(CAST(a.y <> b.y AS INT)) AS DOUBLE) AS dy, CAST(count(*) AS DOUBLE) AS pairs
  FROM pair a JOIN pair b ON a.stratum = b.stratum AND a.uid < b.uid), nn AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT stratum, count(*) AS n FROM pair GROUP BY stratum HAVING count(*) >= 2) t)"""
_MW = "n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, 1 - 2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS effect, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS auc"

#: Upper tail of chi-square with one degree of freedom, by the series of erf; beyond 16 it is under 1e-4 of the sixth decimal.
_SF1 = "CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 32 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * (SELECT sum((CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(sqrt({x} / 2)) - lgamma(i + 1.0)) / (2 * i + 1)) FROM generate_series(0, 120) AS g(i)) END"
_EXACT = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))) FROM generate_series(0, 24) AS g(i) WHERE i <= least(b, c))) END"
_YATES = "(CASE WHEN b + c = 0 THEN 0.0 ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / CAST(b + c AS DOUBLE) END)"
_PLAIN = "(CASE WHEN b + c = 0 THEN 0.0 ELSE (b - c) * (b - c) / CAST(b + c AS DOUBLE) END)"
_PSQL = f"CASE WHEN b + c < 25 THEN {_EXACT} ELSE {_SF1.format(x=_YATES)} END"
_HYPER = "exp(lgamma(r1 + 1.0) - lgamma(x + 1.0) - lgamma(r1 - x + 1.0) + lgamma(r2 + 1.0) - lgamma(c1 - x + 1.0) - lgamma(r2 - c1 + x + 1.0) - lgamma(n + 1.0) + lgamma(c1 + 1.0) + lgamma(n - c1 + 1.0))"

ENTRIES = {
    "mcnemar": (q_mcnemar, (["rate_before", "rate_after", "chi2_plain", "chi2_yates", "reduction", "relative_reduction"], f"WITH {_PAIRED}, g AS (SELECT cond, model, count(*) AS n_common, count(*) FILTER (before = 2 AND after <> 2) AS b, count(*) FILTER (before <> 2 AND after = 2) AS c, avg(CAST(before = 2 AS DOUBLE)) AS rate_before, avg(CAST(after = 2 AS DOUBLE)) AS rate_after FROM pairs GROUP BY cond, model) SELECT *, CASE WHEN b + c = 0 THEN 0 ELSE (b - c) * (b - c) / (b + c) END AS chi2_plain, CASE WHEN b + c = 0 THEN 0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS chi2_yates, b + c < 25 AS exact, rate_before - rate_after AS reduction, (rate_before - rate_after) / nullif(rate_before, 0) AS relative_reduction FROM g")),
    "mcnemar_p": (q_mcnemar_p, (["p", "p_plain"], f"""WITH {_PAIRED}, g AS (SELECT cond, category, count(*) FILTER (before = 2 AND after <> 2) AS b, count(*) FILTER (before <> 2 AND after = 2) AS c FROM pairs GROUP BY 1, 2),
 q AS (SELECT *, {_PSQL} AS p, {_SF1.format(x=_PLAIN)} AS p_plain FROM g) SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM q""")),
    "marginal_rates": (lambda s, d: rates.marginal_rates(c.samples(s, d)), (["rate", "low", "high", "mean_p_hat", "mean_refusal"], f"WITH {c.PER_PAIR}, g AS (SELECT model, CAST(sum(k_eff) AS BIGINT) AS n, CAST(sum(n2) AS BIGINT) AS k, avg(p_hat) AS mean_p_hat, avg(refusal_rate) AS mean_refusal FROM per GROUP BY model), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g) SELECT model, n, k, p AS rate, greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)) AS low, least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)) AS high, mean_p_hat, mean_refusal FROM w")),
    "cmh": (q_cmh, (["chi2", "odds_ratio"], f"WITH {c.SAMPLES}, t AS (SELECT uid, CAST(count(*) FILTER (model = 'view' AND label = 2) AS DOUBLE) AS a, CAST(count(*) FILTER (model = 'view' AND label <> 2) AS DOUBLE) AS b, CAST(count(*) FILTER (model = 'click' AND label = 2) AS DOUBLE) AS c, CAST(count(*) FILTER (model = 'click' AND label <> 2) AS DOUBLE) AS d FROM samples GROUP BY uid), u AS (SELECT *, a+b+c+d AS n FROM t WHERE a+b > 0 AND c+d > 0 AND a+c > 0 AND b+d > 0 AND a+b+c+d > 1), g AS (SELECT count(*) AS tables, sum(a - (a+b)*(a+c)/n) AS diff, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) AS var, sum(a*d/n) AS up, sum(b*c/n) AS down FROM u) SELECT tables, pow(abs(diff) - 0.5, 2) / var AS chi2, up / down AS odds_ratio FROM g")),
    "fisher_truncation": (q_fisher, (["p"], f"""WITH {c.SAMPLES}, t AS (SELECT uid, model, count(*) FILTER (truncated AND label = 2) AS a, count(*) FILTER (truncated AND label <> 2) AS b, count(*) FILTER (NOT truncated AND label = 2) AS c, count(*) FILTER (NOT truncated AND label <> 2) AS d FROM samples GROUP BY 1, 2),
 m AS (SELECT uid, model, a, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n FROM t), s AS (SELECT m.*, unnest(generate_series(greatest(0, c1 - r2), least(r1, c1))) AS x FROM m WHERE r1 > 0 AND r2 > 0 AND c1 > 0 AND n - c1 > 0), h AS (SELECT *, {_HYPER} AS px FROM s),
 f AS (SELECT uid, model, least(1.0, sum(px) FILTER (px <= seen * (1 + 1e-7))) AS p FROM (SELECT *, max(px) FILTER (x = a) OVER (PARTITION BY uid, model) AS seen FROM h) z GROUP BY 1, 2)
 SELECT m.uid, m.model, coalesce(f.p, 1.0) AS p FROM m LEFT JOIN f ON m.uid = f.uid AND m.model = f.model""")),
    "kappa": (lambda s, d: stats.kappa(_judge_human(s, d), "human", "judge"), (["agreement", "kappa"], f"WITH {_JH}, x AS (SELECT human AS a, judge AS b, count(*) AS w FROM jh GROUP BY 1, 2), t AS (SELECT sum(w) AS t, sum(w) FILTER (a = b) AS hit FROM x), pe AS (SELECT sum(wa * wb) AS e FROM (SELECT a AS k, sum(w) AS wa FROM x GROUP BY a) p JOIN (SELECT b AS k, sum(w) AS wb FROM x GROUP BY b) q ON p.k = q.k) SELECT hit / t AS agreement, (hit / t - e / (t * t)) / (1 - e / (t * t)) AS kappa FROM t, pe")),
    "confusion_matrix": (lambda s, d: stats.confusion(_judge_human(s, d), "human", "judge"), ([], f"WITH {_JH} SELECT human, judge, count(*) AS n FROM jh GROUP BY 1, 2")),
    "dispersion": (lambda s, d: stats.dispersion(_per(s, d), "model"), (["chi2", "per_df"], f"WITH {c.PER_PAIR}, t AS (SELECT model, sum(n2) / sum(k_eff) AS p FROM per GROUP BY model) SELECT per.model, sum(pow(n2 - k_eff * p, 2) / (k_eff * p * (1 - p))) AS chi2, count(*) - 1 AS df, sum(pow(n2 - k_eff * p, 2) / (k_eff * p * (1 - p))) / (count(*) - 1) AS per_df FROM per JOIN t ON per.model = t.model WHERE p > 0 AND p < 1 GROUP BY per.model")),
    "bh_fdr": (q_fdr, (["p", "bonferroni", "q"], f"WITH {_PAIRED}, g AS (SELECT cond, model, count(*) FILTER (before = 2 AND after <> 2) AS b, count(*) FILTER (before <> 2 AND after = 2) AS c FROM pairs GROUP BY cond, model), p AS (SELECT cond, model, round({_PSQL}, 9) AS p FROM g), r AS (SELECT a.*, (SELECT count(*) FROM p b WHERE b.cond = a.cond) AS m, (SELECT count(*) FROM p b WHERE b.cond = a.cond AND b.p <= a.p) AS r FROM p a) SELECT cond, model, p, least(1, p * m) AS bonferroni, least(1, (SELECT min(b.p * b.m / b.r) FROM r b WHERE b.cond = a.cond AND b.p >= a.p)) AS q FROM r a")),
    "pearson": (lambda s, d: stats.pearson(c.results(s, d), [("density_change", "centrality_change"), ("original_density", "confidence")]), (["r"], f"WITH {c.RESULTS} SELECT 'density_change' AS x, 'centrality_change' AS y, corr(density_change, centrality_change) AS r, count(*) FILTER (density_change IS NOT NULL AND centrality_change IS NOT NULL) AS n FROM results UNION ALL SELECT 'original_density', 'confidence', corr(original_density, confidence), count(*) FILTER (original_density IS NOT NULL AND confidence IS NOT NULL) FROM results")),
    "spearman": (q_spearman, (["rho"], f"WITH {c.RESULTS}, d AS (SELECT prefix, density_change AS a, centrality_change AS b FROM results WHERE density_change IS NOT NULL AND centrality_change IS NOT NULL), r AS (SELECT prefix, {_AR.format(w='PARTITION BY prefix', v='a', p='PARTITION BY prefix,')} AS ra, {_AR.format(w='PARTITION BY prefix', v='b', p='PARTITION BY prefix,')} AS rb FROM d) SELECT prefix, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(ra, rb) END AS rho FROM r GROUP BY prefix")),
    "tau_binary_matrix": (q_tau_matrix, (["tau"], f"WITH {c.RESULTS}, x AS (SELECT question, model, max(CAST(label = 2 AS INT)) AS f FROM results WHERE label IS NOT NULL AND question IS NOT NULL AND model IS NOT NULL GROUP BY question, model) SELECT p.model AS a, q.model AS b, count(*) AS n, corr(p.f, q.f) AS tau FROM x p JOIN x q ON p.question = q.question GROUP BY 1, 2")),
    "tau_summary": (lambda s, d: stats.tau_summary(q_tau_matrix(s, d)), (["mean", "median", "min", "max", "std"], f"WITH {c.RESULTS}, x AS (SELECT question, model, max(CAST(label = 2 AS INT)) AS f FROM results WHERE label IS NOT NULL AND question IS NOT NULL AND model IS NOT NULL GROUP BY question, model), t AS (SELECT corr(p.f, q.f) AS tau FROM x p JOIN x q ON p.question = q.question WHERE p.model < q.model GROUP BY p.model, q.model) SELECT avg(tau) AS mean, median(tau) AS median, min(tau) AS min, max(tau) AS max, stddev_pop(tau) AS std FROM t")),
    "tau_blocked": (lambda s, d: stats.tau_blocked(_pair(s, d), "x", "y", "stratum"), (["pairs", "tau", "ceiling", "tied_x", "tied_y"], f"WITH {_TAU} SELECT n, pairs, num / sqrt(dx * dy) AS tau, sqrt(least(dx, dy) / greatest(dx, dy)) AS ceiling, (pairs - dx) / pairs AS tied_x, (pairs - dy) / pairs AS tied_y FROM pp, nn")),
    "spearman_blocked": (lambda s, d: stats.spearman_blocked(_pair(s, d), "x", "y", "stratum"), (["rho"], f"WITH {c.PAIR}, r AS (SELECT stratum, {_AR.format(w='PARTITION BY stratum', v='x', p='PARTITION BY stratum,')} AS rx, {_AR.format(w='PARTITION BY stratum', v='y', p='PARTITION BY stratum,')} AS ry FROM pair), k AS (SELECT rx - avg(rx) OVER (PARTITION BY stratum) AS a, ry - avg(ry) OVER (PARTITION BY stratum) AS b, count(*) OVER (PARTITION BY stratum) AS m FROM r) SELECT count(*) AS n, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS rho FROM k WHERE m >= 2")),
    "stratification_inflation": (q_inflation, (["blocked", "pooled", "inflation"], f"WITH {_TAU}, p1 AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS num, CAST(sum(CAST(a.x <> b.x AS INT)) AS DOUBLE) AS dx, CAST(sum(CAST(a.y <> b.y AS INT)) AS DOUBLE) AS dy FROM pair a JOIN pair b ON a.uid < b.uid), t AS (SELECT (SELECT CASE WHEN dx * dy > 0 THEN num / sqrt(dx * dy) END FROM pp) AS blocked, (SELECT CASE WHEN dx * dy > 0 THEN num / sqrt(dx * dy) END FROM p1) AS pooled) SELECT *, pooled - blocked AS inflation FROM t")),
    "residualised": (q_residual, (["r"], f"WITH {c.PAIR}, k AS (SELECT stratum, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM pair WINDOW w AS (PARTITION BY stratum)), sl AS (SELECT sum(x * z) / sum(z * z) AS sx, sum(y * z) / sum(z * z) AS sy FROM k) SELECT stratum, count(*) AS n, corr(x - sx * z, y - sy * z) AS r FROM k, sl GROUP BY stratum")),
    "verdict": (q_verdict, None),
    "mann_whitney": (q_mann_whitney, (["u", "effect", "auc"], f"WITH {c.RESULTS}, long AS (SELECT 'density_change' AS feature, density_change AS v, is_hallucinated AS g FROM results WHERE is_hallucinated IS NOT NULL AND density_change IS NOT NULL UNION ALL SELECT 'centrality_change', centrality_change, is_hallucinated FROM results WHERE is_hallucinated IS NOT NULL AND centrality_change IS NOT NULL), r AS (SELECT feature, g, {_AR.format(w='PARTITION BY feature', v='v', p='PARTITION BY feature,')} AS r FROM long), k AS (SELECT feature, CAST(sum(g) AS BIGINT) AS n1, CAST(count(*) - sum(g) AS BIGINT) AS n2, sum(r) FILTER (g = 1) AS r1 FROM r GROUP BY feature) SELECT feature, {_MW} FROM k")),
    "percentile_rank": (q_percentile, (["percentile"], f"WITH {c.RESULTS}, v AS (SELECT DISTINCT perturbed_density AS v FROM results WHERE perturbed_density IS NOT NULL), u AS (SELECT v, 0 AS c FROM v UNION ALL SELECT original_density, 1 FROM results WHERE original_density IS NOT NULL), g AS (SELECT v, sum(c) AS c FROM u GROUP BY v), k AS (SELECT v, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(c) OVER () AS t FROM g) SELECT id, min(100.0 * below / t) AS percentile FROM results JOIN k ON results.perturbed_density = k.v GROUP BY id")),
    "qcut_rates": (q_qcut, (["rate", "low", "high"], f"WITH {c.RESULTS}, x AS (SELECT original_density AS v, is_hallucinated AS y FROM results WHERE is_hallucinated IS NOT NULL AND original_density IS NOT NULL), e AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS e FROM x) SELECT CAST(len(list_filter(e, lambda q: q < v)) AS INT) AS bin, count(*) AS n, avg(y) AS rate, min(v) AS low, max(v) AS high FROM x, e GROUP BY 1")),
    "cut_rates": (lambda s, d: c.results(s, d).withColumn("bin", ranks.equal_width(F.col("confidence"))).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), rates.share(F.col("label") == 2).alias("rate")), (["rate"], f"WITH {c.RESULTS} SELECT CAST(ceil(confidence * 10) AS INT) AS bin, count(*) AS n, avg(CAST(label = 2 AS DOUBLE)) AS rate FROM results WHERE confidence > 0 AND confidence <= 1 GROUP BY 1")),
    "threshold_table": (q_threshold, (["fraction", "recall", "precision", "fpr"], f"WITH {c.RESULTS}, x AS (SELECT id, max(is_hallucinated) AS y, (1 / (1 + max(original_density)) + max(original_centrality)) / 2 AS score FROM results WHERE is_hallucinated IS NOT NULL AND original_density IS NOT NULL GROUP BY id), r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS i, count(*) OVER () AS n, sum(y) OVER () AS pos FROM x WHERE score IS NOT NULL), k AS (SELECT f AS fraction, any_value(n) AS n, any_value(pos) AS pos, count(*) FILTER (i <= floor(n * f + 1e-9)) AS flagged, count(*) FILTER (i <= floor(n * f + 1e-9) AND y = 1) AS tp FROM r CROSS JOIN (SELECT unnest([0.1, 0.3, 0.4, 0.5]) AS f) q GROUP BY f) SELECT fraction, flagged, tp, tp / pos AS recall, tp / flagged AS precision, (flagged - tp) / (n - pos) AS fpr FROM k")),
    "roc_points": (lambda s, d: ranks.roc_points(c.results(s, d).where("is_hallucinated is not null and confidence is not null").withColumn("y", F.col("is_hallucinated").cast("long")), "confidence", "y"), (["confidence", "tpr", "fpr", "precision"], f"WITH {c.RESULTS}, g AS (SELECT confidence, count(*) AS n, sum(is_hallucinated) AS k FROM results WHERE is_hallucinated IS NOT NULL AND confidence IS NOT NULL GROUP BY confidence), w AS (SELECT confidence, sum(k) OVER o AS tp, sum(n) OVER o - sum(k) OVER o AS fp, sum(k) OVER () AS p, sum(n) OVER () - sum(k) OVER () AS q FROM g WINDOW o AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)) SELECT confidence, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / p AS tpr, fp / q AS fpr, tp / (tp + fp) AS precision FROM w")),
    "classification_metrics": (q_metrics, (["accuracy", "precision", "recall", "f1"], f"WITH {_JH}, g AS (SELECT annotator, count(*) FILTER (human = 2 AND judge = 2) AS tp, count(*) FILTER (human <> 2 AND judge <> 2) AS tn, count(*) FILTER (human <> 2 AND judge = 2) AS fp, count(*) FILTER (human = 2 AND judge <> 2) AS fn FROM jh GROUP BY annotator), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM g) SELECT annotator, tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p")),
    "paired_t": (lambda s, d: stats.paired_t(_pair(s, d), "x", "y", "stratum"), (["mean_diff", "d", "t"], f"WITH {c.PAIR}, g AS (SELECT stratum, count(x - y) AS n, avg(x - y) AS mean_diff, stddev_samp(x - y) AS sd FROM pair GROUP BY stratum) SELECT stratum, n, mean_diff, mean_diff / nullif(sd, 0) AS d, mean_diff / nullif(sd, 0) * sqrt(n) AS t, n - 1 AS df FROM g")),
    "pooled_t": (lambda s, d: stats.pooled_t(c.results(s, d).where("is_hallucinated is not null"), "density_change", F.col("is_hallucinated") == 1, "prefix"), (["t", "d"], f"WITH {c.RESULTS}, g AS (SELECT prefix, count(density_change) FILTER (is_hallucinated = 1) AS n1, count(density_change) FILTER (is_hallucinated = 0) AS n2, avg(density_change) FILTER (is_hallucinated = 1) AS m1, avg(density_change) FILTER (is_hallucinated = 0) AS m2, var_samp(density_change) FILTER (is_hallucinated = 1) AS v1, var_samp(density_change) FILTER (is_hallucinated = 0) AS v2 FROM results WHERE is_hallucinated IS NOT NULL GROUP BY prefix), s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp FROM g) SELECT prefix, n1, n2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / (sp * sqrt(1 / n1 + 1 / n2)) END AS t, CASE WHEN n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / sp END AS d, n1 + n2 - 2 AS df FROM s")),
    "knn": (q_knn, (["dist"], f"WITH {c.DISTANCES} SELECT id, CAST(rank AS INT) AS rank, nbr, dist FROM nn WHERE rank <= 5")),
    "local_id": (lambda s, d: geometry.local_id(_nn(s, d, 2)), (["local_id"], f"WITH {c.DISTANCES}, g AS (SELECT id, max(dist) FILTER (rank = 1) AS r1, max(dist) FILTER (rank = 2) AS r2 FROM nn WHERE rank <= 2 GROUP BY id) SELECT id, CASE WHEN r1 > 0 AND r1 < r2 THEN 1 / ln(r2 / r1) END AS local_id FROM g")),
    "twonn_mle": (lambda s, d: geometry.twonn(_nn(s, d, 2)), (["dimension"], f"WITH {c.DISTANCES}, g AS (SELECT id, max(dist) FILTER (rank = 1) AS r1, max(dist) FILTER (rank = 2) AS r2 FROM nn WHERE rank <= 2 GROUP BY id) SELECT count(*) AS n, 1 / avg(ln(r2 / r1)) AS dimension FROM g WHERE r1 > 0 AND r1 < r2")),
    "density": (q_density, (["density"], f"WITH {c.DISTANCES} SELECT id, 1 / (sum(dist) / 10 + 1e-10) AS density FROM nn WHERE rank <= 9 GROUP BY id")),
    "centrality": (lambda s, d: geometry.centrality(c.vectors(s, d)), (["centrality"], f"WITH {c.VECTORS}, m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) t GROUP BY i) u) SELECT id, 1 - list_inner_product(v, m) / ((sqrt(list_inner_product(v, v)) + 1e-10) * (sqrt(list_inner_product(m, m)) + 1e-10)) AS centrality FROM vectors, m")),
    "corpus_mean": (q_mean, (["mean"], f"WITH {c.VECTORS} SELECT CAST(i - 1 AS INT) AS i, avg(x) AS mean FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) t GROUP BY i")),
    "geometry_drift": (q_drift, (["r", "max_diff", "mean_diff"], f"WITH {c.DISTANCES}, g AS (SELECT id, avg(dist) FILTER (rank <= 5) AS a, avg(dist) FILTER (rank <= 10) AS b FROM nn WHERE rank <= 10 GROUP BY id) SELECT corr(a, b) AS r, max(abs(a - b)) AS max_diff, avg(abs(a - b)) AS mean_diff FROM g")),
    "risk_score": (lambda s, d: c.results(s, d).where("original_density is not null and original_centrality is not null").select("id", geometry.risk_score(F.col("original_density"), F.col("original_centrality")).alias("risk")).withColumn("risky", F.col("risk") >= 0.5).distinct(), (["risk"], f"WITH {c.RESULTS} SELECT DISTINCT id, (1 / (1 + original_density) + original_centrality) / 2 AS risk, (1 / (1 + original_density) + original_centrality) / 2 >= 0.5 AS risky FROM results WHERE original_density IS NOT NULL AND original_centrality IS NOT NULL")),
    "grid_counts": (lambda s, d: geometry.grid_counts(c.vectors(s, d), F.col("v")[0].cast("double"), F.col("v")[1].cast("double"), 20), ([], f"WITH {c.VECTORS} SELECT CAST(least(greatest(floor((v[1] + 1) / 2 * 20), 0), 19) AS INT) AS gx, CAST(least(greatest(floor((v[2] + 1) / 2 * 20), 0), 19) AS INT) AS gy, count(*) AS n FROM vectors GROUP BY 1, 2")),
    "curvature": (q_curvature, None),
    "oppositeness": (lambda s, d: geometry.oppositeness(c.vectors(s, d), 10, 3), None),
    "bootstrap_mean": (lambda s, d: resample.bootstrap_mean(_per(s, d), "p_hat"), None),
    "bootstrap_spearman": (lambda s, d: resample.bootstrap_spearman(c.results(s, d), "density_change", "centrality_change"), None),
    "nested_bootstrap": (lambda s, d: resample.nested_bootstrap(_per(s, d), "stratum", "k_eff", "p_hat"), None),
    "permutation_test": (lambda s, d: resample.permutation_difference(_per(s, d).withColumn("g", (F.col("model") == "view").cast("long")), "p_hat", "g"), None),
    "cv_feature_sets": (q_cv, None),
    "forest_geometry": (q_forest, None),
    "logit_inference": (q_logit, None),
    "likelihood_ratio": (q_lrt, None),
    "stream_running_phat": (q_stream, (["p_hat"], f"WITH {c.SAMPLES} SELECT uid, model, count(*) AS k, avg(CAST(label = 2 AS DOUBLE)) AS p_hat FROM samples GROUP BY uid, model")),
}
