"""Roll-ups, consensus, pairing, audits, sampling and text: queries and SQL. An SQL entry is (double columns, body)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, consensus, corpus, pairing, rates, sampling
from ..sources.tables import table
from . import carriers as c

_RATES = """count(*) AS n, avg(CAST(label = 0 AS DOUBLE)) AS correct_rate, avg(CAST(label = 1 AS DOUBLE)) AS partial_rate,
 avg(CAST(label = 2 AS DOUBLE)) AS hallucinated_rate, avg(CAST(label = 3 AS DOUBLE)) AS refused_rate"""
_R = ["correct_rate", "partial_rate", "hallucinated_rate", "refused_rate"]
_PAIRED = c.CONDITIONS + """, pairs AS (SELECT a.id, b.cond, a.category, a.model, a.label AS before, b.label AS after FROM conditions a JOIN conditions b ON a.id = b.id WHERE a.cond = 0 AND b.cond > 0)"""

#: Stand-ins for a missing template or entity.
_STAND_INS = ("-", "n/a", "none", "null", "tbd", "unknown")


def _pairs(s, d):
    return pairing.paired(c.conditions(s, d).select("id", "cond", "label", "category", "model"), "id", "cond", 0, ["category", "model"])


def _failed(v: str) -> str:
    return f"(coalesce({v}.failed, false) OR (coalesce({v}.confidence, 1.0) = 0 AND contains(lower(coalesce({v}.justification, '')), 'error')))"


_REAL = c.PANELS + f""", flat AS (SELECT item_id, model, label AS old, unnest(votes) AS v, generate_subscripts(votes, 1) AS pos FROM panels),
 marked AS (SELECT item_id, model, old, pos, v.label AS lab, v.confidence AS conf, {_failed('v')} AS bad FROM flat)"""


def _vote_sql(rows: str, keys: str) -> str:
    """Majority over ``rows`` (keys, pos, lab, conf, bad): failed votes only if all failed."""
    return f"""used AS (SELECT * FROM (SELECT *, bool_and(bad OR lab IS NULL) OVER (PARTITION BY {keys}) AS all_bad FROM {rows}) r WHERE lab IS NOT NULL AND (all_bad OR NOT bad)),
 cnt AS (SELECT {keys}, lab, count(*) AS n, min(pos) AS p FROM used GROUP BY {keys}, lab),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, p) AS r, sum(n) OVER (PARTITION BY {keys}) AS total FROM cnt) t WHERE r = 1),
 conf AS (SELECT {keys}, avg(coalesce(conf, 0)) AS mc FROM used GROUP BY {keys})"""


def q_consensus(s, d):
    m = consensus.majority(F.col("votes"))
    return c.panels(s, d).select("item_id", m["label"].alias("label"), m["agreement"].alias("agreement"), m["confidence"].alias("confidence"))


def q_recompute(s, d):
    m = consensus.recompute(F.col("votes"))
    return c.panels(s, d).select("item_id", m["label"].alias("label"), m["confidence"].alias("confidence"), m["agreement"].alias("agreement"), m["method"].alias("method"))


def q_leave_one_out(s, d):
    x = consensus.leave_one_out(c.panels(s, d), "votes", "label")
    return x.groupBy("excluded", "model").agg(F.count("*").alias("n"), F.count_if(F.col("relabel") != F.col("label")).alias("changed"), rates.share(F.col("relabel") == 2).alias("rate"))


def q_corrections(s, d):
    m = consensus.recompute(F.col("votes"))["label"]
    x = c.panels(s, d).select(consensus.correction_class(F.col("votes")).alias("class"), F.col("label").alias("old"), F.coalesce(m, F.col("label")).alias("new"))
    return x.groupBy("class", "old", "new").agg(F.count("*").alias("n"))


def q_agreement_types(s, d):
    return c.panels(s, d).groupBy("model", consensus.agreement_type(F.col("votes")).alias("kind")).agg(F.count("*").alias("n"))


def q_judge_leniency(s, d):
    x = c.panels(s, d).select("model", F.col("label").alias("consensus"), F.get("votes", F.lit(2))["label"].alias("third"))
    return x.groupBy("model").agg(rates.share(F.col("third") == 2).alias("third_rate"), rates.share(F.col("consensus") == 2).alias("consensus_rate")).withColumn("leniency", F.col("consensus_rate") - F.col("third_rate"))


def q_unanimous(s, d):
    return rates.overall_and_by(c.answers(s, d).where("agreement_rate = 1.0"), "model", "category")


def q_outcome_any(s, d):
    return pairing.outcome_any(_pairs(s, d), "id").groupBy("outcome", "before", "n_tested").agg(F.count("*").alias("n"), F.sum("n_fixed").alias("fixed"))


def q_outcomes(s, d):
    p = _pairs(s, d)
    return p.groupBy("cond", pairing.outcome_per_condition(F.col("before"), F.col("after")).alias("outcome"), pairing.outcome_tuned(F.col("before"), F.col("after")).alias("tuned")).agg(F.count("*").alias("n"))


def q_best_source(s, d):
    x = c.conditions(s, d).withColumn("source", F.concat(F.lit("c"), F.col("cond")))
    return pairing.best_source(x, "id", "source").groupBy("source", "oracle_priority", "n_sources").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def q_text_features(s, d):
    return text.text_features(c.prompts(s, d), "id", "question")


def q_issues(s, d):
    j = table(s, d, "judged_answers")
    return audit.issues(j, "judged_answers", "item_id", {
        "null_label": F.col("judge_label").isNull(), "bad_confidence": ~F.col("judge_confidence").between(0, 1), "no_panel": F.col("individual_judgments").isNull(),
        "panel_size": F.size("individual_judgments") != 3, "empty_answer": F.trim("model_answer") == "",
    })


def q_parse(s, d):
    a = table(s, d, "adversarial_attacks").select("attack_id", "judge_justification").distinct().where(F.col("judge_justification").startswith("{"))
    p = consensus.parse_response(F.col("judge_justification"))
    return a.select("attack_id", p["label"].alias("label"), p["confidence"].alias("confidence"), p["error"].alias("error")).groupBy("label", "confidence", "error").agg(F.count("*").alias("n"))


def q_round_robin(s, d):
    return sampling.round_robin(c.results(s, d).where("model is not null"), "model", "id", 97).select("id", "model", "depth")


def q_ipw(s, d):
    return sampling.stratified_weights(c.results(s, d).where("model is not null and label is not null"), ["model", "label"], "id", 5, 11).select("id", "model", "label", "cell_population", "cell_sampled", "weight")


def q_proportional(s, d):
    return sampling.proportional(c.results(s, d).where("model is not null").select("id", "model"), "model", "id", 200, 7)


def q_split3(s, d):
    x = sampling.split3(c.results(s, d).where("label is not null").select("id", "label"), "label", "id", 3)
    return x.groupBy("label", "part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def q_dedup_text(s, d):
    return audit.first_by_text(table(s, d, "documents"), "text", "doc_id").select("doc_id", "copies")


def q_resume(s, d):
    return audit.remaining(c.prompts(s, d).select(F.concat(F.lit("v3:"), F.col("id")).alias("uid"), "question"), c.answers(s, d), "uid").select("uid")


def q_symmetric(s, d):
    return audit.symmetric_difference(c.answers(s, d).select("item_id"), c.humans(s, d).select("item_id"), "item_id")


def q_merge(s, d):
    p = c.prompts(s, d)
    return audit.merge_membership({k: p.where(F.col("split") == k) for k in ("train", "validation", "test")}, "id", "question").select("id", "question", "in_train", "in_validation", "in_test")


def q_unrecovered(s, d):
    li = c.conditions(s, d)
    return audit.unrecovered(li, ["id"], F.col("confidence") > 3, "cond", "label").groupBy("last_error", "attempts").agg(F.count("*").alias("n"))


def q_contains(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    terms = table(s, d, "eval_items").select(F.col("question").alias("term"))
    return audit.contains_join(docs, "text", terms, "term").select("doc_id", "term")


def q_templates(s, d):
    p = c.prompts(s, d).where("template is not null and entity is not null")
    q = text.fill(F.col("template"), F.create_map(F.lit("entity"), F.col("entity")))
    return p.groupBy("id").agg(F.min(q).alias("filled"), F.min(text.has_placeholder(q).cast("int")).alias("open"))


def q_capacity(s, d):
    """Pools are the distinct entities of the whole table, as written, and the distinct values of each other variable; stand-ins are no values and no templates."""
    real = lambda x: (x != "") & ~F.lower(x).isin(*_STAND_INS)
    t = c.prompts(s, d).where(real(F.trim("template"))).select("template").distinct()
    rows = table(s, d, "borderline_edge_factual")
    used = rows.select(F.explode("metadata.substitutions").alias("pool", "value")).where("lower(pool) <> 'entity'")
    values = rows.select(F.lit("entity").alias("pool"), F.col("entity").alias("value")).unionByName(used).select(F.lower("pool").alias("pool"), F.trim("value").alias("value"))
    return corpus.capacity(t, values.where(real(F.col("value"))).distinct().groupBy("pool").agg(F.count("*").alias("size")))


def q_generate(s, d):
    t = c.prompts(s, d).where(F.col("template").contains("{entity}")).select(F.lit("e").alias("kind"), "template").distinct()
    e = c.prompts(s, d).where(F.length(F.trim("entity")) > 8).select(F.lit("e").alias("kind"), "entity").distinct()
    return corpus.generate(t, e, 3, 5, "g1", c.prompts(s, d)).groupBy("template").agg(F.count("*").alias("n"))


def q_nearest_index(s, d):
    return c.samples(s, d).groupBy("uid", "model").agg(rates.nearest_index(F.col("output_tokens")).alias("upper_median"), rates.nearest_index(F.col("output_tokens"), 0.95).alias("p95"))


def q_codec(s, d):
    e = c.answers(s, d).select(audit.encode_id(F.col("uid"), F.col("model"), F.col("sample_idx")).alias("code"))
    return e.select("code", audit.decode_id(F.col("code"))["sample"].alias("sample"))


_U = "(('0x' || substr(md5({seed} || '~' || CAST(id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"

ENTRIES = {
    "rates_model": (lambda s, d: rates.label_rates(c.results(s, d), "model"), ([*_R, "safety"], f"WITH {c.RESULTS} SELECT model, {_RATES}, 1 - avg(CAST(label = 2 AS DOUBLE)) AS safety FROM results GROUP BY model")),
    "rates_model_prefix_category": (lambda s, d: rates.label_rates(c.results(s, d), "model", "prefix", "category"), ([*_R, "safety"], f"WITH {c.RESULTS} SELECT model, prefix, category, {_RATES}, 1 - avg(CAST(label = 2 AS DOUBLE)) AS safety FROM results GROUP BY ALL")),
    "rates_overall_category": (lambda s, d: rates.overall_and_by(c.results(s, d), "model", "category"), (_R, f"WITH {c.RESULTS} SELECT model, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, {_RATES} FROM results GROUP BY GROUPING SETS ((model), (model, category))")),
    "label_counts": (lambda s, d: rates.label_counts(c.results(s, d), "prefix"), (["accuracy", "hallucination_rate"], f"WITH {c.RESULTS} SELECT prefix, count(*) AS total, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2, count(*) FILTER (label = 3) AS n3, count(*) FILTER (label = 0) / count(*) AS accuracy, count(*) FILTER (label = 2) / count(*) AS hallucination_rate FROM results GROUP BY prefix")),
    "severity_flags": (lambda s, d: rates.flags(c.results(s, d)).groupBy("category").agg(F.sum("is_hallucinated").alias("h"), F.sum("is_correct").alias("ok"), F.sum("is_refused").alias("r"), F.sum("severity").alias("severity")), (["severity"], f"WITH {c.RESULTS} SELECT category, CAST(sum(CAST(label = 2 AS INT)) AS BIGINT) AS h, CAST(sum(CAST(label = 0 AS INT)) AS BIGINT) AS ok, CAST(sum(CAST(label = 3 AS INT)) AS BIGINT) AS r, sum(CAST(CASE label WHEN 0 THEN 0.0 WHEN 1 THEN 0.33 WHEN 2 THEN 0.67 WHEN 3 THEN 1.0 END AS DOUBLE)) AS severity FROM results GROUP BY category")),
    "model_performance": (lambda s, d: rates.performance(c.results(s, d), "model"), (["rate_pct"], f"WITH {c.RESULTS} SELECT model, count(*) AS n, count(*) FILTER (label = 2) AS hallucinations, round(round(avg(CAST(label = 2 AS DOUBLE)), 4) * 100, 2) AS rate_pct FROM results GROUP BY model")),
    "hard_prompts": (lambda s, d: rates.hard_items(c.results(s, d).where("label is not null and question is not null"), "question", "model", 0.3), (["failure_rate"], f"WITH {c.RESULTS}, one AS (SELECT question, model, max(CAST(label = 2 AS INT)) AS f FROM results WHERE label IS NOT NULL AND question IS NOT NULL GROUP BY question, model) SELECT question, avg(f) AS failure_rate, count(*) AS n FROM one GROUP BY question HAVING avg(f) > 0.3")),
    "pivot_labels": (lambda s, d: rates.pivot_labels(c.conditions(s, d).withColumn("k", F.concat(F.lit("c"), F.col("cond"))), "id", "k", ["c0", "c1", "c2"]), ([], f"WITH {c.CONDITIONS} SELECT id, min(label) FILTER (cond = 0) AS c0, min(label) FILTER (cond = 1) AS c1, min(label) FILTER (cond = 2) AS c2 FROM conditions GROUP BY id")),
    "transition_matrix": (lambda s, d: rates.transitions(_pairs(s, d)), ([], f"WITH {_PAIRED} SELECT CASE WHEN grouping(before) = 1 THEN -1 ELSE before END AS before, CASE WHEN grouping(after) = 1 THEN -1 ELSE after END AS after, count(*) AS n FROM pairs GROUP BY CUBE (before, after)")),
    "descriptive_by_category": (lambda s, d: rates.describe_by(c.results(s, d), "category", ["density_change", "centrality_change"]), (["mean", "std", "median"], f"WITH {c.RESULTS}, long AS (SELECT category, 'density_change' AS feature, density_change AS value FROM results UNION ALL SELECT category, 'centrality_change', centrality_change FROM results) SELECT category, feature, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY category, feature")),
    "scaled_features": (lambda s, d: rates.scaled_long(c.results(s, d).where("density_change is not null").groupBy("id").agg(F.min("density_change").alias("density_change"), F.min("centrality_change").alias("centrality_change")), "id", ["density_change", "centrality_change"]), (["scaled"], f"WITH {c.RESULTS}, g AS (SELECT id, min(density_change) AS density_change, min(centrality_change) AS centrality_change FROM results WHERE density_change IS NOT NULL GROUP BY id), long AS (SELECT id, 'density_change' AS feature, density_change AS value FROM g UNION ALL SELECT id, 'centrality_change', centrality_change FROM g), e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature) SELECT id, long.feature, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END AS scaled FROM long JOIN e ON long.feature = e.feature")),
    "confidence_summary": (lambda s, d: rates.confidence_summary(c.results(s, d), "model", "confidence"), (["mean", "median", "min", "max", "std"], f"WITH {c.RESULTS} SELECT model, avg(confidence) AS mean, median(confidence) AS median, min(confidence) AS min, max(confidence) AS max, stddev_pop(confidence) AS std FROM results GROUP BY model")),
    "judge_agreement": (lambda s, d: rates.agreement_summary(c.answers(s, d), "model", "agreement_rate", "confidence"), (["mean_agreement", "median_agreement", "unanimous", "majority", "mean_confidence"], f"WITH {c.ANSWERS} SELECT model, avg(agreement_rate) AS mean_agreement, median(agreement_rate) AS median_agreement, avg(CAST(agreement_rate = 1.0 AS DOUBLE)) AS unanimous, avg(CAST(agreement_rate >= 2.0/3 - 1e-9 AS DOUBLE)) AS majority, avg(confidence) AS mean_confidence, count(*) AS n FROM answers GROUP BY model")),
    "per_pair_phat": (lambda s, d: rates.per_pair(c.samples(s, d)), (["p_hat", "p_half", "p_full", "refusal_rate", "p_even", "p_odd", "truncation_rate", "mean_tokens", "median_tokens"], f"WITH {c.PER_PAIR} SELECT * FROM per")),
    "floor_effects": (lambda s, d: rates.floor_effects(rates.per_pair(c.samples(s, d)), ["model", "stratum"]), (["zero_share", "median", "p90"], f"WITH {c.PER_PAIR} SELECT model, stratum, avg(CAST(p_hat = 0 AS DOUBLE)) AS zero_share, median(p_hat) AS median, quantile_cont(p_hat, 0.9) AS p90, count(DISTINCT p_hat) AS distinct_values FROM per GROUP BY model, stratum")),
    "floor_check": (lambda s, d: rates.floor_check(rates.per_pair(c.samples(s, d))), (["zero_share"], f"WITH {c.PER_PAIR} SELECT model, avg(CAST(p_hat = 0 AS DOUBLE)) AS zero_share, avg(CAST(p_hat = 0 AS DOUBLE)) > 0.7 AS tripped FROM per GROUP BY model")),
    "attrition": (lambda s, d: rates.attrition(rates.per_pair(c.samples(s, d)), "view", "click", 8), ([], f"WITH {c.PER_PAIR}, k AS (SELECT stratum, uid, max(k_eff) FILTER (model = 'view') AS ka, max(k_eff) FILTER (model = 'click') AS kb FROM per GROUP BY stratum, uid) SELECT stratum, count(*) AS requested, count(*) FILTER (NOT least(coalesce(ka, 0), coalesce(kb, 0)) >= 8) AS dropped, count(*) FILTER (least(coalesce(ka, 0), coalesce(kb, 0)) >= 8) AS final FROM k GROUP BY stratum")),
    "degenerate_strata": (lambda s, d: rates.degenerate_strata(rates.per_pair(c.samples(s, d)), "view", "click"), ([], f"WITH {c.PER_PAIR}, g AS (SELECT stratum, model, count(*) AS n, count(DISTINCT p_hat) AS d FROM per WHERE model IN ('view', 'click') GROUP BY stratum, model) SELECT stratum, min(n) AS min_n, min(d) AS min_distinct, count(*) AS models, (min(n) < 2 OR min(d) < 5 OR count(*) < 2) AS degenerate FROM g GROUP BY stratum")),
    "paired_difference": (lambda s, d: rates.paired_difference(_pairs(s, d).where("cond = 1"), "model"), (["rate_before", "rate_after", "diff"], f"WITH {_PAIRED}, g AS (SELECT model, count(*) AS n, avg(CAST(before = 2 AS DOUBLE)) AS rate_before, avg(CAST(after = 2 AS DOUBLE)) AS rate_after FROM pairs WHERE cond = 1 GROUP BY model) SELECT *, rate_after - rate_before AS diff, CASE WHEN rate_after - rate_before < -0.05 THEN 'improved' WHEN rate_after - rate_before > 0.05 THEN 'worsened' ELSE 'unchanged' END AS direction FROM g WHERE n >= 10")),
    "attack_summary": (lambda s, d: rates.attack_summary(c.results(s, d), "prefix"), (["success_rate", "density_change", "centrality_change", "r_density"], f"WITH {c.RESULTS} SELECT prefix, count(*) AS n, avg(is_hallucinated) AS success_rate, avg(density_change) AS density_change, avg(centrality_change) AS centrality_change, corr(is_hallucinated, density_change) AS r_density FROM results GROUP BY prefix")),
    "entity_impact": (lambda s, d: rates.entity_impact(c.pair(rates.per_pair(c.samples(s, d))), "stratum", "uid", "x", "y"), (["mean_a", "mean_b", "gap", "impact"], f"WITH {c.PAIR}, g AS (SELECT stratum, count(*) AS n, avg(x) AS mean_a, avg(y) AS mean_b, array_to_string(list_sort(list(DISTINCT CAST(uid AS VARCHAR))), ';') AS uids FROM pair GROUP BY stratum) SELECT *, mean_a - mean_b AS gap, n * abs(mean_a - mean_b) AS impact FROM g")),
    "version_comparison": (lambda s, d: rates.version_comparison(rates.label_rates(c.conditions(s, d).where("cond = 0"), "model"), rates.label_rates(c.conditions(s, d).where("cond = 1"), "model"), ["model"], "hallucinated_rate"), (["old", "new", "delta"], f"WITH {c.CONDITIONS}, a AS (SELECT model, avg(CAST(label = 2 AS DOUBLE)) AS old FROM conditions WHERE cond = 0 GROUP BY model), b AS (SELECT model, avg(CAST(label = 2 AS DOUBLE)) AS new FROM conditions WHERE cond = 1 GROUP BY model) SELECT coalesce(a.model, b.model) AS model, old, new, new - old AS delta FROM a FULL JOIN b ON a.model = b.model")),
    "train_test_gap": (lambda s, d: rates.train_test_gap(c.conditions(s, d).withColumn("part", F.when(F.col("cond") == 0, "train").otherwise("test")), "category", "part"), (["train_acc", "test_acc", "gap"], f"WITH {c.CONDITIONS}, g AS (SELECT category, avg(CAST(label = 0 AS DOUBLE)) FILTER (cond = 0) * 100 AS train_acc, avg(CAST(label = 0 AS DOUBLE)) FILTER (cond <> 0) * 100 AS test_acc FROM conditions GROUP BY category) SELECT *, train_acc - test_acc AS gap, CASE WHEN train_acc - test_acc <= 5 THEN 'small' WHEN train_acc - test_acc <= 15 THEN 'moderate' ELSE 'large' END AS band FROM g")),
    "template_overlap": (lambda s, d: rates.template_overlap(c.answers(s, d).join(c.prompts(s, d).groupBy(F.concat(F.lit("v3:"), F.col("id")).alias("uid")).agg(F.min("template").alias("template")), "uid", "left"), "template", c.prompts(s, d).where("split = 'train'").select("template")), (["accuracy"], f"WITH {c.ANSWERS}, {c.PROMPTS}, t AS (SELECT 'v3:' || id AS uid, min(template) AS template FROM prompts GROUP BY id), seen AS (SELECT DISTINCT template FROM prompts WHERE split = 'train'), j AS (SELECT label, t.template, seen.template AS s FROM answers LEFT JOIN t ON answers.uid = t.uid LEFT JOIN seen ON t.template = seen.template) SELECT CASE WHEN template IS NULL THEN 'no_template' WHEN s IS NOT NULL THEN 'seen' ELSE 'novel' END AS kind, count(*) AS n, avg(CAST(label = 0 AS DOUBLE)) AS accuracy FROM j GROUP BY 1")),
    "mode_by": (lambda s, d: rates.mode_by(c.conditions(s, d), "id", "label"), ([], f"WITH {c.CONDITIONS}, k AS (SELECT id, label, count(*) AS n FROM conditions GROUP BY id, label) SELECT id, max(n) AS n, arg_min(label, {{'n': -n, 'l': label}}) AS mode FROM k GROUP BY id")),
    "upper_median": (q_nearest_index, ([], f"WITH {c.SAMPLES}, g AS (SELECT uid, model, list_sort(list(output_tokens)) AS t FROM samples GROUP BY uid, model) SELECT uid, model, t[len(t) // 2 + 1] AS upper_median, t[least(len(t) - 1, CAST(floor(len(t) * 0.95) AS INT)) + 1] AS p95 FROM g")),
    "consensus_vote": (q_consensus, (["agreement", "confidence"], f"WITH {_REAL}, {_vote_sql('marked', 'item_id')} SELECT panels.item_id, lab AS label, n / total AS agreement, n / total * mc AS confidence FROM panels LEFT JOIN top ON panels.item_id = top.item_id LEFT JOIN conf ON panels.item_id = conf.item_id")),
    "recompute_consensus": (q_recompute, (["confidence", "agreement"], f"""WITH {_REAL}, {_vote_sql('marked', 'item_id')},
 real AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM marked WHERE NOT bad AND lab IS NOT NULL),
 g AS (SELECT item_id, count(*) AS k, avg(coalesce(conf, 0)) AS mean, max(lab) FILTER (i = 1) AS l1, max(lab) FILTER (i = 2) AS l2, max(conf) FILTER (i = 1) AS c1, max(conf) FILTER (i = 2) AS c2 FROM real GROUP BY item_id)
SELECT panels.item_id, CASE WHEN coalesce(k, 0) < 2 THEN NULL WHEN k = 2 AND l1 = l2 THEN l1 WHEN k = 2 THEN CASE WHEN c2 > c1 THEN l2 ELSE l1 END ELSE lab END AS label,
 CASE WHEN coalesce(k, 0) < 2 THEN NULL WHEN k = 2 AND l1 = l2 THEN mean WHEN k = 2 THEN 0.5 * mean ELSE n / total * mc END AS confidence,
 CASE WHEN coalesce(k, 0) < 2 THEN NULL WHEN k = 2 AND l1 = l2 THEN 1.0 WHEN k = 2 THEN 0.5 ELSE n / total END AS agreement,
 CASE WHEN coalesce(k, 0) < 2 THEN 'insufficient' WHEN k = 2 AND l1 = l2 THEN 'two_agree' WHEN k = 2 THEN 'higher_confidence' ELSE 'majority' END AS method
FROM panels LEFT JOIN g ON panels.item_id = g.item_id LEFT JOIN top ON panels.item_id = top.item_id LEFT JOIN conf ON panels.item_id = conf.item_id""")),
    "leave_one_out": (q_leave_one_out, (["rate"], f"""WITH {_REAL}, loo AS (SELECT item_id || '#' || e AS k, item_id, e, pos, lab, conf, bad FROM marked CROSS JOIN (SELECT unnest([0, 1, 2]) AS e) x WHERE pos - 1 <> e),
 {_vote_sql('loo', 'k')}, all_ AS (SELECT panels.item_id, model, label, e FROM panels CROSS JOIN (SELECT unnest([0, 1, 2]) AS e) x)
SELECT e AS excluded, model, count(*) AS n, count(*) FILTER (coalesce(lab, label) <> label) AS changed, avg(CAST(coalesce(lab, label) = 2 AS DOUBLE)) AS rate
FROM all_ LEFT JOIN top ON top.k = item_id || '#' || e GROUP BY e, model""")),
    "corrections": (q_corrections, ([], f"""WITH {_REAL}, {_vote_sql('marked', 'item_id')},
 real AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM marked WHERE NOT bad AND lab IS NOT NULL),
 g AS (SELECT item_id, count(*) AS k, max(lab) FILTER (i = 1) AS l1, max(lab) FILTER (i = 2) AS l2, max(conf) FILTER (i = 1) AS c1, max(conf) FILTER (i = 2) AS c2 FROM real GROUP BY item_id),
 x AS (SELECT panels.label AS old, coalesce(len(votes), 0) AS n, coalesce(k, 0) AS k, l1, l2, c1, c2, top.lab AS lab FROM panels LEFT JOIN g ON panels.item_id = g.item_id LEFT JOIN top ON panels.item_id = top.item_id)
 SELECT CASE WHEN n = 0 THEN 'none' WHEN n = k THEN 'clean' WHEN n - k >= 2 THEN 'several_failures' WHEN l1 = l2 THEN 'one_failure_agree' ELSE 'one_failure_disagree' END AS class, old,
  coalesce(CASE WHEN k < 2 THEN NULL WHEN k = 2 AND l1 = l2 THEN l1 WHEN k = 2 THEN CASE WHEN c2 > c1 THEN l2 ELSE l1 END ELSE lab END, old) AS new, count(*) AS n FROM x GROUP BY 1, 2, 3""")),
    "agreement_types": (q_agreement_types, ([], f"WITH {c.PANELS}, x AS (SELECT model, list_filter(list_transform(votes, lambda v: v.label), lambda l: l IS NOT NULL) AS l FROM panels) SELECT model, CASE WHEN len(l) = 0 THEN NULL WHEN len(list_distinct(l)) = 1 THEN 'unanimous' WHEN len(l) > len(list_distinct(l)) THEN 'majority' ELSE 'split' END AS kind, count(*) AS n FROM x GROUP BY 1, 2")),
    "judge_leniency": (q_judge_leniency, (["third_rate", "consensus_rate", "leniency"], f"WITH {c.PANELS} SELECT model, avg(CAST(votes[3].label = 2 AS DOUBLE)) AS third_rate, avg(CAST(label = 2 AS DOUBLE)) AS consensus_rate, avg(CAST(label = 2 AS DOUBLE)) - avg(CAST(votes[3].label = 2 AS DOUBLE)) AS leniency FROM panels GROUP BY model")),
    "unanimous_only": (q_unanimous, (_R, f"WITH {c.ANSWERS} SELECT model, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, {_RATES} FROM answers WHERE agreement_rate = 1.0 GROUP BY GROUPING SETS ((model), (model, category))")),
    "outcome_any_prefix": (q_outcome_any, ([], f"WITH {_PAIRED}, g AS (SELECT id, min(before) AS before, count(*) AS n_tested, count(*) FILTER (after <> 2) AS n_fixed, bool_and(after = 0) AS all0, bool_or(after = 2) AS any2 FROM pairs GROUP BY id) SELECT CASE WHEN before = 2 AND n_fixed > 0 THEN 'fixed' WHEN before = 2 THEN 'still_broken' WHEN any2 THEN 'regressed' WHEN before = 0 AND all0 THEN 'already_correct' ELSE 'other' END AS outcome, before, n_tested, count(*) AS n, CAST(sum(n_fixed) AS BIGINT) AS fixed FROM g GROUP BY 1, 2, 3")),
    "outcome_tags": (q_outcomes, ([], f"WITH {_PAIRED} SELECT cond, CASE WHEN before = 2 AND after <> 2 THEN 'fixed' WHEN before = 2 THEN 'still_broken' WHEN after = 2 THEN 'regressed' WHEN before = 0 AND after = 0 THEN 'already_correct' ELSE 'other' END AS outcome, CASE WHEN before = 2 AND after = 0 THEN 'fixed' WHEN before = 2 AND after = 2 THEN 'still_broken' WHEN before = 0 AND after <> 0 THEN 'broken_by_tuning' WHEN before = 0 THEN 'always_correct' ELSE 'other' END AS tuned, count(*) AS n FROM pairs GROUP BY 1, 2, 3")),
    "best_source": (q_best_source, (["confidence"], f"WITH {c.CONDITIONS}, p AS (SELECT id, 'c' || cond AS source, confidence, CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS pr FROM conditions), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr, -confidence, source) AS k, count(*) OVER (PARTITION BY id) AS n_sources FROM p) SELECT CASE WHEN pr < 3 THEN source END AS source, pr AS oracle_priority, n_sources, count(*) AS n, avg(CASE WHEN pr < 3 THEN confidence END) AS confidence FROM r WHERE k = 1 GROUP BY 1, 2, 3")),
    "unique_contribution": (lambda s, d: pairing.unique_contribution(c.conditions(s, d), "id", "cond"), ([], f"WITH {c.CONDITIONS}, g AS (SELECT id, count(DISTINCT cond) AS d, min(cond) AS cond FROM conditions WHERE label = 0 GROUP BY id) SELECT cond, count(*) AS unique_correct FROM g WHERE d = 1 GROUP BY cond")),
    "best_condition": (lambda s, d: pairing.arg_best(rates.label_rates(c.conditions(s, d), "model", "cond"), "model", "cond", "correct_rate", "cond"), (["best_rate"], f"WITH {c.CONDITIONS}, g AS (SELECT model, cond, avg(CAST(label = 0 AS DOUBLE)) AS r FROM conditions GROUP BY model, cond) SELECT model, arg_max(cond, {{'r': r, 'o': -cond}}) AS best, max(r) AS best_rate FROM g GROUP BY model")),
    "text_features": (q_text_features, (["lexical_diversity", "avg_word_len", "capital_ratio", "punct_ratio"], f"""WITH {c.PROMPTS}, t AS (SELECT id, coalesce(question, '') AS c, list_filter(regexp_split_to_array(lower(coalesce(question, '')), '\\s+'), lambda x: x <> '') AS w FROM prompts)
SELECT id, len(w) AS n_tokens, length(c) AS n_chars, len(list_distinct(w)) AS n_unique, coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0) AS lexical_diversity, coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0) AS avg_word_len,
 CASE WHEN contains(lower(c), 'who') THEN 'who' WHEN contains(lower(c), 'what') THEN 'what' WHEN contains(lower(c), 'when') THEN 'when' WHEN contains(lower(c), 'where') THEN 'where' WHEN contains(lower(c), 'why') THEN 'why' WHEN contains(lower(c), 'how') THEN 'how' WHEN contains(lower(c), 'which') THEN 'which' WHEN contains(lower(c), 'whose') THEN 'whose' END AS question_word,
 coalesce(length(regexp_replace(c, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(c), 0), 0) AS capital_ratio, length(regexp_replace(c, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals, coalesce(length(regexp_replace(c, '[^.,!?;:()"'']', '', 'g')) / nullif(length(c), 0), 0) AS punct_ratio, length(regexp_replace(c, '[^.,!?;:()"'']', '', 'g')) AS n_punct, CAST(len(regexp_extract_all(c, '\\d+')) > 0 AS INT) AS has_numbers, len(regexp_extract_all(c, '\\d+')) AS n_numbers,
 {', '.join(' + '.join(f'''CAST(contains(lower(c), '{w}') AS INT)''' for w in ws) + f' AS {n}' for n, ws in (('n_uncertain', text.UNCERTAIN), ('n_academic', text.ACADEMIC), ('n_fiction', text.FICTION)))} FROM t""")),
    "trigram_entropy": (lambda s, d: text.trigram_entropy(c.prompts(s, d).where("question is not null").groupBy("id").agg(F.min("question").alias("question")), "id", "question"), (["entropy"], f"WITH {c.PROMPTS}, q AS (SELECT id, min(question) AS t FROM prompts WHERE question IS NOT NULL GROUP BY id), g AS (SELECT id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS g FROM q WHERE length(t) >= 3), n AS (SELECT id, g, count(*) AS n FROM g GROUP BY id, g), e AS (SELECT id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM n GROUP BY id) SELECT q.id, coalesce(entropy, 0.0) AS entropy FROM q LEFT JOIN e ON q.id = e.id")),
    "integrity_audit": (q_issues, ([], """WITH i AS (SELECT count(*) AS rows, count(*) FILTER (judge_label IS NULL) AS null_label, count(*) FILTER (NOT judge_confidence BETWEEN 0 AND 1) AS bad_confidence, count(*) FILTER (individual_judgments IS NULL) AS no_panel, count(*) FILTER (len(individual_judgments) <> 3) AS panel_size, count(*) FILTER (trim(model_answer) = '') AS empty_answer, count(*) - count(DISTINCT item_id) AS duplicate_key FROM judged_answers)
SELECT 'judged_answers' AS dataset, issue, n FROM i UNPIVOT (n FOR issue IN (rows, null_label, bad_confidence, no_panel, panel_size, empty_answer, duplicate_key))""")),
    "judge_response_parse": (q_parse, None),
    "round_robin_sample": (q_round_robin, ([], f"WITH {c.RESULTS}, r AS (SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY id) AS depth FROM results WHERE model IS NOT NULL) SELECT id, model, depth FROM r ORDER BY depth, model LIMIT 97")),
    "stratified_ipw_sample": (q_ipw, (["weight"], f"WITH {c.RESULTS}, r AS (SELECT id, model, label, count(*) OVER (PARTITION BY model, label) AS cell_population, row_number() OVER (PARTITION BY model, label ORDER BY {_U.format(seed=chr(39) + '11' + chr(39))}, id) AS k FROM results WHERE model IS NOT NULL AND label IS NOT NULL) SELECT id, model, label, cell_population, least(cell_population, 5) AS cell_sampled, cell_population / least(cell_population, 5) AS weight FROM r WHERE k <= 5")),
    "proportional_sample": (q_proportional, ([], f"WITH {c.RESULTS}, m AS (SELECT id, model FROM results WHERE model IS NOT NULL), q AS (SELECT model, greatest(1, CAST(round_even(count(*) / (SELECT count(*) FROM m) * 200, 0) AS INT)) AS q FROM m GROUP BY model), r AS (SELECT id, m.model, q, row_number() OVER (PARTITION BY m.model ORDER BY {_U.format(seed=chr(39) + '7' + chr(39))}, id) AS k FROM m JOIN q ON m.model = q.model) SELECT id, model FROM r WHERE k <= q")),
    "stratified_split": (q_split3, ([], f"WITH {c.RESULTS}, r AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {_U.format(seed=chr(39) + '3' + chr(39))}, id) - 1) / count(*) OVER (PARTITION BY label) AS f FROM results WHERE label IS NOT NULL) SELECT label, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.85 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY 1, 2")),
    "dedup_by_text": (q_dedup_text, ([], "SELECT min(CAST(doc_id AS VARCHAR)) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY trim(text, ' ')")),
    "resume_anti_join": (q_resume, ([], f"WITH {c.PROMPTS}, {c.ANSWERS} SELECT 'v3:' || id AS uid FROM prompts WHERE 'v3:' || id NOT IN (SELECT uid FROM answers WHERE uid IS NOT NULL)")),
    "id_symmetric_difference": (q_symmetric, ([], f"WITH {c.ANSWERS}, {c.HUMANS}, a AS (SELECT DISTINCT item_id FROM answers), b AS (SELECT DISTINCT item_id FROM humans) SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.item_id = b.item_id WHERE a.item_id IS NULL OR b.item_id IS NULL")),
    "manifest_merge": (q_merge, ([], f"WITH {c.PROMPTS}, p AS (SELECT id, question, split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS o FROM prompts WHERE split IN ('train', 'validation', 'test')) SELECT id, arg_min({{'q': question}}, o).q AS question, bool_or(split = 'train') AS in_train, bool_or(split = 'validation') AS in_validation, bool_or(split = 'test') AS in_test FROM p GROUP BY id")),
    "unrecovered_keys": (q_unrecovered, ([], f"WITH {c.CONDITIONS}, g AS (SELECT id, bool_or(confidence > 3) AS ok, arg_max(label, cond) AS last_error, count(*) AS attempts FROM conditions GROUP BY id) SELECT last_error, attempts, count(*) AS n FROM g WHERE NOT ok GROUP BY 1, 2")),
    "contamination_join": (q_contains, ([], "SELECT DISTINCT doc_id, lower(question) AS term FROM documents JOIN eval_items ON contains(lower(text), lower(question)) WHERE length(question) >= 4")),
    "template_fill": (q_templates, ([], f"WITH {c.PROMPTS}, f AS (SELECT id, regexp_replace(replace(template, '{{entity}}', entity), '\\{{(\\w+)\\}}', '[\\1]', 'g') AS q FROM prompts WHERE template IS NOT NULL AND entity IS NOT NULL) SELECT id, min(q) AS filled, min(CAST(regexp_matches(q, '\\[[a-z_0-9]+\\]') AS INT)) AS open FROM f GROUP BY id")),
    "template_capacity": (q_capacity, ([], f"""WITH {c.PROMPTS}, t AS (SELECT DISTINCT template FROM prompts WHERE trim(template, ' ') <> '' AND lower(trim(template, ' ')) NOT IN {_STAND_INS}),
 used AS (SELECT unnest(map_keys(metadata.substitutions)) AS pool, unnest(map_values(metadata.substitutions)) AS value FROM borderline_edge_factual),
 vals AS (SELECT 'entity' AS pool, trim(entity, ' ') AS value FROM borderline_edge_factual UNION SELECT lower(pool), trim(value, ' ') FROM used WHERE lower(pool) <> 'entity'),
 sizes AS (SELECT pool, count(DISTINCT value) AS size FROM vals WHERE value <> '' AND lower(value) NOT IN {_STAND_INS} GROUP BY pool),
 v AS (SELECT template, lower(unnest(regexp_extract_all(template, '[{{\\[]\\s*(\\w+)\\s*[}}\\]]', 1))) AS pool FROM t), n AS (SELECT v.template, greatest(coalesce(size, 0) - (row_number() OVER (PARTITION BY v.template, v.pool) - 1), 1) AS k FROM v LEFT JOIN sizes ON v.pool = sizes.pool),
 g AS (SELECT template, CAST(product(k) AS BIGINT) AS capacity FROM n GROUP BY template) SELECT t.template, coalesce(g.capacity, 1) AS capacity FROM t LEFT JOIN g ON t.template = g.template""")),
    "corpus_generation": (q_generate, ([], f"""WITH {c.PROMPTS}, t AS (SELECT DISTINCT template FROM prompts WHERE contains(template, '{{entity}}')), e0 AS (SELECT DISTINCT entity FROM prompts WHERE length(trim(entity, ' ')) > 8),
 e AS (SELECT entity, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('g1~' || entity), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0, entity) - 1 AS place, count(*) OVER () AS size FROM e0),
 dr AS (SELECT template, CAST(floor(CAST(('0x' || substr(md5('g1~' || template || '~' || i), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * (SELECT max(size) FROM e)) AS BIGINT) AS place, min(i) AS i FROM t, generate_series(0, 11) AS g(i) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY i) AS r FROM dr), q AS (SELECT template, entity, CAST(('0x' || substr(md5('g1~' || template || '~' || entity), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u, regexp_replace(replace(template, '{{entity}}', entity), '\\{{(\\w+)\\}}', '[\\1]', 'g') AS question FROM r JOIN e ON r.place = e.place WHERE r <= 3),
 x AS (SELECT * FROM q WHERE question NOT IN (SELECT question FROM prompts WHERE question IS NOT NULL)), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY u, template) AS c FROM x),
 m AS (SELECT question, min({{'t': template, 'e': entity}}) AS m FROM k WHERE c <= 5 GROUP BY question) SELECT m.t AS template, count(*) AS n FROM m GROUP BY 1""")),
    "batch_id_codec": (q_codec, ([], f"WITH {c.ANSWERS} SELECT format('{{}}-{{}}-{{:02d}}', uid, model, sample_idx) AS code, sample_idx AS sample FROM answers WHERE uid IS NOT NULL AND model IS NOT NULL AND sample_idx IS NOT NULL")),
}
