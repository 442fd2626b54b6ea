"""Judged logs, joins, validation and study reports: queries and SQL. An SQL entry is (double columns, body)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, corpus, geometry, judging, ml, pairing, ranks, rates, sampling, stats
from ..session import Scratch
from ..sources import files
from ..sources.tables import table
from . import carriers as c
from .evaluation import _PAIRED, _pairs

K = ["uid", "model", "sample_idx"]


def base(s, d):
    """Sampled completions with their place in the log and some failures."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("int")).withColumn("sample_idx", F.row_number().over(w) - 1)
    label = F.when(F.col("k") < 10 + (F.col("user_id") * 7) % 60, 2).when(F.col("k") < 80, 0).when(F.col("k") < 90, 1).otherwise(3)
    return e.select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("model"), "sample_idx", "k", F.col("event_id").alias("pos"), label.alias("label"),
        F.floor(F.col("value") * 10).cast("int").alias("output_tokens"), (F.col("value") > 100).alias("truncated"), (F.col("k") % 13 == 0).alias("generation_failed"),
        F.when(F.col("k") % 13 == 0, F.when(F.col("k") % 2 == 0, "empty completion (finish_reason=length)").otherwise("timeout")).alias("error"),
    )


def judged_log(b):
    """An append-only log: first tries, recoveries, double judgements, orphans."""
    ok = b.where(~F.col("generation_failed"))
    row = lambda df, n, idx, failed, label: df.select("uid", "model", idx.alias("sample_idx"), (F.col("pos") * 4 + n).alias("pos"), failed.alias("judge_failed"), label.alias("label"))
    no, i = F.lit(False), F.col("sample_idx")
    return (
        row(ok, 0, i, F.col("k") % 7 == 0, F.when(F.col("k") % 7 != 0, F.col("label"))).unionByName(row(ok.where("k % 7 = 0 and k % 3 <> 0"), 1, i, no, F.col("label")))
        .unionByName(row(ok.where("k % 11 = 0"), 2, i, no, F.col("label"))).unionByName(row(ok.where("k % 17 = 0"), 3, i + 1000, no, F.col("label")))
    )


BASE = """base AS (SELECT user_id AS uid, event_type AS model, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS sample_idx, k, event_id AS pos,
  CASE WHEN k < 10 + (user_id * 7) % 60 THEN 2 WHEN k < 80 THEN 0 WHEN k < 90 THEN 1 ELSE 3 END AS label, CAST(floor(value * 10) AS INT) AS output_tokens, (value > 100) AS truncated,
  k % 13 = 0 AS generation_failed, CASE WHEN k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'empty completion (finish_reason=length)' ELSE 'timeout' END END AS error
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e)"""
LOG = (
    BASE
    + """, log AS (SELECT uid, model, sample_idx, pos * 4 AS pos, k % 7 = 0 AS judge_failed, CASE WHEN k % 7 <> 0 THEN label END AS label FROM base WHERE NOT generation_failed
  UNION ALL SELECT uid, model, sample_idx, pos * 4 + 1, false, label FROM base WHERE NOT generation_failed AND k % 7 = 0 AND k % 3 <> 0
  UNION ALL SELECT uid, model, sample_idx, pos * 4 + 2, false, label FROM base WHERE NOT generation_failed AND k % 11 = 0
  UNION ALL SELECT uid, model, sample_idx + 1000, pos * 4 + 3, false, label FROM base WHERE NOT generation_failed AND k % 17 = 0)"""
)
GOOD = LOG + """, good AS (SELECT l.uid, l.model, l.sample_idx, l.label, l.pos FROM log l WHERE l.uid % 29 <> 0 AND NOT judge_failed AND label IS NOT NULL),
 used AS (SELECT g.* FROM good g JOIN base b ON g.uid = b.uid AND g.model = b.model AND g.sample_idx = b.sample_idx),
 lab AS (SELECT uid, model, sample_idx, arg_min(label, pos) AS label, count(*) AS n FROM used GROUP BY 1, 2, 3)"""


def _loaded(s, d):
    b = base(s, d)
    return judging.load_judged(b, judged_log(b), b.where("uid % 29 <> 0").select("uid"), K, "pos")


def q_load(s, d):
    return _loaded(s, d)[0].groupBy("model", "label").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"), F.count_if("truncated").alias("truncated"))


def q_load_counts(s, d):
    return _loaded(s, d)[1]


def q_best_completion(s, d):
    b = base(s, d).withColumn("text", F.when(~F.col("generation_failed"), F.concat(F.lit("t"), F.col("output_tokens"))).otherwise(""))
    return judging.best_completion(b.withColumn("slot", (F.col("sample_idx") / 3).cast("int")), ["uid", "model", "slot"], "text", "pos").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.sum("pos").alias("pos"))


def _frame(b):
    return b.select("uid").distinct().crossJoin(F.broadcast(b.select("model").distinct()))


def q_generation_state(s, d):
    b = base(s, d)
    return judging.generation_state(_frame(b), b, ["uid", "model"], 20, 16)


def q_judging_state(s, d):
    b = base(s, d)
    return judging.judging_state(b, judged_log(b), K)


def q_failure_causes(s, d):
    b = base(s, d).where("generation_failed")
    return b.groupBy("model", judging.failure_cause(F.col("generation_failed"), F.col("error")).alias("cause")).agg(F.count("*").alias("n"))


#: Stems of the synthetic model names, as families.
_STEMS = {k: (k,) for k in ("arbiter", "assay", "basalt", "corvid", "heron", "lumen", "mistvale", "orrery", "quill", "tern")} | {"heron-instruct": ("heron", "instruct")}


def q_independence(s, d):
    j = table(s, d, "judged_answers").select(F.explode(F.split("judge_model", r"\+")).alias("judge"))
    return judging.independence(j.where("judge <> ''"), "judge", c.answers(s, d).where("model is not null"), "model", _STEMS)


def q_low_confidence(s, d):
    return c.answers(s, d).where("confidence < 0.5").select("item_id", "label", "confidence")


_WORDS = ("almanac", "lighthouse", "treaty")


def q_keywords(s, d):
    p = c.prompts(s, d)
    a = c.answers(s, d).withColumn("prompt", F.regexp_replace("uid", "^v3:", ""))
    out = judging.remove_with_dependants(p, "id", judging.mentions(_WORDS, F.col("question"), F.col("entity")), {"answers": (a, "prompt")})
    one = lambda n, df, k: df.agg(F.count_distinct(k).alias("n")).select(F.lit(n).alias("part"), "n")
    return one("prompts", out[""], "id").unionByName(one("answers", out["answers"], "item_id"))


def q_prefixes(s, d):
    loose = F.coalesce(F.contains("question", F.lit("[")), F.lit(False))
    return c.answers(s, d).groupBy(F.startswith("uid", F.lit("v3:")).alias("kept"), loose.alias("open")).agg(F.count("*").alias("n"))


def q_risk(s, d):
    kind = F.when(F.col("entity").rlike("(?i)lake|mount|port|fort"), "places").when(F.col("entity").rlike("(?i)manuscript|codex"), "books").otherwise("other")
    e = c.prompts(s, d).where("trim(entity) <> ''").select("entity", kind.alias("subset")).distinct()
    return e.groupBy("subset", judging.risk_flags(F.col("entity"), F.col("subset")).alias("flags")).agg(F.count("*").alias("n"))


def _measures(s, d):
    return c.results(s, d).groupBy("id").agg(F.max("label").alias("label"), F.min("category").alias("category"), F.max("confidence").alias("confidence"))


def _geo(s, d):
    g = c.results(s, d).groupBy("id").agg(F.max("original_density").alias("density"), F.max("prefix").alias("category"))
    return g.where("id % 3 <> 0")


def q_left_suffix(s, d):
    return judging.left_with_suffix(_measures(s, d), _geo(s, d), "id", "_geo").groupBy("category", "category_geo").agg(F.count("*").alias("n"), F.avg("density").alias("density"))


def q_fan_out(s, d):
    g = _geo(s, d)
    twice = g.unionByName(g.where("id % 5 = 0"))
    one = lambda n, f: judging.left_with_suffix(_measures(s, d), twice, "id", "_geo", f).agg(F.count("*").alias("n")).select(F.lit(n).alias("join"), "n")
    return one("deduplicated", False).unionByName(one("fan_out", True))


def q_coalescing(s, d):
    j = judging.inner_coalescing(_measures(s, d), _geo(s, d), "id", "category")
    return j.groupBy("category").agg(F.count("*").alias("n"), F.avg("density").alias("density"))


def q_asserted(s, d):
    m = _measures(s, d)
    n = m.where("id % 3 <> 0").agg(F.count("*").alias("n")).first().n
    return judging.asserted_size(m.join(_geo(s, d), "id", "left_semi"), F.lit(n))


def q_feature_join(s, d):
    f = text.text_features(c.prompts(s, d), "id", "question").groupBy("id").agg(F.max("n_tokens").alias("n_tokens"))
    a = c.answers(s, d).withColumn("id", F.regexp_replace("uid", "^v3:", ""))
    return judging.left_with_suffix(a, f, "id").groupBy("category").agg(F.count("*").alias("n"), F.count("n_tokens").alias("with_features"), F.avg("n_tokens").alias("mean_tokens"))


def q_columns(s, d):
    return judging.drop_present(judging.keep_present(_measures(s, d), ["id", "label", "missing", "confidence"]), ["confidence", "absent"])


def q_mixed(s, d):
    v = c.panels(s, d).select("model", F.explode("votes").alias("v"))
    return judging.mixed_flags(v.select("model", "v.label", "v.mixed_rejection_then_fabrication"), "label", "mixed_rejection_then_fabrication", "model")


def _means(s, d):
    return c.pair(rates.per_pair(c.samples(s, d))).groupBy("stratum").agg(F.avg("x").alias("a"), F.avg("y").alias("b"))


def q_ordering(s, d):
    return stats.tau_blocked(_means(s, d).withColumn("one", F.lit(1)), "a", "b", "one").select("n", "pairs", "tau")


def q_rank_pct(s, d):
    return ranks.average_rank(_measures(s, d).where("confidence is not null"), "confidence", "category").select("id", "category", (F.col("rank") / F.count("*").over(Window.partitionBy("category"))).alias("pct"))


def q_last_remainder(s, d):
    return sampling.last_remainder(c.results(s, d).where("model is not null").select("id", "model").distinct(), "model", "id", 100, 5)


def q_label_plan(s, d):
    cells = c.answers(s, d).where("label is not null and model is not null and category is not null").groupBy("model", "label", "category").agg(F.count("*").alias("population"))
    return judging.label_plan(cells, "model", "label", "category", 60)


def q_verify(s, d):
    return sampling.verify_sample(c.results(s, d).where("label is not null").select("id", "category", "label").distinct(), "category", F.col("label") == 2, "id", 20, 4)


def q_partition(s, d):
    m = c.prompts(s, d).select("category", F.col("source").alias("coarse")).where("category is not null and coarse is not null").distinct()
    return judging.is_partition(m, "category", "coarse")


def q_subsets(s, d):
    a = c.conditions(s, d)
    parts = {"t5": a.where("cond < 1 and id % 2 = 0"), "t10": a.where("cond < 2"), "all": a}
    return judging.subset_violations(parts, "id")


def _validated(s, d):
    """Latest human labels beside the judge's, with the weight of their (model, label) cell."""
    a = c.answers(s, d).where("label is not null").groupBy("item_id").agg(F.min("label").alias("judge"), F.min("model").alias("model"), F.min("category").alias("category"), F.min("question").alias("question"))
    cells = a.groupBy("model", "judge").agg(F.count("*").alias("population"))
    h = c.humans(s, d).groupBy("item_id").agg(F.min_by("human", F.coalesce("annotator", F.lit(""))).alias("human"))
    j = a.join(h, "item_id").withColumn("sampled", F.count("*").over(Window.partitionBy("model", "judge")))
    return j.join(F.broadcast(cells), ["model", "judge"]).withColumn("weight", F.col("population") / F.col("sampled")).withColumn("open", F.coalesce(text.has_placeholder(F.col("question")), F.lit(False)))


_VALIDATED = c.ANSWERS + ", " + c.HUMANS + """, av AS (SELECT item_id, min(label) AS judge, min(model) AS model, min(category) AS category, min(question) AS question FROM answers WHERE label IS NOT NULL GROUP BY item_id),
 hv AS (SELECT item_id, arg_min(human, coalesce(annotator, '')) AS human FROM humans GROUP BY item_id),
 cells AS (SELECT model, judge, count(*) AS population FROM av GROUP BY model, judge),
 jv AS (SELECT av.*, hv.human, count(*) OVER (PARTITION BY model, judge) AS sampled FROM av JOIN hv ON av.item_id = hv.item_id),
 v AS (SELECT jv.*, population / sampled AS weight, coalesce(regexp_matches(question, '\\[[a-z_0-9]+\\]'), false) AS "open" FROM jv JOIN cells ON jv.model IS NOT DISTINCT FROM cells.model AND jv.judge = cells.judge WHERE jv.model IS NOT NULL)"""
_BUNDLE = ["agree_plain", "kappa_plain", "binary_agree_plain", "binary_kappa_plain", "agree_weighted", "kappa_weighted", "binary_agree_weighted", "binary_kappa_weighted"]


def _bundle_sql(key: str) -> str:
    def part(m: str, tag: str) -> str:
        p = lambda c_, k: f"(sum({m}) FILTER ({c_} = {k}))"
        z = lambda c_, k: f"coalesce({p(c_, k)}, 0) / sum({m})"
        a4 = f"coalesce(sum({m}) FILTER (human = judge), 0) / sum({m})"
        a2 = f"coalesce(sum({m}) FILTER ((human = 2) = (judge = 2)), 0) / sum({m})"
        e4 = " + ".join(f"({z('human', k)}) * ({z('judge', k)})" for k in range(4))
        e2 = f"({z('human', 2)}) * ({z('judge', 2)}) + (1 - {z('human', 2)}) * (1 - {z('judge', 2)})"
        kap = lambda a, e: f"CASE WHEN {e} < 1 THEN ({a} - ({e})) / (1 - ({e})) END"
        return f"{a4} AS agree_{tag}, {kap(a4, e4)} AS kappa_{tag}, {a2} AS binary_agree_{tag}, {kap(a2, e2)} AS binary_kappa_{tag}"

    return f"SELECT {key}, count(*) AS n, {part('one', 'plain')}, {part('weight', 'weighted')} FROM (SELECT *, 1.0 AS one FROM v) t GROUP BY ALL"


def q_bundle_model(s, d):
    return judging.agreement_bundle(_validated(s, d), "human", "judge", "weight", "model")


def q_bundle_category(s, d):
    return judging.agreement_bundle(_validated(s, d), "human", "judge", "weight", "category", "open")


def q_bundle_gap(s, d):
    """The verdict on the largest gap between models: over five points the judge can't rank them."""
    b = q_bundle_model(s, d)
    one = lambda k: b.agg(F.max(k).alias("h"), F.min(k).alias("l")).select(F.lit(k).alias("measure"), (F.col("h") - F.col("l")).alias("gap"), (F.col("h") - F.col("l") > 0.05).alias("wide"))
    return one("agree_weighted").unionByName(one("binary_agree_weighted"))


def _two(s, d):
    """First and last label of items that an annotator labelled more than once."""
    h = table(s, d, "human_labels").where("human_label between 0 and 3 and annotator is not null").select(F.concat_ws("|", "annotator", "item_id").alias("k"), "human_label", "labelled_at", "annotator").distinct()
    g = h.groupBy("k", "annotator").agg(F.min_by("human_label", F.struct("labelled_at", "human_label")).alias("a"), F.max_by("human_label", F.struct("labelled_at", "human_label")).alias("b"), F.count_distinct("labelled_at").alias("n")).where("n > 1")
    return g.select("k", "annotator", F.col("a").alias("label")), g.select("k", F.col("b").alias("label"))


def q_retest(s, d):
    return judging.retest(*_two(s, d), "k", "label", "annotator")


def q_determinism(s, d):
    x = c.results(s, d).where("label is not null and question is not null").withColumn("prior", F.lit(0))
    return judging.determinism(x, ["question", "model"], "label", "prior")


def q_sensitivity(s, d):
    """The estimate on each subset of prompts; fewer than 40 prompts are left out."""
    p = c.pair(rates.per_pair(c.samples(s, d)))
    out = None
    for name, cond in (("all", F.lit(True)), ("no_stratum_0", F.col("stratum") != 0), ("many_samples", F.least("ka", "kb") >= 10), ("few", F.col("uid") < 10)):
        t = stats.tau_blocked(p.where(cond), "x", "y", "stratum").select(F.lit(name).alias("variant"), "n", F.when(F.col("n") >= 40, F.col("tau")).alias("tau"))
        out = t if out is None else out.unionByName(t)
    return out


def q_confounds(s, d):
    """Association with length, and agreement of refusals, beside the residualised one."""
    per = rates.per_pair(c.samples(s, d))
    p = c.pair(per)
    ref = per.where("model = 'view'").select("uid", F.col("refusal_rate").alias("ra")).join(per.where("model = 'click'").select("uid", F.col("refusal_rate").alias("rb")), "uid")
    p = p.join(ref, "uid")
    r = stats.residualise(p, "x", "z", "stratum").withColumnRenamed("residual", "rx")
    r = stats.residualise(r, "y", "z", "stratum").withColumnRenamed("residual", "ry")
    one = lambda n, a, b: stats.tau_blocked(r, a, b, "stratum").select(F.lit(n).alias("check"), "tau")
    return one("x_length", "x", "z").unionByName(one("y_length", "y", "z")).unionByName(one("refusals", "ra", "rb")).unionByName(one("residual", "rx", "ry"))


def q_null_band(s, d):
    """Distribution of the residualised agreement under covariates that tell nothing."""
    return stats.residual_null_band(c.pair(rates.per_pair(c.samples(s, d))), "uid", "x", "y", "stratum", 40)


def _texts(s, d):
    p = c.prompts(s, d).where("question is not null").select("id", "question")
    return p.withColumn("old", F.concat(F.lit("old-"), F.col("id"))).select(F.col("old").alias("id"), F.concat(F.lit(" "), F.col("question")).alias("question")), p.where("cast(substring(id, -3) as int) % 4 <> 0")


def q_rekey(s, d):
    a, b = judging.rekey(*_texts(s, d), "question", "id")
    return a.agg(F.count_distinct("id").alias("n")).select(F.lit("matched").alias("part"), "n").unionByName(b.agg(F.count_distinct("id").alias("n")).select(F.lit("unmatched").alias("part"), "n"))


def q_top_up(s, d):
    p = c.prompts(s, d)
    return judging.top_up(p.where("split = 'test'"), p, p.where("split = 'validation'"), "id").groupBy("origin").agg(F.count("*").alias("n"))


_PATTERNS = (r"(?:of|at|on|from) ((?:[A-Z]\w+ ?){2,3})", r"which \w+ \w+ ((?:[A-Z]\w+ ?){2,3})")


def q_extraction(s, d):
    return c.prompts(s, d).groupBy("id").agg(F.min(F.trim(judging.first_match(F.col("question"), *_PATTERNS))).alias("entity"))


def q_round_robin_prompts(s, d):
    p = c.prompts(s, d)
    kind = F.lower(F.element_at(F.split(F.trim("entity"), r" +"), -1))
    e = p.where("trim(entity) <> ''").select(kind.alias("kind"), F.trim("entity").alias("entity"))
    t = e.select("kind").distinct().crossJoin(s.createDataFrame([("Who built {entity}?",), ("When was {entity} built?",), ("Where is {entity}?",)], "template string"))
    return corpus.round_robin_prompts(e, t, 150)


def q_bridge_history(s, d):
    """Fixed and regressed prompts per category under one condition beside those under the one before."""
    p = _pairs(s, d)
    t = lambda k, n: p.where(F.col("cond") == k).groupBy("category").agg(rates.share((F.col("before") == 2) & (F.col("after") != 2)).alias(f"fixed_{n}"), rates.share((F.col("before") != 2) & (F.col("after") == 2)).alias(f"regressed_{n}"))
    return t(1, "old").join(t(2, "new"), "category", "full_outer").withColumn("fixed_change", F.col("fixed_new") - F.col("fixed_old"))


def q_ground_truth(s, d):
    return c.prompts(s, d).groupBy("category", text.ground_truth_rule(F.lit("factual"), F.col("question"), F.lit(None).cast("map<string,string>")).alias("rule")).agg(F.count("*").alias("n"))


def _feature_rows(s, d):
    return c.results(s, d).where("is_hallucinated is not null").unpivot(["id", "category", "model", "is_hallucinated"], ["density_change", "centrality_change"], "feature", "value").withColumn("g", F.col("is_hallucinated").cast("long"))


def q_within_mw(s, d):
    return ranks.mann_whitney(_feature_rows(s, d), "value", "g", "category", "feature").where("n1 >= 5 and n2 >= 5").drop("z")


def _bridge(s, d):
    o = pairing.outcome_any(_pairs(s, d), "id")
    x = c.conditions(s, d).where("cond = 0").select("id", "category", "confidence")
    return o.join(x, "id")


def q_bridge(s, d):
    """Fixed against still broken, and broken by a change against always correct, per category."""
    b = _bridge(s, d)
    out = None
    for name, one, other in (("fixed_vs_still_broken", "fixed", "still_broken"), ("regressed_vs_correct", "regressed", "already_correct")):
        x = b.where(F.col("outcome").isin(one, other)).withColumn("g", (F.col("outcome") == one).cast("long")).withColumn("comparison", F.lit(name))
        m = ranks.mann_whitney(x, "confidence", "g", "comparison", "category").where("n1 >= 3 and n2 >= 3").drop("z")
        out = m if out is None else out.unionByName(m)
    return out


def q_accuracy_block(s, d):
    """Accuracy and hallucination before and after, their discordance, refusals and intervals."""
    p = _pairs(s, d).where("cond = 1")
    g = p.agg(
        F.count("*").alias("n"), F.count_if((F.col("before") == 0) & (F.col("after") != 0)).alias("acc_lost"), F.count_if((F.col("before") != 0) & (F.col("after") == 0)).alias("acc_won"),
        F.count_if((F.col("before") == 2) & (F.col("after") != 2)).alias("hall_gone"), F.count_if((F.col("before") != 2) & (F.col("after") == 2)).alias("hall_new"),
        (rates.share(F.col("after") == 3) - rates.share(F.col("before") == 3)).alias("refusal_diff"), F.count_if(F.col("after") == 0).alias("_k"),
    )
    lo, hi = stats.wilson(F.col("_k"), F.col("n"))
    return g.withColumn("low", lo).withColumn("high", hi).drop("_k")


def q_examples(s, d):
    p = _pairs(s, d).where("cond = 1").withColumn("transition", F.concat_ws(">", "before", "after"))
    return judging.first_per(p, "transition", "id", 3).select("transition", "nth", "id")


def q_power(s, d):
    p = c.answers(s, d).where("label is not null").withColumn("clean", F.when(F.startswith("uid", F.lit("v3:")), "clean").otherwise("contaminated"))
    g = p.groupBy("clean", "category").agg(F.count("*").alias("n"), (100 * rates.share(F.col("label") == 0)).alias("accuracy"))
    return g.withColumn("power", judging.rows_by_power(F.col("n")))


def q_entities(s, d):
    r = table(s, d, "borderline_edge_factual").groupBy("id").agg(F.min(F.array_join(judging.substituted_entities(F.col("metadata.substitutions")), "|")).alias("entities"))
    return r


def q_template_groups(s, d):
    r = table(s, d, "borderline_edge_factual").select("id", F.lower("category").alias("category"), F.col("metadata.entity_subtype").alias("sub"), F.col("metadata.template").alias("t")).distinct()
    key = F.when(F.startswith("category", F.lit("borderline")) & F.col("sub").isNotNull(), F.concat_ws("__", "category", "sub")).otherwise(F.col("category"))
    return r.groupBy(F.when(F.col("t").isNull(), "(none)").otherwise(key).alias("grp")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("templates"))


def q_write_condition(s, d):
    """Chat records of a condition: written, skipped and their token estimate, by split."""
    p = c.prompts(s, d).withColumn("chat", text.chat_messages(F.coalesce("question", F.lit("")), F.coalesce("ground_truth", F.lit(""))))
    return p.groupBy("split").agg(F.count("chat").alias("written"), F.count_if(F.col("chat").isNull()).alias("skipped"), F.sum(F.when(F.col("chat").isNotNull(), text.token_estimate(F.concat("question", "ground_truth")))).alias("tokens"))


_CONDITIONS = {"only_view": {"view"}, "no_view": {"click", "purchase", "signup", "error"}, "both": {"view", "click"}, "rest": {"purchase", "signup", "error"}}


def q_condition_sets(s, d):
    sets = s.createDataFrame([(k, v) for k, vs in _CONDITIONS.items() for v in sorted(vs)], "condition string, model string")
    return base(s, d).join(F.broadcast(sets), "model").groupBy("condition").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("uids"))


def q_source_dedup(s, d):
    p = table(s, d, "borderline_edge_factual").select("id", F.coalesce("metadata.source", F.lit("none")).alias("file"), "question").distinct()
    return pairing.first_wins(p.withColumn("o", F.concat_ws("/", "file", F.coalesce("question", F.lit("")))), "id", "o", "file").groupBy("file").agg(F.count("*").alias("n"))


def q_rubrics(s, d):
    v = c.panels(s, d).select(F.explode("votes").alias("v"))
    return v.groupBy(F.coalesce("v.rubric_version", F.lit("legacy")).alias("rubric")).agg(F.count("*").alias("n"), rates.share(F.coalesce("v.mixed_rejection_then_fabrication", F.lit(False))).alias("mixed"))


def q_recent(s, d):
    h = table(s, d, "human_labels").where("annotator is not null").groupBy("item_id", "annotator").agg(F.min("labelled_at").alias("at"), F.min("human_label").alias("label")).withColumn("o", F.struct("at", "item_id"))
    return judging.around(h, "o", "annotator", F.col("label") == 3, 2).groupBy("annotator").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


def _labels(s, d):
    return c.humans(s, d).groupBy("item_id").agg(F.min_by("human", F.coalesce("annotator", F.lit(""))).alias("label"))


def _events(s, d):
    h = table(s, d, "human_labels")
    fix = h.where("corrected_from is not null and human_label between 0 and 3").select("item_id", F.lit("fix").alias("kind"), F.col("human_label").alias("value"), F.struct("labelled_at", "human_label").alias("o"))
    return fix.unionByName(h.where("gt_doubt").select("item_id", F.lit("doubt").alias("kind"), F.lit(None).cast("int").alias("value"), F.struct("labelled_at", "human_label").alias("o")))


def q_corrected(s, d):
    return judging.corrected(_labels(s, d), _events(s, d), "item_id", "o").groupBy("label", "corrected_from", "gt_doubt").agg(F.count("*").alias("n"))


def q_promoted(s, d):
    a = _labels(s, d)
    r = a.where(F.col("item_id").rlike("[0-4]$"))
    return judging.promoted(a, r.withColumn("label", (F.col("label") + 1) % 4), r.where(F.col("item_id").rlike("[0-1]$")).withColumn("label", (F.col("label") + 2) % 4), "item_id").groupBy("label", "redone_from", "redone_via").agg(F.count("*").alias("n"))


def q_probe(s, d):
    per = rates.per_pair(c.samples(s, d))
    return per.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("p_hat").alias("mean"), rates.share(F.col("p_hat") == 0).alias("zero"), F.stddev_samp("p_hat").alias("sd"))


def q_figure(s, d):
    m = _measures(s, d).join(_geo(s, d).select("id", "density"), "id")
    return m.groupBy("category", F.floor(F.col("density") * 10).cast("int").alias("band")).agg(F.count("*").alias("n"), rates.share(F.col("label") == 2).alias("rate"))


def q_embedding_robustness(s, d):
    """Rank correlation of mean neighbour distance and label, per embedding: the whole vectors and their first half."""
    v = c.vectors(s, d)
    out = None
    for name, e in (("full", v), ("half", v.withColumn("v", F.slice("v", 1, 32)))):
        m = geometry.knn(e, e, 5).groupBy("id").agg(F.round(F.avg("dist"), 9).alias("m")).join(v.select("id", "is_hallucinated"), "id")
        r = stats.spearman(m.withColumn("embedding", F.lit(name)), "m", "is_hallucinated", "embedding")
        out = r if out is None else out.unionByName(r)
    return out


def _index(s, d):
    """The stated query set - ids divisible by 20 - all vectors, and the index's centres and probes."""
    v = c.vectors(s, d)
    return v.where("id % 20 = 0"), v, *geometry.fit_index(v)


def q_knn_index(s, d):
    q, v, centres, probes = _index(s, d)
    return geometry.knn_index(q, v, 10, centres, probes)


def q_index_recall(s, d):
    q, v, centres, probes = _index(s, d)
    return geometry.index_recall(q, v, 10, centres, probes)


def q_zscores(s, d):
    v = geometry.z_normalise(_measures(s, d).where("confidence is not null"), "confidence")
    return v.select("id", "z")


def _ml(s, d):
    return c.results(s, d).where("is_hallucinated is not null").select("id", "category", "prefix", F.col("is_hallucinated").cast("double").alias("y"), "original_density", "original_centrality", "density_change", "centrality_change")


_NUM = ["original_density", "original_centrality", "density_change", "centrality_change"]


def q_grid(s, d):
    """Feature sets and models, each fitted on train, chosen by validation, reported on test."""
    x = sampling.split3(_ml(s, d), "y", "id", 9)
    return ml.grid(x, {"category": ([], ["prefix"]), "geometry": (_NUM, []), "combined": (_NUM, ["prefix"])}, ("logistic",), "y")


def q_within_models(s, d):
    return ml.within(_ml(s, d), "category", _NUM, "y", "id")


def _dir(s) -> str:
    from ..session import shared_dir

    return f"{shared_dir(s)}/io"


def q_jsonl(s, d):
    """Answers written as JSON lines and read again, with a broken line that the tolerant reader sets aside."""
    sc = Scratch(s, "jsonl")
    a = c.answers(s, d).select("item_id", "label", "model")
    a.select(F.to_json(F.struct("*")).alias("value")).unionByName(s.createDataFrame([("{broken",), ("  ",)], "value string")).write.text(sc.root)
    good, bad = files.read_jsonl_tolerant(s, sc.root, "item_id string, label int, model string")
    return good.groupBy("model").agg(F.count("*").alias("n"), F.sum("label").alias("labels")).unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("(broken)").alias("model"), "n", F.lit(None).cast("long").alias("labels")))


def q_csv(s, d):
    """Prompts written as CSV in one folder per split and read again with the split from the path; texts keep line ends and quotes."""
    sc = Scratch(s, "csv")
    p = c.prompts(s, d).where("question is not null and split is not null").select("id", "question", "split")
    p.write.partitionBy("split").csv(sc.root, header=True, escape='"', quoteAll=True)
    r = files.read_csv(s, f"{sc.root}/*/*.csv", "id string, question string", multiline=True)
    r = files.with_path_columns(r, r"split=([a-z]+)", ["part"])
    return r.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("question", r"\s", ""))).alias("chars"))


def q_last_wins(s, d):
    b = base(s, d)
    return pairing.last_wins(b, "uid", "pos", "model", "label").groupBy("model", "label").agg(F.count("*").alias("n"))


def q_renumber(s, d):
    return audit.renumber(base(s, d).where("not generation_failed"), ["uid", "model"], "pos").groupBy("model", "new_idx").agg(F.count("*").alias("n"), F.sum("sample_idx").alias("old"))


def q_perturb(s, d):
    a = table(s, d, "adversarial_attacks").where("original_question is not null").select("attack_id", "original_question").distinct()
    m = F.element_at(F.array(*[F.lit(x) for x in ("synonyms", "confusing", "false_premise", "none")]), (F.col("attack_id") % 4 + 1).cast("int"))
    return a.groupBy(m.alias("method")).agg(F.count("*").alias("n"), F.sum(F.length(text.perturb(F.col("original_question"), m, F.lit(0.0)))).alias("chars"))


def q_enrichment(s, d):
    x = c.results(s, d).where("is_hallucinated is not null and original_density is not null")
    return ranks.enrichment(x, F.col("original_density") > 0.5, "is_hallucinated")


_TAU = """pp AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS num, CAST(sum(CAST(a.x <> b.x AS INT)) AS DOUBLE) AS dx, CAST(sum(CAST(a.y <> b.y AS INT)) AS DOUBLE) AS dy, count(*) AS pairs FROM q a JOIN q b ON a.s = b.s AND a.id < b.id)"""
_MEASURES = c.RESULTS + """, m AS (SELECT id, max(label) AS label, min(category) AS category, max(confidence) AS confidence FROM results GROUP BY id),
 g AS (SELECT id, max(original_density) AS density, max(prefix) AS category FROM results GROUP BY id HAVING id % 3 <> 0)"""
_FAM = " UNION ALL ".join(f"SELECT '{k}' AS needle, ['{chr(39).join(v) if len(v) == 1 else (chr(39) + ', ' + chr(39)).join(v)}'] AS fam" for k, v in _STEMS.items())
_MW = """SELECT {by}, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u, 1 - 2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS effect, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS auc
 FROM (SELECT {by}, sum(g) AS n1, count(*) - sum(g) AS n2, CAST(sum(r) FILTER (g = 1) AS DOUBLE) AS r1 FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0 AS r FROM x WHERE value IS NOT NULL) r GROUP BY {by}) t WHERE n1 >= {k} AND n2 >= {k}"""


def _variant(name: str, cond: str) -> str:
    q = f"(SELECT uid AS id, stratum AS s, x, y FROM pair WHERE {cond})"
    return f"""SELECT '{name}' AS variant, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {q} z GROUP BY s HAVING count(*) >= 2) y) AS n,
  sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(CAST(a.x <> b.x AS INT)) AS DOUBLE) * sum(CAST(a.y <> b.y AS INT))) AS tau FROM {q} a JOIN {q} b ON a.s = b.s AND a.id < b.id"""


def _check(name: str, x: str, y: str) -> str:
    return f"""SELECT '{name}' AS "check", sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) / sqrt(CAST(sum(CAST(a.{x} <> b.{x} AS INT)) AS DOUBLE) * sum(CAST(a.{y} <> b.{y} AS INT))) AS tau FROM res a JOIN res b ON a.stratum = b.stratum AND a.uid < b.uid"""


_RES = c.PAIR + """, ref AS (SELECT p.*, v.refusal_rate AS ra, k.refusal_rate AS rb FROM pair p JOIN per v ON p.uid = v.uid AND v.model = 'view' JOIN per k ON p.uid = k.uid AND k.model = 'click'),
 dm AS (SELECT *, x - avg(x) OVER w AS dx_, y - avg(y) OVER w AS dy_, z - avg(z) OVER w AS dz_ FROM ref WINDOW w AS (PARTITION BY stratum)),
 sl AS (SELECT sum(dx_ * dz_) / sum(dz_ * dz_) AS sx, sum(dy_ * dz_) / sum(dz_ * dz_) AS sy FROM dm), res AS (SELECT dm.*, round(dx_ - sx * dz_, 9) AS rx, round(dy_ - sy * dz_, 9) AS ry FROM dm, sl)"""
_SRC = "SELECT DISTINCT id, coalesce(metadata.source, 'none') AS file, question FROM borderline_edge_factual"
_LAB = c.HUMANS + ", lab AS (SELECT item_id, arg_min(human, coalesce(annotator, '')) AS label FROM humans GROUP BY item_id)"

ENTRIES = {
    "judged_log_load": (q_load, ([], f"WITH {GOOD} SELECT lab.model, lab.label, count(*) AS n, CAST(sum(b.output_tokens) AS BIGINT) AS tokens, count(*) FILTER (b.truncated) AS truncated FROM lab JOIN base b ON lab.uid = b.uid AND lab.model = b.model AND lab.sample_idx = b.sample_idx GROUP BY 1, 2")),
    "judged_log_counters": (q_load_counts, ([], f"""WITH {GOOD} SELECT (SELECT count(*) FROM log) AS rows, (SELECT count(*) FROM log WHERE uid % 29 = 0) AS unknown, (SELECT count(*) FROM log WHERE uid % 29 <> 0 AND (judge_failed OR label IS NULL)) AS failed,
 (SELECT count(*) FROM good) - (SELECT count(*) FROM used) AS orphans, (SELECT count(*) FROM lab) AS labelled, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM lab) AS duplicates,
 (SELECT count(*) FROM base b WHERE generation_failed AND starts_with(error, 'empty completion') AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.uid = b.uid AND l.model = b.model AND l.sample_idx = b.sample_idx)) AS empty_completions""")),
    "best_completion": (q_best_completion, ([], f"WITH {BASE}, t AS (SELECT *, CASE WHEN generation_failed THEN '' ELSE 't' || output_tokens END AS text, CAST(floor(sample_idx / 3.0) AS INT) AS slot FROM base), r AS (SELECT model, arg_min(text, {{'e': text = '', 'o': pos}}) AS text, arg_min(pos, {{'e': text = '', 'o': pos}}) AS pos FROM t GROUP BY uid, model, slot) SELECT model, count(*) AS n, count(*) FILTER (text = '') AS empty, CAST(sum(pos) AS BIGINT) AS pos FROM r GROUP BY model")),
    "generation_state": (q_generation_state, ([], f"WITH {BASE}, f AS (SELECT u.uid, m.model FROM (SELECT DISTINCT uid FROM base) u, (SELECT DISTINCT model FROM base) m), k AS (SELECT f.uid, f.model, count(b.uid) AS k FROM f LEFT JOIN base b ON f.uid = b.uid AND f.model = b.model AND NOT b.generation_failed GROUP BY 1, 2) SELECT count(*) AS pairs, count(*) FILTER (k < 20) AS short, count(*) FILTER (k = 0) AS zero, count(*) FILTER (k < 16) AS below_least, count(DISTINCT uid) FILTER (k = 0) AS lost_prompts FROM k")),
    "truncation_gap": (lambda s, d: judging.truncation_gap(base(s, d), "model"), (["low", "high", "gap"], f"WITH {BASE}, r AS (SELECT model, avg(CAST(truncated AS DOUBLE)) AS r FROM base WHERE NOT generation_failed GROUP BY model) SELECT min(r) AS low, max(r) AS high, max(r) - min(r) AS gap, max(r) - min(r) > 0.05 AS wide FROM r")),
    "judging_state": (q_judging_state, (["rate"], f"""WITH {LOG}, can AS (SELECT DISTINCT uid, model, sample_idx FROM base WHERE NOT generation_failed), ok AS (SELECT DISTINCT uid, model, sample_idx FROM log WHERE NOT judge_failed AND label IS NOT NULL),
 j AS (SELECT can.*, ok.uid AS o FROM can LEFT JOIN ok ON can.uid = ok.uid AND can.model = ok.model AND can.sample_idx = ok.sample_idx), p AS (SELECT uid, model, count(o) AS k FROM j GROUP BY 1, 2)
 SELECT (SELECT count(*) FROM j) AS judgeable, (SELECT count(*) FROM j WHERE o IS NULL) AS unrecovered, (SELECT count(*) FROM j WHERE o IS NULL) / (SELECT count(*) FROM j) AS rate, (SELECT count(*) FROM j WHERE o IS NULL) / (SELECT count(*) FROM j) > 0.02 AS abort,
 (SELECT count(*) FROM log WHERE judge_failed OR label IS NULL) AS failed_rows, (SELECT count(*) FROM log) AS rows, (SELECT count(*) FROM p WHERE k < 16) AS pairs_below_16""")),
    "failure_causes": (q_failure_causes, ([], f"WITH {BASE} SELECT model, CASE WHEN contains(error, 'empty completion (finish_reason=') THEN 'behavioural' ELSE 'infrastructure' END AS cause, count(*) AS n FROM base WHERE generation_failed GROUP BY 1, 2")),
    "family_independence": (q_independence, ([], f"""WITH {c.ANSWERS}, fam AS ({_FAM}), js AS (SELECT DISTINCT unnest(string_split(judge_model, '+')) AS judge FROM judged_answers), ms AS (SELECT DISTINCT model FROM answers WHERE model IS NOT NULL),
 a AS (SELECT judge, list_sort(list_distinct(flatten(list(fam)))) AS fa FROM (SELECT js.judge, fam.fam FROM js LEFT JOIN fam ON contains(lower(js.judge), fam.needle) WHERE judge <> '') t GROUP BY judge), b AS (SELECT model, list_sort(list_distinct(flatten(list(fam)))) AS fb FROM (SELECT ms.model, fam.fam FROM ms LEFT JOIN fam ON contains(lower(ms.model), fam.needle)) t GROUP BY model)
 SELECT judge, model, coalesce(array_to_string(list_sort(list_intersect(coalesce(fa, []), coalesce(fb, []))), '+'), '') AS shared, CASE WHEN len(coalesce(fa, [])) = 0 OR len(coalesce(fb, [])) = 0 THEN 'unknown family' WHEN len(list_intersect(coalesce(fa, []), coalesce(fb, []))) > 0 THEN 'shared family' ELSE 'independent' END AS verdict FROM a, b""")),
    "low_confidence": (q_low_confidence, (["confidence"], f"WITH {c.ANSWERS} SELECT item_id, label, confidence FROM answers WHERE confidence < 0.5")),
    "keyword_removal": (q_keywords, ([], f"WITH {c.PROMPTS}, {c.ANSWERS}, bad AS (SELECT id FROM prompts WHERE " + " OR ".join(f"contains(lower(coalesce({k}, '')), '{w}')" for k in ("question", "entity") for w in _WORDS) + "), ok AS (SELECT * FROM prompts WHERE NOT (" + " OR ".join(f"contains(lower(coalesce({k}, '')), '{w}')" for k in ("question", "entity") for w in _WORDS) + ")) SELECT 'prompts' AS part, count(DISTINCT id) AS n FROM ok UNION ALL SELECT 'answers', count(DISTINCT item_id) FROM answers WHERE uid IS NULL OR regexp_replace(uid, '^v3:', '') NOT IN (SELECT id FROM bad)")),
    "prefix_predicates": (q_prefixes, ([], f"WITH {c.ANSWERS} SELECT starts_with(uid, 'v3:') AS kept, coalesce(contains(question, '['), false) AS \"open\", count(*) AS n FROM answers GROUP BY 1, 2")),
    "risk_flags": (q_risk, ([], f"""WITH {c.PROMPTS}, e AS (SELECT DISTINCT entity, CASE WHEN regexp_matches(entity, '(?i)lake|mount|port|fort') THEN 'places' WHEN regexp_matches(entity, '(?i)manuscript|codex') THEN 'books' ELSE 'other' END AS subset FROM prompts WHERE trim(entity) <> ''),
 w AS (SELECT *, len(list_filter(regexp_split_to_array(replace(entity, 'The ', ''), '\\s+'), lambda x: x <> '')) AS n FROM e) SELECT subset, CASE WHEN subset = 'places' AND n <= 2 THEN 'short place name' WHEN subset = 'books' AND n <= 4 THEN 'short title' ELSE '' END AS flags, count(*) AS n FROM w GROUP BY 1, 2""")),
    "left_join_suffix": (q_left_suffix, (["density"], f"WITH {_MEASURES} SELECT m.category, g.category AS category_geo, count(*) AS n, avg(density) AS density FROM m LEFT JOIN g ON m.id = g.id GROUP BY 1, 2")),
    "left_join_fan_out": (q_fan_out, ([], f"WITH {_MEASURES} SELECT 'deduplicated' AS \"join\", count(*) AS n FROM m UNION ALL SELECT 'fan_out', count(*) FROM m LEFT JOIN (SELECT * FROM g UNION ALL SELECT * FROM g WHERE id % 5 = 0) t ON m.id = t.id")),
    "inner_join_coalescing": (q_coalescing, (["density"], f"WITH {_MEASURES} SELECT coalesce(g.category, m.category) AS category, count(*) AS n, avg(density) AS density FROM m JOIN g ON CAST(m.id AS VARCHAR) = CAST(g.id AS VARCHAR) GROUP BY 1")),
    "asserted_size": (q_asserted, ([], f"WITH {_MEASURES} SELECT count(*) AS n, count(*) AS expected FROM m WHERE id % 3 <> 0")),
    "feature_join": (q_feature_join, (["mean_tokens"], f"WITH {c.ANSWERS}, {c.PROMPTS}, f AS (SELECT id, max(len(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '\\s+'), lambda x: x <> ''))) AS n FROM prompts GROUP BY id) SELECT a.category, count(*) AS n, count(f.n) AS with_features, avg(f.n) AS mean_tokens FROM answers a LEFT JOIN f ON regexp_replace(a.uid, '^v3:', '') = f.id GROUP BY 1")),
    "columns_present": (q_columns, ([], f"WITH {_MEASURES} SELECT id, label FROM m")),
    "mixed_flags": (q_mixed, ([], f"WITH {c.PANELS}, v AS (SELECT model, unnest(votes) AS v FROM panels) SELECT model, count(*) AS n, count(*) FILTER (v.label = 2) AS n_failing, count(*) FILTER (v.label = 2 AND coalesce(v.mixed_rejection_then_fabrication, false)) AS n_mixed FROM v GROUP BY model")),
    "category_ordering": (q_ordering, (["pairs", "tau"], f"WITH {c.PAIR}, q AS (SELECT 1 AS s, stratum AS id, round(avg(x), 12) AS x, round(avg(y), 12) AS y FROM pair GROUP BY stratum), {_TAU} SELECT (SELECT count(*) FROM q) AS n, CAST(pairs AS DOUBLE) AS pairs, CASE WHEN dx * dy > 0 THEN num / sqrt(dx * dy) END AS tau FROM pp")),
    "rank_pct": (q_rank_pct, (["pct"], f"WITH {_MEASURES} SELECT id, category, (rank() OVER (PARTITION BY category ORDER BY confidence) + (count(*) OVER (PARTITION BY category, confidence) - 1) / 2.0) / count(*) OVER (PARTITION BY category) AS pct FROM m WHERE confidence IS NOT NULL")),
    "sample_last_remainder": (q_last_remainder, ([], f"WITH {c.RESULTS}, x AS (SELECT DISTINCT id, model FROM results WHERE model IS NOT NULL), n AS (SELECT model, count(*) AS n, (SELECT count(*) FROM x) AS t, row_number() OVER (ORDER BY model DESC) AS last FROM x GROUP BY model), q AS (SELECT *, CASE WHEN last = 1 THEN 100 - coalesce((SELECT sum(CAST(floor(100.0 * b.n / b.t) AS BIGINT)) FROM n b WHERE b.last > 1), 0) ELSE CAST(floor(100.0 * n / t) AS BIGINT) END AS quota FROM n), r AS (SELECT x.id, x.model, q.quota, row_number() OVER (PARTITION BY x.model ORDER BY substr(md5('5~' || x.id), 1, 8), x.id) AS r FROM x JOIN q ON x.model = q.model) SELECT id, model FROM r WHERE r <= quota")),
    "label_balanced_plan": (q_label_plan, None),
    "verify_sample": (q_verify, ([], f"WITH {c.RESULTS}, x AS (SELECT DISTINCT id, category, label FROM results WHERE label IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY category, label = 2 ORDER BY substr(md5('4~' || id), 1, 8), id) AS r FROM x) SELECT id, category, label = 2 AS failing FROM r WHERE r <= 10")),
    "coarse_partition": (q_partition, ([], f"WITH {c.PROMPTS}, m AS (SELECT DISTINCT category, source AS coarse FROM prompts WHERE category IS NOT NULL AND source IS NOT NULL), g AS (SELECT category, count(DISTINCT coarse) AS d FROM m GROUP BY 1) SELECT count(*) AS n_fine, count(*) FILTER (d > 1) AS split, (SELECT count(DISTINCT coarse) FROM m) AS n_coarse FROM g")),
    "subset_check": (q_subsets, ([], f"WITH {c.CONDITIONS} SELECT 't5' AS small, 't10' AS large, count(*) AS outside FROM (SELECT DISTINCT id FROM conditions WHERE cond < 1 AND id % 2 = 0 EXCEPT SELECT id FROM conditions WHERE cond < 2) a UNION ALL SELECT 't10', 'all', count(*) FROM (SELECT DISTINCT id FROM conditions WHERE cond < 2 EXCEPT SELECT id FROM conditions) b")),
    "validation_by_model": (q_bundle_model, (_BUNDLE, f"WITH {_VALIDATED} {_bundle_sql('model')}")),
    "validation_by_category": (q_bundle_category, (_BUNDLE, f"WITH {_VALIDATED} {_bundle_sql('category, \"open\"')}")),
    "validation_gap": (q_bundle_gap, (["gap"], f"WITH {_VALIDATED}, b AS ({_bundle_sql('model')}) SELECT 'agree_weighted' AS measure, max(agree_weighted) - min(agree_weighted) AS gap, max(agree_weighted) - min(agree_weighted) > 0.05 AS wide FROM b UNION ALL SELECT 'binary_agree_weighted', max(binary_agree_weighted) - min(binary_agree_weighted), max(binary_agree_weighted) - min(binary_agree_weighted) > 0.05 FROM b")),
    "test_retest": (q_retest, (["agree", "agree_boundary"], """WITH h AS (SELECT DISTINCT annotator || '|' || item_id AS k, human_label, labelled_at, annotator FROM human_labels WHERE human_label BETWEEN 0 AND 3 AND annotator IS NOT NULL AND item_id IS NOT NULL),
 g AS (SELECT k, annotator, arg_min(human_label, {'t': labelled_at, 'l': human_label}) AS a, arg_max(human_label, {'t': labelled_at, 'l': human_label}) AS b FROM h GROUP BY k, annotator HAVING count(DISTINCT labelled_at) > 1)
 SELECT coalesce(annotator, 'all') AS stratum, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS agree, avg(CAST((a = 2) = (b = 2) AS DOUBLE)) AS agree_boundary FROM g GROUP BY GROUPING SETS ((), (annotator))""")),
    "judge_determinism": (q_determinism, ([], f"WITH {c.RESULTS}, g AS (SELECT question, model, count(label) AS n, count(DISTINCT label) AS d, bool_or(label <> 0) AS x FROM results WHERE label IS NOT NULL AND question IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (d > 1) AS unstable, count(*) FILTER (x) AS differs_from_prior FROM g")),
    "sensitivity_variants": (q_sensitivity, (["tau"], f"WITH {c.PAIR}, v AS (" + " UNION ALL ".join(_variant(*v) for v in (("all", "true"), ("no_stratum_0", "stratum <> 0"), ("many_samples", "least(ka, kb) >= 10"), ("few", "uid < 10"))) + ") SELECT variant, n, CASE WHEN n >= 40 THEN tau END AS tau FROM v")),
    "confound_checks": (q_confounds, (["tau"], f"WITH {_RES} " + " UNION ALL ".join(_check(*v) for v in (("x_length", "x", "z"), ("y_length", "y", "z"), ("refusals", "ra", "rb"), ("residual", "rx", "ry"))))),
    "residual_null_band": (q_null_band, None),
    "rekey_migration": (q_rekey, ([], f"WITH {c.PROMPTS}, p AS (SELECT id, question FROM prompts WHERE question IS NOT NULL), n AS (SELECT DISTINCT trim(question, ' ') AS t FROM p WHERE CAST(right(id, 3) AS INT) % 4 <> 0) SELECT 'matched' AS part, count(DISTINCT id) AS n FROM p WHERE trim(question, ' ') IN (SELECT t FROM n) UNION ALL SELECT 'unmatched', count(DISTINCT id) FROM p WHERE trim(question, ' ') NOT IN (SELECT t FROM n)")),
    "pool_top_up": (q_top_up, ([], f"WITH {c.PROMPTS} SELECT 'kept' AS origin, count(DISTINCT id) AS n FROM prompts WHERE split = 'test' UNION ALL SELECT 'pool', count(DISTINCT id) FROM prompts WHERE id NOT IN (SELECT id FROM prompts WHERE split IN ('test', 'validation'))")),
    "entity_extraction": (q_extraction, ([], f"WITH {c.PROMPTS} SELECT id, min(trim(coalesce(" + ", ".join(f"CASE WHEN regexp_matches(question, '{x}') THEN regexp_extract(question, '{x}', 1) END" for x in _PATTERNS) + "), ' ')) AS entity FROM prompts GROUP BY id")),
    "round_robin_prompts": (q_round_robin_prompts, ([], f"""WITH {c.PROMPTS}, e AS (SELECT DISTINCT lower(list_last(regexp_split_to_array(trim(entity, ' '), ' +'))) AS kind, trim(entity, ' ') AS entity FROM prompts WHERE trim(entity, ' ') <> ''),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY entity) AS depth FROM e), o AS (SELECT *, row_number() OVER (ORDER BY depth, kind) AS n FROM r), t AS (SELECT unnest(['When was {{entity}} built?', 'Where is {{entity}}?', 'Who built {{entity}}?']) AS template, unnest([0, 1, 2]) AS i)
 SELECT kind, entity, template, replace(template, '{{entity}}', entity) AS question FROM o JOIN t ON (depth - 1) % 3 = t.i WHERE n <= 150""")),
    "bridge_history": (q_bridge_history, (["fixed_old", "regressed_old", "fixed_new", "regressed_new", "fixed_change"], f"""WITH {_PAIRED}, a AS (SELECT cond, category, avg(CAST(before = 2 AND after <> 2 AS DOUBLE)) AS f, avg(CAST(before <> 2 AND after = 2 AS DOUBLE)) AS r FROM pairs GROUP BY 1, 2)
 SELECT coalesce(o.category, n.category) AS category, o.f AS fixed_old, o.r AS regressed_old, n.f AS fixed_new, n.r AS regressed_new, n.f - o.f AS fixed_change FROM (SELECT * FROM a WHERE cond = 1) o FULL JOIN (SELECT * FROM a WHERE cond = 2) n ON o.category = n.category""")),
    "rule_ground_truth": (q_ground_truth, ([], f"WITH {c.PROMPTS}, q AS (SELECT category, lower(coalesce(question, '')) AS q FROM prompts) SELECT category, CASE WHEN contains(q, 'president') THEN 'office' WHEN contains(q, 'capital') THEN 'capital' WHEN contains(q, 'chemical formula') THEN 'formula' WHEN contains(q, 'who wrote') THEN 'author' ELSE 'verifiable' END AS rule, count(*) AS n FROM q GROUP BY 1, 2")),
    "within_category_mw": (q_within_mw, (["u", "effect", "auc"], f"WITH {c.RESULTS}, x AS (SELECT category, 'density_change' AS feature, density_change AS value, is_hallucinated AS g FROM results WHERE is_hallucinated IS NOT NULL UNION ALL SELECT category, 'centrality_change', centrality_change, is_hallucinated FROM results WHERE is_hallucinated IS NOT NULL) " + _MW.format(by="category, feature", k=5))),
    "bridge_comparisons": (q_bridge, (["u", "effect", "auc"], f"""WITH {_PAIRED}, o AS (SELECT id, min(before) AS before, count(*) FILTER (after <> 2) AS nf, bool_and(after = 0) AS a0, bool_or(after = 2) AS a2 FROM pairs GROUP BY id),
 t AS (SELECT id, CASE WHEN before = 2 AND nf > 0 THEN 'fixed' WHEN before = 2 THEN 'still_broken' WHEN a2 THEN 'regressed' WHEN before = 0 AND a0 THEN 'already_correct' ELSE 'other' END AS outcome FROM o),
 x AS (SELECT CASE WHEN outcome IN ('fixed', 'still_broken') THEN 'fixed_vs_still_broken' ELSE 'regressed_vs_correct' END AS comparison, c.category, c.confidence AS value, CAST(outcome IN ('fixed', 'regressed') AS INT) AS g FROM t JOIN conditions c ON t.id = c.id AND c.cond = 0 WHERE outcome <> 'other') """ + _MW.format(by="comparison, category", k=3))),
    "accuracy_block": (q_accuracy_block, (["refusal_diff", "low", "high"], f"""WITH {_PAIRED}, g AS (SELECT count(*) AS n, count(*) FILTER (before = 0 AND after <> 0) AS acc_lost, count(*) FILTER (before <> 0 AND after = 0) AS acc_won, count(*) FILTER (before = 2 AND after <> 2) AS hall_gone, count(*) FILTER (before <> 2 AND after = 2) AS hall_new,
 avg(CAST(after = 3 AS DOUBLE)) - avg(CAST(before = 3 AS DOUBLE)) AS refusal_diff, count(*) FILTER (after = 0) / count(*) AS p, {stats.Z95} AS z FROM pairs WHERE cond = 1) SELECT n, acc_lost, acc_won, hall_gone, hall_new, refusal_diff, greatest(0.0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)) AS low, least(1.0, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)) AS high FROM g""")),
    "transition_examples": (q_examples, ([], f"WITH {_PAIRED}, r AS (SELECT before || '>' || after AS transition, id, row_number() OVER (PARTITION BY before, after ORDER BY id) AS nth FROM pairs WHERE cond = 1) SELECT transition, nth, id FROM r WHERE nth <= 3")),
    "accuracy_by_power": (q_power, (["accuracy"], f"WITH {c.ANSWERS}, g AS (SELECT CASE WHEN starts_with(uid, 'v3:') THEN 'clean' ELSE 'contaminated' END AS clean, category, count(*) AS n, 100 * avg(CAST(label = 0 AS DOUBLE)) AS accuracy FROM answers WHERE label IS NOT NULL GROUP BY 1, 2) SELECT *, CASE WHEN n >= 30 THEN 'GOOD' WHEN n >= 20 THEN 'OK' WHEN n >= 5 THEN 'POOR' ELSE 'NONE' END AS power FROM g")),
    "substituted_entities": (q_entities, ([], "SELECT id, min(array_to_string(list_sort(list_distinct(list_filter(list_transform(map_values(metadata.substitutions), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '' AND x NOT IN ('[profession]', '[topic]')))), '|')) AS entities FROM borderline_edge_factual GROUP BY id")),
    "template_groups": (q_template_groups, ([], "WITH r AS (SELECT DISTINCT id, lower(category) AS category, metadata.entity_subtype AS sub, metadata.template AS t FROM borderline_edge_factual) SELECT CASE WHEN t IS NULL THEN '(none)' WHEN starts_with(category, 'borderline') AND sub IS NOT NULL THEN category || '__' || sub ELSE category END AS grp, count(*) AS n, count(DISTINCT t) AS templates FROM r GROUP BY 1")),
    "write_condition": (q_write_condition, (["tokens"], f"WITH {c.PROMPTS}, x AS (SELECT *, trim(coalesce(question, ''), ' ') <> '' AND trim(coalesce(ground_truth, ''), ' ') <> '' AS ok FROM prompts) SELECT split, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS skipped, sum(length(question || ground_truth) / 4.0) FILTER (ok) AS tokens FROM x GROUP BY split")),
    "condition_sets": (q_condition_sets, ([], f"WITH {BASE}, cs AS (" + " UNION ALL ".join(f"SELECT '{k}' AS condition, '{v}' AS model" for k, vs in _CONDITIONS.items() for v in sorted(vs)) + ") SELECT condition, count(*) AS n, count(DISTINCT uid) AS uids FROM base JOIN cs ON base.model = cs.model GROUP BY 1")),
    "source_dedup": (q_source_dedup, ([], f"WITH p AS ({_SRC}), r AS (SELECT id, arg_min(file, file || '/' || coalesce(question, '')) AS file FROM p GROUP BY id) SELECT file, count(*) AS n FROM r GROUP BY file")),
    "rubric_counts": (q_rubrics, (["mixed"], f"WITH {c.PANELS}, v AS (SELECT unnest(votes) AS v FROM panels) SELECT coalesce(v.rubric_version, 'legacy') AS rubric, count(*) AS n, avg(CAST(coalesce(v.mixed_rejection_then_fabrication, false) AS DOUBLE)) AS mixed FROM v GROUP BY 1")),
    "recent_window": (q_recent, ([], """WITH h AS (SELECT item_id, annotator, min(labelled_at) AS seen, min(human_label) AS label FROM human_labels WHERE annotator IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY seen, item_id) AS place FROM h),
 s AS (SELECT annotator, place FROM n WHERE label = 3) SELECT n.annotator, count(*) AS n, CAST(sum(n.place) AS BIGINT) AS places FROM n WHERE EXISTS (SELECT 1 FROM s WHERE s.annotator = n.annotator AND abs(s.place - n.place) <= 2) GROUP BY 1""")),
    "corrected_labels": (q_corrected, ([], f"""WITH {_LAB}, f AS (SELECT item_id, arg_max(human_label, {{'t': labelled_at, 'l': human_label}}) AS v FROM human_labels WHERE corrected_from IS NOT NULL AND human_label BETWEEN 0 AND 3 GROUP BY item_id), dt AS (SELECT DISTINCT item_id FROM human_labels WHERE gt_doubt)
 SELECT coalesce(v, label) AS label, CASE WHEN v <> label THEN label END AS corrected_from, dt.item_id IS NOT NULL AS gt_doubt, count(*) AS n FROM lab LEFT JOIN f ON lab.item_id = f.item_id LEFT JOIN dt ON lab.item_id = dt.item_id GROUP BY 1, 2, 3""")),
    "promoted_labels": (q_promoted, ([], f"""WITH {_LAB}, x AS (SELECT label AS a, CASE WHEN regexp_matches(item_id, '[0-4]$') THEN (label + 1) % 4 END AS b, CASE WHEN regexp_matches(item_id, '[0-1]$') THEN (label + 2) % 4 END AS c FROM lab)
 SELECT coalesce(c, b, a) AS label, CASE WHEN coalesce(c, b) IS NOT NULL THEN a END AS redone_from, CASE WHEN c IS NOT NULL THEN 'redo' WHEN b IS NOT NULL THEN 'relabel' END AS redone_via, count(*) AS n FROM x GROUP BY 1, 2, 3""")),
    "probe_summary": (q_probe, (["mean", "zero", "sd"], f"WITH {c.PER_PAIR} SELECT stratum, count(*) AS n, avg(p_hat) AS mean, avg(CAST(p_hat = 0 AS DOUBLE)) AS zero, stddev_samp(p_hat) AS sd FROM per GROUP BY stratum")),
    "figure_density": (q_figure, (["rate"], f"WITH {_MEASURES} SELECT m.category, CAST(floor(density * 10) AS INT) AS band, count(*) AS n, avg(CAST(label = 2 AS DOUBLE)) AS rate FROM m JOIN g ON m.id = g.id GROUP BY 1, 2")),
    "embedding_robustness": (q_embedding_robustness, (["rho"], """WITH e AS (SELECT 'full' AS embedding, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT 'half', vec_id, CAST(embedding AS DOUBLE[])[1:32] FROM embeddings),
 dist AS (SELECT a.embedding, a.id, b.id AS nbr, 1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS dist FROM e a JOIN e b ON a.embedding = b.embedding AND a.id <> b.id),
 nn AS (SELECT *, row_number() OVER (PARTITION BY embedding, id ORDER BY dist, nbr) AS r FROM dist), m AS (SELECT embedding, id, round(avg(dist), 9) AS m FROM nn WHERE r <= 5 GROUP BY 1, 2),
 x AS (SELECT m.embedding, m, CASE WHEN (vec_id * 7 + label) % 5 = 0 THEN 1 ELSE 0 END AS h FROM m JOIN embeddings ON m.id = vec_id), rk AS (SELECT embedding, rank() OVER (PARTITION BY embedding ORDER BY m) + (count(*) OVER (PARTITION BY embedding, m) - 1) / 2.0 AS a, rank() OVER (PARTITION BY embedding ORDER BY h) + (count(*) OVER (PARTITION BY embedding, h) - 1) / 2.0 AS b FROM x)
 SELECT embedding, count(*) AS n, corr(a, b) AS rho FROM rk GROUP BY embedding""")),
    "knn_index": (q_knn_index, None),
    "knn_index_recall": (q_index_recall, None),
    "z_scores": (q_zscores, (["z"], f"WITH {_MEASURES} SELECT id, (confidence - avg(confidence) OVER ()) / nullif(stddev_pop(confidence) OVER (), 0) AS z FROM m WHERE confidence IS NOT NULL")),
    "model_grid": (q_grid, None),
    "within_category_models": (q_within_models, None),
    "jsonl_round_trip": (q_jsonl, ([], f"WITH {c.ANSWERS} SELECT model, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM (SELECT DISTINCT * FROM answers) a GROUP BY model UNION ALL SELECT '(broken)', 1, NULL")),
    "csv_round_trip": (q_csv, ([], f"WITH {c.PROMPTS} SELECT split AS part, count(*) AS n, CAST(sum(length(regexp_replace(question, '\\s', '', 'g'))) AS BIGINT) AS chars FROM prompts WHERE question IS NOT NULL AND split IS NOT NULL GROUP BY 1")),
    "last_wins": (q_last_wins, ([], f"WITH {BASE}, r AS (SELECT uid, arg_max(model, pos) AS model, arg_max(label, pos) AS label FROM base GROUP BY uid) SELECT model, label, count(*) AS n FROM r GROUP BY 1, 2")),
    "renumbered": (q_renumber, ([], f"WITH {BASE}, r AS (SELECT model, sample_idx, row_number() OVER (PARTITION BY uid, model ORDER BY pos) - 1 AS new_idx FROM base WHERE NOT generation_failed) SELECT model, new_idx, count(*) AS n, CAST(sum(sample_idx) AS BIGINT) AS old FROM r GROUP BY 1, 2")),
    "perturbed_lengths": (q_perturb, ([], """WITH a AS (SELECT DISTINCT attack_id, original_question AS q FROM adversarial_attacks WHERE original_question IS NOT NULL), m AS (SELECT q, ['synonyms', 'confusing', 'false_premise', 'none'][CAST(attack_id % 4 AS INT) + 1] AS method FROM a)
 SELECT method, count(*) AS n, CAST(sum(length(q) + CASE method WHEN 'confusing' THEN 1 + length('Bear in mind that sources differ.') WHEN 'false_premise' THEN length('Assume the opposite. ') WHEN 'none' THEN 0 ELSE CASE
  WHEN contains(lower(q), 'how many') THEN length('what number of') - length('how many') WHEN contains(lower(q), 'who') THEN length('which person') - length('who') WHEN contains(lower(q), 'first') THEN length('earliest') - length('first')
  WHEN contains(lower(q), 'when') THEN length('at what time') - length('when') ELSE 0 END END) AS BIGINT) AS chars FROM m GROUP BY method""")),
    "enrichment": (q_enrichment, (["flagged_rate", "other_rate", "enrichment"], f"WITH {c.RESULTS}, x AS (SELECT avg(is_hallucinated) FILTER (original_density > 0.5) AS a, avg(is_hallucinated) FILTER (NOT original_density > 0.5) AS b FROM results WHERE is_hallucinated IS NOT NULL AND original_density IS NOT NULL) SELECT a AS flagged_rate, b AS other_rate, a / nullif(b, 0) AS enrichment FROM x")),
}
