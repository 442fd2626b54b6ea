"""The reference abstractions as frames over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def results(spark: SparkSession, d: str) -> DataFrame:
    """Judged records: id, model, prefix, category, label and measures; a record delivered again is one row."""
    return table(spark, d, "adversarial_attacks").select(
        F.col("attack_id").alias("id"), F.col("generation_model").alias("model"), F.lower("perturbation_method").alias("prefix"), F.coalesce("source", F.lit("none")).alias("category"),
        F.col("judge_label").alias("label"), F.col("judge_confidence").alias("confidence"), "is_hallucinated", "original_density", "perturbed_density", "original_centrality",
        "perturbed_centrality", "density_change", "centrality_change", F.col("original_question").alias("question"),
    ).distinct()


RESULTS = """results AS (SELECT DISTINCT attack_id AS id, generation_model AS model, lower(perturbation_method) AS prefix, coalesce(source, 'none') AS category,
  judge_label AS label, judge_confidence AS confidence, is_hallucinated, original_density, perturbed_density, original_centrality, perturbed_centrality,
  density_change, centrality_change, original_question AS question FROM adversarial_attacks)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Judged answers without their panels."""
    return table(spark, d, "judged_answers").select(
        "item_id", F.col("id").alias("uid"), F.col("generation_model").alias("model"), F.lower("category").alias("category"), "sample_idx", F.col("judge_label").alias("label"),
        F.col("judge_confidence").alias("confidence"), "agreement_rate", "individual_confidence_avg", "question",
    ).distinct()


ANSWERS = """answers AS (SELECT DISTINCT item_id, id AS uid, generation_model AS model, lower(category) AS category, sample_idx, judge_label AS label,
  judge_confidence AS confidence, agreement_rate, individual_confidence_avg, question FROM judged_answers)"""


def panels(spark: SparkSession, d: str) -> DataFrame:
    """item_id, model, label, votes of the answers that have a panel."""
    row = F.struct(F.col("generation_model").alias("model"), F.col("judge_label").alias("label"), F.col("individual_judgments").alias("votes"))
    first = F.min_by(row, F.struct("judged_at", F.to_json(row))).alias("r")
    return table(spark, d, "judged_answers").where("individual_judgments is not null").groupBy("item_id").agg(first).select("item_id", "r.*")


PANELS = """panels AS (SELECT item_id, r.model AS model, r.label AS label, r.votes AS votes FROM (SELECT item_id, arg_min({'model': generation_model, 'label': judge_label, 'votes': individual_judgments},
  {'t': judged_at, 'j': to_json({'model': generation_model, 'label': judge_label, 'votes': individual_judgments})}) AS r FROM judged_answers WHERE individual_judgments IS NOT NULL GROUP BY item_id) p)"""


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """Orders under their conditions: id, cond (0 the baseline), label, confidence, category, model."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("cond", F.row_number().over(w) - 1)
    v = li.select(F.col("l_orderkey").alias("id"), "cond", (F.col("l_quantity").cast("int") % 4).alias("label"), F.round(F.col("l_discount") * 10, 1).cast("double").alias("confidence"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("model"))
    return v.join(o, "id")


CONDITIONS = """conditions AS (SELECT v.*, o.o_orderstatus AS category, o.o_orderpriority AS model FROM (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS cond,
    CAST(l_quantity AS INT) % 4 AS label, CAST(round(l_discount * 10, 1) AS DOUBLE) AS confidence FROM lineitem) v JOIN orders o ON v.id = o.o_orderkey)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Repeated samples of two or more models: uid, model, stratum, sample_idx, label, output_tokens, truncated."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    e = table(spark, d, "events").withColumn("k", k)
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    label = F.when(F.col("k") < 10 + (F.col("user_id") * 7) % 60, 2).when(F.col("k") < 80, 0).when(F.col("k") < 90, 1).otherwise(3)
    return e.select(
        F.col("user_id").alias("uid"), F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("stratum"), (F.row_number().over(w) - 1).alias("sample_idx"),
        label.alias("label"), F.floor(F.col("value") * 10).cast("int").alias("output_tokens"), (F.col("value") > 100).alias("truncated"),
    )


SAMPLES = """samples AS (SELECT user_id AS uid, event_type AS model, user_id % 5 AS stratum, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS sample_idx,
  CASE WHEN k < 10 + (user_id * 7) % 60 THEN 2 WHEN k < 80 THEN 0 WHEN k < 90 THEN 1 ELSE 3 END AS label, CAST(floor(value * 10) AS INT) AS output_tokens, (value > 100) AS truncated
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e)"""

PER_PAIR = (
    SAMPLES
    + """, per AS (SELECT uid, model, min(stratum) AS stratum, count(*) AS k_eff, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
  count(*) FILTER (label = 2) AS n2, count(*) FILTER (label = 3) AS n3, avg(CAST(label = 2 AS DOUBLE)) AS p_hat,
  avg(CAST(label = 2 AS DOUBLE) + 0.5 * CAST(label = 1 AS DOUBLE)) AS p_half, avg(CAST(label = 2 AS DOUBLE) + CAST(label = 1 AS DOUBLE)) AS p_full,
  avg(CAST(label = 3 AS DOUBLE)) AS refusal_rate, avg(CAST(label = 2 AS DOUBLE)) FILTER (sample_idx % 2 = 0) AS p_even, avg(CAST(label = 2 AS DOUBLE)) FILTER (sample_idx % 2 = 1) AS p_odd,
  avg(CAST(truncated AS DOUBLE)) AS truncation_rate, avg(output_tokens) AS mean_tokens, median(output_tokens) AS median_tokens FROM samples GROUP BY uid, model)"""
)

#: Two models side by side per prompt.
PAIR = PER_PAIR + """, pair AS (SELECT a.uid, a.stratum, a.p_hat AS x, b.p_hat AS y, a.k_eff AS ka, b.k_eff AS kb, a.mean_tokens AS z, a.p_even, a.p_odd
  FROM per a JOIN per b ON a.uid = b.uid WHERE a.model = 'view' AND b.model = 'click' AND least(a.k_eff, b.k_eff) >= 8)"""


def pair(per: DataFrame, a: str = "view", b: str = "click", least: int = 8) -> DataFrame:
    """Rates of two models on the prompts with enough samples of both."""
    x = per.where(F.col("model") == a).select("uid", "stratum", F.col("p_hat").alias("x"), F.col("k_eff").alias("ka"), F.col("mean_tokens").alias("z"), "p_even", "p_odd")
    y = per.where(F.col("model") == b).select("uid", F.col("p_hat").alias("y"), F.col("k_eff").alias("kb"))
    return x.join(y, "uid").where(F.least("ka", "kb") >= least)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.col("embedding").alias("v"), F.when((F.col("vec_id") * 7 + F.col("label")) % 5 == 0, 1).otherwise(0).alias("is_hallucinated"))


VECTORS = """vectors AS (SELECT vec_id AS id, label AS category, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN (vec_id * 7 + label) % 5 = 0 THEN 1 ELSE 0 END AS is_hallucinated FROM embeddings)"""
#: All cosine distances, in SQL.
DISTANCES = VECTORS + """, dist AS (SELECT a.id, b.id AS nbr, 1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS dist
  FROM vectors a JOIN vectors b ON a.id <> b.id), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM dist)"""


def humans(spark: SparkSession, d: str) -> DataFrame:
    """Human labels as they hold: the latest per item and annotator."""
    return table(spark, d, "human_labels").groupBy("item_id", "annotator").agg(F.max_by("human_label", F.struct("labelled_at", F.coalesce("human_label", F.lit(-1)))).alias("human")).where("human between 0 and 3")


HUMANS = """humans AS (SELECT * FROM (SELECT item_id, annotator, max_by(human_label, {'t': labelled_at, 'l': coalesce(human_label, -1)}) AS human FROM human_labels
  WHERE annotator IS NOT NULL OR annotator IS NULL GROUP BY item_id, annotator) h WHERE human BETWEEN 0 AND 3)"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts, one row per id."""
    return table(spark, d, "borderline_edge_factual").select("id", F.lower("category").alias("category"), "question", "ground_truth", "entity", F.col("metadata.template").alias("template"), F.col("metadata.source").alias("source"), F.col("metadata.generation_seed").alias("seed"), "split").distinct()


PROMPTS = """prompts AS (SELECT DISTINCT id, lower(category) AS category, question, ground_truth, entity, metadata.template AS template, metadata.source AS source, metadata.generation_seed AS seed, split FROM borderline_edge_factual)"""
