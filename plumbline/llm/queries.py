"""Registered queries of the training-data problems, and SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import consensus, encoding, leakage, overlap, pagespam, pairs, splits, truncation

ASKED = ("perturbed_question", "original_question")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "adversarial_attacks"), asked=ASKED).select("attack_id", "field")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "adversarial_attacks"))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.censoring_limits(table(spark, d, "adversarial_attacks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_pairs(table(spark, d, "borderline_edge_factual"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, "borderline_edge_factual"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(table(spark, d, "borderline_edge_factual"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "adversarial_attacks"))


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(table(spark, d, "adversarial_attacks"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_rates(table(spark, d, "adversarial_attacks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.ordered_pairs(overlap.cross_split_pairs(table(spark, d, "borderline_edge_factual")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "borderline_edge_factual"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "judged_answers"), table(spark, d, "human_labels")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_both(spark, d))[0].where("disputed").select("item_id", "label")


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_both(spark, d))[1]


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = consensus.agreement_report(*_both(spark, d))
    return a.select("item_id", F.round("agreement", 9).alias("agreement"), F.round("agreement_rate", 9).alias("agreement_rate"))


def p5_votes(spark: SparkSession, d: str) -> DataFrame:
    v = consensus.all_votes(*_both(spark, d))
    return v.groupBy("annotator", "label").agg(F.count("*").alias("n"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return encoding.token_totals(encoding.encode_corpus(docs), docs)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id", "field").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.spam_pages(table(spark, d, "documents")).select("doc_id")


def p8_curves(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return pagespam.rank_curves(docs, "doc_id", "text").select("doc_id", "words", "distinct", "top")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_rates, p1_limits, p2_found, p2_splits, p2_report, p3_found, p3_rules, p3_rates, p4_found, p4_report, p5_found, p5_annotators,
            p5_agreement, p5_votes, p6_ids, p6_totals, p7_found, p7_items, p8_found, p8_curves,
        )
    }


_VALID = """NOT (coalesce(v.failed, false) OR (coalesce(v.confidence, 1.0) = 0 AND contains(lower(coalesce(v.justification, '')), 'error')))
      AND v.label BETWEEN 0 AND 3"""

ORACLES = {
    "p5_agreement": f"""
WITH one AS (SELECT item_id, arg_min(individual_judgments, -coalesce(len(individual_judgments), 0)) AS js, min(agreement_rate) AS agreement_rate
             FROM judged_answers WHERE item_id IS NOT NULL GROUP BY item_id),
     votes AS (SELECT item_id, unnest(js) AS v FROM one),
     counts AS (SELECT item_id, v.label AS label, count(*) AS n FROM votes WHERE {_VALID} GROUP BY item_id, v.label),
     own AS (SELECT item_id, max(n) / sum(n) AS agreement FROM counts GROUP BY item_id)
SELECT one.item_id, round(own.agreement, 9) AS agreement, round(one.agreement_rate, 9) AS agreement_rate
FROM one LEFT JOIN own ON one.item_id = own.item_id""",
    "p5_votes": f"""
WITH one AS (SELECT item_id, arg_min({{'m': judge_model, 'js': individual_judgments}}, -coalesce(len(individual_judgments), 0)) AS r
             FROM judged_answers WHERE item_id IS NOT NULL GROUP BY item_id),
     votes AS (SELECT item_id, string_split(r.m, '+') AS judges, unnest(r.js) AS v, generate_subscripts(r.js, 1) AS pos FROM one),
     panel AS (SELECT 'judge:' || coalesce(judges[pos], CAST(pos - 1 AS VARCHAR)) AS annotator, v.label AS label FROM votes WHERE {_VALID}),
     last AS (SELECT item_id, annotator, max_by(human_label, {{'t': labelled_at, 'l': coalesce(human_label, -1)}}) AS label
              FROM human_labels WHERE annotator IS NOT NULL AND item_id IN (SELECT item_id FROM judged_answers) GROUP BY item_id, annotator)
SELECT annotator, CAST(label AS INT) AS label, count(*) AS n FROM (
  SELECT annotator, label FROM panel UNION ALL SELECT 'human:' || annotator, label FROM last WHERE label BETWEEN 0 AND 3) t
GROUP BY annotator, label""",
    "p8_curves": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-gi-vx-z][a-z\x{00df}-\x{052f}]*|<a\b[^>]*>|\]\([^)\s]*\)|https?://[^\s<>"'')\]]+|www\.[^\s<>"'')\]]+|#[\p{L}\p{N}_][\p{L}\p{N}_-]*|\d+(?:[.,:]\d+)*|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]|[\p{L}\p{M}]+')) AS x
           FROM (SELECT doc_id, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id) d),
     k AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^\d+[.,]\d\d$') THEN ' price' WHEN x[1] BETWEEN '0' AND '9' THEN ' ' || x WHEN x[1] = '#' THEN ' tag'
           WHEN x[1] IN ('<', ']') OR starts_with(x, 'www.') OR starts_with(x, 'http://') OR starts_with(x, 'https://') THEN ' link' ELSE x END AS word FROM t),
     c AS (SELECT doc_id, word, count(*) AS n FROM k GROUP BY doc_id, word)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, count(*) AS "distinct", max(n) AS top FROM c GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
