"""Prediction with MLlib: feature assembly, balanced classifiers, folds by hash, comparison tables."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .ranks import classification_metrics, mann_whitney
from .sampling import uniform

METRICS = "feature_set string, model string, fold int, auc double"


def assembled(numeric: list[str], categorical: list[str], n: int = 0) -> list:
    """Stages: alphabetic one-hot of all categories, scaling of the numbers by the population's deviation over ``n`` rows."""
    stages, inputs = [], []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_i", stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_h", dropLast=False)]
        inputs.append(f"_{c}_h")
    if numeric:
        stages += [VectorAssembler(inputCols=numeric, outputCol="_num", handleInvalid="keep"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        stages += [ElementwiseProduct(inputCol="_scaled", outputCol="_scaled_p", scalingVec=Vectors.dense([math.sqrt(n / (n - 1)) if n > 1 else 1.0] * len(numeric)))]
        inputs.append("_scaled_p")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def balanced(df: DataFrame, target: str) -> DataFrame:
    """``w`` = n / (2 n_class): both classes weigh the same and the weights sum to n."""
    c = df.groupBy(target).agg(F.count("*").alias("_c"))
    t = c.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(c.crossJoin(t).select(target, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("w"))), target)


def classifier(kind: str, target: str, n: int, seed: int = 42):
    """L2 logistic with C = 1 (regParam = 1/n on scaled inputs) or a forest of 100 trees of depth 10."""
    if kind == "logistic":
        return LogisticRegression(labelCol=target, weightCol="w", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=100)
    return RandomForestClassifier(labelCol=target, weightCol="w", numTrees=100, maxDepth=10, seed=seed)


def auc(df: DataFrame, score: str, target: str) -> float | None:
    """Rank AUC with ties counted half."""
    r = mann_whitney(df.select(score, F.col(target).cast("long").alias(target)), score, target).first()
    return None if r is None else r.auc


def scored(train: DataFrame, test: DataFrame, kind: str, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """``test`` with the predicted probability of class 1 as ``score``."""
    t = balanced(train.na.fill(0.0, numeric), target)
    n = t.count()
    model = Pipeline(stages=[*assembled(numeric, categorical, n), classifier(kind, target, n)]).fit(t)
    return model.transform(test.na.fill(0.0, numeric)).withColumn("score", vector_to_array("probability")[1])


def cross_validate(df: DataFrame, key: str, target: str, sets: dict[str, tuple[list[str], list[str]]], kinds: tuple[str, ...] = ("logistic",), folds: int = 5, seed: int = 42, group_col: str | None = None) -> DataFrame:
    """Out-of-fold AUC per feature set, model and fold; scaling is fitted within each fold.

    ``group_col`` keeps rows of one group in one fold.
    """
    d = df.withColumn("_f", F.floor(uniform(seed, F.col(group_col or key)) * folds).cast("int"))
    d = Scratch(df.sparkSession, "folds").cut(d)
    rows = []
    for name, (num, cat) in sets.items():
        for kind in kinds:
            for f in range(folds):
                a = auc(scored(d.where(F.col("_f") != f), d.where(F.col("_f") == f), kind, num, cat, target), "score", target)
                rows.append((name, kind, f, a))
    return df.sparkSession.createDataFrame(rows, METRICS)


def cv_summary(cv: DataFrame) -> DataFrame:
    return cv.groupBy("feature_set", "model").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def log_loss(df: DataFrame, target: str) -> float:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.agg(F.sum(-F.when(F.col(target) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("l")).first().l


def likelihood_ratio(df: DataFrame, small: tuple[list[str], list[str]], large: tuple[list[str], list[str]], target: str, extra: int) -> dict[str, float]:
    """2 (NLL small - NLL large) of two regularised fits, and its chi-square tail; with regularisation the tail is approximate."""
    from ..functions.pvalues import chi2_sf

    a, b = (log_loss(scored(df, df, "logistic", *s, target), target) for s in (small, large))
    return {"statistic": 2 * (a - b), "df": extra, "p": chi2_sf(2 * (a - b), extra)}


def logit_inference(df: DataFrame, numeric: list[str], target: str) -> DataFrame:
    """Maximum-likelihood logit: term, coefficient, standard error, z, p and odds ratio, intercept last."""
    a = VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="skip").transform(df)
    m = GeneralizedLinearRegression(family="binomial", labelCol=target, maxIter=50).fit(a)
    s = m.summary
    coef = [*m.coefficients, m.intercept]
    rows = [(t, float(c), float(e), float(z), float(p), math.exp(min(700.0, c))) for t, c, e, z, p in zip([*numeric, "const"], coef, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, odds_ratio double")


def importance(model, names: list[str]) -> list[tuple[str, float]]:
    """|coefficient| or Gini importance, largest first."""
    last = model.stages[-1]
    v = [abs(x) for x in last.coefficients] if hasattr(last, "coefficients") else list(last.featureImportances.toArray())
    return sorted(zip(names, map(float, v)), key=lambda x: -x[1])


def grid(df: DataFrame, sets: dict[str, tuple[list[str], list[str]]], kinds: tuple[str, ...], target: str, part: str = "part") -> DataFrame:
    """``feature_set, model, val_auc, test_auc, accuracy, precision, recall, f1, best``: fitted on train, the first highest validation AUC is best."""
    d = Scratch(df.sparkSession, "grid").cut(df)
    rows, top = [], -1.0
    for name, (num, cat) in sets.items():
        for kind in kinds:
            s = scored(d.where(F.col(part) == "train"), d.where(F.col(part) != "train"), kind, num, cat, target).select(part, target, "score")
            s = Scratch(df.sparkSession, "scored").cut(s)
            val, test = (auc(s.where(F.col(part) == p), "score", target) for p in ("validation", "test"))
            m = classification_metrics(s.where(F.col(part) == "test"), F.col(target) == 1, F.col("score") >= 0.5).first()
            rows.append([name, kind, val, test, *[float(m[k]) for k in ("accuracy", "precision", "recall", "f1")]])
    best = None
    for r in rows:
        if r[2] is not None and r[2] > top:
            top, best = r[2], (r[0], r[1])
    kind = "feature_set string, model string, val_auc double, test_auc double, accuracy double, precision double, recall double, f1 double, best boolean"
    return df.sparkSession.createDataFrame([(*r, (r[0], r[1]) == best) for r in rows], kind)


def within(df: DataFrame, category: str, numeric: list[str], target: str, key: str, least: int = 20, least_class: int = 5, seed: int = 42) -> DataFrame:
    """``category, n, n_positive, rate, auc, accuracy`` of a logistic model per category, on a held-out 30 %.

    Categories with fewer rows, or fewer of either class, are left out; missing
    numbers are filled with the category's mean. One model per category: they are few.
    """
    d = df.join(F.broadcast(df.groupBy(category).agg(*[F.avg(c).alias(f"_m_{c}") for c in numeric])), category)
    d = d.select(key, category, target, *[F.coalesce(c, f"_m_{c}", F.lit(0.0)).alias(c) for c in numeric], (uniform(seed, F.col(key)) < 0.7).alias("_train"))
    d = Scratch(df.sparkSession, "within").cut(d)
    g = d.groupBy(category).agg(F.count("*").alias("n"), F.sum(target).alias("k")).where((F.col("n") >= least) & (F.col("k") >= least_class) & (F.col("n") - F.col("k") >= least_class))
    rows = []
    for r in g.orderBy(category).collect():
        x = d.where(F.col(category) == r[category])
        s = scored(x.where("_train"), x.where("not _train"), "logistic", numeric, [], target)
        acc = s.agg(F.avg(((F.col("score") >= 0.5) == (F.col(target) == 1)).cast("double")).alias("a")).first().a
        rows.append((r[category], int(r.n), int(r.k), float(r.k / r.n), auc(s, "score", target), acc))
    return df.sparkSession.createDataFrame(rows, f"{category} string, n long, n_positive long, rate double, auc double, accuracy double")
