"""Models on MLlib: calibrators, rankers, factorisations. Neural rankers are replaced by these, with the same inputs,
outputs and invariants (README)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions.expressions import clip, logit, sigmoid
from adspark.operators.features import assert_no_leakage, decoded_value
from adspark.operators.metrics import expected_calibration_error, probability_losses, reliability
from adspark.operators.ordering import numbered
from adspark.operators.recall import vector_top_k
from adspark.sources.staging import staged


def _two_classes(df: DataFrame, label: str) -> bool:
    r = df.agg(F.min(label).alias("a"), F.max(label).alias("b")).first()
    return r["a"] is not None and r["a"] != r["b"]


def fit_platt(df: DataFrame, label: str, score: str, epsilon: float = 1e-7) -> tuple[float, float] | None:
    """(intercept, slope) of the logistic curve over the score's logit; None where only one class occurs."""
    if not _two_classes(df, label):
        return None
    rows = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(df.select(F.col(label).cast("double").alias("_y"), logit(score, epsilon).alias("_x")))
    m = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return float(m.intercept), float(m.coefficients[0])


def apply_platt(df: DataFrame, curve: tuple[float, float], score: str, out: str, epsilon: float = 1e-7) -> DataFrame:
    return df.withColumn(out, sigmoid(curve[0] + curve[1] * logit(score, epsilon)))


def fit_isotonic(df: DataFrame, label: str, score: str) -> tuple[list[float], list[float]] | None:
    """Boundaries and values of the isotonic fit, with one weighted row a distinct score."""
    if not _two_classes(df, label):
        return None
    rows = df.groupBy(F.col(score).alias("_x")).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    m = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(rows)
    return list(m.boundaries), list(m.predictions)


def apply_isotonic(df: DataFrame, curve: tuple[list[float], list[float]], score: str, out: str, epsilon: float = 1e-7) -> DataFrame:
    """Linear between boundaries and constant beyond, null for a null score. The curve, which the fit holds on the driver, is
    sent once to each executor; a score finds its boundaries by binary search."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(np.asarray(part, float) for part in curve))

    @F.pandas_udf("double")
    def between(scores: pd.Series) -> pd.Series:
        x, (b, v) = scores.to_numpy(float), shared.value
        at = np.searchsorted(b, x, "right")
        low, high = np.maximum(at - 1, 0), np.minimum(at, len(b) - 1)
        wide = b[high] > b[low]
        share = np.where(wide, (x - b[low]) / np.where(wide, b[high] - b[low], 1.0), 0.0)
        return pd.Series(v[low] + (v[high] - v[low]) * np.clip(share, 0.0, 1.0))

    value = F.col(score).cast("double")
    return df.withColumn(out, F.when(value.isNotNull(), clip(between(value), epsilon, 1 - epsilon)))


def select_calibrator(fit: DataFrame, later: DataFrame, label: str, score: str, bins: int = 10) -> tuple[str, DataFrame]:
    """(name, metrics): raw, Platt and isotonic curves of `fit`, judged on `later` by ECE, log loss, Brier score, name."""
    tried = {"raw": later.withColumn("_p", F.col(score))}
    if (platt := fit_platt(fit, label, score)) is not None:
        tried["platt"] = apply_platt(later, platt, score, "_p")
    if (curve := fit_isotonic(fit, label, score)) is not None:
        tried["isotonic"] = apply_isotonic(later, curve, score, "_p")
    out = None
    for name, rows in tried.items():
        losses, ece = probability_losses(rows, label, "_p"), expected_calibration_error(reliability(rows, label, "_p", bins))
        one = losses.crossJoin(ece).select(F.lit(name).alias("calibrator"), "ece", "log_loss", "brier")  # single rows
        out = one if out is None else out.unionByName(one)
    best = out.orderBy("ece", "log_loss", "brier", "calibrator").first()
    return best["calibrator"], out


def fit_coarse_ranker(rows: DataFrame, features: list[str], label: str = "label", weight: str = "sample_weight", seed: int = 2026) -> PipelineModel:
    """Boosted trees over coarse features with sample weights."""
    assert_no_leakage(features)
    steps = [VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep"), GBTClassifier(featuresCol="_f", labelCol=label, weightCol=weight, maxIter=20, stepSize=0.08, maxDepth=5, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def merged_rows(rows: DataFrame, features: list[str], label: str = "label", weight: str = "sample_weight") -> DataFrame:
    """Rows of equal features and label as one, of their whole weight: trees see sums of weights alone, so they learn the same."""
    merged = rows.groupBy(*features, label).agg(F.sum(weight).alias(weight))
    return merged.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def positive_probability(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    """rows with the probability of class 1."""
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*rows.columns, out)


def fit_hashed_classifier(rows: DataFrame, columns: list[str], label: str, buckets: int = 1 << 14, factors: int = 0) -> PipelineModel:
    """Logistic regression over hashed features, or a factorisation machine with `factors` factors."""
    assert_no_leakage(columns)
    hasher = FeatureHasher(inputCols=columns, outputCol="_f", numFeatures=buckets)
    if factors:
        model = FMClassifier(featuresCol="_f", labelCol=label, factorSize=factors, maxIter=20, stepSize=0.05, seed=2026)
    else:
        model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1e-3, maxIter=30)
    return Pipeline(stages=[hasher, model]).fit(rows)


def fit_click_and_conversion(rows: DataFrame, columns: list[str]) -> tuple[PipelineModel, PipelineModel]:
    """Models of P(click) and P(click and conversion), both over all impressions."""
    typed = rows.withColumns({"_c": F.col("click").cast("double"), "_b": F.col("click_and_conversion").cast("double")})
    return fit_hashed_classifier(typed, columns, "_c"), fit_hashed_classifier(typed, columns, "_b")


def predict_click_and_conversion(models: tuple[PipelineModel, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with raw_pctr, raw_pctcvr and raw_pcvr; pctcvr = pctr * pcvr holds."""
    out = positive_probability(models[1], positive_probability(models[0], rows, "raw_pctr"), "_both")
    both = F.least("_both", "raw_pctr")
    return out.withColumns({"raw_pctcvr": both, "raw_pcvr": clip(both / F.col("raw_pctr"), 0.0, 1.0)}).drop("_both")


def fit_value_ranker(rows: DataFrame, columns: list[str]) -> tuple[PipelineModel, PipelineModel]:
    """Models of conversion and, over rows with a value mask, of the log value."""
    conversion = fit_hashed_classifier(rows.withColumn("_y", F.col("conversion_label").cast("double")), columns, "_y")
    known = rows.where("value_mask = 1")
    hasher = FeatureHasher(inputCols=columns, outputCol="_f", numFeatures=1 << 12)
    return conversion, Pipeline(stages=[hasher, LinearRegression(featuresCol="_f", labelCol="log_conversion_value", regParam=0.1, maxIter=30)]).fit(known)


def predict_value(models: tuple[PipelineModel, PipelineModel], rows: DataFrame, log_max: float) -> DataFrame:
    """rows with pCVR, predicted_conversion_value (at least 0) and expected_value_score."""
    out = positive_probability(models[0], rows, "pCVR")
    out = models[1].transform(out).withColumn("predicted_conversion_value", decoded_value(F.col("prediction"), 0.0, log_max))
    return out.select(*rows.columns, "pCVR", "predicted_conversion_value", (F.col("pCVR") * F.col("predicted_conversion_value")).alias("expected_value_score"))


def numbered_ids(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, users, products): ids of any kind as numbers from 0 in their order, and what they stand for (user_id, u) and
    (product_id, i)."""
    users = staged(numbered(pairs.select("user_id").distinct(), [F.col("user_id")], "u"), "user_numbers")
    products = staged(numbered(pairs.select("product_id").distinct(), [F.col("product_id")], "i"), "product_numbers")
    return pairs.join(users, "user_id").join(products, "product_id").select("u", "i", "weight"), users, products


def fit_factors(rows: DataFrame, rank: int = 16, seed: int = 2026) -> ALSModel:
    """Implicit-feedback factors of numbered users and products (u, i, weight)."""
    typed = rows.select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.col("weight").cast("float").alias("w"))
    return ALS(userCol="u", itemCol="i", ratingCol="w", implicitPrefs=True, rank=rank, maxIter=5, regParam=0.05, seed=seed).fit(typed)


def _factor_lists(pairs: DataFrame, users: DataFrame, k: int, rank: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(lists, products): (query, item, score, rank) of factor_lists, where item is a product's number, and (product_id, i). Numbers
    have the order of ids, so ties fall alike."""
    rows, user_numbers, product_numbers = numbered_ids(pairs)
    model = fit_factors(rows, rank, seed)
    vector = F.transform("features", lambda x: x.cast("double")).alias("v")
    asked = model.userFactors.join(user_numbers, F.col("id") == F.col("u")).select(F.col("user_id").alias("key"), vector)
    asked = asked.join(users.select(F.col("user_id").alias("key")).distinct(), "key", "left_semi")
    seen = pairs.join(users.select("user_id").distinct(), "user_id", "left_semi").join(product_numbers, "product_id").select(F.col("user_id").alias("query"), F.col("i").cast("int").alias("item"))
    return vector_top_k(asked, model.itemFactors.select(F.col("id").alias("key"), vector), k, "key", "v", seen, same=False), product_numbers


def factor_lists(pairs: DataFrame, users: DataFrame, k: int, rank: int = 16, seed: int = 2026) -> DataFrame:
    """(user_id, candidate_ad_id, two_tower_score, rank): the k unseen products of largest inner product of factors."""
    found, products = _factor_lists(pairs, users, k, rank, seed)
    return found.join(products.withColumn("i", F.col("i").cast("int")), F.col("item") == F.col("i")).select(F.col("query").alias("user_id"), F.col("product_id").alias("candidate_ad_id"), F.col("score").alias("two_tower_score"), "rank")


def factor_numbers(pairs: DataFrame, users: DataFrame, k: int, rank: int = 16, seed: int = 2026) -> DataFrame:
    """(user_id, i): the products' numbers of factor_lists, best first, as an array."""
    found = _factor_lists(pairs.where("product_id IS NOT NULL"), users, k, rank, seed)[0]
    best = F.sort_array(F.collect_list(F.struct("rank", "item")))
    return found.groupBy(F.col("query").alias("user_id")).agg(best["item"].alias("i"))
