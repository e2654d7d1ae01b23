"""Audits of splits: overlap, unseen slices, priors and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions.expressions import row_digest, safe_divide


def key_overlap(train: DataFrame, test: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(key, train, test, common, jaccard, test_rows_seen) of distinct keys of two windows."""
    out = None
    for name, columns in keys.items():
        a = train.select(*columns).distinct().withColumn("_a", F.lit(1))
        b = test.groupBy(*columns).agg(F.count(F.lit(1)).alias("_b"))
        both = a.join(b, columns, "full")
        common = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        one = both.agg(
            F.lit(name).alias("key"), F.count("_a").alias("train"), F.count("_b").alias("test"), common.alias("common"),
            safe_divide(common, F.count(F.lit(1))).alias("jaccard"),
            safe_divide(F.sum(F.when(F.col("_a").isNotNull(), F.col("_b"))), F.sum("_b")).alias("test_rows_seen"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def seen_flags(past: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with seen_user, seen_product and seen_pair (0/1)."""
    for name, columns in (("seen_user", ["user_id"]), ("seen_product", ["product_id"]), ("seen_pair", ["user_id", "product_id"])):
        rows = rows.join(past.select(*columns).distinct().withColumn(name, F.lit(1)), columns, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def seen_slices(past: DataFrame, rows: DataFrame, label: str = "conversion_label") -> DataFrame:
    """(seen_user, seen_product, n, positives, rate)."""
    return seen_flags(past, rows).groupBy("seen_user", "seen_product").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("rate"))


def unseen_rows(past: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose key does not occur in past: a strict holdout."""
    return rows.join(past.select(*columns).distinct(), columns, "left_anti")


def smoothed_rates(past: DataFrame, key: str, label: str = "conversion_label", alpha: float = 20.0) -> DataFrame:
    """(key, n, positives, rate): conversion rates drawn to the overall rate by alpha rows of it."""
    overall = past.agg(F.avg(label).alias("_g"))
    counts = past.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"))
    return counts.crossJoin(F.broadcast(overall)).select(key, "n", "positives", ((F.col("positives") + alpha * F.col("_g")) / (F.col("n") + alpha)).alias("rate"))


def prior_predictions(past: DataFrame, rows: DataFrame, alpha: float = 20.0) -> DataFrame:
    """rows with p_global, p_product, p_brand and p_brand_category, each from past only, falling back to the coarser one."""
    overall = F.broadcast(past.agg(F.avg("conversion_label").alias("p_global")))
    out = rows.crossJoin(overall)
    for name, key in (("p_product", "product_id"), ("p_brand", "product_brand"), ("p_category", "product_category_1")):
        out = out.join(smoothed_rates(past, key, alpha=alpha).select(key, F.col("rate").alias(name)), key, "left").withColumn(name, F.coalesce(name, "p_global"))
    return out.withColumn("p_brand_category", (F.col("p_brand") + F.col("p_category")) / 2).drop("p_category")


def user_aggregates(past: DataFrame, alpha: float = 20.0) -> DataFrame:
    """Each user's activity before the split: counts, smoothed conversion rate, mean price, log counts and recency."""
    overall = past.agg(F.avg("conversion_label").alias("_g"), F.max("click_timestamp").alias("_t"))
    users = past.groupBy("user_id").agg(F.count(F.lit(1)).alias("interactions"), F.sum("conversion_label").cast("long").alias("conversions"), F.avg(F.log1p(F.greatest("product_price", F.lit(0.0)))).alias("mean_log_price"), F.max("click_timestamp").alias("_last"))
    rate = (F.col("conversions") + alpha * F.col("_g")) / (F.col("interactions") + alpha)
    return users.crossJoin(F.broadcast(overall)).select("user_id", "interactions", "conversions", rate.alias("smoothed_cvr"), "mean_log_price", F.log1p("interactions").alias("log_interactions"), F.log1p(F.col("_t") - F.col("_last")).alias("recency"))


def repeated_rates(df: DataFrame) -> DataFrame:
    """One row: share of rows beyond the first of their pair, and of pairs with several rows."""
    pairs = df.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pairs"), safe_divide(F.sum(F.col("n") - 1), F.sum("n")).alias("repeated_rows"), F.avg((F.col("n") > 1).cast("double")).alias("repeated_pairs"))


def fingerprint_overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct row fingerprints of both tables and in common."""
    x = a.select(*columns).select(row_digest(a.select(*columns)).alias("h")).distinct()
    y = b.select(*columns).select(row_digest(b.select(*columns)).alias("h")).distinct()
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), "h", "full")
    return both.agg(F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))


def positive_histogram(users: DataFrame, positives: DataFrame) -> DataFrame:
    """(bucket, users): users by their number of positives, 0, 1, 2-5 and more."""
    n = users.select("user_id").distinct().join(positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "left")
    k = F.coalesce("n", F.lit(0))
    return n.groupBy(F.when(k == 0, "0").when(k == 1, "1").when(k <= 5, "2-5").otherwise(">5").alias("bucket")).agg(F.count(F.lit(1)).alias("users"))


def exclusion_reasons(candidates: DataFrame, past: DataFrame) -> DataFrame:
    """(reason, rows): why a candidate gives no labelled row; reasons exclude each other."""
    users = past.select("user_id").distinct().withColumn("_u", F.lit(1))
    items = past.select(F.col("product_id").alias("candidate_ad_id")).distinct().withColumn("_i", F.lit(1))
    pairs = past.select("user_id", F.col("product_id").alias("candidate_ad_id")).distinct().withColumn("_p", F.lit(1))
    rows = candidates.join(users, "user_id", "left").join(items, "candidate_ad_id", "left").join(pairs, ["user_id", "candidate_ad_id"], "left")
    reason = F.when(F.col("_u").isNull(), "unknown_user").when(F.col("_i").isNull(), "unknown_product").when(F.col("_p").isNull(), "no_interaction").otherwise("positive")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def nonzero_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate): share of values that are not 0."""
    wide = df.agg(*(F.avg((F.col(c) != 0).cast("double")).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in columns))).alias("x")).select("x.*")


def class_means(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, positive_mean, negative_mean)."""
    wide = df.agg(*(F.avg(F.when(F.col(label) == y, F.col(c))).alias(f"{c}_{y}") for c in columns for y in (0, 1)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_1").alias("positive_mean"), F.col(f"{c}_0").alias("negative_mean")) for c in columns))).alias("x")).select("x.*")
