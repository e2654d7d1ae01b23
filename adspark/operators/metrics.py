"""Recall, ranking, probability, value and drift metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.expressions import clip, safe_divide
from adspark.operators.ordering import exact_quantiles, numbered, running
from adspark.sources.staging import staged


def recall_at(candidates: DataFrame, positives: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(cutoff, users, recall, hit_rate) over all users with positives, those without candidates included."""
    size = positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    hits = candidates.join(positives.withColumnRenamed("product_id", "candidate_ad_id"), ["user_id", "candidate_ad_id"])
    per_user = size.join(hits.groupBy("user_id").agg(*(F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cutoffs)), "user_id", "left")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.coalesce(F.col(f"h{c}"), F.lit(0)).alias("h")) for c in cutoffs))).alias("p")
    return per_user.select("size", pairs).groupBy("p.cutoff").agg(F.count(F.lit(1)).alias("users"), F.avg(F.col("p.h") / F.col("size")).alias("recall"), F.avg((F.col("p.h") > 0).cast("double")).alias("hit_rate"))


def global_recall_at(top: DataFrame, positives: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """recall_at of one list that all users share: products meet their ranks in a join on the product."""
    ranked = positives.join(top.select(F.col("candidate_ad_id").alias("product_id"), "rank"), "product_id", "left")
    per_user = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), *(F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cutoffs))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"h{c}").alias("h")) for c in cutoffs))).alias("p")
    return per_user.select("size", pairs).groupBy("p.cutoff").agg(F.count(F.lit(1)).alias("users"), F.avg(F.col("p.h") / F.col("size")).alias("recall"), F.avg((F.col("p.h") > 0).cast("double")).alias("hit_rate"))


def source_overlap(every: DataFrame, positives: DataFrame, sources: tuple[str, ...], cutoff: int) -> DataFrame:
    """(source, hits, alone, incremental): hit pairs of each source, those of no other, and those of no earlier one."""
    hits = every.where(F.col("rank") <= cutoff).join(positives.withColumnRenamed("product_id", "candidate_ad_id"), ["user_id", "candidate_ad_id"])
    order = F.lit(len(sources))
    for i, s in enumerate(sources):
        order = F.when(F.col("source") == s, i).otherwise(order)
    pairs = hits.groupBy("user_id", "candidate_ad_id").agg(F.collect_set("source").alias("by"), F.min_by("source", order).alias("first"))
    rows = pairs.select("first", "by", F.explode("by").alias("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.size("by") == 1).alias("alone"), F.count_if(F.col("first") == F.col("source")).alias("incremental"))


def cold_start(past: DataFrame, future: DataFrame) -> DataFrame:
    """One row: shares of later rows whose user, product and pair do not occur before."""
    flag = lambda c: past.select(*c).distinct().withColumn("_" + c[-1][:1] + str(len(c)), F.lit(1))
    rows = future.join(flag(["user_id"]), "user_id", "left").join(flag(["product_id"]), "product_id", "left").join(flag(["user_id", "product_id"]), ["user_id", "product_id"], "left")
    new = lambda c: F.avg(F.col(c).isNull().cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), new("_u1").alias("unseen_user"), new("_p1").alias("unseen_product"), new("_p2").alias("unseen_pair"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and rows of each distinct score, with running totals from the highest score on."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("tp"), F.count(F.lit(1)).cast("double").alias("n"))
    return running(counts, [F.desc("s")], {"ctp": "tp", "cn": "n"})


def ranking_quality(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: rows, positives, roc_auc and average_precision; null where only one class occurs."""
    h = _by_score(df, label, score)
    neg = F.col("n") - F.col("tp")
    t = h.agg(F.sum("n").alias("n"), F.sum("tp").alias("p"), F.sum(neg * (F.col("ctp") - F.col("tp")) + 0.5 * F.col("tp") * neg).alias("a"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("ap"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    return t.select(F.col("n").cast("long").alias("rows"), F.col("p").cast("long").alias("positives"), F.when(both, F.col("a") / (F.col("p") * (F.col("n") - F.col("p")))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("p")).alias("average_precision"))


def probability_losses(df: DataFrame, label: str, score: str, epsilon: float = 1e-7) -> DataFrame:
    """One row: log loss, Brier score and the means of label and score."""
    p, y = clip(score, epsilon, 1 - epsilon), F.col(label)
    return df.agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        F.avg(y).alias("mean_label"),
        F.avg(score).alias("mean_score"),
    )


def reliability(df: DataFrame, label: str, score: str, bins: int) -> DataFrame:
    """(bin, n, mean_score, mean_label, gap): all bins, empty ones with gap 0."""
    index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    filled = df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    gap = F.coalesce(F.abs(F.col("mean_score") - F.col("mean_label")), F.lit(0.0))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "mean_label", gap.alias("gap"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_gap"))


def value_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: MAE, RMSE, and both of log1p, over rows with an actual value."""
    a, p = F.col(actual), F.greatest(F.col(predicted), F.lit(0.0))
    log = F.log1p(p) - F.log1p(a)
    return df.where(a.isNotNull() & (a >= 0)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"), F.avg(F.abs(log)).alias("log_mae"), F.sqrt(F.avg(log * log)).alias("rmsle")
    )


def ndcg_at(df: DataFrame, score: str, label: str, cutoffs: tuple[int, ...], item: str = "product_id") -> DataFrame:
    """(cutoff, users, ndcg, recall, hit_rate) over users with a positive."""
    user = Window.partitionBy("user_id")
    r = df.withColumns({"rank": F.row_number().over(user.orderBy(F.desc(score), item)), "ideal": F.row_number().over(user.orderBy(F.desc(label), item))})
    gain = lambda place, c: F.sum(F.when(F.col(place) <= c, F.col(label) / F.log2(F.col(place) + 1)).otherwise(0.0))
    per = r.groupBy("user_id").agg(F.sum(label).alias("p"), *(x for c in cutoffs for x in (gain("rank", c).alias(f"d{c}"), gain("ideal", c).alias(f"i{c}"), F.sum(F.when(F.col("rank") <= c, F.col(label)).otherwise(0)).alias(f"h{c}")))).where("p > 0")
    row = lambda c: F.struct(F.lit(c).alias("cutoff"), (F.col(f"d{c}") / F.col(f"i{c}")).alias("ndcg"), (F.col(f"h{c}") / F.col("p")).alias("recall"), (F.col(f"h{c}") > 0).cast("double").alias("hit"))
    return per.select(F.explode(F.array(*map(row, cutoffs))).alias("x")).groupBy("x.cutoff").agg(F.count(F.lit(1)).alias("users"), F.avg("x.ndcg").alias("ndcg"), F.avg("x.recall").alias("recall"), F.avg("x.hit").alias("hit_rate"))


def reciprocal_rank(candidates: DataFrame, positives: DataFrame, cutoff: int) -> DataFrame:
    """One row, mrr over all users with positives."""
    hits = candidates.where(F.col("rank") <= cutoff).join(positives.withColumnRenamed("product_id", "candidate_ad_id"), ["user_id", "candidate_ad_id"]).groupBy("user_id").agg(F.min("rank").alias("r"))
    users = positives.select("user_id").distinct().join(hits, "user_id", "left")
    return users.agg(F.count(F.lit(1)).alias("users"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def deciles(df: DataFrame, score: str, label: str, value: str, key: str = "event_id", n: int = 10) -> DataFrame:
    """(decile, n, mean_score, labels, value, captured): equal parts by falling score, the first ones larger by one where rows do
    not divide; captured is the running share of the value (not below 0)."""
    placed = numbered(df.withColumn(value, F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))), [F.desc(score), F.col(key)])
    placed = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_all"))))
    small, more = F.floor(F.col("_all") / n), F.col("_all") % n
    at = F.col("source_row_number")
    part = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    sums = placed.groupBy(part.cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.sum(label).cast("long").alias("labels"), F.sum(value).alias("value"))
    upto = Window.orderBy("decile")
    return sums.withColumn("captured", safe_divide(F.sum("value").over(upto), F.sum("value").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def popularity_buckets(train: DataFrame) -> DataFrame:
    """(product_id, n, bucket): the 20 % of products with most rows are head, the next 30 % mid, the others tail."""
    counts = train.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(counts, [F.desc("n"), F.col("product_id")], "_at")
    total = F.broadcast(placed.agg(F.count(F.lit(1)).alias("_t")))
    return placed.crossJoin(total).withColumn("_p", F.col("_at") + 1).select("product_id", "n", F.when(F.col("_p") <= F.ceil(F.col("_t") * 0.2), "head").when(F.col("_p") <= F.ceil(F.col("_t") * 0.5), "mid").otherwise("tail").alias("bucket"))


# Whether more is better.
DIRECTIONS = {"roc_auc": 1, "average_precision": 1, "recall": 1, "ndcg": 1, "log_loss": -1, "brier": -1, "ece": -1, "mae": -1, "rmse": -1, "log_mae": -1, "rmsle": -1}


def drift(before: DataFrame, after: DataFrame, stable: float = 0.05, moderate: float = 0.15) -> DataFrame:
    """(metric, before, after, delta, relative, verdict) of one-row tables with the same columns. Every gain is "improved"; a
    loss is "stable" up to the first bound, then "moderate", and "large" beyond the second; without a former value, or where
    it is 0 and changes, the verdict is "n/a"."""
    names = [c for c in before.columns if c in after.columns and c in DIRECTIONS]
    rows = lambda df, n: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(n), F.lit(DIRECTIONS[c]).alias("d")) for c in names))).alias("x")).select("x.metric", f"x.{n}", "x.d")
    both = rows(before, "before").join(rows(after, "after").drop("d"), "metric")
    delta = F.col("after") - F.col("before")
    relative = F.try_divide(delta, F.abs("before"))
    gain = relative * F.col("d")
    verdict = F.when(delta == 0, "stable").when(relative.isNull(), "n/a").when(gain > 0, "improved").when(gain >= -stable, "stable").when(gain >= -moderate, "moderate").otherwise("large")
    return both.select("metric", "before", "after", delta.alias("delta"), relative.alias("relative"), verdict.alias("verdict"))


def serving_consistency(df: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """One row: how pCTR * clip(pCTCVR / pCTR) differs from pCTCVR, and the share of clipped ratios."""
    click, both = clip("raw_pctr", epsilon, 1 - epsilon), clip("raw_pctcvr", epsilon, 1 - epsilon)
    ratio = both / click
    error = F.abs(click * clip(ratio, 0.0, 1.0) - both)
    return df.agg(F.max(error).alias("max_error"), F.avg(error).alias("mean_error"), F.avg((ratio > 1).cast("double")).alias("clipped_fraction"))


def output_diagnostics(ranked: DataFrame, levels: tuple[float, float] = (0.9, 0.99)) -> DataFrame:
    """One row on ranked predictions: rows, those with a pCVR above each level, its median, the 99 % quantile of the expected
    value, first places and those of them above it."""
    ranked = staged(ranked.select("rank", "pCVR", "expected_value_score"), "ranked")
    quantile = lambda c, q, name: F.broadcast(exact_quantiles(ranked, c, (q,)).select(F.col("value").alias(name)))
    rows = ranked.crossJoin(quantile("pCVR", 0.5, "median_pcvr")).crossJoin(quantile("expected_value_score", 0.99, "value_p99"))  # single rows
    first = F.col("rank") == 1
    return rows.groupBy("median_pcvr", "value_p99").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pCVR") > levels[0]).alias("high"), F.count_if(F.col("pCVR") > levels[1]).alias("very_high"),
        F.count_if(first).alias("firsts"), F.count_if(first & (F.col("expected_value_score") > F.col("value_p99"))).alias("firsts_above"),
    )


def share_of(column: Column) -> Column:
    return F.avg(column.cast("double"))


def sketched(df: DataFrame, value: str, group: list[str], error: float = 0.01) -> DataFrame:
    """A mergeable sketch of a number: (*group, sign, bucket, n), rows in buckets whose bounds grow by (1 + error) / (1 - error),
    so that a bucket's middle is within `error` of each of its values. Non-finite values are left out. There are no more buckets
    than magnitudes of a double, whatever the number of rows; sketches merge by adding up n."""
    gamma = (1 + error) / (1 - error)
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    bucket = F.when(x != 0, F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma))).cast("long")).otherwise(F.lit(0))
    return df.where(finite).groupBy(*group, F.signum(x).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketch: DataFrame, group: list[str], levels: tuple[float, ...], error: float = 0.01) -> DataFrame:
    """(*group, level, value): of each level the bucket that holds the order statistic at floor(level * (n - 1)), by its middle."""
    gamma = (1 + error) / (1 - error)
    merged = sketch.groupBy(*group, "sign", "bucket").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*group).orderBy(F.col("sign"), F.col("sign") * F.col("bucket"))
    middle = F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    placed = merged.withColumns({"_upto": F.sum("n").over(up), "_total": F.sum("n").over(Window.partitionBy(*group)), "_v": middle})
    asked = placed.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumn("_at", F.floor(F.col("level") * (F.col("_total") - 1)))
    inside = asked.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("n") <= F.col("_at")))
    return inside.select(*group, "level", F.col("_v").alias("value"))


def prediction_diagnostics(df: DataFrame, columns: list[str], levels: tuple[float, ...] = (0.01, 0.5, 0.99), error: float = 0.01) -> DataFrame:
    """A row a column of predictions: name, rows, nonfinite, zeros, mean, std, min, max and its sketched quantiles."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    x = F.col("x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    known = F.when(finite, x)
    stats = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~finite).alias("nonfinite"), F.count_if(x == 0).alias("zeros"),
        F.avg(known).alias("mean"), F.stddev_pop(known).alias("std"), F.min(known).alias("min"), F.max(known).alias("max"),
    )
    found = sketch_quantiles(sketched(long, "x", ["name"], error), ["name"], levels, error)
    named = [F.max(F.when(F.col("level") == q, F.col("value"))).alias(f"q{round(100 * q)}") for q in levels]
    return stats.join(found.groupBy("name").agg(*named), "name", "left")
