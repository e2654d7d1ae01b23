"""Negatives, labelled examples and validation splits, all by stable hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.expressions import stable_hash
from adspark.operators.ordering import numbered, numbered_by_hash


def interaction_pairs(df: DataFrame) -> DataFrame:
    """(user_id, candidate_ad_id, ts, converted): one row a pair."""
    return df.groupBy("user_id", F.col("product_id").alias("candidate_ad_id")).agg(F.max("click_timestamp").alias("ts"), F.max("conversion_label").alias("converted"))


def labelled_candidates(candidates: DataFrame, pairs: DataFrame, negatives: int, seed: int = 2026, conversion_weight: float = 3.0) -> DataFrame:
    """Training rows: a user's clicked candidates, and `negatives` others for each, in hash order. Users without a clicked
    candidate have none. Conversions weigh more; the group's time is that of its latest click, -1 without one."""
    rows = candidates.join(pairs, ["user_id", "candidate_ad_id"], "left").withColumn("label", F.col("converted").isNotNull().cast("int"))
    user = Window.partitionBy("user_id")
    rows = rows.withColumn("_n", F.sum("label").over(user)).withColumn("group_ts", F.coalesce(F.max("ts").over(user), F.lit(-1)).cast("long")).where("_n > 0")
    order = [stable_hash(F.lit(seed), F.col("user_id"), F.col("candidate_ad_id")), F.col("candidate_ad_id")]
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "label").orderBy(*order)))
    weight = F.when(F.col("converted") == 1, conversion_weight).otherwise(1.0)
    return rows.where((F.col("label") == 1) | (F.col("_k") <= F.col("_n") * negatives)).select("user_id", "candidate_ad_id", "label", weight.alias("sample_weight"), "group_ts")


def is_validation(key: Column, fraction: float = 0.2, seed: int = 2026) -> Column:
    """Whether a key's hash puts it among the validation rows."""
    return stable_hash(F.lit(seed), key) % 10_000 < round(fraction * 10_000)


def time_validation(rows: DataFrame, ratio: float = 0.8) -> DataFrame:
    """rows with validation: groups after the quantile of valid group times; by user hash where no group has a time."""
    bound = rows.where("group_ts >= 0").select("user_id", "group_ts").distinct().agg(F.floor(F.percentile("group_ts", F.lit(ratio))).cast("long").alias("_at"))
    hashed = stable_hash(F.lit(0), F.col("user_id")) % 10 >= 8
    return rows.crossJoin(F.broadcast(bound)).withColumn("validation", F.when(F.col("_at").isNull(), hashed).otherwise(F.col("group_ts") > F.col("_at"))).drop("_at")


def past_pool(past: DataFrame) -> DataFrame:
    """(candidate_ad_id, n, pos): products by count, then id; pos from 0."""
    counts = past.groupBy(F.col("product_id").alias("candidate_ad_id")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [F.desc("n"), F.col("candidate_ad_id")], "pos")


def pool_negatives(positives: DataFrame, pool: DataFrame, per_positive: int, seed: int = 2026) -> DataFrame:
    """(user_id, candidate_ad_id, pos): for each user the next products of the pool, around from a place that the user's
    hash gives, that are no positives of theirs. So many places are visited as positives could spoil, and no more. A user is
    one row with the places of the positives, so only what is kept is joined with the pool."""
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    places = pool.select("pos", "candidate_ad_id")
    known = positives.select("user_id", "product_id").join(places, F.col("product_id") == F.col("candidate_ad_id"), "left")
    held = F.collect_set(F.when(F.col("user_id").isNotNull(), F.col("pos"))).alias("held")
    users = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), held).crossJoin(F.broadcast(size)).where("size > 0")
    start = stable_hash(F.lit(seed), F.col("user_id")) % F.col("size")
    steps = F.least(F.col("size"), F.col("n") * (per_positive + 1)) - 1
    visited = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda s: F.pmod(F.col("start") + s, F.col("size")))
    free = F.slice(F.array_except(visited, "held"), F.lit(1), (F.col("n") * per_positive).cast("int"))
    kept = users.withColumn("start", start).select("user_id", F.explode(free).alias("pos"))
    return kept.join(places, "pos").select("user_id", "candidate_ad_id", "pos")


def hard_negatives(similar: DataFrame, positives: DataFrame, skip: int, n: int) -> DataFrame:
    """(query, item, rank): from each query's list without its positives, n items after the first `skip`."""
    free = similar.select("query", "item", "score").join(positives.select("query", "item"), ["query", "item"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return free.withColumn("rank", rank).where((F.col("rank") > skip) & (F.col("rank") <= skip + n))


def synthetic_auctions(df: DataFrame, per_auction: int, seed: int = 2026, key: str = "event_id") -> DataFrame:
    """df with auction_id: rows in hash order, per_auction in a row together."""
    placed = numbered_by_hash(df, stable_hash(F.lit(seed), F.col(key)), key, "_place")
    return placed.withColumn("auction_id", F.floor(F.col("_place") / per_auction).cast("long")).drop("_place")
