"""Candidates on their way through ranking: features joined to them, guards, ranks and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.expressions import MISSING, stable_hash
from adspark.operators.auction import budget_phases, won_places
from adspark.operators.ordering import numbered

# Names of outcomes, which must never be bid on.
OUTCOMES = frozenset({"conversion", "conversion_label", "conversion_value", "conversion_value_eur", "click"})


def enrich(candidates: DataFrame, features: DataFrame, key: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """candidates with columns of `features` (one row a key); what is unknown or missing is 0 or the missing token. <key>_missing
    says whether the key has no features."""
    held = features.select(F.col(key).alias("_key"), *numbers, *categories, F.lit(1).alias("_known"))
    joined = candidates.join(held, F.col(key) == F.col("_key"), "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers} | {c: F.coalesce(c, F.lit(MISSING)) for c in categories}
    return joined.withColumns({**filled, f"{key}_missing": F.col("_known").isNull().cast("int")}).drop("_key", "_known")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right's row of the same key; a key that occurs twice on either side is an error, a null key
    matches nothing."""
    counted = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    twice = F.when(F.col(key).isNotNull() & (F.col("_n") > 1), F.raise_error(F.concat(F.lit("key occurs more than once: "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("_n"))
    checked = lambda df: counted(df).withColumn("_n", twice).where("_n > 0").drop("_n")
    return checked(left).join(checked(right), key, "left")


def observed_rows(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a label of 0 or 1, one row: rows, kept, dropped)."""
    good = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))
    return df.where(good), counts


def positive_rank(rank: Column) -> Column:
    """A rank as a long; anything but a positive whole number is an error."""
    number = rank.try_cast("double")
    bad = number.isNull() | (number != F.floor(number)) | (number <= 0)
    return F.when(bad, F.raise_error(F.lit("rank must be a positive integer")).cast("long")).otherwise(number.cast("long"))


def finite(name: str) -> Column:
    """A column, where null, NaN and infinities are an error."""
    c = F.col(name).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} must be finite")).cast("double")).otherwise(c)


def predicted_value(df: DataFrame, name: str) -> Column:
    """A value column that bids may use: it must be a prediction by name, finite and not negative."""
    if name in OUTCOMES or "conversion_value" in name.lower() or not name.startswith("predicted_"):
        raise ValueError(f"{name!r} is not named as a prediction")
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    held = finite(name)
    return F.when(held < 0, F.raise_error(F.lit(f"{name} must not be negative")).cast("double")).otherwise(held)


def top_of_user(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each user, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= k)


def coarse_top(df: DataFrame, k: int) -> DataFrame:
    """Best coarse scores, then fused scores, then ids."""
    return top_of_user(df, [F.desc("coarse_score"), F.desc("rrf_score"), F.col("candidate_ad_id")], k)


def fine_top(df: DataFrame, k: int) -> DataFrame:
    """Best expected values, then conversion probabilities, then ids."""
    return top_of_user(df, [F.desc("expected_value_score"), F.desc("pCVR"), F.col("candidate_ad_id")], k)


def derived_rank(df: DataFrame) -> DataFrame:
    """df with rank by fused score and id, for lists that were stored without one."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("rrf_score"), "candidate_ad_id")))


def first_users_met(df: DataFrame, order: str, n: int) -> DataFrame:
    """(user_id): the n users that a table in the given order meets first. A sampling operator: n is its feature."""
    return df.groupBy("user_id").agg(F.min(order).alias("_first")).orderBy("_first", "user_id").limit(n).select("user_id")


def row_budget(df: DataFrame, budget: int) -> DataFrame:
    """Rows of whole users, in order of the user's id, as long as they fit: a user whose rows exceed what is left is passed over,
    and later, smaller ones may still fit."""
    sizes = df.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("price"))
    placed = numbered(sizes, [F.col("user_id")], "place", keep_part=True)
    phases, places = budget_phases(placed, float(budget))
    return df.join(won_places(placed, phases, places).where("won = 1").select("user_id"), "user_id", "left_semi")


def drawn_negatives(positives: DataFrame, history: DataFrame, pool: DataFrame, n: int, seed: int = 2026, tries: int = 4) -> DataFrame:
    """(user_id, product_id, candidate_ad_id): n draws for each positive from the pool (candidate_ad_id, pos from 0), by hashes
    of the positive and the number of the draw; a draw that the user's history holds is drawn again, `tries` times, and
    then goes to the next free place of the pool. A user whose history is the whole pool has none."""
    size = F.broadcast(pool.agg(F.count(F.lit(1)).alias("_size")))
    at = lambda t: stable_hash(F.lit(seed), F.col("user_id"), F.col("product_id"), F.col("draw"), t) % F.col("_size")
    known = F.broadcast(pool.agg(F.count(F.lit(1)).alias("_all")))
    mine = history.join(pool, F.col("product_id") == F.col("candidate_ad_id")).groupBy("user_id").agg(F.array_sort(F.collect_set("pos")).alias("_held"))
    rows = positives.select("user_id", "product_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")).crossJoin(size).join(mine, "user_id", "left").crossJoin(known)
    held = F.coalesce("_held", F.array().cast("array<bigint>"))
    # a draw is hashed when those before it are held
    drawn = [F.get(F.filter(F.array(at(F.lit(t))), lambda x: ~F.array_contains(held, x)), F.lit(0)) for t in range(tries)]
    # the first place after the last draw that is not held: one of the next size(held) + 1
    around = F.transform(F.sequence(F.lit(1).cast("long"), F.size(held).cast("long") + 1), lambda s: F.pmod(at(F.lit(tries - 1)) + s, F.col("_size")))
    free = F.filter(around, lambda x: ~F.array_contains(held, x))
    pos = F.coalesce(*drawn, F.get(free, F.lit(0)))
    return rows.where(F.size(held) < F.col("_all")).withColumn("pos", pos).join(pool.select("pos", "candidate_ad_id"), "pos").select("user_id", "product_id", "draw", "candidate_ad_id")


def click_stats(df: DataFrame, split: str) -> DataFrame:
    """(split, rows, timestamp_min, timestamp_max, ctr_positives, ctcvr_positives, clicked_rows, clicked_conversions)."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("timestamp_min"), F.max("timestamp").alias("timestamp_max"),
        F.sum("click").cast("long").alias("ctr_positives"), F.sum("click_and_conversion").cast("long").alias("ctcvr_positives"),
        F.count_if(F.col("click") == 1).alias("clicked_rows"), F.sum(F.when(F.col("click") == 1, F.col("conversion")).otherwise(0)).cast("long").alias("clicked_conversions"),
    )


def bucket_recall(candidates: DataFrame, positives: DataFrame, buckets: DataFrame, cutoff: int) -> DataFrame:
    """(bucket, positives, hits, recall): positive pairs whose product is in a popularity bucket, and those among a user's first
    candidates."""
    hits = candidates.where(F.col("rank") <= cutoff).select("user_id", F.col("candidate_ad_id").alias("product_id"), F.lit(1).alias("_hit")).distinct()
    rows = positives.join(buckets.select("product_id", "bucket"), "product_id").join(hits, ["user_id", "product_id"], "left")
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("positives"), F.count("_hit").alias("hits"))
    return sums.withColumn("recall", F.col("hits") / F.col("positives"))


def catalogue_recall(candidates: DataFrame, positives: DataFrame, warm: DataFrame, catalogue: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(slice, cutoff, users, recall, hit_rate) over users with positives in the slice: all, warm (products with past
    interactions) and cold (other products of the catalogue)."""
    known = catalogue.select("product_id").distinct().withColumn("_known", F.lit(1)).join(warm.select("product_id").distinct().withColumn("_warm", F.lit(1)), "product_id", "left")
    ranks = candidates.groupBy("user_id", F.col("candidate_ad_id").alias("product_id")).agg(F.min("rank").alias("_rank"))
    rows = positives.join(known, "product_id", "left").join(ranks, ["user_id", "product_id"], "left")
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("_warm") == 1, "warm"), F.when((F.col("_known") == 1) & F.col("_warm").isNull(), "cold")))
    each = rows.withColumn("slice", F.explode(slices)).withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    by = each.groupBy("slice", "cutoff", "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_rank") <= F.col("cutoff")).alias("h"))
    return by.groupBy("slice", "cutoff").agg(F.count(F.lit(1)).alias("users"), F.avg(F.col("h") / F.col("n")).alias("recall"), F.avg((F.col("h") > 0).cast("double")).alias("hit_rate"))


def retention(top: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: positives (user_id, product_id), those retained in top (user_id, candidate_ad_id), and their share."""
    kept = positives.join(top.select("user_id", F.col("candidate_ad_id").alias("product_id"), F.lit(1).alias("_kept")).distinct(), ["user_id", "product_id"], "left")
    sums = kept.agg(F.count(F.lit(1)).alias("positives"), F.count("_kept").alias("retained"))
    return sums.withColumn("retention", F.try_divide(F.col("retained").cast("double"), F.col("positives")))


def clicked_only(df: DataFrame, click: str = "click") -> DataFrame:
    """Rows that were clicked; rows without a known click are none."""
    return df.where(F.col(click) == 1)
