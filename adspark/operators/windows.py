"""Time windows: exact order-statistic splits, cohorts and checks of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _running(df: DataFrame, timestamp: str) -> DataFrame:
    """(ts, n, upto, total): rows of each timestamp, running and in all. One row a distinct timestamp is ordered, not one a
    row of df."""
    counts = df.where(F.col(timestamp).isNotNull()).groupBy(F.col(timestamp).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.orderBy("ts")
    return counts.withColumn("upto", F.sum("n").over(everything)).withColumn("total", F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def higher_quantile(df: DataFrame, timestamp: str, ratio: float) -> DataFrame:
    """One row, threshold: the order statistic at index ceil(ratio * (n - 1)). Earlier rows, and equal ones, are before."""
    at = F.ceil(F.lit(ratio) * (F.col("total") - 1))
    return _running(df, timestamp).where(F.col("upto") > at).agg(F.min("ts").alias("threshold"))


def strict_boundaries(df: DataFrame, timestamp: str, ratios: list[float]) -> DataFrame:
    """One row, start_0, start_1, ...: for each cumulative ratio the first timestamp after that of row int(n * ratio) - 1.
    Rows of one timestamp stay together; a start that no row reaches is null."""
    running = _running(df, timestamp)
    out = None
    for i, ratio in enumerate(ratios):
        base = F.greatest(F.floor(F.col("total") * F.lit(ratio)) - 1, F.lit(0))
        first = running.withColumn("_base", F.min(F.when(F.col("upto") > base, F.col("ts"))).over(Window.partitionBy()))
        one = first.agg(F.min(F.when(F.col("ts") > F.col("_base"), F.col("ts"))).alias(f"start_{i}"))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def split(df: DataFrame, timestamp: str, ratio: float, names: tuple[str, str] = ("past", "future")) -> DataFrame:
    """df with window: the first name up to the threshold, the second after it; rows without a timestamp have none."""
    bound = F.broadcast(higher_quantile(df, timestamp, ratio))
    ts = F.col(timestamp)
    return df.crossJoin(bound).withColumn("window", F.when(ts <= F.col("threshold"), names[0]).when(ts > F.col("threshold"), names[1])).drop("threshold")


def split_three(df: DataFrame, timestamp: str, past: float, future_a: float) -> DataFrame:
    """df with window past, future_a or future_b, by strict boundaries: `past` of all rows, then `future_a` of the rest."""
    bounds = F.broadcast(strict_boundaries(df, timestamp, [past, past + (1 - past) * future_a]))
    ts = F.col(timestamp)
    window = F.when(ts < F.col("start_0"), "past").when(ts < F.col("start_1"), "future_a").otherwise("future_b")
    return df.crossJoin(bounds).withColumn("window", window).drop("start_0", "start_1")


def eligible_users(df: DataFrame) -> DataFrame:
    """Users with rows in both windows."""
    seen = df.groupBy("user_id").agg(F.bool_or(F.col("window") == "past").alias("p"), F.bool_or(F.col("window") == "future").alias("f"))
    return seen.where("p AND f").select("user_id")


def hashed_users(users: DataFrame, seed: int, n: int) -> DataFrame:
    """n users in the order of a hash: a sample that reruns repeat."""
    from adspark.functions.expressions import stable_hash

    return users.withColumn("_h", stable_hash(F.lit(seed), F.col("user_id"))).orderBy("_h", "user_id").limit(n).drop("_h")


def window_stats(df: DataFrame, timestamp: str = "click_timestamp") -> DataFrame:
    """Rows, users, products, pairs, conversions and time range of each window."""
    return df.groupBy("window").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("product_id").alias("products"),
        F.count_distinct("user_id", "product_id").alias("pairs"),
        F.sum("conversion_label").cast("long").alias("conversions"),
        F.min(timestamp).alias("min_timestamp"),
        F.max(timestamp).alias("max_timestamp"),
    )


def order_violations(df: DataFrame, order: str, timestamp: str, parts: int = 512) -> DataFrame:
    """One row, violations: rows whose timestamp is before that of the row before them. Ranges of rows are checked apart;
    their first and last rows are then compared."""
    dealt = df.select(order, timestamp).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    inside = dealt.withColumn("_before", F.lag(timestamp).over(Window.partitionBy("_part").orderBy(order)))
    ends = inside.groupBy("_part").agg(F.count_if(F.col(timestamp) < F.col("_before")).alias("bad"), F.min_by(timestamp, order).alias("first"), F.max_by(timestamp, order).alias("last"))
    between = ends.withColumn("_last", F.lag("last").over(Window.orderBy("_part")))
    return between.agg(F.coalesce(F.sum(F.col("bad") + F.when(F.col("first") < F.col("_last"), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"))


def assert_window_order(stats: DataFrame, names: list[str]) -> None:
    """An error unless each window ends before the next begins."""
    rows = {r["window"]: r for r in stats.collect()}
    for a, b in zip(names, names[1:], strict=False):
        if a not in rows or b not in rows or rows[a]["max_timestamp"] >= rows[b]["min_timestamp"]:
            raise ValueError(f"window {a} does not end before {b} begins")


def refuse_later_window(path: str, later: str = "future_b") -> None:
    """An error for paths of the final holdout."""
    if later in path.replace("-", "_").lower():
        raise ValueError(f"{path} belongs to the final holdout")


def assert_disjoint(df: DataFrame, key: str, window: str = "window") -> None:
    """No key may stand in two windows."""
    shared = df.groupBy(key).agg(F.min(window).alias("a"), F.max(window).alias("b")).where("a <> b").limit(1).collect()
    if shared:
        raise ValueError(f"{key} {shared[0][key]!r} is in windows {shared[0]['a']!r} and {shared[0]['b']!r}")
