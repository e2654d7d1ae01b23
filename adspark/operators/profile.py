"""Profiles of tables: missing values, numbers, categories and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.expressions import MISSING, safe_divide
from adspark.operators.ordering import exact_quantiles


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.column", "p.value")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, missing_rate) in one pass over wide rows."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"n_{c}") for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"n_{c}")).alias("missing")) for c in columns)))
    return counts.select("rows", pairs.alias("p")).select("p.column", "rows", "p.missing", safe_divide("p.missing", "rows").alias("missing_rate"))


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type): int64, float64, string, or unknown where all is missing."""
    checks = []
    for c in columns:
        number = F.col(c).cast("string").try_cast("double")
        checks += [F.bool_and(number.isNotNull()).alias(f"f_{c}"), F.bool_and(F.col(c).cast("string").rlike(r"^\s*[+-]?\d+\s*$")).alias(f"i_{c}")]
    wide = df.select(*columns).agg(*checks, *(F.count(c).alias(f"n_{c}") for c in columns))
    kind = lambda c: F.when(F.col(f"n_{c}") == 0, "unknown").when(F.col(f"i_{c}"), "int64").when(F.col(f"f_{c}"), "float64").otherwise("string")
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), kind(c).alias("type")) for c in columns))).alias("p")).select("p.column", "p.type")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, min, max)."""
    wide = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"count_{c}").alias("count"), *(F.col(f"{n}_{c}").cast("double").alias(n) for n in ("mean", "min", "max"))) for c in columns))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def top_categories(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, value, n, rank): most frequent values of each column, ties by value."""
    counts = _long(df, columns).groupBy("column", F.coalesce("value", F.lit(MISSING)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def label_statistics(df: DataFrame) -> DataFrame:
    """Counts, rates and cross cells of clicks and conversions of impressions, and exact distinct counts."""
    cell = lambda a, b: F.count_if((F.col("click") == a) & (F.col("conversion") == b)).alias(f"click{a}_conversion{b}")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(cell(a, b) for a in (0, 1) for b in (0, 1)),
        safe_divide(F.sum("click"), F.count(F.lit(1))).alias("ctr"),
        safe_divide(F.sum("click_and_conversion"), F.sum("click")).alias("cvr"),
        safe_divide(F.sum("click_and_conversion"), F.count(F.lit(1))).alias("ctcvr"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("campaign_id").alias("campaigns"),
    )


def quantiles(df: DataFrame, column: str, levels: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), group: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation, as columns p50, p90, ..., of all rows or of each group."""
    rows = df.withColumn("_g", F.lit(0) if group is None else F.col(group))
    found = exact_quantiles(rows, column, levels, "_g")
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("level") == q, F.col("value"))).alias(f"p{round(q * 100)}") for q in levels)).withColumnRenamed("_g", "_h")
    sums = rows.groupBy("_g").agg(F.count(column).alias("n"), F.avg(column).alias("mean"))
    out = sums.join(wide, F.col("_g").eqNullSafe(F.col("_h")), "left").drop("_h")
    return out.drop("_g") if group is None else out.withColumnRenamed("_g", group)


def approximate_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sketched distinct counts, about 0.8 % off."""
    return df.agg(*(F.approx_count_distinct(c, 0.0081).alias(c) for c in columns))
