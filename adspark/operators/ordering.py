"""Places and running sums along a total order, without a task that sees the whole table.

Rows are dealt over ranges of the full order (so rows of one heavy value are dealt too) and written with their range. Sums
of ranges are few rows, at most one a shuffle partition; they give each range its start, and rows of one range are ordered
together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.sources.staging import staged

#: Parts that a 60-bit hash is dealt over by its upper bits.
HASH_PARTS_SHIFT = 48


def dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _part, the range of the order that a row falls into; written, so that every use sees the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")


def _after(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows (with _part) with the inclusive running sum of each column of `sums`, under its name."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(starts), "_part")
    added = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return joined.withColumns(added).drop(*(f"_s_{n}" for n in sums))


def running(df: DataFrame, order: list[Column], sums: dict[str, str], dealt_before: bool = False) -> DataFrame:
    """df with inclusive running sums along a total order: sums maps new names to columns."""
    rows = df if dealt_before else dealt(df, order)
    out = _after(rows, order, {n: F.col(c) for n, c in sums.items()})
    return out if dealt_before else out.drop("_part")


def numbered(df: DataFrame, order: list[Column], out: str = "source_row_number", keep_part: bool = False) -> DataFrame:
    """df with the place of each row in a total order, from 0."""
    rows = _after(dealt(df, order), order, {out: F.lit(1).cast("long")})
    rows = rows.withColumn(out, (F.col(out) - 1).cast("long"))
    return rows if keep_part else rows.drop("_part")


def numbered_by_hash(df: DataFrame, hashed: Column, key: str, out: str = "source_row_number") -> DataFrame:
    """df with the place of each row, from 0, in the order of a 60-bit hash and then the key. The hash's upper bits deal the
    rows evenly, so nothing has to be sampled or written."""
    rows = df.withColumn("_h", hashed).withColumn("_part", F.shiftright("_h", HASH_PARTS_SHIFT))
    placed = _after(rows, [F.col("_h"), F.col(key)], {out: F.lit(1).cast("long")})
    return placed.withColumn(out, (F.col(out) - 1).cast("long")).drop("_h", "_part")


def exact_quantiles(df: DataFrame, value: str, levels: tuple[float, ...], group: str | None = None) -> DataFrame:
    """(level, value), after the group if there is one: quantiles of the non-null values, linear between order statistics.
    Values are counted first, and as many rows are ordered as there are distinct values."""
    if group is not None:
        return _grouped_quantiles(df, value, levels, group)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, [F.col("v")], {"upto": "n"})
    total = placed.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.createDataFrame([(float(q),) for q in levels], "level double")
    ask = wanted.crossJoin(total).withColumn("at", F.col("level") * (F.col("total") - 1)).where("total > 0")
    # a value holds places upto - n to upto - 1; few levels meet each value
    found = placed.crossJoin(F.broadcast(ask)).where((F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("n") <= F.ceil("at")))
    both = found.groupBy("level", "at").agg(F.min_by("v", "upto").alias("low"), F.max_by("v", "upto").alias("high"))
    return both.select("level", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def _grouped_quantiles(df: DataFrame, value: str, levels: tuple[float, ...], group: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = staged(running(counts, [F.col("_g"), F.col("v")], {"upto": "n"}), "placed")
    groups = placed.groupBy("_g").agg(F.min(F.col("upto") - F.col("n")).alias("_first"), F.sum("n").alias("_total")).withColumnRenamed("_g", "_h")
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in levels))).alias("level")
    ask = groups.select("_h", "_first", "_total", wanted).withColumn("at", F.col("level") * (F.col("_total") - 1))
    rows = placed.join(ask, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("upto", F.col("upto") - F.col("_first"))
    found = rows.where((F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("n") <= F.ceil("at")))
    both = found.groupBy(F.col("_g").alias(group), "level", "at").agg(F.min_by("v", "upto").alias("low"), F.max_by("v", "upto").alias("high"))
    return both.select(group, "level", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))
