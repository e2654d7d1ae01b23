"""Running popularity and windowed click rates over interaction and impression streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_popularity(stream: DataFrame, click: float = 1.0, conversion: float = 3.0) -> DataFrame:
    """(candidate_ad_id, popularity_score) so far; for update or complete mode."""
    weight = F.when(F.col("conversion_label") == 1, conversion).otherwise(click)
    return stream.groupBy(F.col("product_id").alias("candidate_ad_id")).agg(F.sum(weight).alias("popularity_score"))


def click_rates(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Impressions, clicks and CTR of each campaign and window of event time; rows later than the watermark are left out."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", late)
    sums = timed.groupBy(F.window("event_time", width), "campaign_id").agg(F.count(F.lit(1)).alias("impressions"), F.sum("click").alias("clicks"))
    return sums.select(F.col("window.start").alias("start"), "campaign_id", "impressions", "clicks", (F.col("clicks") / F.col("impressions")).alias("ctr"))
