"""Views of the driver's tables as the logical tables that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.functions.expressions import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked product ads with their outcome, from order lines. event_id orders them in full."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = lines.withColumn("click_timestamp", epoch_seconds(lines, "l_shipdate"))
    rows = rows.join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(parts.select("p_partkey", "p_brand", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    money = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = [pad(F.col("l_orderkey"), 12), pad(F.col("l_linenumber"), 3), pad(F.col("l_partkey"), 10), pad(F.col("l_suppkey"), 8), pad(F.round("l_quantity").cast("long"), 6), pad(money, 14)]
    sold = F.col("l_returnflag") == "R"
    return rows.select(
        F.concat(*key).alias("event_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("partner_id"),
        "click_timestamp",
        sold.cast("int").alias("conversion_label"),
        F.when(sold, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("conversion_value_eur"),
        F.col("p_retailprice").alias("product_price"),
        F.col("p_brand").alias("product_brand"),
        F.col("p_type").alias("product_category_1"),
        F.col("o_orderpriority").alias("device_type"),
        F.col("l_quantity").alias("clicks_last_7d"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display impressions with clicks and conversions, from events in event_id order."""
    events = table(spark, sf_dir, "events")
    click = F.col("event_type").isin("click", "purchase").cast("int")
    conversion = F.col("event_type").isin("purchase", "signup").cast("int")
    return events.select(
        F.col("event_id"),
        epoch_seconds(events, "ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("campaign_id"),
        click.alias("click"),
        conversion.alias("conversion"),
        (click * conversion).alias("click_and_conversion"),
        F.col("value").alias("cost"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with stand-in probabilities made from their cost, in steps of 0.01 so that ties occur."""
    p = F.round(F.col("cost") / (F.col("cost") + 50), 2)
    q = F.round(F.col("cost") / (F.col("cost") + 150), 2)
    return impressions(spark, sf_dir).withColumns({"raw_pctr": F.greatest(F.lit(0.01), p), "raw_pctcvr": F.greatest(F.lit(0.005), q)})


#: The same views for SQL engines: common table expressions.
INTERACTIONS_SQL = """interactions AS (
  SELECT lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 3, '0') || lpad(l_partkey::VARCHAR, 10, '0') || lpad(l_suppkey::VARCHAR, 8, '0')
      || lpad(round(l_quantity)::BIGINT::VARCHAR, 6, '0') || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') AS event_id,
    o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS product_id, l_suppkey::VARCHAR AS partner_id, epoch(l_shipdate)::BIGINT AS click_timestamp,
    (l_returnflag = 'R')::INT AS conversion_label, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) END AS conversion_value_eur,
    p_retailprice AS product_price, p_brand AS product_brand, p_type AS product_category_1, o_orderpriority AS device_type, l_quantity AS clicks_last_7d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
IMPRESSIONS_SQL = """impressions AS (
  SELECT event_id, floor(epoch(ts))::BIGINT AS timestamp, user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS campaign_id,
    (event_type IN ('click', 'purchase'))::INT AS click, (event_type IN ('purchase', 'signup'))::INT AS conversion,
    (event_type = 'purchase')::INT AS click_and_conversion, value AS cost FROM events)"""
PREDICTIONS_SQL = (
    IMPRESSIONS_SQL
    + """, predictions AS (
  SELECT *, greatest(0.01::DOUBLE, round(cost / (cost + 50), 2)) AS raw_pctr, greatest(0.005::DOUBLE, round(cost / (cost + 150), 2)) AS raw_pctcvr FROM impressions)"""
)
