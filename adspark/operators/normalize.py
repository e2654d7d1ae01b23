"""Typed tables from raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.expressions import mask_tokens, normal_id
from adspark.operators.ordering import numbered

# Columns of the raw click log, their names in the unified table, and how they are typed.
SEARCH_COLUMNS = {
    "Sale": ("conversion_label", "byte"),
    "SalesAmountInEuro": ("conversion_value_eur", "double"),
    "time_delay_for_conversion": ("conversion_delay_seconds", "double"),
    "click_timestamp": ("click_timestamp", "long"),
    "nb_clicks_1week": ("clicks_last_7d", "double"),
    "product_price": ("product_price", "double"),
    "product_age_group": ("product_age_group", "string"),
    "device_type": ("device_type", "string"),
    "audience_id": ("audience_id", "string"),
    "product_gender": ("product_gender", "string"),
    "product_brand": ("product_brand", "string"),
    "product_category_1": ("product_category_1", "string"),
    "product_category_2": ("product_category_2", "string"),
    "product_category_3": ("product_category_3", "string"),
    "product_category_4": ("product_category_4", "string"),
    "product_category_5": ("product_category_5", "string"),
    "product_category_6": ("product_category_6", "string"),
    "product_category_7": ("product_category_7", "string"),
    "product_country": ("product_country", "string"),
    "product_id": ("product_id", "string"),
    "product_title": ("product_title", "string"),
    "partner_id": ("partner_id", "string"),
    "user_id": ("user_id", "string"),
}
# Columns of the raw impression log.
IMPRESSION_INTEGERS = ("timestamp",)
IMPRESSION_NULLABLE = ("attribution", "conversion_timestamp", "conversion_id", "click_pos", "click_nb", "time_since_last_click")
IMPRESSION_BINARY = ("click", "conversion")
IMPRESSION_DOUBLES = ("cost", "cpo")
IMPRESSION_IDS = {"uid": "user_id", "campaign": "campaign_id", **{f"cat{i}": f"cat{i}" for i in range(1, 10)}}


# What event ids of the two logs begin with.
SEARCH_PREFIX, IMPRESSION_PREFIX = "criteo-", "criteo-attribution-"


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """df with source_row_number, from 0 in the given total order."""
    return numbered(df, [F.col(c) for c in order])


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("long")).otherwise(value)


def binary_label(c: Column | str, name: str) -> Column:
    """A 0/1 label; anything else is an error."""
    number = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return _checked(number.cast("long"), number.isNull() | ~number.isin(0.0, 1.0), f"{name} must be 0 or 1").cast("byte")


def normalize_search(raw: DataFrame, missing: tuple[str, ...] = ("", "-1"), by_column: dict[str, tuple[str, ...]] | None = None, prefix: str = SEARCH_PREFIX) -> DataFrame:
    """The unified interaction table from raw text columns with source_row_number."""
    by_column = {"click_timestamp": ("0",)} if by_column is None else by_column
    out = [F.concat(F.lit(prefix), F.lpad(F.col("source_row_number").cast("string"), 12, "0")).alias("event_id"), "source_row_number"]
    for source, (name, kind) in SEARCH_COLUMNS.items():
        value = mask_tokens(source, (*missing, *by_column.get(source, ())))
        if kind == "byte":
            out.append(binary_label(source, name).alias(name))
        elif kind == "string":
            out.append(value.alias(name))
        elif kind == "long":
            out.append(value.try_cast("double").try_cast("long").alias(name))
        else:
            out.append(value.try_cast(kind).alias(name))
    return raw.select(*out)


def normalize_impressions(raw: DataFrame, missing: tuple[str, ...] = ("", "-1"), prefix: str = IMPRESSION_PREFIX) -> DataFrame:
    """The impression table from raw text columns with source_row_number; bad integers and labels are errors."""

    def whole(name: str, required: bool) -> Column:
        value = mask_tokens(name, missing)
        number = value.try_cast("double")
        bad = value.isNotNull() & (number.isNull() | (number != F.floor(number)))
        if required:
            bad = bad | value.isNull()
        return _checked(number.cast("long"), bad, f"{name} must be an integer")

    click, conversion = binary_label("click", "click"), binary_label("conversion", "conversion")
    return raw.select(
        F.concat(F.lit(prefix), F.lpad(F.col("source_row_number").cast("string"), 12, "0")).alias("event_id"),
        "source_row_number",
        *(whole(c, True).alias(c) for c in IMPRESSION_INTEGERS),
        *(mask_tokens(c, missing).alias(n) for c, n in IMPRESSION_IDS.items()),
        click.alias("click"),
        conversion.alias("conversion"),
        (click * conversion).cast("byte").alias("click_and_conversion"),
        *(mask_tokens(c, missing).try_cast("double").alias(c) for c in IMPRESSION_DOUBLES),
        *(whole(c, False).alias(c) for c in IMPRESSION_NULLABLE),
    )


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ids are not blank after trimming."""
    for c in columns:
        df = df.withColumn(c, normal_id(c)).where(F.col(c).isNotNull())
    return df
