"""Features for ranking models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.expressions import MISSING, clip, hour_utc, positive_log, signed_log, stable_hash, weekday_monday0, weekday_thursday0
from adspark.operators.ordering import numbered

#: Fixed value: names that must never be features, as they are known only after the event.
FORBIDDEN = frozenset({"conversion_label", "conversion_value_eur", "conversion_delay_seconds", "conversion_delay_hours", "conversion", "click_and_conversion", "attribution", "conversion_timestamp", "conversion_id", "cost", "cpo", "click_timestamp"})
#: Fixed value: what the names of columns made from a later window begin with.
FORBIDDEN_PREFIX = "future_"
#: Buckets of the hashed features of the fine ranker.
FINE_BUCKETS = {
    "user_id": 1_000_003, "product_id": 1_000_003, "product_age_group": 10_007, "device_type": 10_007, "product_gender": 10_007,
    "product_brand": 100_003, "product_category_1": 100_003, "product_category_2": 100_003, "product_category_3": 100_003, "product_country": 10_007,
}


def assert_no_leakage(columns: list[str], forbidden: frozenset[str] = FORBIDDEN) -> None:
    """An error if a feature is known only after the event."""
    if bad := sorted(c for c in set(columns) if c in forbidden or c.startswith(FORBIDDEN_PREFIX)):
        raise ValueError(f"features that leak the outcome: {bad}")


def engineer(df: DataFrame, categories: list[str]) -> DataFrame:
    """Model features of interactions: calendar, missing flags, logs and categories with a missing token."""
    ts = F.col("click_timestamp")
    out = [
        "event_id",
        F.coalesce("conversion_label", F.lit(0)).cast("int").alias("conversion_label"),
        F.col("conversion_value_eur").isNotNull().cast("int").alias("has_conversion_value"),
        F.coalesce("conversion_value_eur", F.lit(0.0)).alias("conversion_value_eur"),
        F.coalesce(hour_utc(ts), F.lit(0)).alias("click_hour_utc"),
        F.coalesce(weekday_monday0(ts), F.lit(0)).alias("click_day_of_week_utc"),
        ts.isNull().cast("int").alias("click_timestamp_missing"),
    ]
    if "conversion_delay_seconds" in df.columns:
        delay = F.coalesce("conversion_delay_seconds", F.lit(0.0))
        out += [delay.alias("conversion_delay_seconds"), (delay / 3600).alias("conversion_delay_hours")]
    for c in ("product_price", "clicks_last_7d"):
        held = F.coalesce(F.col(c), F.lit(0.0))
        out += [F.col(c).isNull().cast("int").alias(f"{c}_missing"), held.alias(c), F.log1p(F.greatest(held, F.lit(0.0))).alias(f"log_{c}")]
    out += [F.coalesce(F.col(c), F.lit(MISSING)).alias(f"cat_{c}") for c in categories]
    return df.select(*out)


def coarse_features(df: DataFrame, categories: list[str]) -> DataFrame:
    """Candidate features of the coarse ranker: four numbers (NaN and infinities 0) and hashed categories in [0, 1)."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    numbers = [finite(F.col(c).cast("double")).alias(c) for c in ("rrf_score", "source_count", "product_price", "clicks_last_7d")]
    hashed = [(stable_hash(F.coalesce(F.col(c), F.lit(MISSING))) % 1_000_003 / 1_000_003).alias(f"hash_{c}") for c in categories]
    return df.select("user_id", "candidate_ad_id", *numbers, *hashed)


def fine_features(df: DataFrame, buckets: dict[str, int] | None = None, seed: int = 2026) -> DataFrame:
    """Encoded rows of the fine ranker: bounded dense features, hashed sparse ones, value mask and log target. Columns
    that df lacks count as 0; so a missing rank gives an inverse rank of 1."""
    buckets = FINE_BUCKETS if buckets is None else buckets
    number = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(0.0)
    bounded = lambda c: F.coalesce(clip(F.nanvl(c, F.lit(0.0)), -10.0, 10.0), F.lit(0.0))
    ts = number("click_timestamp")
    flag = lambda c: (number(c).isNull() | F.isnan(number(c))).cast("double")
    dense = {
        "rrf_score": signed_log(number("rrf_score")),
        "coarse_score": signed_log(number("coarse_score")),
        "source_count": positive_log(number("source_count")),
        "inverse_coarse_rank": bounded(clip(1 / F.greatest(number("rank"), F.lit(1.0)), 0.0, 1.0)),
        "product_price": positive_log(number("product_price")) / 5,
        "log_product_price": positive_log(number("product_price")),
        "clicks_last_7d": positive_log(number("clicks_last_7d")) / 5,
        "log_clicks_last_7d": positive_log(number("clicks_last_7d")),
        "click_hour_utc": bounded(hour_utc(ts) / 23),
        "click_day_of_week_utc": bounded(weekday_thursday0(ts) / 6),
        "product_price_missing": flag("product_price"),
        "clicks_last_7d_missing": flag("clicks_last_7d"),
        "timestamp_missing": flag("click_timestamp"),
    }
    sparse = {}
    for i, (c, n) in enumerate(buckets.items()):
        text = F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
        sparse[c] = stable_hash(F.lit(seed + i), F.coalesce(F.when(text != "", text), F.lit(MISSING))) % n
    value, label = number("conversion_value_eur"), number("conversion_label")
    mask = F.coalesce((label == 1) & value.isNotNull() & ~F.isnan(value) & (value < float("inf")) & (value >= 0), F.lit(False))
    return df.select(
        *(c for c in ("event_id", "user_id", "candidate_ad_id", "product_id") if c in df.columns),
        *(v.alias(f"dense__{c}") for c, v in dense.items()),
        *(v.alias(f"sparse__{c}") for c, v in sparse.items()),
        label.cast("int").alias("conversion_label"),
        mask.cast("int").alias("value_mask"),
        F.when(mask, F.log1p(value)).alias("log_conversion_value"),
    )


def esmm_features(df: DataFrame, fit_on: DataFrame, categories: dict[str, int], number: str) -> DataFrame:
    """Encoded impressions: hashed categories, the standardised log1p of a number that is not negative (0 where it is missing or
    negative) with a flag for that, and the labels; click_and_conversion must be the product of click and conversion."""
    valid = F.coalesce(F.col(number) >= 0, F.lit(False))
    log = F.when(valid, F.log1p(F.col(number).cast("double")))
    moments = F.broadcast(fit_on.agg(F.avg(log).alias("_m"), F.greatest(F.stddev_pop(log), F.lit(1e-6)).alias("_s")))  # one row
    both = F.col("click") * F.col("conversion")
    checked = F.when(F.col("click_and_conversion") == both, both).otherwise(F.raise_error(F.lit("click_and_conversion must be click and conversion")).cast("int"))
    hashed = [(stable_hash(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))) % n).alias(f"sparse__{c}") for c, n in categories.items()]
    scaled = F.coalesce((log - F.col("_m")) / F.col("_s"), F.lit(0.0))
    return df.crossJoin(moments).select("event_id", *hashed, scaled.alias(f"dense__{number}"), (~valid).cast("int").alias(f"dense__{number}_missing"), "click", "conversion", checked.alias("click_and_conversion"))


def z_scores(df: DataFrame, fit_on: DataFrame, columns: list[str]) -> DataFrame:
    """Columns z_<c>, standardised by population moments of fit_on with a deviation of at least 1e-6."""
    moments = fit_on.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scored = df.crossJoin(F.broadcast(moments))  # one row
    scored = scored.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-6)) for c in columns})
    return scored.drop(*moments.columns)


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values in order from 2 on; 0 pads, 1 is unknown."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return numbered(values, [F.col("value")], "_at").select("value", (F.col("_at") + 2).cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with code_<column>; unknown and missing values are 1."""
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(named, F.col(column) == F.col("_value"), "left").withColumn(f"code_{column}", F.coalesce("_code", F.lit(1))).drop("_value", "_code")


def sanitised_price(c: Column) -> tuple[Column, Column]:
    """(log1p of the price with NaN, infinities and negatives as 0, whether the price was a finite number)."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.log1p(F.when(finite & (c >= 0), c).otherwise(0.0)), F.coalesce(finite, F.lit(False)).cast("int")


def price_issues(df: DataFrame, column: str = "product_price") -> DataFrame:
    """Counts of each kind of unusable price."""
    c = F.col(column).cast("double")
    return df.agg(
        F.count_if(F.isnan(c)).alias("nan"),
        F.count_if(c == float("inf")).alias("positive_infinity"),
        F.count_if(c == float("-inf")).alias("negative_infinity"),
        F.count_if((c < 0) & (c != float("-inf"))).alias("negative"),
    )


def value_transform(df: DataFrame, clip_at: float = 20.0) -> DataFrame:
    """Moments of the masked log value and the largest log value that predictions may have."""
    log = F.col("log_conversion_value")
    moments = df.where(F.col("value_mask") == 1).agg(F.count(log).alias("n"), F.avg(log).alias("mean"), F.stddev_pop(log).alias("std"), F.max(log).alias("max_log"))
    return moments.withColumn("prediction_log_max", F.least(F.lit(clip_at), F.greatest(F.lit(0.0), F.col("max_log") + 3 * F.col("std"))))


def decoded_value(log_value: Column, low: Column | float, high: Column | float) -> Column:
    """A predicted value from its log, held between bounds before the exponential."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.expm1(F.greatest(bound(low), F.least(bound(high), log_value)))
