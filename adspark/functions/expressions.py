"""Column expressions that the operators share. All but blake_hash stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

MISSING = "__MISSING__"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of a timestamp column with or without a zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)").cast("long")
    return F.floor(F.col(name).cast("double")).cast("long")


def mask_tokens(c: Column | str, tokens: Iterable[str]) -> Column:
    """Null where the text is one of the tokens that stand for a missing value."""
    tokens = list(tokens)
    return F.when(~col(c).isin(*tokens), col(c)) if tokens else col(c)


def normal_id(c: Column | str) -> Column:
    """A trimmed id as text; null where nothing is left."""
    text = F.trim(col(c).cast("string"))
    return F.when(text != "", text)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def positive_log(c: Column | str) -> Column:
    """log1p of the positive part, at most 10; 0 for null and NaN."""
    x = F.nanvl(col(c).cast("double"), F.lit(0.0))
    return F.coalesce(clip(F.log1p(F.greatest(x, F.lit(0.0))), 0.0, 10.0), F.lit(0.0))


def signed_log(c: Column | str) -> Column:
    """sign(x) * log1p(|x|), within 10 of 0; 0 for null and NaN."""
    x = F.nanvl(col(c).cast("double"), F.lit(0.0))
    return F.coalesce(clip(F.signum(x) * F.log1p(F.abs(x)), -10.0, 10.0), F.lit(0.0))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-clip(c, -60.0, 60.0)))


def logit(c: Column | str, epsilon: float = 1e-7) -> Column:
    p = clip(c, epsilon, 1 - epsilon)
    return F.log(p / (1 - p))


def hour_utc(ts: Column | str) -> Column:
    """Hour of day of epoch seconds."""
    return F.floor(F.pmod(col(ts), F.lit(86400)) / 3600).cast("int")


def weekday_monday0(ts: Column | str) -> Column:
    """Day of week of epoch seconds, Monday 0 (1970-01-01 was a Thursday)."""
    return F.pmod(F.floor(col(ts) / 86400) + 3, F.lit(7)).cast("int")


def weekday_thursday0(ts: Column | str) -> Column:
    """Day of week as floor(ts / 86400) mod 7, by which Thursday is 0."""
    return F.pmod(F.floor(col(ts) / 86400), F.lit(7)).cast("int")


def weekday_sunday0(ts: Column | str) -> Column:
    return F.pmod(F.floor(col(ts) / 86400) + 4, F.lit(7)).cast("int")


def stable_hash(*parts: Column) -> Column:
    """60-bit hash of the parts' texts, joined by 0x1F, that other engines with MD5 reproduce."""
    text = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def blake_hash(seed: int | None = None, separator: str = "\x1f"):
    """A vectorised function: first 8 bytes of BLAKE2b of the text (with the seed before it) as a decimal string, as the
    value is unsigned. For artefacts that must agree with hashes made elsewhere; stable_hash is the native one."""

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        codes, kinds = pd.factorize(values.astype("string").fillna(MISSING))
        lead = "" if seed is None else f"{seed}{separator}"
        made = [str(int.from_bytes(hashlib.blake2b(f"{lead}{k}".encode(), digest_size=8).digest(), "big")) for k in kinds]
        return pd.Series(made, dtype="object").take(codes).reset_index(drop=True) if len(values) else values

    return hashed


def label_key(c: Column | str) -> Column:
    """An interaction label as a lookup key: integers without a fraction, other text trimmed and lowered."""
    text = F.lower(F.trim(col(c).cast("string")))
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(text)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's values in column name order; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
