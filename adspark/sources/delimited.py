"""Delimited scans and table sinks under explicit contracts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adspark.functions.expressions import mask_tokens


@dataclass(frozen=True)
class Contract:
    """A delimited dataset: its columns in order, label, and tokens that stand for missing values."""

    columns: tuple[str, ...]
    separator: str = "\t"
    header: bool = False
    label: str | None = None
    missing: tuple[str, ...] = ("", "-1")
    missing_by_column: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(set(self.columns)) != len(self.columns):
            raise ValueError("column names must be unique")
        if self.label is not None and self.label not in self.columns:
            raise ValueError(f"label {self.label!r} is not a declared column")
        if unknown := set(self.missing_by_column) - set(self.columns):
            raise ValueError(f"tokens for undeclared columns: {sorted(unknown)}")

    def tokens(self, column: str) -> tuple[str, ...]:
        return (*self.missing, *self.missing_by_column.get(column, ()))


def scan(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """All columns as text; empty fields are empty texts, and a malformed line is an error. A header must match."""
    schema = StructType([StructField(c, StringType()) for c in contract.columns])
    if contract.header:
        first = spark.read.text(path).first()
        if first is None or tuple(first[0].split(contract.separator)) != contract.columns:
            raise ValueError("the file's header differs from the contract")
    reader = spark.read.schema(schema).option("sep", contract.separator).option("header", contract.header).option("mode", "FAILFAST")
    return reader.option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def masked(df: DataFrame, contract: Contract) -> DataFrame:
    """df with missing-value tokens as nulls."""
    return df.select(*(mask_tokens(c, contract.tokens(c)).alias(c) for c in contract.columns))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Write Parquet; a table that exists is an error unless overwrite is set, and columns must match in
    name and order if given."""
    if columns is not None and df.columns != columns:
        raise ValueError(f"expected columns {columns}, got {df.columns}")
    writer = df.select(*(columns or df.columns)).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_leading(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a total order."""
    return df.orderBy(order).limit(n)


def restricted(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of a cohort's users, blank ids left out."""
    return df.where(F.trim(key) != "").join(users.select(key).distinct(), key, "left_semi")


def before_cutoff(df: DataFrame, path: str, as_of: int, cutoff: int, timestamp: str = "event_timestamp") -> DataFrame:
    """A catalogue scan as of the split: paths of later windows and later snapshots are refused."""
    if "future" in path.lower():
        raise ValueError(f"a catalogue must not come from a future window: {path}")
    if as_of > cutoff:
        raise ValueError("the catalogue's as-of time is after the split")
    return df.where(F.col(timestamp) <= cutoff)


#: Rows of a report. A larger table is an error, never cut: it is no report, and write_table is for it.
REPORTED = 10_000


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORTED + 1).collect()
    if len(rows) > REPORTED:
        raise ValueError(f"more than {REPORTED} rows for a report")
    return rows


def report(df: DataFrame) -> str:
    """A table of results, of REPORTED rows at most, as JSON."""
    rows: list[dict[str, Any]] = [r.asDict(recursive=True) for r in _small(df)]
    return json.dumps(rows, indent=2, sort_keys=True, default=str)


def markdown(df: DataFrame) -> str:
    """A table of results, of REPORTED rows at most, as Markdown."""
    rows = _small(df)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in rows])
