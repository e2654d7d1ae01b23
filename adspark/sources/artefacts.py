"""Frozen artefacts: learned parameters with what they were learned from, and datasets that are built once.

An artefact is a folder with a Parquet table of its matrices' rows and a manifest, which is written last: a folder without one
is not an artefact. The manifest has a hash of the parameters, and whatever a reader must find unchanged (inputs, seed, format).
All files are reached through Hadoop's file systems, so a folder may be wherever Spark can write."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def _at(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _at(spark, path)
    return bool(files.exists(hadoop))


def _write_json(spark: SparkSession, path: str, payload: dict) -> None:
    spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def content_hash(parameters: dict[str, np.ndarray]) -> str:
    """SHA-256 of the matrices by name, with their shapes."""
    digest = hashlib.sha256()
    for name in sorted(parameters):
        matrix = np.ascontiguousarray(parameters[name], dtype="<f8")
        digest.update(json.dumps([name, matrix.shape]).encode())
        digest.update(matrix.tobytes())
    return digest.hexdigest()


def save_parameters(spark: SparkSession, path: str, parameters: dict[str, np.ndarray], meta: dict[str, Any], overwrite: bool = False) -> str:
    """Write an artefact and return its content hash. One that exists is an error unless overwrite is set."""
    if exists(spark, path):
        if not overwrite:
            raise FileExistsError(f"an artefact exists at {path}")
        hadoop, files = _at(spark, path)
        files.delete(hadoop, True)
    rows = [(n, i, [float(x) for x in r]) for n, m in parameters.items() for i, r in enumerate(m)]
    spark.createDataFrame(rows, "name string, row long, v array<double>").write.parquet(f"{path}/parameters")
    found = content_hash(parameters)
    shapes = {n: list(m.shape) for n, m in parameters.items()}
    _write_json(spark, f"{path}/manifest", {"format": FORMAT, "sha256": found, "shapes": shapes, "meta": meta})
    return found


def load_parameters(spark: SparkSession, path: str, expected: dict[str, Any] | None = None, sha256: str | None = None) -> tuple[dict[str, np.ndarray], dict[str, Any]]:
    """(parameters, meta) of an artefact. It is refused if its content is not what its manifest says, if `expected` names other
    values than its meta has, or if it is not the one of the given hash."""
    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no complete artefact at {path}")
    manifest = _read_json(spark, f"{path}/manifest")
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']} instead of {FORMAT}")
    other = {k: (v, manifest["meta"].get(k)) for k, v in json.loads(json.dumps(expected or {})).items() if manifest["meta"].get(k) != v}
    if other:
        raise ValueError(f"the artefact was made for other inputs (expected, found): {other}")
    parameters = {n: np.zeros(shape) for n, shape in manifest["shapes"].items()}
    many = 0
    for r in spark.read.parquet(f"{path}/parameters").toLocalIterator():
        parameters[r["name"]][r["row"]] = r["v"]
        many += 1
    if many != sum(len(m) for m in parameters.values()) or content_hash(parameters) != manifest["sha256"] or sha256 not in (None, manifest["sha256"]):
        raise ValueError("the artefact's content differs from its fingerprint")
    return parameters, manifest["meta"]


def rows_fingerprint(df: DataFrame) -> str:
    """A hash of all rows in any order: their count and two sums of row hashes."""
    parts = [F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in df.columns)), F.lit(1 << 31)) for seed in (1, 2)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts))).first()
    return hashlib.sha256(json.dumps([df.dtypes, *map(str, r)]).encode()).hexdigest()


def source_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of all files of the sources, which reads none of them."""
    found = []
    for path in paths:
        hadoop, files = _at(spark, path)
        listed = files.listFiles(hadoop, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def build_or_reuse(spark: SparkSession, root: str, sources: list[str], settings: dict[str, Any], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(dataset, whether it was there): a dataset under a key of its sources' files and its settings. One that is built is
    published by a rename, complete with its manifest; one that is there is read without a look into the sources."""
    key = hashlib.sha256(json.dumps([FORMAT, source_fingerprint(spark, sources), settings], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/{key}"
    if exists(spark, f"{path}/manifest"):
        return spark.read.parquet(f"{path}/rows"), True
    being = f"{root.rstrip('/')}/.building-{uuid.uuid4().hex}"
    build().write.parquet(f"{being}/rows")
    rows = spark.read.parquet(f"{being}/rows")
    _write_json(spark, f"{being}/manifest", {"format": FORMAT, "settings": settings, "rows": rows.count(), "columns": rows.columns})
    source, files = _at(spark, being)
    target, _ = _at(spark, path)
    # Whoever comes first publishes; a rename onto a published dataset would land inside it, so it is looked for before.
    if exists(spark, f"{path}/manifest") or not files.rename(source, target):
        files.delete(source, True)
    return spark.read.parquet(f"{path}/rows"), False


def write_windows(df: DataFrame, path: str, names: list[str], window: str = "window") -> dict[str, int]:
    """Write each row to the folder of its window, in one pass, and return the windows' rows. A row of no window or of an unknown
    one is an error, as is a total that differs from what was read; in either case nothing is published."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"windows exist at {path}")
    seen, being = Observation(), f"{path.rstrip('/')}-building-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(window).parquet(being)
    source, files = _at(spark, being)
    try:
        schema = df.select(*(c for c in df.columns if c != window), window).schema
        found = {r[window]: r["count"] for r in spark.read.schema(schema).parquet(being).groupBy(window).count().collect()}
        if odd := sorted(str(w) for w in found if w not in names):
            raise ValueError(f"rows outside the windows {names}: {odd}")
        if sum(found.values()) != seen.get["rows"]:
            raise ValueError(f"{sum(found.values())} rows written of {seen.get['rows']}")
        if not files.rename(source, _at(spark, path)[0]):
            raise FileExistsError(f"windows exist at {path}")
    finally:
        files.delete(source, True)
    return {n: found.get(n, 0) for n in names}
