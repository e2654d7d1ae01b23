"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: ASCII space and the five control characters 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local folder that goes with the process will do for a
    local master; on a cluster, whose executors see different disks, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="stages-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the file system handles close."""
    root = f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"
    hadoop, files = _files(spark, root)
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    for made in _recorded.get():
        made.append(path)
    return path


#: Lists of the scopes that are open in this thread or task; each notes the paths made inside it.
_recorded: ContextVar[tuple[list[str], ...]] = ContextVar("recorded", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that new_path gives, and so the tables that stage writes, inside the with block. Scopes nest, and what other
    threads make is not noted, so a caller can delete its own tables and no others."""
    made: list[str] = []
    token = _recorded.set((*_recorded.get(), made))
    try:
        yield made
    finally:
        _recorded.reset(token)


def delete(spark: SparkSession, paths: list[str], but: tuple[str, ...] = ()) -> None:
    """Delete staged tables, but for those whose names begin with one of `but`; what is deleted leaves the list."""
    for path in [p for p in paths if not p.rsplit("/", 1)[1].startswith(but)] if but else list(paths):
        hadoop, files = _files(spark, path)
        files.delete(hadoop, True)
        paths.remove(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table: lost executors then cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column | str) -> Column:
    """The words of a text as an array; an empty array for null and for texts without a word."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """Number of words as a long; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    blank = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank - last).cast("long")


def running_offset(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str, kind: str = "long") -> DataFrame:
    """Exclusive running sum of value within each group, along bucket and then order, as column out.

    Two levels: sums per (group, bucket) give each bucket's start, and only rows of one bucket are ordered together, so
    a group with a third of all rows is spread over all its buckets. The first window sees one row a bucket."""
    key = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(F.sum(value).alias("_sum")).select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    renamed = starts.select(*(F.col(k).alias(f"_{k}") for k in key), "_start")
    joined = df.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left").drop(*(f"_{k}" for k in key))
    return joined.withColumn(out, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast(kind)).drop("_start")


# Words and hashes of them in numpy, for tasks that read Arrow batches.

_U = np.uint64
#: Spans of at most so many bytes are hashed eight bytes at a time, all together.
SHORT = 64
#: By length, the bits of a chunk of eight bytes that belong to a span that ends in it.
_WITHIN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are looked at together; texts are cut there between words, so long texts need no more memory.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: equal spans have equal hashes wherever they stand. Each chunk of eight bytes is mixed
    into what the chunks before it gave; a span longer than SHORT takes xxHash of its bytes."""
    size = end - start
    value = size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    chunks = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    todo = np.flatnonzero(size <= SHORT)
    at = 0
    while len(todo):
        left = size[todo] - at
        todo, left = (todo, left) if at == 0 else (todo[left > 0], left[left > 0])
        held = chunks[np.minimum(start[todo] + at, max(len(data) - 1, 0))] & _WITHIN[np.clip(left, 0, 8)] if len(data) else np.zeros(len(todo), np.uint64)
        value[todo] = mix(value[todo] ^ held)
        at += 8
    for i in np.flatnonzero(size > SHORT).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return value


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes between words where punctuation parts them too.
IS_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes of UTF-8; apart says which bytes stand between words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~apart[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed_words(texts: list[bytes | None], apart: np.ndarray = _IS_SPACE, also: Callable | None = None) -> tuple:
    """(hash of each word with A-Z lowered, words of each text) over all texts, in order. also is called with bytes, starts
    and ends of words, and what it returns for each word is put together as a third value."""
    out, counts, more = [], np.zeros(len(texts), np.int64), []
    held: list[bytes] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            data = _LOWER[np.frombuffer(b"\n".join(held), np.uint8)]
            start, end = word_spans(data, apart)
            out.append(span_hash(data, start, end))
            if also:
                more.append(also(data, start, end))
            ends = np.cumsum([len(h) + 1 for h in held])
            np.add.at(counts, which, np.diff(np.searchsorted(start, np.concatenate([[0], ends]))))
            held.clear()
            which.clear()
            size = 0

    for i, text in enumerate(texts):
        for piece in pieces(text or b""):
            held.append(piece)
            which.append(i)
            size += len(piece) + 1
            if size >= PIECE:
                flush()
    flush()
    found = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return (found, counts, np.concatenate(more) if more else np.zeros(0, np.int64)) if also else (found, counts)


def pieces(text: bytes, most: int | None = None) -> list[bytes]:
    """The text cut between words into pieces of about the given size, PIECE by default; a longer word stays whole."""
    most = PIECE if most is None else most
    cut, at = [], 0
    while len(text) - at > most:
        near = np.flatnonzero(_IS_SPACE[np.frombuffer(text, np.uint8, most, at)])
        if len(near):
            to = at + int(near[-1]) + 1
        else:
            rest = np.flatnonzero(_IS_SPACE[np.frombuffer(text, np.uint8, len(text) - at, at)])
            to = at + int(rest[0]) + 1 if len(rest) else len(text)
        cut.append(text[at:to])
        at = to
    return [*cut, text[at:]] if at < len(text) or not cut else cut
