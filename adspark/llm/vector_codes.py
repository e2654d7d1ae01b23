"""Vector code compression: vectors cut into parts, each coded by the nearest entry of its part's codebook.

Components become integers floor(SCALE * x), so distances are exact and runs agree to the last bit. The codebooks are learned
by Hamerly's variant of Lloyd's rounds. For each part of each vector a state is kept: its entry, an upper bound of the distance
to it, and a lower bound of the distance to the second nearest entry. When entries move, the upper bound grows by the way the
part's entry went and the lower one shrinks by the longest way of another entry. While the upper bound is strictly below the
lower one, or below half the way from the entry to its nearest other one, no other entry can be nearer or as near, so the part
keeps its entry unseen. Otherwise the upper bound is made exact, and where it still isn't strictly below, all entries are
compared in integers, of which the lowest index among the nearest wins. Bounds are rounded outwards, so rounding skips nothing.

States are rows: one pass over them assigns, writes the new states and adds up, in each task, sums and counts of its parts by
entry, PARTS * entries rows a task. Sums of these give the next codebooks, which are PARTS * entries integer vectors, whatever
the number of rows; nothing else goes to the driver or is sent to tasks.

Defined cases: a null vector and one with a null, infinite or NaN component are dropped. The length is that of the kept vector
of the smallest id that has a positive multiple of PARTS components; vectors of another length stay, uncoded (null code and
error), and are no entries. With fewer vectors than entries each is an entry. A null id comes last, equal ids by components;
equal entries are told apart by index. Unused entries stay as they are. An empty table gives an empty result and empty
codebooks. Components whose squared distances a long cannot hold are an error. Other columns but the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Integers up to this keep the squared distance of two vectors of up to 2 ** 12 components in a long.
MOST = 1 << 24
#: Integers up to this keep all products' sums exact in doubles, for parts of up to 2 ** 10 components.
EXACT = 1 << 20
#: By so much of their size bounds are rounded outwards.
SLACK = 1e-9
#: Parts whose distances to all entries are held at a time.
AT_ONCE = 4096
#: Labels whose sums may be broadcast.
BROADCAST_LABELS = 10_000


def integers(vector: Column) -> Column:
    """A vector's components as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to entries."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if most <= EXACT and points.shape[1] <= 1 << 10:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        found = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]
        return found.astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], 1)


def to_own(points: np.ndarray, entries: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to its entry."""
    return ((points - entries[own]) ** 2).sum(1)


def spread(entries: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to its nearest other one, rounded down."""
    if len(entries) < 2:
        return np.full(len(entries), np.inf)
    ways = squared(entries, entries).astype(np.float64)
    np.fill_diagonal(ways, np.inf)
    return np.sqrt(ways.min(1)) / 2 * (1 - SLACK)


def moves(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(way of each entry, longest way of the others), rounded up."""
    way = np.sqrt(((after - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
    if len(way) < 2:
        return way, np.zeros(len(way))
    order = np.argsort(way)
    others = np.full(len(way), way[order[-1]])
    others[order[-1]] = way[order[-2]]
    return way, others


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bound, lower bound) of each point, from its distances to all entries."""
    own, upper, lower = np.zeros(len(points), np.int16), np.zeros(len(points)), np.full(len(points), np.inf)
    for at in range(0, len(points), AT_ONCE):
        found = squared(points[at : at + AT_ONCE], entries)
        rows, best = np.arange(len(found)), found.argmin(1)
        own[at : at + AT_ONCE] = best
        upper[at : at + AT_ONCE] = np.sqrt(found[rows, best].astype(np.float64)) * (1 + SLACK)
        if found.shape[1] > 1:
            lower[at : at + AT_ONCE] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK)
    return own, upper, lower


def assign(points: np.ndarray, entries: np.ndarray, before: np.ndarray | None, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper bound, lower bound) of each point after its entries have moved, and how many points saw all entries."""
    if before is None:
        return *scan(points, entries), len(points)
    way, others = moves(before, entries)
    upper = (upper + way[own]) * (1 + SLACK)
    lower = np.where(np.isinf(lower), lower, np.maximum(0, (lower - others[own]) - SLACK * lower))
    half = spread(entries)
    open_ = np.flatnonzero(~(upper < np.maximum(lower, half[own])))
    upper[open_] = np.sqrt(to_own(points[open_], entries, own[open_]).astype(np.float64)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < np.maximum(lower[open_], half[own[open_]]))]
    own = own.copy()
    own[open_], upper[open_], lower[open_] = scan(points[open_], entries)
    return own, upper, lower, len(open_)


def first_books(rows: DataFrame, length: int) -> np.ndarray:
    """(PARTS, entries, components of a part): the vectors of the smallest ids."""
    first = rows.where(F.size("ints") == length).orderBy(F.col("id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints")
    found = np.array([r[0] for r in first.collect()], np.int64).reshape(-1, PARTS, length // PARTS)
    return np.ascontiguousarray(found.transpose(1, 0, 2))


def _points(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, length // PARTS)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * PARTS, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


#: The state of a vector's parts.
STATE = "own array<smallint>, upper array<double>, lower array<double>, scanned int"


def next_states(states: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """States (id, label, ints, own, upper, lower, scanned) after the entries have moved from `before` to `books`."""
    shared = states.sparkSession.sparkContext.broadcast((books, before))
    length = books.shape[0] * books.shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = shared.value
        for batch in batches:
            points = _points(batch, length)
            held = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS) for c in ("own", "upper", "lower")]
            own, upper, lower = np.zeros((len(points), PARTS), np.int16), np.zeros((len(points), PARTS)), np.zeros((len(points), PARTS))
            scanned = np.zeros(PARTS, np.int64)
            for p in range(PARTS):
                own[:, p], upper[:, p], lower[:, p], scanned[p] = assign(points[:, p], now[p], None if then is None else then[p], *(h[:, p] for h in held))
            count = np.zeros(len(points), np.int32)
            count[:1] = scanned.sum()
            values = [batch.column("id"), batch.column("label"), batch.column("ints"), _lists(own), _lists(upper), _lists(lower), pa.array(count)]
            yield pa.RecordBatch.from_arrays(values, names=["id", "label", "ints", "own", "upper", "lower", "scanned"])

    id_kind, label_kind = (states.schema[c].dataType.simpleString() for c in ("id", "label"))
    return states.mapInArrow(step, f"id {id_kind}, label {label_kind}, ints array<long>, {STATE}")


def moved_books(states: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of its parts; unused ones stay."""
    parts, many, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, many, width), np.int64), np.zeros((parts, many), np.int64)
        for batch in batches:
            points = _points(batch, parts * width)
            own = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                found, first = np.unique(own[order, p], return_index=True)
                sums[p, found] += np.add.reduceat(points[order, p], first, axis=0)
                counts[p, found] += np.diff(np.append(first, len(order)))
        p, e = np.nonzero(counts)
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), total], names=["part", "entry", "n", "total"])

    added = states.select("ints", "own").mapInArrow(add, "part long, entry long, n long, total array<long>")
    sums = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)))
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas between them."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def learn(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(codebooks, states, others): states (id, label, ints, own, ...) under the final codebooks of all vectors that can be
    coded, others (id, label) of those of another length."""
    kept = df.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), integers(F.col(vector)).alias("ints"))
    rows = stage(kept, "integers")
    odd = rows.where(F.exists("ints", lambda x: (x > MOST) | (x < -MOST))).limit(1).count()
    if odd:
        raise ValueError(f"components beyond {MOST} / {SCALE} have no exact distances in a long")
    cut = rows.where((F.size("ints") > 0) & (F.size("ints") % PARTS == 0))
    first = cut.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    length = first[0] if first else 0
    others = rows.where(F.size("ints") != length).select("id", "label")
    books = first_books(rows, length) if length else np.zeros((PARTS, 0, 0), np.int64)
    empty = F.array(*(F.lit(0).cast("short") for _ in range(PARTS)))
    zero = F.array(*(F.lit(0.0) for _ in range(PARTS)))
    states = rows.where(F.size("ints") == length).select("id", "label", "ints", empty.alias("own"), zero.alias("upper"), zero.alias("lower"), F.lit(0).alias("scanned"))
    if not length:
        return books, states.where("false"), others
    before = None
    for number in range(ROUNDS + 1):
        states = stage(next_states(states, books, before), f"states{number}")
        if number < ROUNDS:
            books, before = moved_books(states, books), books
    return books, states, others


def codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code, error, label_error and codebooks_sha256 of every usable vector of df."""
    books, states, others = learn(df, key, vector, label)
    shared = df.sparkSession.sparkContext.broadcast(books)
    length = books.shape[0] * books.shape[2]
    id_kind, label_kind = (states.schema[c].dataType.simpleString() for c in ("id", "label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = shared.value
        for batch in batches:
            points = _points(batch, length)
            own = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            error = sum(to_own(points[:, p], final[p], own[:, p]) for p in range(PARTS))
            code = ["".join(f"{x:02x}" for x in r) for r in own.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    coded = states.select("id", "label", "ints", "own").mapInArrow(measure, f"id {id_kind}, label {label_kind}, code string, error long")
    both = coded.unionByName(others.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    found = stage(both, "codes")
    sums = stage(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_sums")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
