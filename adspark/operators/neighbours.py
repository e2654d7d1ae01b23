"""Sums over what neighbours hold: each asked row of weighted items meets the rows that share an item with it.

sum over i of w(u, i) * similarity(i, c), where similarities are cosines over rows v, is the sum over v of
K(u, v) * a(v, c) with K(u, v) = sum over i of w(u, i) * a(v, i) and a = weight / norm of the item. So similarities need not
be formed: asked rows are dealt into blocks by the work they make, a block gets only the rows that share an item with it, each
once, and its task adds up in numpy. What is shuffled grows with rows and the blocks that need them, not with pairs of items, so
there are at most BLOCKS of them; rows go packed, a batch's rows for a block as compressed bytes, in no order that must be sorted.
A block's task holds its rows (12 bytes an entry, half as much again in pieces) and takes its asked rows in runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from adspark.operators.ordering import numbered, running
from adspark.sources.staging import staged

#: Blocks at most (the blocks that need a row are the bits of one long), and pairs of an asked row and an entry that shares its
#: item that are worth a block.
BLOCKS, LEAST_PAIRS = 48, 1 << 19
#: Entries of a piece of a row, at most, and entries of rows that meet a run at once.
PIECE, MEET = 16, 1 << 20


def packed(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, entries, rows) of pairs (user_id, product_id, weight): product_id with its number `i` in id order, norm and
    count; (user_id, i, weight, n); and user_id with row, all its i and their weights x, and the work that asking for it
    makes. Items and rows are written once, entries are read from the rows."""
    items = pairs.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.count("user_id").alias("n"))
    items = staged(numbered(items, [F.col("product_id")], "i").withColumn("i", F.col("i").cast("int")), "items")
    entries = pairs.where(F.col("user_id").isNotNull()).join(items.select("product_id", "i", "n"), "product_id")
    rows = staged(entries.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "weight", "n"))).alias("entries"), F.sum("n").alias("load")), "rows")
    row = F.struct(F.col("entries.i").alias("i"), F.col("entries.weight").alias("x"))
    return items, rows.select("user_id", F.inline("entries")), rows.select("user_id", row.alias("row"), "load")


def dealt(asked: DataFrame, key: str, order: list[Column], most_pairs: int, most_rows: int) -> tuple[DataFrame, int]:
    """(asked with its block, number of blocks): runs of asked rows (key, row, load) along an order, cut by load, BLOCKS at most.
    Runs of ids keep rows together that were given out together, so that fewer blocks need a row. Keys and loads alone are put
    in order."""
    loads = staged(asked.select(key, "load"), "loads")
    total, many = loads.agg(F.sum("load"), F.count(F.lit(1))).first()
    blocks = max(1, min(BLOCKS, max((total or 0) // min(LEAST_PAIRS, most_pairs), many // most_rows)))
    size = (total or 0) // blocks + 1
    out = running(loads, order, {"_upto": "load"})
    out = staged(out.select(key, F.least(((F.col("_upto") - F.col("load")) / size).cast("int"), F.lit(blocks - 1)).alias("block")), "blocks")
    return asked.select(key, "row").join(out, key), blocks


class _Block:
    """The asked rows of one block, and the rows that meet them."""

    def __init__(self) -> None:
        self.names, self.sizes, self.asked_items, self.asked_weights = [], [], [], []
        self.lengths, self.items, self.values = [], [], []

    def ask(self, names: list, lengths: np.ndarray, items: np.ndarray, weights: np.ndarray) -> None:
        self.names += names
        self.sizes.append(lengths)
        self.asked_items.append(items)
        self.asked_weights.append(weights)

    def need(self, lengths: np.ndarray, items: np.ndarray, values: np.ndarray) -> None:
        self.lengths.append(lengths)
        self.items.append(items)
        self.values.append(values)

    def sums(self, at_once: int, keep: tuple[int, float] | None = None, most_pairs: int = 1 << 22, most_rows: int = 1 << 16, norms: np.ndarray | None = None) -> Iterator[tuple]:
        """(first asked row, end, ids, row, column, sum) of runs of asked rows: the sums that are not 0, by row and column, of
        items other than the row's own; a column stands for the item ids[column]. keep is (k, margin) where sums that are less
        than a row's k-th largest by more than the margin may be passed over. Values are divided by their item's norm, if given."""
        if not self.names or not sum(map(len, self.items)):
            return
        lengths, items, values = (np.concatenate(x) for x in (self.lengths, self.items, self.values))
        self.lengths, self.items, self.values = [lengths], [items], [values]
        if norms is not None:
            values = values / norms[items]
        sizes, own, weights = (np.concatenate(x) for x in (self.sizes, self.asked_items, self.asked_weights))
        there = np.zeros(max(items.max(), own.max(initial=0)) + 1, bool)
        there[items] = True
        ids, place = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - 1
        column, width = place[items], len(ids)
        of = np.repeat(np.arange(len(sizes)), sizes)[there[own]]  # asked items that no row has meet nothing
        weights, own = weights[there[own]], place[own[there[own]]]
        del items, there, place
        first, many, columns, parts = _pieces(lengths, column, values, width)
        own_of = np.searchsorted(of, np.arange(len(sizes) + 1))
        upto = np.concatenate([[0], np.cumsum(np.bincount(of, np.bincount(column, minlength=width)[own], len(sizes)))])
        a = 0
        while a < len(sizes):
            b = min(max(a + 1, int(np.searchsorted(upto, upto[a] + most_pairs, "right")) - 1), a + most_rows)
            mine = slice(own_of[a], own_of[b])
            asked, near, k = _pairs(of[mine] - a, own[mine], weights[mine], lengths, column, values, width)
            for u, to, row, cell, total in _added(b - a, asked, near, k, first, many, columns, parts, own[mine], of[mine] - a, width, at_once, keep):
                yield a + u, a + to, ids, row, cell, total
            a = b


def _pairs(of: np.ndarray, own: np.ndarray, weights: np.ndarray, lengths: np.ndarray, column: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(asked, row, K) of every pair of an asked row and a row that shares an item, in that order."""
    by = np.argsort(own, kind="stable")
    of, weights = of[by], weights[by]
    count = np.bincount(own, minlength=width)
    low, upto = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(lengths)])
    pairs, found, at = [np.zeros(0, np.int64)], [np.zeros(0)], 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + MEET, "right")) - 1)
        part = slice(upto[at], upto[to])
        hit = np.flatnonzero(count[column[part]])
        n = count[column[part][hit]]
        each = np.repeat(low[column[part][hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(at, to), lengths[at:to])[hit], n)
        pairs.append(of[each] * len(lengths) + row)
        found.append(weights[each] * np.repeat(values[part][hit], n))
        at = to
    pair, k = np.concatenate(pairs), np.concatenate(found)
    pair, k = _merged(pair, k)
    return pair // len(lengths), pair % len(lengths), k


def _merged(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, sums of their values)."""
    if not len(key):
        return key, value
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(value[by], first)


def _added(count: int, asked: np.ndarray, near: np.ndarray, k: np.ndarray, first: np.ndarray, many: np.ndarray, columns: np.ndarray, values: np.ndarray, own: np.ndarray, of: np.ndarray, width: int, at_once: int, keep: tuple[int, float] | None) -> Iterator[tuple]:
    """(first asked row, end, row, column, sum) of short runs of a run's asked rows."""
    stride = width + 1
    met_of, own_of = np.searchsorted(asked, np.arange(count + 1)), np.searchsorted(of, np.arange(count + 1))
    upto = np.concatenate([[0], np.cumsum(many[near])])[met_of] * columns.shape[1]
    u = 0
    while u < count:
        to = max(u + 1, int(np.searchsorted(upto, upto[u] + at_once, "right")) - 1)
        if upto[to] - upto[u] >= (to - u) * stride:
            to = max(u + 1, min(to, u + at_once // stride))
        to = min(to, count, u + (1 << 31) // stride - 1) if stride < 1 << 30 else u + 1
        met = slice(met_of[u], met_of[to])
        n = many[near[met]]
        each = np.repeat(first[near[met]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = columns.take(each, 0, mode="clip")
        cell += np.repeat(((asked[met] - u) * stride).astype(np.int32), n)[:, None]
        part = values.take(each, 0, mode="clip")
        part *= np.repeat(k[met], n)[:, None]
        cell, part = cell.ravel(), part.ravel()
        known = ((of[own_of[u] : own_of[to]] - u) * stride + own[own_of[u] : own_of[to]]).astype(np.int64)
        if len(cell) < (to - u) * stride:  # few cells are met: they are sorted, not laid out
            cells, sums = _merged(cell, part)
            if len(cells):
                out = np.concatenate([known, np.arange(width, (to - u) * stride, stride)]).astype(cells.dtype)
                at = np.minimum(np.searchsorted(cells, out), len(cells) - 1)
                sums[at[cells[at] == out]] = 0
            there = np.flatnonzero(sums)
            cells, sums = cells[there], sums[there]
        else:
            sums = np.bincount(cell, weights=part, minlength=(to - u) * stride)
            sums[known] = 0
            sums[width::stride] = 0
            cells = np.flatnonzero(sums if keep is None else _large(sums.reshape(to - u, stride), *keep))
            sums = sums[cells]
        row = cells // stride
        yield u, to, row, cells - row * stride, sums
        u = to


def _pieces(lengths: np.ndarray, column: np.ndarray, values: np.ndarray, spare: int) -> tuple[np.ndarray, ...]:
    """(first piece, number of pieces) of each row and (columns, values) of all pieces: rows are cut into pieces of one length,
    so that whole pieces are copied and added; what a row's last piece lacks is 0 in a spare column."""
    size = int(np.clip(lengths.mean() / 4, 1, PIECE))
    many = -(-lengths // size)
    first = np.cumsum(many) - many
    at = np.repeat(first * size - np.cumsum(lengths) + lengths, lengths) + np.arange(len(column))
    columns, numbers = np.full(many.sum() * size, spare, np.int32), np.zeros(many.sum() * size)
    columns[at], numbers[at] = column, values
    return first, many, columns.reshape(-1, size), numbers.reshape(-1, size)


def _large(sums: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Which sums are not 0 and at most the margin below their row's k-th largest."""
    if k >= sums.shape[1]:
        return sums != 0
    least = np.partition(sums, -k, axis=1)[:, -k]
    return (sums >= np.where(least > 0, least - margin, -np.inf)[:, None]) & (sums != 0)


def needed(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, blocks): the rows that share an item with some block's asked rows, and these blocks as bits of a long."""
    wanted = asked.select(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block")).alias("blocks"), F.explode("row.i").alias("i")).groupBy("i").agg(F.bit_or("blocks").alias("blocks"))
    return entries.select("user_id", "i").join(wanted, "i").groupBy("user_id").agg(F.bit_or("blocks").alias("blocks"))


# Numbers on their way to a block.


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first, as neighbouring numbers differ in some bytes only."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, many: int, kind: type) -> np.ndarray:
    if not many:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, many * size, codec="zstd", asbytes=True), np.uint8).reshape(size, many)
    return np.ascontiguousarray(planes.T).view(kind).reshape(many)


def _steps(items: np.ndarray) -> np.ndarray:
    return np.diff(items, prepend=items.dtype.type(0))


SENT = "block int, kind int, many int, entries int, lengths binary, items binary, numbers binary"
ASKED, ROWS, NORMS = 0, 1, 2


def _sent(block: int, kind: int, lengths: np.ndarray, items: np.ndarray, numbers: np.ndarray) -> tuple:
    return int(block), kind, len(lengths), len(items), _bytes(lengths.astype(np.int32)), _bytes(_steps(items.astype(np.int32))), _bytes(numbers.astype(np.float64))


def _batch(rows: list[tuple], names: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True), names] if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def met(asked: DataFrame, key: str, blocks: int, entries: DataFrame, rows: DataFrame, items: DataFrame, reduce: Callable, schema: str, at_once: int = 1 << 17, keep: tuple[int, float] | None = None, most_pairs: int = 1 << 22, most_rows: int = 1 << 16, lists: bool = False) -> DataFrame:
    """What `reduce` makes of the sums of each run of asked rows (_Block.sums), as columns: the first is the row's place in
    the run and becomes `key`. Runs are short, so that what is added up stays in a core's cache. lists: one row for each asked
    row that has sums, with the other columns as arrays."""
    kind = asked.schema[key].dataType
    names_type, columns_out = to_arrow_type(kind), StructType.fromDDL(schema)
    names_out = columns_out.fieldNames()
    sent = f"{SENT}, names array<{kind.simpleString()}>"
    packed_schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(sent)])

    def send(as_: int) -> Callable:
        """Pack a batch's rows (blocks as bits, name, items, numbers) for each block."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits, flat, numbers = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                lengths, out, named = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [], []
                begin = np.cumsum(lengths) - lengths
                for b in range(blocks):
                    mine = np.flatnonzero(bits >> b & 1)
                    if len(mine):
                        n = lengths[mine]
                        each = np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        out.append(_sent(b, as_, n, flat[each], numbers[each]))
                        named.append(batch.column(1).take(pa.array(mine)).to_pylist() if as_ == ASKED else None)
                yield _batch(out, named, packed_schema)

        return pack

    def send_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = _sent(0, NORMS, np.zeros(0), batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield _batch([(b, *one[1:]) for b in range(blocks)], [None] * blocks, packed_schema)

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block"))
    asks = asked.select(bit.alias("blocks"), F.col(key).alias("name"), "row.i", "row.x").mapInArrow(send(ASKED), sent)
    mine = needed(asked, entries).join(rows.select("user_id", "row"), "user_id")
    needs = mine.select("blocks", F.lit(None).cast(kind).alias("name"), "row.i", "row.x").mapInArrow(send(ROWS), sent)
    parts = asks.unionByName(needs).unionByName(items.select("i", "norm").mapInArrow(send_norms, sent)).repartitionById(blocks, "block")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Block, list]] = {}
        for batch in batches:
            for i, r in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)):
                block, norms = held.setdefault(r[0], (_Block(), []))
                lengths = _numbers(r[4], r[2], np.int32).astype(np.int64)
                found = np.cumsum(_numbers(r[5], r[3], np.int32), dtype=np.int32)
                numbers = _numbers(r[6], r[3], np.float64)
                if r[1] == NORMS:
                    norms.append((found, numbers))
                elif r[1] == ASKED:
                    block.ask(batch.column(7)[i].as_py(), lengths, found, numbers)
                else:
                    block.need(lengths, found, numbers)
        while held:
            block, norms = held.popitem()[1]
            norm = np.ones(max((int(i.max(initial=0)) for i, _ in norms), default=0) + 1)
            for i, x in norms:
                norm[i] = x
            for u, _, ids, row, column, sums in block.sums(at_once, keep, most_pairs, most_rows, norm):
                place, *columns = reduce(ids, row, column, sums)
                if not len(place):
                    continue
                arrays = [pa.array(c) for c in columns]
                if lists:
                    first = np.flatnonzero(np.diff(place, prepend=-1))
                    offsets = pa.array(np.append(first, len(place)).astype(np.int32))
                    place, arrays = place[first], [pa.ListArray.from_arrays(offsets, c) for c in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([block.names[x] for x in place + u], names_type), *arrays], names=names_out)

    out = StructType([columns_out[0], *(StructField(f.name, ArrayType(f.dataType)) for f in columns_out[1:])]) if lists else columns_out
    return parts.mapInArrow(add, out)


def best(k: int, digits: int) -> Callable:
    """A reduce that keeps the k largest rounded sums of each row, ties by item: (place, item, sum, rank)."""

    def reduce(_ids: np.ndarray, row: np.ndarray, column: np.ndarray, sums: np.ndarray) -> tuple:
        first = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else np.zeros(1, int)
        keep = np.ones(len(row), bool)
        margin = 2.0 * 10.0**-digits
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a > k:  # rounding moves a sum by less than the margin
                part = sums[a:b]
                keep[a:b] = part >= np.partition(part, b - a - k)[b - a - k] - margin
        row, column, sums = row[keep], column[keep], np.round(sums[keep], digits)
        row, column, sums = row[sums != 0], column[sums != 0], sums[sums != 0]
        by = np.lexsort((column, -sums, row))
        row, column, sums = row[by], column[by], sums[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        keep = rank <= k
        return row[keep], _ids[column[keep]].astype(np.int32), sums[keep], rank[keep].astype(np.int32)

    return reduce


def totals(_ids: np.ndarray, row: np.ndarray, _column: np.ndarray, sums: np.ndarray) -> tuple:
    """A reduce that counts and adds up each row: (place, count, largest, sum)."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(first):
        return row, row, sums, sums
    return row[first], np.diff(first, append=len(row)), np.maximum.reduceat(sums, first), np.add.reduceat(sums, first)
