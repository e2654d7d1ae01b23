"""Token-ID output: texts as token ids in patched frame-of-reference blocks.

Ids are cut into blocks of BLOCK. A block keeps its minimum and packs the differences at the width that a percentile of
them needs; those that need more are stored in an exception list besides. Starts of blocks are indexed, so any block can
be decoded alone. A segment is the blocks of some consecutive documents with the documents' keys and lengths; segments
are the rows of a Parquet table, which Spark writes and reads wherever its tables can be, and whose files appear only
when whole.

Documents stand in ascending key order, null first, equal keys by a hash of the text: part, then seq, then place in the
segment. Defined cases: null and empty texts are encoded as the end id alone; repeated rows are written again; an empty
table gives no segments; other columns are not read; texts of any length are encoded whole.

Texts are cut where the tokenizer always parts them (around single spaces and line ends between plain characters, and
between a letter and punctuation) and each distinct piece is encoded once by the tokenizers library, as long as the task
remembers it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import PIECE, running_offset, span_hash

BLOCK = 128
#: Blocks of one width that are packed or unpacked together.
TOGETHER = 512
#: Share of a block's differences that fit the packed width.
PERCENTILE = 0.9
#: A segment is closed with the document that reaches so many ids.
SEGMENT = 1 << 18
#: New pieces that are encoded in one call.
JOINED = 4096
#: Pieces whose ids a task remembers, and the bytes that they, their ids and their places may take.
REMEMBERED = 600_000
HELD = 64 << 20

_HEAD = np.dtype([("magic", "S4"), ("n", "<u8"), ("blocks", "<u4"), ("exceptions", "<u4")])
_INDEX = np.dtype([("start", "<u4"), ("least", "<u4"), ("width", "u1"), ("first", "<u4")])
_EXCEPTION = np.dtype([("place", "u1"), ("value", "<u4")])


def _by_width(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, blocks) of blocks that need bits, TOGETHER at most at once."""
    for w in np.flatnonzero(np.bincount(width)).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows) if w else 0, TOGETHER):
            yield w, rows[i : i + TOGETHER]


def _place(slot: int, width: int) -> tuple[int, np.uint64, bool]:
    """Where a block's slot begins: 64-bit word, bit within it, and whether the slot goes on in the next word."""
    word, bit = divmod(slot * width, 64)
    return word, np.uint64(bit), bit + width > 64


def _packed(rest: np.ndarray, width: int) -> np.ndarray:
    """The low bits of blocks of values, as bytes; a slot of all blocks is put in at a time."""
    low = np.ascontiguousarray(rest.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((BLOCK * width // 64, rest.shape[0]), np.uint64)
    for slot in range(BLOCK):
        word, bit, on = _place(slot, width)
        words[word] |= low[slot] << bit
        if on:
            words[word + 1] |= low[slot] >> (np.uint64(64) - bit)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """The blocks of values that _packed gave as bytes."""
    words = np.ascontiguousarray(data.view("<u8").T)
    out = np.empty((BLOCK, data.shape[0]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for slot in range(BLOCK):
        word, bit, on = _place(slot, width)
        value = words[word] >> bit
        if on:
            value |= words[word + 1] << (np.uint64(64) - bit)
        out[slot] = value & mask
    return out.T


def pack(ids: np.ndarray) -> bytes:
    """One segment's ids as bytes: head, block index, exceptions, packed bits."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    held = np.zeros(blocks * BLOCK, np.uint32)
    held[:n] = ids
    held[n:] = ids[-1] if n else 0
    held = held.reshape(blocks, BLOCK)
    least = held.min(axis=1, initial=np.iinfo(np.uint32).max) if blocks else np.zeros(0, np.uint32)
    rest = held - least[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits: values below 2^53 are exact
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(need, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    beyond = need > width[:, None]
    row, place = np.nonzero(beyond)
    exceptions = np.empty(len(row), _EXCEPTION)
    exceptions["place"], exceptions["value"] = place, rest[row, place]
    index = np.empty(blocks, _INDEX)
    size = width.astype(np.int64) * (BLOCK // 8)
    index["start"], index["least"], index["width"] = np.cumsum(size) - size, least, width
    index["first"] = np.cumsum(beyond.sum(axis=1)) - beyond.sum(axis=1)
    packed = np.zeros(int(size.sum()), np.uint8)
    for w, own in _by_width(width):
        to = index["start"][own].astype(np.int64)[:, None] + np.arange(w * (BLOCK // 8))
        packed[to] = _packed(rest[own], w)
    head = np.array([(b"PFOR", n, blocks, len(exceptions))], _HEAD)
    return b"".join(x.tobytes() for x in (head, index, exceptions, packed))


def _parts(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(data, _HEAD, 1)[0]
    at = _HEAD.itemsize
    index = np.frombuffer(data, _INDEX, int(head["blocks"]), at)
    at += index.nbytes
    exceptions = np.frombuffer(data, _EXCEPTION, int(head["exceptions"]), at)
    at += exceptions.nbytes
    return int(head["n"]), index, exceptions, np.frombuffer(data, np.uint8, len(data) - at, at)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1 of a segment, of all of them by default."""
    n, index, exceptions, packed = _parts(data)
    last = len(index) if last is None else min(last, len(index))
    own = index[first:last]
    out = np.zeros((len(own), BLOCK), np.uint32)
    for w, rows in _by_width(own["width"]):
        at = own["start"][rows].astype(np.int64)[:, None] + np.arange(w * (BLOCK // 8))
        out[rows] = _unpacked(packed[at], w)
    ends = np.append(index["first"][1:], len(exceptions)).astype(np.int64)
    count = ends[first:last] - own["first"].astype(np.int64)
    mine = exceptions[int(own["first"][0]) : int(ends[last - 1])] if len(own) else exceptions[:0]
    out[np.repeat(np.arange(len(own)), count), mine["place"]] = mine["value"]
    return (out + own["least"][:, None]).reshape(-1)[: max(0, n - first * BLOCK)]


_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: Bytes of ASCII letters and of U+00C0 to U+00FF, where × and ÷ are no letters.
_LETTERS = _LETTER.copy()
_LETTERS[[0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = True
_MARK = _PLAIN & np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def safe_cuts(data: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Places in UTF-8 bytes at which byte-level tokenizing always begins a new piece: before a single space, and before
    and after a single line end, that stand between characters known to be no white space (ASCII or U+00C0 to U+00FF); and
    before those ASCII punctuation marks that follow an ASCII letter, where a run of letters ends."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    middle = data[1:-1]
    before = _PLAIN[data[:-2]]
    before[1:] |= (data[1:-2] >= 0x80) & (data[:-3] == 0xC3)
    fits = before & (_PLAIN[data[2:]] | (data[2:] == 0xC3))
    line = fits & (middle == 0x0A)
    cut = np.zeros(len(data), bool)
    cut[1:-1] = line | (fits & (middle == 0x20))
    cut[2:] |= line
    if marks is not None:
        cut[1:] |= _LETTER[data[:-1]] & marks[data[1:]]
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of texts; a text's ids are those that encoding it as one piece gives. Ids and bytes of pieces met before are
    kept in flat arrays beside the pieces' hashes: a large sorted level, and a small one that is merged into it when it has
    grown to a part of its size. A piece is found by its hash, and its bytes are compared before its ids are taken."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.marks, self.letters = _MARK.copy(), self._letter_table()
        for token in self.tokenizer.get_added_tokens_decoder().values():  # these are found before texts are parted
            held = np.frombuffer(token.content.encode(), np.uint8)
            self.marks[held[1:][_LETTER[held[:-1]]]] = False
            if token.content.strip().isalpha():
                self.letters = None
        self._forget()

    def _forget(self) -> None:
        # A level: sorted hashes, and the place of each among the pieces in the order in which they were learned.
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32)) for _ in range(2)]
        self.begins, self.sizes, self.flat = _Growing(np.uint32), _Growing(np.uint32), _Growing(np.uint32)
        self.from_, self.raw = _Growing(np.uint32), _Growing(np.uint8)

    def held(self) -> int:
        """Bytes of all that is remembered, room to grow included."""
        grown = (self.begins, self.sizes, self.flat, self.from_, self.raw)
        return sum(x.room.nbytes for x in grown) + sum(x.nbytes for level in self.levels for x in level)

    def _letter_table(self) -> dict | None:
        """How the tokenizer spells a space and the letters of U+00C0 to U+00FF, if it takes a run of letters, after one space at
        most, as one word; None otherwise."""
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        if parts["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return None
        spelled = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        return {ord(" "): spelled(" a")[:-1], **{c: spelled(chr(c)) for c in range(0xC0, 0x100) if chr(c).isalpha()}}

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in many(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> None:
        """Remember the ids of new pieces; raw holds their bytes, laid end to end. Runs of letters are words by themselves, for
        the tokenizer's model. Other pieces without line ends that begin (after one space at most) and end with plain
        characters are encoded many at a time with a line end between them, which is always a token of its own."""
        end = np.cumsum(length)
        start = end - length
        lead = raw[start] == 0x20
        second = raw[np.minimum(start + lead, len(raw) - 1)]
        before = raw[np.maximum(end - 2, 0)]
        ends_well = _PLAIN[raw[end - 1]] | ((raw[end - 1] >= 0x80) & (before == 0xC3) & (length >= 2))
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        lines, follows = upto(raw == 0x0A), np.append(False, raw[:-1] == 0xC3)
        apart = upto(~_LETTERS[raw] | ((raw >= 0x80) & (raw < 0xC0) & ~follows))
        word = (start + lead < end) & (apart[end] == apart[np.minimum(start + lead, end)]) & (self.letters is not None)
        alike = ~word & (start + lead < end) & (_PLAIN[second] | (second == 0xC3)) & ends_well & (lines[end] == lines[start]) & (self.line is not None)
        size = np.zeros(len(hashes), np.int64)
        parts: list[np.ndarray] = []
        wide, model = upto(raw >= 0x80), self.tokenizer.model
        plain, words = np.flatnonzero(word & (wide[end] == wide[start])), np.flatnonzero(word & (wide[end] > wide[start]))
        for own, table in ((plain, None), (words, self.letters)):
            if len(own):
                spelled = _lined(raw, start[own], length[own])
                spelled = spelled.translate(table) if table else spelled.replace(" ", self.letters[ord(" ")])
                lists = [[t.id for t in model.tokenize(w)] for w in spelled.split("\n")]
                size[own] = list(map(len, lists))
                parts.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        rows = np.flatnonzero(alike)
        chunks = [rows[k : k + JOINED] for k in range(0, len(rows), JOINED)]
        for mine, ids in zip(chunks, self._encoded([_lined(raw, start[c], length[c]) for c in chunks]), strict=True):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == self.line)
            own = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            if len(own) != len(mine):
                raise ValueError("a line end was not a token of its own")
            size[mine] = own
            parts.append(ids[ids != self.line])
        others = np.flatnonzero(~alike & ~word)
        lists = self._encoded([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)])
        size[others] = list(map(len, lists))
        parts.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        order = np.concatenate([plain, words, rows, others])
        begin = np.zeros(len(hashes), np.int64)
        begin[order] = len(self.flat.held) + np.cumsum(size[order]) - size[order]
        place = (len(self.sizes.held) + np.arange(len(hashes))).astype(np.uint32)
        self.begins.add(begin)
        self.sizes.add(size)
        self.from_.add(len(self.raw.held) + start)
        self.flat.add(np.concatenate(parts))
        self.raw.add(raw)
        large, small = self.levels
        small = _merged(small, (hashes, place))
        self.levels = [_merged(large, small), (small[0][:0], small[1][:0])] if 4 * len(small[0]) > len(large[0]) else [large, small]

    def _places(self, found: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, -1 where it is unknown."""
        out = np.full(len(found), -1, np.int64)
        for hashes, place in self.levels:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                out = np.where(hashes[at] == found, place[at], out)
        return out

    def encode(self, data: bytes | memoryview, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of texts laid end to end; ends are their ends in bytes."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.zeros(len(raw) + 1, bool)
        edge[0] = True
        edge[safe_cuts(raw, self.marks)] = True
        edge[ends] = True
        edges = np.flatnonzero(edge)
        start, end = edges[:-1], edges[1:]
        found, first, which = np.unique(span_hash(raw, start, end), return_index=True, return_inverse=True)
        if len(self.sizes.held) + len(found) > REMEMBERED or self.held() > HELD:
            self._forget()
        place = self._places(found)
        new = np.flatnonzero(place < 0)
        if len(new):
            length = (end - start)[first[new]]
            place[new] = len(self.sizes.held) + np.arange(len(new))
            self._learn(raw[_ranges(start[first[new]], length)], found[new], length)
        at = place[which]
        if not np.array_equal(self.raw.held[_ranges(self.from_.held[at].astype(np.int64), end - start)], raw):  # two pieces of one hash
            return self._whole(data, ends)
        each = self.sizes.held[at].astype(np.int64)
        ids = self.flat.held[_ranges(self.begins.held[at].astype(np.int64), each)]
        upto = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(end, ends, "right")]
        return ids, np.diff(upto, prepend=0)

    def _whole(self, data: bytes | memoryview, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, each text in one piece."""
        lists = self._encoded([bytes(data[a:b]).decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)


class _Growing:
    """An array that is added to at its end, with room to spare so that few additions copy it."""

    def __init__(self, kind: type) -> None:
        self.room, self.held = np.zeros(0, kind), np.zeros(0, kind)

    def add(self, more: np.ndarray) -> None:
        n = len(self.held) + len(more)
        if n > len(self.room):
            self.room = np.concatenate([self.held, np.zeros(n, self.room.dtype)])
        self.room[len(self.held) : n] = more
        self.held = self.room[:n]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from begin on, size of them, of each range after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _lined(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> str:
    """Spans of UTF-8 bytes with a line end between each and the next."""
    out = np.full(int(size.sum()) + len(size), 0x0A, np.uint8)
    to = np.cumsum(size + 1)
    out[_ranges(to - size - 1, size)] = raw[_ranges(start, size)]
    return out[:-1].tobytes().decode()


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _safe_pieces(text: memoryview) -> list[memoryview]:
    """A text in pieces of at most 2 * PIECE bytes where safe cuts are that near."""
    cut, at, reach = [], 0, 2 * PIECE
    while len(text) - at > reach:
        near = safe_cuts(np.frombuffer(text, np.uint8, reach, at))
        if not len(near):
            reach *= 2
            continue
        cut.append(text[at : at + int(near[-1])])
        at, reach = at + int(near[-1]), 2 * PIECE
    return [*cut, text[at:]]


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, each followed by end_id, to path: part, seq, n_ids, keys, lengths, payload."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def segment() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(whole)], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(whole)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["part", "seq", "n_ids", "keys", "lengths", "payload"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            kind = batch.column("_key").type
            texts = batch.column("_text").cast(pa.large_binary())  # laid end to end already, so runs of them are not copied
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            names = batch.column("_key").to_pylist()
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + PIECE, "right")) - 1)
                run = data[edges[at] : edges[to]]
                if to - at > 1:
                    got, counts = encoder.encode(run, edges[at + 1 : to + 1] - edges[at])
                    split = np.split(got, np.cumsum(counts)[:-1])
                else:
                    split = [np.concatenate([encoder.encode(p, np.array([len(p)]))[0] for p in _safe_pieces(run)])]
                for name, own in zip(names[at:to], split, strict=True):
                    keys.append(name)
                    ids += [own.astype(np.uint32), end]
                    lengths.append(len(own) + 1)
                    size += len(own) + 1
                    if size >= SEGMENT:
                        yield segment()
                        seq, size = seq + 1, 0
                        keys.clear()
                        ids.clear()
                        lengths.clear()
                at = to
        if keys:
            yield segment()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = [F.col("_key").asc_nulls_first(), F.col("_hash").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text").select("_key", "_text")
    dealt.mapInArrow(encoded, f"part int, seq int, n_ids long, keys array<{kind}>, lengths array<long>, payload binary").write.parquet(path)


def read_tokens(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a document from written segments: part, seq, place, key, start (ids before it, in all segments), n_tokens and
    ids."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = unpack(batch.column("payload")[i].as_py())
                keys, lengths = batch.column("keys")[i].values, batch.column("lengths")[i].values
                n = len(keys)
                size = lengths.to_numpy()
                ends = np.cumsum(size)
                place = lambda c: pa.array([batch.column(c)[i].as_py()] * n, pa.int32())  # noqa: E731, B023
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                whole = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([place("part"), place("seq"), pa.array(np.arange(n, dtype=np.int32)), keys, pa.array(ends - size), pa.array(size), whole], names=["part", "seq", "place", key, "_within", "n_tokens", "ids"])

    docs = segments.mapInArrow(decoded, f"part int, seq int, place int, {key} {kind}, _within long, n_tokens long, ids array<int>")
    return _placed(segments, docs)


def _placed(segments: DataFrame, docs: DataFrame) -> DataFrame:
    starts = running_offset(segments.select("part", "seq", "n_ids"), [], "part", [F.col("seq")], "n_ids", "_before")
    starts = starts.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "_before")
    joined = docs.join(starts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    return joined.withColumn("start", F.col("_before") + F.col("_within")).drop("_part", "_seq", "_before", "_within")


def token_digests(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """As read_tokens, with ids_crc32 (unsigned, of the ids as little-endian 32-bit integers) in place of ids."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = unpack(batch.column("payload")[i].as_py()).astype("<u4")
                keys, size = batch.column("keys")[i].values, batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(size)
                n, raw = len(keys), memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
                place = lambda c: pa.array([batch.column(c)[i].as_py()] * n, pa.int32())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([place("part"), place("seq"), pa.array(np.arange(n, dtype=np.int32)), keys, pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64())], names=["part", "seq", "place", key, "_within", "n_tokens", "ids_crc32"])

    docs = segments.mapInArrow(digested, f"part int, seq int, place int, {key} {kind}, _within long, n_tokens long, ids_crc32 long")
    return _placed(segments, docs)
