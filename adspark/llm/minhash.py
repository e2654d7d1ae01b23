"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

A text's set holds its distinct word shingles, as 64-bit hashes. One permutation of them is cut into BINS equal ranges; the
smallest hash of each range is the bin's value. An empty bin borrows from another one: it tries bins that a hash of (bin,
attempt) names until one has a value, the same attempts in every text, so two texts agree in a bin with the probability of
their similarity whether it was empty or not. BANDS bands of ROWS bins give a bucket each.

Two texts at the threshold of 0.85 agree in no band with a probability of 3e-7 (0.8: 6e-5), whatever their length.

Buckets hold classes of equal sets, so copies never meet each other. A bucket's candidate edges are stars: in the first round
its members are compared with one hub, the class of most copies; in round k with the first HUBS ** k classes, about, in the
order of a hash. Hubs that have met all members leave the bucket, so after some rounds nothing is left to compare in it. An
edge is a candidate only if its ends are in different components so far (what a hub has linked is not compared again), if this
is the first band that they agree in, if their sizes allow a link, and if the one-bit sketches of all bins differ in no more
places than a pair at the threshold has but for one in some millions. Every candidate is confirmed on the two whole sets, so
no likeness of buckets or sketches makes a link. The links' components are those of alternating large and small stars.

Defined cases: null and empty texts, and texts without words, have empty sets, are linked with nothing and form their own
component; a text of fewer words than a shingle is one shingle; repeated rows are copies; a null doc_id never counts as the
smallest one of a component, unless it has no other; an empty table gives an empty result; other columns are not read.
Sets of one class are told apart by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import mix, stage
from adspark.llm.jaccard_join import _batched, class_sets, components, verified, with_digest

BANDS = 32
ROWS = 6
#: Bins of the permutation. The first BANDS * ROWS make the bands, and each gives the sketch a bit.
BINS = 1 << 10
#: Hubs of a bucket grow by this factor from round to round.
HUBS = 32
#: Standard deviations beyond the mean that a linked pair's sketches may differ in.
DEVIATIONS = 5.5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(11).integers(0, 2**63, BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set's hashes and 32 of its size."""
    with np.errstate(over="ignore"):
        both = [np.bitwise_xor.reduce(mix(hashes + np.uint64(7))), np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
    return np.array([*both, len(hashes)], np.uint64).tobytes()[:20]


#: Attempts that a worker holds, enough for almost all bins of the shortest texts.
HELD = 1 << 12


def attempts(first: int, many: int, bins: np.ndarray) -> np.ndarray:
    """(many, bins): what the given bins try from their attempt of number `first` on."""
    with np.errstate(over="ignore"):
        tried = mix(bins.astype(np.uint64)[None, :] * _GOLDEN + np.arange(first + 1, first + many + 1, dtype=np.uint64)[:, None])
    return (tried % np.uint64(BINS)).astype(np.int16)


@cache
def first_attempts() -> np.ndarray:
    """The first attempts of all bins."""
    return np.concatenate([attempts(at, 256, np.arange(BINS)) for at in range(0, HELD, 256)])


def bin_values(hashes: np.ndarray) -> np.ndarray:
    """The value of each bin of a sorted set that is not empty; empty bins are densified."""
    of = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    value, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    at = of[first].astype(np.int64)
    value[at], filled[at] = hashes[first], True
    if len(at) == 1:
        return np.full(BINS, value[at[0]])
    empty, done, enough = np.flatnonzero(~filled), 0, 3 * BINS // len(at) + 1
    while len(empty):
        tried = first_attempts()[done : done + enough, empty] if done + enough <= HELD else attempts(done, enough, empty)
        found = filled[tried]
        which = found.argmax(0)
        column = np.arange(len(empty))
        good = found[which, column]
        value[empty[good]] = value[tried[which[good], column[good]]]
        empty, done = empty[~good], done + enough
    return value


def band_keys(values: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    with np.errstate(over="ignore"):
        sums = (values[: BANDS * ROWS] * _ODD[: BANDS * ROWS]).reshape(BANDS, ROWS).sum(1)
        return mix(sums ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN))


def sketch(values: np.ndarray) -> np.ndarray:
    """A bit of each bin's value, packed into longs. Bins that hold one value draw their bits apart."""
    with np.errstate(over="ignore"):
        bits = (mix(values ^ _ODD) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_different(percent: int) -> int:
    """Places in which the sketches of a pair at the threshold may differ."""
    p = (100 - percent) / 200
    return int(np.ceil(BINS * p + DEVIATIONS * np.sqrt(BINS * p * (1 - p))))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row for each row of docs (doc_id, digest, text): doc_id, digest, n, cls (of equal sets), and buckets and sketch, which
    a task gives once for a class. The last three are null for empty sets."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes | None] = {None}
        for rows, sets in _batched(batches, width):
            cls = [set_digest(s) if len(s) else None for s in sets]
            buckets: list[np.ndarray | None] = []
            sketches: list[np.ndarray | None] = []
            for c, s in zip(cls, sets, strict=True):
                values = bin_values(s) if c not in given else None
                buckets.append(None if values is None else band_keys(values).view(np.int64))
                sketches.append(None if values is None else sketch(values))
                given.add(c)
            n, longs = pa.array([len(s) for s in sets], pa.int64()), pa.list_(pa.int64())
            values = [rows.column("doc_id"), rows.column("digest"), n, pa.array(cls, pa.binary()), pa.array(buckets, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "digest", "n", "cls", "buckets", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "digest", "text")
    return named.mapInArrow(signed, f"doc_id {kind}, digest binary, n long, cls binary, buckets array<long>, sketch array<long>")


def shared_buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, band, cid, n, copies, bands, sketch): the members of each bucket that several classes share. Bands are shorter
    hashes of the buckets in their order."""
    given = rows.where(F.col("buckets").isNotNull()).select("cls", "buckets", "sketch")
    given = stage(given.join(classes.select("cls", "cid", "n", "copies"), "cls").drop("cls").dropDuplicates(["cid"]), "given")
    posted = given.select("cid", F.posexplode("buckets").alias("band", "bucket"))
    several = posted.groupBy("bucket").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    shared = posted.join(several.select("bucket"), "bucket", "left_semi")
    bands = F.transform("buckets", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")
    return shared.join(given.select("cid", "n", "copies", bands, "sketch"), "cid")


def open_buckets(members: DataFrame, turn: int) -> DataFrame:
    """(bucket, m): buckets whose m members are in several components and have not all been hubs in earlier turns."""
    found = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"))
    compared = HUBS ** (turn - 1) if turn > 1 else 0
    return found.where((F.col("low") < F.col("high")) & (F.col("m") > compared)).select("bucket", "m")


def star_edges(members: DataFrame, open_: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): the candidate edges between members of each open bucket and its hubs of this turn. Hubs of earlier turns have
    met all members and stay away."""
    inside = members.join(open_, "bucket")
    if turn == 0:
        first = inside.groupBy("bucket").agg(F.max(F.struct("copies", "cid"))["cid"].alias("_hub"))
        inside = inside.join(first.withColumnRenamed("bucket", "_at"), F.col("bucket") == F.col("_at")).withColumn("new", F.col("cid") == F.col("_hub"))
    else:  # a hash gives the members' order, the same in all buckets
        place = F.pmod(F.xxhash64("cid"), F.lit(1 << 40)) / float(1 << 40) * F.col("m")
        inside = inside.where(place >= (HUBS ** (turn - 1) if turn > 1 else 0)).withColumn("new", place < HUBS**turn)
    one = F.struct("cid", "n", "comp", "band", "bands", "sketch", "new")
    me, hub = inside.select("bucket", one.alias("me")), inside.where("new").select(F.col("bucket").alias("at"), one.alias("hub"))
    low, high = F.least("me.n", "hub.n"), F.greatest("me.n", "hub.n")
    different = sum((F.bit_count(F.col("me.sketch")[i].bitwiseXOR(F.col("hub.sketch")[i])) for i in range(1, BINS // 64)), F.bit_count(F.col("me.sketch")[0].bitwiseXOR(F.col("hub.sketch")[0])))
    first = F.array_position(F.zip_with("me.bands", "hub.bands", lambda x, y: x == y), True) - 1
    likely = (F.col("me.comp") != F.col("hub.comp")) & (100 * low >= percent * high) & (different <= most_different(percent))
    once = ~F.col("me.new") | (F.col("me.cid") < F.col("hub.cid"))
    pairs = me.join(hub, (F.col("bucket") == F.col("at")) & once & likely & (first == F.col("me.band")))
    return pairs.select(F.least("me.cid", "hub.cid").alias("a"), F.greatest("me.cid", "hub.cid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, digest, n_shingles, component_id (the smallest doc_id that links of
    at least percent / 100 Jaccard similarity reach) and kept, whether doc_id is that one."""
    docs = with_digest(docs.select("doc_id", "text"))
    rows = stage(signatures(docs, width), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "digest", "n")).alias("one")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), one)
    classes = classes.select("cls", "copies", "one.doc_id", "one.digest", "one.n").withColumn("cid", F.monotonically_increasing_id())
    classes = stage(classes, "classes")
    shared = stage(shared_buckets(rows, classes), "shared")
    members, links, sets, turn = shared.withColumn("comp", F.col("cid")), None, None, 0
    comps: DataFrame | None = None
    while True:
        open_ = stage(open_buckets(members, turn), "open")
        if not open_.limit(1).count():
            break
        pairs = stage(star_edges(members, open_, percent, turn), "edges")
        wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        new = class_sets(docs, classes, wanted if sets is None else wanted.join(sets, "cid", "left_anti"), width)
        sets = new if sets is None else sets.unionByName(new)
        found = stage(verified(pairs, sets, percent).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        named = stage(comps.select(F.col("node").alias("cid"), F.col("comp").alias("_comp")), "named")
        members = shared.join(named, "cid", "left").withColumn("comp", F.coalesce("_comp", "cid")).drop("_comp")
        turn += 1
    comp = F.col("cid")
    grouped = classes.select("cls", "doc_id", "cid")
    if comps is not None:
        grouped, comp = grouped.join(comps.withColumnRenamed("node", "cid"), "cid", "left"), F.coalesce("comp", "cid")
    # Both sides of the join on comp are written, so that a component with many classes can be dealt over several tasks.
    grouped = stage(grouped.select("cls", "doc_id", comp.alias("comp")), "grouped")
    smallest = stage(grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "smallest")
    by_class = grouped.select("cls", "comp").join(smallest, "comp").select(F.col("cls").alias("_cls"), "component_id", F.lit(True).alias("_set"))
    out = rows.select("doc_id", "digest", "n", "cls").join(by_class, F.col("cls") == F.col("_cls"), "left")
    own = F.when(F.col("_set"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "digest", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
