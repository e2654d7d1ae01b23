"""N-gram Jaccard join: a grouped prefix join, and the connected components of its links.

A text's set holds its distinct word shingles. Sets are ordered by rarity, the same order for all: frequent shingles come
last, the others stand in hash order. Two sets whose Jaccard similarity reaches the threshold share a shingle among the
first n - ceil(threshold * n) + 1 of each (their prefixes). The steps:

1. equal sets become one class; classes with identical prefix and size become one group;
2. groups are posted under their prefix shingles, and only shingles that two groups share go on;
3. those are expanded to the groups' members; pairs within length and positional bounds that share as many prefix
   shingles as they must are verified on their whole sets.

Large groups of near copies have links without number, and components need only some of them. So each shingle first
compares its members with one of them (the one with most copies, later others of the largest component there), links
found so far are contracted, and only pairs of different components remain. When few remain, when a round finds
hardly any link, or after MOST_ROUNDS, all of them are verified: none between components is left out.

Defined cases: null and empty texts, and texts without words, have empty sets, are linked with nothing and form their
own component; a text of fewer words than a shingle is one shingle; repeated rows are copies; a null doc_id never counts
as the smallest one of a component, unless it has no other; an empty table gives an empty result; other columns are not
read. Shingles and sets are told apart by 64 and 128 hash bits. The order table that tasks get has ORDERED rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.common import hashed_words, mix, stage

#: Frequent shingles that the order tells apart. A shingle counts as frequent from 1 / ORDERED of all shingles on, so
#: there cannot be more of them.
ORDERED = 1 << 22
LEAST_FREQUENT = 8
#: Shingles whose repeats a task counts together.
COUNTED = 1 << 22
MOST_ROUNDS = 6
#: Classes whose digests may be broadcast, to pick their texts: about 60 bytes each.
BROADCAST_ROWS = 400_000


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    out = []
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            whole = mix(whole * np.uint64(31) + words[k : k + len(whole)])
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= width:
                h = np.sort(whole[end - n : end - width + 1])
                out.append(h[np.append(True, h[1:] != h[:-1])])
            else:
                h = np.zeros(min(n, 1), np.uint64)
                for k in range(n):
                    h = mix(h * np.uint64(31) + words[end - n + k] + np.uint64(n))
                out.append(h)
    return out


def _batched(batches: Iterator[pa.RecordBatch], width: int, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their shingle sets, in slices of about size bytes of text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()) if batch.column("text").type != pa.large_binary() else batch.column("text")
        length = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()), np.int64, len(batch))
        cut = np.cumsum(length) // size
        at = 0
        while at < len(batch):
            to = int(np.searchsorted(cut, cut[at], "right"))
            yield batch.slice(at, to - at), shingle_sets(texts.slice(at, to - at).to_pylist(), width)
            at = to


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, document counts) of the frequent shingles. Each task counts those that repeat among its texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = size = 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for _, sets in _batched(batches, width):
            held += sets
            size += sum(map(len, sets))
            total += sum(map(len, sets))
            if size >= COUNTED:
                yield counted()
                size = 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["h", "n"])

    counts = stage(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    total = (counts.where(F.col("h").isNull()).first() or {"n": 0})["n"]
    least = max(LEAST_FREQUENT, total // ORDERED + 1)
    rows = counts.where(F.col("h").isNotNull() & (F.col("n") >= least)).orderBy("h").toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each row of docs: doc_id, digest (of the text), n, cls (of equal sets), grp (of equal prefix and size)
    and prefix, the first shingles in order, which a task gives once for a group. All three are null for empty sets."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = frequent.value
        given: set[bytes] = set()
        for rows, sets in _batched(batches, width):
            cls, grp, prefix = [], [], []
            for s in sets:
                if not len(s):
                    cls.append(None)
                    grp.append(None)
                    prefix.append(None)
                    continue
                short = len(s) - -(-percent * len(s) // 100) + 1
                rank = np.zeros(len(s), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[at] == s, often[at], 0)
                first = s[np.lexsort((s, rank))[:short]]
                with np.errstate(over="ignore"):
                    both = [np.bitwise_xor.reduce(mix(s + np.uint64(7))), np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
                    also = [np.bitwise_xor.reduce(mix(first + np.uint64(len(s)))), np.add.reduce(mix(first ^ np.uint64(0x14057B7EF767814F)))]
                cls.append(np.array([*both, len(s)], np.uint64).tobytes()[:20])
                grp.append(np.array([*also, len(s)], np.uint64).tobytes()[:20])
                prefix.append(None if grp[-1] in given else first.view(np.int64))
                given.add(grp[-1])
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("digest"), n, pa.array(cls, pa.binary()), pa.array(grp, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "cls", "grp", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "digest", "text")
    return named.mapInArrow(prefixed, f"doc_id {kind}, digest binary, n long, cls binary, grp binary, prefix array<long>")


def with_digest(docs: DataFrame) -> DataFrame:
    """docs with digest, by which equal texts are told from others."""
    return docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def shared_postings(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(token, cid, gid, n, pos, copies): classes under each prefix shingle that two groups of near sizes share, and under their
    group where it has several. rows has lid, which numbers them; several rows can give one group's prefix."""

    def near(who: str):
        under = Window.partitionBy("token").orderBy("n", who)
        before, after = F.lag("n").over(under), F.lead("n").over(under)
        return F.coalesce(100 * before >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * after, F.lit(False))

    given = rows.where(F.col("prefix").isNotNull())
    posted = given.select("lid", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = posted.withColumn("_near", near("lid")).where("_near").select("token", "lid", "pos")
    groups = classes.groupBy("grp").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("members"))
    member = classes.join(groups, "grp").select("grp", "cid", "n", "copies", "gid", "members")
    across = tokens.join(given.select("lid", "grp").join(member, "grp"), "lid").select("token", "cid", "gid", "n", "pos", "copies").distinct()
    across = across.withColumn("_near", near("cid")).where("_near").drop("_near")
    within = member.where(F.col("members") > 1).select(F.xxhash64("gid", F.lit("group")).alias("token"), "cid", "gid", "n", F.lit(-1).alias("pos"), "copies")
    return across.unionByName(within)


def _possible(percent: int, a: str, b: str) -> Column:
    """Length and positional bounds of a pair of postings given as structs of n and pos. A linked pair meets them under its
    first common shingle: from there on each set must still hold all that they need in common."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(*(F.col(f"{x}.n") - F.greatest(F.col(f"{x}.pos"), F.lit(0)) for x in (a, b)))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (left * (100 + percent) >= percent * (na + nb))


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    """(a, b, n_a, n_b, alike): distinct pairs of the structs me and `other`; alike if they are of one group."""
    low = F.when(F.col("me.cid") < F.col(f"{other}.cid"), F.col("me")).otherwise(F.col(other)).alias("l")
    high = F.when(F.col("me.cid") < F.col(f"{other}.cid"), F.col(other)).otherwise(F.col("me")).alias("h")
    return rows.select(low, high).select(F.col("l.cid").alias("a"), F.col("h.cid").alias("b"), F.col("l.n").alias("n_a"), F.col("h.n").alias("n_b"), (F.col("l.gid") == F.col("h.gid")).alias("alike")).distinct()


def _member() -> Column:
    return F.struct("cid", "gid", "n", "pos", "comp")


def star_pairs(labelled: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of each posting with one of its token, unless both are in one component already. Turn 0 takes the class with
    most copies, a later turn some class of the token's largest component."""
    if turn == 0:
        chosen = labelled.groupBy("token").agg(F.max(F.struct("copies", "cid", _member().alias("p")))["p"].alias("hub"))
    else:
        some = F.max(F.struct(F.xxhash64("cid", "token", F.lit(turn)).alias("x"), _member().alias("p")))["p"]
        sizes = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), some.alias("p"))
        chosen = sizes.groupBy("token").agg(F.max(F.struct("k", "comp", "p"))["p"].alias("hub"), F.count(F.lit(1)).alias("comps")).where(F.col("comps") > 1)
    rows = labelled.select("token", _member().alias("me")).join(chosen.select("token", "hub"), "token")
    return _pairs(rows.where((F.col("me.comp") != F.col("hub.comp")) & _possible(percent, "me", "hub")), "hub")


def cross_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """All pairs of postings of one token that are in different components."""
    several = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token")
    rows = labelled.join(several, "token", "left_semi").select("token", _member().alias("me"))
    both = rows.join(rows.withColumnRenamed("me", "other"), "token")
    return _pairs(both.where((F.col("me.comp") < F.col("other.comp")) & _possible(percent, "me", "other")), "other")


def enough_shared(pairs: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that share as many prefix shingles as they need. Shingles in common beyond the prefix that ends first
    are at most as many as that set has there, so a pair needs the rest among those that both prefixes have. Groups of
    one prefix share it whole."""
    own = postings.where("pos >= 0").groupBy("cid").agg(F.collect_list("token").alias("tokens"))
    of = lambda side: own.select(F.col("cid").alias(side), F.col("tokens").alias(f"t_{side}"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    shared = F.coalesce(F.size(F.array_intersect("t_a", "t_b")), F.lit(0))
    beyond = F.ceil(F.greatest("n_a", "n_b") * percent / 100.0) - 1
    return rows.where(F.col("alike") | ((100 + percent) * (shared + beyond) >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def cross_count(labelled: DataFrame) -> tuple[int, int]:
    """(postings, pairs of postings of one token in different components)."""
    comps = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("k"))
    tokens = comps.groupBy("token").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("q"))
    r = tokens.agg(F.sum("m").alias("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("p")).first()
    return int(r["m"] or 0), int(r["p"] or 0)


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, set): the shingle set, as bytes, of each wanted class, made from the text of one of its rows."""
    wanted = classes.join(wanted, "cid", "left_semi").select("cid", F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("cid", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _batched(batches, width):
            yield pa.RecordBatch.from_arrays([rows.column("cid"), pa.array([s.tobytes() for s in found], pa.binary())], names=["cid", "set"])

    made = stage(texts.mapInArrow(sets, "cid long, set binary"), "sets")
    if made.groupBy("cid").count().where("count > 1").limit(1).count():  # rows alike in key and text
        made = made.groupBy("cid").agg(F.min("set").alias("set"))
    return made


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, both, n_a, n_b) of the pairs that reach the threshold, by their whole sets."""
    rows = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, both, sizes = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                k = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * k >= percent * (len(u) + len(v) - k):
                    keep.append(i)
                    both.append(k)
                    sizes.append((len(u), len(v)))
            out = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b"), pa.array(both, pa.int64()), pa.array([x for x, _ in sizes], pa.int64()), pa.array([y for _, y in sizes], pa.int64())], names=["a", "b", "both", "n_a", "n_b"])

    return rows.mapInArrow(verify, "a long, b long, both long, n_a long, n_b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has a link, by alternating large-star and
    small-star steps until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        edges = stage(edges, "edges")
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hung.unionByName(root.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, digest, n_shingles, and component_id, the smallest doc_id that
    links of at least percent / 100 Jaccard similarity reach."""
    docs = with_digest(docs.select("doc_id", "text"))
    rows = stage(prefixes(docs, width, percent).withColumn("lid", F.monotonically_increasing_id()), "prefixes")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "digest", "n", "grp")).alias("one")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), one)
    classes = stage(classes.select("cls", "copies", "one.doc_id", "one.digest", "one.n", "one.grp").withColumn("cid", F.monotonically_increasing_id()), "classes")
    postings = stage(shared_postings(rows, classes, percent), "postings")
    labelled, links, sets, turn, useful = postings.withColumn("comp", F.col("cid")), None, None, 0, True
    while True:
        posted, left = cross_count(labelled)
        last = turn > 0 and (left <= 4 * posted or not useful) or turn >= MOST_ROUNDS
        pairs = cross_pairs(labelled, percent) if last else star_pairs(labelled, percent, turn)
        pairs = stage(enough_shared(pairs, postings, percent), "pairs")
        wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        new = class_sets(docs, classes, wanted if sets is None else wanted.join(sets, "cid", "left_anti"), width)
        sets = new if sets is None else sets.unionByName(new)
        found = stage(verified(pairs, sets, percent).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        if last:
            break
        useful = 20 * found.count() >= pairs.count()
        named = comps.select(F.col("node").alias("cid"), F.col("comp").alias("_comp"))
        labelled = stage(postings.join(named, "cid", "left").withColumn("comp", F.coalesce("_comp", "cid")).drop("_comp"), "labelled")
        turn += 1
    # Both sides of the join on comp are written, so that a component with many classes can be dealt over several tasks.
    named = comps.withColumnRenamed("node", "cid")
    grouped = stage(classes.select("cls", "doc_id", "cid").join(named, "cid", "left").select("cls", "doc_id", F.coalesce("comp", "cid").alias("comp")), "grouped")
    smallest = stage(grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "smallest")
    by_class = grouped.select("cls", "comp").join(smallest, "comp").select(F.col("cls").alias("_cls"), "component_id", F.lit(True).alias("_set"))
    out = rows.select("doc_id", "digest", "n", "cls").join(by_class, F.col("cls") == F.col("_cls"), "left")
    own = F.when(F.col("_set"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each component: that of the smallest doc_id (not null, if there is one), of its texts the one
    with the smallest digest. Rows without words all stay."""
    found = stage(jaccard_components(docs, width, percent).where("n_shingles > 0"), "components")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unset"), F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")))
    first = found.groupBy("component_id").agg(least.alias("k")).select("k._doc", "k._digest")
    key = lambda other: (F.col("digest") == other["_digest"]) & F.col("doc_id").eqNullSafe(other["_doc"])
    gone = found.join(first, key(first), "left_anti").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    gone = stage(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    named = with_digest(docs)
    kept = named.join(gone, key(gone), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).count().where("count > 1").drop("count")
    if again.limit(1).count():  # rows alike in key and text: one of them stays
        kept = kept.join(again, key(again), "left_anti").unionByName(kept.join(again, key(again), "left_semi").dropDuplicates(["doc_id", "digest"]))
    return kept.select(*docs.columns)
