"""Merkle dataset manifest: trees of FAN children over the rows of each group, a tree over the groups, and proofs.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as their hex text. A row's leaf is H of its fields,
each `-` if null, else its number of UTF-8 bytes, `:` and its value. In a group, leaves stand in the order of their key; while
several nodes remain, each FAN consecutive ones (the last run may have fewer, even one) become their H. What remains is the
group's subroot; a lone leaf is one itself. The subroots, by group (null first, then UTF-8 bytewise), make the root likewise.

How a forest is built:

1. The rows' leaves are range-sorted by group, key and leaf, and each sorted partition is written as blocks of at most BLOCK
   consecutive leaves of one group. Counts of blocks, added up in order within a group, tell each block the places of its
   leaves; the digests themselves are not moved for that.
2. Each block builds the complete aligned subtrees among its leaves. The roots of those whose parents reach into other
   blocks, at most 2 * (FAN - 1) a level, are its ragged nodes.
3. Ragged nodes are shuffled by the coordinate of their parent (group, level, run) and hashed, level by level, up to the
   subroots. With these, they are the spine: some nodes a block, not the whole tree.
4. Each block asks the spine for the runs at its edges and above it, builds its subtrees again, and gives each leaf its path:
   for each level the digests left of it in its run and those right of it.

The groups' subroots pass through the same steps as the leaves of one group, so any number of groups will do. A task holds one
block, whatever the size of a group, and equal rows are dealt over blocks like others.

Defined cases: null fields are `-`, so null and empty texts differ; texts of any length are hashed whole; rows of equal key
stand by their leaf, equal rows in any order, as they are alike; a null key comes first; a null group is one of its own; an
empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.common import stage

FAN = 8
#: Leaves of a block: all that a task holds at a time, 64 bytes each.
BLOCK = FAN**5
#: Leaves whose paths are given out together.
GIVEN = 4096
#: Groups whose paths may be broadcast: some kilobytes each.
BROADCAST_GROUPS = 2_000


def field(value: Column) -> Column:
    """The text that stands for a field in a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """A row's leaf."""
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path one after the other, left to right and level by level."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def height(n: int) -> int:
    """Levels above the leaves of a group of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtrees(leaves: list[str], first: int, n: int) -> list[tuple[int, list[str]]]:
    """(first index, digests) of the complete nodes of each level that a block's leaves make; first is the place of the first
    leaf in its group of n leaves. Levels end at the subroot, or with the first one that has no complete node."""
    levels, low, nodes = [(first, leaves)], first, leaves
    while n > 1 and nodes:
        high = low + len(nodes)
        start, end = -(-low // FAN), -(-high // FAN) if high == n else high // FAN
        nodes = [digest(nodes[FAN * j - low : FAN * j + FAN - low]) for j in range(start, end)]
        n, low = -(-n // FAN), start
        levels.append((low, nodes))
    return levels


def ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of nodes without a parent in the block; the subroot is one of them."""
    for level, (low, nodes) in enumerate(levels):
        start, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i, node in enumerate(nodes, low):
            if not start <= i // FAN < start + len(above):
                yield level, i, node


def runs_asked(first: int, many: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, run) of the runs that hold ancestors of a block's leaves, or those leaves, and nodes of other blocks."""
    low, high = first, first + many  # of complete nodes
    left, right = first, first + many - 1  # first and last ancestor
    level = 0
    while n > 1:
        for run in sorted({left // FAN, right // FAN}):
            if low > FAN * run or min(FAN * run + FAN, n) > high:
                yield level, run
        low, high = -(-low // FAN), -(-high // FAN) if high == n else high // FAN
        left, right, n, level = left // FAN, right // FAN, -(-n // FAN), level + 1


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(part, seq, grp, many, keys, leaves, others): range-sorted rows (grp, key, leaf, other), at most `size` of a group in a
    block; part and seq are the blocks' order."""
    many = rows.count()
    parts = min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // (32 * BLOCK)), many // GIVEN + 1)
    tied = rows.withColumn("tied", F.monotonically_increasing_id())  # so that a range can end among equal rows
    order = ["grp", "key", "leaf", "tied"]
    ordered = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tied")
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, many = TaskContext.get().partitionId(), 0, [], 0
        grp = None

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.array([whole.column(c).to_pylist()], pa.list_(whole.schema.field(c).type)) for c in ("key", "leaf", "other")]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([grp]), pa.array([many]), *lists], names=["part", "seq", "grp", "many", "keys", "leaves", "others"])

        for batch in batches:
            names = batch.column("grp").to_pylist()
            at = 0
            while at < len(names):
                if many and (names[at] != grp or many == size):
                    yield block()
                    seq, held, many = seq + 1, [], 0
                grp = names[at]
                to = at + 1
                while to < len(names) and names[to] == grp and many + to - at < size:
                    to += 1
                held.append(batch.slice(at, to - at))
                many += to - at
                at = to
        if many:
            yield block()

    made = ordered.mapInArrow(cut, f"part int, seq long, grp string, many long, keys array<{kind}>, leaves array<string>, others array<string>")
    return stage(made, "blocks")


def placed(cut: DataFrame) -> DataFrame:
    """(part, seq, grp, many, first, n): where each block's leaves stand in their group, and that group's size."""
    own = Window.partitionBy("grp").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.select("part", "seq", "grp", "many")
    sizes = counts.groupBy("grp").agg(F.sum("many").alias("n"))
    first = F.coalesce(F.sum("many").over(own), F.lit(0)).alias("first")
    return stage(counts.select("part", "seq", "grp", "many", first).join(sizes, "grp"), "places")


def spine(cut: DataFrame, places: DataFrame) -> DataFrame:
    """(grp, n, level, idx, digest): the nodes that are in no block's complete subtrees but as their roots, subroots included."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(ragged(subtrees(r["leaves"], r["first"], r["n"])))
                level, idx, node = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * len(found)), pa.array([r["n"]] * len(found)), pa.array(level, pa.int32()), pa.array(idx), pa.array(node)], names=["grp", "n", "level", "idx", "digest"])

    rows = cut.select("part", "seq", "leaves").join(places.select("part", "seq", "grp", "first", "n"), ["part", "seq"])
    known = stage(rows.mapInArrow(climb, "grp string, n long, level int, idx long, digest string"), "ragged")
    top = height(known.agg(F.max("n")).first()[0] or 0)
    whole, below = known, known.where("level = 0")
    for level in range(top):
        run = F.floor(F.col("idx") / FAN).alias("idx")
        node = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), ""), 256)
        made = below.where(F.col("n") > FAN**level).groupBy("grp", "n", run.alias("up")).agg(node.alias("digest"))
        made = made.select("grp", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest")
        made = stage(made, f"level{level + 1}")
        whole = whole.unionByName(made)
        below = known.where(F.col("level") == level + 1).unionByName(made)
    return whole


def is_subroot() -> Column:
    """Whether a node of the spine is its group's subroot: the level is the first that one node's FAN ** level leaves fill."""
    out = F.lit(False)
    for level in range(21):  # a long counts no more leaves than that
        out = out | ((F.col("level") == level) & (F.col("n") <= FAN**level) & (F.col("n") > FAN**level // FAN))
    return out


def paths(cut: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, key, leaf, other, path) of every leaf: path has left and right of each level up to the subroot."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [(r.part, r.seq, r.grp, level, run) for r in df.itertuples() for level, run in runs_asked(r.first, r.many, r.n)]
            yield pd.DataFrame(out, columns=["part", "seq", "grp", "level", "run"])

    asked = places.mapInPandas(ask, "part int, seq long, grp string, level int, run long")
    in_run = F.floor(F.col("idx") / FAN).alias("run")
    runs = nodes.groupBy("grp", "level", in_run).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("nodes"))
    told = asked.join(runs, ["grp", "level", "run"]).groupBy("part", "seq").agg(F.collect_list(F.struct("level", "nodes")).alias("told"))
    kind = cut.schema["keys"].dataType.elementType.simpleString()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _given(r, batch.schema.field("keys").type.value_type)

    rows = cut.select("part", "seq", "keys", "leaves", "others").join(places, ["part", "seq"]).join(told, ["part", "seq"], "left")
    return rows.mapInArrow(give, f"grp string, key {kind}, leaf string, other string, path array<struct<left:string,right:string>>")


def _given(block: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of a block with their paths. Nodes of one parent share theirs, so they are made once and then taken."""
    first, many, n = block["first"], block["many"], block["n"]
    known: list[dict[int, str]] = []
    for low, nodes in subtrees(block["leaves"], first, n):
        known.append(dict(enumerate(nodes, low)))
    levels = height(n)
    known += [{} for _ in range(levels + 1 - len(known))]
    for run in block["told"] or []:
        known[run["level"]].update((x["idx"], x["digest"]) for x in run["nodes"])
    for at in range(first, first + many, GIVEN):
        to = min(at + GIVEN, first + many)
        left, right, places, made, size = [], [], [], 0, n
        for level in range(levels):
            low, high = at // FAN**level, (to - 1) // FAN**level
            run, text = -1, ""
            for i in range(low, high + 1):
                if i // FAN != run:
                    run = i // FAN
                    text = "".join(known[level][j] for j in range(FAN * run, min(FAN * run + FAN, size)))
                k = 64 * (i % FAN)
                left.append(text[:k])
                right.append(text[k + 64 :])
            places.append(np.arange(at, to) // FAN**level - low + made)
            made, size = len(left), -(-size // FAN)
        taken = pa.array(np.stack(places, 1).reshape(-1) if places else np.zeros(0, np.int64))
        runs = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(taken), pa.array(right, pa.string()).take(taken)], names=["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * levels, pa.int32()), runs)
        cut = slice(at - first, to - first)
        values = [pa.array([block["grp"]] * (to - at)), pa.array(block["keys"][cut], kind), pa.array(block["leaves"][cut]), pa.array(block["others"][cut], pa.string()), path]
        yield pa.RecordBatch.from_arrays(values, names=["grp", "key", "leaf", "other", "path"])


def forest(rows: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(leaves with paths, subroots): of rows (grp, key, leaf, other) the same with path, and (grp, subroot)."""
    cut = blocks(rows, size)
    places = placed(cut)
    nodes = spine(cut, places)
    return paths(cut, places, nodes), nodes.where(is_subroot()).select("grp", F.col("digest").alias("subroot"))


def manifest(df: DataFrame, key: str, group: str, leaf: Column, other: Column, size: int = BLOCK) -> DataFrame:
    """key, leaf, other (a text carried along), subroot, root and path (from the leaf to the root) of every row of df, whose
    leaves are in trees by group."""
    grp = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # null first
    rows = stage(df.select(grp.alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), other.alias("other")), "leaves")
    below, subroots = forest(rows, size)
    groups = stage(subroots, "subroots")
    many = groups.count()
    above, roots = forest(groups.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("other")), size)
    tops = above.select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), F.col("path").alias("_above"))
    tops = stage(tops.crossJoin(F.broadcast(roots.select(F.col("subroot").alias("root")))), "tops")  # one root, or none
    joined = below.join(F.broadcast(tops) if many <= BROADCAST_GROUPS else tops, "grp")
    return joined.select(F.col("key").alias(key), "leaf", "other", "subroot", "root", F.concat("path", "_above").alias("path"))
