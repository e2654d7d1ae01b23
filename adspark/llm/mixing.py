"""Mixing sources to target weights.

The words of each source are laid end to end, in an order that a hash of the key gives, and cut into blocks of fixed
length. Each output shard draws how many of its slots go to each source from a multinomial over what is still due to the
sources. Slots of a source are numbered through all shards; slot i takes block p(i mod blocks), where p is a pseudorandom
permutation of the source's block indexes, another one for each pass over the source. Slots and blocks are then joined by
index.

Defined cases: a null source is a source of its own, after all others; null and empty texts have no words and are never
taken; repeated rows are texts of their own; a source without words has target 0; an empty table gives an empty result;
other columns pass through, and of a clashing name the computed column is the one that stays. What reaches the driver is
one row a source. Reruns agree: nothing depends on the order of rows or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import mix, running_offset, stage, word_count, word_spans

#: A source's words are taken so many times at most.
MOST_PASSES = 3
#: Parts of a source that are laid out apart from each other.
PARTS = 1024
#: Slots that one row of the slot plan stands for, and rows that a task deals, about.
CHUNK, DEALT = 1 << 14, 4


def water_fill(sizes: list[int], weights: list[float], most: int = MOST_PASSES) -> list[float]:
    """Targets that share the sum of sizes by weight, none above most * its size: the excess goes to the others by
    weight until none is above."""
    sizes_, weights_ = np.asarray(sizes, float), np.asarray(weights, float)
    total, fixed = float(sizes_.sum()), np.zeros(len(sizes_), bool)
    targets = np.zeros(len(sizes_))
    while not fixed.all():
        left = total - float((most * sizes_[fixed]).sum())
        targets[~fixed] = left * weights_[~fixed] / weights_[~fixed].sum()
        over = ~fixed & (targets > most * sizes_)
        if not over.any():
            break
        fixed |= over
        targets[fixed] = most * sizes_[fixed]
    return [float(x) for x in targets]


def source_targets(sized: DataFrame, weights: tuple[float, ...]) -> list[dict]:
    """A row a source in code point order, null last: source, size, target; weights are dealt in that order, repeating."""
    rows = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    shares = water_fill([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))])
    return [{"source": s, "source_size": n, "target": t, "index": i} for i, ((s, n), t) in enumerate(zip(rows, shares, strict=True))]


def draw_counts(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each (shard, source). Each shard draws from a multinomial whose chances are what is still due to each
    source; what goes beyond that is drawn again, so all shards together give each source its quota."""
    due, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        rng = np.random.default_rng([seed, k])
        left = int(due.sum()) * 1 // (shards - k) if k + 1 < shards else int(due.sum())
        while left > 0:
            drawn = np.minimum(rng.multinomial(left, due / due.sum()), due)
            out[k] += drawn
            due -= drawn
            left -= int(drawn.sum())
    return out


def permuted(index: np.ndarray, size: int, salt: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(size), one for each salt, puts each index: a four-round Feistel network
    over the next even number of bits, followed until the value is below size."""
    bits = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << bits) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right, key = out[todo] >> np.uint64(bits), out[todo] & mask, salt[todo].astype(np.uint64)
        for r in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix(right + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & mask)
        out[todo] = (left << np.uint64(bits)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def deal_slots(plan: DataFrame, seed: int) -> DataFrame:
    """(shard, slot, index, block): the block that each slot takes. plan has a row for each chunk of slots of a source."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                number = np.arange(r["first"], r["first"] + r["n"], dtype=np.int64)
                salt = mix((number // r["blocks"]).astype(np.uint64) + np.uint64(r["index"] * 1_000_003 + seed))
                block = permuted(number % r["blocks"], r["blocks"], salt)
                slot = np.arange(r["slot"], r["slot"] + r["n"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(r["n"], r["shard"], np.int32)), pa.array(slot), pa.array(np.full(r["n"], r["index"], np.int32)), pa.array(block)], names=["shard", "slot", "index", "block"])

    return plan.mapInArrow(deal, "shard int, slot long, index int, block long")


def plan_slots(df: DataFrame, sources: list[dict], block_words: int, shards: int, seed: int) -> DataFrame:
    """A row for each chunk of a source's slots in an output shard."""
    blocks = np.array([-(-s["source_size"] // block_words) for s in sources], np.int64)
    mean = np.array([s["source_size"] / max(b, 1) for s, b in zip(sources, blocks, strict=True)])
    quotas = np.array([min(round(s["target"] / m) if m else 0, MOST_PASSES * int(b)) for s, m, b in zip(sources, mean, blocks, strict=True)], np.int64)
    counts = draw_counts(quotas, shards, seed)
    first, at = np.cumsum(counts, axis=0) - counts, np.cumsum(counts, axis=1) - counts
    rows = [(k, i, int(blocks[i]), int(first[k, i]), int(at[k, i]), int(counts[k, i])) for k in range(shards) for i in range(len(sources)) if counts[k, i]]
    plan = df.sparkSession.createDataFrame(rows, "shard int, index int, blocks long, first long, slot long, n long")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("o")
    plan = plan.select("*", cut).select("shard", "index", "blocks", (F.col("first") + F.col("o")).alias("first"), (F.col("slot") + F.col("o")).alias("slot"), F.least(F.col("n") - F.col("o"), F.lit(CHUNK)).cast("long").alias("n"))
    tasks = int(counts.sum()) // (DEALT * CHUNK) + 1  # a number of its own: small plan rows stand for many slots
    return plan.repartition(tasks, "shard", "first", "index")


def lay_out(df: DataFrame, sources: list[dict], key: str) -> DataFrame:
    """Rows with words, with index (of the source) and start, the words of the source before this row's."""
    table = df.sparkSession.createDataFrame([(s["source"], s["index"], s["source_size"], s["target"]) for s in sources], "_source string, index int, source_size long, target double")
    rows = df.join(table, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("_hash", F.xxhash64(F.col(key), F.col("_text"))).withColumn("_part", F.pmod("_hash", F.lit(PARTS)).cast("int"))
    return running_offset(rows, ["index"], "_part", [F.col("_hash"), F.col(key)], "size", "start").drop("_hash", "_part")


def mix_sources(
    df: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    key: str = "doc_id",
    text: str = "text",
    block_words: int = 64,
    shards: int = 64,
    seed: int = 0,
    keep_hash: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(texts, slots). texts: a row for each row of df with key, source, size, source_size, target, index and start. slots:
    (shard, slot, index, block), a row for each slot of the mix; block b of a source holds its words b * block_words on.
    keep_hash: texts also has _text, a hash of the text."""
    sized = stage(df.select(key, "source", word_count(text).alias("size"), F.xxhash64(text).alias("_text")), "sizes")
    sources = source_targets(sized, weights)
    texts = lay_out(sized, sources, key)
    texts = stage(texts if keep_hash else texts.drop("_text"), "texts")
    slots = deal_slots(plan_slots(df, sources, block_words, shards, seed), seed)
    return texts, slots


def pieces(texts: DataFrame, block_words: int) -> DataFrame:
    """texts with words, one row for each block that a text reaches into: block, begin and n (words within the text)."""
    last = (F.col("start") + F.col("size") - 1) / block_words
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(last)))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * block_words - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return texts.where(F.col("size") > 0).withColumn("block", blocks).withColumns({"begin": begin, "n": end - begin})


def placed_pieces(texts: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """pieces of the blocks that some slot takes, with times. Both sides are shuffled: what Spark knows of their sizes is that of
    compressed texts before they are cut, so it would send all pieces through the driver."""
    times = slots.groupBy("index", "block").agg(F.count(F.lit(1)).alias("times"))
    return pieces(texts, block_words).hint("merge").join(times.hint("merge"), ["index", "block"])


def taken_words(texts: DataFrame, slots: DataFrame, block_words: int = 64) -> DataFrame:
    """texts with taken, the words that the mix takes of each, repeats counted."""
    whole = placed_pieces(texts, slots, block_words).groupBy("index", "start").agg(F.sum(F.col("times") * F.col("n")).alias("_taken"))
    named = whole.withColumnRenamed("index", "_index").withColumnRenamed("start", "_start")
    on = (F.col("index") == F.col("_index")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return texts.join(named.hint("merge"), on, "left").withColumn("taken", F.coalesce(F.col("_taken"), F.lit(0)).cast("long")).drop("_index", "_start", "_taken")


def _cut(text: bytes, places: list[dict]) -> list[bytes]:
    """The parts of a text that blocks take: for each pass, the words of neighbouring taken blocks in one part."""
    start, end = word_spans(np.frombuffer(text, np.uint8))
    out = []
    for turn in range(1, max(p["times"] for p in places) + 1):
        run: list[int] | None = None
        for p in [*sorted((p for p in places if p["times"] >= turn), key=lambda p: p["begin"]), None]:
            if run and (p is None or p["begin"] != run[1]):
                whole = run[0] == 0 and run[1] == len(start)
                out.append(text if whole else text[start[run[0]] : end[run[1] - 1]])
                run = None
            if p is not None:
                run = [run[0] if run else p["begin"], p["begin"] + p["n"]]
    return out


def mixed_documents(df: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), key: str = "doc_id", text: str = "text", block_words: int = 256, shards: int = 64, seed: int = 0) -> DataFrame:
    """The mix as rows of df's columns: text holds the words that a pass of the mix takes of a row, as far as they are
    connected; a row that is taken whole n times comes n times. n_chars, where there is such a column, is set anew.
    White space within a part is the text's own. Rows alike in key, source and text count as often as they come."""
    texts, slots = mix_sources(df, weights, key, text, block_words, shards, seed, keep_hash=True)
    places = placed_pieces(texts, slots, block_words)
    mine = places.groupBy(F.col(key).alias("_key"), F.col("_text").alias("_hash"), F.col("source").alias("_source")).agg(F.collect_list(F.struct("start", "begin", "n", "times")).alias("_places"))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = df.join(mine, on).drop("_key", "_source").dropDuplicates([key, "_hash", "source"]).drop("_hash")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, parts = [], []
            for i, (t, places) in enumerate(zip(batch.column(text), batch.column("_places"), strict=True)):
                own: dict[int, list[dict]] = {}
                for p in places.as_py():
                    own.setdefault(p["start"], []).append(p)
                raw = t.as_py().encode()
                for _, ps in sorted(own.items()):
                    cut = _cut(raw, ps)
                    parts += [c.decode() for c in cut]
                    which += [i] * len(cut)
            out = batch.drop_columns(["_places"]).take(pa.array(which, pa.int64()))
            new = {text: pa.array(parts, batch.schema.field(text).type), "n_chars": pa.array([len(p) for p in parts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(name, column) for name, column in zip(out.schema.names, out.columns, strict=True)], names=out.schema.names)

    kinds = ", ".join(f"`{f.name}` {'bigint' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(taken, kinds)
