"""Sharding: jump consistent hashing of a stable key, in DataFrame expressions only.

Defined cases: a null key is the key '' (all its rows go to one shard, as one key must); repeated keys share a shard and
have slots of their own; texts of any length count with their bytes; an empty table gives an empty result; other columns
pass through, and of a clashing name the computed column is the one that stays. A shard's slots are dealt in two levels,
so no task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import running_offset

#: Fixed value: the multiplier of the 64-bit linear congruential generator of jump consistent hashing.
MULTIPLIER = 2862933555777941757
#: Parts of a shard whose slots are dealt apart from each other.
PARTS = 1024


def key_halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a 64-bit hash of the key's text, each as a non-negative long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def jump_shard(high: Column, low: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key given in halves.

    The generator's product is put together from 16-bit limbs of the multiplier, as a long product would overflow. From
    one candidate shard the next is drawn further on; the last one below `shards` is the result, so with one shard more
    a key either stays or moves to the new one."""
    m0, m1, m2, m3 = (F.lit(MULTIPLIER >> s & 0xFFFF).cast("long") for s in (0, 16, 32, 48))
    word = F.lit(0xFFFFFFFF).cast("long")
    bits16 = F.lit(0xFFFF).cast("long")
    up = lambda x, n: F.shiftleft(x, n)
    down = lambda x, n: F.shiftright(x, n)

    def drawn(h: Column, x: Column, b: Column) -> Column:
        first, second = x * m0, x * m1
        sums = first + up(second.bitwiseAND(bits16), 16) + 1
        upper = down(sums, 32) + down(second, 16) + x * m2 + up((x * m3).bitwiseAND(bits16), 16) + h * m0 + up((h * m1).bitwiseAND(bits16), 16)
        return F.struct(upper.bitwiseAND(word).alias("h"), sums.bitwiseAND(word).alias("x"), b.alias("b"))

    def further(s: Column) -> Column:
        return F.floor((s["b"] + 1) * (F.lit(2.0**31) / (down(s["h"], 1) + 1))).cast("long")

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)),
        drawn(high, low, F.lit(0).cast("long")),
        lambda s, _: F.when(further(s) >= shards, s).otherwise(drawn(s["h"], s["x"], further(s))),
        lambda s: s["b"].cast("int"),
    )


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with size (UTF-8 bytes of the text and 16 for the record), text_crc32, law, shard and grown_shard (the shard
    if there were one more)."""
    high, low = key_halves(F.col(key))
    held = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumns({"size": (F.octet_length(held) + 16).cast("long"), "text_crc32": F.crc32(held), "_high": high, "_low": low})
        .withColumns({"law": F.lit("key"), "shard": jump_shard(F.col("_high"), F.col("_low"), shards), "grown_shard": jump_shard(F.col("_high"), F.col("_low"), shards + 1)})
        .drop("_high", "_low")
    )


def number_slots(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with slot, which numbers each shard's rows from 0 without gaps; rows that are alike in all of key, text_crc32
    and size are interchangeable. Parts are dealt by key and text, so copies under one key are dealt over them too."""
    name = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    part = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % PARTS).cast("int")
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return running_offset(df.withColumns({"_part": part, "_one": F.lit(1).cast("long")}), ["shard"], "_part", order, "_one", "slot").drop("_part", "_one")


def write_shards(df: DataFrame, path: str, shards: int, files_per_shard: int = 16, key: str = "doc_id", text: str = "text") -> None:
    """Write df to path with a folder for each shard. A shard's rows are dealt over files_per_shard tasks."""
    dealt = assign_shards(df, shards, key, text)
    salt = F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(files_per_shard))
    dealt.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
