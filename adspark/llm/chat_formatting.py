"""Chat formatting: cumulative snapshots are collapsed, then the conversations that remain are rendered.

Loggers often store a conversation anew after every turn, so that most records are prefixes of longer ones. Each turn
gets a hash of its conversation up to it; a conversation whose last hash stands inside a longer one is dropped.

Defined cases: null roles and texts are empty strings and differ from no empty string; null conv_ids form one
conversation; turns are ordered by turn (null first), then role and text, so that repeated turn numbers have one order;
of equal conversations the smallest conv_id stays (null first); an empty table gives an empty result; other columns of
the input are not read. A conversation of more than BLOCK turns is rendered in several rows, its parts, so that no row and no
task has to hold it whole. Turns of one conversation that share a turn number are ordered in one task. DataFrame
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.common import running_offset, stage

#: Turns of one conversation that are ordered and rendered together.
BLOCK = 4096


def _digest(*parts: Column) -> Column:
    """Two 62-bit numbers from the MD5 of parts, as decimals whose sums stay exact."""
    held = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    text = F.concat_ws("\x1f", *(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in held))
    number = lambda at: F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("decimal(20,0)")
    return F.struct(number(1).alias("a"), number(17).alias("b"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, pos (from 1), part (of BLOCK turns), role, text and the digest (a, b) of pos, role and text."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select("conv_id", "turn", "role", "text").withColumns({"_block": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK), "_one": F.lit(1).cast("long")})
    rows = running_offset(rows, ["conv_id"], "_block", order, "_one", "_before").withColumn("pos", F.col("_before") + 1)
    rows = rows.withColumn("_d", _digest(F.col("pos"), F.col("role"), F.col("text")))
    return rows.select("conv_id", "pos", F.floor((F.col("pos") - 1) / BLOCK).alias("part"), "role", "text", F.col("_d.a").alias("a"), F.col("_d.b").alias("b"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """One row a turn: conv_id, pos, n_turns and prefix, the hash of the turns up to this one.

    The rolling hash is the running sum of digests of (position, role, text): it needs order only through the position,
    so that sums of parts can be added up and no task has to hold or sort a whole conversation. Texts are not read."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv_id", "part").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("decimal(38,0)")
    starts = sums.select(
        F.col("conv_id").alias("_id"),
        F.col("part").alias("_part"),
        *(F.coalesce(F.sum(f"_{half}").over(before).cast("decimal(38,0)"), zero).alias(f"_before_{half}") for half in "ab"),
        F.sum("_n").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    joined = placed.select("conv_id", "pos", "part", "a", "b").join(starts, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos")
    upto = [(F.col(f"_before_{half}") + F.sum(half).over(inside)).cast("decimal(38,0)").cast("string") for half in "ab"]
    return joined.select("conv_id", "pos", "n_turns", F.concat_ws("-", *upto).alias("prefix"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each conversation that is no prefix of another; of equal ones the first."""
    ends = hashed.where(F.col("pos") == F.col("n_turns")).groupBy("prefix", "n_turns").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("set"), F.col("conv_id"))).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashed.where(F.col("pos") < F.col("n_turns")).select("prefix").distinct()
    return ends.join(inner, "prefix", "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_turns", "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part (int), n_turns, n_copies (equal conversations), n_chars (all long) and text of each maximal
    conversation, rendered turn by turn. Each BLOCK turns of a conversation are a part, a row of its own; texts of the
    parts in order make up the whole."""
    placed = stage(placed_turns(turns), "turns")
    kept = maximal(stage(prefix_hashes(placed), "prefixes")).select(F.col("conv_id").alias("_id"), "n_turns", "n_copies")
    rows = placed.select("conv_id", "pos", "part", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    turn = F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("t"))
    whole = rows.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda p: p["t"]), "")
    return whole.select("conv_id", F.col("part").cast("int").alias("part"), "n_turns", "n_copies", F.length(text).cast("long").alias("n_chars"), text.alias("text"))
