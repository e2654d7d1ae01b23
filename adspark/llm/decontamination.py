"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items, in DataFrame expressions only.

Each item gives windows of `window` consecutive words (a shorter item is one window). A document contains a window only
if it contains all of the window's word shingles, so it is enough to join on one shingle of each: its prefix, the rarest
one by documents. Where a shingle stands in the window gives the place where the window would begin in the document;
that place must leave room before and after (length and positional bounds), and the words there are compared.

Equal windows of several items are one window with a list of items, and equal texts are searched and compared once; what is
found joins the documents by a digest of their texts, which is written first, so that many copies can be dealt over tasks.

Defined cases: null texts have no words; an item without words has no windows; a null item id stands as the empty string; repeated rows are judged alike; empty tables
give zero hits or an empty result; of the input only the key, the text and columns asked for are read. Tables are broadcast
only below a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.common import stage

#: Anything but ASCII digits and letters and non-ASCII characters parts words; A-Z are lowered before.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lowered.
PARTING_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hashes of shingles or digests of texts that may be broadcast: 16 to 100 bytes each.
BROADCAST_ROWS = 1_000_000


def item_words(text: Column) -> Column:
    """Words with A-Z lowered; lower() itself is used where there are ASCII characters only."""
    held = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(held) == F.length(held), F.lower(held)).otherwise(F.translate(held, UPPER, UPPER.lower()))
    return F.filter(F.split(low, PARTING), lambda w: w != "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hash of each shingle of `width` words, by the place where it begins."""

    def joined(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    empty = F.array().cast("array<bigint>")
    return F.when(F.size(words) < width, empty).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), joined))


def word_count(text: Column) -> Column:
    """Number of item_words as a long."""

    def counted(parts: Column) -> Column:
        first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return (F.size(parts) - first - last).cast("long")

    return _let(F.split(F.coalesce(text, F.lit("")), PARTING_CASED), counted)


def windows_of(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(wid, words, items): each distinct window with the items that have it."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    places = rows.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("place"))
    windows = places.select("item", F.slice("w", F.col("place"), F.col("size")).alias("words"))
    return windows.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), "words", "items")


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, words, width, offset, h): the shingles of each window; a window of fewer words is one shingle."""
    width = F.least(F.size("words"), F.lit(shingle))
    found = None
    for n in range(1, shingle + 1):
        part = windows.where(width == n).select("wid", "words", F.lit(n).alias("width"), F.posexplode(shingle_hashes(F.col("words"), n)).alias("offset", "h"))
        found = part if found is None else found.unionByName(part)
    return found


def _checked_broadcast(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_shingles(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(text, n_words, width, h, pos): where texts have a shingle of the benchmark; text is the text's digest."""
    widths = [r["width"] for r in shingles.select("width").distinct().orderBy("width").collect()]  # at most the shingle's width of them
    rows = docs.select(F.col("_digest").alias("text"), F.size("_w").cast("long").alias("n_words"), "_w")
    wanted = _checked_broadcast(shingles.select("width", "h").distinct())
    found = None
    for n in widths or [1]:
        part = rows.select("text", "n_words", F.lit(n).alias("width"), F.posexplode(shingle_hashes(F.col("_w"), n)).alias("pos", "h"))
        part = part.join(wanted, ["width", "h"], "left_semi")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def prefix_shingles(shared: DataFrame, shingles: DataFrame) -> DataFrame:
    """One shingle of each window: the one that stands in the fewest texts. Windows of which a shingle stands nowhere
    have no row: no text contains them."""
    rarity = shared.groupBy("width", "h").agg(F.count_distinct("text").alias("texts"))
    ranked = Window.partitionBy("wid").orderBy("texts", "h", "offset")
    known = shingles.join(rarity, ["width", "h"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    return known.withColumn("_rank", F.row_number().over(ranked)).where((F.col("_rank") == 1) & (F.col("texts") > 0)).drop("_rank")


def _covered(found: Column) -> Column:
    """Words covered by windows given as structs of begin and n."""
    spans = F.array_sort(F.transform(found, lambda c: F.struct(c["begin"].alias("begin"), (c["begin"] + c["n"]).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["end"])
        return F.struct((a["n"] + end - F.least(end, F.greatest(a["end"], s["begin"]))).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def _verified(rows: DataFrame, possible: DataFrame) -> DataFrame:
    """(text, n_words, n_hit, wids): distinct texts, by digest, with possible windows, and which of these stand in them. Texts
    without any are left to the reader of the written table: a filter here would be moved before the splitting of words."""
    wanted = _checked_broadcast(possible.select("text"))
    texts = rows.join(wanted, F.col("_digest") == F.col("text"), "left_semi").select("_digest", "_text").dropDuplicates(["_digest"])
    judged = texts.join(possible, F.col("_digest") == F.col("text")).withColumn("_w", item_words(F.col("_text")))
    same = F.filter(F.col("_possible"), lambda c: F.slice(F.col("_w"), (c["begin"] + 1).cast("int"), c["n"].cast("int")) == c["words"])
    judged = judged.select("text", F.size("_w").cast("long").alias("n_words"), same.alias("_found"))
    wids = F.array_distinct(F.transform("_found", lambda c: c["wid"]))
    return judged.select("text", "n_words", _covered(F.col("_found")).cast("long").alias("n_hit"), wids.alias("wids"))


def find_hits(rows: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int, shingle: int) -> DataFrame:
    """(_of, _n_words, _n_hit, _items): digests of texts with an occurring window, and what they hold. rows has _text and
    _digest."""
    windows = stage(windows_of(items, item_key, item_text, window), "windows")
    shingles = stage(window_shingles(windows, shingle), "shingles")
    shared = stage(shared_shingles(rows.withColumn("_w", item_words(F.col("_text"))), shingles), "shared")
    prefix = prefix_shingles(shared, shingles).select("width", "h", "wid", "offset", "words")
    begin = (F.col("pos") - F.col("offset")).cast("long")
    candidates = shared.join(prefix, ["width", "h"]).withColumn("begin", begin).where((F.col("begin") >= 0) & (F.col("begin") + F.size("words") <= F.col("n_words")))
    window_at = F.struct("begin", F.size("words").cast("long").alias("n"), "wid", "words")
    possible = stage(candidates.groupBy("text").agg(F.collect_set(window_at).alias("_possible")), "possible")
    found = stage(_verified(rows, possible), "found").where("n_hit > 0")
    named = found.select("text", F.explode("wids").alias("wid")).join(windows.select("wid", "items"), "wid")
    lists = named.select("text", F.explode("items").alias("item")).groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    hits = found.select("text", F.col("n_words").alias("_n_words"), F.col("n_hit").alias("_n_hit")).join(lists, "text")
    return stage(hits.withColumnRenamed("text", "_of"), "hits")


def match_benchmark(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, others: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: key, text, the other columns asked for, n_words, n_hit (words inside an occurrence of a
    window) and items (ids as strings, sorted, of the items with occurring windows)."""
    others = others or []
    rows = docs.select(F.col(key), F.col(text).alias("_text"), *others).withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
    hits = find_hits(rows, items, item_key, item_text, window, shingle)
    judged = rows.join(hits, F.col("_digest") == F.col("_of"), "left")
    return judged.select(
        F.col(key),
        F.col("_text").alias(text),
        *others,
        F.when(F.col("_n_words").isNotNull(), F.col("_n_words")).otherwise(word_count(F.col("_text"))).alias("n_words"),
        F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(percent: int = 5) -> Column:
    """Whether a matched row counts as contaminated: at least `percent` of its words are hit, and one is."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
