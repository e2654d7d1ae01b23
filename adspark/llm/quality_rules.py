"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined cases: a null text is an empty text; a text without words has zero counts and fails the base rule; ties and
repeated rows are judged row by row; an empty table gives an empty result; other columns of the input pass through, and
of a clashing name the computed column is the one that stays. No shuffle: every figure of a row comes from that row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import words_of

# Very frequent words of the languages handled.
STOP_WORDS = (
    "the a an and of to in is it that for on with as was be by at are this from or "
    "der die das und ist nicht ein eine zu den von mit sich auf dem im für als auch "
    "le la les de des du et un une est en que qui dans pour pas sur par au ce il elle plus "
    "el los las y que se una por con para su al lo como del no es"
).split()

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """measure must lie within [low, high]; a missing bound holds nothing back."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict beside the base rule.
RULES = (
    Rule("chars_per_word", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.01, None),
    Rule("duplicate_line_ratio", None, 0.4),
)


def _let(value: Column, body) -> Column:
    """Bind value to a name inside an expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that stand in a window of `width` words found twice or more in the array, the first place included.

    Windows are compared by 64-bit hashes, put together by doubling: words, pairs, fours, eights (width must be a power
    of two). Sorted order puts equal ones side by side; each place of a repeated window then covers the words up to the
    next such place, `width` at most."""

    def windows(w: Column) -> Column:
        def doubled(h: Column, span: int) -> Column:
            if span == width:
                return F.slice(h, 1, F.size(h) - (width - 1))
            return _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + span))), lambda wider: doubled(wider, 2 * span))

        return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: doubled(h, 1))

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def places(found: Column) -> Column:
        # place i of an array holds the window that begins at word i
        pairs = F.array_sort(F.transform(found, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["s"] == x["s"]) | (F.get(s, k + 1)["s"] == x["s"])
            marked = F.transform(s, lambda x, k: F.when(F.coalesce(same(x, k), F.get(s, k + 1)["s"] == x["s"], F.get(s, k - 1)["s"] == x["s"], F.lit(False)), x["i"]))
            return _let(F.array_sort(F.filter(marked, lambda i: i.isNotNull())), covered)

        return _let(pairs, again)

    counted = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(places(found))
    return F.when(F.size(words) <= width, 0).otherwise(_let(windows(words), counted)).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the figures that rules refer to."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    stop = F.filter("_words", lambda w: w.isin(*STOP_WORDS))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(stop).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_words", "_lines")
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return df.withColumns(
        {
            "chars_per_word": over("word_chars", "n_words"),
            "symbols_per_word": over("n_symbols", "n_words"),
            "stop_word_ratio": over("n_stop_words", "n_words"),
            "duplicate_line_ratio": over("n_dup_lines", "n_lines"),
        }
    )


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """df with its measures, base_failed (too few words, or too many repeated ones), failed_rules and kept."""
    df = measures(df, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        broken.append(F.when(bad, F.lit(r.measure)))
    df = df.withColumns({"base_failed": base, "failed_rules": F.filter(F.array(*broken), lambda x: x.isNotNull())})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
