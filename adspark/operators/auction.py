"""Bids, clearing, budgets, pacing and value selection."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.expressions import clip, safe_divide, stable_hash
from adspark.operators.ordering import HASH_PARTS_SHIFT, exact_quantiles, numbered, running
from adspark.sources.staging import shared_folder, staged

EPSILON = 1e-12


def attribution_scores(df: DataFrame, click: str = "raw_pctr", both: str = "raw_pctcvr") -> DataFrame:
    """df with score_pctr, score_pctcvr (within 1e-7 of 0 and 1) and score_pcvr, their ratio in [0, 1]."""
    a, b = clip(click, 1e-7, 1 - 1e-7), clip(both, 1e-7, 1 - 1e-7)
    return df.withColumns({"score_pctr": a, "score_pctcvr": b, "score_pcvr": clip(b / a, 0.0, 1.0)})


def expected_value(p: Column, value: Column) -> Column:
    return clip(p, 0.0, 1.0) * F.greatest(value, F.lit(0.0))


def target_cpa_bid(p: Column, target: float, scale: float = 1.0) -> Column:
    return clip(p, 0.0, 1.0) * target * scale


def value_bid(p: Column, value: Column, target_roas: float, scale: float = 1.0) -> Column:
    return clip(p, 0.0, 1.0) * F.greatest(value, F.lit(0.0)) / target_roas * scale


def policy_bids(df: DataFrame, base: float, value: str | None = None) -> DataFrame:
    """df with bid_fixed, bid_ctr and bid_ctcvr, and bid_value (scaled by the exact 95 % quantile of the value, negative values
    and missing ones counting as 0)."""
    bids = {"bid_fixed": F.lit(base), "bid_ctr": base * clip("score_pctr", 0.0, 1.0), "bid_ctcvr": base * clip("score_pctcvr", 0.0, 1.0)}
    if value is None:
        return df.withColumns(bids)
    held = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    scale = exact_quantiles(df.select(held.alias("_v")), "_v", (0.95,)).select(F.col("value").alias("_q"))
    scaled = F.coalesce(F.try_divide(held, F.col("_q")), F.lit(0.0))
    return df.crossJoin(F.broadcast(scale)).withColumns({**bids, "bid_value": base * clip(scaled, 0.0, 1.0)}).drop("_q")


def clear_auctions(df: DataFrame, quality: str, bid: str, key: str = "event_id") -> DataFrame:
    """A row an auction: winner, its bid, rank_score, quality, first and second price. The best score wins, ties by key; the
    second price is what the winner had to bid to keep its place, at most its bid; alone, that is its own bid."""
    score = F.greatest(F.col(quality), F.lit(0.0)) * F.greatest(F.col(bid), F.lit(0.0))
    order = Window.partitionBy("auction_id").orderBy(F.desc("rank_score"), key)
    rows = df.withColumn("rank_score", score).withColumns({"_r": F.row_number().over(order), "_next": F.lead("rank_score").over(order)}).where("_r = 1")
    second = F.least(F.greatest(F.col(bid), F.lit(0.0)), F.coalesce("_next", "rank_score") / F.greatest(F.col(quality), F.lit(EPSILON)))
    return rows.select("auction_id", F.col(key).alias("winner"), F.col(quality).alias("quality"), F.greatest(F.col(bid), F.lit(0.0)).alias("winning_bid"), "rank_score", second.alias("second_price"))


def feedback_multiplier(current: float, elapsed: float, spent: float, budget: float, low: float, high: float, alpha: float) -> float:
    """The next pacing multiplier: lowered when the spent share of the budget is ahead of the elapsed share of time."""
    pace = min(max(elapsed, 0.0), 1.0) / max(spent / budget, 0.0, EPSILON)
    return min(high, max(low, current * pace**alpha))


#: Auctions that one task folds one after the other.
FOLDED = 1 << 18
_KINDS = "policy string, budget double, auction_id long, won int, payment double, cumulative_spend double, pacing_multiplier double"


def in_auction_order(cleared: DataFrame, price: str = "second_price") -> DataFrame:
    """(policy, auction_id, price, place, _part) with each policy's auctions numbered from 0."""
    rows = cleared.select("policy", "auction_id", F.col(price).alias("price"))
    placed = numbered(rows, [F.col("policy"), F.col("auction_id")], "_at", keep_part=True)
    first = placed.groupBy("policy").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    return staged(placed.join(F.broadcast(first), "policy").withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first"), "auctions")


def _left_to_right(prices: list[float], left: float) -> tuple[list[int], float]:
    """(places of the prices that fit in order, what is left then)."""
    won = []
    for i, p in enumerate(prices):
        if p <= left + EPSILON:
            won.append(i)
            left -= p
    return won, left


def budget_phases(rows: DataFrame, budget: float) -> tuple[list[tuple[int, int, float]], list[int]]:
    """(phases, places): how a budget is spent on one policy's auctions. A phase (first, last, left) says that of the places
    first to last - 1 those are won whose price is at most left; the places are those won after the last phase.

    What is left never grows, so within a phase only prices up to it matter. Sums of ranges show where these prices first
    exceed it; there one auction is lost and the next phase begins. When few enough auctions still matter, they are
    folded here, FOLDED at most."""
    phases, at, left = [], 0, budget
    while True:
        matter = rows.where((F.col("place") >= at) & (F.col("price") <= left + EPSILON))
        sums = matter.groupBy("_part").agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
        if sum(r["n"] for r in sums) <= FOLDED:
            held = matter.select("place", "price").orderBy("place").collect()
            return phases, [held[i]["place"] for i in _left_to_right([r["price"] for r in held], left)[0]]
        before, edge = 0.0, None
        for r in sums:
            if before + r["s"] > left + EPSILON:
                edge = r["_part"]
                break
            before += r["s"]
        if edge is None:
            return [*phases, (at, 1 << 62, left)], []
        upto = F.sum("price").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one range
        over = matter.where(F.col("_part") == edge).withColumn("_upto", upto).where(F.col("_upto") + before > left + EPSILON)
        first = over.orderBy("place").select("place", (F.col("_upto") - F.col("price")).alias("s")).first()
        phases.append((at, first["place"], left))
        at, left = first["place"] + 1, left - before - first["s"]


def won_places(rows: DataFrame, phases: list[tuple[int, int, float]], places: list[int]) -> DataFrame:
    """rows with won, by what budget_phases gave."""
    fits = F.lit(False)
    for first, last, left in phases:
        fits = fits | (F.col("place").between(first, last - 1) & (F.col("price") <= left + EPSILON))
    late = rows.sparkSession.createDataFrame([(p,) for p in places], "place long").withColumn("_late", F.lit(1))
    return rows.join(F.broadcast(late), "place", "left").withColumn("won", (fits | F.col("_late").isNotNull()).cast("int")).drop("_late")


def spend(cleared: DataFrame, budgets: list[float], price: str = "second_price", pacing: tuple[float, float, float] | None = None) -> DataFrame:
    """(policy, budget, auction_id, won, payment, cumulative_spend, pacing_multiplier). Auctions are taken in order; one
    whose price exceeds what is left of the budget is lost and costs nothing, and later, cheaper ones may still be won.
    pacing = (low, high, alpha) multiplies all bids of an auction by a multiplier that feedback adjusts; as it is common
    to an auction, the winner is the same and its price scales. cleared has policy."""
    rows = in_auction_order(cleared, price)
    if pacing is not None:
        return _fold_chunks(rows, budgets, _feedback_fold(*pacing), float(min(pacing[1], max(pacing[0], 1.0))))
    out = None
    for policy in [r["policy"] for r in rows.select("policy").distinct().orderBy("policy").collect()]:  # few by definition
        mine = rows.where(F.col("policy") == policy)
        for budget in budgets:
            won = won_places(mine, *budget_phases(mine, budget))
            won = won.withColumns({"budget": F.lit(float(budget)), "payment": F.when(F.col("won") == 1, F.col("price")).otherwise(0.0)})
            summed = running(won, [F.col("place")], {"cumulative_spend": "payment"}, dealt_before=True)
            one = summed.select("policy", "budget", "auction_id", "won", "payment", "cumulative_spend", F.lit(1.0).alias("pacing_multiplier"))
            out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], _KINDS) if out is None else out


def _feedback_fold(low: float, high: float, alpha: float):
    def step(spent: float, now: float, place: int, n: int, price: float, budget: float) -> tuple[int, float, float, float, float]:
        ok = spent + price * now <= budget + EPSILON
        paid = price * now if ok else 0.0
        spent += paid
        return int(ok), paid, spent, now, feedback_multiplier(now, (place + 1) / n, spent, budget, low, high, alpha)

    return step


def _static_fold(low: float, high: float):
    def step(spent: float, _: float, place: int, n: int, price: float, budget: float) -> tuple[int, float, float, float, float]:
        now = min(high, max(low, budget * (place + 1) / n / max(spent, EPSILON)))
        spent += price * now
        return 1, price * now, spent, now, now

    return step


def _fold_chunks(rows: DataFrame, budgets: list[float], step, multiplier: float) -> DataFrame:
    """Fold each (policy, budget) in order, FOLDED auctions at a time: what goes on from chunk to chunk is what was spent and
    the multiplier, read back from the written chunk."""
    spark = rows.sparkSession

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        budget, n = float(pdf["budget"].iloc[0]), int(pdf["n"].iloc[0])
        spent, now, out = float(pdf["spent"].iloc[0]), float(pdf["next"].iloc[0]), []
        for place, p in zip(pdf["place"].tolist(), pdf["price"].tolist(), strict=True):
            won, paid, spent, used, now = step(spent, now, place, n, p, budget)
            out.append((won, paid, spent, used, now))
        return pdf[["policy", "budget", "auction_id", "place"]].join(pd.DataFrame(out, columns=["won", "payment", "cumulative_spend", "pacing_multiplier", "next"]))

    last = rows.agg(F.max("place")).first()[0]
    if last is None:
        return spark.createDataFrame([], _KINDS)
    names = [r["policy"] for r in rows.select("policy").distinct().collect()]
    state, path = [(p, float(b), 0.0, multiplier) for p in names for b in budgets], f"{shared_folder(spark)}/folded-{uuid.uuid4().hex}"
    for chunk, first in enumerate(range(0, last + 1, FOLDED)):  # every chunk goes to one table
        held = F.broadcast(spark.createDataFrame(state, "policy string, budget double, spent double, next double"))
        mine = rows.where(F.col("place").between(first, first + FOLDED - 1)).join(held, "policy")
        mine.groupBy("policy", "budget").applyInPandas(fold, f"{_KINDS}, place long, next double").write.parquet(f"{path}/chunk={chunk}")
        done = spark.read.parquet(f"{path}/chunk={chunk}")
        ends = done.groupBy("policy", "budget").agg(F.max_by("cumulative_spend", "place"), F.max_by("next", "place")).collect()
        going = {tuple(r)[:2]: tuple(r) for r in ends}
        state = [going.get(s[:2], s) for s in state]
    return spark.read.parquet(path).drop("place", "next", "chunk")


def static_pacing(cleared: DataFrame, budgets: list[float], low: float, high: float, price: str = "second_price") -> DataFrame:
    """As spend, with the multipliers of a spend that is linear in time: the budget's share so far over what was spent so far,
    within bounds; every auction is won."""
    return _fold_chunks(in_auction_order(cleared, price), budgets, _static_fold(low, high), 1.0)


def spend_summary(curve: DataFrame, early: float = 0.9, exhausted: float = 0.99) -> DataFrame:
    """(policy, budget): auctions, win rate, spend, utilisation, the share of the horizon after which that share of the budget
    was used up (null if it never was), and whether that was early."""
    gone = F.col("cumulative_spend") >= F.col("budget") * exhausted
    # auctions before the budget is used up, and the one that uses it
    until = F.when(F.count_if(gone) > 0, (F.count_if(~gone) + 1) / F.count(F.lit(1)))
    out = curve.groupBy("policy", "budget").agg(F.count(F.lit(1)).alias("auctions"), F.avg("won").alias("win_rate"), F.max("cumulative_spend").alias("spend"), until.alias("exhausted_at"))
    return out.withColumns({"utilisation": safe_divide("spend", "budget"), "exhausted_early": F.coalesce(F.col("exhausted_at") < early, F.lit(False))})


def spend_trajectory(curve: DataFrame, buckets: int = 10) -> DataFrame:
    """(policy, budget, bucket, horizon, spent, impressions, remaining, smoothness) at the ends ceil(n * bucket / buckets) of
    equal parts of the horizon, as shares: of auctions, of the budget spent, of all won auctions, of the budget left.
    smoothness is the mean distance of spent and horizon. A bucket without an auction of its own repeats the end before."""
    numbers = numbered(curve, [F.col("policy"), F.col("budget"), F.col("auction_id")], "_at")
    size = numbers.groupBy("policy", "budget").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_won"))
    ends = F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("bucket")
    asked = size.select("policy", "budget", "_first", "_n", "_won", ends).withColumn("_end", F.ceil(F.col("_n") * F.col("bucket") / buckets))
    rows = numbers.select("policy", "budget", "_at", "won", "cumulative_spend").join(F.broadcast(asked), ["policy", "budget"])
    inside = rows.where(F.col("_at") - F.col("_first") < F.col("_end"))
    sums = inside.groupBy("policy", "budget", "bucket", "_n", "_won", "_end").agg(F.max("cumulative_spend").alias("_spend"), F.sum("won").alias("_wins"))
    spent = F.try_divide("_spend", "budget")
    out = sums.select(
        "policy", "budget", "bucket",
        (F.col("_end") / F.col("_n")).alias("horizon"),
        spent.alias("spent"),
        (F.col("_wins") / F.greatest("_won", F.lit(1))).alias("impressions"),
        F.try_divide(F.greatest(F.col("budget") - F.col("_spend"), F.lit(0.0)), F.col("budget")).alias("remaining"),
    )
    return out.withColumn("smoothness", F.avg(F.abs(F.col("spent") - F.col("horizon"))).over(Window.partitionBy("policy", "budget")))


def won_metrics(curve: DataFrame, cleared: DataFrame, candidates: DataFrame, key: str = "event_id") -> DataFrame:
    """(policy, budget): spend_summary's figures of curve with those of the rows that won: click rate, conversion rate, spend for
    each conversion and the sum of their own costs. cleared names each auction's winner, candidates has the rows."""
    won = curve.where("won = 1").join(cleared.select("policy", "auction_id", "winner"), ["policy", "auction_id"])
    rows = won.join(candidates.select(F.col(key).alias("winner"), "click", "conversion", "cost"), "winner")
    by = rows.groupBy("policy", "budget").agg(
        F.count(F.lit(1)).alias("impressions"), F.avg("click").alias("click_rate"), F.avg("conversion").alias("conversion_rate"),
        F.try_divide(F.sum("payment"), F.sum("conversion")).alias("cpa"), F.sum("cost").alias("observed_cost"),
    )
    return spend_summary(curve).join(by, ["policy", "budget"], "left")


def selection(df: DataFrame, policies: dict[str, Column], fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0), key: str = "event_id", label: str = "conversion_label", value: str = "conversion_value_eur", seed: int = 2026) -> DataFrame:
    """(policy, fraction, selected, conversions, conversion_rate, value, value_per_click, value_capture, conversion_capture,
    value_lift, capture_lift): the best ceil(n * fraction) rows by each policy, ties by key. Values below 0 and missing ones
    count as 0. Lifts are over random_baseline, rows in the order of a hash of the seed and the key."""
    base = df.select(F.col(key).alias("k"), F.coalesce(F.col(label), F.lit(0)).alias("y"), F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)).alias("v"), *(F.round(F.coalesce(s, F.lit(0.0)), 9).alias(f"s_{n}") for n, s in policies.items()))
    base = staged(base, "selection")  # each order and the totals read it
    totals = F.broadcast(base.agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_c"), F.sum("v").alias("_v")))
    hashed = stable_hash(F.lit(seed), F.col("k"))
    out = _first_sums(base.select("k", "y", "v", F.shiftright(hashed, HASH_PARTS_SHIFT).alias("g")), F.col("g"), [hashed, F.col("k")], totals, fractions).withColumn("policy", F.lit("random_baseline"))
    for name in policies:
        rows = base.select("k", "y", "v", F.col(f"s_{name}").alias("g"))
        out = out.unionByName(_first_sums(rows, F.desc("g"), [F.col("k")], totals, fractions).withColumn("policy", F.lit(name)))
    out = out.select("policy", "fraction", "selected", "conversions", "value", "_c", "_v")
    rates = {"conversion_rate": ("conversions", "selected"), "value_per_click": ("value", "selected"), "value_capture": ("value", "_v"), "conversion_capture": ("conversions", "_c")}
    out = out.withColumns({n: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for n, (a, b) in rates.items()})
    first = Window.partitionBy("fraction")  # one row a policy
    baseline = lambda c: F.max(F.when(F.col("policy") == "random_baseline", F.col(c))).over(first)
    return out.withColumns({"value_lift": F.try_divide("value_per_click", baseline("value_per_click")), "capture_lift": F.try_divide("value_capture", baseline("value_capture"))}).drop("_c", "_v")


def _first_sums(rows: DataFrame, order: Column, ties: list[Column], totals: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """(fraction, selected, conversions, value, _c, _v): sums of y and v over the first ceil(n * fraction) rows (k, y, v, g) by g and
    then by ties. Rows are counted by g, and only those of the few g that a fraction cuts are put in order."""
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("y"), F.sum("v").alias("v"))
    placed = staged(running(sums, [order], {"upto": "n"}), "placed").crossJoin(totals).where("_n > 0")
    most = {i: F.greatest(F.ceil(F.col("_n") * f), F.lit(1)).cast("long") for i, f in enumerate(fractions)}
    before = F.col("upto") - F.col("n")
    wholly = lambda c: [F.sum(F.when(F.col("upto") <= m, F.col(c))).alias(f"{c}{i}") for i, m in most.items()]
    whole = placed.groupBy("_n", "_c", "_v").agg(*wholly("n"), *wholly("y"), *wholly("v"))
    cut = placed.where(reduce(or_, ((before < m) & (F.col("upto") > m) for m in most.values())))  # at most one g a fraction
    cut = cut.select("g", "upto", "n", "_n", F.sum("n").over(Window.orderBy("upto").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    tied = numbered(rows.join(F.broadcast(cut.select("g")), "g"), [order, *ties], "place").join(F.broadcast(cut), "g")
    place = before + F.col("place") - F.coalesce("_ahead", F.lit(0))
    taken = {i: (before < m) & (F.col("upto") > m) & (place < m) for i, m in most.items()}
    part = tied.agg(*(x for i, t in taken.items() for x in (F.count_if(t).alias(f"pn{i}"), F.sum(F.when(t, F.col("y"))).cast("long").alias(f"py{i}"), F.sum(F.when(t, F.col("v"))).alias(f"pv{i}"))))
    both = lambda c, i: F.coalesce(f"{c}{i}", F.lit(0)) + F.coalesce(f"p{c}{i}", F.lit(0))
    rows_out = F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), both("n", i).alias("selected"), both("y", i).alias("conversions"), both("v", i).alias("value")) for i, f in enumerate(fractions)))).alias("x")
    return whole.crossJoin(F.broadcast(part)).select("_c", "_v", rows_out).select("x.*", "_c", "_v")  # single rows


def winner_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: auctions, and how many have another winner under b than under a."""
    both = a.select("auction_id", F.col("winner").alias("x")).join(b.select("auction_id", F.col("winner").alias("y")), "auction_id")
    return both.agg(F.count(F.lit(1)).alias("auctions"), F.count_if(F.col("x") != F.col("y")).alias("changed"))


def policy_grid(cleared: DataFrame, budgets: list[float], pacing: tuple[float, float, float]) -> DataFrame:
    """spend's rows with pacing, no_pacing or feedback, of every policy and budget: all see the same auctions in one order."""
    plain = spend(cleared, budgets).withColumn("pacing", F.lit("no_pacing"))
    return staged(plain.unionByName(spend(cleared, budgets, pacing=pacing).withColumn("pacing", F.lit("feedback"))), "grid")


def pacing_comparison(grid: DataFrame, buckets: int = 10) -> DataFrame:
    """spend_summary's figures and the smoothness of every policy, budget and way of pacing."""
    out = None
    for mode in ("no_pacing", "feedback"):
        curve = grid.where(F.col("pacing") == mode).drop("pacing")
        smooth = spend_trajectory(curve, buckets).groupBy("policy", "budget").agg(F.max("smoothness").alias("smoothness"))
        one = spend_summary(curve).join(smooth, ["policy", "budget"]).withColumn("pacing", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out
