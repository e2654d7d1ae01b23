"""Sums over neighbours: brute force, rows sent only where they are needed, and few cells among many."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adspark.operators import neighbours, recall


def brute(data):
    rows, norm = defaultdict(dict), defaultdict(float)
    for u, i, w in data:
        rows[u][i] = w
        norm[i] += w * w
    sims = defaultdict(float)
    for r in rows.values():
        for i, a in r.items():
            for j, b in r.items():
                if i != j:
                    sims[i, j] += a * b / math.sqrt(norm[i] * norm[j])
    scores = defaultdict(float)
    for u, r in rows.items():
        for (i, j), s in sims.items():
            if i in r and j not in r:
                scores[u, j] += r[i] * s
    return sims, scores


def communities(n):
    rng = random.Random(5)
    return [(f"u{c}_{u}", f"p{c}_{p}", float(rng.choice((1, 3)))) for c in range(n) for u in range(4) for p in range(6) if rng.random() < 0.5]


@pytest.mark.parametrize("most", [1 << 22, 16])
def test_against_brute_force(spark, monkeypatch, most):
    data = communities(40)  # a user meets few of all products: their cells are sorted, not laid out
    monkeypatch.setattr(recall, "CELL_PAIRS", most)
    pairs = spark.createDataFrame(data, "user_id string, product_id string, weight double")
    sims, scores = brute(data)
    got = {r.item: (r.neighbours, r.best, r.total) for r in recall.similarity_totals(pairs).collect()}
    for i in {i for i, _ in sims}:
        mine = [s for (a, _), s in sims.items() if a == i]
        assert got.pop(i) == (len(mine), pytest.approx(max(mine)), pytest.approx(sum(mine)))
    assert not got
    want = []
    for u in {u for u, *_ in data}:
        best = sorted((-round(s, 9), c) for (v, c), s in scores.items() if v == u)[:2]
        want += [(u, c, -s, n + 1) for n, (s, c) in enumerate(best)]
    found = recall.itemcf(pairs, pairs.select("user_id"), 2).collect()
    assert sorted(tuple(r) for r in found) == [(u, c, pytest.approx(s), n) for u, c, s, n in sorted(want)]


def test_rows_go_only_where_they_are_needed(spark):
    data = communities(12)
    pairs = spark.createDataFrame(data, "user_id string, product_id string, weight double")
    _, entries, rows = neighbours.packed(pairs)
    asked = entries.groupBy("user_id").agg(F.collect_list(F.struct("i", F.col("weight").alias("x"))).alias("row"), F.sum("n").alias("load"))
    asked = asked.withColumn("block", F.substring_index(F.substring("user_id", 2, 9), "_", 1).cast("int"))  # a block a community
    assert neighbours.needed(asked, entries).count() == rows.count() == len({u for u, *_ in data})


def test_sweep_makes_variants_after_the_shuffle(spark):
    """Each variant's order by hand, and no shuffle of rows that are there once a variant."""
    lists = [("u", "a", "itemcf", 1), ("u", "b", "itemcf", 2), ("u", "b", "popularity", 1), ("v", "c", "popularity", 1), ("u", "d", "popularity", 2)]
    every = spark.createDataFrame(lists, "user_id string, candidate_ad_id string, source string, rank long")
    top = recall.swept(every, [("even", 10.0, 1.0, 1.0, 1.0), ("items", 10.0, 9.0, 1.0, 1.0)], 2)
    assert "hashpartitioning(variant" not in top._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.variant, r.user_id, r["rank"], r.candidate_ad_id, r.score) for r in top.collect())
    even = [("even", "u", 1, "b", round(1 / 12 + 1 / 11, 12)), ("even", "u", 2, "a", round(1 / 11, 12)), ("even", "v", 1, "c", round(1 / 11, 12))]
    assert got == [*even, ("items", "u", 1, "b", round(9 / 12 + 1 / 11, 12)), ("items", "u", 2, "a", round(9 / 11, 12)), ("items", "v", 1, "c", round(1 / 11, 12))]
    positives = spark.createDataFrame([("u", "a"), ("u", "z"), ("w", "a")], "user_id string, product_id string")
    found = {(r.variant, r.cutoff): (r.recall, r.hit_rate) for r in recall.fusion_sweep(every, positives, [("even", 10.0, 1.0, 1.0, 1.0)], (1, 2)).collect()}
    assert found == {("even", 1): (0.0, 0.0), ("even", 2): (0.25, 0.5)}
