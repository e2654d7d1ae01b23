"""Joins and lists that several steps of a query read are made once."""

import pytest
from pyspark.sql import functions as F

from adspark import queries
from adspark import queries_ranking  # noqa: F401  registers
from adspark import queries_temporal
from adspark.operators import auction, metrics, recall, sampling

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_personal_lists_are_made_once(spark):
    drawn = spark.range(20).select(F.expr("uuid()").alias("user_id"), F.lit("a").alias("candidate_ad_id"), F.lit(1).alias("rank"))
    popular = spark.createDataFrame([("b", 1)], "candidate_ad_id string, rank int")
    rows = recall.personalised({"itemcf": drawn}, popular).collect()
    users = {s: {r.user_id for r in rows if r.source == s} for s in ("itemcf", "popularity")}
    assert len(rows) == 40 and users["itemcf"] == users["popularity"]


def test_fused_lists_take_one_shuffle(spark):
    rows = spark.createDataFrame([("u", "a", "itemcf", 1), ("u", "b", "popularity", 1)], "user_id string, candidate_ad_id string, source string, rank long")
    text = recall.rrf(rows, {"itemcf": 1.0, "popularity": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["candidate_features", "coarse_top", "fine_top", "derived_rank", "positive_retention", "output_diagnostics", "prior_predictions", "seen_unseen_slices", "bucket_recall", "drawn_negatives", "past_halves", "pool_negatives"])
def test_interactions_are_joined_once(spark, name):
    assert "l_orderkey" not in plan(queries.QUERIES[name](spark, DATA)) and queries.QUERIES[name](spark, DATA).count() > 0


def test_windows_hold_what_is_asked(spark):
    parts = queries_temporal._windows(spark, DATA, "conversion_label")
    assert set(parts.past_a.columns) == {"click_timestamp", "user_id", "product_id", "conversion_label", "window"}


def test_diagnostics_and_selection_read_their_rows_once(spark):
    rows = spark.range(100).select(F.expr("uuid()").alias("event_id"), F.lit(1).alias("rank"), F.rand().alias("pCVR"), F.rand().alias("expected_value_score"))
    found = metrics.output_diagnostics(rows.withColumn("expected_value_score", F.col("pCVR")), (0.5, 0.6))
    assert "rand(" not in plan(found) and found.first()["firsts_above"] == 1
    sold = rows.select("event_id", F.lit(1).alias("conversion_label"), F.rand().alias("conversion_value_eur"))
    best = auction.selection(sold, {"v": F.col("conversion_value_eur")}, (1.0,))
    assert {round(r.value_capture, 9) for r in best.collect()} == {1.0}  # the totals are those of the rows that are ordered


def test_pool_negatives_without_expanding_what_is_not_kept(spark):
    pool = spark.createDataFrame([(f"p{i}", i) for i in range(7)], "candidate_ad_id string, pos long")
    held = [("u", f"p{i}") for i in range(5)] + [("v", "p6"), ("v", "unknown"), (None, "p1")] + [("w", f"p{i}") for i in range(7)]
    found = sampling.pool_negatives(spark.createDataFrame(held, "user_id string, product_id string"), pool, 2)
    assert "Window" not in plan(found)
    size, got = 7, {}
    for r in found.collect():
        assert r.candidate_ad_id == f"p{r.pos}"
        got.setdefault(r.user_id, set()).add(r.pos)
    for u in ("u", "v"):
        start = spark.range(1).select(sampling.stable_hash(F.lit(2026), F.lit(u)) % size).first()[0]
        mine = [p for who, p in held if who == u]
        around = [(start + s) % size for s in range(min(size, len(mine) * 3))]
        assert got[u] == set([p for p in around if f"p{p}" not in mine][: len(mine) * 2])
    assert "w" not in got
