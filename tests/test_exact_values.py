"""Exact expectations on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adspark.functions.expressions import blake_hash, weekday_monday0, weekday_sunday0, weekday_thursday0
from adspark.operators import auction, audit, features, metrics, models, normalize, ordering, profile, recall, sampling, windows
from adspark.plans import funnel
from adspark.sources import delimited


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_search_scan_normalise_and_features(spark, tmp_path):
    columns = tuple(normalize.SEARCH_COLUMNS)
    first = dict.fromkeys(columns, "-1") | {"Sale": "0", "click_timestamp": "0", "product_price": "0.0", "product_id": "p", "user_id": "u"}
    second = dict.fromkeys(columns, "x") | {"Sale": "1", "SalesAmountInEuro": "12.5", "time_delay_for_conversion": "60", "click_timestamp": "1598895420", "nb_clicks_1week": "3", "product_price": "20.0"}
    (tmp_path / "in.tsv").write_text("".join("\t".join(r[c] for c in columns) + "\n" for r in (first, second)))
    raw = delimited.scan(spark, str(tmp_path / "in.tsv"), delimited.Contract(columns, label="Sale"))
    raw = raw.withColumn("source_row_number", F.when(F.col("Sale") == "0", 0).otherwise(1).cast("long"))
    unified = normalize.normalize_search(raw)
    a, b = unified.orderBy("event_id").collect()
    assert (a.event_id, b.event_id) == ("criteo-000000000000", "criteo-000000000001")
    assert a.conversion_value_eur is None and b.conversion_value_eur == 12.5 and a.click_timestamp is None
    x, y = features.engineer(unified, ["product_brand"]).orderBy("event_id").collect()
    assert (x.click_hour_utc, x.click_timestamp_missing, x.cat_product_brand) == (0, 1, "__MISSING__")
    assert y.conversion_delay_hours == pytest.approx(1 / 60) and y.log_product_price == pytest.approx(math.log1p(20)) and y.log_clicks_last_7d == pytest.approx(math.log1p(3))


def test_labels_outside_0_and_1_are_errors(spark):
    raw = spark.createDataFrame([("2",)], "Sale string")
    with pytest.raises(Exception, match="0 or 1"):
        raw.select(normalize.binary_label("Sale", "label")).collect()


def test_contract_and_sink_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.Contract(("a", "a"))
    df = spark.range(3)
    delimited.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        delimited.write_table(df, str(tmp_path / "t"))
    delimited.write_table(df, str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_attribution_split_keeps_ties_and_order_errors_count(spark):
    df = spark.createDataFrame([(i, i) for i in range(12)], "event_id long, timestamp long")
    assert rows(windows.strict_boundaries(df, "timestamp", [0.5, 0.75])) == [(6, 9)]
    ties = spark.createDataFrame([(t,) for t in (1, 1, 2, 2, 3, 3)], "timestamp long")
    assert rows(windows.strict_boundaries(ties, "timestamp", [0.5])) == [(3,)]
    assert windows.order_violations(df, "event_id", "timestamp").first()[0] == 0
    swapped = df.withColumn("timestamp", F.when(F.col("event_id") == 4, 5).when(F.col("event_id") == 5, 4).otherwise(F.col("timestamp")))
    assert windows.order_violations(swapped, "event_id", "timestamp").first()[0] == 1


def test_higher_order_statistic(spark):
    df = spark.createDataFrame([(t,) for t in range(1, 7)], "ts long")
    assert windows.higher_quantile(df, "ts", 0.5).first()[0] == 4


def test_weekday_conventions(spark):
    r = spark.range(1).select(*(f(F.lit(0).cast("long")) for f in (weekday_monday0, weekday_thursday0, weekday_sunday0))).first()
    assert tuple(r) == (3, 0, 4)


def test_itemcf_order(spark):
    data = [("m", "s", "click"), ("m", "t", "conversion"), ("n", "s", "click"), ("n", "v", "conversion"), ("o", "t", "click"), ("o", "w", "click")]
    df = spark.createDataFrame(data, "user_id string, product_id string, label string")
    pairs = recall.weighted_pairs(df, recall.label_weight("label", {"click": 1, "conversion": 4}))
    found = rows(recall.itemcf(pairs, spark.createDataFrame([("m",)], "user_id string"), 10), "rank")
    # w: 4 * (1 * 1) / (sqrt(17) * 1); v: 1 * (1 * 4) / (sqrt(2) * 4)
    assert [(r[1], r[3]) for r in found] == [("w", 1), ("v", 2)]
    assert [r[2] for r in found] == pytest.approx([4 / 17**0.5, 1 / 2**0.5])


def test_popularity_ties(spark):
    data = [("m", "k1", 0), ("n", "k1", 1), *((f"u{i}", "k2", 0) for i in range(4)), ("o", "k0", 0)]
    df = spark.createDataFrame(data, "user_id string, product_id string, conversion_label int")
    assert rows(recall.popularity(df, 5), "rank") == [("k1", 4.0, 1), ("k2", 4.0, 2), ("k0", 1.0, 3)]


def test_rrf_formula_dedup_and_quota(spark):
    item = spark.createDataFrame([("m", "s", 1), ("m", "t", 3), ("n", "y", 2)], "user_id string, candidate_ad_id string, rank int")
    tower = spark.createDataFrame([("m", "t", 1), ("m", "t", 5), ("m", "w", 2)], "user_id string, candidate_ad_id string, rank int")
    top = spark.createDataFrame([("t", 9.0, 1), ("q", 2.0, 2)], "candidate_ad_id string, popularity_score double, rank int")
    every = recall.personalised({"itemcf": item, "two_tower": tower}, top)
    weights = {"itemcf": 2, "two_tower": 1, "popularity": 1}
    got = {(r[0], r[1]): r for r in rows(recall.rrf(every, weights, 10, 10))}
    assert got["m", "t"][2] == pytest.approx(2 / 13 + 1 / 11 + 1 / 11) and got["m", "t"][3] == 3
    assert got["m", "w"][2] == pytest.approx(1 / 12) and got["n", "q"][3] == 1
    assert {r[1] for r in rows(recall.rrf(every, weights, 10, 2)) if r[0] == "m"} == {"s", "t"}
    quota = recall.rrf_with_quotas(every, weights, {"popularity": 2}, 10, 2)
    assert {r[1] for r in rows(quota) if r[0] == "m"} == {"q", "t"}


def test_recall_counts_users_without_candidates(spark):
    cands = spark.createDataFrame([("m", c, i + 1) for i, c in enumerate("klno")], "user_id string, candidate_ad_id string, rank int")
    pos = spark.createDataFrame([("m", c) for c in "loz"], "user_id string, product_id string")
    assert [(r[0], r[2]) for r in rows(metrics.recall_at(cands, pos, (2, 4)), "cutoff")] == [(2, pytest.approx(1 / 3)), (4, pytest.approx(2 / 3))]
    more = pos.union(spark.createDataFrame([("n", "k")], pos.schema))
    assert rows(metrics.recall_at(cands, more, (4,)))[0][2] == pytest.approx(1 / 3)


def test_reciprocal_rank(spark):
    cands = spark.createDataFrame([("m", "x", 1), ("m", "a", 2)] + [("n", c, i + 1) for i, c in enumerate("xyzb")], "user_id string, candidate_ad_id string, rank int")
    pos = spark.createDataFrame([("m", "a"), ("n", "b"), ("o", "a")], "user_id string, product_id string")
    assert metrics.reciprocal_rank(cands, pos, 100).first()["mrr"] == pytest.approx((1 / 2 + 1 / 4 + 0) / 3)


def test_calibration_points(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, 0.4)], "y int, p double")
    assert metrics.probability_losses(df, "y", "p").first()["brier"] == pytest.approx((0.01 + 0.01 + 0.36) / 3)
    # bins 0.1 and 0.4 (mean 0.25, rate 0.5) and 0.9 (rate 1)
    assert metrics.expected_calibration_error(metrics.reliability(df, "y", "p", 2)).first()["ece"] == pytest.approx((2 * 0.25 + 0.1) / 3)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    r = metrics.ranking_quality(df, "y", "p").first()
    assert r["roc_auc"] is None and r["average_precision"] is None
    assert models.fit_platt(df, "y", "p") is None and models.fit_isotonic(df, "y", "p") is None


def test_calibrators_improve(spark):
    data = [(int((i * 37 % 100) < 100 * (i % 10) / 20), (i % 10 + 0.5) / 10) for i in range(400)]
    df = spark.createDataFrame(data, "y int, p double")
    name, table = models.select_calibrator(df, df, "y", "p")
    assert name in ("platt", "isotonic") and table.count() == 3


def test_serving_ratio(spark):
    df = spark.createDataFrame([(0.4, 0.06), (0.25, 0.32), (0.05, 0.09), (0.7, 0.7)], "raw_pctr double, raw_pctcvr double")
    r = metrics.serving_consistency(df).first()
    assert r["clipped_fraction"] == 0.5 and r["max_error"] == pytest.approx(0.07) and r["mean_error"] == pytest.approx(0.11 / 4)
    assert [round(x[0], 9) for x in rows(auction.attribution_scores(df).select("score_pcvr"))] == [0.15, 1.0, 1.0, 1.0]


def test_prices_and_budget(spark):
    df = spark.createDataFrame([(7, 1, 0.5, 8.0), (7, 2, 1.0, 3.0), (7, 3, 0.2, 10.0)], "auction_id long, event_id long, quality double, bid double")
    won = auction.clear_auctions(df, "quality", "bid")
    assert [(r["winner"], r["winning_bid"], r["second_price"]) for r in won.collect()] == [(1, 8.0, 6.0)]
    spent = auction.spend(won.withColumn("policy", F.lit("p")), [7.0], price="winning_bid")
    assert [(r["won"], r["payment"]) for r in spent.collect()] == [(0, 0.0)]


def test_cheaper_auctions_win_after_a_lost_one(spark):
    cleared = spark.createDataFrame([("p", 0, 2.5), ("p", 1, 4.0), ("p", 2, 1.25)], "policy string, auction_id long, second_price double")
    got = rows(auction.spend(cleared, [4.0]).select("won", "cumulative_spend", "auction_id"), "auction_id")
    assert [g[:2] for g in got] == [(1, 2.5), (0, 2.5), (1, 3.75)]


@pytest.mark.parametrize("folded", [7, 1 << 18])
def test_spend_is_the_fold(spark, monkeypatch, folded):
    monkeypatch.setattr(auction, "FOLDED", folded)
    rng = random.Random(3)
    prices = [rng.choice([0.0, 0.25, 1.0, 3.0, 8.0]) for _ in range(120)]
    cleared = spark.createDataFrame([("p", i, x) for i, x in enumerate(prices)] + [("q", 500 + i, 1.0) for i in range(3)], "policy string, auction_id long, second_price double")
    for budget in (0.0, 2.0, 40.0, 1000.0):
        total, want = 0.0, []
        for p in prices:
            ok = total + p <= budget + auction.EPSILON
            total += p if ok else 0
            want.append((int(ok), total))
        got = rows(auction.spend(cleared, [budget]).where("policy = 'p'").select("auction_id", "won", "cumulative_spend"), "auction_id")
        assert [g[1:] for g in got] == want, budget
    now, total, want = 1.0, 0.0, []
    for i, p in enumerate(prices):
        ok = total + p * now <= 20 + auction.EPSILON
        total += p * now if ok else 0
        want.append((int(ok), total, now))
        now = min(3.0, max(0.1, now * ((i + 1) / 120 / max(total / 20, 1e-12)) ** 0.1))
    paced = auction.spend(cleared, [20.0], pacing=(0.1, 3.0, 0.1)).where("policy = 'p'")
    got = [g[1:] for g in rows(paced.select("auction_id", "won", "cumulative_spend", "pacing_multiplier"), "auction_id")]
    assert len(got) == len(want) and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_static_pacing_follows_the_line(spark):
    cleared = spark.createDataFrame([("p", i, 2.0) for i in range(3)], "policy string, auction_id long, second_price double")
    got = rows(auction.static_pacing(cleared, [6.0], 0.5, 1.25).select("auction_id", "pacing_multiplier"), "auction_id")
    # nothing spent: the upper bound; then 4 / 2.5 over the bound again; then 6 / 5
    assert [g[1] for g in got] == pytest.approx([1.25, 1.25, 1.2])


def test_exhaustion_and_trajectory(spark):
    prices = [10.0] * 9 + [9.5] + [5.0] * 5
    cleared = spark.createDataFrame([("p", i, x) for i, x in enumerate(prices)], "policy string, auction_id long, second_price double")
    curve = auction.spend(cleared, [100.0])
    r = auction.spend_summary(curve).first()  # 90 after nine, 99.5 after ten: 0.99 of the budget is reached there
    assert r["exhausted_at"] == pytest.approx(10 / 15) and r["exhausted_early"] and r["spend"] == 99.5
    t = auction.spend_trajectory(curve, 10).orderBy("bucket").collect()  # ends at ceil(1.5 b): 2, 3, 5, 6, 8, 9, 11, 12, 14, 15
    assert [x["horizon"] for x in t] == pytest.approx([k / 15 for k in (2, 3, 5, 6, 8, 9, 11, 12, 14, 15)])
    spent = [0.2, 0.3, 0.5, 0.6, 0.8, 0.9, 0.995, 0.995, 0.995, 0.995]
    assert [x["spent"] for x in t] == pytest.approx(spent) and [x["remaining"] for x in t] == pytest.approx([1 - x for x in spent])
    assert t[0]["impressions"] == pytest.approx(2 / 10) and t[0]["smoothness"] == pytest.approx(sum(abs(x["spent"] - x["horizon"]) for x in t) / 10)
    few = auction.spend_trajectory(curve.where("auction_id < 3"), 10).orderBy("bucket").collect()
    assert [x["horizon"] for x in few] == pytest.approx([1 / 3] * 3 + [2 / 3] * 3 + [1] * 4)


def test_drift_verdicts(spark):
    a = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5, 0.0)], "log_loss double, brier double, roc_auc double, ece double, mae double")
    b = spark.createDataFrame([(0.485, 0.52, 0.44, 0.7, 0.1)], a.schema)
    got = {r["metric"]: r["verdict"] for r in metrics.drift(a, b).collect()}
    assert got == {"log_loss": "improved", "brier": "stable", "roc_auc": "moderate", "ece": "large", "mae": "n/a"}


def test_places_and_quantiles(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 10)) for i in range(100)] + [(100, None)], "k long, v double").repartition(7)
    got = [(r["v"], r["k"]) for r in ordering.numbered(df, [F.col("v").desc(), F.col("k")], "at").orderBy("at").collect()]
    assert got == sorted(got, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    sums = ordering.running(df.where("v IS NOT NULL"), [F.col("v"), F.col("k")], {"upto": "v"}).orderBy("v", "k").collect()
    assert [r["upto"] for r in sums] == pytest.approx([sum(r["v"] for r in sums[: i + 1]) for i in range(len(sums))])
    q = {r["level"]: r["value"] for r in ordering.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.95, 1.0)).collect()}
    want = df.where("v IS NOT NULL").selectExpr("percentile(v, array(0.0, 0.25, 0.5, 0.95, 1.0)) AS q").first()["q"]
    assert [q[x] for x in (0.0, 0.25, 0.5, 0.95, 1.0)] == pytest.approx(want)


def test_reports_are_never_cut(spark, monkeypatch):
    monkeypatch.setattr(delimited, "REPORTED", 3)
    assert "| 2 |" in delimited.markdown(spark.range(3)) and '"id": 2' in delimited.report(spark.range(3))
    for f in (delimited.markdown, delimited.report):
        with pytest.raises(ValueError, match="more than 3"):
            f(spark.range(4))


def test_feedback_moves_against_the_lead():
    m = lambda spent: auction.feedback_multiplier(1.0, 0.5, spent, 10.0, 0.1, 3.0, 0.5)
    assert m(9.0) < 1 < m(1.0) and m(1e-9) == 3.0


def test_price_issues(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (-1.0,), (2.0,)], "product_price double")
    assert tuple(features.price_issues(df).first()) == (1, 1, 1, 1)
    log, ok = features.sanitised_price(F.col("product_price"))
    assert [r[0] for r in df.select(log).collect()] == pytest.approx([0, 0, 0, 0, math.log1p(2)])


def test_negative_samples_are_deterministic(spark):
    cands = spark.createDataFrame([("u1", c) for c in "abcdef"] + [("u2", "a")], "user_id string, candidate_ad_id string")
    pairs = spark.createDataFrame([("u1", "a", 5, 1)], "user_id string, candidate_ad_id string, ts long, converted int")
    a = rows(sampling.labelled_candidates(cands, pairs, 2), "candidate_ad_id")
    b = rows(sampling.labelled_candidates(cands.repartition(3), pairs, 2), "candidate_ad_id")
    assert a == b and len(a) == 3 and {r[0] for r in a} == {"u1"} and max(r[3] for r in a) == 3.0


def test_leakage_guards():
    with pytest.raises(ValueError):
        features.assert_no_leakage(["product_price", "conversion_label"])
    with pytest.raises(ValueError):
        features.assert_no_leakage(["future_clicks"])
    with pytest.raises(ValueError):
        windows.refuse_later_window("/data/future-b/part-0")
    with pytest.raises(ValueError):
        delimited.before_cutoff(None, "catalogue", 10, 5)


def test_holdout_opens_once(tmp_path):
    model = tmp_path / "model"
    model.write_text("x")
    h = funnel.FinalHoldout(str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        h.open([str(tmp_path / "none")])
    h.open([str(model)])
    with pytest.raises(RuntimeError):
        h.open([str(model)])


def test_overlap_and_slices(spark):
    past = spark.createDataFrame([("u1", "a", 1)], "user_id string, product_id string, conversion_label int")
    later = spark.createDataFrame([("u1", "b", 0), ("u2", "a", 1)], past.schema)
    assert rows(audit.seen_slices(past, later), "seen_user") == [(0, 1, 1, 1, 1.0), (1, 0, 1, 0, 0.0)]
    assert rows(audit.key_overlap(past, later, {"user": ["user_id"]})) == [("user", 1, 2, 1, 0.5, 0.5)]


def test_missing_profile_counts_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "a string, b int")
    assert rows(profile.missing_profile(df, ["a", "b"]), "column") == [("a", 2, 1, 0.5), ("b", 2, 0, 0.0)]


def test_blake_hash_is_unsigned_and_seeded(spark):
    import hashlib

    want = str(int.from_bytes(hashlib.blake2b(b"7\x1fx", digest_size=8).digest(), "big"))
    assert spark.createDataFrame([("x",)], "v string").select(blake_hash(7)("v")).first()[0] == want


def test_value_ranker_invariants(spark):
    data = [(f"b{i % 3}", i % 2, i % 2, math.log1p(10 + i % 3) if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(data, "product_brand string, conversion_label int, value_mask int, log_conversion_value double")
    out = models.predict_value(models.fit_value_ranker(df, ["product_brand"]), df, 5.0).collect()
    assert all(0 <= r["pCVR"] <= 1 and r["predicted_conversion_value"] >= 0 for r in out)


def test_click_and_conversion_product(spark):
    data = [(f"c{i % 4}", i % 2, i % 4 // 2 * (i % 2)) for i in range(80)]
    df = spark.createDataFrame(data, "campaign_id string, click int, click_and_conversion int")
    out = models.predict_click_and_conversion(models.fit_click_and_conversion(df, ["campaign_id"]), df).collect()
    assert all(abs(r["raw_pctr"] * r["raw_pcvr"] - r["raw_pctcvr"]) < 1e-9 for r in out)


def test_running_popularity_stream(spark, tmp_path):
    from adspark.streaming import popularity as stream

    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "product_id string, conversion_label int")
    df.write.parquet(str(tmp_path / "in"))
    running = stream.running_popularity(stream.file_stream(spark, str(tmp_path / "in"), df.schema))
    q = running.writeStream.outputMode("complete").format("memory").queryName("pop").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("pop"), "candidate_ad_id") == [("a", 4.0), ("b", 1.0)]


def test_isotonic_curve_of_many_boundaries(spark):
    bounds = [0.1 + i / 50_000 for i in range(40_000)]
    values = [0.2 + i / 80_000 for i in range(40_000)]
    asked = [None, 0.0, 0.1, bounds[7], (bounds[7] + bounds[8]) / 2, bounds[-1], 5.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, p double")
    got = [r.c for r in models.apply_isotonic(df, (bounds, values), "p", "c").orderBy("i").collect()]
    want = [None, 0.2, 0.2, values[7], (values[7] + values[8]) / 2, values[-1], values[-1]]
    assert got[0] is None and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[1:], want[1:], strict=True))


def test_isotonic_steps_and_ends(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, 0.3, 0.5, 0.7])], "i int, p double")
    got = [r.c for r in models.apply_isotonic(df, ([0.2, 0.5, 0.5, 0.6], [0.0, 0.4, 0.8, 1.0]), "p", "c").orderBy("i").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, [1e-7, 0.4 / 3, 0.8, 1 - 1e-7], strict=True))
    assert [r.c for r in models.apply_isotonic(df, ([0.4], [0.3]), "p", "c").collect()] == [0.3] * 4
