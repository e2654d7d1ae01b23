"""Registered queries on candidates, ranking, calibration and bidding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions.expressions import blake_hash
from adspark.operators import auction, audit, candidates, features, metrics, models, normalize, profile, recall, sampling, windows
from adspark.plans import funnel
from adspark.queries import _HASH, GROUPED_SQL, IMPRESSIONS_SQL, INTERACTIONS_SQL, PAIRS_SQL, PREDICTIONS_SQL, SPLIT_SQL, STRICT_SQL, _fold_sql, _grouped, _pairs, _past_future, query, rounded
from adspark.sources import delimited
from adspark.sources.adapters import impressions, interactions, predictions, table
from adspark.sources.staging import staged

# --- scans and guards -----------------------------------------------------------------------------------------------


def raw_clicks(spark, sf_dir) -> DataFrame:
    """Interactions as the text columns of a raw click log, with the tokens that stand for missing values."""
    rows = interactions(spark, sf_dir)
    text = {
        "Sale": F.col("conversion_label"), "SalesAmountInEuro": F.when(F.col("conversion_value_eur").isNull(), "-1").otherwise(F.col("conversion_value_eur").cast("string")),
        "click_timestamp": F.when(F.col("clicks_last_7d") < 3, "0").otherwise(F.col("click_timestamp").cast("string")), "product_price": F.col("product_price"),
        "product_brand": F.when(F.col("product_brand") == "Brand#11", "-1").otherwise(F.col("product_brand")), "product_id": F.col("product_id"), "user_id": F.concat(F.lit(" "), "user_id", F.lit(" ")),
    }
    raw = {c: text.get(c, F.lit("-1")).cast("string") for c in normalize.SEARCH_COLUMNS}
    return rows.select(F.col("event_id").alias("_event"), F.substring("event_id", 1, 12).cast("long").alias("source_row_number"), *(v.alias(c) for c, v in raw.items()))


@query("normalized_search", f"""WITH {INTERACTIONS_SQL}
SELECT 'criteo-' || substr(event_id, 1, 12) AS event_id, conversion_label, round(conversion_value_eur, 6) AS conversion_value_eur, CASE WHEN clicks_last_7d >= 3 THEN click_timestamp ELSE -1 END AS click_timestamp,
  CASE WHEN product_brand <> 'Brand#11' THEN product_brand END AS product_brand, NULL::VARCHAR AS device_type, product_id, user_id FROM interactions""")
def normalized_search(spark, sf_dir):
    unified = normalize.with_ids(normalize.normalize_search(raw_clicks(spark, sf_dir).drop("_event")), "user_id", "product_id")
    return unified.select("event_id", F.col("conversion_label").cast("int").alias("conversion_label"), F.round("conversion_value_eur", 6).alias("conversion_value_eur"), F.coalesce("click_timestamp", F.lit(-1)).alias("click_timestamp"), "product_brand", "device_type", "product_id", "user_id")


@query("normalized_impressions", f"""WITH {IMPRESSIONS_SQL} SELECT 'criteo-attribution-' || lpad(event_id::VARCHAR, 12, '0') AS event_id, timestamp, user_id, campaign_id, click, conversion, click_and_conversion, cost FROM impressions""")
def normalized_impressions(spark, sf_dir):
    rows = impressions(spark, sf_dir)
    known = {"timestamp": "timestamp", "uid": "user_id", "campaign": "campaign_id", "click": "click", "conversion": "conversion", "cost": "cost"}
    names = [*normalize.IMPRESSION_INTEGERS, *normalize.IMPRESSION_IDS, *normalize.IMPRESSION_BINARY, *normalize.IMPRESSION_DOUBLES, *normalize.IMPRESSION_NULLABLE]
    raw = rows.select(F.col("event_id").alias("source_row_number"), *((F.col(known[c]).cast("string") if c in known else F.lit("-1")).alias(c) for c in names))
    out = normalize.normalize_impressions(raw)
    ints = [F.col(c).cast("int").alias(c) for c in ("click", "conversion", "click_and_conversion")]
    return out.select("event_id", "timestamp", "user_id", "campaign_id", *ints, "cost")


@query("observed_rows", f"""WITH {INTERACTIONS_SQL}, l AS (SELECT CASE WHEN clicks_last_7d > 45 THEN 2 WHEN clicks_last_7d < 3 THEN NULL ELSE conversion_label END AS label FROM interactions)
SELECT count(*) AS rows, count(*) FILTER (label IN (0, 1)) AS kept, count(*) - count(*) FILTER (label IN (0, 1)) AS dropped FROM l""")
def observed_rows(spark, sf_dir):
    label = F.when(F.col("clicks_last_7d") > 45, 2).when(F.col("clicks_last_7d") < 3, None).otherwise(F.col("conversion_label"))
    return candidates.observed_rows(interactions(spark, sf_dir).withColumn("label", label), "label")[1]


@query("cohort_rows", f"WITH {SPLIT_SQL}, u AS (SELECT DISTINCT user_id FROM past WHERE user_id IN (SELECT user_id FROM future)) SELECT event_id, user_id FROM future WHERE user_id IN (SELECT user_id FROM u)")
def cohort_rows(spark, sf_dir):
    split = windows.split(interactions(spark, sf_dir), "click_timestamp", 0.8)
    delimited.require_columns(split, ["user_id", "window"])
    return delimited.restricted(split.where("window = 'future'"), windows.eligible_users(split)).select("event_id", "user_id")


@query("leading_rows", f"WITH {INTERACTIONS_SQL} SELECT event_id, user_id FROM interactions ORDER BY event_id LIMIT 1000")
def leading_rows(spark, sf_dir):
    return delimited.read_leading(interactions(spark, sf_dir).select("event_id", "user_id"), "event_id", 1000)


@query("point_in_time_catalogue", f"WITH {SPLIT_SQL} SELECT product_id, arg_max(product_price, (click_timestamp, event_id)) AS product_price, arg_max(product_brand, (click_timestamp, event_id)) AS product_brand FROM past GROUP BY 1")
def point_in_time_catalogue(spark, sf_dir):
    rows = interactions(spark, sf_dir)
    at = windows.higher_quantile(rows, "click_timestamp", 0.8).first()["threshold"]
    known = delimited.before_cutoff(rows, f"{sf_dir}/catalogue", at, at, "click_timestamp")
    return recall.latest_catalogue(known, ["product_price", "product_brand"], ["click_timestamp", "event_id"])


@query("first_users", f"WITH {INTERACTIONS_SQL} SELECT DISTINCT user_id FROM interactions ORDER BY user_id LIMIT 50")
def first_users(spark, sf_dir):
    return recall.first_users(interactions(spark, sf_dir), 50)


@query("first_users_met", f"WITH {INTERACTIONS_SQL} SELECT user_id FROM (SELECT user_id, min(event_id) AS e FROM interactions GROUP BY 1) ORDER BY e, user_id LIMIT 50")
def first_users_met(spark, sf_dir):
    return candidates.first_users_met(interactions(spark, sf_dir), "event_id", 50)


@query("row_budget", f"""WITH RECURSIVE {INTERACTIONS_SQL}, s AS MATERIALIZED (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY user_id) AS i FROM interactions GROUP BY 1),
f AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS user_id, 0::BIGINT AS total, false AS won UNION ALL SELECT s.i, s.user_id, CASE WHEN total + n <= 5000 THEN total + n ELSE total END, total + n <= 5000 FROM f JOIN s ON s.i = f.i + 1)
SELECT event_id, user_id FROM interactions WHERE user_id IN (SELECT user_id FROM f WHERE won)""")
def row_budget(spark, sf_dir):
    return candidates.row_budget(interactions(spark, sf_dir), 5000).select("event_id", "user_id")


@query("approximate_distinct_bound", f"WITH {INTERACTIONS_SQL} SELECT 'user_id' AS column, count(DISTINCT user_id) AS exact, true AS close FROM interactions UNION ALL SELECT 'product_id', count(DISTINCT product_id), true FROM interactions")
def approximate_distinct_bound(spark, sf_dir):
    """Exact counts, and whether the sketched ones are within five standard errors of them."""
    rows = interactions(spark, sf_dir)
    both = profile.approximate_distinct(rows, ["user_id", "product_id"]).crossJoin(rows.agg(F.count_distinct("user_id").alias("xu"), F.count_distinct("product_id").alias("xp")))
    pair = lambda c, x: F.struct(F.lit(c).alias("column"), F.col(x).alias("exact"), (F.abs(F.col(c) - F.col(x)) <= F.greatest(F.col(x) * 0.0405, F.lit(1.0))).alias("close"))
    return both.select(F.explode(F.array(pair("user_id", "xu"), pair("product_id", "xp"))).alias("p")).select("p.*")


@query("seeded_hashes", None)
def seeded_hashes(spark, sf_dir):
    return interactions(spark, sf_dir).select("event_id", blake_hash(2026)(F.col("user_id")).alias("user_hash"))


# --- enrichment and ranks -------------------------------------------------------------------------------------------

_ENRICHED_SQL = f"""{SPLIT_SQL}, pr AS (SELECT product_id, arg_max(product_price, (click_timestamp, event_id)) AS product_price, arg_max(product_brand, (click_timestamp, event_id)) AS product_brand FROM past GROUP BY 1),
us AS (SELECT user_id, arg_max(clicks_last_7d, (click_timestamp, event_id)) AS clicks_last_7d, arg_max(device_type, (click_timestamp, event_id)) AS device_type FROM past GROUP BY 1),
enriched AS (SELECT c.user_id, c.product_id, coalesce(product_price, 0) AS product_price, coalesce(product_brand, '__MISSING__') AS product_brand, (pr.product_id IS NULL)::INT AS product_id_missing,
    coalesce(clicks_last_7d, 0) AS clicks_last_7d, coalesce(device_type, '__MISSING__') AS device_type, (us.user_id IS NULL)::INT AS user_id_missing
  FROM positives c LEFT JOIN pr ON pr.product_id = c.product_id LEFT JOIN us ON us.user_id = c.user_id)"""


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(past, positives) with what candidates are enriched with."""
    past, future = _past_future(spark, sf_dir, "event_id", "user_id", "product_id", "product_price", "product_brand", "clicks_last_7d", "device_type")
    return past, funnel.positives(future)


def _enriched(past: DataFrame, positives: DataFrame) -> DataFrame:
    order = ["click_timestamp", "event_id"]
    products = recall.latest_catalogue(past, ["product_price", "product_brand"], order)
    users = recall.latest_users(past, ["clicks_last_7d", "device_type"], order)
    rows = candidates.enrich(positives, products, "product_id", ["product_price"], ["product_brand"])
    return candidates.enrich(rows, users, "user_id", ["clicks_last_7d"], ["device_type"])


@query("candidate_features", f"WITH {_ENRICHED_SQL} SELECT * FROM enriched")
def candidate_features(spark, sf_dir):
    return _enriched(*_judged(spark, sf_dir))


@query("missing_features", f"WITH {_ENRICHED_SQL} SELECT count(*) AS rows, sum(product_id_missing)::BIGINT AS missing_products, round(avg(product_id_missing), 9) AS product_rate, sum(user_id_missing)::BIGINT AS missing_users, round(avg(user_id_missing), 9) AS user_rate FROM enriched")
def missing_features(spark, sf_dir):
    sums = [F.count(F.lit(1)).alias("rows")]
    for name in ("product", "user"):
        sums += [F.sum(f"{name}_id_missing").alias(f"missing_{name}s"), metrics.share_of(F.col(f"{name}_id_missing") == 1).alias(f"{name}_rate")]
    return rounded(_enriched(*_judged(spark, sf_dir)).agg(*sums), "product_rate", "user_rate", digits=9)


@query("one_to_one_join", f"WITH {PREDICTIONS_SQL} SELECT event_id, raw_pctr, raw_pctcvr, campaign_id, cost FROM predictions")
def one_to_one_join(spark, sf_dir):
    scored = predictions(spark, sf_dir).select("event_id", "raw_pctr", "raw_pctcvr")
    return candidates.one_to_one(scored, impressions(spark, sf_dir).select("event_id", "campaign_id", "cost"), "event_id")


_SCORED_SQL = f"""{_ENRICHED_SQL}, scored AS (SELECT user_id, product_id AS candidate_ad_id, round(product_price / 200, 0) AS coarse_score, round(clicks_last_7d / 10, 0) AS rrf_score,
  round(product_price / (product_price + 1000), 1) AS pcvr, round(product_price * clicks_last_7d / 20000, 0) AS expected FROM enriched)"""


def _scored(past: DataFrame, positives: DataFrame) -> DataFrame:
    price, clicks = F.col("product_price"), F.col("clicks_last_7d")
    rows = _enriched(past, positives).withColumnRenamed("product_id", "candidate_ad_id")
    return rows.select("user_id", "candidate_ad_id", F.round(price / 200, 0).alias("coarse_score"), F.round(clicks / 10, 0).alias("rrf_score"), F.round(price / (price + 1000), 1).alias("pCVR"), F.round(price * clicks / 20000, 0).alias("expected_value_score"))


@query("coarse_top", f"WITH {_SCORED_SQL} SELECT user_id, candidate_ad_id, row_number() OVER (PARTITION BY user_id ORDER BY coarse_score DESC, rrf_score DESC, candidate_ad_id) AS rank FROM scored QUALIFY rank <= 5")
def coarse_top(spark, sf_dir):
    return candidates.coarse_top(_scored(*_judged(spark, sf_dir)), 5).select("user_id", "candidate_ad_id", "rank")


@query("fine_top", f"WITH {_SCORED_SQL} SELECT user_id, candidate_ad_id, row_number() OVER (PARTITION BY user_id ORDER BY expected DESC, pcvr DESC, candidate_ad_id) AS rank FROM scored QUALIFY rank <= 5")
def fine_top(spark, sf_dir):
    return candidates.fine_top(_scored(*_judged(spark, sf_dir)), 5).select("user_id", "candidate_ad_id", "rank")


@query("derived_rank", f"WITH {_SCORED_SQL} SELECT user_id, candidate_ad_id, row_number() OVER (PARTITION BY user_id ORDER BY rrf_score DESC, candidate_ad_id) AS rank FROM scored")
def derived_rank(spark, sf_dir):
    ranked = candidates.derived_rank(_scored(*_judged(spark, sf_dir)))
    return ranked.select("user_id", "candidate_ad_id", candidates.positive_rank(F.col("rank").cast("string")).alias("rank"))


@query("output_diagnostics", f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY expected DESC, pcvr DESC, candidate_ad_id) AS rank FROM scored), q AS (SELECT quantile_cont(expected, 0.99) AS p99 FROM r)
SELECT count(*) AS rows, count(*) FILTER (pcvr > 0.5) AS high, count(*) FILTER (pcvr > 0.6) AS very_high, round(quantile_cont(pcvr, 0.5), 6) AS median_pcvr, round(any_value(p99), 6) AS value_p99, count(*) FILTER (rank = 1) AS firsts, count(*) FILTER (rank = 1 AND expected > p99) AS firsts_above FROM r, q""")
def output_diagnostics(spark, sf_dir):
    return rounded(metrics.output_diagnostics(candidates.fine_top(_scored(*_judged(spark, sf_dir)), 1 << 30), (0.5, 0.6)), "median_pcvr", "value_p99")


# --- evaluation -----------------------------------------------------------------------------------------------------

_POPULAR_SQL = "popular AS (SELECT product_id, row_number() OVER (ORDER BY sum(weight) DESC, product_id) AS rank FROM pairs GROUP BY 1 QUALIFY rank <= 100)"


def _popular_lists(past: DataFrame, positives: DataFrame) -> DataFrame:
    """The popular products as a list of each user with positives, joined on the product: only pairs that may be hits."""
    top = recall.popular_pairs(_pairs(past), 100).select("candidate_ad_id", "rank")
    return positives.withColumnRenamed("product_id", "candidate_ad_id").join(F.broadcast(top), "candidate_ad_id")


@query("bucket_recall", f"""WITH {SPLIT_SQL}, {PAIRS_SQL}, {_POPULAR_SQL}, c AS (SELECT product_id, row_number() OVER (ORDER BY count(*) DESC, product_id) AS p, count(*) OVER () AS t FROM past GROUP BY 1),
b AS (SELECT product_id, CASE WHEN p <= ceil(t * 0.2) THEN 'head' WHEN p <= ceil(t * 0.5) THEN 'mid' ELSE 'tail' END AS bucket FROM c)
SELECT bucket, count(*) AS positives, count(rank) AS hits, round(count(rank) / count(*), 9) AS recall FROM positives JOIN b USING (product_id) LEFT JOIN popular USING (product_id) GROUP BY 1""")
def bucket_recall(spark, sf_dir):
    past, future = _past_future(spark, sf_dir, "user_id", "product_id", "conversion_label")
    positives = funnel.positives(future)
    return rounded(candidates.bucket_recall(_popular_lists(past, positives), positives, metrics.popularity_buckets(past), 100), "recall", digits=9)


@query("catalogue_recall", f"""WITH {SPLIT_SQL}, {PAIRS_SQL}, {_POPULAR_SQL}, w AS (SELECT DISTINCT product_id FROM past WHERE product_id::BIGINT % 3 > 0),
s AS (SELECT p.*, rank, unnest(CASE WHEN w.product_id IS NULL THEN ['all', 'cold'] ELSE ['all', 'warm'] END) AS slice FROM positives p LEFT JOIN popular USING (product_id) LEFT JOIN w ON w.product_id = p.product_id),
u AS (SELECT slice, cutoff, user_id, count(*) AS n, count(*) FILTER (rank <= cutoff) AS h FROM s, (VALUES (20), (100)) AS c(cutoff) GROUP BY ALL)
SELECT slice, cutoff, count(*) AS users, round(avg(h / n), 9) AS recall, round(avg((h > 0)::INT), 9) AS hit_rate FROM u GROUP BY ALL""")
def catalogue_recall(spark, sf_dir):
    past, future = _past_future(spark, sf_dir, "user_id", "product_id", "conversion_label")
    positives = funnel.positives(future)
    warm = past.where(F.col("product_id").cast("long") % 3 > 0)  # so that there are cold products
    found = candidates.catalogue_recall(_popular_lists(past, positives), positives, warm, interactions(spark, sf_dir), (20, 100))
    return rounded(found, "recall", "hit_rate", digits=9)


@query("positive_retention", f"""WITH {_SCORED_SQL}, t AS (SELECT user_id, candidate_ad_id, row_number() OVER (PARTITION BY user_id ORDER BY coarse_score DESC, rrf_score DESC, candidate_ad_id) AS rank FROM scored QUALIFY rank <= 3)
SELECT count(*) AS positives, count(rank) AS retained, round(count(rank) / count(*), 9) AS retention FROM positives p LEFT JOIN t ON t.user_id = p.user_id AND t.candidate_ad_id = p.product_id""")
def positive_retention(spark, sf_dir):
    past, positives = _judged(spark, sf_dir)
    return rounded(candidates.retention(candidates.coarse_top(_scored(past, positives), 3), positives), "retention", digits=9)


@query("mean_reciprocal_rank", f"""WITH {SPLIT_SQL}, {PAIRS_SQL}, {_POPULAR_SQL}, r AS (SELECT user_id, min(rank) AS r FROM positives LEFT JOIN popular USING (product_id) GROUP BY 1) SELECT count(*) AS users, round(avg(coalesce(1 / r, 0)), 9) AS mrr FROM r""")
def mean_reciprocal_rank(spark, sf_dir):
    past, future = _past_future(spark, sf_dir)
    positives = funnel.positives(future)
    return rounded(metrics.reciprocal_rank(_popular_lists(past, positives), positives, 100), "mrr", digits=9)


_NUMERIC = ("product_price", "clicks_last_7d")


def _auc_sql(c: str) -> str:
    return f"""(SELECT round(sum((n - tp) * (ctp - tp) + 0.5::DOUBLE * tp * (n - tp)) / (sum(tp) * sum(n - tp)), 6) FROM (
  SELECT *, sum(tp) OVER (ORDER BY {c} DESC) AS ctp FROM (SELECT {c}, sum(conversion_label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM interactions GROUP BY 1)))"""


@query("feature_diagnostics", f"WITH {INTERACTIONS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(avg({c}) FILTER (conversion_label = 1), 6) AS positive_mean, round(avg({c}) FILTER (conversion_label = 0), 6) AS negative_mean, round(avg(({c} <> 0)::INT), 6) AS nonzero, {_auc_sql(c)} AS roc_auc FROM interactions" for c in _NUMERIC))
def feature_diagnostics(spark, sf_dir):
    rows = interactions(spark, sf_dir)
    auc = None
    for c in _NUMERIC:
        one = metrics.ranking_quality(rows, "conversion_label", c).select(F.lit(c).alias("column"), "roc_auc")
        auc = one if auc is None else auc.unionByName(one)
    rates = audit.nonzero_rates(rows, list(_NUMERIC)).withColumnRenamed("rate", "nonzero")
    out = audit.class_means(rows, list(_NUMERIC), "conversion_label").join(rates, "column").join(auc, "column")
    return rounded(out, "positive_mean", "negative_mean", "nonzero", "roc_auc")


# --- splits and samples ---------------------------------------------------------------------------------------------


@query("past_halves", f"""WITH {SPLIT_SQL}, m AS (SELECT min(ts) AS m FROM (SELECT ts, sum(n) OVER (ORDER BY ts) AS upto, sum(n) OVER () AS total FROM (SELECT click_timestamp AS ts, count(*) AS n FROM past GROUP BY 1)) WHERE upto > ceil(0.5::DOUBLE * (total - 1)))
SELECT CASE WHEN click_timestamp <= m THEN 'past_a' ELSE 'past_b' END AS "window", count(*) AS rows, count(DISTINCT user_id) AS users, min(click_timestamp) AS min_timestamp, max(click_timestamp) AS max_timestamp FROM past, m GROUP BY 1""")
def past_halves(spark, sf_dir):
    halves = windows.split(_past_future(spark, sf_dir, "user_id", "product_id", "conversion_label")[0].drop("window"), "click_timestamp", 0.5, ("past_a", "past_b"))
    stats = windows.window_stats(halves).select("window", "rows", "users", "min_timestamp", "max_timestamp")
    windows.assert_window_order(stats, ["past_a", "past_b"])
    return stats


@query("calibration_split_stats", f"""WITH {STRICT_SQL}, s AS (SELECT *, CASE WHEN timestamp < start_0 THEN 'fit' ELSE 'later' END AS split FROM impressions, bounds)
SELECT split, count(*) AS rows, min(timestamp) AS timestamp_min, max(timestamp) AS timestamp_max, sum(click)::BIGINT AS ctr_positives, sum(click_and_conversion)::BIGINT AS ctcvr_positives, count(*) FILTER (click = 1) AS clicked_rows, sum(CASE WHEN click = 1 THEN conversion ELSE 0 END)::BIGINT AS clicked_conversions FROM s GROUP BY 1""")
def calibration_split_stats(spark, sf_dir):
    rows = impressions(spark, sf_dir)
    bound = F.broadcast(windows.strict_boundaries(rows, "timestamp", [0.5]))
    return candidates.click_stats(rows.crossJoin(bound).withColumn("split", F.when(F.col("timestamp") < F.col("start_0"), "fit").otherwise("later")), "split")


@query("group_validation", f"""WITH {INTERACTIONS_SQL}, g AS (SELECT user_id, max(click_timestamp) AS group_ts FROM interactions GROUP BY 1), b AS (SELECT floor(quantile_cont(group_ts, 0.8))::BIGINT AS b FROM g)
SELECT user_id, group_ts > b AS validation FROM g, b""")
def group_validation(spark, sf_dir):
    groups = interactions(spark, sf_dir).groupBy("user_id").agg(F.max("click_timestamp").alias("group_ts"))
    return sampling.time_validation(groups).select("user_id", "validation")


@query("hard_negatives")
def hard_negatives(spark, sf_dir):
    unit = recall.unit_vectors(table(spark, sf_dir, "embeddings"))
    near = staged(recall.vector_top_k(unit.where("vec_id % 20 = 0"), unit, 30), "near")
    return rounded(sampling.hard_negatives(near, near.where("rank <= 3"), 5, 10), "score", digits=9)


_POOL = "pool AS (SELECT product_id AS candidate_ad_id, row_number() OVER (ORDER BY count(*) DESC, product_id) - 1 AS pos, count(*) OVER () AS size FROM past GROUP BY 1)"


@query("drawn_negatives", f"""WITH {SPLIT_SQL}, {_POOL}, s AS (SELECT any_value(size) AS size FROM pool), h AS (SELECT user_id, list(DISTINCT pos) AS held FROM past JOIN pool ON candidate_ad_id = product_id GROUP BY 1),
r AS (SELECT user_id, product_id, draw, size, coalesce(held, []) AS held, list_transform(range(4), lambda t: {_HASH.format("'2026' || chr(31) || user_id || chr(31) || product_id || chr(31) || draw || chr(31) || t")} % size) AS tries
  FROM positives CROSS JOIN s CROSS JOIN (VALUES (1), (2)) AS d(draw) LEFT JOIN h USING (user_id)),
k AS (SELECT *, coalesce(list_filter(tries, lambda x: NOT list_contains(held, x))[1], list_filter(list_transform(range(1, len(held) + 2), lambda i: (tries[4] + i) % size), lambda x: NOT list_contains(held, x))[1]) AS pos FROM r)
SELECT user_id, product_id, draw, candidate_ad_id FROM k JOIN pool USING (pos)""")
def drawn_negatives(spark, sf_dir):
    past, future = _past_future(spark, sf_dir, "user_id", "product_id")
    pool = staged(sampling.past_pool(past).select("candidate_ad_id", "pos"), "pool")
    return candidates.drawn_negatives(funnel.positives(future), past.select("user_id", "product_id").distinct(), pool, 2)


@query("esmm_features", f"""WITH {IMPRESSIONS_SQL}, m AS (SELECT avg(ln(1 + cost)) FILTER (cost >= 0) AS m, stddev_pop(ln(1 + cost)) FILTER (cost >= 0) AS s FROM impressions)
SELECT event_id, {_HASH.format("coalesce(campaign_id, '__MISSING__')")} % 1009 AS sparse__campaign_id, {_HASH.format("user_id")} % 100003 AS sparse__user_id, round(coalesce(CASE WHEN cost >= 0 THEN (ln(1 + cost) - m) / s END, 0), 6) AS dense__cost,
  (NOT coalesce(cost >= 0, false))::INT AS dense__cost_missing, click, conversion, click_and_conversion FROM impressions, m""".replace("click_and_conversion FROM impressions, m", "click * conversion AS click_and_conversion FROM impressions, m"))
def esmm_features(spark, sf_dir):
    rows = impressions(spark, sf_dir)
    return rounded(features.esmm_features(rows, rows, {"campaign_id": 1009, "user_id": 100_003}, "cost"), "dense__cost")


# --- models ---------------------------------------------------------------------------------------------------------


@query("calibrator_selection")
def calibrator_selection(spark, sf_dir):
    """Curves of the earlier half, judged on the later one."""
    rows = windows.split(predictions(spark, sf_dir).select("timestamp", "click", "raw_pctr"), "timestamp", 0.5, ("fit", "later"))
    rows = staged(rows, "calibration")
    chosen, table_ = models.select_calibrator(rows.where("window = 'fit'"), rows.where("window = 'later'"), "click", "raw_pctr")
    return table_.withColumn("chosen", F.col("calibrator") == chosen)


def _training(spark, sf_dir, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(past, future) with these columns, written once: the threshold is one number, so that windows are plain filters."""
    rows = staged(interactions(spark, sf_dir).select("click_timestamp", *columns), "training")
    bound = F.lit(windows.higher_quantile(rows, "click_timestamp", 0.8).first()["threshold"])
    return rows.where(F.col("click_timestamp") <= bound), rows.where(F.col("click_timestamp") > bound)


@query("coarse_ranker")
def coarse_ranker(spark, sf_dir):
    """Boosted trees learned from the past, the best five of each user's later pairs."""
    columns = ["product_price", "clicks_last_7d"]
    past, future = _training(spark, sf_dir, "user_id", "product_id", *columns, "conversion_label")
    fit_on = past.withColumns({"label": F.col("conversion_label").cast("double"), "sample_weight": F.when(F.col("conversion_label") == 1, 3.0).otherwise(1.0)})
    model = models.fit_coarse_ranker(staged(models.merged_rows(fit_on, columns), "merged"), columns)
    scored = models.positive_probability(model, future, "coarse_score").groupBy("user_id", F.col("product_id").alias("candidate_ad_id")).agg(F.max("coarse_score").alias("coarse_score"))
    return rounded(candidates.coarse_top(scored.withColumn("rrf_score", F.lit(0.0)), 5).select("user_id", "candidate_ad_id", "coarse_score", "rank"), "coarse_score")


@query("fine_ranker")
def fine_ranker(spark, sf_dir):
    """Conversion and value models learned from the past, the best five of each user's later pairs by expected value."""
    columns = ["product_price", "clicks_last_7d", "product_brand", "device_type"]
    made = {"value_mask": (F.col("conversion_value_eur") >= 0).cast("int"), "log_conversion_value": F.log1p("conversion_value_eur")}
    past, future = (x.withColumns(made) for x in _training(spark, sf_dir, "user_id", "product_id", *columns, "conversion_label", "conversion_value_eur"))
    scored = models.predict_value(models.fit_value_ranker(past, columns), future, 20.0).withColumn("expected_value_score", candidates.finite("expected_value_score"))
    best = scored.groupBy("user_id", F.col("product_id").alias("candidate_ad_id")).agg(F.max("expected_value_score").alias("expected_value_score"), F.max("pCVR").alias("pCVR"))
    return rounded(candidates.fine_top(best, 5), "expected_value_score", "pCVR")


@query("click_and_conversion_model")
def click_and_conversion_model(spark, sf_dir):
    """Probabilities of impressions of the later half from models of the earlier one; pctcvr = pctr * pcvr."""
    rows = staged(windows.split(impressions(spark, sf_dir), "timestamp", 0.5, ("fit", "later")), "impressions")
    fitted = models.fit_click_and_conversion(rows.where("window = 'fit'"), ["campaign_id", "user_id"])
    out = models.predict_click_and_conversion(fitted, rows.where("window = 'later'"))
    return rounded(out.select("event_id", "raw_pctr", "raw_pctcvr", "raw_pcvr"), "raw_pctr", "raw_pctcvr", "raw_pcvr")


@query("two_tower_lists")
def two_tower_lists(spark, sf_dir):
    past, future = _past_future(spark, sf_dir)
    pairs = staged(_pairs(past), "pairs")
    return rounded(models.factor_lists(pairs, future.select("user_id").distinct(), 20), "two_tower_score")


# --- bidding --------------------------------------------------------------------------------------------------------


@query("search_value_score", f"WITH {INTERACTIONS_SQL} SELECT event_id, round(least(clicks_last_7d / 40, 1) * greatest(product_price - 1000, 0), 6) AS score_value_per_click FROM interactions")
def search_value_score(spark, sf_dir):
    score = auction.expected_value(F.col("clicks_last_7d") / 40, F.col("product_price") - 1000)
    return interactions(spark, sf_dir).select("event_id", F.round(score, 6).alias("score_value_per_click"))


def _won_sql(bid: str, name: str) -> str:
    return f"""SELECT '{name}' AS policy, auction_id, event_id AS winner, quality, bid, rank_score, least(bid, coalesce(nxt, rank_score) / greatest(quality, 1e-12)) AS price FROM (
  SELECT *, row_number() OVER w AS r, lead(rank_score) OVER w AS nxt FROM (SELECT auction_id, event_id, score_pctcvr AS quality, {bid} AS bid, score_pctcvr * ({bid}) AS rank_score FROM auctions) WINDOW w AS (PARTITION BY auction_id ORDER BY rank_score DESC, event_id)) WHERE r = 1"""


_BIDS = {
    **{f"target_cpa_{t}": (f"score_pctcvr * {t}.0::DOUBLE", lambda t=t: auction.target_cpa_bid(F.col("score_pctcvr"), float(t))) for t in (5, 10, 20)},
    **{f"target_roas_{t}": (f"score_pctcvr * greatest(cost, 0) / {t}.0::DOUBLE", lambda t=t: auction.value_bid(F.col("score_pctcvr"), F.col("predicted_value"), float(t))) for t in (2, 4)},
}


@query("bid_sensitivity", f"""WITH {GROUPED_SQL}, w AS ({' UNION ALL '.join(_won_sql(b, n) for n, (b, _) in _BIDS.items())}) SELECT policy, count(*) AS auctions, round(sum(price), 4) AS spend, round(avg(bid), 6) AS mean_bid FROM w GROUP BY 1""")
def bid_sensitivity(spark, sf_dir):
    rows = staged(_grouped(spark, sf_dir).withColumn("predicted_value", F.greatest(F.col("cost"), F.lit(0.0))), "grouped")
    value = candidates.predicted_value(rows, "predicted_value")
    out = None
    for name, (_, bid) in _BIDS.items():
        won = auction.clear_auctions(rows.withColumn("predicted_value", value).withColumns({"quality": F.col("score_pctcvr"), "bid": bid()}), "quality", "bid")
        one = won.agg(F.count(F.lit(1)).alias("auctions"), F.round(F.sum("second_price"), 4).alias("spend"), F.round(F.avg("winning_bid"), 6).alias("mean_bid")).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("calibration_impact", f"""WITH {GROUPED_SQL}, raw AS ({_won_sql("score_pctcvr * 10.0::DOUBLE", "raw")}),
cal AS ({_won_sql("score_pctcvr * 10.0::DOUBLE", "calibrated").replace("score_pctcvr", "(score_pctcvr * (1.5::DOUBLE - score_pctr))")})
SELECT count(*) AS auctions, count(*) FILTER (raw.winner <> cal.winner) AS changed FROM raw JOIN cal USING (auction_id)""")
def calibration_impact(spark, sf_dir):
    rows = staged(_grouped(spark, sf_dir), "grouped")
    clear = lambda p: auction.clear_auctions(rows.withColumns({"quality": p, "bid": auction.target_cpa_bid(p, 10.0)}), "quality", "bid")
    return auction.winner_changes(clear(F.col("score_pctcvr")), clear(F.col("score_pctcvr") * (1.5 - F.col("score_pctr"))))


@query("business_report", f"""WITH {_fold_sql((5.0, 20.0))}, t AS (SELECT budget, count(*) AS auctions, sum(won)::BIGINT AS impressions, sum(payment) AS spend FROM f WHERE i > 0 GROUP BY 1)
SELECT 'target_cpa' AS policy, budget, 'no_pacing' AS pacing, auctions, impressions, round(spend, 6) AS spend, round(budget - spend, 6) AS unspent FROM t""")
def business_report(spark, sf_dir):
    from adspark.queries import _cleared

    curve = auction.spend(_cleared(spark, sf_dir), [5.0, 20.0])
    sums = curve.groupBy("policy", "budget").agg(F.count(F.lit(1)).alias("auctions"), F.sum("won").alias("impressions"), F.sum("payment").alias("spend"))
    return sums.select("policy", "budget", F.lit("no_pacing").alias("pacing"), "auctions", "impressions", F.round("spend", 6).alias("spend"), F.round(F.col("budget") - F.col("spend"), 6).alias("unspent"))
